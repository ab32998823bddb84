"""Byte-level BPE encoding and decoding by merge replay over the distinct words of the corpus.

A text is cut into words by the vocabulary's pattern. Blocks of documents number their words and are
written in buckets; a word that is no token by itself is asked for by each block once. The distinct words so asked
for, of the whole corpus, come together sorted and are encoded once each: an inverted index leads from
the rank of a pair to the places (word, node) where it stands, a heap gives the lowest rank that still
has places, and a merge touches only the two neighbours of its place. Places are merged in the order in
which one word alone would be (lowest rank, then leftmost), so the ids equal those of encoding each word
by itself. The ids go back to the blocks that asked. What moves is linear in the number of (block,
distinct word) pairs, and a frequent word is one of them per block; texts and blocks don't move. The index is over BATCH_BYTES of the distinct words of a partition at a time.

Defined results: a null text is the empty text and has no ids; null ids decode to empty bytes; ids
outside the vocabulary are an error; a lone surrogate can't occur in Spark strings; a word may be of any
length; an empty table gives an empty result; null or repeated ids and other columns are carried as they
are, whatever their names, but one named like the result is replaced.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.plans.tables import bucketed, give_back

#: Code points of text in a block.
BLOCK_CHARS = 12_000_000
#: Parts into which a block's words are dealt by hash.
PARTS = 1024
#: Bytes of distinct words that are encoded together, and rows that ask for them.
BATCH_BYTES, BATCH_ROWS = 1_000_000, 250_000
#: Bytes of a word that may put places back into the index.
LONG = 512


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks of tokens, and the rank that a pair of tokens merges to."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.end = max(ranks.values()) + 1  # stands where no token is
        get = ranks.get
        pairs = {
            a * (self.end + 1) + b: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None
        }
        self.codes = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.merged = np.fromiter(map(pairs.__getitem__, self.codes.tolist()), np.int64, len(pairs))
        self.table = pairs

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE if they don't merge."""
        code = a * (self.end + 1) + b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.merged[at], self.NONE)


def by_heap(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word, in n log n steps: a heap of (rank, place) and links to the neighbours."""
    pairs, end = vocabulary.table, vocabulary.end
    ids = vocabulary.bytes[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at: list[int | None] = [pairs.get(a * (end + 1) + b) for a, b in zip(ids, ids[1:])] + [None]
    heap = [(r, k) for k, r in enumerate(rank_at) if r is not None]
    heapq.heapify(heap)
    while heap:
        rank, k = heapq.heappop(heap)
        if rank_at[k] != rank:
            continue
        gone = after[k]
        right, left = after[gone], before[k]
        ids[k], ids[gone], rank_at[gone], after[k] = rank, -1, None, right
        if right < n:
            before[right] = k
        for at, to in ((left, k), (k, right)):
            if at >= 0:
                rank_at[at] = new = pairs.get(ids[at] * (end + 1) + ids[to]) if to < n else None
                if new is not None:
                    heapq.heappush(heap, (new, at))
    return [i for i in ids if i >= 0]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and the number of each word's: merges in rank order.

    A rank's step merges all its places, of overlapping ones every second from the left. Where that
    would make a pair of a lower rank, which has to go first, only the word's leftmost place is merged
    and the others go back into the index; a word of more than LONG bytes then goes to ``by_heap``.
    """
    sizes = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)  # node n stands for no node
    ids = np.append(vocabulary.bytes[data], vocabulary.end)
    word = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[ends[sizes > 0] - 1], before[(ends - sizes)[sizes > 0]] = n, n
    after[n] = before[n] = n
    rank_at = vocabulary.pair(ids, ids[after])
    places: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def put(rank: int, nodes: np.ndarray) -> None:
        if rank in places:
            places[rank].append(nodes)
        else:
            places[rank] = [nodes]
            heapq.heappush(heap, rank)

    def index(nodes: np.ndarray) -> None:
        ranks = rank_at[nodes]
        order = np.argsort(ranks, kind="stable")
        nodes, ranks = nodes[order], ranks[order]
        cut = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cut])].tolist() if len(ranks) else (), np.split(nodes, cut)):
            put(rank, part)

    index(np.flatnonzero(rank_at != Vocabulary.NONE))
    while heap:
        rank = heapq.heappop(heap)
        found = places.pop(rank)
        nodes = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
        nodes = nodes[rank_at[nodes] == rank]
        if not len(nodes):
            continue
        if len(nodes) > 1:
            first = np.concatenate([[True], after[nodes[:-1]] != nodes[1:]])  # of a run of overlapping places
            at = np.arange(len(nodes))
            pick = nodes[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            gone, left = after[pick], before[pick]
            beside = np.concatenate([[False], left[1:] == gone[:-1]])  # what stands before is merged as well
            new = vocabulary.pair(np.where(beside, rank, ids[left]), np.full(len(pick), rank))
            new = np.minimum(new, vocabulary.pair(np.full(len(pick), rank), ids[after[gone]]))
            if (new < rank).any():
                held = np.unique(word[pick[new < rank]])
                alone = np.isin(word[nodes], held)
                slow = held[sizes[held] > LONG]
                for w in slow.tolist():
                    lo, hi = ends[w] - sizes[w], ends[w]
                    done = by_heap(words[w], vocabulary)
                    ids[lo : lo + len(done)], ids[lo + len(done) : hi], rank_at[lo:hi] = done, -1, Vocabulary.NONE
                rest = nodes[alone & (rank_at[nodes] == rank)]
                lone = np.concatenate([[True], word[rest[1:]] != word[rest[:-1]]])[: len(rest)]
                if not lone.all():
                    put(rank, rest[~lone])
                nodes = np.sort(np.concatenate([pick[~np.isin(word[pick], held)], rest[lone]]))
                if not len(nodes):
                    continue
            else:
                nodes = pick
        gone = after[nodes]
        right = after[gone]
        ids[nodes], ids[gone], rank_at[gone] = rank, -1, Vocabulary.NONE
        after[nodes], before[right] = right, nodes
        left = before[nodes]
        touched = np.unique(np.concatenate([left[left != n], nodes]))
        rank_at[touched] = vocabulary.pair(ids[touched], ids[after[touched]])
        touched = touched[rank_at[touched] != Vocabulary.NONE]
        if len(touched):
            index(touched)
    alive = ids[:n] >= 0
    return ids[:n][alive].astype(np.int32), np.bincount(word[alive], minlength=len(words))


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    """A worker reads a vocabulary once."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(load_ranks(path))
    return _vocabularies[path]


# ---- blocks of texts, as numbers of their words ----


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of one place together, then zstd."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 3)


def _expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


_BLOCK = "block long, rows array<struct<{rest}>>, sizes binary, flat binary, known binary, asks array<struct<part:int,base:int,words:binary>>"
#: Stands between words; no UTF-8 text has it.
_GAP = b"\xff"


def _asks(words: list[str]) -> tuple[np.ndarray, pa.StructArray]:
    """The order in which words are asked for, and what each part is asked for: (part, place of its first word, words)."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    parts = np.fromiter((xxhash.xxh64_intdigest(words[i]) % PARTS for i in order.tolist()), np.int32, len(words))
    by_part = np.argsort(parts, kind="stable")
    order, parts = order[by_part], parts[by_part]
    base = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]])) if len(parts) else np.zeros(0, np.int64)
    joined = [zstandard.compress(_GAP.join(words[i].encode() for i in of.tolist()), 3) for of in np.split(order, base[1:])] if len(base) else []
    return order, pa.StructArray.from_arrays([pa.array(parts[base]), pa.array(base.astype(np.int32)), pa.array(joined, pa.binary())], ["part", "base", "words"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, base, words) to (word, block, at)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            lists = [zstandard.decompress(w).split(_GAP) for w in part.column(2).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            block, base = (np.repeat(np.asarray(part.column(k)), sizes) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array([w for ws in lists for w in ws], pa.binary()), pa.array(block), pa.array(base + within)], ["word", "block", "at"])


def _blocks(pattern: str, path: str, rest: list[str]):
    """(carried columns, text) to blocks: the words of each text as numbers, and of each number the id, or the
    place -1, -2, ... among the words asked for if it is no token by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, ranks = regex.compile(pattern).findall, load_ranks(path)
        seq = count(TaskContext.get().partitionId() << 32)
        numbers, parts, rows, chars = _Numbers(), [], [], 0

        def close() -> pa.RecordBatch:
            sizes = np.array([len(p) for p in parts], np.uint32)
            flat = np.concatenate([np.zeros(0, np.uint32), *parts])
            parts.clear()
            uses = np.bincount(flat, minlength=len(numbers))
            order = np.argsort(-uses, kind="stable")  # frequent words have small numbers
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            flat = place[flat]
            words = list(numbers)
            numbers.clear()
            words = [words[i] for i in order.tolist()]
            known = np.array([ranks.get(w.encode(), -1) for w in words], np.int32)
            order, asks = _asks([w for w, k in zip(words, known.tolist(), strict=True) if k < 0])
            known[np.flatnonzero(known < 0)[order]] = -1 - np.arange(len(order))
            carried = pa.concat_arrays(rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([next(seq)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(carried)], pa.int32()), carried),
                    *(pa.array([_squeeze(x)], pa.binary()) for x in (sizes, flat, known)),
                    pa.ListArray.from_arrays(pa.array([0, len(asks)], pa.int32()), asks),
                ],
                ["block", "rows", "sizes", "flat", "known", "asks"],
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for text in part.column(len(rest)).to_pylist():
                    found = cut(text or "")
                    parts.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                    chars += len(text or "")
                own = pa.array(np.arange(len(part)))  # copies, so that no text is held by its neighbours
                rows.append(pa.StructArray.from_arrays([c.take(own) for c in part.columns[: len(rest)]], rest))
                if chars >= BLOCK_CHARS:
                    yield close()
                    numbers, parts, rows, chars = _Numbers(), [], [], 0
                    give_back()
        if rows:
            yield close()
        del numbers, parts, rows, ranks
        give_back()

    return run


def _encode_words(path: str):
    """(word, block, at), sorted by word, to (asking, at, counts, ids): the ids of the words that a block asked
    for. Each word is encoded once, BATCH_BYTES of distinct words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        words, held, rows, size = [], [], 0, 0  # distinct words, and (number of the word, block, at) of what asks for them

        def flush() -> Iterator[pa.RecordBatch]:
            number, block, at = (np.concatenate(c) for c in zip(*held))
            ids, counts = replay(words, vocabulary)
            starts = np.cumsum(counts) - counts
            order = np.argsort(block, kind="stable")
            number, block, at = number[order], block[order], at[order]
            cut = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(block))
            n = counts[number]
            upto = np.concatenate([[0], np.cumsum(n)])
            flat = ids[np.repeat(starts[number] - upto[:-1], n) + np.arange(upto[-1])]
            for lo in range(0, len(cut) - 1, 4096):
                ends = cut[lo : lo + 4097]
                packed = [[_squeeze(v[a:b].astype(np.uint32)) for a, b in zip(o[:-1].tolist(), o[1:].tolist())] for o, v in ((ends, at), (ends, n), (upto[ends], flat))]
                yield pa.RecordBatch.from_arrays([pa.array(block[ends[:-1]]), *(pa.array(p, pa.binary()) for p in packed)], ["asking", "at", "counts", "ids"])

        for batch in batches:
            number = np.empty(batch.num_rows, np.int64)
            for i, word in enumerate(batch.column(0).to_pylist()):
                if not words or word != words[-1]:
                    words.append(word)
                    size += len(word)
                number[i] = len(words) - 1
            held.append((number, np.asarray(batch.column(1)), np.asarray(batch.column(2))))
            rows += batch.num_rows
            if size >= BATCH_BYTES or rows >= BATCH_ROWS:
                yield from flush()
                words, held, rows, size = [], [], 0, 0
                give_back()
        if rows:
            yield from flush()
        del words, held
        give_back()

    return run


def _fill(rest: list[str], ids_col: str):
    """A block and the ids of its words to the rows it carries, with ids."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_batches()[0]
        per_text, flat, known = (_expand(block.column(k)[0].as_py(), kind) for k, kind in ((2, np.uint32), (3, np.uint32), (4, np.int32)))
        at, of, new = (np.concatenate([np.zeros(0, np.uint32), *(_expand(x.as_py(), np.uint32) for x in right[name])]).astype(np.int64) for name in ("at", "counts", "ids"))
        # words that were asked for stand behind the tokens: word -1 has the ids from base[0] on
        of_word, base = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        of_word[at], base[at] = of, np.cumsum(of) - of
        ids = np.concatenate([known, new.astype(np.int32)])
        asked = known < 0
        counts, begins = np.ones(len(known), np.int64), np.arange(len(known))
        counts[asked], begins[asked] = of_word[-1 - known[asked]], len(known) + base[-1 - known[asked]]
        rows = block.column(1).flatten()
        fields = [rows.field(k) for k in range(len(rest))]
        text_ends = np.concatenate([[0], np.cumsum(per_text, dtype=np.int64)])
        out_batches = []
        for lo in range(0, len(per_text), 512):
            hi = min(len(per_text), lo + 512)
            words = flat[text_ends[lo] : text_ends[hi]].astype(np.int64)
            sizes = counts[words]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            out = ids[np.repeat(begins[words] - upto[:-1], sizes) + np.arange(upto[-1])]
            offsets = upto[text_ends[lo : hi + 1] - text_ends[lo]].astype(np.int32)
            done = pa.ListArray.from_arrays(pa.array(offsets), pa.array(out))
            out_batches.append(pa.RecordBatch.from_arrays([*(f.slice(lo, hi - lo) for f in fields), done], [*rest, ids_col]))
        give_back()
        return pa.Table.from_batches(out_batches)

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` without its text and with ``ids_col`` (array<int>), in place of a column of that name.
    ``vocabulary`` is a path on every executor."""
    rest = [c for c in docs.columns if c not in (text_col, ids_col)]
    names = [f"c{i}" for i in range(len(rest) + 1)]  # the last is there in case there is no other
    kinds = [docs.schema[c].dataType.simpleString() for c in rest] + ["boolean"]
    fields = [f"{n}:{k}" for n, k in zip(names, kinds, strict=True)]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(rest, names)], F.lit(True).alias(names[-1]), F.col(text_col).alias("text"))
    blocks = bucketed(rows.mapInArrow(_blocks(pattern, vocabulary, names), _BLOCK.format(rest=",".join(fields))), "bpe-blocks", "block")
    asked = blocks.select("block", F.explode("asks").alias("a")).repartition("a.part").select("block", "a.base", "a.words")
    asked = asked.mapInArrow(_asked, "word binary, block long, at long").sortWithinPartitions("word")
    replies = asked.mapInArrow(_encode_words(vocabulary), "asking long, at binary, counts binary, ids binary")
    done = blocks.drop("asks").groupBy("block").cogroup(replies.groupBy("asking"))
    schema = ", ".join([f"{n} {k}" for n, k in zip(names, kinds, strict=True)] + [f"`{ids_col}` array<int>"])
    return done.applyInArrow(_fill(names, ids_col), schema).select(*[F.col(n).alias(c) for c, n in zip(rest, names)], ids_col)


_tokens: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _table(vocabulary: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens one after the other; where each id's begin, and how many they are."""
    if vocabulary not in _tokens:
        ranks = load_ranks(vocabulary)
        order = sorted(ranks, key=ranks.__getitem__)
        sizes = np.zeros(ranks[order[-1]] + 1, np.int64)
        sizes[[ranks[t] for t in order]] = [len(t) for t in order]
        _tokens[vocabulary] = np.frombuffer(b"".join(order), np.uint8), np.cumsum(sizes) - sizes, sizes
    return _tokens[vocabulary]


def bpe_decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """``encoded`` with ``bytes_col`` (binary), in place of a column of that name: the bytes of its ids."""
    encoded = encoded.drop(bytes_col)
    rest = encoded.columns
    where = rest.index(ids_col)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema] + [f"`{bytes_col}` binary"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = _table(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(where)
                ids = np.asarray(lists.flatten()).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes[ids])])
                found = data[np.repeat(starts[ids] - ends[:-1], sizes[ids]) + np.arange(ends[-1])]
                counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
                offsets = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*rest, bytes_col])

    return encoded.mapInArrow(decode, schema)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every text of documents encoded and decoded again."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = bpe_decode(bpe_encode(docs, vocabulary, public_tokenizers.PATTERN), vocabulary)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
