"""Language-model scoring with a Katz backoff bigram model.

Words and one end per text are the tokens; the first token's history is a start mark. With c the
training counts and D(c) the Good-Turing discount of a count,

    P(w)   = (c(w) - D1(c(w))) / N                       for known w, the rest of the mass for any unknown
    P(w|h) = (c(h,w) - D2(c(h,w))) / c(h)                if c(h,w) > 0
    P(w|h) = a(h) P(w)                                   otherwise; a(h) = 1 if h never was a history
    a(h)   = sum of D2 over w seen after h / c(h) / (1 - sum of P(w) over them)

so that the probabilities after every history add up to one exactly. Counts above GT_MAX lose LARGE,
so that no history is without mass for what it has not met. Where the counts of counts as they are don't
allow Good-Turing for every count of an order (gaps, copies in pairs), they are smoothed by a line through
their logarithms, as in Simple Good-Turing, and the order keeps Good-Turing discounts for all its counts.

How it runs. Documents are cut into blocks of about BLOCK_TOKENS tokens. A block knows each of its
distinct n-grams once; it sends their sorted 64-bit hash keys with training counts to the partition
of the count table that owns the key's range, and gets back the total counts in the same order.
Partitions are even, as keys are hashes, and a frequent n-gram costs one entry per block. The count
tables are written, partitioned by order. For each n-gram one block, its first, adds to the backoff
sums of the history; these go through a second exchange of the same kind, from which blocks get the
weights that their unseen bigrams need. Keys of 64 bits make two of a billion n-grams share a count
with a chance of about 3 percent.

Defined results: a null text is the empty one, whose only token is the end; an id may repeat or be null; a null
train flag counts as false, and a null id has a null ``held_out`` and trains nothing; without any training row N is 0 and both scores are 0; repeated rows
count and are scored as often as they are there; texts and words may be of any length; other columns are left out, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.langid import held_out
from linework.plans.tables import materialise

BLOCK_TOKENS = 2_000_000
#: Keys of a partition of the count tables, about.
PART_KEYS = 1_000_000
GT_MAX = 5
LARGE = 0.05
#: How counts of counts fall where there are too few to tell: as r ** ZIPF.
ZIPF = -2.0
END, START = 0, 1  # keys of the marks
BASE = 0.1


# ---- packing of sorted keys and of numbers ----


def _squeeze(a: np.ndarray) -> bytes:
    """Bytes of one place together, then zstd."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def _expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    return _squeeze(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_expand(data, np.uint64), dtype=np.uint64)


def join_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key for each pair of keys."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(29))


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's range begins and ends in sorted keys."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


# ---- blocks ----


def _blocks(batches: Iterator[pa.RecordBatch], id_type: pa.DataType, limit: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (id, text, train) rows: numbered tokens, frequent ones first, and the key of each number."""
    seq = count(TaskContext.get().partitionId() << 32)
    ids: list = []
    train: list[bool] = []
    parts: list[np.ndarray] = []
    words: defaultdict[bytes, int] = defaultdict(count(1).__next__)
    tokens = 0

    def close() -> pa.RecordBatch:
        flat = np.concatenate(parts)
        uses = np.bincount(flat, minlength=len(words) + 1)
        uses[0] = len(flat) + 1  # the end stays number 0
        order = np.argsort(-uses, kind="stable")
        number = np.empty(len(order), np.uint32)
        number[order] = np.arange(len(order))
        keys = np.fromiter((END, *map(xxhash.xxh64_intdigest, words)), np.uint64, len(words) + 1)[order]
        sizes = [len(p) for p in parts]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([next(seq)], pa.int64()),
                pa.array([len(flat)], pa.int64()),
                pa.array([ids], pa.list_(id_type)),
                pa.array([train], pa.list_(pa.bool_())),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.array([_squeeze(number[flat])], pa.binary()),
                pa.array([keys.tobytes()], pa.binary()),
            ],
            ["block", "tokens", "ids", "train", "sizes", "flat", "words"],
        )

    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            for i, text, t in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns), strict=True):
                found = (text or "").encode("utf-8", "surrogatepass").lower().split()
                parts.append(np.fromiter((*map(words.__getitem__, found), 0), np.uint32, len(found) + 1))
                ids.append(i)
                train.append(bool(t))
                tokens += len(found) + 1
                if tokens >= limit:
                    yield close()
                    words = defaultdict(count(1).__next__)
                    ids, train, parts, tokens = [], [], [], 0
    if ids:
        yield close()


class Block:
    """A block's tokens and its distinct n-grams, each order sorted by key."""

    def __init__(self, row: dict):
        words = np.append(np.frombuffer(row["words"], np.uint64), np.uint64(START))
        self.sizes = np.array(row["sizes"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tokens = _expand(row["flat"], np.uint32).astype(np.int64)
        self.history = np.concatenate([[0], self.tokens[:-1]])
        self.history[self.starts] = len(words) - 1
        train = np.repeat(np.array(row["train"], bool), self.sizes)
        counts = np.bincount(self.tokens[train], minlength=len(words) - 1)
        order = np.argsort(words[:-1])
        self.word_keys, self.word_counts, self.word_order = words[:-1][order], counts[order], order
        codes = self.history * len(words) + self.tokens
        self.pairs, self.pair_of = np.unique(codes, return_inverse=True)
        counts = np.bincount(self.pair_of[train], minlength=len(self.pairs))
        self.pair_history, self.pair_word = np.divmod(self.pairs, len(words))
        keys = join_keys(words[self.pair_history], words[self.pair_word])
        order = np.argsort(keys)
        self.pair_keys, self.pair_counts, self.pair_order = keys[order], counts[order], order
        self.words = words


_REQUEST = "level int, part int, block long, keys binary, counts binary"


def _requests(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row)
                out: list[tuple] = []
                for level, keys, counts in ((1, b.word_keys, b.word_counts), (2, b.pair_keys, b.pair_counts)):
                    at = cuts(keys, parts)
                    for p, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                        if hi > lo:
                            out.append((level, p, row["block"], pack_keys(keys[lo:hi]), _squeeze(counts[lo:hi].astype(np.uint32))))
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["level", "part", "block", "keys", "counts"])

    return run


_COUNTED = "kind string, level int, part int, block long, keys binary, counts binary, n long, total long, of_count array<long>"


def _count(table: pa.Table) -> pa.Table:
    """Totals of one partition's keys: a row of the count table, and a reply to each block."""
    table = table.sort_by("block")
    level, part = table["level"][0].as_py(), table["part"][0].as_py()
    sent = [unpack_keys(k.as_py()) for k in table["keys"]]
    counts = np.concatenate([_expand(c.as_py(), np.uint32) for c in table["counts"]])
    keys, first, back = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    totals = np.bincount(back, weights=counts).astype(np.int64)
    value = totals[back].astype(np.uint64) << np.uint64(1)
    value[first] |= np.uint64(1)  # the first block to name a key answers for it
    seen = totals > 0
    of_count = np.bincount(np.minimum(totals[seen], GT_MAX + 2), minlength=GT_MAX + 3)[1 : GT_MAX + 2]
    rows = [("counts", level, part, None, pack_keys(keys[seen]), _squeeze(totals[seen]), int(seen.sum()), int(totals.sum()), of_count.tolist())]
    ends = np.cumsum([len(s) for s in sent])
    for block, hi, s in zip(table["block"].to_pylist(), ends, sent, strict=True):
        rows.append(("reply", level, part, block, None, _squeeze(value[hi - len(s) : hi]), None, None, None))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = ["kind", "level", "part", "block", "keys", "counts", "n", "total", "of_count"]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


# ---- the model ----


def turing(of_count: list[int]) -> np.ndarray | None:
    """The kept parts of the counts 1 to GT_MAX by Good-Turing with the counts of counts as they are, if they allow it for all."""
    n = np.array([0, *of_count], float)
    r = np.arange(1, GT_MAX + 1)
    if (n[1:] > 0).all() and (common := (GT_MAX + 1) * n[GT_MAX + 1] / n[1]) < 1:
        kept = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
        if ((kept > 0) & (kept < 1)).all():
            return kept
    return None


def slope(of_count: list[int]) -> float:
    """Of the line through the logarithms of the counts of counts, each spread over the gap around it; ZIPF without two counts."""
    r = np.flatnonzero(of_count) + 1
    if len(r) < 2:
        return ZIPF
    before, after = np.concatenate([[0], r[:-1]]), np.append(r[1:], 2 * r[-1] - r[-2])
    return np.polyfit(np.log(r), np.log(2 * np.array(of_count, float)[r - 1] / (after - before)), 1)[0]


def smoothed(of_count: list[int]) -> np.ndarray:
    """The same with counts of counts that fall as r ** slope. A slope of -1 or more can't discount and counts as -1, in the limit."""
    power = slope(of_count) + 1
    r = np.arange(1, GT_MAX + 1)
    if power > -1e-6:
        return 1 - np.log1p(1 / r) / np.log(GT_MAX + 1)
    common = (GT_MAX + 1) ** power
    return ((1 + 1 / r) ** power - common) / (1 - common)


def discounts(of_count: list[int]) -> np.ndarray:
    """D(c) for c from 0 to GT_MAX, and for all larger c, from the numbers of n-grams seen 1, 2, ... times."""
    kept = turing(of_count)
    if kept is None:
        kept = smoothed(of_count)
    return np.concatenate([[0], np.arange(1, GT_MAX + 1) * (1 - kept), [LARGE]])


def discount(d: np.ndarray, c: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, GT_MAX + 1)]


class Scalars:
    """What all blocks need to know of the count tables."""

    def __init__(self, by_level: dict[int, tuple[int, int, list[int]]]):
        empty = (0, 0, [0] * (GT_MAX + 1))
        self.types, self.total, of_count = by_level.get(1, empty)
        self.d1, self.d2 = discounts(of_count), discounts(by_level.get(2, empty)[2])
        held = [of_count[r - 1] * self.d1[r] for r in range(1, GT_MAX + 1)]
        self.unknown = sum(held) + (self.types - sum(of_count[:GT_MAX])) * self.d1[-1]

    def word(self, c: np.ndarray) -> np.ndarray:
        """P(w) of words by their counts."""
        return np.where(c > 0, c - discount(self.d1, c), self.unknown) / max(1, self.total)


_SCORED = "kind string, part int, block long, ids array<{id}>, sizes array<int>, known array<int>, base array<double>, score array<double>, wait array<int>, keys binary, a binary, b binary"
_SCORED_NAMES = ["kind", "part", "block", "ids", "sizes", "known", "base", "score", "wait", "keys", "a", "b"]


def _replies(right: pa.Table, level: int) -> np.ndarray:
    of = right.filter(pa.compute.equal(right["level"], level)).sort_by("part")
    return np.concatenate([_expand(c.as_py(), np.uint64) for c in of["counts"]])


def _per_doc(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts)


def _score(s: Scalars, parts: int, id_type: pa.DataType):
    """A block and its counts: all but the backoff weights, which are asked for."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [
            pa.string(), pa.int32(), pa.int64(), pa.list_(id_type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()),
            pa.list_(pa.float64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(),
        ]
        row = left.to_pylist()[0]
        b = Block(row)
        c1 = np.zeros(len(b.words), np.int64)
        c1[b.word_order] = (_replies(right, 1) >> np.uint64(1)).astype(np.int64)
        reply = _replies(right, 2)
        c2, owner = np.zeros(len(b.pairs), np.int64), np.zeros(len(b.pairs), bool)
        c2[b.pair_order], owner[b.pair_order] = (reply >> np.uint64(1)).astype(np.int64), (reply & np.uint64(1)).astype(bool)
        c1[-1] = c1[0]  # as many starts as ends
        p1 = s.word(c1)
        with np.errstate(divide="ignore"):
            ph = c1[b.pair_history].astype(float)
            pw = p1[b.pair_word]
            seen = c2 > 0
            pair_score = np.log10(np.where(seen, (c2 - discount(s.d2, c2)) / np.maximum(ph, 1), np.where(ph > 0, pw / np.maximum(ph, 1), pw)))
            base = np.log10((c1 + BASE) / (s.total + BASE * (s.types + 1)))
        waits = ~seen & (ph > 0)
        if not s.total:
            pair_score[:], base[:], waits[:] = 0, 0, False

        mine = owner & seen  # sums over what follows each history
        lost = np.bincount(b.pair_history[mine], weights=discount(s.d2, c2[mine]), minlength=len(b.words))
        mass = np.bincount(b.pair_history[mine], weights=pw[mine], minlength=len(b.words))
        given = np.flatnonzero(np.bincount(b.pair_history[mine], minlength=len(b.words)))
        given = given[np.argsort(b.words[given])]
        asked = np.unique(b.pair_history[waits])
        asked = asked[np.argsort(b.words[asked])]
        place = np.full(len(b.words), -1, np.int32)
        place[asked] = np.arange(len(asked))
        wait = np.where(waits, place[b.pair_history], -1)[b.pair_of]

        nothing = [None] * 9
        rows = [
            ("block", None, row["block"], row["ids"], row["sizes"], _per_doc((c1[b.tokens] > 0).astype(np.int64), b.starts), _per_doc(base[b.tokens], b.starts),
             _per_doc(pair_score[b.pair_of], b.starts), _per_doc((wait >= 0).astype(np.int64), b.starts), None, _squeeze(wait[wait >= 0].astype(np.int32)), None)
        ]
        for kind, which in (("sum", given), ("ask", asked)):
            keys = b.words[which]
            at = cuts(keys, parts)
            for p, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
                if hi > lo:
                    w = which[lo:hi]
                    sums = (_squeeze(lost[w]), _squeeze(mass[w])) if kind == "sum" else (None, None)
                    rows.append((kind, p, row["block"], *nothing[:6], pack_keys(keys[lo:hi]), *sums))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _SCORED_NAMES)

    return run


def _weights(table: pa.Table) -> pa.Table:
    """log10 of the backoff weight times c(h) for every history that a block asked for."""
    table = table.sort_by("block")
    rows = table.select(["kind", "block", "keys", "a", "b"]).to_pylist()
    sums = [r for r in rows if r["kind"] == "sum"]
    keys, back = np.unique(np.concatenate([np.zeros(0, np.uint64), *(unpack_keys(r["keys"]) for r in sums)]), return_inverse=True)
    add = lambda k: np.bincount(back, weights=np.concatenate([np.zeros(0), *(_expand(r[k], np.float64) for r in sums)]), minlength=len(keys))
    weight = np.log10(add("a") / (1 - add("b")))
    out = []
    for r in rows:
        if r["kind"] == "ask":
            out.append((table["part"][0].as_py(), r["block"], _squeeze(weight[np.searchsorted(keys, unpack_keys(r["keys"]))])))
    columns = list(zip(*out)) or [(), (), ()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), pa.binary()])], ["part", "block", "a"])


def _finish(id_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        score, wait = np.array(row["score"]), np.array(row["wait"])
        if wait.any():
            weight = np.concatenate([_expand(x.as_py(), np.float64) for x in right.sort_by("part")["a"]])
            of = np.repeat(np.arange(len(wait)), wait)
            score = score + np.bincount(of, weights=weight[_expand(row["a"], np.int32)], minlength=len(wait))
        return pa.table(
            [pa.array(row["ids"], id_type), pa.array(row["sizes"], pa.int64()), pa.array(row["known"], pa.int64()), pa.array(row["base"]), pa.array(score)],
            ["id", "n_tokens", "n_known", "base_score", "score"],
        )

    return run


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(scores, counts): scores has id, n_tokens, n_known, train_tokens, base_score and score of every row,
    learnt from the rows where ``train`` holds; counts is the written count table (level, part, packed
    keys and counts, n, total)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    id_type = pa.array([], rows.limit(0).select("id").toArrow().schema.field("id").type).type
    blocks = materialise(
        rows.mapInArrow(lambda it, limit=BLOCK_TOKENS: _blocks(it, id_type, limit), f"block long, tokens long, ids array<{kind}>, train array<boolean>, sizes array<int>, flat binary, words binary"),
        "katz-blocks",
    )
    tokens = blocks.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    parts = max(4, -(-tokens // PART_KEYS))
    requests = blocks.drop("tokens", "ids").mapInArrow(_requests(parts), _REQUEST)
    counted = materialise(requests.groupBy("level", "part").applyInArrow(_count, _COUNTED), "katz-counts", ("kind",))
    counts = counted.where("kind = 'counts'")
    by_level = counts.groupBy("level").agg(
        F.sum("n").alias("n"), F.sum("total").alias("t"), *[F.sum(F.get("of_count", F.lit(i))).alias(f"r{i}") for i in range(GT_MAX + 1)]
    )
    s = Scalars({r["level"]: (r["n"], r["t"], [r[f"r{i}"] for i in range(GT_MAX + 1)]) for r in by_level.collect()})
    replies = counted.where("kind = 'reply'").select("block", "level", "part", "counts")
    scored = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(s, parts, id_type), _SCORED.format(id=kind))
    scored = materialise(scored, "katz-scores", ("kind",))
    weights = scored.where("kind in ('sum', 'ask')").select("kind", "part", "block", "keys", "a", "b")
    weights = weights.groupBy("part").applyInArrow(_weights, "part int, block long, a binary")
    done = scored.where("kind = 'block'").select("block", "ids", "sizes", "known", "base", "score", "wait", "a").groupBy("block")
    scores = done.cogroup(weights.groupBy("block")).applyInArrow(_finish(id_type), f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    named = scores.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(s.total).cast("long").alias("train_tokens"), "base_score", "score")
    return named, counts



def op6_katz(spark, sf_dir: str) -> DataFrame:
    """All of documents scored by a model of nine tenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scores, _ = katz_scores(docs, ~held_out("doc_id", 10))
    return scores.select("doc_id", held_out("doc_id", 10).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
