"""Benchmark decontamination with one Aho-Corasick automaton over words.

Benchmark texts become windows of 13 consecutive words (a shorter item is one window). All windows
go into one automaton, whose symbols are word numbers; every document is scanned once, and each match
marks its words. ASCII letters are lowered and all ASCII separators become spaces by a byte-for-byte
mapping, so the place of a word in the normalised bytes is its place in the original and spans can be
given as code points of the original text.

The automaton is three flat arrays of 16 bytes a state: the sorted keys (state before, word), where a
state's number is its key's place, the failure links, and the nearest window that ends in a state. It is
built level by level and written once to the shared folder; tasks map the file into memory, so that the
workers of a machine share its pages and a new executor finds it again. As no state knows more than 13
words, the words of many texts are cut into stretches that overlap by 12 and scanned side by side.

A benchmark of at most MAX_PATTERN_BYTES is held that way. Of a larger one neither the driver nor a task
ever holds all: the windows stay a distributed table and only a bitmap of their hashes, of fixed size, is
sent; the texts are scanned once just the same, windows whose bit is set are looked up in the table by
their words, and what is found is put together per document. Both ways give the same rows.

Defined results: null has no words; a document without words is not contaminated; items without
words match nothing; repeated items count by their id once; a null item id is the string ''; null and
repeated document ids stay as they are; texts and items may be of any length; columns are carried as asked
for, whatever their names; an empty benchmark hits nothing, no documents give no rows.
"""

from __future__ import annotations

import io
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.plans.tables import materialise, new_path
from linework.sources.files import open_file, write_file

WINDOW = 13
#: Text of the benchmark that an automaton may hold.
MAX_PATTERN_BYTES = 1 << 24
#: Words that are scanned together.
RUN_WORDS = 1 << 19
#: Bits of the map of a larger benchmark's windows: 16 MB.
BITMAP_BITS = 1 << 27

#: ASCII letters lowered, digits kept, bytes from 0x80 kept, the rest a space.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

SCHEMA = (
    "id {id}, n_words long, n_hit long, item_ids array<string>, "
    "spans array<struct<start:int,end:int>>"
)


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Windows:
    """The automaton over the windows of some items, and the items of each window.

    States are numbered by depth, state 0 is the root; ``levels[d]`` is the first state of depth ``d``.
    """

    ARRAYS = ("keys", "fail", "out", "levels", "ends", "starts", "items")

    def __init__(self, arrays: dict[str, np.ndarray], words: list[bytes], names: list[str]):
        self.keys, self.fail, self.out, self.levels, self.ends, self.starts, self.items = (arrays[n] for n in self.ARRAYS)
        self.names, self.words = names, words
        self.numbers = {w: i for i, w in enumerate(words, 1)}
        self.width = len(words) + 1
        self.roots = np.zeros(self.width, np.int32)
        if len(self.keys):
            first = self.keys[: self.levels[2] - 1]
            self.roots[first] = np.arange(1, len(first) + 1)

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int) -> Windows:
        """Build the automaton level by level, all states of a level at once."""
        numbers: dict[bytes, int] = {}
        names = sorted({i for i, _ in items})
        rank = {n: i for i, n in enumerate(names)}
        texts = [(rank[i], np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(t)], np.int32)) for i, t in items]
        texts = [(i, w) for i, w in texts if len(w)]
        rows = [np.lib.stride_tricks.sliding_window_view(w, window) if len(w) >= window else np.pad(w, (0, window - len(w)))[None] for _, w in texts]
        patterns = np.concatenate([np.zeros((0, window), np.int32), *rows])
        item = np.repeat(np.array([i for i, _ in texts], np.int64), [len(r) for r in rows])
        width = len(numbers) + 1
        state, levels, keys = np.zeros(len(patterns), np.int64), [0, 1], []
        for depth in range(window):
            more = np.flatnonzero(patterns[:, depth])
            found, place = np.unique(state[more] * width + patterns[more, depth], return_inverse=True)
            state[more] = levels[-1] + place
            levels.append(levels[-1] + len(found))
            keys.append(found)
        ends = np.unique(state)
        pairs = np.unique(state * len(names) + item) if names else np.zeros(0, np.int64)
        out = np.zeros(levels[-1], np.int32)
        out[ends] = ends
        arrays = {
            "keys": np.concatenate(keys), "fail": np.zeros(levels[-1], np.int32), "out": out, "levels": np.array(levels, np.int64), "ends": ends,
            "starts": np.searchsorted(pairs, np.append(ends, levels[-1]) * len(names)), "items": (pairs % max(1, len(names))).astype(np.int32),
        }
        made = cls(arrays, list(numbers), names)
        for depth in range(2, window + 1):
            lo, hi = levels[depth], levels[depth + 1]
            before, word = np.divmod(made.keys[lo - 1 : hi - 1], width)
            at, todo = made.fail[before], np.arange(lo, hi)
            while len(todo):
                to = made.step(at, word)
                made.fail[todo] = np.maximum(to, 0)
                on = np.flatnonzero((to < 0) & (at > 0))
                todo, word, at = todo[on], word[on], made.fail[at[on]]
            none = np.flatnonzero(out[lo:hi] == 0) + lo
            out[none] = out[made.fail[none]]
        return made

    def write(self, folder: str) -> None:
        """One file per array and one of the words and names."""
        for name in self.ARRAYS:
            np.save(to := io.BytesIO(), getattr(self, name))
            write_file(f"{folder}/{name}.npy", to.getbuffer())
        write_file(f"{folder}/names", pickle.dumps((self.words, self.names)))

    @classmethod
    def read(cls, folder: str) -> Windows:
        """The arrays are mapped where the folder is one of the machine's, and read from elsewhere."""
        arrays = {}
        for name in cls.ARRAYS:
            with open_file(f"{folder}/{name}.npy") as file:
                local = isinstance(file, io.FileIO)
                arrays[name] = np.load(file.name, mmap_mode="r") if local else np.load(io.BytesIO(file.read()))
        with open_file(f"{folder}/names") as file:
            return cls(arrays, *pickle.loads(file.read()))

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states one word deeper, -1 where there is none."""
        key = state.astype(np.int64) * self.width + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at + 1, -1)

    def matches(self, words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of last words, and the states of the windows that end there (word 0 is in no window)."""
        if not len(self.keys) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        # what a state of depth 0 or 1 leads to is known for all places at once
        short = self.roots[words]
        pair = np.flatnonzero((short[:-1] > 0) & (words[1:] > 0))
        two = self.step(short[pair], words[pair + 1])
        short[pair[two > 0] + 1] = two[two > 0]
        deep, lap = self.levels[2], window - 1
        size = min(512, max(64, math.isqrt(len(words)) // 2))
        lanes = -(-len(words) // size)

        def side_by_side(of: np.ndarray) -> np.ndarray:
            padded = np.zeros(lap + lanes * size, np.int32)
            padded[lap : lap + len(of)] = of
            return np.array(np.lib.stride_tricks.sliding_window_view(padded, lap + size)[::size].T, order="C")

        symbols, least = side_by_side(words), side_by_side(short)
        state, places, states = np.zeros(lanes, np.int32), [], []
        for t in range(lap + size):
            on = np.flatnonzero((state >= deep) & (symbols[t] > 0))
            at, word, state = state[on], symbols[t][on], least[t]
            while len(on):
                to = self.step(at, word)
                state[on[to > 0]] = to[to > 0]
                miss = to < 0
                at = self.fail[at[miss]]
                keep = at >= deep
                on, word, at = on[miss][keep], word[miss][keep], at[keep]
            if t >= lap:
                found = self.out[state]
                hit = np.flatnonzero(found)
                place, found = hit * size + (t - lap), found[hit]
                while len(found):
                    places.append(place)
                    states.append(found)
                    found = self.out[self.fail[found]]
                    place, found = place[found > 0], found[found > 0]
        return np.concatenate([np.zeros(0, np.int64), *places]), np.concatenate([np.zeros(0, np.int32), *states])

    def scan(self, docs: list[list[bytes]], window: int) -> list[tuple[list[tuple[int, int]], list[str]]]:
        """For the words of each document: hit ranges, merged and in order, and the sorted ids of items that occur."""
        get = self.numbers.get
        bounds = np.cumsum([0, *(len(d) + 1 for d in docs)])
        words = np.fromiter((get(w, 0) for d in docs for w in (*d, b"")), np.int32, bounds[-1])
        last, state = self.matches(words, window)
        result: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in docs]
        if not len(last):
            return result
        first = last + 1 - (np.searchsorted(self.levels, state, "right") - 1)
        n = len(words) + 1
        inside = np.cumsum(np.bincount(first, minlength=n) - np.bincount(last + 1, minlength=n)) > 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        edges = np.append(0, edges) if inside[0] else edges
        of = np.searchsorted(bounds, edges[::2], "right") - 1
        for doc, base, a, b in zip(of.tolist(), bounds[of].tolist(), edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            result[doc][0].append((a - base, b - base))
        end = np.searchsorted(self.ends, state)
        pairs = np.unique((np.searchsorted(bounds, last, "right") - 1) * len(self.ends) + end)
        seen: dict[int, set[int]] = {}
        for doc, e in zip(*(x.tolist() for x in np.divmod(pairs, len(self.ends))), strict=True):
            seen.setdefault(doc, set()).update(self.items[self.starts[e] : self.starts[e + 1]].tolist())
        for doc, items in seen.items():
            result[doc][1].extend(self.names[i] for i in sorted(items))
        return result


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as [start, end) in code points of the original text."""
    if not ranges:
        return []
    flat = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    wanted = sorted({i for a, b in ranges for i in (a, b - 1)})
    at: dict[int, tuple[int, int]] = {}
    pos = number = 0
    chars = byte = 0
    raw = text.encode("utf-8", "surrogatepass")
    todo = iter(wanted)
    want = next(todo, None)
    for word in flat.split():
        pos = flat.index(word, pos)
        if number == want:
            chars += len(raw[byte:pos].decode("utf-8", "surrogatepass"))
            byte = pos
            size = len(word.decode("utf-8", "surrogatepass"))
            at[number] = (chars, chars + size)
            want = next(todo, None)
        pos += len(word)
        number += 1
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


_built: dict[str, Windows] = {}
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_SPANS, _IDS = pa.list_(_SPAN), pa.list_(pa.string())


def _windows(folder: str) -> Windows:
    """The automaton in a folder; a worker keeps one."""
    if folder not in _built:
        _built.clear()
        _built[folder] = Windows.read(folder)
    return _built[folder]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            yield batch.slice(lo, 512)


def _runs(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in order, so many together that a run has some RUN_WORDS words."""
    run, n = [], 0
    for text in texts:
        run.append(text)
        n += len(text or "") // 6 + 1
        if n >= RUN_WORDS:
            yield run
            run, n = [], 0
    if run:
        yield run


def _scan(folder: str, window: int):
    """(id, text, carried...) to (id, n_words, n_hit, item_ids, spans, carried...)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(folder)
        for part in _pieces(batches):
            n_words, n_hit, item_ids, spans = [], [], [], []
            for run in _runs(part.column(1).to_pylist()):
                words = [words_of(text) for text in run]
                for text, of, (ranges, items) in zip(run, words, windows.scan(words, window), strict=True):
                    n_words.append(len(of))
                    n_hit.append(sum(b - a for a, b in ranges))
                    item_ids.append(items)
                    spans.append(char_spans(text or "", ranges))
            found = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(item_ids, _IDS), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays([part.column(0), *found, *part.columns[2:]], ["id", "n_words", "n_hit", "item_ids", "spans", *part.schema.names[2:]])

    return scan


# ---- a benchmark beyond the bound ----

_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: list[bytes], n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _STEP + of[j : j + len(out)]
    return out ^ (out >> np.uint64(31))


def _item_windows(window: int):
    """(item, text) to (n, hash, words, item) of the item's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            out: list[tuple] = []
            for item, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = words_of(text)
                n = min(window, len(words))
                for i, h in enumerate(window_hashes(words, n).view(np.int64).tolist() if n else ()):
                    out.append((n, h, b" ".join(words[i : i + n]), item))
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.string()]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "hash", "words", "item"])

    return run


_MAYBE = "array<struct<start:int,end:int,first:int,last:int,words:binary>>"


def _candidates(shared, lengths: list[int]):
    """(row, id, text, carried...) to (row, id, n_words, maybe, carried...): the windows whose bit is set."""
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "first", "last")] + [("words", pa.binary())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part in _pieces(batches):
            n_words, maybe = [], []
            for text in part.column(2).to_pylist():
                words, ranges = words_of(text), []
                for n in lengths:
                    slot = window_hashes(words, n) & np.uint64(BITMAP_BITS - 1)
                    ranges += [(int(i), int(i) + n) for i in np.flatnonzero((bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)]
                at = char_spans(text or "", ranges)
                n_words.append(len(words))
                maybe.append([{"start": a, "end": b, "first": c["start"], "last": c["end"], "words": b" ".join(words[a:b])} for (a, b), c in zip(ranges, at, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(n_words, pa.int64()), pa.array(maybe, kind), *part.columns[3:]], ["row", "id", "n_words", "maybe", *part.schema.names[3:]]
            )

    return scan


def _beyond(rows: DataFrame, items: DataFrame, window: int, names: list[str], kind: str) -> DataFrame:
    """The same as _scan() with the windows as a table."""
    spark = rows.sparkSession
    table = items.mapInArrow(_item_windows(window), "n int, hash long, words binary, item string").distinct()
    table = materialise(table, "benchmark-windows")
    slot = F.pmod("hash", F.lit(BITMAP_BITS)) + 1
    packed = table.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("b"))
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in packed.toLocalIterator():  # BITMAP_BITS / 32768 rows of 4 KB at most
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["b"], np.uint8)
    lengths = sorted(r["n"] for r in table.select("n").distinct().collect())  # 1 to ``window``
    shared = spark.sparkContext.broadcast(bits)
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"row long, id {kind}, n_words long, maybe {_MAYBE}" + "".join(f", `{n}` {fields[n]}" for n in names)
    found = rows.select(F.monotonically_increasing_id().alias("row"), "id", "_text", *names).mapInArrow(_candidates(shared, lengths), schema)
    found = materialise(found, "benchmark-candidates")
    hits = found.select("row", F.explode("maybe").alias("m")).select("row", "m.*").join(table.select("words", "item"), "words")
    hits = hits.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end", "first", "last"))).alias("hits"), F.array_sort(F.collect_set("item")).alias("items"))
    # ranges of words that touch become one; each is (start, end, first, last)
    none = F.array().cast("array<struct<start:int,end:int,first:int,last:int>>")
    top = lambda acc: F.element_at(acc, -1)
    grown = lambda acc, h: F.struct(top(acc)["start"].alias("start"), F.greatest(top(acc)["end"], h["end"]).alias("end"), top(acc)["first"].alias("first"), F.greatest(top(acc)["last"], h["last"]).alias("last"))
    merge = lambda acc, h: F.when((F.size(acc) > 0) & (top(acc)["end"] >= h["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown(acc, h)))).otherwise(F.concat(acc, F.array(h)))
    hits = hits.select("row", "items", F.aggregate("hits", none, merge).alias("ranges"))
    done = found.join(hits, "row", "left")
    ranges = F.coalesce("ranges", none)
    return done.select(
        "id", "n_words", F.aggregate(ranges, F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("item_ids"),
        F.transform(ranges, lambda r: F.struct(r["first"].alias("start"), r["last"].alias("end"))).alias("spans"), *names,
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, n_words, n_hit, item_ids (sorted), spans of the original, carried columns."""
    names = [f"_c_{c}" for c in carry]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).alias("t")).where(F.col("t").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    size = items.agg(F.sum(F.octet_length("i") + F.octet_length("t")).alias("n")).first()["n"] or 0
    if size <= MAX_PATTERN_BYTES:
        folder = new_path(docs.sparkSession, "benchmark-automaton")
        Windows.of([tuple(r) for r in items.collect()], window).write(folder)
        result = SCHEMA.format(id=fields["id"]) + "".join(f", `{n}` {fields[n]}" for n in names)
        found = rows.mapInArrow(_scan(folder, window), result)
    else:
        found = _beyond(rows, items, window, names, fields["id"])
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "item_ids", "spans", *[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)])


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from decontaminate()'s rows."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return digests(decontaminate(read("documents"), read("benchmark")))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, item_id, k, n FROM dw JOIN iw USING (n, win)),
p AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
