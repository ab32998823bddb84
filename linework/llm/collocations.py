"""Phrase collocations by top-order marginalisation.

Every word starts one window: itself and the words that follow it in its piece, up to the longest phrase,
padded beyond the piece's end. Only these windows are counted. As a phrase is the beginning of the
windows that start where it stands, a ROLLUP over the window's columns sums the counts of all shorter
phrases, and of all words of a language, without exploding n-grams of any other length.

A window is cut before a word, pair or triple that is surely rarer than LEAST, as no wanted phrase has such a part. Their
counts are first summed in SLOTS slots by hash; a slot below LEAST holds none that any wanted phrase could have, so no count of a wanted
phrase changes, and a window of a rare word still counts as a word of its language. What tasks get is two bits per slot (16 MB each), whatever
the input. The more fall in a slot the fewer windows are cut; beyond some billions of distinct pairs all windows move whole, and the result is the same.

Each phrase with LEAST occurrences then meets its parts and the phrases around it in joins of written tables.

Defined results: a null text has no words, a null language is ``und``; a language without phrases gives no rows;
rows of one id are documents of their own and ids are not looked at; a piece and a text may be of any length; ties are
broken by the phrase's UTF-8 bytes; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.plans.tables import give_back, materialise, small_batches

LONGEST, LEAST, TOP = 4, 30, 2000
#: Slots of counts; a power of two, 32768 at least. Two bits of each are broadcast.
SLOTS = 1 << 27
#: Slots of one row of counts or bits.
PART = 1 << 15
#: Characters whose windows are counted together before they leave a task.
CHUNK = 4 << 20
#: Code units that end a piece become line feeds, tabs spaces, A-Z small.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10)
_GAP, _BREAK = 0, 1


class Chunk:
    """The words of some documents as numbers: ``word`` with a _BREAK between pieces, ``lang`` beside it."""

    def __init__(self, langs: list[str], texts: list[str | None], slots: int):
        numbers, kinds = defaultdict(count().__next__), defaultdict(count().__next__)
        assert (numbers[b""], numbers[b"\n"]) == (_GAP, _BREAK)
        parts = []
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
            parts.append(np.array(list(map(numbers.__getitem__, data.replace(b"\n", b" \n ").split(b" "))) + [_BREAK], np.int32))
        sizes = [len(p) for p in parts]
        word = np.concatenate(parts)
        lang = np.repeat(np.array([kinds[x] for x in langs], np.int32), sizes)
        real = word != _GAP
        self.word, self.lang = word[real], lang[real]
        self.words, self.langs = list(numbers), list(kinds)
        hashed = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64)
        salt = np.array([xxhash.xxh64_intdigest(x, 1) for x in self.langs], np.uint64)
        shift, hashed, salt = np.uint64(65 - slots.bit_length()), hashed[self.word], salt[self.lang]
        slot = lambda h: ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int32 if slots <= 1 << 31 else np.int64)
        pair = hashed[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashed[1:] + salt[:-1]
        triple = (pair[:-1] ^ (pair[:-1] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[2:]
        self.slots = [slot(hashed * np.uint64(0x165667B19E3779F9) + salt), slot(pair), slot(triple)]
        real = self.word != _BREAK
        self.there = [real, real[:-1] & real[1:], real[:-2] & real[1:-1] & real[2:]]

    def possible(self, k: int, bits: np.ndarray) -> np.ndarray:
        """Where words (1), pairs (2), triples (3) begin that may be frequent, by the slots' bits."""
        slot = self.slots[k - 1]
        return self.there[k - 1] & ((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0)


def _chunks(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[Chunk]:
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in ((x.as_py() for x in pair) for pair in zip(batch.column(0), batch.column(1), strict=True)):
            langs.append(lang)
            texts.append(text)
            size += len(text or "")
            if size >= CHUNK:
                yield Chunk(langs, texts, slots)
                langs, texts, size = [], [], 0
    if langs:
        yield Chunk(langs, texts, slots)
        del langs, texts, batch
    give_back()


def _slot_counts(slots: int, shared=None):
    """(part, packed): the slots of a task's words and pairs with their counts; given the bits of these, of the triples that
    may be frequent. A row has the slots of one PART in a chunk: their low bytes, their high bytes, their counts (255 at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, slots):
            if shared is None:
                found = np.concatenate([c.slots[0][c.there[0]], c.slots[1][c.there[1]]])
            else:
                pair = c.possible(2, shared.value)
                found = c.slots[2][c.there[2] & pair[:-1] & pair[1:]]
            slot, n = np.unique(found, return_counts=True)
            parts, first = np.unique(slot // PART, return_index=True)
            planes = [(slot & 255).astype(np.uint8), (slot % PART >> 8).astype(np.uint8), np.minimum(n, 255).astype(np.uint8)]
            packed = [b"".join(x[a:b].tobytes() for x in planes) for a, b in zip(first, [*first[1:], len(slot)])]
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int64)), pa.array(packed, pa.binary())], ["part", "packed"])

    return run


def _slot_bits(least: int):
    """(part, bits) of a partition's packed counts: one bit for each slot that is met ``least`` times (255 at most)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high, n = np.frombuffer(packed, np.uint8).reshape(3, -1).astype(np.int32)
                if part not in sums:
                    sums[part] = np.zeros(PART, np.int32)
                at = low | high << 8
                sums[part][at] = np.minimum(sums[part][at] + n, 1 << 20)
        bits = [np.packbits(x >= min(least, 255), bitorder="little").tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(bits, pa.binary())], ["part", "bits"])

    return run


def _windows(pairs, triples, longest: int, slots: int):
    """The padded windows of a task's chunks with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, slots):
            at = np.flatnonzero(c.there[0])
            if not len(at):
                continue
            goes = c.possible(1, pairs.value)[at]
            pair, triple = c.possible(2, pairs.value), c.possible(3, triples.value)
            triple = triple & pair[:-1] & pair[1:]
            held = lambda x, i: x[np.minimum(i, len(x) - 1)] if len(x) else np.zeros(len(i), bool)  # noqa: E731  what stands behind the end is never there
            columns = [np.where(goes, c.word[at], _GAP)]
            code = c.lang[at].astype(np.int64) * len(c.words) + columns[0]
            for k in range(1, longest):
                goes = goes & (held(pair, at) if k == 1 else held(triple, at + k - 2))
                columns.append(np.where(goes, c.word[np.minimum(at + k, len(c.word) - 1)], _GAP))
                code = np.unique(code, return_inverse=True)[1] * len(c.words) + columns[-1]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            words = pa.array(c.words, pa.binary()).cast(pa.string())
            lang = pa.array(c.langs, pa.string()).take(pa.array(c.lang[at][first]))
            yield pa.RecordBatch.from_arrays(
                [lang, *[words.take(pa.array(x[first])) for x in columns], pa.array(n)], ["lang", *[f"w{k + 1}" for k in range(longest)], "c"]
            )

    return run


def _bitmap(rows: DataFrame, least: int, slots: int, shared=None) -> np.ndarray:
    """One bit per slot: what falls there is together met ``least`` times. slots / PART rows of 4 KB."""
    packed = rows.mapInArrow(_slot_counts(slots, shared), "part long, packed binary")
    bits = np.zeros(slots // 8, np.uint8)
    for r in packed.repartition("part").mapInArrow(_slot_bits(least), "part long, bits binary").toLocalIterator():
        bits[r["part"] * PART // 8 : (r["part"] + 1) * PART // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, words, f) of all phrases of up to ``longest`` words met ``least`` times, and
    (lang, n) with the number of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    small_batches(docs.sparkSession, 4 << 20)
    send = docs.sparkSession.sparkContext.broadcast
    pairs = send(_bitmap(rows, least, slots))
    triples = send(_bitmap(rows, least, slots, pairs))
    columns = [f"w{k + 1}" for k in range(longest)]
    windows = rows.mapInArrow(_windows(pairs, triples, longest, slots), "lang string, " + ", ".join(f"{c} string" for c in columns) + ", c long")
    windows = windows.groupBy("lang", *columns).agg(F.sum("c").alias("c"))  # few are left for ROLLUP to multiply
    summed = windows.rollup("lang", *columns).agg(F.sum("c").alias("f"))
    words = F.filter(F.array(*columns), lambda w: w.isNotNull())  # a null was rolled up, an empty word is padding
    whole = summed.where("lang is not null").select("lang", words.alias("words"), "f").where(~F.array_contains("words", F.lit("")))
    whole = materialise(whole.where((F.col("f") >= least) | (F.size("words") == 0)), "phrases")
    return whole.where(F.size("words") > 0), whole.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP, slots: int = SLOTS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A phrase's score is that of its lowest cut, 2000000 a / (l + r); phrases of which four in five
    occurrences lie in one longer phrase are left out.
    """
    phrases, totals = phrase_counts(docs, lang_col, text_col, longest, least, slots)
    counts = materialise(phrases.select("lang", _text(F.col("words")).alias("part"), "f"), "phrase-counts")
    several = phrases.where(F.size("words") > 1)
    cut = several.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cut = materialise(
        cut.select(
            "lang", _text(F.col("words")).alias("phrase"), "a", "k",
            _text(F.slice("words", F.lit(1), F.col("k"))).alias("head"), _text(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("rest"),
        ),
        "phrase-cuts",
    )
    heads = counts.select("lang", F.col("part").alias("head"), F.col("f").alias("l"))
    rests = counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r"))
    cut = cut.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    score = F.expr("cast(2000000 * cast(a as decimal(20,0)) as decimal(28,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cut.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("x")).groupBy("lang", "phrase", "a").agg(F.min("x").alias("x"))

    size, spans = F.size("words"), F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for n in range(2, longest) for i in range(1, longest - n + 2)])
    inner = several.where(size > 2).select("lang", "words", "f", F.explode(spans).alias("s")).where((F.col("s.n") < size) & (F.col("s.i") + F.col("s.n") <= size + 1))
    around = inner.groupBy("lang", _text(F.slice("words", F.col("s.i"), F.col("s.n"))).alias("phrase")).agg(F.max("f").alias("longer"))
    left = scored.join(around, ["lang", "phrase"], "left")
    left = left.where(F.col("longer").isNull() | (100 * _exact(F.col("longer")) < 80 * _exact(F.col("a"))))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    first = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of all of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, len(w) AS m, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
grams AS (SELECT lang, w[i:i + k - 1] AS ws FROM g, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= m),
f AS (SELECT lang, ws, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
c AS (SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1),
cuts AS (SELECT *, ws[1:k] AS head, ws[k + 1:] AS rest FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM c)),
cut AS (SELECT cuts.lang, cuts.ws, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON cuts.lang = x.lang AND head = x.ws JOIN f y ON cuts.lang = y.lang AND rest = y.ws),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
inner_of AS (SELECT lang, ws[i:i + k - 1] AS ws, max(a) AS longer
  FROM c, (SELECT unnest([2, 3]) AS k), (SELECT unnest([1, 2, 3]) AS i) WHERE k < len(ws) AND i + k - 1 <= len(ws) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inner_of USING (lang, ws) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, array_to_string(ws, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(ws, ' '))) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
