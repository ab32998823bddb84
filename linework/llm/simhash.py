"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets, once, a row of Hamming distances to PIVOTS reference fingerprints, which is
written and goes with it. By the triangle inequality two fingerprints within ``k`` bits differ by at most
``k`` in every coordinate, so pairs with a larger coordinate difference are discarded and the survivors
verified.

Distances to a pivot concentrate near 32, so the tables alone can't say which pairs to look at
without looking at all of them. Pairs are met in blocks: with the 64 bits cut into k + e pieces, two
fingerprints within k bits agree in at least e of them, so every choice of e pieces is a key under
which fingerprints that agree there come together; no link is lost. e is the smallest that leaves
about GROUP fingerprints to a key. A key with more than CHUNK fingerprints is split into pairs of
chunks, each a group of its own, so that no task holds an unbounded group. A group emits only a
spanning forest of its links, never all pairs.

Texts are read once and not shuffled. Copies share a fingerprint and are collapsed before pairs are
looked for.

Defined results: null, empty and all-space texts have fingerprint zero, linked like any other; a null
id is never a component's id unless no other is there; repeated rows repeat in the result; texts may be of
any length; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.llm.components import connected_components
from linework.plans.tables import materialise

SHINGLE = 4
SEED = 42
MAX_BITS = 4
PIVOTS = 16
#: Fingerprints that a key should have on average at most.
GROUP = 64
#: Fingerprints of one chunk of a large key.
CHUNK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(n)], np.uint64)


def distances(fp: Column) -> list[Column]:
    """The row of the distance table: PIVOTS bytes, eight to a long."""
    of = [F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * (i % 8)) for i, p in enumerate(pivots().tolist())]
    return [reduce(Column.__add__, of[i : i + 8]).alias(f"d{i // 8}") for i in range(0, PIVOTS, 8)]


def pieces_for(n: int, max_bits: int) -> tuple[list[int], int]:
    """Masks that cut 64 bits into max_bits + e pieces, and e, for n fingerprints."""
    e = 1
    while e < 4 and n > GROUP * 2 ** (64 * e / (max_bits + e)):
        e += 1
    m = max_bits + e
    cuts = [64 * i // m for i in range(m + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])], e


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Forest:
    """Union-find over positions, with all labels at hand."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Join each a with b; the pairs that joined two trees."""
        new, up = [], {}

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for x, y, i, j in zip(self.label[a].tolist(), self.label[b].tolist(), a.tolist(), b.tolist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
                new.append((i, j))
        if up:
            old = np.fromiter(up, np.int64, len(up))
            to = np.array([root(x) for x in up])
            table = np.arange(len(self.label))
            table[old] = to
            self.label = table[self.label]
        return new


def forest_links(group: np.ndarray, fps: np.ndarray, max_bits: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each group; rows of a group stand together, each with its
    row of the distance table."""
    forest, found = Forest(len(fps)), []
    here = np.arange(len(fps))
    for k in range(1, len(fps)):
        here = here[here + k < len(fps)]
        here = here[group[here] == group[here + k]]
        if not len(here):
            break
        a = here[forest.label[here] != forest.label[here + k]]
        near = np.ones(len(a), bool)
        for j in range(table.shape[1]):  # maximum coordinate difference
            a = a[near]
            near = np.abs(table[a, j] - table[a + k, j]) <= max_bits
        a = a[near]
        a = a[np.bitwise_count(fps[a] ^ fps[a + k]) <= max_bits]
        if len(a):
            found += forest.add(a, a + k)
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) among the distinct fingerprints ``fp``, with their distances, that connect whatever is linked."""
    far = [f"d{i}" for i in range(PIVOTS // 8)]
    masks, e = pieces_for(distinct.count(), max_bits)
    keys = [_signed(sum(c)) for c in combinations(masks, e)]
    keyed = distinct.select("fp", *far, F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(m).alias("bits")) for i, m in enumerate(keys)])).alias("x"))
    keyed = keyed.select("fp", *far, "x.k", "x.bits")
    sizes = keyed.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    dealt = (
        keyed.join(sizes, ["k", "bits"])
        .withColumn("chunks", F.ceil(F.col("n") / CHUNK))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("k", "bits", F.least(chunk, "other").alias("i"), F.greatest(chunk, "other").alias("j"), "fp", *far)
    )
    group = ["k", "bits", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[True], (rows[1:, :4] != rows[:-1, :4]).any(axis=1)])
            table = np.ascontiguousarray(rows[:, 5:]).view(np.int8)
            u, v = forest_links(np.cumsum(starts), np.ascontiguousarray(rows[:, 4]).view(np.uint64), max_bits, table)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])

        for batch in batches:
            rows = np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)
            same = (rows[:, :4] == rows[-1, :4]).all(axis=1) if len(rows) else np.zeros(0, bool)
            last = len(rows) - int(same.sum())  # where the last group, perhaps not whole, begins
            if rest and len(rows) and last == 0 and (rest[-1][-1, :4] == rows[0, :4]).all():
                rest.append(rows)
                continue
            whole = np.concatenate([*rest, rows[:last]])
            rest = [rows[last:]] if len(rows) else []
            if len(whole):
                yield emit(whole)
        if rest:
            yield emit(np.concatenate(rest))

    return dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: id, fp (signed long) and component_id, the smallest id reachable by links."""
    marked = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")).select("*", *distances(F.col("fp"))), "nodes")
    roots = connected_components(links(nodes.drop("least"), max_bits))
    nodes = nodes.select("fp", "least")
    linked = materialise(nodes.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = materialise(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    of_fp = (
        nodes.join(linked.join(least, "root").select("fp", "component_id"), "fp", "left")
        .select("fp", F.coalesce("component_id", "least").alias("component_id"))
    )
    return marked.join(materialise(of_fp, "components"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all of documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
