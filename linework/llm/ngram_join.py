"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Texts with one set of n-grams are one row of the incidence matrix (a class); its columns are n-grams. Links are
pairs of rows whose overlap, an entry of the matrix times its transpose, is large enough for their sizes. The product
is made by blocks of columns (a shuffle of the entries by n-gram) and never in full:

* Columns stand in one order for all rows, rarer ones (by counts of hash slots over all rows) first. In this order two rows
  that link must meet must_meet() times in the first columns of both; how far to look follows from their sizes (meets()). Entries
  beyond that are never dealt.
* First, in each column, only the products with the column's central row (that with the commonest n-grams, mostly the
  text that others were copied from) are added up, which are as many as entries. Each row is compared with the central row with which it
  met in most columns, so a group of near copies becomes one component with about one comparison per row. The same
  is done again with a comparison per component.
* Then columns whose rows are already of one component are left out, and overlaps are accumulated for pairs of rows of different
  components. Pairs that met less often than they must are discarded, the rest compared.

Comparing joins the two texts, once per pair, and is exact up to equal 64-bit hashes of different n-grams within one pair. A row
is named by 128 bits of its set's hash, in entries by 64 bits of that; rows that share these are compared one by one.
A column of many rows is dealt in pairs of chunks, and an output row is made only for a pair that passes the size bounds.

Defined results: a null text is an empty one, has no n-grams and links with nothing, not even other empty ones;
a text of fewer words than an n-gram is one n-gram; a null id is a component's id only if there is no other in it, repeated rows
repeat; texts may be of any length; other columns are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.components import connected_components
from linework.plans.tables import materialise

SHINGLE = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Slots of the n-grams' counts (a power of two) and slots of one row of the table of counts.
SLOTS, SLAB = 1 << 21, 1 << 14
#: One in so many of the common columns that a pair needs must be among its first ones; of those with a central row, to be compared with it.
PART, OFTEN = 50, 12
#: Rounds of comparisons with central rows.
ROUNDS = 2
#: Bits that say which documents' texts are wanted: 4 MB to broadcast.
BITMAP_BITS = 1 << 25
#: Rows of a chunk of a column.
CHUNK = 2048
#: Texts whose n-grams are handled together.
STEP = 256
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's word n-grams; a shorter text is one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(w) for w in words], np.uint64)
    n = len(words) - shingle + 1
    h = np.zeros(n, np.uint64)
    for k in range(shingle):
        h = (h ^ each[k : k + n]) * _MIX[k % len(_MIX)]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int = PERCENT):
    """The smallest intersection with which sets of a and b elements link."""
    return -(-percent * (a + b) // (100 + percent))


def must_meet(least):
    """In how many of its first columns a pair of rows is to meet that needs ``least`` common ones: some hundredths of
    them, so that rows that meet by chance are told apart."""
    return np.minimum(least, 2 + least // PART)


def needed(a: str, b: str, percent: int, part: int = PART) -> str:
    """SQL for must_meet(least_overlap(a, b)), or another part."""
    least = f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"
    return f"least({least}, 2 + {least} div {part})"


def meets(a, place_a, b, place_b, percent: int = PERCENT):
    """Whether rows of a and b elements with a common column at these places (from 0) may have it among the first
    must_meet() ones they have in common, if they link: after the k-th of at least ``least`` common ones there are ``least`` - k more."""
    least = least_overlap(a, b, percent)
    return np.minimum(a - place_a, b - place_b) > least - must_meet(least)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, STEP):
            yield batch.slice(low, STEP)


def _digest(found: np.ndarray) -> bytes:
    """What names a row of the incidence."""
    return xxhash.xxh3_128_digest(found.tobytes())


def _key(digest: bytes) -> int:
    """What names a row in entries: Spark's xxhash64 of its digest."""
    found = xxhash.xxh64_intdigest(digest, 42)
    return found - (1 << 64) if found >> 63 else found


def _scan(shingle: int):
    """(id, h, size, row) of each text, row being the digest of its set; and the counts of n-grams by slot, in slabs."""
    names = ["id", "h", "size", "row", "slab", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(SLOTS, np.int32), None
        for batch in _parts(batches):
            kind, n = batch.schema.field(0).type, batch.num_rows
            sets = [shingle_hashes(t, shingle) for t in batch.column(2).to_pylist()]
            counts += np.bincount(_slot(np.concatenate(sets)), minlength=SLOTS).astype(np.int32)
            rows = pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(s) for s in sets], pa.int64()), rows, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        slabs = [(i, s) for i, s in enumerate(counts.reshape(-1, SLAB)) if s.any()]
        if slabs:
            n = len(slabs)
            packed = pa.array([s.tobytes() for _, s in slabs], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([i for i, _ in slabs], pa.int32()), packed], names)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition's slabs."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[slab] = sums.get(slab, 0) + np.frombuffer(counts, np.int32).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"slab": pa.array(list(sums), pa.int32()), "counts": pa.array([s.tobytes() for s in sums.values()], pa.binary())})


def _entries(shared, shingle: int, percent: int):
    """Entries of the incidence that can matter: (gram, key, size, place, centre) of the first columns of a text in
    the order by count; centre rises with the rareness of all its n-grams."""
    names = ["gram", "key", "size", "place", "centre"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in _parts(batches):
            out, rows, times = [], [], []
            for text in batch.column(0).to_pylist():
                h = shingle_hashes(text, shingle)
                n = len(h)
                if not n:
                    continue
                counts = table[_slot(h)]
                least = -(-percent * n // 100)
                first = n - least + int(must_meet(least))
                order = np.lexsort((h, counts))[:first]
                rows.append(_key(_digest(h)))
                times.append(first)
                out.append((h[order].view(np.int64), np.full(first, n, np.int32), np.arange(first, dtype=np.int32), np.full(first, -np.log(counts).mean(), np.float32)))
            if rows:
                gram, size, place, centre = (pa.array(np.concatenate(x)) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([gram, pa.array(np.repeat(np.array(rows, np.int64), times)), size, place, centre], names)

    return run


_ENTRY = [("gram", pa.int64()), ("key", pa.int64()), ("size", pa.int32()), ("place", pa.int32())]
_CENTRAL = [("c_key", pa.int64()), ("c_size", pa.int32())]


def _central(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by (gram, centre, key): those of columns with several rows, each with the column's
    central entry. Two entries are held, whatever a column's length."""
    central = last = None
    for batch in batches:
        gram = np.asarray(batch.column(0))
        if not len(gram):
            continue
        same = gram[1:] == gram[:-1]
        near = np.flatnonzero(np.concatenate([[True], same]) | np.concatenate([same, [True]]))  # alone in their columns, the others
        out: list[tuple] = []
        for entry in zip(*(c.to_pylist() for c in batch.take(pa.array(near)).columns), strict=True):
            if central is None or central[0] != entry[0]:
                central = last = entry
            elif entry[1] != last[1]:  # a repeated row stands beside itself
                if last is central:
                    out.append(central + central[1:3])
                last = entry
                out.append(entry + central[1:3])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), _ENTRY + _CENTRAL, strict=True)], [n for n, _ in _ENTRY + _CENTRAL])


def _products(percent: int):
    """Of entries sorted by (gram, i, j, size), i and j being the chunks that a block of a column multiplies: the pairs of rows
    of different components that meet there. ``own`` is a row's chunk."""

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        gram, i, j, size, place, own = (np.asarray(table.column(k)).astype(np.int64) for k in range(6))
        row, root = (np.asarray(table.column(k)) for k in (6, 7))
        block = np.cumsum(np.concatenate([[True], (gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        across = i != j
        here, k = np.arange(len(gram)), 0
        while len(here):
            k += 1
            here = here[here + k < len(gram)]
            b = here + k
            here = here[(block[here] == block[b]) & (100 * size[here] >= percent * size[b])]  # sizes rise within a block
            a, b = here, here + k
            good = (root[a] != root[b]) & (~across[a] | (own[a] != own[b])) & meets(size[a], place[a], size[b], place[b], percent)
            a, b = a[good], b[good]
            for low in range(0, len(a), 1 << 16):
                x, y = a[low : low + (1 << 16)], b[low : low + (1 << 16)]
                sizes = [pa.array(size[c].astype(np.int32)) for c in (x, y)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(row[x], row[y])), pa.array(np.maximum(row[x], row[y])), *sizes], ["u", "v", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            key = np.stack([np.asarray(table.column(k)).astype(np.int64) for k in range(3)], axis=1)
            begins = len(key) - int((key == key[-1]).all(axis=1).sum())  # of the last block, perhaps not whole
            rest = table.slice(begins)
            if begins:
                yield from emit(table.slice(0, begins))
        if rest is not None:
            yield from emit(rest)

    return run


def _linked(shingle: int, percent: int):
    """The pairs (u, v) whose texts a and b link; a text that isn't its row's is passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)
        for batch in _parts(batches):
            found = []
            for k, (u, v, a, b) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if u != last:
                    last, mine = u, shingle_hashes(a, shingle)
                other = shingle_hashes(b, shingle)
                if _digest(mine) != u or _digest(other) != v:
                    raise ValueError("a text does not belong to its row")
                if len(np.intersect1d(mine, other, assume_unique=True)) >= least_overlap(len(mine), len(other), percent):
                    found.append(k)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(found, pa.int32())) for c in batch.columns[:2]], ["u", "v"])

    return run


class Join:
    """The join of one table. What is read more than once is written."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int):
        self.docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
        self.shingle, self.percent = shingle, percent
        kind = docs.schema[id_col].dataType.simpleString()
        scanned = materialise(self.docs.mapInArrow(_scan(shingle), f"id {kind}, h long, size long, row binary, slab int, counts binary"), "shingle-sets")
        self.sets = scanned.where("slab is null").select("id", "h", "size", "row")
        slabs = scanned.where("slab is not null").select("slab", "counts").repartition("slab").mapInArrow(_added, "slab int, counts binary")
        table = np.zeros(SLOTS, np.int64)
        for r in slabs.toLocalIterator():  # SLOTS / SLAB rows
            table[r["slab"] * SLAB : (r["slab"] + 1) * SLAB] = np.frombuffer(r["counts"], np.int64)
        self.table = docs.sparkSession.sparkContext.broadcast(table)
        # each row of the incidence with the smallest id that has it and the hash of that document's text
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("x")
        self.rows = materialise(self.sets.where("row is not null").groupBy("row").agg(least).select("row", F.xxhash64("row").alias("key"), "x.id", "x.h"), "shingle-rows")

    def texts_of(self, rows: DataFrame) -> DataFrame:
        """(id, h, text) of the documents that rows (with id and h) name, perhaps with some others: by a bit per hash of (id, h),
        so that no text moves."""
        slot = F.pmod(F.xxhash64("id", "h"), F.lit(BITMAP_BITS)) + 1
        bitmap = rows.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("_bits"))
        marked = self.docs.withColumns({"_bucket": F.bitmap_bucket_number(slot), "_at": F.bitmap_bit_position(slot)}).join(F.broadcast(materialise(bitmap, "wanted")), "_bucket")
        byte = F.conv(F.hex(F.substring("_bits", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return marked.withColumn("_byte", byte).where("(shiftright(_byte, cast(_at % 8 as int)) & 1) = 1").select("id", "h", "text")

    def compare(self, pairs: DataFrame, label: str) -> DataFrame:
        """Of the pairs (u, v) of keys the pairs of rows that link."""
        pairs = materialise(pairs, f"{label}-pairs")
        used = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).distinct()
        used = materialise(used.join(self.rows, "key"), f"{label}-used")
        texts = self.texts_of(used).groupBy("id", "h").agg(F.first("text").alias("text")).alias("t")  # repeated rows are one
        texts = texts.join(used.alias("r"), F.col("t.id").eqNullSafe(F.col("r.id")) & F.col("t.h").eqNullSafe(F.col("r.h"))).select("key", "row", "text")
        texts = materialise(texts, f"{label}-texts")
        of = lambda key, row, text: texts.select(F.col("key").alias(key), F.col("row").alias(row), F.col("text").alias(text))
        both = pairs.join(of("v", "v_row", "b"), "v").join(of("u", "u_row", "a"), "u").select("u_row", "v_row", "a", "b")
        return materialise(both.mapInArrow(_linked(self.shingle, self.percent), "u binary, v binary"), f"{label}-links")

    def roots(self, links: DataFrame) -> DataFrame:
        """(key, root) of the linked rows, both as keys."""
        found = connected_components(links)
        return materialise(found.select(F.xxhash64("node").alias("key"), F.xxhash64("root").alias("root")), "central-roots")

    def links(self) -> DataFrame:
        """Pairs (u, v) of linked rows that connect whatever is linked."""
        percent = self.percent
        entries = self.texts_of(self.rows).select("text").mapInArrow(_entries(self.table, self.shingle, percent), "gram long, key long, size int, place int, centre float")
        dealt = entries.repartition("gram").sortWithinPartitions("gram", "centre", "key").select("gram", "key", "size", "place")
        shared = materialise(dealt.mapInArrow(_central, "gram long, key long, size int, place int, c_key long, c_size int"), "shared-columns")
        # how often each row met a central one; too seldom is left to the exact step
        near = shared.where(f"key != c_key and 100 * size >= {percent} * c_size and 100 * c_size >= {percent} * size")
        near = near.groupBy("key", "c_key").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("c_size").alias("c_size"))
        near = near.where(f"n >= {needed('size', 'c_size', percent, OFTEN)}").select("key", "c_key", "n", F.col("key").alias("root"))
        near, found = materialise(near, "near-rows"), None
        for turn in range(ROUNDS):
            best = near.groupBy("root").agg(F.max(F.struct("n", "key", "c_key")).alias("x"))
            new = self.compare(best.select(F.col("x.c_key").alias("u"), F.col("x.key").alias("v")), f"central{turn}")
            found = new if found is None else found.unionByName(new)
            roots = self.roots(found)
            of = lambda name: roots.select(F.col("key").alias(name), F.col("root").alias(f"new_{name}"))
            near = near.join(of("key"), "key", "left").join(of("c_key"), "c_key", "left")
            near = near.where("coalesce(new_key, key) != coalesce(new_c_key, c_key)").select("key", "c_key", "n", F.coalesce("new_key", "key").alias("root"))
        entry = shared.select("gram", "key", "size", "place").join(roots, "key", "left")
        entry = materialise(entry.withColumn("root", F.coalesce("root", "key")), "rooted-columns")
        mixed = entry.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n"))
        mixed = materialise(mixed.where("a != b").select("gram", F.ceil(F.col("n") / CHUNK).alias("chunks")), "mixed-columns")
        blocks = entry.join(mixed, "gram").withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")))
        blocks = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        blocks = blocks.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "size", "place", "own", "key", "root")
        dealt = blocks.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "size")
        pairs = dealt.mapInArrow(_products(percent), "u long, v long, a int, b int")
        overlaps = pairs.groupBy("u", "v", "a", "b").agg(F.count(F.lit(1)).alias("n"))
        return found.unionByName(self.compare(overlaps.where(f"n >= {needed('a', 'b', percent)}").select("u", "v"), "others"))

    def components(self) -> DataFrame:
        """(id, size, component_id) of every document."""
        roots = materialise(connected_components(self.links()), "join-roots").withColumnRenamed("node", "row")
        rooted = materialise(self.rows.join(roots, "row", "left").select("row", "id", F.coalesce("root", "row").alias("root")), "join-rooted")
        least = materialise(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "join-least")
        of_row = materialise(rooted.join(least, "root").select("row", "component_id"), "join-components")
        linked = self.sets.where("row is not null").join(of_row, "row").select("id", "size", "component_id")
        return linked.unionByName(self.sets.where("row is null").select("id", "size", F.col("id").alias("component_id")))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    found = Join(docs, id_col, text_col, shingle, percent).components()
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id")


def op13_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of all of documents by shared 5-word shingles."""
    return ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
