"""Embedding whitening from bit-sliced integer cross-products.

Entries become integers x = floor(SCALE c) + OFFSET. Of each dimension the smallest x is taken away, so that few
bits remain. In each task every dimension's bits are cut into planes over the rows, packed 64 rows to a word;
an AND of two planes and a count of its bits, weighted with both planes' values, adds up to the exact sum of
products of two dimensions, whatever the offset. From these sums n Q - S S' is formed as integers, which is n^2 times the
covariance without any rounding, and only then turned into doubles and decomposed.

The fit list holds each distinct x vector once: vectors become bytes and distinct ones are kept by a
pre-aggregated shuffle, so one vector held by a third of all rows arrives once per task. Rows are read twice more,
without moving: for the ranges, and for the results. The driver gets one number pair per dimension and the sums of pairs of
dimensions, which don't grow with the rows.

Defined results: a row whose vector is null, empty or holds null or non-finite entries is dropped; so is one whose
length isn't the most frequent one (of equally frequent ones the largest). Beyond 2^52 entries are held at that bound
(times SCALE they would leave the integers). A component whose eigenvalue is zero to working precision has null in ``whitened`` and
is left out of identity_error; with fewer dimensions than components, there are fewer components. deviation is null where it exceeds
a long, deviation_exact holds it as a decimal (null beyond 38 digits). Ids may be null or repeated, rows may repeat, other columns
are left out, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.plans.tables import materialise

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Largest entry in absolute value.
BOUND = 2.0**52
#: Numbers of a task's block of rows.
BLOCK = 1 << 20
#: Sums of products travel as high * LIMB + low.
LIMB = 1 << 60
_LONG = 1 << 63


def integers(vectors: pa.Array, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places, x): the rows that remain, of ``size`` entries if it is given, and their integers."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(vectors), 0))
    at = np.flatnonzero(lengths > 0 if size is None else lengths == size)
    if not len(at):
        return at, np.zeros((0, size or 0), np.int64)
    flat = pa.compute.list_flatten(vectors.take(pa.array(at))).cast(pa.float64())
    c = np.asarray(pa.compute.fill_null(flat, float("nan"))).reshape(len(at), -1)
    real = np.isfinite(c).all(axis=1)
    return at[real], np.floor(SCALE * np.clip(c[real], -BOUND, BOUND)).astype(np.int64) + OFFSET


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in pieces of some BLOCK numbers."""
    for batch in batches:
        vectors = batch.column(batch.num_columns - 1)
        numbers = len(vectors.flatten()) if batch.num_rows else 0
        step = max(1, BLOCK * batch.num_rows // max(1, numbers))
        for low in range(0, batch.num_rows, step):
            yield batch.slice(low, step)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and length: the number of rows, and of each dimension the least and greatest x."""
    found: dict[int, list] = {}
    for batch in _parts(batches):
        vectors = batch.column(0)
        for size in pa.compute.unique(pa.compute.list_value_length(vectors)).to_pylist():
            at, x = integers(vectors, size) if size else ((), None)
            if len(at):
                n, low, high = found.get(size, (0, x[0], x[0]))
                found[size] = (n + len(x), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
    for size, (n, low, high) in found.items():
        yield pa.RecordBatch.from_pydict({"size": [size], "n": [n], "low": [low.tolist()], "high": [high.tolist()]})


def _packed(low: np.ndarray, width: int):
    """Vectors less ``low`` as bytes, ``width`` to an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            _, x = integers(batch.column(0), len(low))
            y = np.ascontiguousarray((x - low).astype("<u8").view(np.uint8).reshape(len(x), len(low), 8)[:, :, :width])
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(low) * width), len(x), [None, pa.py_buffer(y.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([rows], ["y"])

    return run


def _unpacked(column: pa.Array, size: int, width: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, size, width)
    y = np.zeros((len(raw), size, 8), np.uint8)
    y[:, :, :width] = raw
    return y.view("<u8")[:, :, 0]


def bit_products(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """Exact sums of products of all pairs of columns (the upper half), as Python integers, from bit planes."""
    size = len(bits)
    planes = [np.packbits((y[:, j] >> np.uint64(b)) & np.uint64(1)) for j in range(size) for b in range(bits[j])]
    words = np.zeros((len(planes), -(-len(y) // 64) * 8), np.uint8)
    for i, p in enumerate(planes):
        words[i, : len(p)] = p
    words = words.view(np.uint64)
    starts = np.concatenate([[0], np.cumsum(bits)])
    powers = [1 << b for j in range(size) for b in range(bits[j])]
    small = 2 * max(bits) + len(y).bit_length() < 62
    weights = np.array(powers, np.int64 if small else object)
    total = np.zeros((size, size), object)
    for j in range(size):
        row = np.zeros(len(planes) - starts[j], np.int64 if small else object)
        for b in range(bits[j]):
            counts = np.bitwise_count(words[starts[j] + b] & words[starts[j] :]).sum(axis=1, dtype=np.int64)
            row = row + (counts if small else counts.astype(object)) * (1 << b)
        total[j, j:] = np.add.reduceat(row * weights[starts[j] :], starts[j:-1] - starts[j])
    return total


def _sums(size: int, bits: list[int], width: int):
    """Per task: the number of rows (pair -1, -1), sums (j, -1) and sums of products (j, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            step = max(64, BLOCK // size // 64 * 64)
            for low in range(0, batch.num_rows, step):
                y = _unpacked(batch.column(0).slice(low, step), size, width)
                n, sums, products = n + len(y), sums + y.astype(object).sum(axis=0), products + bit_products(y, bits)
        if n:
            pairs = [(-1, -1, n), *((j, -1, int(s)) for j, s in enumerate(sums)), *((j, k, int(products[j, k])) for j in range(size) for k in range(j, size))]
            for low in range(0, len(pairs), 1 << 14):
                j, k, v = zip(*pairs[low : low + (1 << 14)], strict=True)
                limbs = [pa.array([Decimal(x) for x in part], pa.decimal128(38, 0)) for part in ([x // LIMB for x in v], [x % LIMB for x in v])]
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(k, pa.int32()), *limbs], ["j", "k", "high", "low"])

    return run


class Whitening:
    """A fitted model: ``low`` and ``sums`` per dimension (of x - low), ``axes`` (columns), eigenvalues."""

    def __init__(self, low: np.ndarray, n: int, sums: list[int], products: np.ndarray, components: int):
        self.low, self.n, self.sums = low, n, sums
        size = len(low)
        scatter = [[n * int(products[min(j, k), max(j, k)]) - sums[j] * sums[k] for k in range(size)] for j in range(size)]
        cov = np.array([[v / (n * n) for v in row] for row in scatter])  # a quotient of integers, rounded once
        values, axes = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.axes = values[order], axes[:, order]
        trace = sum(scatter[j][j] for j in range(size)) / (n * n)
        self.explained = self.values / trace if trace else np.full(len(order), np.nan)
        self.usable = self.values > size * np.finfo(float).eps * max(float(values[-1]), 0.0)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n (x - mean) as exact integers."""
        if self.n * (int(y.max(initial=0)) + 1) < 1 << 62:
            return y.astype(np.int64) * self.n - np.array(self.sums, np.int64)
        return y.astype(object) * self.n - np.array(self.sums, object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened coordinates; nan where the eigenvalue is zero."""
        scale = np.where(self.usable, np.sqrt(np.where(self.usable, self.values, 1.0)), np.nan)
        return (centred / self.n).astype(float) @ self.axes / scale

    def deviations(self, centred: np.ndarray) -> list[int]:
        if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < _LONG:
            return (centred**2).sum(axis=1).tolist()
        return (centred.astype(object) ** 2).sum(axis=1).tolist()


def _second_moments(model: Whitening, width: int):
    """Per task: sums of products of whitened coordinates over the fit list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(model.values)
        total = np.zeros((m, m))
        for batch in batches:
            step = max(1, BLOCK // len(model.low))
            for low in range(0, batch.num_rows, step):
                w = model.project(model.centred(_unpacked(batch.column(0).slice(low, step), len(model.low), width)))
                total += w.T @ w
        j, k = np.indices((m, m))
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (j.astype(np.int32), k.astype(np.int32), total)], ["j", "k", "s"])

    return run


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, float | None] | None:
    """The model of a one-column DataFrame of vectors, and its identity error; None if no row remains."""
    ranges = materialise(vectors.mapInArrow(_ranges, "size long, n long, low array<long>, high array<long>"), "vector-ranges")
    best = ranges.groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    size = best["size"]
    at = ranges.where(F.col("size") == size).select(F.posexplode(F.arrays_zip("low", "high")).alias("j", "x"))
    bounds = at.groupBy("j").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).orderBy("j").collect()  # a row per dimension
    low = np.array([b["low"] for b in bounds], np.int64)
    bits = [max(1, (b["high"] - b["low"]).bit_length()) for b in bounds]
    width = -(-max(bits) // 8)
    fit_list = materialise(vectors.mapInArrow(_packed(low, width), "y binary").distinct(), "fit-list")
    sums = fit_list.mapInArrow(_sums(size, bits, width), "j int, k int, high decimal(38,0), low decimal(38,0)")
    sums = sums.groupBy("j", "k").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # a row per pair of dimensions
    of = {(r["j"], r["k"]): int(r["high"]) * LIMB + int(r["low"]) for r in sums}
    products = np.zeros((size, size), object)
    for (j, k), v in of.items():
        if k >= 0:
            products[j, k] = v
    model = Whitening(low, of[-1, -1], [of[j, -1] for j in range(size)], products, components)
    moments = fit_list.mapInArrow(_second_moments(model, width), "j int, k int, s double").groupBy("j", "k").agg(F.sum("s").alias("s")).collect()
    errors = [abs(r["s"] / model.n - (r["j"] == r["k"])) for r in moments if model.usable[r["j"]] and model.usable[r["k"]]]
    return model, max(errors, default=None)


def _apply(shared, error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        m = len(model.values)
        for batch in _parts(batches):
            at, x = integers(batch.column(1), len(model.low))
            centred = model.centred((x - model.low).astype(np.uint64))
            exact = model.deviations(centred)
            times = np.repeat(np.arange(len(at)), m)
            column = lambda v, kind: pa.array(v, kind).take(pa.array(times))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at[times])),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(times), model.n)),
                    column([v if v < _LONG else None for v in exact], pa.int64()),
                    pa.array(model.project(centred).ravel(), from_pandas=True),
                    pa.array(np.tile(model.explained, len(at)), from_pandas=True),
                    pa.array([error] * len(times), pa.float64()),
                    column([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
            )

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained,
    identity_error, deviation_exact."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = "id {}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fitted = fit(rows.select("v"), components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema.format(kind)).withColumnRenamed("id", id_col)
    model, error = fitted
    shared = df.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_apply(shared, error), schema.format(kind)).withColumnRenamed("id", id_col)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """All of embeddings on the leading components of their whitening."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
