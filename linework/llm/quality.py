"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is the logistic of  w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j.  The pairwise sum is
taken in linear time as half of  sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2.

Features of a text: its words, lowered and hashed to WORDS slots, with weights log(1 + count) scaled
to length one; structure statistics (sizes, shares of symbols, capitals, repeated words and lines and
so on) and numeric metadata columns, each as a one-hot quantile bin, so that words and structure can
interact. A missing value has a bin of its own.

The machine is fitted on at most TRAIN_ROWS labelled rows, chosen by a hash of the id from all of
them; features of that bounded sample, not texts, come to the driver. All texts are scored where they
lie, whole.

Defined results: null and empty texts are scored by their statistics; a document labelled more than
once counts with its largest label; of documents of one id the one with the least hash teaches; null labels
and null ids teach nothing; without labels every score is 0.5; repeated rows have repeated scores; texts may
be of any length; other columns are left out, whatever their names; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.langid import held_out

TRAIN_ROWS = 4000
WORDS = 1 << 15
RANK = 8
BINS = 10
EPOCHS = 25
#: Cut between the classes.
THRESHOLD = 0.3

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_STOPS = b".,;:'\"-()"
_SPACE = b" \t\n\v\f\r"
_ODD = bytes(c for c in range(128) if c not in _LETTERS + _DIGITS + _STOPS + _SPACE)
STATISTICS = 12
_CACHE = 500_000


def _share(data: bytes, of: bytes) -> float:
    return (len(data) - len(data.translate(None, of))) / max(1, len(data))


class Reader:
    """Texts to (slots, weights, statistics); remembers the slots of words."""

    def __init__(self) -> None:
        self.slots: dict[bytes, int] = {}

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray, list[float]]:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.lower().split()
        if len(self.slots) > _CACHE:
            self.slots.clear()
        slots = self.slots
        for w in set(words).difference(slots):
            slots[w] = xxhash.xxh32_intdigest(w, 0) % WORDS
        at = np.fromiter(map(slots.__getitem__, words), np.int32, len(words))
        found, counts = np.unique(at, return_counts=True)
        weights = np.log1p(counts)
        weights /= max(1e-9, np.sqrt((weights**2).sum()))
        lines = data.split(b"\n")
        n = max(1, len(words))
        return found, weights.astype(np.float32), [
            np.log1p(len(words)),
            sum(map(len, words)) / n,
            _share(data, _UPPER) / max(1e-9, _share(data, _LETTERS)),
            _share(data, _DIGITS),
            _share(data, _ODD),
            _share(data, _STOPS),
            _share(data, _SPACE),
            len(found) / n,
            float((at[1:] == at[:-1]).mean()) if len(at) > 1 else 0.0,
            float(counts.max()) / n if len(counts) else 0.0,
            len(set(lines)) / len(lines),
            np.log1p(len(data) / len(lines)),
        ]


@dataclass
class Machine:
    """Fitted parameters; cuts has the quantiles of each statistic."""

    cuts: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Slots of the one-hot statistics: rows by statistics."""
        at = np.stack([np.searchsorted(c, s, side="right") for c, s in zip(self.cuts, stats.T, strict=True)], axis=1)
        at = np.where(np.isnan(stats), BINS, at)
        return WORDS + np.arange(stats.shape[1]) * (BINS + 1) + at

    def score(self, rows: list[tuple[np.ndarray, np.ndarray, list[float]]]) -> np.ndarray:
        slots, x, starts = flat(rows, self.bins(np.array([r[2] for r in rows], float)))
        return 1 / (1 + np.exp(-self.logit(slots, x, starts)[0]))

    def logit(self, slots: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.factors[slots] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = (sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.linear[slots] * x, starts) + pairs / 2, vx, sums


def flat(rows: list, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and weights of all rows one after the other, and where each begins."""
    one = np.full(bins.shape[1], 1 / np.sqrt(bins.shape[1]), np.float32)
    slots = np.concatenate([p for r, b in zip(rows, bins, strict=True) for p in (r[0], b)]).astype(np.int64)
    x = np.concatenate([p for r in rows for p in (r[1], one)])
    sizes = np.array([len(r[0]) + bins.shape[1] for r in rows])
    return slots, x, np.concatenate([[0], np.cumsum(sizes)[:-1]])


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, n_stats: int) -> Machine:
    """Logistic loss, Adam, fixed seed."""
    rng = np.random.default_rng(0)
    size = WORDS + n_stats * (BINS + 1)
    stats = np.array([r[2] for r in rows], float).reshape(-1, n_stats)
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    cuts = np.array([np.quantile(s[~np.isnan(s)], quantiles) if (~np.isnan(s)).any() else np.zeros(BINS - 1) for s in stats.T])
    rate = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(cuts, float(np.log(rate / (1 - rate))), np.zeros(size, np.float32), rng.normal(0, 0.1, (size, RANK)).astype(np.float32))
    if not len(rows):
        machine.factors[:] = 0
        return machine
    bins = machine.bins(stats)
    wide = lambda: np.zeros((size, RANK + 1), np.float32)
    mean, square, step = wide(), wide(), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(rows), 256):
            pick = order[lo : lo + 256]
            slots, x, starts = flat([rows[i] for i in pick], bins[pick])
            logit, vx, sums = machine.logit(slots, x, starts)
            error = ((1 / (1 + np.exp(-logit)) - labels[pick]) / len(pick)).astype(np.float32)
            of = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(slots))))
            each = np.concatenate([(error[of] * x)[:, None], (error[of] * x)[:, None] * (sums[of] - vx)], axis=1)
            used, back = np.unique(slots, return_inverse=True)
            gradient = np.zeros((len(used), RANK + 1), np.float32)
            np.add.at(gradient, back, each)
            now = np.concatenate([machine.linear[used, None], machine.factors[used]], axis=1)
            gradient += 1e-5 * now
            step += 1
            mean[used] = 0.9 * mean[used] + 0.1 * gradient
            square[used] = 0.99 * square[used] + 0.01 * gradient**2
            now -= 0.03 * (mean[used] / (1 - 0.9**step)) / (np.sqrt(square[used] / (1 - 0.99**step)) + 1e-6)
            machine.linear[used], machine.factors[used] = now[:, 0], now[:, 1:]
            machine.bias -= 0.1 * float(error.sum())
    return machine


def _stats(stats: list[float], meta: tuple) -> list[float]:
    return stats + [np.nan if m is None else float(m) for m in meta]


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, meta_cols: tuple[str, ...]) -> tuple[list, np.ndarray]:
    """Features and labels of at most TRAIN_ROWS labelled documents."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    total = known.count()
    share = min(1.0, 1.5 * TRAIN_ROWS / max(1, total))
    h = F.xxhash64(F.col(id_col))
    few = known.where(F.pmod(h, F.lit(1 << 40)) < share * (1 << 40)).orderBy(h, id_col).limit(TRAIN_ROWS)
    known = F.struct("_y", F.col(text_col).alias("_t"), *[F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(meta_cols)])
    rows = docs.select(id_col, text_col, *meta_cols).join(F.broadcast(few), id_col)
    rows = rows.groupBy(id_col).agg(F.min_by(known, F.xxhash64(text_col, *meta_cols)).alias("_r")).select("_r.*")  # an id may be repeated

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                y, text, *meta = [c.to_pylist() for c in batch.slice(lo, 256).columns]
                read = [reader.read(t) for t in text]
                stats = [_stats(r[2], m) for r, m in zip(read, zip(*meta) if meta else [()] * len(read), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(y, pa.int32()),
                        pa.array([r[0] for r in read], pa.list_(pa.int32())),
                        pa.array([r[1] for r in read], pa.list_(pa.float32())),
                        pa.array(stats, pa.list_(pa.float64())),
                    ],
                    ["y", "slots", "x", "stats"],
                )

    table = rows.mapInArrow(features, "y int, slots array<int>, x array<float>, stats array<double>").toArrow()
    slots, x, stats = (table.column(k) for k in ("slots", "x", "stats"))
    read = [(np.asarray(s.values), np.asarray(w.values), t.as_py()) for s, w, t in zip(slots, x, stats, strict=True)]
    labels_of = np.array(table.column("y").to_pylist(), np.float32)
    order = sorted(range(len(read)), key=lambda i: (labels_of[i], read[i][2]))  # whatever the order of tasks
    return [read[i] for i in order], labels_of[order]


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("n_chars",), score_col: str = "score"
) -> DataFrame:
    """id and ``score_col`` of every row of ``docs``; ``labels`` has id and label to learn from."""
    rows, y = training_rows(docs, labels, id_col, text_col, label_col, meta_cols)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, y, STATISTICS + len(meta_cols)))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, machine = Reader(), shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                text, *meta = [c.to_pylist() for c in part.columns[1:]]
                read = [(a, b, _stats(s, m)) for (a, b, s), m in zip(map(reader.read, text), zip(*meta) if meta else [()] * len(text), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(machine.score(read).astype(float))], ["id", "score"])

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col), *[F.col(c).cast("double") for c in meta_cols])
    return read.mapInArrow(score, f"id {kind}, score double").select(F.col("id").alias(id_col), F.col("score").alias(score_col))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of every text of documents, learnt from labels."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    labels = read("labels").where(~held_out("doc_id"))
    found = classify(read("documents").select("doc_id", "text", "n_chars"), labels)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
