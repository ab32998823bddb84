from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm.whitening import bit_products, whiten

SF = "/root/testdata/sf0.001"


def brute(vectors, components=16):
    """x, fit list, covariance and deviations with plain integers and fractions."""
    xs = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, xs)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[j] for v in fit) for j in range(d)]
    mean = [Fraction(t, n) for t in s]
    cov = np.array([[float(sum((v[j] - mean[j]) * (v[k] - mean[k]) for v in fit) / n) for k in range(d)] for j in range(d)])
    deviations = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in xs]
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    centred = np.array([[float(v[j] - mean[j]) for j in range(d)] for v in xs])
    return n, deviations, centred @ axes / np.sqrt(values), values / np.trace(cov)


def check(spark, rows, schema="vec_id long, embedding array<float>, n int, component string", components=16):
    got = whiten(spark.createDataFrame(rows, schema), components=components).collect()
    good = [r for r in rows if r[1] and all(c is not None and np.isfinite(c) for c in r[1])]
    n, deviations, whitened, explained = brute([np.float32(r[1]) for r in good], components)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(by) == sorted(r[0] for r in good)
    signs = None
    for i, row in enumerate(good):
        mine = [by[row[0]][c + 1] for c in range(whitened.shape[1])]
        assert {m["n"] for m in mine} == {n}
        assert {m["deviation_exact"] for m in mine} == {deviations[i]}
        assert {m["deviation"] for m in mine} == {deviations[i] if deviations[i] < 2**63 else None}
        w = np.array([m["whitened"] for m in mine])
        signs = np.sign(w * whitened[i]) if signs is None else signs
        np.testing.assert_allclose(w * signs, whitened[i], atol=1e-8)
        np.testing.assert_allclose([m["explained"] for m in mine], explained, rtol=1e-6)
        assert mine[0]["identity_error"] < 1e-6


def test_against_brute_force_with_bad_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i, [float(c) for c in rng.normal(0, 1, 5) * [1, 2, 3, 4, 50]], 7, "x") for i in range(70)]
    copies = [(100 + i, good[0][1], 7, "x") for i in range(40)]
    bad = [(900, None, 1, None), (901, [], 1, ""), (902, [1.0, None, 1.0, 1.0, 1.0], 1, ""), (903, [float("nan")] + [1.0] * 4, 1, ""), (904, [float("inf")] + [1.0] * 4, 1, "")]
    check(spark, good + copies + bad)


def test_large_entries_stay_exact(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, [float(c) for c in rng.normal(0, 1, 3) * [1e9, 3e10, 1e12]], 0, "") for i in range(30)])


def test_constant_dimension_single_row_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    flat = whiten(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], schema)).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True}
    one = whiten(spark.createDataFrame([(1, [2.0]), (2, [2.0])], schema)).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 2
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], schema)).columns[0] == "vec_id"


def test_the_most_frequent_length_counts(spark):
    rows = [(i, [float(i % 3), float(i)]) for i in range(5)] + [(9, [1.0, 2.0, 3.0]), (None, [0.5, 0.5])]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r[0] for r in got.select("vec_id").distinct().collect()} == {0, 1, 2, 3, 4, None}


@pytest.mark.parametrize("bits", [[1, 3, 7], [60, 2, 33]])
def test_bit_products(bits):
    rng = np.random.default_rng(3)
    y = np.stack([rng.integers(0, 1 << b, 131, dtype=np.uint64) for b in bits], axis=1)
    got = bit_products(y, bits)
    for j in range(3):
        for k in range(j, 3):
            assert got[j, k] == sum(int(a) * int(b) for a, b in zip(y[:, j], y[:, k]))


def test_query_on_the_whole_table(spark):
    from linework.llm.whitening import op11_whitening

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = op11_whitening(spark, SF)
    vectors = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    n, deviations, whitened, explained = brute([v for _, v in vectors])
    first = {r["vec_id"]: r for r in got.where("component = 1").collect()}
    second = {r["vec_id"]: r for r in got.where("component = 16").collect()}
    assert got.count() == 16 * len(vectors) and {r["n"] for r in first.values()} == {n}
    assert [first[i]["deviation"] for i, _ in vectors] == deviations
    for found, c in ((first, 0), (second, 15)):
        w = np.array([found[i]["whitened"] for i, _ in vectors])
        np.testing.assert_allclose(w * np.sign(w[0] * whitened[0, c]), whitened[:, c], atol=1e-7)
        assert abs(found[vectors[0][0]]["explained"] - explained[c]) < 1e-9
    assert got.agg(F.max("identity_error")).first()[0] < 1e-8
