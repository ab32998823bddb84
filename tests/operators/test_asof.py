import random

import pytest

from linework.operators.asof import asof_join, seek_hits


def brute(left, right, backward, strict, wrap):
    out = []
    for k, p, name in left:
        group = sorted((q, v) for key, q, v in right if key == k)
        fits = [x for x in group if (x[0] < p or x[0] == p and not strict if backward else x[0] > p or x[0] == p and not strict)]
        near = (fits[-1] if backward else fits[0]) if fits else ((group[-1] if backward else group[0]) if wrap and group else None)
        out.append((k, p, name, near))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("backward", [True, False])
@pytest.mark.parametrize("strict, wrap", [(False, False), (True, True)])
def test_against_brute_force(spark, parts, backward, strict, wrap):
    """One group holds half of all rows; keys may be null; places and rows repeat."""
    rng = random.Random(parts)
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None, rng.randrange(9)])
    left = [(key(), rng.randrange(40), f"l{rng.randrange(3)}") for _ in range(150)]
    right = [(k, rng.randrange(60), f"r{i % 5}") for i in range(120) if (k := key()) != 3]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        found = asof_join(spark.createDataFrame(left, "k long, p int, name string"), spark.createDataFrame(right, "k long, p int, v string"), ["k"], ["p"], "x", backward, strict, wrap)
        assert found.columns == ["k", "p", "name", "x"]
        got = sorted(((r.k, r.p, r.name, None if r.x is None else (r.x.p, r.x.v)) for r in found.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(left, right, backward, strict, wrap)


def test_cursors_go_around(spark):
    hits = spark.createDataFrame([("a", 1, 5), ("a", 3, 0), ("b", 2, 2)], "doc string, line int, off int")
    cursors = spark.createDataFrame([("a", 1, 5), ("a", 9, 9), ("a", 0, 0), ("b", 2, 2), ("c", 1, 1)], "doc string, line int, off int")
    got = {(r.doc, r.line): (r.next_hit and tuple(r.next_hit), r.prev_hit and tuple(r.prev_hit)) for r in seek_hits(hits, cursors, "doc", ["line", "off"]).collect()}
    assert got == {("a", 1): ((3, 0), (3, 0)), ("a", 9): ((1, 5), (3, 0)), ("a", 0): ((1, 5), (3, 0)), ("b", 2): ((2, 2), (2, 2)), ("c", 1): (None, None)}
    assert seek_hits(hits.limit(0), cursors.limit(0), "doc", ["line", "off"]).count() == 0
