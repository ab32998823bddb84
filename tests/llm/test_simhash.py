import random

import pytest
import xxhash

from linework.llm import simhash
from linework.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {d: d for d in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if root[b] < root[a] and (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a], changed = root[b], True
    return root


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = {r.doc_id: r for r in simhash.op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    fps = {d: brute_fingerprint(t) for d, t in texts.items()}
    assert {d: int(r.fingerprint, 16) for d, r in rows.items()} == fps
    assert {d: r.component_id for d, r in rows.items()} == brute_components(fps)


@pytest.mark.parametrize("chunk", [4096, 5])
@pytest.mark.parametrize("group", [64, 1e-9])
def test_links_lose_nothing(spark, monkeypatch, chunk, group):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for f in fps[:20]:  # chains of near fingerprints
        for _ in range(6):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5])))
            fps.append(f)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "GROUP", group)
    signed = {simhash._signed(f): f for f in fps}
    distinct = spark.createDataFrame([(s,) for s in signed], "fp long")
    edges = simhash.links(distinct.select("fp", *simhash.distances(distinct["fp"])))
    got = {r.node: r.root for r in connected_components(edges).collect()}
    want = brute_components({s: f for s, f in signed.items()})
    assert {s: got.get(s, s) for s in signed} == want


def test_nulls_ties_repeats_and_empty(spark):
    docs = spark.createDataFrame([(3, None, 1), (2, " \t", 2), (9, "one two", 3), (9, "one two", 3), (4, "ONE two", 4), (None, "one  two", 5)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 4), (2, 2), (3, 2), (4, 4), (9, 4), (9, 4)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(300, 200), (300, 200)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 300: 200}
