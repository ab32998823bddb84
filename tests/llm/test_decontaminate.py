import hashlib
import random
import re

import numpy as np
import pytest

from linework.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=13):
    """Contract columns by comparing every window with every place."""
    windows = {}
    for item_id, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(str(item_id))
    out = {}
    for doc_id, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if of := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= of
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def contract(rows):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows}


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    return read("documents"), read("benchmark")


def test_matches_brute_force(tables):
    docs, bench = tables
    got = contract(dc.digests(dc.decontaminate(docs, bench)).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(x[4] for x in got.values()) and not all(x[4] for x in got.values())


def test_a_benchmark_beyond_the_bound_gives_the_same(tables, monkeypatch):
    docs, bench = tables
    want = dc.decontaminate(docs, bench).collect()
    monkeypatch.setattr(dc, "MAX_PATTERN_BYTES", 100)
    assert sorted(dc.decontaminate(docs, bench).collect()) == sorted(want)


def test_edges_and_spans(spark):
    bench = spark.createDataFrame([(1, "Élan vital, QUICK"), (2, None), (3, "..."), (1, "Élan vital, QUICK")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x Élan  vital—quick", "k"), (2, None, "k"), (3, "", None), (4, "é Élan\tVITAL.quick! Élan vital quick", "k"), (4, "none", "k")],
        "doc_id long, text string, n_hit string",
    )
    rows = dc.decontaminate(docs, bench).orderBy("doc_id", "n_words").collect()
    assert [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in rows] == [
        (1, 3, 0, []), (2, 0, 0, []), (3, 0, 0, []), (4, 1, 0, []), (4, 7, 6, ["1"])]
    text = "é Élan\tVITAL.quick! Élan vital quick"
    assert [text[s.start : s.end] for s in rows[-1].spans] == ["Élan\tVITAL.quick! Élan vital quick"]
    assert dc.decontaminate(docs.limit(0), bench).count() == 0
    assert {r.n_hit for r in dc.decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_edges_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(dc, "MAX_PATTERN_BYTES", 1)
    monkeypatch.setattr(dc, "BITMAP_BITS", 1 << 15)
    test_edges_and_spans(spark)


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words), "x"), (None, "W100 w101", "y"), (None, "w" * 400_000, "z")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([("a", " ".join(words[40_000:40_020]), 1), (None, "w100.w101", 2), ("b", "w" * 400_000, 3)], "item_id string, text string, doc_id int")
    rows = sorted(dc.decontaminate(docs, bench, carry=("item_id",)).collect(), key=lambda r: r.item_id)
    assert [(r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in rows] == [(1, 60_000, 22, ["", "a"]), (None, 2, 2, [""]), (None, 1, 1, ["b"])]


def test_automaton_matches_brute_force_on_few_words():
    """Few different words, so that failure links, nested and overlapping windows all occur."""
    rng = random.Random(5)
    for _ in range(150):
        window, kinds = rng.choice([2, 3, 5, 13]), rng.choice([2, 3, 8])
        text = lambda n: " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))  # noqa: B023, E731
        items = [(rng.choice("abcdef"), text(rng.randrange(25))) for _ in range(rng.randrange(8))]
        docs = [text(rng.randrange(400)) for _ in range(rng.randrange(1, 9))]
        found = dc.Windows.of(items, window).scan([dc.words_of(d) for d in docs], window)
        want = brute(enumerate(docs), items, window)
        for i, (ranges, ids) in enumerate(found):
            assert (sum(b - a for a, b in ranges), hashlib.sha256(",".join(ids).encode()).hexdigest()) == (want[i][1], want[i][3])
            assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))


def test_automaton_is_the_same_from_its_files(tmp_path):
    made = dc.Windows.of([("b", "x y z"), ("a", "y z x y")], 3)
    made.write(f"file:{tmp_path}/made")
    read = dc.Windows.read(f"{tmp_path}/made")
    docs = [dc.words_of("x y z x y"), [], dc.words_of("z y x")]
    assert read.scan(docs, 3) == made.scan(docs, 3) == [([(0, 5)], ["a", "b"]), ([], []), ([], [])]
    assert isinstance(read.keys, np.memmap)


def test_runs_of_words_give_the_same(tables, monkeypatch):
    docs, bench = tables
    texts = [r.text for r in docs.collect()]
    windows = dc.Windows.of([(r.item_id, r.text) for r in bench.collect()], dc.WINDOW)
    whole = windows.scan([dc.words_of(t) for t in texts], dc.WINDOW)
    monkeypatch.setattr(dc, "RUN_WORDS", 700)
    runs = list(dc._runs(texts))
    assert len(runs) > 1 and sum(runs, []) == texts
    assert [x for run in runs for x in windows.scan([dc.words_of(t) for t in run], dc.WINDOW)] == whole
