import random

import numpy as np
import pytest

from linework.llm import ngram_join
from linework.llm.ngram_join import least_overlap, meets, must_meet, ngram_components, op13_ngram_join, shingle_hashes

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """[(id, n, component)] of (id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(root(i), []).append(doc)
    least = {r: min((d for d in found if d is not None), default=None) for r, found in ids.items()}
    return sorted(((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def run(spark, rows, schema="doc_id long, text string"):
    found = ngram_components(spark.createDataFrame(rows, schema))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def near_copies(rng, n_originals, words):
    """Texts with copies of every degree of change, stars whose copies don't link with each other, chains and shared passages."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    passage = [word() for _ in range(50)]
    texts = []
    for _ in range(n_originals):
        text = [word() for _ in range(rng.randrange(1, words))]
        if rng.random() < 0.4:
            at = rng.randrange(len(text))
            text[at:at] = passage
        texts.append(text)
        chain = list(text)
        for k in range(rng.randrange(8)):
            copy = list(text)
            for _ in range(max(1, len(text) * k // 100)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
            chain[rng.randrange(len(chain))] = word()
            texts.append(list(chain))
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("seed, words", [(1, 12), (3, 300)])
def test_against_brute_force(spark, seed, words):
    rng = random.Random(seed)
    texts = near_copies(rng, 25, words) + ["", None, " \n", "Same Text", "same\ttext", "one two three four FIVE", "one two three four five"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, "only null"), (None, "only null"), rows[3], rows[3], (rows[4][0], "another text of one id")]
    assert run(spark, rows) == brute(rows)


def test_chunks_of_a_column(spark, monkeypatch):
    """A passage that is nearly all of many different texts, in columns of many chunks."""
    monkeypatch.setattr(ngram_join, "CHUNK", 7)
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(46))
    rows = [(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 10))) + " " + passage) for i in range(80)]
    assert run(spark, rows) == brute(rows)


def test_the_bounds_lose_no_link():
    rng = random.Random(6)
    for _ in range(300):
        common = rng.sample(range(10**6), rng.randrange(1, rng.choice([5, 40, 400])))
        a, b = (sorted({*common, *rng.sample(range(10**6), rng.randrange(max(2, len(common) // 4)))}) for _ in "ab")
        both = sorted(set(a) & set(b))
        if 100 * len(both) >= 80 * len(set(a) | set(b)):
            assert len(both) >= least_overlap(len(a), len(b))
            first = both[: must_meet(least_overlap(len(a), len(b)))]
            assert len(first) == must_meet(least_overlap(len(a), len(b)))
            for g in first:
                assert meets(len(a), a.index(g), len(b), b.index(g))
                for x in (a, b):
                    least = -(-80 * len(x) // 100)
                    assert x.index(g) < len(x) - least + must_meet(least)
        else:
            assert len(both) < least_overlap(len(a), len(b))


def test_long_texts_clashing_columns_and_empty_tables(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(60_000))
    rows = [(5, long, "row", 1.0), (3, long + " more", "gram", 2.0), (1, "x " * 50_000, "", 3.0), (2, "x x x x x", "", 4.0), (9, " " * 1_000_000, "", 5.0)]
    got = run(spark, rows, "doc_id long, text string, row string, root double")
    assert got == sorted([(5, len(shingles(long)), 3), (3, len(shingles(long + " more")), 3), (1, 1, 1), (2, 1, 1), (9, 0, 9)], key=repr)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]
    assert len(np.unique(shingle_hashes(long))) == len(shingles(long))


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op13_ngram_join(spark, SF).collect()), key=repr) == brute(rows)
