import zlib
from collections import Counter
from math import isclose, log10

import pytest
from pyspark.sql import functions as F

from linework.llm import katz


def words(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


class Brute:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for t in texts:
            seq = [*words(t), katz.END]
            self.one.update(seq)
            self.two.update(zip([katz.START, *seq[:-1]], seq))
        self.n, self.v = sum(self.one.values()), len(self.one)
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.GT_MAX + 2)]
        self.d1, self.d2 = katz.discounts(of(self.one)), katz.discounts(of(self.two))
        self.unknown = sum(self.cut(self.d1, c) for c in self.one.values())
        self.after = {}
        for h, w in self.two:
            self.after.setdefault(h, []).append(w)

    def cut(self, d, c):
        return d[min(c, katz.GT_MAX + 1)]

    def p1(self, w):
        c = self.one[w]
        return (c - self.cut(self.d1, c) if c else self.unknown) / self.n

    def p2(self, h, w):
        ch = sum(self.two[h, x] for x in self.after.get(h, ()))
        if not ch:
            return self.p1(w)
        if c := self.two[h, w]:
            return (c - self.cut(self.d2, c)) / ch
        lost = sum(self.cut(self.d2, self.two[h, x]) for x in self.after[h])
        return lost / ch / (1 - sum(map(self.p1, self.after[h]))) * self.p1(w)

    def score(self, text):
        seq = [*words(text), katz.END]
        base = sum(log10((self.one[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in seq)
        return len(seq), sum(w in self.one for w in seq), base, sum(log10(self.p2(h, w)) for h, w in zip([katz.START, *seq[:-1]], seq))


@pytest.mark.parametrize("block, part", [(katz.BLOCK_TOKENS, katz.PART_KEYS), (3000, 4000)])
def test_query_equals_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "PART_KEYS", part)
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    model = Brute([t for d, t in texts.items() if not held[d]])
    rows = katz.op6_katz(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, base, score = model.score(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], n, known, model.n)
        assert isclose(r.base_score, base, rel_tol=1e-9) and isclose(r.score, score, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_every_history_adds_up_to_one():
    model = Brute(["a b a b c", "a a b", "", "c c c c c c c c", "d b a", "a b"] * 3 + ["e f", "g"])
    vocabulary = [*model.one, "never"]
    for h in [*model.after, "never"]:
        assert isclose(sum(model.p2(h, w) for w in vocabulary), 1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, True, 0), (2, "A b", True, 1), (2, "A b", True, 1), (3, "zz  a\tb", None, 2), (None, "", False, 3)], "doc_id long, text string, train boolean, block int")
    model = Brute(["", "A b", "A b"])
    rows = katz.katz_scores(docs, F.col("train"))[0].collect()
    text = {None: "", 1: "", 2: "a b", 3: "zz a b"}
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 2, 2, 3]
    for r in rows:
        n, known, base, score = model.score(text[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known) and isclose(r.score, score) and isclose(r.base_score, base)
    assert katz.katz_scores(docs.limit(0), F.lit(True))[0].count() == 0
    assert {(r.train_tokens, r.score) for r in katz.katz_scores(docs, F.lit(False))[0].collect()} == {(0, 0.0)}


GAPS = {
    "copies in pairs": [0, 1000, 0, 300, 0, 150],
    "more twice than once": [100, 900, 80, 300, 60, 150],
    "closed vocabulary": [0, 0, 0, 0, 0, 0],
    "one count": [7, 0, 0, 0, 0, 0],
    "rising": [1, 2, 3, 4, 5, 6],
    "a gap": [1000, 300, 150, 0, 60, 40],
}


@pytest.mark.parametrize("of_count", GAPS.values(), ids=GAPS)
def test_discounts_with_gaps_stay_good_turing(of_count):
    d = katz.discounts(of_count)
    c = range(1, katz.GT_MAX + 1)
    assert d[0] == 0 and d[-1] == katz.LARGE  # large counts are never discounted like small ones
    assert all(0 < d[r] < r for r in c)
    assert katz.turing(of_count) is None
    kept = [1 - d[r] / r for r in c]
    assert kept == sorted(kept)  # the more often seen, the more is kept


def test_smoothed_discounts_are_exact_on_a_power_law():
    fall = lambda b: [r**b for r in range(1, katz.GT_MAX + 2)]
    for b in (-3.0, -2.0, -1.5):
        assert isclose(katz.slope(fall(b)), b)
        assert all(isclose(x, y) for x, y in zip(katz.smoothed(fall(b)), katz.turing(fall(b)), strict=True))


def test_doubled_texts_add_up_to_one():
    texts = ["a b a b c", "a a b", "", "c c c c c c c c", "d b a", "a b", "e f", "g"]
    model = Brute(texts * 2)
    assert model.d1[-1] == model.d2[-1] == katz.LARGE
    for h in [*model.after, "never"]:
        assert isclose(sum(model.p2(h, w) for w in [*model.one, "never"]), 1)
