import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linework.llm import langid


def brute_phrases(text, reference):
    """Greedy longest-match phrases by substring search."""
    rest, reference = ("".join(map(chr, langid.codes(t))) for t in (text, reference))
    n = at = 0
    while at < len(rest):
        k = 1
        while at + k < len(rest) and rest[at : at + k + 1] in reference:
            k += 1
        n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("dense", [1 << 24, 0])
def test_phrases_equal_brute_force(monkeypatch, dense):
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "ROWS", 7)
    rng = random.Random(3)
    samples = [(x, "".join(rng.choices(a, k=400)) + "z" * 5) for x, a in (("a", "abc \n"), ("b", "abcdé1"))]
    parser = langid.CrossParser(samples)
    texts = ["".join(rng.choices("abcdéé 2\t漢Z", k=rng.choice([1, 3, 40, 511, 512, 513, 1024, 1500, 5000]))) for _ in range(40)]
    texts += ["a", "漢", "z" * 3000, "z" * 1024, "漢" * 2000, samples[0][1] * 4]  # phrases of five z never meet those of a segment
    got = (parser.costs(texts) / parser.bits).round().astype(int)
    assert got.tolist() == [[brute_phrases(t, s) for _, s in samples] for t in texts]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = langid.labelled_sample(docs.where(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    learnt = {lang: "".join(map(chr, langid.codes(text))) for lang, text in samples}
    assert all(10_000 < len(t) <= 60_100 for t in learnt.values())
    rows = {r.doc_id: r for r in langid.op3_language_id(spark, sf).collect()}
    few = [d for d in docs.collect() if d.text and len(d.text) < 3000 and any(c.isalpha() for c in d.text)]
    assert len(few) > 100
    for d in few:
        cost = {x: brute_phrases(d.text, t) * math.log2(len(t)) for x, t in learnt.items()}
        best = min(sorted(cost), key=cost.get)
        score = 1 / sum(math.exp(-langid.SHARPNESS * (c - cost[best]) / max(cost[best], 1)) for c in cost.values())
        assert rows[d.doc_id].lang_pred == best and rows[d.doc_id].score == pytest.approx(score)


def test_ties_long_texts_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL", 2_000)
    rows = [(i, chr(97 + i % 26) * 3 + f" {chr(97 + i // 26)}" * 2, f"l{i:03}") for i in range(300)]
    long = "bbb a a " * 60_000
    docs = spark.createDataFrame(rows + [(1000, "same text", "x"), (1001, "same text", "w"), (None, long, None), (None, "same text", None)], "doc_id long, text string, lang string")
    docs = docs.withColumn("score", F.lit("kept")).withColumn("lang_score", F.lit("replaced"))
    found = langid.identify(docs, docs).collect()
    assert len(found) == 304 and {r.score for r in found} == {"kept"}
    by = {r.text: r for r in found if r.lang is None}
    assert by["same text"].lang_pred == "w" and by[long].lang_pred == "l001"
    assert sum(r.lang_pred == r.lang for r in found if r.doc_id is not None and r.doc_id < 300) >= 290


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(path).collect()}
    rows = langid.op3_language_id(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert len(rows) > 150
    assert sum(lang[r.doc_id] == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_no_letters_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "123 !?", None), (3, "the the", "en"), (3, "the the", "en"), (4, "der die", "de")], "doc_id long, text string, lang string")
    rows = langid.identify(docs, docs).orderBy("doc_id").collect()
    assert [(r.lang_pred, r.lang) for r in rows] == [("und", "x"), ("und", None), ("en", "en"), ("en", "en"), ("de", "de")]
    assert {r.lang_pred for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), docs).count() == 0


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = lambda n: spark.range(n).selectExpr("id AS doc_id", "'some text' AS text", "'l' || id AS lang")
    assert langid.identify(rows(2), rows(2)).count() == 2
    with pytest.raises(ValueError, match="3 different languages"):
        langid.identify(rows(3), rows(3))


@pytest.mark.parametrize("dense, name", [(1 << 24, "dense"), (0, "keys")])
def test_written_automata_are_mapped(monkeypatch, tmp_path, dense, name):
    monkeypatch.setattr(langid, "DENSE", dense)
    samples = [("a", "abcabd " * 50), ("b", ""), ("c", "xyz é" * 50)]
    built, read = langid.CrossParser(samples), langid.CrossParser(samples, str(tmp_path))
    for k in range(2):
        read.write(k)
    assert all(isinstance(getattr(t, name).base, np.memmap) for t in read.tables)
    texts = ["abd abc" * 200, "xyz", "é", "", "q abcab" * 500]
    assert read.langs == ["a", "c"] and (read.costs(texts) == built.costs(texts)).all()
