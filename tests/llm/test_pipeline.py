import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from linework.llm.bpe import load_ranks
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_run_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = {d: t for d, t in docs.items() if re.search(r"[^\W\d_]", t)}
    keep = {}
    for d, t in docs.items():
        k = re.sub("[\x20\x09-\x0d]", "", t)
        keep[k] = min(keep.get(k, (1, 0)), (-len(t), d))
    docs = {d: docs[d] for _, d in keep.values()}
    roots = brute_components({d: brute_fingerprint(t) for d, t in docs.items()})
    docs = {d: t for d, t in docs.items() if roots[d] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = brute_contamination(list(docs.items()), items)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = {d: library.encode_ordinary(t) for d, t in docs.items() if not bad[d][4]}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(rows) == len(want) < 200
    assert {r.doc_id: r.ids for r in rows} == want


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert set(stage(spark, docs.limit(20), "/root/testdata/sf0.001").columns) == set(docs.columns)


def test_stages_take_nulls_empty_tables_repeats_and_other_columns(spark):
    sf = "/root/testdata/sf0.001"
    long = "word " * 30_000
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (3, "same text here", "en", None, 3, None), (3, "same text here", "en", None, 3, None),
            (None, "no id at all", None, "s", None, "y"), (4, long, "en", "s", 1, "z"), (5, long + "x", "en", "s", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = stage(spark, docs, sf).collect()
        assert stage(spark, docs.limit(0), sf).count() == 0
    ids = lambda name: sorted((r.doc_id or 0 for r in kept[name]))
    assert ids("language_id") == [0, 3, 3, 4, 5]
    assert ids("exact_dedup") == [0, 1, 3, 4, 5]
    assert ids("simhash_near_dedup") == [0, 1, 3, 3, 4]
    assert ids("decontaminate") == [0, 1, 2, 3, 3, 4, 5]
    assert len(kept["byte_bpe"]) == len(rows)


def test_near_duplicates_go_by_row_not_by_id(spark):
    sf = "/root/testdata/sf0.001"
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(1, text + " end"), (1, "a clean text of its own that has no copy at all"), (0, text), (None, text + " other"), (None, "another clean text that is like no other here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text[:5]) for r in corpus_pipeline.near(spark, docs, sf).collect()) == [(-1, "anoth"), (0, "word0"), (1, "a cle")]
