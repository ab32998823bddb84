import public_tokenizers
import regex
import tiktoken

from linework.llm import bpe
from linework.llm import token_counts as tc

BPE = (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.docs, r.tokens, r.chars) for r in rollup.totals().collect()}


def test_batches_replays_and_compaction(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (1, "a b", "s", "en"), (2, None, None, "en"), (3, " x\ny2 !", "s", None)], "doc_id long, text string, source string, lang string")
    roll = tc.Rollup(spark, str(tmp_path / "r"))
    versions = list(tc.PATTERNS)
    assert totals(roll) == {}
    docs = tc.ledger(docs, tc.PATTERNS, tc.F.when(tc.F.col("doc_id") == 3, "z").otherwise(tc.F.col("text")))
    roll.commit("a", tc.whole(docs, "insert", versions))
    want = {("s", "en", "space-1"): (2, 4, 6), (None, "en", "space-1"): (1, 0, 0), ("s", None, "space-1"): (1, 3, 7)}
    want |= {("s", "en", "class-1"): (2, 4, 6), (None, "en", "class-1"): (1, 0, 0), ("s", None, "class-1"): (1, 4, 7)}
    assert totals(roll) == want
    assert not roll.commit("a", tc.whole(docs, "insert", versions))
    assert totals(roll) == want
    roll.commit("b", tc.whole(docs.where("doc_id = 1").limit(1), "delete", versions))
    roll.commit("c", tc.revised(docs.where("doc_id = 3"), versions))
    roll.commit("c", tc.revised(docs.where("doc_id = 3"), versions))
    assert roll.commit("d/=..", tc.whole(docs.limit(0), "insert", versions)) and not roll.commit("d/=..", tc.whole(docs, "insert", versions))
    want[("s", "en", "space-1")] = want[("s", "en", "class-1")] = (1, 2, 3)
    want[("s", None, "space-1")] = want[("s", None, "class-1")] = (1, 1, 1)
    assert totals(roll) == want
    small = roll.compact(str(tmp_path / "s"))
    assert totals(small) == want
    assert not small.commit("a", tc.whole(docs, "insert", versions)) and not small.commit("d/=..", tc.whole(docs, "insert", versions))
    assert totals(small) == want
    again = small.compact(str(tmp_path / "t"))
    assert not again.commit("c", tc.whole(docs, "insert", versions))
    gone = docs.where("doc_id = 3 and is_new").withColumn("is_new", tc.F.lit(False))
    assert again.commit("e", tc.whole(gone, "delete", versions))
    assert totals(again)["s", None, "space-1"] == (0, 0, 0)


def test_a_crash_before_the_commit_and_two_writers(spark, tmp_path):
    docs = tc.ledger(spark.createDataFrame([(1, "a b", "s", "en")], "doc_id long, text string, source string, lang string"), tc.PATTERNS)
    roll = tc.Rollup(spark, str(tmp_path / "r"))
    roll.commit("a", tc.whole(docs, "insert", ["space-1"]))
    tc._summed(tc.signed(tc.whole(docs, "insert", ["space-1"]))).write.parquet(f"{roll.path}/data/folder=lost")
    assert totals(roll) == {("s", "en", "space-1"): (1, 2, 3)}
    tc._summed(tc.signed(tc.whole(docs, "insert", ["space-1"]))).write.parquet(f"{roll.path}/data/folder=0other")
    roll._publish(spark.createDataFrame([("a", "0other")], "batch_id string, folder string"), "second-file-of-a")
    assert totals(roll) == {("s", "en", "space-1"): (1, 2, 3)}


def test_a_commit_during_a_compaction(spark, tmp_path, monkeypatch):
    """It is neither in the snapshot's sums nor in its list of batches, so it is not lost."""
    docs = tc.ledger(spark.createDataFrame([(1, "a b", "s", "en")], "doc_id long, text string, source string, lang string"), tc.PATTERNS)
    roll, real = tc.Rollup(spark, str(tmp_path / "r")), tc._summed
    changes = tc.whole(docs, "insert", ["space-1"])
    roll.commit("a", changes)

    def meanwhile(rows):
        monkeypatch.setattr(tc, "_summed", real)
        roll.commit("late", changes)
        return real(rows)

    monkeypatch.setattr(tc, "_summed", meanwhile)
    small = roll.compact(str(tmp_path / "s"))
    assert totals(small) == {("s", "en", "space-1"): (1, 2, 3)} and totals(roll) == {("s", "en", "space-1"): (2, 4, 6)}
    assert not small.commit("a", changes) and small.commit("late", changes) and not small.commit("late", changes)
    assert totals(small) == totals(roll)


def test_empty_documents_and_clashing_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a " * 100_000, "s", "en", 1, "x")], "doc_id long, text string, source string, lang string, tokens int, counts string")
    versions = {"space-1": tc.PATTERNS["space-1"], "bpe": BPE, "bpe again": BPE}
    roll = tc.Rollup(spark, str(tmp_path / "r"))
    roll.commit("none", tc.whole(tc.ledger(docs.limit(0), versions), "insert", list(versions)))
    assert totals(roll) == {}
    roll.commit("one", tc.whole(tc.ledger(docs, versions), "insert", list(versions)))
    assert totals(roll) == {("s", "en", v): (1, n, 200_000) for v, n in [("space-1", 100_000), ("bpe", 100_001), ("bpe again", 100_001)]}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BPE[0]), special_tokens={})
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels.setdefault(r.doc_id, []).append(r)
    want = {}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        of = labels.get(d.doc_id, [])
        toxic = any(r.toxic == 1 for r in of)
        low = 0 in [r.quality for r in of]
        text = (d.text or "").translate(dict.fromkeys(map(ord, "#$%&*|!"))) if low and not toxic else d.text or ""
        for version, n in (("space-1", len(regex.findall(r"[^\x20\x09-\x0D]+", text))), ("bpe-50k-1", len(library.encode_ordinary(text)))):
            docs, tokens, chars = want.get((d.source, d.lang, version), (0, 0, 0))
            want[d.source, d.lang, version] = (docs, tokens, chars) if toxic else (docs + 1, tokens + n, chars + len(text))
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens, r.chars) for r in tc.op7_token_counts(spark, sf).collect()}
    assert got == want
