import numpy as np

from linework.llm import quality


def test_sum_of_squares_equals_pairs():
    rng = np.random.default_rng(1)
    reader = quality.Reader()
    rows = [reader.read(t) for t in ("a b a c", "", "one TWO 3 $$", "x\ny\nx")]
    machine = quality.fit(rows, np.array([1, 0, 1, 0], np.float32), quality.STATISTICS)
    machine.linear = rng.normal(size=machine.linear.shape)
    machine.factors = rng.normal(size=machine.factors.shape)
    bins = machine.bins(np.array([r[2] for r in rows]))
    for row, b, score in zip(rows, bins, machine.score(rows), strict=True):
        at = np.concatenate([row[0], b])
        x = np.concatenate([row[1], np.full(len(b), 1 / np.sqrt(len(b)))])
        z = machine.bias + (machine.linear[at] * x).sum()
        z += sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op4_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in label]
    good, bad = ([r.score for r in held if label[r.doc_id] == k] for k in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    accuracy = np.mean([r.predicted == label[r.doc_id] for r in held])
    assert auc > 0.95 and accuracy > 0.93, (auc, accuracy)


def test_nulls_repeats_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", 0, "y"), (3, "a b", 3, None), (3, "a b", 3, None)], "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (2, None), (9, 1)], "doc_id long, quality int")
    rows = sorted((r.doc_id, r.score) for r in quality.classify(docs, labels).collect())
    assert [r[0] for r in rows] == [1, 2, 3, 3] and rows[2] == rows[3]
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_query_equals_all_pairs(spark):
    """The query's scores from plain loops over pairs of features."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out("doc_id"))
    rows, y = quality.training_rows(docs, labels, "doc_id", "text", "quality", ("n_chars",))
    labelled = {r.doc_id for r in labels.where("quality is not null").collect()}
    assert len(rows) == len({d.doc_id for d in docs.select("doc_id").collect()} & labelled)
    machine = quality.fit(rows, y, quality.STATISTICS + 1)
    got = {r.doc_id: r.score for r in quality.op4_quality(spark, sf).collect()}
    reader = quality.Reader()
    some = [d for d in docs.collect() if len(d.text or "") < 1500][:60]
    for d in some:
        slots, weights, stats = reader.read(d.text)
        bins = machine.bins(np.array([[*stats, d.n_chars]], float))[0]
        at = np.concatenate([slots, bins])
        x = np.concatenate([weights, np.full(len(bins), 1 / np.sqrt(len(bins)))])
        z = machine.bias + float((machine.linear[at] * x).sum())
        for i in range(len(at)):
            for j in range(i):
                z += float(machine.factors[at[i]] @ machine.factors[at[j]]) * x[i] * x[j]
        assert abs(got[d.doc_id] - 1 / (1 + np.exp(-z))) < 1e-4


def test_an_id_that_is_repeated_teaches_once(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 3)
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(500)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] + [(None, 1)], "doc_id long, quality int")
    rows, y = quality.training_rows(docs, labels, "doc_id", "text", "quality", ())
    assert 1 <= len(rows) <= 3
