from pyspark.sql import functions as F

from linework.plans import tables


def test_a_bucketed_table_keeps_its_buckets_and_leaves_no_entry(spark):
    before = {t.name for t in spark.catalog.listTables()}
    found = tables.bucketed(spark.range(1000).select((F.col("id") % 10).alias("k"), "id"), "numbers", "k")
    assert {t.name for t in spark.catalog.listTables()} == before
    counts = found.groupBy("k").count()
    assert {tuple(r) for r in counts.collect()} == {(k, 100) for k in range(10)}
    assert "hashpartitioning" not in counts._jdf.queryExecution().executedPlan().toString()
