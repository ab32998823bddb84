"""Streaming queries over conversations, run to their end, with batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from linework.operators.filters import FilterSpec, filter_lines
from linework.operators.lines import explode_lines
from linework.plans.tables import new_path
from linework.streaming import tail

QUERIES, ORACLES = {}, {}

_LINES = """WITH c AS (SELECT conv_id, turn, role, string_split(text, chr(10)) AS a, ends_with(text, chr(10)) AS closed FROM conversations WHERE coalesce(text, '') != ''),
l AS (SELECT conv_id, turn, role, unnest(CASE WHEN closed THEN a[:len(a) - 1] ELSE a END) AS text, unnest(range(1, len(a) + CASE WHEN closed THEN 0 ELSE 1 END)) AS file_line FROM c)
"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query("tail_stream", _LINES + "SELECT role, conv_id // 1000 AS part, row_number() OVER (PARTITION BY role, conv_id // 1000 ORDER BY conv_id, turn, file_line) AS file_line, text FROM l")
def tail_stream(spark, sf_dir):
    """Spark writes logs of a thousand conversations for each role; the lines are followed into a view."""
    lines = explode_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", keep=("turn", "role"))
    logs = new_path(spark, "logs")
    lines = lines.withColumn("part", F.expr("conv_id div 1000")).repartition("role", "part").sortWithinPartitions("role", "part", "conv_id", "turn", "file_line")
    lines.select("role", "part", "text").write.partitionBy("role", "part").text(logs)
    spark.dataSource.register(tail.TailLines)
    view = tail.LineView(spark, new_path(spark, "view"))
    stream = spark.readStream.format("tail_lines").option("path", logs.removeprefix("file://").removeprefix("file:") + "/role=*/part=*/*.txt").load()
    writer = stream.writeStream.foreachBatch(view.append).option("checkpointLocation", new_path(spark, "offsets"))
    writer.trigger(availableNow=True).start().awaitTermination()
    found = lambda name: F.regexp_extract("path", f"{name}=([^/]*)", 1)
    return view.lines().select(found("role").alias("role"), found("part").cast("long").alias("part"), "file_line", "text")


@query("stream_filter", _LINES + "SELECT conv_id, turn, file_line, text FROM l WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'shon')")
def stream_filter(spark, sf_dir):
    """A keyword filter on a stream of messages, into a table."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")
    lines = filter_lines(explode_lines(stream, "conv_id", keep=("turn",)), FilterSpec(("shon",)))
    out = new_path(spark, "filtered")
    writer = lines.writeStream.format("parquet").option("checkpointLocation", new_path(spark, "offsets")).trigger(availableNow=True)
    writer.start(out).awaitTermination()
    return spark.read.schema(lines.schema).parquet(out)


@query("stream_totals", _LINES + "SELECT role, count(*) AS total_lines, sum(strlen(text) + 1)::BIGINT AS bytes FROM l GROUP BY role")
def stream_totals(spark, sf_dir):
    """Running totals per role; each batch replaces the table."""
    schema = spark.read.parquet(f"{sf_dir}/conversations.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")
    lines = explode_lines(stream, "conv_id", keep=("role",)).select(F.col("role").alias("path"), F.lit(0).alias("generation"), "text", F.lit("line").alias("event"))
    totals, out = tail.running_totals(lines), new_path(spark, "totals")
    writer = totals.writeStream.outputMode("complete").option("checkpointLocation", new_path(spark, "offsets"))
    writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(totals.schema).parquet(out).select(F.col("path").alias("role"), "total_lines", "bytes")
