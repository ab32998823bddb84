"""Queries over written log files: lines, ranges by an index, pages backwards, heads; with DuckDB SQL.

Spark writes the texts of documents as logs, each with a bounded range of ids, one document after the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.plans.tables import materialise, new_path
from linework.sources import files
from linework.sources.lines import read_lines

QUERIES, ORACLES = {}, {}

FILES = r"""WITH t AS (SELECT doc_id // 50 AS part, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
raw AS (SELECT part, doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM t),
file AS (SELECT part, row_number() OVER w AS file_line, (sum(strlen(line) + 1) OVER w - strlen(line) - 1)::BIGINT AS byte_offset, count(*) OVER (PARTITION BY part) AS n,
  CASE WHEN ends_with(line, chr(13)) THEN left(line, length(line) - 1) ELSE line END AS text
  FROM raw WINDOW w AS (PARTITION BY part ORDER BY doc_id, i))
"""


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def logs(spark: SparkSession, sf_dir: str) -> str:
    """The path of the logs."""
    path = new_path(spark, "logs")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.expr("doc_id div 50").alias("part"), "doc_id", "text")
    docs.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "text").write.partitionBy("part").text(path)
    return path


def part() -> F.Column:
    return F.regexp_extract("path", "part=([^/]*)", 1).cast("long").alias("part")


def splits_of(spark: SparkSession, path: str) -> DataFrame:
    return files.line_splits(files.with_encodings(files.manifest(spark, path)))


@query("file_lines", FILES + "SELECT part, file_line, text FROM file")
def file_lines(spark, sf_dir):
    return read_lines(spark, logs(spark, sf_dir)).select(part(), "file_line", "text")


@query("file_line_places", FILES + "SELECT part, file_line, byte_offset FROM file WHERE (file_line - 1) % 64 = 0")
def file_line_places(spark, sf_dir):
    return files.line_index(splits_of(spark, logs(spark, sf_dir))).select(part(), "file_line", "byte_offset")


@query("file_ranges", FILES + "SELECT part, file_line, byte_offset, text FROM file WHERE file_line BETWEEN 100 + part % 7 AND 130 OR file_line BETWEEN n - 3 AND n + 4")
def file_ranges(spark, sf_dir):
    """Two ranges of each file, the second one running over its end, read from the written index."""
    splits, index = splits_of(spark, logs(spark, sf_dir)), new_path(spark, "index")
    files.write_index(files.line_index(splits), index)
    totals = splits.groupBy("path").agg(F.sum("n").alias("n")).withColumn("p", part())
    ranges = F.explode(F.array(F.struct((100 + F.col("p") % 7).alias("first"), F.lit(130).cast("long").alias("last")), F.struct(F.greatest(F.col("n") - 3, F.lit(131)).alias("first"), (F.col("n") + 4).alias("last"))))
    wanted = totals.select("path", ranges.alias("r")).select("path", "r.*")
    tail = totals.where("n < 134").select("path", F.greatest(F.col("n") - 3, F.lit(1)).alias("first"), F.least("n", F.lit(99) + F.col("p") % 7).alias("last"))
    found = files.read_ranges(wanted.unionByName(tail), spark.read.parquet(index))
    return found.select(part(), "file_line", "byte_offset", "text")


@query("file_indexed", FILES + "SELECT part, file_line, text FROM file WHERE file_line BETWEEN 150 AND 160")
def file_indexed(spark, sf_dir):
    """The same through a data source that is told which lines are wanted."""
    index = new_path(spark, "index")
    files.write_index(files.line_index(splits_of(spark, logs(spark, sf_dir))), index)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(files.IndexedLines)
    found = spark.read.format("indexed_lines").option("index", index).load().where("file_line between 150 and 160")
    return found.select(part(), "file_line", "text")


@query("file_page_back", FILES + """SELECT part, file_line, byte_offset, text, CASE WHEN file_line > n - 30 THEN n > 30 ELSE n > 60 END AS has_more FROM file WHERE file_line > n - 60""")
def file_page_back(spark, sf_dir):
    """The last page of each file and the one before it, without an index."""
    found = files.with_encodings(files.manifest(spark, logs(spark, sf_dir)))
    splits = files.line_splits(found)
    last = materialise(files.page_back(found.withColumn("before", F.lit(None).cast("long")), 30), "page")
    cursors = last.where("has_more").groupBy("path", "size", "encoding").agg(F.min("byte_offset").alias("before"))
    pages = [files.number_page(p, splits) for p in (last, materialise(files.page_back(cursors, 30), "page"))]
    return pages[0].unionByName(pages[1]).select(part(), "file_line", "byte_offset", "text", "has_more")


@query("file_heads", FILES + """, whole AS (SELECT part, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS t FROM (SELECT doc_id // 50 AS part, doc_id, text FROM documents) GROUP BY part),
c AS (SELECT part, i, c, sum(strlen(c)) OVER (PARTITION BY part ORDER BY i) AS upto FROM (SELECT part, unnest(a) AS c, unnest(range(len(a))) AS i FROM (SELECT part, regexp_extract_all(left(t, 2048), '(?s).') AS a FROM whole)))
SELECT part, strlen(any_value(whole.t)) AS bytes, strlen(any_value(whole.t)) > 2048 AS truncated, 'utf-8' AS encoding, string_agg(c, '' ORDER BY i) FILTER (WHERE upto <= 2048) AS text FROM c JOIN whole USING (part) GROUP BY part""")
def file_heads(spark, sf_dir):
    """The first 2 KiB of each file, without the rest of a cut character."""
    read = files.read_documents(spark, logs(spark, sf_dir), cap=2048)
    return read.select(part(), "bytes", "truncated", F.col("encoding.id").alias("encoding"), F.regexp_replace("text", r"\x{FFFD}+\z", "").alias("text"))
