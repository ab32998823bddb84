"""Table, encoding and config queries, with DuckDB SQL. Texts and files are derived from the tables by Spark."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linework.operators import lines, search, tables
from linework.plans.tables import new_path
from linework.sources import config, delimited, encodings

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def customers(spark, sf_dir: str) -> DataFrame:
    """customer as rows of cells; the key is the row number."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cells = F.array(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey")])
    return c.select(F.col("c_custkey").alias("row_no"), cells.alias("cells"))


_CELLS = "WITH t AS (SELECT c_custkey AS row_no, [c_custkey::VARCHAR, coalesce(c_name, ''), coalesce(c_mktsegment, ''), c_nationkey::VARCHAR] AS cells FROM customer)\n"


@query("table_find", _CELLS + ", h AS (SELECT row_no AS row, i - 1 AS col FROM (SELECT row_no, unnest(cells) AS v, unnest(range(1, 5)) AS i FROM t) WHERE contains(lower(v), 'build')) SELECT row, col::INT AS col, (SELECT count(*) FROM h) >= 5000 AS capped FROM h ORDER BY 1, 2 LIMIT 5000")
def table_find(spark, sf_dir):
    return search.find_in_cells(customers(spark, sf_dir), "Build")


@query("hits_by_row", _CELLS + ", h AS (SELECT row_no AS row, i - 1 AS col FROM (SELECT row_no, unnest(cells) AS v, unnest(range(1, 5)) AS i FROM t) WHERE contains(lower(v), '1') ORDER BY 1, 2 LIMIT 5000) SELECT row, list(col ORDER BY col)::INT[] AS cols FROM h GROUP BY row")
def hits_by_row(spark, sf_dir):
    """The page of hits that a find shows, which is capped, by row."""
    return search.hits_by_row(search.find_in_cells(customers(spark, sf_dir), "1"))


@query("hits_by_row_whole", _CELLS + "SELECT row_no AS row, list(i - 1 ORDER BY i)::INT[] AS cols FROM (SELECT row_no, unnest(cells) AS v, unnest(range(1, 5)) AS i FROM t) WHERE contains(lower(v), '1') GROUP BY row_no")
def hits_by_row_whole(spark, sf_dir):
    """The cells of all customers, without a cap."""
    return search.hits_by_row(search.cell_hits(customers(spark, sf_dir), "1"))


@query("table_long_form", _CELLS + "SELECT row_no AS row, (unnest(range(4)))::INT AS col, unnest(cells) AS value FROM t")
def table_long_form(spark, sf_dir):
    return tables.long_form(customers(spark, sf_dir))


@query("table_wide", _CELLS + "SELECT row_no, cells[1] AS id, cells[2] AS name, cells[3] AS seg, cells[4] AS nation, '' AS extra FROM t WHERE row_no > 1")
def table_wide(spark, sf_dir):
    return tables.wide(tables.body(customers(spark, sf_dir)), ["id", "name", "seg", "nation", "extra"])


@query("table_shape", _CELLS + "SELECT count(*) FILTER (WHERE row_no > 1) AS data_rows, 4 AS columns, 4 AS width FROM t")
def table_shape(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return tables.shape(rows).join(tables.width(rows))


@query("header_derive", """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders), n AS (SELECT max(1 + k % 3) AS n FROM o)
SELECT i::INT AS col, CASE WHEN i = 0 THEN (SELECT trim(s) FROM o WHERE k = 1) ELSE 'Col' || (i + 1) END AS name FROM (SELECT unnest(range(n)) AS i FROM n)""")
def header_derive(spark, sf_dir):
    """The names of a ragged table of all orders: those of the first row where there are any."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cells = F.slice(F.array(F.col("o_orderstatus"), F.lit(" "), F.lit("")), F.lit(1), (1 + F.col("o_orderkey") % 3).cast("int"))
    return tables.header_table(o.select(F.col("o_orderkey").alias("row_no"), cells.alias("cells")))


@query("tsv_export", _CELLS + r"SELECT row_no, array_to_string(list_transform(cells, lambda x: regexp_replace(x, '[\t\r\n]+', ' ', 'g')), chr(9)) AS line FROM t UNION ALL SELECT 0, 'id' || chr(9) || 'na me' || chr(9) || 'seg' || chr(9) || 'nation'")
def tsv_export(spark, sf_dir):
    return tables.tsv_lines(customers(spark, sf_dir), ["id", "na\tme", "seg", "nation"])


@query("column_profile", _CELLS + """, v AS (SELECT row_no, (unnest(range(4)))::INT AS col, unnest(cells) AS value FROM t WHERE row_no = 1 OR (row_no - 2) % 3 = 0)
SELECT col, greatest(72, least(600, round(max((length(value) - length(regexp_replace(value, '[\\x00-\\xff]', '', 'g'))) * 0.55 * CASE WHEN row_no = 1 THEN 12 ELSE 13 END + length(regexp_replace(value, '[\\x00-\\xff]', '', 'g')) * 1.1 * CASE WHEN row_no = 1 THEN 12 ELSE 13 END)) + 18))::INT AS width FROM v GROUP BY col""".replace("\\\\", "\\").replace(r"[\x00-\xff]", r"[\x{00}-\x{ff}]"))
def column_profile(spark, sf_dir):
    return tables.column_profile(customers(spark, sf_dir), 3)


@query("sampled_rows", _CELLS + "SELECT row_no FROM t WHERE (row_no - 1) % greatest(1, (((SELECT count(*) FROM t) + 99) // 100)) = 0")
def sampled_rows(spark, sf_dir):
    rows = customers(spark, sf_dir)
    return lines.every_kth(rows.select("row_no", (F.col("row_no") - 1).alias("i")), "i", rows.count(), 100).select("row_no")


@query("table_preview", _CELLS + "SELECT row_no, true AS truncated FROM t WHERE row_no <= 100")
def table_preview(spark, sf_dir):
    rows, cut = tables.preview(customers(spark, sf_dir), 100)
    return rows.select("row_no").join(cut)


_DIFF = """WITH l AS (SELECT o_orderkey AS k, o_orderstatus AS s, round(o_totalprice, 4) AS p FROM orders),
r AS (SELECT k, CASE WHEN k % 17 = 0 THEN 'X' ELSE s END AS s, round(CASE WHEN k % 11 = 0 THEN p + 0.5 ELSE p + 0.000001 END, 4) AS p FROM l WHERE k % 23 != 0 UNION ALL SELECT -k, s, p FROM l WHERE k % 29 = 0),
j AS (SELECT coalesce(l.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' ELSE 'changed' END AS status, l.s AS ls, r.s AS rs, l.p AS lp, r.p AS rp FROM l FULL JOIN r ON l.k = r.k),
d AS (SELECT k, status, NULL AS field FROM j WHERE status != 'changed' UNION ALL SELECT k, status, 's' FROM j WHERE status = 'changed' AND ls IS DISTINCT FROM rs UNION ALL SELECT k, status, 'p' FROM j WHERE status = 'changed' AND lp IS DISTINCT FROM rp)
"""


def _order_versions(spark, sf_dir):
    left = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").cast("double").alias("p"))
    k = F.col("k")
    right = left.where(k % 23 != 0).select(k, F.when(k % 17 == 0, "X").otherwise(F.col("s")).alias("s"), F.when(k % 11 == 0, F.col("p") + 0.5).otherwise(F.col("p") + 0.000001).alias("p"))
    return left, right.unionByName(left.where(k % 29 == 0).withColumn("k", -k))


@query("cfg_diff", _DIFF + "SELECT * FROM d")
def cfg_diff(spark, sf_dir):
    return tables.keyed_diff(*_order_versions(spark, sf_dir), "k", ["s", "p"]).select("k", "status", "field")


@query("cfg_diff_totals", _DIFF + "SELECT (SELECT count(*) FROM l) AS rows, count(DISTINCT k) AS differing_rows, count(*) AS differences FROM d")
def cfg_diff_totals(spark, sf_dir):
    left, right = _order_versions(spark, sf_dir)
    return tables.diff_totals(tables.keyed_diff(left, right, "k", ["s", "p"]), left)


# ---- delimited text made of documents' lines ----


@query("csv_lenient", """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, 1 AS row_no, ['id', 'te"xt', ''] AS cells FROM d UNION ALL SELECT doc_id, 2, [doc_id::VARCHAR, replace(t, ';', '"') || 'tail', 'x"y'] FROM d UNION ALL SELECT doc_id, 3, ['last'] FROM d""")
def csv_lenient(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    body = F.replace(F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit(";"), F.lit('""'))
    text = F.concat(F.lit('id;"te""xt";\r\n\n'), F.col("doc_id").cast("string"), F.lit(';"'), body, F.lit('"tail;x"y\r""\nlast'))
    return delimited.parse_delimited(docs.select("doc_id", text.alias("text")), ["doc_id"], "text", ";").withColumn("row_no", F.col("row_no").cast("int"))


@query("delimited_roundtrip", "SELECT c_nationkey AS f, c_custkey // 1000 AS part, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_custkey) AS row_no, [c_custkey::VARCHAR, c_name, c_mktsegment] AS cells FROM customer")
def delimited_roundtrip(spark, sf_dir):
    """customer as files of at most a thousand rows, several for each nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    quoted = lambda x: F.concat(F.lit('"'), F.replace(F.col(x).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws("\t", "c_custkey", quoted("c_name"), quoted("c_mktsegment"))
    file = [F.col("c_nationkey").alias("f"), F.expr("c_custkey div 1000").alias("part")]
    files = c.groupBy(*file).agg(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))).alias("rs"))
    text = F.array_join(F.transform("rs", lambda x: x["r"]), "\r\n")
    return delimited.parse_delimited(files.select("f", "part", text.alias("text")), ["f", "part"], "text", delimited.resolve_delimiter(None, "a.tsv"))


# ---- config files made of orders ----

#: Orders of a file, at most.
FILE_ROWS = 1000

_FIELDS = [("id", "uint"), ("status", "string"), ("price", "double"), ("tags", "string[]"), ("parts", "dict<string,int>"), ("nested", "int[][]"), ("flags", "set<string>"), ("big", "ulong"), ("small", "byte")]


def config_files(spark, sf_dir: str) -> DataFrame:
    """(path, content): files of at most FILE_ROWS orders, each a range of keys."""

    def pack(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["o_orderkey"])
        values = [
            {"id": r["o_orderkey"], "status": r["o_orderstatus"], "price": float(r["o_totalprice"]), "tags": [r["o_orderpriority"], None], "parts": [("c", r["o_custkey"]), ("c", 1)],
             "nested": [[r["o_custkey"], 2], []], "flags": [r["o_orderstatus"]] * 2, "big": 2**63 + r["o_orderkey"], "small": r["o_orderkey"] % 256}
            for r in rows
        ]
        data = config.write_table(_FIELDS, [r["o_custkey"] for r in rows], values)
        return pa.table({"path": [f"/client_cfg/en/orders_{rows[0]['o_orderkey'] // FILE_ROWS}.bin"], "content": [data]})

    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderpriority")
    # narrow rows that stand for much work: as few as their bytes ask for, tasks would leave cores idle
    file, tasks = F.expr(f"o_orderkey div {FILE_ROWS}").alias("file"), 4 * spark.sparkContext.defaultParallelism
    return o.withColumn("file", file).repartition(tasks, "file").groupBy("file").applyInArrow(pack, "path string, content binary")


@query("cfg_rows", """SELECT '/client_cfg/en/orders_' || o_orderkey // 1000 || '.bin' AS path, row_number() OVER (PARTITION BY o_orderkey // 1000 ORDER BY o_orderkey) AS row_no, o_custkey::INT AS key,
o_orderkey AS id, (9223372036854775808::HUGEINT + o_orderkey)::VARCHAR AS big, o_totalprice::DOUBLE AS price, (o_orderkey % 256)::SMALLINT AS small, o_orderstatus AS status, o_orderpriority || ', ' AS tags, 'c: ' || o_custkey || ', c: 1' AS parts,
o_custkey || ', 2, ' AS nested, o_orderstatus || ', ' || o_orderstatus AS flags FROM orders""")
def cfg_rows(spark, sf_dir):
    rows = config.read_config(config_files(spark, sf_dir), _FIELDS)
    return rows.withColumns({c: config.formatted(F.col(c), rows.schema[c].dataType) for c in ("big", "tags", "parts", "nested", "flags")})


@query("cfg_tables", """SELECT 'orders' AS "table", 'en' AS lang, count(DISTINCT o_orderkey // 1000) AS files FROM orders""")
def cfg_tables(spark, sf_dir):
    names = spark.createDataFrame([("orders",), ("parts",)], "table string")
    files = config.table_of_path(config_files(spark, sf_dir).select("path"), names)
    return files.groupBy("table", config.language_of_path(F.col("path")).alias("lang")).agg(F.count(F.lit(1)).alias("files"))


@query("cfg_json", "SELECT o_custkey::INT AS key, o_orderkey::VARCHAR AS id, o_orderstatus AS status, (9223372036854775808::HUGEINT + o_orderkey)::VARCHAR AS big, o_orderpriority AS tag, o_custkey::VARCHAR AS nested FROM orders")
def cfg_json(spark, sf_dir):
    made = config.config_json(config.read_config(config_files(spark, sf_dir), _FIELDS))
    at = lambda path: F.get_json_object("json", path)
    return made.select("key", at("$.id").alias("id"), at("$.status").alias("status"), at("$.big").alias("big"), at("$.tags[0]").alias("tag"), at("$.nested[0][0]").alias("nested"))


# ---- encodings of documents ----


@F.udf(T.BinaryType(), useArrow=False)
def _gb18030(text: str | None) -> bytes | None:
    return None if text is None else text.encode("gb18030")


def encoded_documents(spark, sf_dir: str) -> DataFrame:
    """documents as bytes in turn: UTF-8 with and without a mark, UTF-16 of both orders, and GB18030."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark = lambda h: F.unhex(F.lit(h))
    utf = lambda c: F.encode("text", c)
    turn = F.col("doc_id") % 5
    content = (
        F.when(turn == 0, F.concat(mark("EFBBBF"), utf("UTF-8"))).when(turn == 1, utf("UTF-8")).when(turn == 2, F.concat(mark("FFFE"), utf("UTF-16LE")))
        .when(turn == 3, F.concat(mark("FEFF"), utf("UTF-16BE"))).otherwise(_gb18030(F.when(turn == 4, F.concat(F.lit("中"), "text"))))
    )
    return docs.select("doc_id", content.alias("content"))


@query("encoding_detect", """SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN 'utf-16le' WHEN 3 THEN 'utf-16be' WHEN 4 THEN 'gb18030' ELSE 'utf-8' END AS id, CASE doc_id % 5 WHEN 1 THEN 'utf8' WHEN 4 THEN 'fallback' ELSE 'bom' END AS source,
  doc_id % 5 IN (0, 2, 3) AS bom FROM documents""")
def encoding_detect(spark, sf_dir):
    return encodings.with_encoding(encoded_documents(spark, sf_dir)).select("doc_id", "encoding.id", "encoding.source", "encoding.bom")


@query("encoding_decode", "SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '中' ELSE '' END || coalesce(text, '') AS text FROM documents")
def encoding_decode(spark, sf_dir):
    return encodings.decoded(encodings.with_encoding(encoded_documents(spark, sf_dir))).select("doc_id", "text")


@query("encoding_alias", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'gbk' WHEN 1 THEN 'utf-16le' WHEN 2 THEN 'shift_jis' WHEN 3 THEN 'windows-1252' WHEN 4 THEN 'utf-8' END AS id FROM documents""")
def encoding_alias(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, (" CP936", "Unicode", "SHIFT_JIS", "latin1", "utf_8", "none"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", encodings.encoding_id(names).alias("id"))


@query("garbled", """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(coalesce(text, ''), 'e', chr(65533)) ELSE coalesce(text, '') END AS t FROM documents),
n AS (SELECT doc_id, length(t) AS n, length(t) - length(replace(t, chr(65533), '')) AS bad FROM t) SELECT doc_id, bad >= 4 AND bad * 20 >= n AS garbled FROM n""")
def garbled(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    shown = F.when(F.col("doc_id") % 3 == 0, F.replace(text, F.lit("e"), F.lit("�"))).otherwise(text)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", encodings.garbled(shown).alias("garbled"))


@query("preview_lines", "WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE coalesce(text, '') != '') SELECT doc_id, (CASE WHEN len(a) > 1 AND a[-1] = '' THEN a[:len(a) - 1] ELSE a END)[:14] AS shown FROM s")
def preview_lines(spark, sf_dir):
    """The first lines of texts that are at hand whole; ``preview_whole`` reads bytes and stops at 8 KiB."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("coalesce(text, '') != ''")
    return docs.select("doc_id", encodings.preview_lines(F.col("text"), F.lit(False)).alias("shown"))


@query("preview_whole", """WITH d AS (SELECT doc_id, text AS t FROM documents WHERE coalesce(text, '') != ''),
c AS (SELECT doc_id, i, c, sum(strlen(c)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
  SELECT doc_id, unnest(a) AS c, unnest(range(len(a))) AS i FROM (SELECT doc_id, regexp_extract_all(left(t, 8192), '(?s).') AS a FROM d WHERE strlen(t) > 8192))),
h AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS t FROM c WHERE upto <= 8192 GROUP BY doc_id UNION ALL SELECT doc_id, t FROM d WHERE strlen(t) <= 8192)
SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x, i: i <= 14 AND (i < len(string_split(t, chr(10))) OR x != '')) AS shown FROM h""")
def preview_whole(spark, sf_dir):
    """The previews of all documents, those of more than 8 KiB included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("coalesce(text, '') != ''")
    return docs.select("doc_id", encodings.preview(F.encode("text", "UTF-8"), F.lit("utf-8")).alias("shown"))


@query("encoding_manual", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'utf-16le' END AS id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 = 0 ELSE doc_id % 5 = 2 END AS bom, 'manual' AS source FROM documents")
def encoding_manual(spark, sf_dir):
    choice = F.when(F.col("doc_id") % 2 == 0, "UTF8").otherwise("utf_16_le")
    found = encodings.with_encoding(encoded_documents(spark, sf_dir), choice)
    return found.select("doc_id", "encoding.id", "encoding.bom", "encoding.source")


@query("cfg_tsv", "SELECT o_orderkey AS id, o_custkey || chr(9) || o_orderkey AS line FROM orders")
def cfg_tsv(spark, sf_dir):
    rows = config.read_config(config_files(spark, sf_dir), _FIELDS)
    made = config.config_tsv(rows.withColumn("row_no", F.col("id"))).where("line not like 'key%'")
    return made.select(F.col("row_no").alias("id"), F.substring_index("line", "\t", 2).alias("line"))


@query("csv_split", "SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS text, 2 AS cells FROM documents")
def csv_split(spark, sf_dir):
    """documents written as delimited files with cells of many lines, and read in splits of any place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cell = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    path = new_path(spark, "csv")
    docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(","), cell).alias("value")).write.text(path)
    rows = delimited.split_delimited(spark, path)
    return rows.select(F.get("cells", F.lit(0)).alias("id"), F.get("cells", F.lit(1)).alias("text"), F.size("cells").alias("cells"))
