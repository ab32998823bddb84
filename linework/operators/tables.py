"""Delimited tables as rows of cells: headers, shape, search, profiles, export, long and wide forms.

A table is (path columns, row_no, cells ARRAY<STRING>) with row_no from 1 in each path; rows may be ragged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds and padding of a column's width, and a character's share of the font size.
MIN_WIDTH, MAX_WIDTH, PADDING = 72, 600, 18
NARROW, WIDE = 0.55, 1.1


def visible_marks(text: Column) -> Column:
    """Line ends and tabs as visible signs."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n|\r|\n", "␊"), "\t", "⇥")


def width(rows: DataFrame) -> DataFrame:
    """(width): cells of the longest row, 0 for an empty table."""
    return rows.agg(F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("width"))


def body(rows: DataFrame, header: bool = True) -> DataFrame:
    """The rows after the header."""
    return rows.where("row_no > 1") if header else rows


def shape(rows: DataFrame, header: bool = True) -> DataFrame:
    """(data_rows, columns)."""
    return rows.agg(F.count_if(F.col("row_no") > int(header)).alias("data_rows"), F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("columns"))


def cell(cells: Column, i: int) -> Column:
    """The i-th cell from 0; '' where the row is shorter."""
    return F.coalesce(F.get(cells, F.lit(i)), F.lit(""))


def header_names(rows: DataFrame, header: bool = True, generated: str = "Col") -> list[str]:
    """A name for every column: the first row's, trimmed, or ``generated`` and the number. One row and one
    number come to the driver."""
    n = width(rows).first()["width"]
    first = rows.where("row_no = 1").select("cells").first() if header else None
    names = list(first["cells"]) if first else []
    names += [""] * (max(n, len(names)) - len(names))
    return [(x or "").strip() or f"{generated}{i + 1}" for i, x in enumerate(names)]


def header_table(rows: DataFrame, generated: str = "Col") -> DataFrame:
    """(col, name) of every column, without the driver."""
    first = F.max(F.when(F.col("row_no") == 1, F.col("cells")))
    both = rows.agg(F.coalesce(F.max(F.size("cells")), F.lit(0)).alias("n"), first.alias("first")).where("n > 0")
    names = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.nullif(F.trim(F.get("first", i)), F.lit("")), F.concat(F.lit(generated), i + 1)))
    return both.select(F.posexplode(names).alias("col", "name"))


def long_form(rows: DataFrame) -> DataFrame:
    """(row, col, value): one row per cell."""
    return rows.select(F.col("row_no").alias("row"), F.posexplode("cells").alias("col", "value"))


def wide(rows: DataFrame, names: list[str]) -> DataFrame:
    """A column per name, '' for missing cells."""
    return rows.select("row_no", *[cell(F.col("cells"), i).alias(n) for i, n in enumerate(names)])


def flat(text: Column) -> Column:
    """Tabs and line ends as one space."""
    return F.regexp_replace(text, r"[\t\r\n]+", " ")


def tsv_lines(rows: DataFrame, names: list[str]) -> DataFrame:
    """(row_no, line): the header at 0, then each row padded to the width."""
    padded = F.transform(F.sequence(F.lit(0), F.greatest(F.size("cells"), F.lit(len(names))) - 1), lambda i: flat(F.coalesce(F.get("cells", i), F.lit(""))))
    top = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("row_no"), flat(F.lit("\0".join(names))).alias("line"))
    top = top.withColumn("line", F.replace("line", F.lit("\0"), F.lit("\t")))
    return top.unionByName(rows.select(F.col("row_no").cast("long").alias("row_no"), F.array_join(padded, "\t").alias("line")))


def write_tsv(rows: DataFrame, names: list[str], path: str) -> None:
    """Rows in order as text files with CRLF ends."""
    tsv_lines(rows, names).orderBy("row_no").select("line").write.option("lineSep", "\r\n").text(path)


def text_width(text: Column, font: float) -> Column:
    """Display width: characters above U+00FF are twice as wide as others."""
    wide_ones = F.length(F.regexp_replace(text, r"[\x00-\xff]", ""))
    return (F.length(text) - wide_ones) * NARROW * font + wide_ones * WIDE * font


def column_profile(rows: DataFrame, step: int = 1, font: float = 13) -> DataFrame:
    """(col, width): the width that a column needs for its header and every ``step``-th row."""
    head = F.col("row_no") == 1
    sampled = rows.where(head | ((F.col("row_no") - 2) % step == 0)).select(head.alias("head"), F.posexplode("cells").alias("col", "value"))
    size = text_width(F.when(F.col("head"), F.col("value")).otherwise(visible_marks(F.col("value"))), 1.0) * F.when(F.col("head"), font - 1).otherwise(font)
    fitted = F.greatest(F.lit(MIN_WIDTH), F.least(F.lit(MAX_WIDTH), F.round(F.max(size)) + PADDING))
    return sampled.groupBy("col").agg(fitted.cast("int").alias("width"))


def preview(rows: DataFrame, max_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(rows up to the cap, one row with truncated): truncated only if a row was really left out."""
    return rows.where(F.col("row_no") <= max_rows), rows.agg((F.coalesce(F.max("row_no"), F.lit(0)) > max_rows).alias("truncated"))


def keyed_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str], digits: int = 4) -> DataFrame:
    """(key, field, left_value, right_value, status) for every field that differs; numbers are compared
    rounded. Keys of one side only give one row with status left_only or right_only; a null key is a key like
    any other."""
    kinds = dict(left.dtypes)
    shown = lambda side, f: (F.round(F.col(f"{side}.{f}"), digits) if kinds[f] in ("float", "double") else F.col(f"{side}.{f}")).cast("string")
    sides = [df.withColumn("_here", F.lit(True)).alias(a) for df, a in ((left, "l"), (right, "r"))]
    both = sides[0].join(sides[1], F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")), "full_outer")
    status = F.when(F.col("r._here").isNull(), "left_only").when(F.col("l._here").isNull(), "right_only").otherwise("changed")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), shown("l", f).alias("left_value"), shown("r", f).alias("right_value")) for f in fields])
    none = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    changed = F.filter(cells, lambda c: ~c["left_value"].eqNullSafe(c["right_value"]))
    rows = both.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), status.alias("status"), F.when(status == "changed", changed).otherwise(none).alias("x"))
    return rows.select(key, "status", F.inline("x"))


def diff_totals(diff: DataFrame, compared: DataFrame) -> DataFrame:
    """(rows, differing_rows, differences) of a diff and the keys that were compared."""
    n = compared.agg(F.count(F.lit(1)).alias("rows"))
    d = diff.agg(F.count_distinct(F.struct(diff.columns[0])).alias("differing_rows"), F.count(F.lit(1)).alias("differences"))
    return n.join(F.broadcast(d))  # one row each
