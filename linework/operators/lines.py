"""Lines of texts: splitting, numbering, addressing and windows.

A text is split at LF only; one CR before it belongs to the terminator, a lone CR is content. An empty
text has no lines and an unterminated last line counts. Lines are numbered from 1 within their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions.arrays import running

# Fixed values.
#: Lines between two entries of the sparse index.
SAMPLE_EVERY = 64
#: Lines of a block.
BLOCK = 10_000
#: Lines of the window around a jump's target, and how near its start must be to the end to reach it.
JUMP_LINES, JUMP_TO_END = 3000, 50_000
#: Retention: beyond the first number of lines the newest second number stay.
KEEP_ABOVE, KEEP = 200_000, 180_000


def raw_lines(text: Column) -> Column:
    """array of lines with their CR, without LF."""
    text = F.coalesce(text, F.lit(""))
    open_end = F.when(F.endswith(text, F.lit("\n")), F.left(text, F.length(text) - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(open_end, "\n", -1))


def without_cr(raw: Column) -> Column:
    """A line without the one CR that belongs to its end."""
    return F.when(F.endswith(raw, F.lit("\r")), F.left(raw, F.length(raw) - 1)).otherwise(raw)


def total_lines(text: Column) -> Column:
    """Number of lines, without splitting: terminators, and one more for an unterminated tail."""
    text = F.coalesce(text, F.lit(""))
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (ends + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("long")


def terminators(text: Column) -> Column:
    """Number of LF in a text."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def source_line_count(text: Column) -> Column:
    """Lines as an editor counts them: a trailing LF opens one more; an empty text has none."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(F.size(F.split(text, "\n", -1))).cast("long")


def strip_bom(text: Column) -> Column:
    """Without a byte order mark at the very start."""
    return F.when(F.startswith(text, F.lit("﻿")), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def explode_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, kept columns, file_line, text): one row per line, without a shuffle."""
    lines = df.select(id_col, *keep, F.posexplode(raw_lines(F.col(text_col))).alias("_pos", "_raw"))
    return lines.select(id_col, *keep, (F.col("_pos") + 1).cast("long").alias("file_line"), without_cr(F.col("_raw")).alias("text"))


def line_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, file_line, byte_offset, bytes, complete): place and size of every line, terminator included."""
    whole = F.endswith(F.col(text_col), F.lit("\n"))
    rows = df.select(id_col, whole.alias("_whole"), raw_lines(F.col(text_col)).alias("_lines"))
    complete = lambda i: F.col("_whole") | (i + 1 < F.size("_lines"))
    rows = rows.select(id_col, F.transform("_lines", lambda x, i: F.struct((F.octet_length(x) + complete(i).cast("int")).cast("long").alias("bytes"), complete(i).alias("complete"))).alias("_sizes"))
    places = F.arrays_zip(F.col("_sizes").alias("s"), running(F.transform("_sizes", lambda x: x["bytes"])).alias("o"))
    rows = rows.select(id_col, F.posexplode(places).alias("_pos", "_x"))
    return rows.select(id_col, (F.col("_pos") + 1).cast("long").alias("file_line"), F.col("_x.s.bytes").alias("bytes"), F.col("_x.s.complete").alias("complete"), F.col("_x.o").alias("byte_offset"))


def locate_line(places: DataFrame, line: int, id_col: str = "doc_id") -> DataFrame:
    """(id, byte_offset) where a line starts; null past the end."""
    return places.groupBy(id_col).agg(F.max(F.when(F.col("file_line") == line, F.col("byte_offset"))).alias("byte_offset"))


def lines_before_offset(places: DataFrame, offset: int, id_col: str = "doc_id") -> DataFrame:
    """(id, lines): complete lines that end at or before a byte offset."""
    ended = F.col("complete") & (F.col("byte_offset") + F.col("bytes") <= offset)
    return places.groupBy(id_col).agg(F.count_if(ended).alias("lines"))


def locate_range(places: DataFrame, first: int, last: int, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end) in bytes of the lines first..last; past the end both are the size."""
    size = F.max(F.col("byte_offset") + F.col("bytes"))
    start = F.min(F.when(F.col("file_line") >= first, F.col("byte_offset")))
    end = F.min(F.when(F.col("file_line") > last, F.col("byte_offset")))
    return places.groupBy(id_col).agg(F.coalesce(start, size).alias("start"), F.coalesce(end, size).alias("end"))


def sparse_index(places: DataFrame, every: int = SAMPLE_EVERY) -> DataFrame:
    """The start of every ``every``-th line."""
    return places.where((F.col("file_line") - 1) % every == 0).drop("bytes", "complete")


def avg_line_len(places: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Bytes by complete lines; null without any."""
    return places.groupBy(id_col).agg((F.sum("bytes") / F.nullif(F.count_if("complete"), F.lit(0))).alias("avg_len"))


def block_avg_lens(places: DataFrame, block: int = BLOCK, id_col: str = "doc_id", smooth: int | None = None) -> DataFrame:
    """(id, block, avg_len): mean bytes of a block's lines. ``smooth`` first spreads the bytes of each run
    of that many lines evenly over it."""
    if smooth:
        run = Window.partitionBy(id_col, F.floor((F.col("file_line") - 1) / smooth))
        places = places.withColumn("bytes", F.avg("bytes").over(run))
    return places.groupBy(id_col, F.floor((F.col("file_line") - 1) / block).alias("block")).agg(F.avg("bytes").alias("avg_len"))


def block_coverage(lines: DataFrame, totals: DataFrame, block: int = BLOCK, id_col: str = "doc_id") -> DataFrame:
    """(id, block, loaded, expected, is_complete): how much of each block of the text is at hand."""
    blocks = totals.where("total_lines > 0").select(id_col, "total_lines", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total_lines") - 1) / block))).alias("block"))
    expected = F.least(F.lit(block), F.col("total_lines") - F.col("block") * block).cast("long")
    loaded = lines.groupBy(id_col, F.floor((F.col("file_line") - 1) / block).alias("block")).agg(F.countDistinct("file_line").alias("loaded"))
    joined = blocks.join(loaded, [id_col, "block"], "left").withColumn("loaded", F.coalesce("loaded", F.lit(0)))
    return joined.select(id_col, "block", "loaded", expected.alias("expected"), (F.col("loaded") == expected).alias("is_complete"))


def get_range(lines: DataFrame, start: int, count: int) -> DataFrame:
    """``count`` lines from ``start`` (at least 1)."""
    start = max(1, start)
    return lines.where((F.col("file_line") >= start) & (F.col("file_line") < start + count))


def from_line(lines: DataFrame, line: int) -> DataFrame:
    """Lines from a line on."""
    return lines.where(F.col("file_line") >= max(1, line))


def with_totals(lines: DataFrame, totals: DataFrame | None, id_col: str = "doc_id") -> DataFrame:
    """``lines`` with total_lines: their own column if they have it (explode_lines can keep one, which
    needs no join), else joined from ``totals``."""
    return lines if "total_lines" in lines.columns else lines.join(totals.select(id_col, "total_lines"), id_col)


def jump_window(
    lines: DataFrame, target: int, keep: Column | None = None, totals: DataFrame | None = None, id_col: str = "doc_id", half: int = JUMP_LINES // 2, to_end: int = JUMP_TO_END
) -> DataFrame:
    """The lines around a target line (0: the last), those that pass ``keep``, with columns first_line,
    has_more, target_visible and target_index (0-based place of the first survivor at or after the target,
    else of the last). Texts that have no such line give nothing."""
    total = F.col("total_lines")
    at = F.lit(target).cast("long") if target else total
    first = F.greatest(at - half, F.lit(1))
    last = F.when(total - first + 1 <= to_end, total).otherwise(F.least(at - 1 + half, total))
    shown = with_totals(lines, totals, id_col).where((at <= total) & (F.col("file_line") >= first) & (F.col("file_line") <= last))
    shown = shown if keep is None else shown.where(keep)
    whole = Window.partitionBy(id_col)
    before = F.count_if(F.col("file_line") < at).over(whole)
    return (
        shown.withColumn("first_line", first)
        .withColumn("has_more", F.col("first_line") > 1)
        .withColumn("target_visible", F.max(F.col("file_line") == at).over(whole))
        .withColumn("target_index", F.least(before, F.count(F.lit(1)).over(whole) - 1))
        .drop("total_lines")
    )


def tail_lines(lines: DataFrame, n: int, totals: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """The last ``n`` lines of each text."""
    return with_totals(lines, totals, id_col).where(F.col("file_line") > F.col("total_lines") - n).drop("total_lines")


def tail_window(places: DataFrame, n: int, id_col: str = "doc_id") -> DataFrame:
    """Places of the lines that start within the last max(256 n, 8192) bytes of each text; a line that
    the window cuts is left out."""
    size = F.max(F.col("byte_offset") + F.col("bytes")).over(Window.partitionBy(id_col))
    return places.withColumn("_size", size).where(F.col("byte_offset") >= F.col("_size") - max(256 * n, 8192)).drop("_size")


def page_back(lines: DataFrame, before: int, n: int, id_col: str = "doc_id") -> DataFrame:
    """Up to ``n`` lines before a line, with has_more: there are still earlier ones."""
    first = max(1, before - n)
    return lines.where((F.col("file_line") < before) & (F.col("file_line") >= first)).withColumn("has_more", F.lit(first > 1))


def retain(lines: DataFrame, totals: DataFrame | None = None, above: int = KEEP_ABOVE, keep: int = KEEP, id_col: str = "doc_id") -> DataFrame:
    """Of a text with more than ``above`` lines the newest ``keep``."""
    cut = F.when(F.col("total_lines") > above, F.col("total_lines") - keep).otherwise(0)
    return with_totals(lines, totals, id_col).where(F.col("file_line") > cut).drop("total_lines")


def every_kth(rows: DataFrame, number: str, total: int, wanted: int = 2000) -> DataFrame:
    """A row in every ceil(total / wanted), by its 0-based ``number``."""
    return rows.where(F.col(number) % max(1, -(-total // wanted)) == 0)


def write_text(lines: DataFrame, order: list[str], path: str) -> None:
    """The text of lines, in order, as text files."""
    lines.orderBy(*order).select("text").write.text(path)


def newest_generation(lines: DataFrame, path_col: str = "path") -> DataFrame:
    """Of each path the lines of its last generation: what stays after a reset."""
    last = lines.groupBy(path_col).agg(F.max("generation").alias("_last"))
    return lines.join(last, path_col).where("generation = _last").drop("_last")


def append_batches(*batches: DataFrame, key: tuple[str, ...] = ("doc_id", "file_line")) -> DataFrame:
    """Batches as one table; of a line that two batches have, that of the later one counts (within a batch, the greatest)."""
    columns = batches[0].columns
    rest = [c for c in columns if c not in key]
    together = batches[0].withColumn("_batch", F.lit(0))
    for i, b in enumerate(batches[1:], 1):
        together = together.unionByName(b.withColumn("_batch", F.lit(i)))
    latest = together.groupBy(*key).agg(F.max(F.struct("_batch", *rest)).alias("_x"))
    return latest.select(*[c if c in key else F.col("_x")[c].alias(c) for c in columns])
