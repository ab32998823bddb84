"""Lenient delimited text, from a text column or from files.

A quote opens a quoted field only at a field's start; two quotes in one are a quote; what follows a
closing quote is taken literally; LF, CRLF and a lone CR end a record; a record that is one empty field
is dropped; rows may be ragged; an open quote runs to the end. All cells are strings.

``parse_delimited`` cuts each text of a column in one task; texts are independent. ``split_delimited``
reads one large file in many ranges: at the start of a line the rules are either outside or within
quotes, so the lines of a range are a map between two states, and ranges compose. (The idea is that of published
work on parallel CSV parsing, e.g. Ge et al., SIGMOD 2019.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linework.plans.tables import materialise
from linework.sources.encodings import decoded, with_encoding
from linework.sources.files import byte_ranges, heads, manifest, open_file, spread, text_between, with_encodings

#: Rows of a batch that goes back to Spark.
BATCH = 4096
#: Bytes of a range of a file; even, so that UTF-16 units stay whole. And of a read behind it, for a record that goes on.
RANGE, MORE = 4 << 20, 1 << 20
#: Rows and bytes (of decoded text, as UTF-8) of a preview.
MAX_ROWS, MAX_BYTES = 200_000, 32 << 20
#: Fixed names of delimiters.
DELIMITERS = {"tab": "\t", "\\t": "\t", "comma": ",", "semicolon": ";", "pipe": "|"}


def resolve_delimiter(choice: str | None = None, path: str = "") -> str:
    """The delimiter that a name or a character stands for, else by extension; quotes and line ends can't be one."""
    found = DELIMITERS.get((choice or "").strip().lower(), choice or "")
    if len(found) == 1 and found not in '"\r\n':
        return found
    return "\t" if path.lower().endswith(".tsv") else ","


def _ended(text: str, delimiter: str) -> Iterator[tuple[list[str], int, str]]:
    """The records of a text, the place behind each, and what ended it: a line end, or nothing at the text's end."""
    d = re.escape(delimiter)
    field = re.compile(rf'(?:"([^"]*+(?:""[^"]*+)*+)"?)?+([^{d}\r\n]*+)({d}|\r\n|\r|\n|\Z)')
    cells: list[str] = []
    at, more = 0, False
    while at < len(text) or more:
        found = field.match(text, at)
        quoted, rest, end = found.groups()
        cells.append(rest if quoted is None else quoted.replace('""', '"') + rest)
        at, more = found.end(), end == delimiter
        if not more:
            if cells != [""]:
                yield cells, at, end
            cells = []


def records(text: str, delimiter: str = ",") -> Iterator[list[str]]:
    """The records of a text."""
    for cells, _, _ in _ended(text, delimiter):
        yield cells


def capped_records(text: str, delimiter: str = ",", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[list[str]], bool]:
    """(rows, truncated): the first records of a text. Reading stops with the character that reaches ``max_bytes`` of UTF-8 or
    ends the last of ``max_rows``; the record in progress at a cap of bytes is dropped, and only what was really left over is truncation."""
    limit = len(text)
    if len(text) * 4 > max_bytes:
        data = text.encode("utf-8", "surrogatepass")
        if len(data) >= max_bytes:  # the character that reaches the cap is still read
            stop = max_bytes
            while stop < len(data) and data[stop] & 0xC0 == 0x80:
                stop += 1
            limit = len(data[:stop].decode("utf-8", "surrogatepass"))
    hit = limit < len(text) or len(text.encode("utf-8", "surrogatepass")) >= max_bytes
    rows = []
    for cells, at, end in _ended(text[:limit], delimiter):
        if end == "" and hit:
            break
        rows.append(cells)
        if len(rows) == max_rows:
            read = at - (end == "\r\n")  # the record ends with CR; LF is left over
            return rows, end != "" and read < len(text)
    return rows, limit < len(text)


def preview_delimited(df: DataFrame, keys: list[str], text_col: str = "text", delimiter: str = ",", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, more: str | None = None) -> DataFrame:
    """(keys, row_no, cells, truncated): the records of each text up to the caps; ``truncated`` on each row says whether text was left over,
    also such as a boolean column ``more`` says is behind it. A text of which no record is read has one row with null cells."""
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["row_no long", "cells array<string>", "truncated boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(len(keys))[i].as_py() or ""
                rows, cut = capped_records(text, delimiter, max_rows, max_bytes)
                cut = cut or bool(more and batch.column(len(keys) + 1)[i].as_py())
                for first in range(0, max(1, len(rows)), BATCH):
                    part = rows[first : first + BATCH] or [None]
                    own = [batch.column(k).take(pa.array([i] * len(part))) for k in range(len(keys))]
                    numbers = pa.array(range(first + 1, first + 1 + len(part)), pa.int64())
                    yield pa.RecordBatch.from_arrays([*own, numbers, pa.array(part, pa.list_(pa.string())), pa.array([cut] * len(part))], [*keys, "row_no", "cells", "truncated"])

    return df.select(*keys, text_col, *([more] if more else [])).mapInArrow(run, schema)


def preview_files(spark: SparkSession, paths: str | list[str], delimiter: str | None = None, encoding: str = "auto", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, row_no, cells, truncated) of the beginnings of files; of no file are more bytes read than the caps can need (no encoding
    takes more than two bytes for a byte of UTF-8)."""
    cap = 2 * max_bytes + 4
    found = with_encoding(heads(manifest(spark, paths), cap), encoding)
    text = decoded(found).select("path", "text", (F.col("size") > cap).alias("more"))
    return preview_delimited(text, ["path"], "text", resolve_delimiter(delimiter, paths if isinstance(paths, str) else paths[0]), max_rows, max_bytes, "more")


def parse_delimited(df: DataFrame, keys: list[str], text_col: str = "text", delimiter: str = ",", max_rows: int | None = None) -> DataFrame:
    """(keys, row_no, cells) of the text of each row; null is empty."""
    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + ["row_no long", "cells array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(source: pa.RecordBatch, i: int, first: int, rows: list[list[str]]) -> pa.RecordBatch:
            own = [source.column(k).take(pa.array([i] * len(rows))) for k in range(len(keys))]
            numbers = pa.array(range(first, first + len(rows)), pa.int64())
            return pa.RecordBatch.from_arrays([*own, numbers, pa.array(rows, pa.list_(pa.string()))], [*keys, "row_no", "cells"])

        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[list[str]] = []
                first = 1
                for n, cells in enumerate(records(batch.column(len(keys))[i].as_py() or "", delimiter), 1):
                    if max_rows and n > max_rows:
                        break
                    rows.append(cells)
                    if len(rows) == BATCH:
                        yield batch_of(batch, i, first, rows)
                        first, rows = first + BATCH, []
                if rows:
                    yield batch_of(batch, i, first, rows)

    return df.select(*keys, text_col).mapInArrow(run, schema)


def _closed(text: str, at: int) -> int:
    """The place of the quote that closes the field whose inside ``at`` is in, or -1."""
    while (at := text.find('"', at)) >= 0 and text.startswith('"', at + 1):
        at += 2
    return at


def _ends_within(text: str, within: bool, delimiter: str) -> bool:
    """Whether whole lines end within quotes, if they begin within or outside."""
    opening = re.compile(rf'[{re.escape(delimiter)}\r\n]"')
    if not within and not text.startswith('"'):
        found = opening.search(text)
    else:
        at = _closed(text, 0 if within else 1)
        if at < 0:
            return True
        found = opening.search(text, at + 1)
    while found:
        at = _closed(text, found.end())
        if at < 0:
            return True
        found = opening.search(text, at + 1)
    return False


def _first_outside(text: str, delimiter: str) -> int | None:
    """The place behind the first line end that is outside quotes, in a text that begins within."""
    end_or_opening = re.compile(rf'\n|{re.escape(delimiter)}"|\r"')
    at = _closed(text, 0)
    while at >= 0 and (found := end_or_opening.search(text, at + 1)):
        if found[0] == "\n":
            return found.end()
        at = _closed(text, found.end())
    return None


def _ranges(files: DataFrame, delimiter: str, size: int) -> DataFrame:
    """(path, size, encoding, start, end, n, begin, goes_on): ranges of files, the lines that begin in each, whether these begin and
    end within quotes. One pass over the bytes; written.

    A range whose map is constant sets the state, one that swaps flips it, the others keep it; so the state is
    that of the last constant range and the parity of the swaps since.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_file(r["path"]) as file:
                    text, n = text_between(file, r["start"], r["end"], r["size"], r["encoding"])
                yield pa.RecordBatch.from_pylist([r | {"n": n, "out": _ends_within(text, False, delimiter), "within": _ends_within(text, True, delimiter)}])

    schema = "path string, size long, encoding string, start long, end long, n long, out boolean, within boolean"
    ranges = byte_ranges(files, size)
    ranges = materialise(spread(ranges, F.col("end") - F.col("start")).mapInArrow(run, schema), "delimited-maps")
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    flipped = lambda state, n: state != (n % 2 == 1)  # noqa: E731  for odd n
    ranges = ranges.withColumn("_swaps", F.sum((F.col("out") & ~F.col("within")).cast("int")).over(order))
    ranges = ranges.withColumn("_set", F.when(F.col("out") == F.col("within"), F.struct(F.col("out").alias("v"), F.col("_swaps").alias("n"))))
    ranges = ranges.withColumns({"_last": F.last("_set", ignorenulls=True).over(before), "_n": F.coalesce(F.last("_swaps").over(before), F.lit(0))})
    begin = F.coalesce(flipped(F.col("_last.v"), F.col("_n") - F.col("_last.n")), flipped(F.lit(False), F.col("_n")))
    ranges = ranges.withColumn("begin", begin).withColumn("goes_on", F.when(F.col("begin"), F.col("within")).otherwise(F.col("out")))
    return materialise(ranges.select("path", "size", "encoding", "start", "end", "n", "begin", "goes_on"), "delimited-ranges")


def split_delimited(spark: SparkSession, paths: str | list[str], delimiter: str = ",", encoding: str = "auto", size: int = RANGE) -> DataFrame:
    """(path, row_no, cells) of files of any size, each read in many ranges of ``size`` bytes.

    No text goes between tasks: records are parsed by the task that reads the range in which the line begins that they begin in, and
    a record that goes on behind its range is read to its end. Numbers are the sums of the ranges before.
    """

    def text_of(r: dict) -> str:
        with open_file(r["path"]) as file:
            text, n = text_between(file, r["start"], r["end"], r["size"], r["encoding"])
            if n != r["n"]:
                raise OSError(f"{r['path']} has changed: {n} lines instead of {r['n']} begin in bytes {r['start']} to {r['end']}")
            if r["begin"]:
                at = _first_outside(text, delimiter)
                if at is None:
                    return ""
                text = text[at:]
            parts, at = [text], r["end"]
            while r["goes_on"] and at < r["size"]:
                more, _ = text_between(file, at, min(at + MORE, r["size"]), r["size"], r["encoding"])
                stop = _first_outside(more, delimiter)
                parts.append(more[:stop])
                if stop is not None:
                    break
                at += MORE
        return "".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found, first = records(text_of(r), delimiter), 1
                while rows := list(islice(found, BATCH)):
                    n = len(rows)
                    own = [pa.array([r[k]]).take(pa.array([0] * n)) for k in ("path", "start")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(range(first, first + n), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["path", "start", "own", "cells"])
                    first += n

    ranges = _ranges(with_encodings(manifest(spark, paths), encoding), delimiter, size)
    rows = materialise(spread(ranges, F.col("end") - F.col("start")).mapInArrow(run, "path string, start long, own long, cells array<string>"), "delimited-records")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("path", "start").agg(F.max("own").alias("n"))
    bases = materialise(bases.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "delimited-bases")
    return rows.join(bases, ["path", "start"]).select("path", (F.col("base") + F.col("own")).alias("row_no"), "cells")


def read_delimited(spark: SparkSession, paths: str | list[str], delimiter: str | None = None, encoding: str = "auto") -> DataFrame:
    """(path, row_no, cells) of files of any size; the encoding is found per file, the delimiter from the first path's extension."""
    return split_delimited(spark, paths, resolve_delimiter(delimiter, paths if isinstance(paths, str) else paths[0]), encoding)
