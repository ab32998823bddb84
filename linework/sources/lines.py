"""Line sources over files: exact numbers and byte places, in parallel splits of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linework.sources.files import line_splits, manifest, read_splits, with_encodings, without_cr


def read_lines(spark: SparkSession, paths: str | list[str], encoding: str = "auto") -> DataFrame:
    """(path, file_line, text) of files: split at LF only, one CR before it dropped, a mark at the start dropped.

    With ``auto`` the encoding is found per file from its first bytes. Encodings that keep ASCII bytes split by bytes and decode
    afterwards; UTF-16 is split at its own line ends, which count only at even places. Two passes over the files as they are now, the
    first of which counts; a range that has other lines by the second is an error.
    """
    splits = line_splits(with_encodings(manifest(spark, paths), encoding))
    return read_splits(splits).select("path", "file_line", without_cr(F.col("raw")).alias("text"))


def route_files(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with kind: table of cells, binary table, document or lines, by extension."""
    ext = F.lower(F.regexp_extract(path_col, r"\.([^./\\]+)\z", 1))
    kind = F.when(ext == "bin", "config").when(ext.isin("csv", "tsv"), "table").when(ext.isin("md", "markdown"), "document").otherwise("lines")
    return files.withColumn("kind", kind)
