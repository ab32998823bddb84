"""Files read in tasks, by byte ranges that don't depend on the cluster: manifests, heads, numbered lines,
a sparse line index, ranges of lines by seeking, pages backwards.

A file is cut every SPLIT bytes of the size that its manifest has, so numbers of lines found in one pass hold in
another one, whatever the number of executors is by then. A line belongs to the range in which it begins; a range that has not
the lines it had when they were counted is an error, never a loss.

Files are opened by path through the local file system or the file systems that pyarrow knows (s3, gs, hdfs).
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from linework.plans.tables import materialise
from linework.sources.encodings import CAP, ENCODINGS, SAMPLE, decode_bytes, decoded, detected, encoding_id, with_encoding

#: Bytes of a range; even, so that UTF-16 units stay whole.
SPLIT = 32 << 20
#: Bytes of one read where it isn't known how many are needed.
STEP = 1 << 16
#: Tasks of a core, at least, that few rows are dealt to.
TURNS = 4
#: Rows of a batch that goes back to Spark.
BATCH = 1 << 15
#: Lines between two entries of the index (fixed value), and lines that one task reads of a wanted range.
EVERY, PIECE = 64, 64 << 8
_MARKS = {e[0]: bytes.fromhex(e[4]) for e in ENCODINGS}


class LineEnds:
    """The terminator of an encoding. One of two bytes counts only at an even place of the file."""

    def __init__(self, encoding: str):
        self.bytes = {"utf-16le": b"\n\0", "utf-16be": b"\0\n"}.get(encoding, b"\n")
        self.width = len(self.bytes)

    def behind(self, data: bytes, base: int) -> np.ndarray:
        """The places in the file that follow a terminator in ``data``, which begins at ``base``."""
        if self.width == 1:
            return np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + base + 1
        skip = base % 2
        pairs = np.frombuffer(data, np.uint8, (len(data) - skip) // 2 * 2, skip).reshape(-1, 2) if len(data) > skip + 1 else np.zeros((0, 2), np.uint8)
        return np.flatnonzero((pairs[:, 0] == self.bytes[0]) & (pairs[:, 1] == self.bytes[1])) * 2 + base + skip + 2


def open_file(path: str):
    """A seekable binary file; not buffered."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return open(path, "rb", buffering=0)
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(quote(path, safe="/:@?=&%+,"))
    return system.open_input_file(inner)


def write_file(path: str, data: bytes | memoryview) -> None:
    """Write a whole file, and its folder where there is none."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    local = "://" not in path
    system, inner = (LocalFileSystem(), path) if local else FileSystem.from_uri(quote(path, safe="/:@?=&%+,"))
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    with system.open_output_stream(inner) as file:
        file.write(data)


def read_at(file, place: int, n: int) -> bytes:
    """``n`` bytes, fewer only at the end of the file."""
    file.seek(place)
    parts = []
    while n and (part := file.read(n)):
        parts.append(part)
        n -= len(part)
    return b"".join(parts)


def lines_between(file, start: int, end: int, size: int, ends: LineEnds) -> tuple[np.ndarray, list[bytes], bool]:
    """(places, lines, ended): the lines that begin in [start, end) of a file of ``size`` bytes, terminators cut off,
    the last one read to its end; whether that has its terminator."""
    low = max(0, start - ends.width)
    data = read_at(file, low, end - low)
    behind = ends.behind(data, low)
    places = behind[(behind >= start) & (behind < end)]
    if start == 0 and size:
        places = np.concatenate([[0], places])
    if not len(places):
        return places, [], True
    stop, read = (behind[-1], True) if len(behind) and behind[-1] > places[-1] else (None, False)
    whole = bytearray(data)
    while stop is None and low + len(whole) < size:
        seen = max(0, len(whole) - ends.width + 1)
        whole += read_at(file, low + len(whole), min(STEP, size - low - len(whole)))
        after = ends.behind(bytes(whole[seen:]), low + seen)
        if len(after):
            stop = after[0]
        elif seen + ends.width > len(whole):
            break
    ended = stop is not None
    stop = low + len(whole) if stop is None else int(stop)
    cut = np.concatenate([places[1:], [stop]])
    view = bytes(whole)
    last = stop - ends.width if ended else stop
    if ends.width == 1:
        lines = view[int(places[0]) - low : last - low].split(b"\n")
    else:
        lines = [view[a - low : b - low - ends.width] for a, b in zip(places[:-1].tolist(), cut[:-1].tolist())] + [view[int(places[-1]) - low : last - low]]
    return places, lines, ended


def lines_from(file, place: int, n: int, ends: LineEnds) -> Iterator[tuple[int, bytes, bool, int]]:
    """(place, line, ended, bytes read so far) of up to ``n`` lines from a line's start; stops reading behind the last."""
    held, base, read = b"", place, 0
    while n:
        more = read_at(file, base + len(held), STEP)
        read += len(more)
        held += more
        at = base
        for behind in ends.behind(held, base)[:n].tolist():
            yield at, held[at - base : behind - base - ends.width], True, read
            at, n = behind, n - 1
        held, base = held[at - base :], at
        if n and len(more) < STEP:
            if held:
                yield base, held, False, read
            return


def lines_before(file, place: int, n: int, size: int, ends: LineEnds) -> tuple[list[tuple[int, bytes, bool]], int]:
    """Up to ``n`` lines that begin before ``place``, in order, and the bytes read. Bytes are read backwards until
    enough terminators are met; a line that ``place`` cuts is read to its end."""
    place = min(place, size)
    held, low, read = b"", place, 0
    starts = np.zeros(0, np.int64)
    while low > 0 and len(starts) <= n:
        step = min(low, STEP)
        step += (low - step) % ends.width if low - step else 0
        step = min(low, step)
        low -= step
        data = read_at(file, low, step)
        read += step
        held = data + held
        behind = ends.behind(held[: step + ends.width - 1], low)
        starts = np.concatenate([behind[behind < place], starts[starts > (behind[-1] if len(behind) else -1)]])
    if low == 0 and place > 0:
        starts = np.concatenate([[0], starts])
    starts = starts[-n:]
    if not len(starts):
        return [], read
    out = [(int(a), held[int(a) - low : int(b) - low - ends.width], True) for a, b in zip(starts[:-1], starts[1:])]
    for at, line, ended, more in lines_from(file, int(starts[-1]), 1, ends):
        out.append((at, line, ended))
        read += more
    return out, read


def line_text(raw: bytes, place: int, encoding: str) -> str:
    """A line decoded; at the file's start without the mark."""
    mark = _MARKS.get(encoding)
    if place == 0 and mark and raw.startswith(mark):
        raw = raw[len(mark) :]
    return decode_bytes(raw, encoding)


def _texts(raws: list[bytes], place: int, encoding: str) -> pa.Array:
    """Lines decoded, the first one beginning at ``place``."""
    if place == 0 and raws and raws[0].startswith(mark := _MARKS.get(encoding) or b"\0\0\0\0\0"):
        raws = [raws[0][len(mark) :], *raws[1:]]
    if encoding == "utf-8":
        try:
            return pa.array(raws, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            pass
    return pa.array([decode_bytes(r, encoding) for r in raws], pa.string())


def text_between(file, start: int, end: int, size: int, encoding: str) -> tuple[str, int]:
    """The lines that begin in [start, end), each with its LF where it has one, as one text, and their number."""
    places, raws, ended = lines_between(file, start, end, size, LineEnds(encoding))
    if not raws:
        return "", 0
    return "\n".join(_texts(raws, int(places[0]), encoding).to_pylist()) + "\n" * ended, len(places)


def without_cr(text: Column) -> Column:
    """Without the one CR that belongs to a line's end."""
    return F.when(F.endswith(text, F.lit("\r")), F.left(text, F.length(text) - 1)).otherwise(text)


def spread(rows: DataFrame, size: Column | str | None = None) -> DataFrame:
    """Few narrow rows that stand for reads of ``size`` bytes each (none: short ones), dealt to tasks: enough for all cores, more as
    the bytes are more, so many small files don't make as many tasks. ``rows`` is a written table."""
    size = F.lit(0) if size is None else F.col(size) if isinstance(size, str) else size
    n, total = rows.agg(F.count(F.lit(1)), F.sum(size + STEP)).first()
    tasks = max(TURNS * rows.sparkSession.sparkContext.defaultParallelism, (total or 0) // SPLIT)
    return rows.repartition(max(1, min(n, tasks, 100_000)))


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, size, mtime_ms) of files, listed by Spark and written once, so that all that follows is of one state.
    A pattern that nothing fits has no files; Spark does not list files of no bytes."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem) or not any(c in p for p in ([paths] if isinstance(paths, str) else paths) for c in "*?[{"):
            raise
        return spark.createDataFrame([], "path string, size long, mtime_ms long")
    return materialise(files.select("path", F.col("length").alias("size"), F.coalesce(F.unix_millis("modificationTime"), F.lit(0)).alias("mtime_ms")), "manifest")


def heads(files: DataFrame, cap: int = SAMPLE) -> DataFrame:
    """``files`` with content, the first ``cap`` bytes, read in tasks; no more bytes are read. A file that is gone
    by then has null."""
    schema = files.select("*", F.lit(b"").alias("content")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    with open_file(batch.column("path")[i].as_py()) as file:
                        content = read_at(file, 0, cap)
                except FileNotFoundError:
                    content = None
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], [*batch.schema.names, "content"])

    for f in schema.fields:
        f.nullable = True
    return spread(files, F.least(F.col("size"), F.lit(cap))).mapInArrow(run, schema)


def with_encodings(files: DataFrame, encoding: str = "auto") -> DataFrame:
    """``files`` with encoding, an id: the named one, or (``auto``, an unknown name) found per file from its head."""
    named = files.withColumn("encoding", encoding_id(F.lit(encoding)))
    known = files.sparkSession.range(1).select(encoding_id(F.lit(encoding))).first()[0]
    if known is not None:
        return named
    return materialise(heads(files).withColumn("encoding", detected(F.col("content"))["id"]).drop("content"), "encodings")


def read_documents(spark: SparkSession, paths: str | list[str], encoding: str = "auto", cap: int = CAP) -> DataFrame:
    """(path, text, bytes, truncated, encoding): the first ``cap`` bytes of each file, and no more of it, read in tasks."""
    text = decoded(with_encoding(heads(manifest(spark, paths), cap), encoding))
    return text.select("path", "text", F.col("size").alias("bytes"), (F.col("size") > cap).alias("truncated"), "encoding")


def stat_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, mtime_ms, size) without reading contents."""
    return manifest(spark, paths).select("path", "mtime_ms", "size")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with n, the lines that begin in them."""
    for batch in batches:
        for r in batch.to_pylist():
            ends = LineEnds(r["encoding"])
            with open_file(r["path"]) as file:
                low = max(0, r["start"] - ends.width)
                n = int(r["start"] == 0)
                for at in range(low, r["end"], 4 << 20):
                    stop = min(r["end"], at + (4 << 20))
                    before = at - ends.width + 1 if at > low else at  # a terminator over the border
                    data = read_at(file, before, stop - before)
                    behind = ends.behind(data, before)
                    n += int(((behind >= max(r["start"], 1)) & (behind > at) & (behind < r["end"])).sum()) if at > low else int(((behind >= max(r["start"], 1)) & (behind < r["end"])).sum())
            yield pa.RecordBatch.from_pydict({**{k: [r[k]] for k in ("path", "size", "encoding", "start", "end")}, "n": [n]})


def byte_ranges(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, size, encoding, start, end): the ranges of files (with encoding); written."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))
    ranges = files.where("size > 0").select("path", "size", "encoding", F.explode(starts).alias("start"))
    return materialise(ranges.withColumn("end", F.least("size", F.col("start") + split)), "ranges")


def line_splits(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, size, encoding, start, end, n, base): the ranges of files (with encoding), the lines that begin in each
    and those before it. One pass over the bytes; written."""
    ranges = byte_ranges(files, split)
    counted = spread(ranges, F.col("end") - F.col("start")).mapInArrow(_counted, "path string, size long, encoding string, start long, end long, n long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return materialise(counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "line-splits")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with open_file(r["path"]) as file:
                places, raws, ended = lines_between(file, r["start"], r["end"], r["size"], LineEnds(r["encoding"]))
            if len(places) != r["n"]:
                raise OSError(f"{r['path']} has changed: {len(places)} lines instead of {r['n']} begin in bytes {r['start']} to {r['end']}")
            for low in range(0, len(raws), BATCH):
                part = raws[low : low + BATCH]
                n = len(part)
                whole = np.ones(n, bool)
                whole[-1] = ended or low + n < len(raws)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["path"]]).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, r["start"])),
                        pa.array(np.arange(low, low + n) + r["base"] + 1), pa.array(places[low : low + n]), pa.array(whole), _texts(part, int(places[low]), r["encoding"]),
                    ],
                    ["path", "block", "file_line", "byte_offset", "ended", "raw"],
                )


def read_splits(splits: DataFrame) -> DataFrame:
    """(path, block, file_line, byte_offset, ended, raw) of line_splits(): every line with its number and place, its CR
    still there. No line moves."""
    return spread(splits, F.col("end") - F.col("start")).mapInArrow(_read, "path string, block long, file_line long, byte_offset long, ended boolean, raw string")


def line_index(splits: DataFrame, every: int = EVERY) -> DataFrame:
    """(path, size, encoding, file_line, byte_offset) of every ``every``-th line, from one pass over the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = LineEnds(r["encoding"])
                low = max(0, r["start"] - ends.width)
                with open_file(r["path"]) as file:
                    behind = ends.behind(read_at(file, low, r["end"] - low), low)
                places = behind[(behind >= max(1, r["start"])) & (behind < r["end"])]
                if r["start"] == 0:
                    places = np.concatenate([[0], places])
                if len(places) != r["n"]:
                    raise OSError(f"{r['path']} has changed")
                number = np.arange(len(places)) + r["base"] + 1
                kept = (number - 1) % every == 0
                n = int(kept.sum())
                if n:  # a batch of no rows would have columns of no type
                    yield pa.RecordBatch.from_pydict({"path": [r["path"]] * n, "size": [r["size"]] * n, "encoding": [r["encoding"]] * n, "file_line": number[kept], "byte_offset": places[kept]})

    return spread(splits, F.col("end") - F.col("start")).mapInArrow(run, "path string, size long, encoding string, file_line long, byte_offset long")


def write_index(index: DataFrame, path: str) -> None:
    """The index as a table whose files hold ranges of (path, file_line), so that a filter skips most of them."""
    index.repartitionByRange("path", "file_line").sortWithinPartitions("path", "file_line").write.mode("overwrite").parquet(path)


def read_ranges(wanted: DataFrame, index: DataFrame, every: int = EVERY) -> DataFrame:
    """(path, file_line, byte_offset, text, bytes_read) of the lines first..last of each row of ``wanted`` (path, first, last).

    The entry to begin at is an equal key of the index (no range join); its file is opened there and read until the
    last line, in pieces of PIECE lines. Lines beyond the end are left out. bytes_read counts a piece's bytes up to the line.
    """
    piece = lambda c: F.floor((c - 1) / PIECE)
    first = F.greatest(F.col("first"), F.lit(1)).cast("long")
    wanted = wanted.select("path", first.alias("first"), F.col("last").cast("long").alias("last")).where("first <= last")
    pieces = wanted.withColumn("k", F.explode(F.sequence(piece(F.col("first")), piece(F.col("last")))))
    pieces = pieces.select("path", F.greatest("first", F.col("k") * PIECE + 1).alias("first"), F.least("last", (F.col("k") + 1) * PIECE).alias("last"))
    pieces = pieces.withColumn("file_line", F.floor((F.col("first") - 1) / every) * every + 1)
    found = materialise(pieces.join(index, ["path", "file_line"]), "wanted-pieces")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                with open_file(r["path"]) as file:
                    n = r["last"] - r["file_line"] + 1
                    for k, (place, raw, _, read) in enumerate(lines_from(file, r["byte_offset"], n, LineEnds(r["encoding"])), r["file_line"]):
                        if k >= r["first"]:
                            rows.append((r["path"], k, place, line_text(raw, place, r["encoding"]), read))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "file_line", "byte_offset", "text", "bytes_read"])

    lines = spread(found).mapInArrow(run, "path string, file_line long, byte_offset long, text string, bytes_read long")
    return lines.withColumn("text", without_cr(F.col("text")))


def page_back(wanted: DataFrame, n: int) -> DataFrame:
    """(path, size, encoding, byte_offset, text, ended, has_more, bytes_read): up to ``n`` lines of each file that begin before the byte
    ``before`` (null: the end), without an index. ``wanted`` has path, size, encoding, before; the next page's ``before`` is the least
    byte_offset. A line that ``before`` cuts is whole."""
    wanted = materialise(wanted.select("path", "size", "encoding", F.coalesce("before", "size").cast("long").alias("before")), "wanted-pages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                with open_file(r["path"]) as file:
                    lines, read = lines_before(file, r["before"], n, r["size"], LineEnds(r["encoding"]))
                rows = [(r["path"], r["size"], r["encoding"], place, line_text(raw, place, r["encoding"]), ended, lines[0][0] > 0, read) for place, raw, ended in lines]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "size", "encoding", "byte_offset", "text", "ended", "has_more", "bytes_read"])

    schema = "path string, size long, encoding string, byte_offset long, text string, ended boolean, has_more boolean, bytes_read long"
    return spread(wanted).mapInArrow(run, schema).withColumn("text", without_cr(F.col("text")))


def number_page(page: DataFrame, splits: DataFrame, split: int = SPLIT) -> DataFrame:
    """A page with file_line: the lines before each file's first row are counted once, from the start of its range. Joins
    are merges: Spark reckons a page by its narrow input, a row a file, and would broadcast the texts of all files."""
    first = materialise(page.groupBy("path").agg(F.min("byte_offset").alias("at")).withColumn("start", F.floor(F.col("at") / split) * split), "page-starts")
    first = materialise(first.hint("merge").join(splits.select("path", "start", "base", "encoding"), ["path", "start"]), "page-bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends = LineEnds(r["encoding"])
                low = max(0, r["start"] - ends.width)
                with open_file(r["path"]) as file:
                    behind = ends.behind(read_at(file, low, r["at"] - low), low)
                n = int((behind >= max(1, r["start"])).sum()) + (r["start"] == 0)  # lines that begin up to ``at``
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "line": [r["base"] + n]})

    numbers = spread(first, F.col("at") - F.col("start")).mapInArrow(run, "path string, line long")
    order = Window.partitionBy("path").orderBy("byte_offset")  # a page
    return page.hint("merge").join(numbers, "path").withColumn("file_line", F.col("line") + F.row_number().over(order) - 1).drop("line")


class Wanted(InputPartition):
    def __init__(self, path: str, encoding: str, line: int, place: int, first: int, last: int):
        self.path, self.encoding, self.line, self.place, self.first, self.last = path, encoding, line, place, first, last


class IndexedReader(DataSourceReader):
    """Lines of indexed files; filters on path and file_line say which entries of the index are looked at."""

    def __init__(self, index: str):
        self.index, self.paths, self.first, self.last = index, None, 1, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") else None
            if name == "path" and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = values if self.paths is None else self.paths & values
            elif name == "file_line" and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Wanted]:
        import pyarrow.dataset as ds

        field = ds.field
        begin = (self.first - 1) // EVERY * EVERY + 1
        # of a long range one entry in PIECE lines, besides the first
        keep = (field("file_line") >= begin) & (field("file_line") <= self.last)
        if self.paths is not None:
            keep &= field("path").isin(list(self.paths))
        where = self.index.removeprefix("file://") if self.index.startswith("file:///") else "/" + self.index.removeprefix("file:").lstrip("/") if self.index.startswith("file:") else self.index
        out = []
        for batch in ds.dataset(where, format="parquet").to_batches(columns=["path", "encoding", "file_line", "byte_offset"], filter=keep):
            number = np.asarray(batch.column("file_line"))
            for r in batch.take(pa.array(np.flatnonzero((number == begin) | ((number - 1) % PIECE == 0)))).to_pylist():
                line = r["file_line"]
                first, last = max(self.first, line), min(self.last, (line - 1) // PIECE * PIECE + PIECE)
                out.append(Wanted(r["path"], r["encoding"], line, r["byte_offset"], first, last))
        return out

    def read(self, part: Wanted | None) -> Iterator[tuple]:
        if part is None:  # no entry is wanted
            return
        with open_file(part.path) as file:
            for k, (place, raw, _, read) in enumerate(lines_from(file, part.place, part.last - part.line + 1, LineEnds(part.encoding)), part.line):
                if k >= part.first:
                    text = line_text(raw, place, part.encoding)
                    yield part.path, k, place, text.removesuffix("\r"), read


class IndexedLines(DataSource):
    """format("indexed_lines"), option index: a table of write_index(). Filters are pushed down if
    spark.sql.python.filterPushdown.enabled is set; load anew for each query, as Spark 4.1 keeps the filters pushed last with a
    loaded source for a query without any."""

    @classmethod
    def name(cls) -> str:
        return "indexed_lines"

    def schema(self) -> str:
        return "path string, file_line long, byte_offset long, text string, bytes_read long"

    def reader(self, schema) -> IndexedReader:
        return IndexedReader(self.options["index"])
