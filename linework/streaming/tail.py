"""Follow growing files as a stream of lines, with truncation, rewriting and rotation.

The source keeps, per file, a generation, its encoding, the byte up to which lines are out and a hash of the file's
first KILOBYTE. A poll ends at the last whole line end, so half lines and half characters are never
read; in UTF-16 a line end stands at an even place. A file that got shorter, or whose beginning changed, or that was replaced, starts a new
generation from byte 0. A look at a file is checked by a second one and repeated if the file changed in between. Line numbers are given per
batch by the sink, which knows how many lines each (path, generation) has.

Files lie where driver and executors can open them by path.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from glob import glob

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from linework.plans.numbering import numbered
from linework.sources.encodings import CAP, SAMPLE, detect_bytes
from linework.sources.files import LineEnds, line_text, lines_from, open_file, read_at

SIGNATURE = 1024
#: Bytes of a file that one task reads; even.
SPLIT = 32 << 20
STEP = 1 << 16
#: Looks at a file that keeps changing (fixed value).
LOOKS = 3
SCHEMA = "path string, generation int, byte_offset long, text string, event string"


def signature(path: str, size: int) -> str:
    """Hash of the first bytes, as many as the smaller of SIGNATURE and size."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read(min(SIGNATURE, size))).hexdigest()


def last_line_end(path: str, start: int, size: int, ends: LineEnds) -> int:
    """The place after the last line end in [start, size), else start. ``start`` follows a line end or is 0."""
    with open_file(path) as f:
        at = size
        while at > start:
            low = max(start, at - STEP)
            found = ends.behind(read_at(f, low, min(at + ends.width - 1, size) - low), low)
            if len(found):
                return int(found[-1])
            at = low
    return start


def _look(seen: dict | None, path: str, encoding: str) -> tuple[dict, os.stat_result]:
    stat = os.stat(path)
    size = stat.st_size
    if seen is None:
        state = {"generation": 0, "byte": 0, "start": 0, "encoding": None}
    else:
        changed = size < seen["byte"] or stat.st_ino != seen["inode"] or signature(path, min(size, seen["signed"])) != seen["signature"]
        at = 0 if changed else seen["byte"]
        state = {"generation": seen["generation"] + changed, "byte": at, "start": at, "encoding": None if changed else seen["encoding"]}
    if state["encoding"] is None and size:
        with open_file(path) as f:
            state["encoding"] = detect_bytes(read_at(f, 0, SAMPLE)) if encoding == "auto" else encoding
    if size:
        state["byte"] = last_line_end(path, state["start"], size, LineEnds(state["encoding"]))
    if not state["byte"]:
        state["encoding"] = None  # no line is out, so more bytes may still tell
    state["signed"] = min(SIGNATURE, state["byte"])
    state["signature"] = signature(path, state["signed"])
    state["inode"] = stat.st_ino
    return state, stat


def advance(seen: dict | None, path: str, encoding: str = "utf-8") -> dict:
    """The state of a file after a look at it; seen is its state before. If size, time or file are others after the look,
    it is taken again, LOOKS times at most; the place is always one that was read."""
    for _ in range(LOOKS):
        state, stat = _look(seen, path, encoding)
        now = os.stat(path)
        if (now.st_size, now.st_mtime_ns, now.st_ino) == (stat.st_size, stat.st_mtime_ns, stat.st_ino):
            break
    return state


class Piece(InputPartition):
    def __init__(self, path: str, generation: int, encoding: str, start: int, end: int, reset: bool, file_start: int):
        self.path, self.generation, self.encoding = path, generation, encoding
        self.start, self.end, self.reset, self.file_start = start, end, reset, file_start


class TailReader(DataSourceStreamReader):
    def __init__(self, pattern: str, encoding: str, skip_existing: bool):
        self.pattern, self.encoding, self.skip_existing = pattern, encoding, skip_existing
        self.now: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        if not self.skip_existing:
            return {"files": "{}"}
        return {"files": json.dumps({p: advance(None, p, self.encoding) for p in sorted(glob(self.pattern))})}

    def latestOffset(self) -> dict:
        for path in sorted(glob(self.pattern)):
            try:
                self.now[path] = advance(self.now.get(path), path, self.encoding)
            except FileNotFoundError:
                continue
        return {"files": json.dumps(self.now)}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.now = self.now or old  # after a restart Spark first asks for the empty range at the last offset
        pieces = []
        for path, state in new.items():
            before = old.get(path)
            same = before is not None and before["generation"] == state["generation"]
            first = before["byte"] if same else 0
            reset = before is not None and not same
            for low in range(first, max(state["byte"], first + reset), SPLIT):
                pieces.append(Piece(path, state["generation"], state["encoding"], low, min(low + SPLIT, state["byte"]), reset and low == first, first))
        return pieces

    def commit(self, end: dict) -> None:
        """Files are kept."""

    def read(self, piece: Piece) -> Iterator[tuple]:
        """Lines that start in the piece; the last one is read to its end."""
        if piece.reset:
            yield piece.path, piece.generation, 0, None, "reset"
        if piece.start >= piece.end:
            return
        ends = LineEnds(piece.encoding)
        try:
            with open_file(piece.path) as f:
                at = piece.start
                if at > piece.file_start:  # the line that is under way belongs to the piece before
                    for _, line, ended, _ in lines_from(f, at - ends.width, 1, ends):
                        at += len(line) if ended else piece.end
                for place, line, ended, _ in lines_from(f, at, 1 << 62, ends) if at < piece.end else ():
                    if place >= piece.end:
                        return
                    if not ended:
                        yield piece.path, piece.generation, place, None, "lost"
                        return
                    yield piece.path, piece.generation, place, line_text(line, place, piece.encoding).removesuffix("\r"), "line"
                    at = place + len(line) + ends.width
                if at < piece.end:
                    yield piece.path, piece.generation, at, None, "lost"
        except FileNotFoundError:
            yield piece.path, piece.generation, piece.start, None, "lost"


class TailLines(DataSource):
    """format("tail_lines"), options path (a glob), encoding (an id, or auto: found from each file's head) and skip_existing."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"], self.options.get("encoding", "utf-8"), self.options.get("skip_existing", "false").lower() == "true")


class Stats(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class StatReader(DataSourceStreamReader):
    """(path, mtime_ms, size) of files whose time or size is another than at the last offset."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = {}
        for path in sorted(glob(self.pattern)):
            try:
                stat = os.stat(path)
            except FileNotFoundError:
                continue
            found[path] = [stat.st_mtime_ns // 1_000_000, stat.st_size]
        return {"files": json.dumps(found)}

    def partitions(self, start: dict, end: dict) -> list[Stats]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        rows = [(p, *x) for p, x in new.items() if old.get(p) != x]
        return [Stats(rows[i : i + 64]) for i in range(0, len(rows), 64)]

    def commit(self, end: dict) -> None:
        """Nothing is held."""

    def read(self, part: Stats) -> Iterator[tuple]:
        yield from part.rows


class FileStats(DataSource):
    """format("file_stats"), option path (a glob): the feed that says which files to read again."""

    @classmethod
    def name(cls) -> str:
        return "file_stats"

    def schema(self) -> str:
        return "path string, mtime_ms long, size long"

    def streamReader(self, schema) -> StatReader:
        return StatReader(self.options["path"])


def read_changed(stats: DataFrame, encoding: str = "auto", cap: int = CAP) -> DataFrame:
    """(path, mtime_ms, size, text) of a feed of file stats: the first ``cap`` bytes of each file that it names, and of no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    with open_file(r["path"]) as f:
                        head = read_at(f, 0, cap)
                except FileNotFoundError:
                    continue
                text = line_text(head, 0, detect_bytes(head) if encoding == "auto" else encoding)
                yield pa.RecordBatch.from_pydict({"path": [r["path"]], "mtime_ms": [r["mtime_ms"]], "size": [r["size"]], "text": [text]})

    return stats.select("path", "mtime_ms", "size").mapInArrow(run, "path string, mtime_ms long, size long, text string")


def numbered_batch(batch: DataFrame, counts: DataFrame) -> DataFrame:
    """A batch's lines with file_line; counts has (path, generation, lines) of what came before. A file's
    lines are numbered in many tasks."""
    lines = numbered(batch.where("event = 'line'").select("path", "generation", "byte_offset", "text"), ["path", "generation"], ["byte_offset"], "n")
    lines = lines.join(counts, ["path", "generation"], "left")
    return lines.select("path", "generation", (F.coalesce("lines", F.lit(0)) + F.col("n")).alias("file_line"), "byte_offset", "text")


class LineView:
    """A table of followed lines: appended per batch, replaced on a reset, cut to the newest lines.

    Each batch is one partition, written again if the batch is replayed, so a batch counts once; of lines that two batches have, those
    of the later one count. Beside the lines lies a row per file and batch with its first and last number, so that a batch doesn't read the
    lines before it. Older generations are left out on reading, until compact() rewrites what is shown as one segment.

    What a reader sees is named by the newest file in ``{path}-state``: a segment and the batches it holds. It is written
    aside and renamed, so a reader sees the old state or the new one; folders of the state before stay until the next
    compaction, for readers that began with it. (On a store whose rename is no single step, it must be made one.)
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.columns = "path string, generation int, file_line long, byte_offset long, text string"
        self.ranges = "path string, generation int, first long, lines long"
        self.counts = f"{path}-counts"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _states(self) -> list[dict]:
        """The published states, oldest first; the first one has no segment."""
        fs, at = self._fs(f"{self.path}-state")
        names = sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []
        states = [{"upto": -1, "segment": None, "version": 0}]
        for name in (n for n in names if n.endswith(".json")):
            stream = fs.open(self._fs(f"{self.path}-state/{name}")[1])
            states.append(json.loads(bytes(stream.readAllBytes()).decode()))
            stream.close()
        return states

    def _publish(self, state: dict) -> None:
        fs, aside = self._fs(f"{self.path}-state/_{state['version']:08d}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(aside, self._fs(f"{self.path}-state/{state['version']:08d}.json")[1]):
            raise RuntimeError("another compaction has come first")

    def _read(self, path: str, columns: str, state: dict) -> DataFrame:
        """A segment's rows, as of batch ``upto``, and the batches after it."""
        try:
            late = self.spark.read.schema(columns + ", batch long").parquet(path).where(F.col("batch") > state["upto"])
        except Exception as problem:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            late = self.spark.createDataFrame([], columns + ", batch long")
        if state["segment"] is None:
            return late
        early = self.spark.read.schema(columns).parquet(f"{path}-{state['segment']}")
        return early.withColumn("batch", F.lit(state["upto"]).cast("long")).unionByName(late)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch: the batch's lines get their numbers."""
        state = self._states()[-1]
        if batch_id <= state["upto"]:
            return  # a replay of what the segment holds
        before = self._read(self.counts, self.ranges, state).where(F.col("batch") < batch_id)
        counts = before.groupBy("path", "generation").agg(F.max("lines").alias("lines"))
        self.put(numbered_batch(batch, counts), batch_id)

    def put(self, lines: DataFrame, batch_id: int) -> None:
        """Lines that have their numbers; they may be such as another batch has, in newer words."""
        if batch_id <= self._states()[-1]["upto"]:
            return
        lines.select("path", "generation", "file_line", "byte_offset", "text").write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        written = self.spark.read.schema(self.columns).parquet(f"{self.path}/batch={batch_id}")
        numbers = written.groupBy("path", "generation").agg(F.min("file_line").alias("first"), F.max("file_line").alias("lines"))
        numbers.write.mode("overwrite").parquet(f"{self.counts}/batch={batch_id}")

    def lines(self, above: int | None = None, keep: int | None = None) -> DataFrame:
        """The lines of each file's newest generation; of a file with more than ``above`` lines the newest ``keep``."""
        return self._shown(self._states()[-1], above, keep)

    def _shown(self, state: dict, above: int | None, keep: int | None, upto: int = 1 << 62) -> DataFrame:
        counts = self._read(self.counts, self.ranges, state).where(F.col("batch") <= upto)
        every = self._read(self.path, self.columns, state).where(F.col("batch") <= upto)
        newest = counts.groupBy("path").agg(F.max("generation").alias("_g"), F.max(F.struct("generation", "lines"))["lines"].alias("_n"))
        earlier = Window.partitionBy("path", "generation").orderBy("first", "batch").rowsBetween(Window.unboundedPreceding, -1)
        overlap = counts.withColumn("_m", F.max("lines").over(earlier)).where(F.col("first") <= F.col("_m"))
        if not overlap.isEmpty():  # blocks that two batches have: the later batch's words
            rest = F.struct("batch", "byte_offset", "text")
            every = every.groupBy("path", "generation", "file_line").agg(F.max(rest).alias("x")).select("path", "generation", "file_line", "x.byte_offset", "x.text")
        shown = every.drop("batch").join(newest, "path").where("generation = _g")
        if above is not None:
            shown = shown.where(F.when(F.col("_n") > above, F.col("file_line") > F.col("_n") - keep).otherwise(True))
        return shown.drop("_g", "_n")

    def compact(self, above: int | None = None, keep: int | None = None) -> None:
        """Rewrite what lines() shows as one segment: older generations, older words and lines beyond retention go.
        Batches that come meanwhile stay batches."""
        states = self._states()
        state, fs = states[-1], self._fs(self.path)[0]
        counts = self._read(self.counts, self.ranges, state)
        upto = counts.agg(F.max("batch")).first()[0]
        if upto is None or upto <= state["upto"]:
            return
        new = {"version": state["version"] + 1, "upto": upto, "segment": f"segment-{state['version'] + 1:08d}"}
        self._shown(state, above, keep, upto).write.mode("overwrite").parquet(f"{self.path}-{new['segment']}")
        total = counts.where(F.col("batch") <= upto).groupBy("path", "generation").agg(F.min("first").alias("first"), F.max("lines").alias("lines"))
        total.write.mode("overwrite").parquet(f"{self.counts}-{new['segment']}")
        self._publish(new)
        # what the state before the last one needed
        for table in (self.path, self.counts):
            for old in states[1:-1]:
                fs.delete(self._fs(f"{table}-{old['segment']}")[1], True)
            at = self._fs(table)[1]
            for status in fs.listStatus(at) if fs.exists(at) else ():
                name = status.getPath().getName()
                if name.startswith("batch=") and int(name[6:]) <= state["upto"]:
                    fs.delete(status.getPath(), True)
        for old in states[1:-1]:
            fs.delete(self._fs(f"{self.path}-state/{old['version']:08d}.json")[1], False)


def running_totals(stream: DataFrame) -> DataFrame:
    """(path, generation, total_lines, bytes) of a stream of lines, for update or complete mode."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 1
    return stream.where("event = 'line'").groupBy("path", "generation").agg(F.count(F.lit(1)).alias("total_lines"), F.sum(size).alias("bytes"))


def changed_documents(stream: DataFrame, key: str = "path", text_col: str = "text") -> DataFrame:
    """(key, hash): a row when a document's text differs from the last one seen. Needs the RocksDB state store."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    import pandas as pd

    class LastHash(StatefulProcessor):
        def init(self, handle) -> None:
            self.last = handle.getValueState("last", "hash string")

        def handleInputRows(self, name, rows, timers):
            seen = self.last.get()[0] if self.last.exists() else None
            out = []
            for frame in rows:
                for text in frame[text_col]:
                    now = hashlib.sha256((text or "").encode()).hexdigest()
                    if now != seen:
                        out.append(now)
                        seen = now
            if out:
                self.last.update((seen,))
                yield pd.DataFrame({key: [name[0]] * len(out), "hash": out})

        def close(self) -> None:
            pass

    return stream.groupBy(key).transformWithStateInPandas(LastHash(), f"{key} string, hash string", "Append", "None")
