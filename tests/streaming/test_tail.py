import hashlib
import json
import os
import random

import pytest

from linework.streaming import tail


@pytest.fixture
def follow(spark, tmp_path):
    """A function that polls once, as a new run of the stream, and returns the view."""
    spark.dataSource.register(tail.TailLines)
    (tmp_path / "logs").mkdir()
    view = tail.LineView(spark, str(tmp_path / "view"))

    def poll(**options):
        stream = spark.readStream.format("tail_lines").option("path", str(tmp_path / "logs" / "*.log")).options(**options).load()
        query = stream.writeStream.foreachBatch(view.append).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((os.path.basename(r.path), r.generation, r.file_line, r.text) for r in view.lines().collect())

    poll.dir, poll.view = tmp_path / "logs", view
    return poll


def test_appends_rewrites_truncation_rotation(follow):
    log = follow.dir / "a.log"
    log.write_bytes("﻿one\r\n".encode() + b"\xe4\xb8")
    assert follow() == [("a.log", 0, 1, "one")]
    with log.open("ab") as f:
        f.write(b"\xad par")
    assert follow() == [("a.log", 0, 1, "one")]
    with log.open("ab") as f:
        f.write(b"tial\nthree\n")
    (follow.dir / "b.log").write_text("x\n\n")
    want = [("a.log", 0, 1, "one"), ("a.log", 0, 2, "中 partial"), ("a.log", 0, 3, "three"), ("b.log", 0, 1, "x"), ("b.log", 0, 2, "")]
    assert follow() == want
    log.write_text("NEW-1\nNEW-2\nmuch longer than it was before\n")  # rewritten, larger
    assert follow()[:3] == [("a.log", 1, 1, "NEW-1"), ("a.log", 1, 2, "NEW-2"), ("a.log", 1, 3, "much longer than it was before")]
    with log.open("a") as f:
        f.write("6\n")
    assert follow()[3] == ("a.log", 1, 4, "6")
    log.write_text("s\n")  # truncated
    assert follow()[0] == ("a.log", 2, 1, "s")
    other = follow.dir / "new"
    other.write_text("s\nrotated\n")
    os.replace(other, log)
    assert follow()[:2] == [("a.log", 3, 1, "s"), ("a.log", 3, 2, "rotated")]


def test_pieces_skip_existing_and_retention(follow, monkeypatch):
    monkeypatch.setattr(tail, "SPLIT", 7)
    log = follow.dir / "a.log"
    log.write_text("".join(f"line-{i:03d}\n" for i in range(50)))
    reader = tail.TailReader(str(log), "utf-8", False)
    pieces = reader.partitions({"files": "{}"}, reader.latestOffset())
    assert len(pieces) > 50 and [r[3] for p in pieces for r in reader.read(p)] == [f"line-{i:03d}" for i in range(50)]
    assert follow(skip_existing="true") == []
    with log.open("a") as f:
        f.write("late\n")
    assert [x[3] for x in follow(skip_existing="true")] == ["late"]
    with log.open("a") as f:
        f.write("".join(f"{i}\n" for i in range(30)))
    follow(skip_existing="true")
    assert follow.view.lines(20, 18).count() == 18 and follow.view.lines(40, 18).count() == 31


@pytest.mark.parametrize("codec, mark", [("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff")])
@pytest.mark.parametrize("split, step", [(1 << 20, 1 << 16), (6, 3)])
def test_utf16_in_odd_pieces(tmp_path, monkeypatch, codec, mark, split, step):
    """Two writers that stop within characters and line ends; every line comes once, whole."""
    monkeypatch.setattr(tail, "SPLIT", split)
    monkeypatch.setattr(tail, "STEP", step)
    rng = random.Random(split)
    want = {n: [f"{n}{i} 行ਊ਀\u0a00\u000dy{'x' * rng.randrange(9)}" for i in range(40)] for n in "ab"}
    data = {n: mark + "".join(t + rng.choice(["\n", "\r\n"]) for t in texts).encode(codec) for n, texts in want.items()}
    reader, offset, got = tail.TailReader(str(tmp_path / "*.log"), "auto", False), {"files": "{}"}, {n: [] for n in want}
    while any(data.values()):
        for n in want:
            cut = rng.randrange(1, 90)
            with open(tmp_path / f"{n}.log", "ab") as f:
                f.write(data[n][:cut])
            data[n] = data[n][cut:]
        new = reader.latestOffset()
        for piece in reader.partitions(offset, new):
            got[os.path.basename(piece.path)[0]] += [(r[3], r[4]) for r in reader.read(piece)]
        offset = json.loads(json.dumps(new))
    assert got == {n: [(t, "line") for t in texts] for n, texts in want.items()}


def test_a_look_is_checked_by_a_second_one(tmp_path, monkeypatch):
    """A writer that comes between the two looks: appending, then rewriting, then at every look."""
    log, real = tmp_path / "a.log", tail.last_line_end
    log.write_text("one\ntwo")
    writes = [lambda: log.write_text("one\ntwo\nthree\n")]

    def meanwhile(*args):
        found = real(*args)
        if writes:
            writes.pop(0)()
        return found

    monkeypatch.setattr(tail, "last_line_end", meanwhile)
    state = tail.advance(None, str(log))
    assert state["byte"] == 14 and not writes
    writes.append(lambda: log.write_text("Z\n"))  # shorter: a new generation
    state = tail.advance(state, str(log))
    assert (state["generation"], state["byte"]) == (1, 2)
    writes.extend([lambda i=i: log.write_text("Z\n" * (i + 2) + "half") for i in range(5)])
    state = tail.advance(state, str(log))
    assert len(writes) == 2 and state["byte"] == 6  # what the third look read
    writes.clear()
    assert tail.advance(state, str(log))["byte"] == 8


def test_touching_a_file_reads_it_and_emits_nothing(spark, tmp_path):
    spark.dataSource.register(tail.FileStats)
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in/a.md", tmp_path / "in/b.md"
    a.write_text("one")
    b.write_bytes("中文".encode("gb18030"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def poll():
        stats = spark.readStream.format("file_stats").option("path", str(tmp_path / "in/*.md")).load()
        read, found = [], []
        writer = stats.writeStream.foreachBatch(lambda d, _: read.extend(os.path.basename(r.path) for r in d.collect()))
        writer.option("checkpointLocation", str(tmp_path / "seen")).trigger(availableNow=True).start().awaitTermination()
        changed = tail.changed_documents(tail.read_changed(stats))
        writer = changed.writeStream.foreachBatch(lambda d, _: found.extend((os.path.basename(r.path), r.hash) for r in d.collect()))
        writer.option("checkpointLocation", str(tmp_path / "changes")).trigger(availableNow=True).start().awaitTermination()
        return sorted(read), sorted(found)

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    try:
        assert poll() == (["a.md", "b.md"], [("a.md", digest("one")), ("b.md", digest("中文"))])
        assert poll() == ([], [])
        os.utime(a, (1, 1))
        assert poll() == (["a.md"], [])
        a.write_text("two")
        assert poll() == (["a.md"], [("a.md", digest("two"))])
        b.unlink()
        assert poll() == ([], [])
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_latest_words_win_and_compaction(spark, tmp_path):
    view = tail.LineView(spark, str(tmp_path / "view"))
    schema = "path string, generation int, file_line long, byte_offset long, text string"
    put = lambda i, rows: view.put(spark.createDataFrame([(p, g, n, 0, t) for p, g, n, t in rows], schema), i)
    shown = lambda *a: sorted((r.path, r.generation, r.file_line, r.text) for r in view.lines(*a).collect())
    put(0, [("a", 0, n, f"old{n}") for n in range(1, 6)] + [("b", 0, 1, "gone")])
    put(1, [("a", 0, n, f"new{n}") for n in range(4, 8)] + [("b", 1, 1, "kept")])
    want = [("a", 0, n, f"{'old' if n < 4 else 'new'}{n}") for n in range(1, 8)] + [("b", 1, 1, "kept")]
    assert shown() == want
    reader = view.lines()
    view.compact()
    assert shown() == want and reader.count() == 8
    put(1, [("a", 0, 1, "replayed")])  # what the segment holds stays
    assert shown() == want
    batch = spark.createDataFrame([("a", 0, 99, "next", "line"), ("b", 1, 9, "more", "line")], tail.SCHEMA)
    view.append(batch, 2)
    view.append(batch, 2)
    want = want[:7] + [("a", 0, 8, "next"), ("b", 1, 1, "kept"), ("b", 1, 2, "more")]
    assert shown() == want
    late = view.lines()
    view.compact(6, 3)
    assert shown() == want[5:] and late.count() == 10
    assert not (tmp_path / "view/batch=0").exists() and (tmp_path / "view/batch=2").exists()
    view.append(batch, 3)
    view.compact(6, 3)
    assert [x[2:] for x in shown() if x[0] == "a"] == [(7, "new7"), (8, "next"), (9, "next")]
    view.compact()
    assert [x[2] for x in shown()] == [7, 8, 9, 1, 2, 3]


def test_totals_and_changed_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write = lambda i, rows: spark.createDataFrame(rows, "path string, generation int, event string, text string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    write(0, [("a", 0, "line", "xy"), ("a", 0, "reset", None), ("b", 0, "line", "")])
    write(1, [("a", 0, "line", "xy"), ("b", 1, "line", "z")])
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = lambda: spark.readStream.schema("path string, generation int, event string, text string").parquet(str(tmp_path / "in/*"))
        for name, df, mode in (("totals", tail.running_totals(stream()), "complete"), ("changes", tail.changed_documents(stream().where("event = 'line'")), "append")):
            df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert sorted(map(tuple, spark.table("totals").collect())) == [("a", 0, 2, 6), ("b", 0, 1, 1), ("b", 1, 1, 2)]
    assert spark.table("changes").groupBy("path").count().orderBy("path").collect()[0][:] == ("a", 1)
