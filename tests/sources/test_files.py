import random

import pytest
from pyspark.sql import functions as F

from linework.plans.tables import materialise
from linework.sources import files, lines
from linework.sources.encodings import _CODECS, ENCODINGS

MARKS = {e[0]: bytes.fromhex(e[4]) for e in ENCODINGS}
SAMPLES = {"gb18030": "第一行", "gbk": "中文", "big5": "繁體", "shift_jis": "ログ", "euc-jp": "ログ", "euc-kr": "로그", "windows-1252": "é€", "windows-1251": "лог", "windows-1250": "ěš"}


def write(path, encoding, texts, end="\n", closed=True, mark=True):
    """A file of lines; the places at which they begin."""
    codec, data, places = _CODECS[encoding], (MARKS[encoding] if mark else b""), []
    for i, text in enumerate(texts):
        places.append(len(data) if i else 0)
        data += (text + (end if closed or i + 1 < len(texts) else "")).encode(codec)
    path.write_bytes(data)
    return places


def sample(encoding, n, seed=1):
    rng = random.Random(seed)
    word = SAMPLES.get(encoding, "行ਊ਀" if encoding.startswith("utf-16") else "é中")
    return [f"{i} " + word * rng.choice([0, 1, 3, 40]) for i in range(n)]


@pytest.mark.parametrize("encoding", [e[0] for e in ENCODINGS])
def test_paging_back_to_line_one(spark, tmp_path, monkeypatch, encoding):
    """No line is lost, repeated or shifted, whatever the pages and the reads."""
    texts = sample(encoding, 90)
    places = write(tmp_path / "a.log", encoding, texts, "\r\n", closed=False)
    for step in (2, 7, 1 << 16):
        monkeypatch.setattr(files, "STEP", step)
        ends, size = files.LineEnds(encoding), (tmp_path / "a.log").stat().st_size
        with files.open_file(str(tmp_path / "a.log")) as f:
            at, got = size, []
            while at > 0:
                page, _ = files.lines_before(f, at, 11, size, ends)
                got = [(p, files.line_text(raw, p, encoding).removesuffix("\r"), ended) for p, raw, ended in page] + got
                at = page[0][0]
            assert got == [(p, t, i < 89) for i, (p, t) in enumerate(zip(places, texts))]
            page, _ = files.lines_before(f, places[50] + ends.width, 3, size, ends)  # the cut line is whole
            assert [p for p, _, _ in page] == places[48:51]
            assert files.lines_before(f, 0, 3, size, ends)[0] == []


def test_page_back_reads_little_and_is_numbered_once(spark, tmp_path):
    texts = sample("utf-8", 60_000)
    places = write(tmp_path / "big.log", "utf-8", texts)
    found = files.with_encodings(files.manifest(spark, str(tmp_path)))
    splits = files.line_splits(found, split=100_000)
    page = files.page_back(found.withColumn("before", F.lit(None).cast("long")), 20)
    rows = files.number_page(page, splits, split=100_000).orderBy("file_line").collect()
    assert [(r.file_line, r.byte_offset, r.text) for r in rows] == list(zip(range(59_981, 60_001), places[-20:], texts[-20:]))
    assert rows[0].bytes_read < 3 * files.STEP and rows[0].has_more
    page = files.page_back(found.withColumn("before", F.lit(rows[0].byte_offset)), 20)
    assert [r.file_line for r in files.number_page(page, splits, split=100_000).orderBy("file_line").collect()] == list(range(59_961, 59_981))


def test_pages_of_many_files_are_not_broadcast(spark, tmp_path):
    """Spark takes a page for as small as its row of a file, whatever its texts are."""
    want = []
    for i in range(30):
        texts = [f"{i} {k} " + "x" * 2000 for k in range(i, 60)]
        places = write(tmp_path / f"{i}.log", "utf-8", texts, "\r\n")
        want += [(f"{i}.log", k, p, t, i < 35) for k, p, t in list(zip(range(1, 61 - i), places, texts))[-25:]]
    try:
        spark.conf.set("spark.sql.maxBroadcastTableSize", "1k")  # a larger broadcast is an error
        found = files.with_encodings(files.manifest(spark, str(tmp_path)))
        page = files.page_back(found.withColumn("before", F.lit(None).cast("long")), 25)
        rows = files.number_page(page, files.line_splits(found, split=10_000), split=10_000).collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    got = sorted((r.path.rsplit("/", 1)[1], r.file_line, r.byte_offset, r.text, r.has_more) for r in rows)
    assert got == sorted(want)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16le", "utf-16be", "gb18030"])
@pytest.mark.parametrize("split", [2, 38, 1000])
def test_lines_over_ranges(spark, tmp_path, encoding, split):
    want = {}
    for name, n, closed in (("a", 40, True), ("b", 41, False), ("one", 1, False), ("empty", 0, True)):
        texts = sample(encoding, n, seed=n) if split > 2 or n < 2 else ["", "x", "", "y\r"]
        places = write(tmp_path / f"{name}.log", encoding, texts, "\r\n", closed)
        want[name] = [(i, p, closed or i < len(texts), t + ("\r" if closed or i < len(texts) else "")) for i, (p, t) in enumerate(zip(places, texts), 1)]
    splits = files.line_splits(files.with_encodings(files.manifest(spark, str(tmp_path)), encoding), split)
    got = {n: [] for n in want}
    for r in files.read_splits(splits).orderBy("path", "file_line").collect():
        got[r.path.rsplit("/", 1)[1].removesuffix(".log")].append((r.file_line, r.byte_offset, r.ended, r.raw))
    want["empty"] = [(1, 0, False, "")] if MARKS[encoding] else []
    assert got == want
    index = files.line_index(splits, every=4).orderBy("path", "file_line").collect()
    assert [(r.file_line, r.byte_offset) for r in index if r.path.endswith("a.log")] == [x[:2] for x in want["a"] if x[0] % 4 == 1]


def test_numbers_hold_when_parallelism_changes(spark, tmp_path):
    """The splits of Spark's own reader change between two scans; ours don't."""
    (tmp_path / "a.log").write_bytes(b"".join(b"%07d\n" % i for i in range(200_000)))
    names = ["spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"]
    try:
        spark.conf.set(names[0], 2)
        spark.conf.set(names[1], 1)
        read = lines.read_lines(spark, str(tmp_path / "a.log"), "utf-8")
        wide = lines.read_lines(spark, str(tmp_path / "a.log"))
        spark.conf.set(names[0], 16)
        spark.conf.set(names[2], 10_000)
        for found in (read, wide):
            assert found.agg(F.count("*"), F.sum((F.col("text").cast("int") + 1 == F.col("file_line")).cast("int"))).first()[:] == (200_000, 200_000)
    finally:
        for name in names:
            spark.conf.unset(name)


def test_a_file_that_changes_is_an_error(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_bytes(b"a\nb\nc\n")
    read = lines.read_lines(spark, str(path), "utf-8")
    assert read.count() == 3
    path.write_bytes(b"a\nb\nc\nd\n")
    assert read.count() == 3  # what came later is not of this state
    path.write_bytes(b"a b\nc\n")
    with pytest.raises(Exception, match="has changed"):
        read.count()


def test_ranges_by_seeking(spark, tmp_path):
    want = {}
    for name, encoding, n in (("a", "utf-8", 30_000), ("b", "utf-16be", 5000), ("c", "gb18030", 70)):
        texts = sample(encoding, n)
        places = write(tmp_path / f"{name}.log", encoding, texts)
        want[name] = list(zip(range(1, n + 1), places, texts))
    index = str(tmp_path / "_index")
    splits = files.line_splits(files.with_encodings(files.manifest(spark, str(tmp_path))), 100_000)
    files.write_index(files.line_index(splits), index)
    table = spark.read.parquet(index)
    paths = {r.path.rsplit("/", 1)[1][0]: r.path for r in table.select("path").distinct().collect()}
    cases = [("a", 1, 3), ("a", 20_000, 20_010), ("a", 29_999, 40_000), ("a", 40_000, 50_000), ("b", 64, 65), ("b", 4000, 4100), ("c", -5, 200), ("c", 9, 8)]
    for name, first, last in cases:
        asked = spark.createDataFrame([(paths[name], first, last)], "path string, first int, last int")
        rows = files.read_ranges(asked, table).orderBy("file_line").collect()
        assert [(r.file_line, r.byte_offset, r.text) for r in rows] == [x for x in want[name] if first <= x[0] <= last]
        size = sum(len(x[2].encode()) for x in want[name] if first - 64 <= x[0] <= last) * 2
        assert max((r.bytes_read for r in rows), default=0) <= size + 2 * files.STEP
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(files.IndexedLines)
    source = spark.read.format("indexed_lines").option("index", index).load()
    for name, first, last in cases[1:6]:
        rows = source.where((F.col("path") == paths[name]) & F.col("file_line").between(first, last)).orderBy("file_line").collect()
        assert [(r.file_line, r.byte_offset, r.text) for r in rows] == [x for x in want[name] if first <= x[0] <= last]
        assert max((r.bytes_read for r in rows), default=0) <= 8 * files.STEP
    assert source.where("file_line > 69").where("length(text) > 0").groupBy("path").count().count() == 3
    assert spark.read.format("indexed_lines").option("index", index).load().count() == 35_070


def test_heads_in_tasks(spark, tmp_path):
    for i in range(1, 40):
        (tmp_path / f"{i}.md").write_bytes(b"x" * i * 1000)
    with open(tmp_path / "huge.md", "wb") as f:
        f.seek(10 << 30)  # 10 GB that nobody reads
        f.write(b"!")
    found = {r.path.rsplit("/", 1)[1]: (r.size, len(r.content)) for r in files.heads(files.manifest(spark, str(tmp_path)), 5000).collect()}
    assert found == {f"{i}.md": (i * 1000, min(i * 1000, 5000)) for i in range(1, 40)} | {"huge.md": ((10 << 30) + 1, 5000)}


def test_many_small_files_do_not_make_as_many_tasks(spark):
    few, some = files.TURNS * spark.sparkContext.defaultParallelism, materialise(spark.range(3000), "many")
    dealt = files.spread(some, F.lit(100))
    assert dealt.rdd.getNumPartitions() <= max(few, 3000 * (100 + files.STEP) // files.SPLIT) and dealt.count() == 3000
    assert files.spread(some, F.lit(files.SPLIT)).rdd.getNumPartitions() == 3000
    assert files.spread(some.where("id < 3")).rdd.getNumPartitions() == 3
