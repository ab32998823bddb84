import itertools

import pytest
from pyspark.sql import functions as F

from linework.sources import delimited, encodings, files, lines


@pytest.mark.parametrize("text, rows", [
    ("a,b\n1,2,3,4\n5\n", [["a", "b"], ["1", "2", "3", "4"], ["5"]]), ("a\rb\r\nc", [["a"], ["b"], ["c"]]), ("\n\na\n\n", [["a"]]),
    (",,", [["", "", ""]]), ('""\n"a""b",c\n', [['a"b', "c"]]), ('"x"y,z', [["xy", "z"]]), ('a"b,"c\nd', [['a"b', "c\nd"]]),
    ('"a\r\nb",1\r\n2', [["a\r\nb", "1"], ["2"]]), ("a,", [["a", ""]]), ("", []), ('"', []), ('"",', [["", ""]]), ('x,"', [["x", ""]]), ('"a"b"c",d', [['ab"c"', "d"]])])
def test_records(text, rows):
    assert list(delimited.records(text)) == rows


def test_parse_many_rows(spark, monkeypatch):
    df = spark.createDataFrame([("p", "a;b\n1;2\n" * 5000), ("q", None)], "path string, text string")
    got = delimited.parse_delimited(df, ["path"], "text", ";")
    assert got.agg(F.count("*"), F.max("row_no"), F.countDistinct("row_no")).first()[:] == (10000, 10000, 10000)
    assert delimited.parse_delimited(df, ["path"], "text", ";", max_rows=7).count() == 7
    assert [delimited.resolve_delimiter(*x) for x in (("tab",), ("\\t",), ('"', "a.tsv"), (None, "x.TSV"), ("||",), ("pipe",))] == ["\t", "\t", "\t", "\t", ",", "|"]


def test_detection_and_names(spark):
    cases = [(b"\xef\xbb\xbfa", "utf-8", "bom"), (b"\xff\xfea\0", "utf-16le", "bom"), (b"\xfe\xff\0a", "utf-16be", "bom"), (b"abc", "utf-8", "utf8"), (b"ab\xc3", "utf-8", "utf8"),
             (b"\xf0\x9f\x98", "utf-8", "utf8"), (b"ab\xc3(", "gb18030", "fallback"), (b"\xe0\x80", "gb18030", "fallback"), (b"\xff", "gb18030", "fallback"), (b"", "utf-8", "utf8")]
    df = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "i int, content binary")
    got = {r.i: (r.encoding.id, r.encoding.source) for r in encodings.with_encoding(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    manual = encodings.with_encoding(df, "UTF_16_LE").where("i in (0, 1)").orderBy("i").collect()
    assert [(r.encoding.id, r.encoding.source, r.encoding.bom) for r in manual] == [("utf-16le", "manual", False), ("utf-16le", "manual", True)]
    names = spark.createDataFrame([(x,) for x in (" CP936 ", "shift_jis", "utf_8", "Latin1", "nope", "")], "n string").select(encodings.encoding_id(F.col("n")))
    assert [r[0] for r in names.collect()] == ["gbk", "shift_jis", "utf-8", "windows-1252", None, None]


@pytest.mark.parametrize("name, text", [("gbk", "中文日志"), ("gb18030", "第一行"), ("big5", "繁體"), ("shift_jis", "ログ"), ("euc-jp", "ログ"), ("euc-kr", "로그"), ("windows-1252", "é€"), ("windows-1251", "лог"), ("windows-1250", "ěš")])
def test_encoded_files(spark, tmp_path, name, text):
    (tmp_path / "a.log").write_bytes(f"{text}\r\nx {text}".encode(encodings._CODECS[name]))
    rows = lines.read_lines(spark, str(tmp_path / "a.log"), name).orderBy("file_line").collect()
    assert [(r.file_line, r.text) for r in rows] == [(1, text), (2, f"x {text}")]


def test_lossy_decoding(spark):
    assert encodings.decode_bytes(b"ok \xe4\xb8 err", "utf-8") == "ok � err"
    assert encodings.decode_bytes(b"a\x81b", "windows-1252") == "a\x81b"
    assert encodings.decode_bytes(b"\xfeb", "gbk") == "㧏" or len(encodings.decode_bytes(b"\xfeb", "gbk")) == 1


@pytest.mark.parametrize("codec, mark", [("utf-16le", b"\xff\xfe"), ("utf-16be", b"\xfe\xff"), ("utf-16le", b"")])
def test_utf16_lines_over_many_splits(spark, tmp_path, codec, mark):
    want = [f"行-{i:05d}" + ("ਅ଀ਊ" if i % 7 == 0 else "") for i in range(3000)]
    (tmp_path / "w.log").write_bytes(mark + "\r\n".join([*want, ""]).encode(codec.replace("16", "16-")))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = sorted((r.file_line, r.text) for r in lines.read_lines(spark, str(tmp_path / "w.log"), codec).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert rows == list(enumerate(want, 1))


@pytest.mark.parametrize("size", ["1000", "50000", "128m"])
def test_numbers_do_not_depend_on_splits(spark, tmp_path, size):
    for name in "ab":
        (tmp_path / f"{name}.log").write_bytes(b"".join(b"%s-%06d\r%s\n" % (name.encode(), i, b"\r" * (i % 2)) for i in range(1, 5001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        rows = lines.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 10000
    assert all(r.text == f"{r.path[-5]}-{r.file_line:06d}" + "\r" * (r.file_line % 2) for r in rows)


def test_documents_stats_previews(spark, tmp_path):
    (tmp_path / "d.md").write_bytes(b"\xef\xbb\xbf" + "é".encode() * 10)
    row = files.read_documents(spark, str(tmp_path / "d.md"), cap=8).first()
    assert (row.text, row.bytes, row.truncated, row.encoding.id) == ("éé�", 23, True, "utf-8")
    assert files.stat_files(spark, str(tmp_path)).first()["size"] == 23
    shown = spark.createDataFrame([("a\r\nb\rc\n�", True), ("", False), ("a\n", False)], "t string, cut boolean").select(encodings.preview_lines(F.col("t"), F.col("cut")))
    assert [r[0] for r in shown.collect()] == [["a", "b", "c"], [], ["a"]]
    kinds = lines.route_files(spark.createDataFrame([("a/b.BIN",), ("c.tsv",), ("x.markdown",), ("log.1",)], "path string"))
    assert [r.kind for r in kinds.collect()] == ["config", "table", "document", "lines"]


def test_each_file_in_its_own_encoding(spark, tmp_path):
    (tmp_path / "a").mkdir()
    cases = {"a.log": "é\n中".encode(), "b.log": b"\xff\xfe" + "x\r\ny".encode("utf-16-le"), "a/c.log": "中文日志\nz".encode("gb18030"), "d.log": b""}
    for name, data in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = sorted((r.path.removeprefix(f"file:{tmp_path}/").removeprefix(f"file://{tmp_path}/"), r.file_line, r.text) for r in lines.read_lines(spark, str(tmp_path)).collect())
    assert rows == [("a.log", 1, "é"), ("a.log", 2, "中"), ("a/c.log", 1, "中文日志"), ("a/c.log", 2, "z"), ("b.log", 1, "x"), ("b.log", 2, "y")]
    assert lines.read_lines(spark, str(tmp_path / "none*")).count() == 0


@pytest.mark.parametrize("size", ["40", "333", "128m"])
def test_one_file_in_many_splits(spark, tmp_path, size):
    import random

    rng = random.Random(int(size[:2]))
    alphabet = ['"', '"', ",", "\n", "\n", "\r", "\r\n", "ab", "é", " ", '""', "xyz,", 'q"r']
    texts = {f"{i}.csv": "".join(rng.choices(alphabet, k=rng.choice([0, 3, 40, 400]))) for i in range(30)}
    texts |= {"open.csv": 'a,b\n"never\nclosed,\n' + "x\n" * 50, "tail.csv": 'a\n"open\nend', "nl.csv": "\n\n\n", "mark.csv": '﻿"a\nb",c\n"'}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = {}
        for r in delimited.split_delimited(spark, str(tmp_path)).orderBy("row_no").collect():
            rows = got.setdefault(r.path.rsplit("/", 1)[1], [])
            assert r.row_no == len(rows) + 1
            rows.append(r.cells)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = {n: list(delimited.records(t.removeprefix("﻿"))) for n, t in texts.items()}
    assert got == {n: rows for n, rows in want.items() if rows}


@pytest.mark.parametrize("size", [10, 64, 334])
def test_delimited_files_in_ranges_of_any_size(spark, tmp_path, monkeypatch, size):
    """Quoted cells over several ranges, in one encoding and another."""
    import random

    monkeypatch.setattr(delimited, "MORE", size + 2)
    rng = random.Random(size)
    alphabet = ['"', '"', ",", "\n", "\n", "\r", "\r\n", "ab", "é", "中", " ", '""', "xyz,", 'q"r']
    texts = {f"{i}": "".join(rng.choices(alphabet, k=rng.choice([1, 3, 40, 300]))) for i in range(12)}
    texts |= {"open": 'a,b\n"never\nclosed,\n' + "x\n" * 90, "long": "a\n" + 'b,"' + "y\n" * 300 + '"\nc\nd,""\n', "ends": "\n\n\n", "bare": 'a\n"b\n",c'}
    for encoding, codec in (("utf-8", "utf-8"), ("utf-16le", "utf-16-le"), ("gb18030", "gb18030")):
        folder = tmp_path / encoding
        folder.mkdir()
        for name, text in texts.items():
            (folder / f"{name}.csv").write_bytes(text.encode(codec))
        got = {}
        for r in delimited.split_delimited(spark, str(folder), ",", encoding, size).orderBy("path", "row_no").collect():
            rows = got.setdefault(r.path.rsplit("/", 1)[1].removesuffix(".csv"), [])
            assert r.row_no == len(rows) + 1
            rows.append(r.cells)
        assert got == {n: rows for n, t in texts.items() if (rows := list(delimited.records(t)))}


def test_rows_of_a_delimited_file_are_not_exchanged(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b\nc"\nd,e\n')
    df = delimited.split_delimited(spark, str(tmp_path))
    assert [(r.row_no, r.cells) for r in df.orderBy("row_no").collect()] == [(1, ["a", "b\nc"]), (2, ["d", "e"])]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Window", "hashpartitioning", "rangepartitioning", "SortMergeJoin") if x in plan]


def test_previews_of_long_files(spark):
    texts = ["é" * 5000, "x" + "é" * 5000, "xy" + "中" * 4000, "a\n" * 5000, "a\r\nb" + "z" * 8187, "a\r\nb" + "z" * 8188, "", "\ufeffa"]
    files = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "i int, content binary")
    shown = {r.i: r.shown for r in files.select("i", encodings.preview(F.col("content"), F.lit("utf-8")).alias("shown")).collect()}
    assert shown == {0: ["é" * 4096], 1: ["x" + "é" * 4095], 2: ["xy" + "中" * 2730], 3: ["a"] * 14, 4: ["a", "b" + "z" * 8187], 5: ["a", "b" + "z" * 8188], 6: [], 7: ["a"]}
    long = [t for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len((t := r.text or "").encode()) > 8192]
    assert long
    got = spark.createDataFrame([(t,) for t in long], "t string").select(encodings.preview(F.encode("t", "UTF-8"), F.lit("utf-8"))).collect()
    assert [r[0] for r in got] == [t.encode()[:8192].decode(errors="ignore").split("\n")[:14] for t in long]


def _char_by_char(text, max_rows, max_bytes):
    """The caps as a loop over characters would take them."""
    read, consumed = "", 0
    for c in text:
        read += c
        consumed += len(c.encode())
        done = [r for r, _, end in delimited._ended(read, ",") if end]
        if len(done) >= max_rows or consumed >= max_bytes:
            return done[:max_rows], len(read) < len(text)
    return list(delimited.records(text)), False


@pytest.mark.parametrize("text", ["a,b\n1,2\nx", "a,b\r\n1,2\r\n", 'h\n"q\n""é",中\n\n5', "", "\n\n", '"open\nto the end', "a\rb\rc"])
def test_caps_of_rows_and_bytes(text):
    size = len(text.encode())
    for rows in (1, 2, 3, 99):
        for cap in [*range(1, size + 3), 10**6]:
            assert delimited.capped_records(text, ",", rows, cap) == _char_by_char(text, rows, cap), (rows, cap)


def test_previews_of_delimited_files(spark, tmp_path):
    """At the cap less one, at the cap and one above; the rest of a huge file is not read."""
    row = "中" * 10 + ",x\n"
    (tmp_path / "a.csv").write_bytes((row * 50).encode())
    (tmp_path / "b.csv").write_bytes(b"\xff\xfe" + (row * 50).encode("utf-16-le"))
    with open(tmp_path / "c.csv", "wb") as f:
        f.write(b"1,2\n" * 1000)
        f.seek(5 << 30)
        f.write(b"!")
    n = len(row.encode())
    for cap, rows, cut in ((n * 50 - 1, 49, True), (n * 50, 50, False), (n * 50 + 1, 50, False), (n * 20, 20, True)):
        got = delimited.preview_files(spark, str(tmp_path / "[ab].csv"), max_bytes=cap).groupBy("path").agg(F.count("cells").alias("n"), F.max("truncated").alias("cut")).collect()
        assert [(r.n, r.cut) for r in got] == [(rows, cut)] * 2
    got = delimited.preview_files(spark, str(tmp_path / "c.csv"), max_rows=7, max_bytes=1 << 16).collect()
    assert [r.cells for r in got] == [["1", "2"]] * 7 and got[0].truncated


def test_detection_needs_no_python_and_knows_cut_characters(spark):
    tails = [bytes(t) for n in range(4) for t in itertools.product((0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5), repeat=n)]
    df = spark.createDataFrame([(t,) for t in tails] + [(b"\xc3\xa9" + t,) for t in tails] + [(None,)], "content binary").select("content", encodings._utf8_start(F.col("content")).alias("got"))
    assert all(r.got == encodings.begins_utf8(r.content) for r in df.collect())
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_decoding_takes_few_rows_at_a_time_and_leaves_valid_utf8_alone(spark):
    rows = [(b"\xc3\xa9\x00", "utf-8"), (b"a\xffb", "utf-8"), (b"\x3d\xd8\x00\xde", "utf-16le"), (None, "utf-8"), (b"\x81", "windows-1252"), (b"", "gb18030")]
    df = spark.createDataFrame(rows, "content binary, encoding string").select("content", "encoding", encodings.decode(F.col("content"), F.col("encoding")).alias("text"))
    assert all(r.text == encodings.decode_bytes(r.content, r.encoding) for r in df.collect())
    assert "BatchEvalPython" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "ArrowEvalPython" not in plan
