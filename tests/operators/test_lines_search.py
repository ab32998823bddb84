import duckdb
import pytest
from pyspark.sql import functions as F

from linework.operators import filters, lines, search
from linework.plans import line_queries


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows, 1)), "doc_id long, text string")


@pytest.mark.parametrize("text, want", [("", []), (None, []), ("a", ["a"]), ("a\n", ["a"]), ("a\nb", ["a", "b"]), ("\n\n", ["", ""]), ("a\n\nb", ["a", "", "b"]), ("a\r\nb\r\n", ["a", "b"]), ("a\rb\r\r\n", ["a\rb\r"])])
def test_line_rules(spark, text, want):
    df = texts(spark, text)
    assert [r.text for r in lines.explode_lines(df).orderBy("file_line").collect()] == want
    assert df.select(lines.total_lines(F.col("text"))).first()[0] == len(want)


def test_places(spark):
    rows = lines.line_bytes(texts(spark, "é\r\nbc\n\nd")).orderBy("file_line").collect()
    assert [(r.byte_offset, r.bytes, r.complete) for r in rows] == [(0, 4, True), (4, 3, True), (7, 1, True), (8, 1, False)]


def test_jump_windows(spark):
    df = texts(spark, "".join(f"line-{i:06d}\n" for i in range(1, 100_001)))
    log, totals = lines.explode_lines(df).cache(), df.select("doc_id", lines.total_lines(F.col("text")).alias("total_lines"))
    shape = lambda n, keep=None: lines.jump_window(log, n, keep, totals).agg(F.min("first_line"), F.count("*"), F.max("target_index"), F.max("target_visible")).first()
    assert tuple(shape(50_000)) == (48_500, 3000, 1500, True)
    assert tuple(shape(99_000)) == (97_500, 2501, 1500, True)
    assert tuple(shape(0)) == (98_500, 1501, 1500, True)
    assert tuple(shape(99_000, F.col("file_line") < 98_000)) == (97_500, 500, 499, False)
    assert shape(100_001)[1] == 0


def test_block_averages(spark):
    df = texts(spark, "123456789\n" * 128 + "x" * 99 + "\n" + ("x" * 99 + "\n") * 127)
    places = lines.line_bytes(df)
    assert [r.avg_len for r in lines.block_avg_lens(places, 128).orderBy("block").collect()] == [10, 100]
    assert lines.block_avg_lens(places, 256, smooth=64).first().avg_len == lines.avg_line_len(places).first().avg_len == 55


def found(spark, text, query, **options):
    log = lines.explode_lines(texts(spark, text))
    return [(r.file_line, r.offset) for r in search.search_lines(log, query, **options).orderBy("file_line", "offset").collect()]


def test_hits_take_text_from_left_to_right(spark):
    assert found(spark, "aaaa\nabc abc abc", "aa") == [(1, 0), (1, 2)]
    assert found(spark, "the ERR here\n中文err中文", "err") == [(1, 4), (2, 2)]
    assert found(spark, "the ERR here\n中文err中文", "err", whole_word=True) == [(1, 4)]
    assert found(spark, "aaa-aa", "aa", whole_word=True) == [(1, 4)]
    assert found(spark, "É é k K", "é") == [(1, 2)]
    assert found(spark, "a.b\\E.", "\\E") == [(1, 3)]
    assert found(spark, "abc", "  ") == [] and found(spark, "a b", " b") == [(1, 1)]


def test_a_line_of_very_many_hits(spark):
    got = found(spark, "ab" * 100_001, "ab")
    assert got == [(1, 2 * i) for i in range(100_001)]


def test_pages_resume_without_loss(spark):
    hits = search.search_lines(lines.explode_lines(texts(spark, "x x x\nx\n\nx x")), "x")
    everything, seen, after = sorted(map(tuple, hits.collect())), [], None
    while True:
        page = sorted(search.search_page(hits, ["doc_id", "file_line", "offset"], 2, after).collect())
        seen += [tuple(r)[:3] for r in page]
        if page[-1].is_last:
            break
        after = seen[-1]
    assert seen == everything and len(page) == 2


@pytest.mark.parametrize("bad", ["(", "x" * 513, "a(?=b)", r"(a)\1", "a++", ""])
def test_unusable_patterns_filter_nothing(spark, bad):
    spec = filters.FilterSpec.pattern(bad)
    assert not spec.is_active
    assert filters.filter_lines(texts(spark, "q"), spec).count() == 1


def test_pattern_dialect(spark):
    df = texts(spark, "٣", "a\rb", "É", "k")
    rows = lambda p: {r.doc_id for r in filters.filter_lines(df, filters.FilterSpec.pattern(p)).collect()}
    assert rows(r"^\d$") == {1} and rows("a.b") == {2} and rows("(?i)é") == {3} and rows("K") == set()
    both = filters.FilterSpec(("K",), "^٣")
    assert {r.doc_id for r in filters.filter_lines(df, both).collect()} == {1, 4}


def test_filter_regex_has_the_word_borders_of_its_sql(spark, tmp_path):
    rows = [(1, "Au inöun be."), (2, "Au in be."), (3, "Au and."), (4, "Au andy."), (5, "Au inÉ x."), (6, "Au in_x.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = {r[0] for r in con.sql(f"SELECT doc_id FROM ({line_queries.ORACLES['filter_regex']})").fetchall()}
    assert {r.doc_id for r in line_queries.filter_regex(spark, str(tmp_path)).collect()} == wanted == {1, 2, 3, 5}
    found = lambda p: {r.doc_id for r in filters.filter_lines(texts(spark, "in ö", "inö", "\\b"), filters.FilterSpec.pattern(p, ascii_classes=True)).collect()}
    assert found(r"\Bn\b") == {1, 2} and found(r"n\B") == set() and found(r"\Q\b\E") == {3} and found(r"^\w+$") == set()


def test_spans_and_segments(spark):
    row = texts(spark, "aaAa foo AAb").select(
        search.find_spans(F.col("text"), "aa").alias("all"),
        search.find_spans(F.col("text"), "foo", whole_word=True).alias("word"),
        search.search_segments(F.col("text"), "aa").alias("cut"),
        search.segments(F.col("text"), "aab", "FOO a").alias("both"),
    ).first()
    assert [s.start for s in row["all"]] == [0, 1, 2, 9] and [s.start for s in row.word] == [5]
    assert [(s.text, s.find) for s in row.cut] == [("aaAa", True), (" foo ", False), ("AA", True), ("b", False)]
    assert [(s.text, s.find, s.keyword) for s in row.both] == [
        ("a", False, 1), ("a", False, 1), ("A", False, 1), ("a", False, 1), (" ", False, None), ("foo", False, 0), (" ", False, None), ("AAb", True, None)]


def test_cell_pages_resume_and_all_hits_are_grouped(spark):
    rows = spark.range(3000).selectExpr("id as row_no", "array('1x', 'y', cast(id as string), '1') as cells")
    every = sorted((i, c) for i in range(3000) for c, v in enumerate(["1x", "y", str(i), "1"]) if "1" in v)
    assert len(every) > search.CELL_CAP
    pages, after = [], None
    while not pages or pages[-1][-1].capped:
        pages.append(search.find_in_cells(rows, "1", after=after).orderBy("row", "col").collect())
        after = tuple(pages[-1][-1][:2])
    assert [tuple(r[:2]) for page in pages for r in page] == every and len(pages) == 2
    grouped = search.hits_by_row(search.cell_hits(rows, "1")).collect()
    assert sorted((r.row, c) for r in grouped for c in r.cols) == every
