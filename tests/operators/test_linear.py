"""Patterns and folds on 300,000 characters in one line, or thousands of elements: time that grows with the square shows here."""

import time

import pytest
from pyspark.sql import functions as F

from linework.functions import text
from linework.operators import html, markdown, search

#: Seconds that one document may take. What is quadratic took some minutes to hours.
LIMIT = 30
N = 300_000


def run(df):
    """The rows, in time."""
    df.limit(0).collect()
    began = time.perf_counter()
    rows = df.collect()
    assert time.perf_counter() - began < LIMIT
    return rows


def one(spark, t):
    return spark.createDataFrame([(1, t)], "doc_id long, text string")


@pytest.mark.parametrize("line, head", [("# a" + " " * N + "b", ("a" + " " * N + "b",)), ("# a" + " " * N, ("a",)), ("# a " + "#" * N, ("a",)), ("# " + "a #" * (N // 3), None), ("#" * N, ()), ("# x" + " #" * (N // 2), None)])
def test_headings(spark, line, head):
    rows = run(markdown.outline(one(spark, line), "doc_id"))
    if head is not None:
        assert [" ".join(r.text.split(" ")) for r in rows] == list(head)


@pytest.mark.parametrize("line", ["![" * (N // 2), "![a" * (N // 3) + "](u)", "!" * N, "[" * N, "![" + "!" * N + "](x)"])
def test_images(spark, line):
    assert len(run(markdown.images(one(spark, line), "doc_id", F.lit("/a.md")))) == (line.endswith(")"))


@pytest.mark.parametrize("page, n", [("<!--" * (N // 4), 1), ("<script>" * (N // 8), 0), ("<" * N, 1), ("<!--" * (N // 8) + "-->x", 1), ("x<style>" + " " * N, 1), ("<p>" + " " * N + "</p>x", 1)])
def test_html(spark, page, n):
    nodes = run(spark.createDataFrame([(page,)], "html string").select(F.size(html.text_nodes(F.col("html"))).alias("n")))
    assert nodes[0].n == n


def test_ids_of_many_equal_headings(spark):
    n = 20_000
    rows = run(markdown.outline(one(spark, "# x\n" * n + "# x-5\n# y"), "doc_id"))
    ids = [r.id for r in sorted(rows, key=lambda r: r.pos)]
    assert ids[:3] == ["x", "x-2", "x-3"] and ids[n - 1] == f"x-{n}" and ids[n:] == ["x5", "y"] and len(set(ids)) == n + 2
    some = spark.createDataFrame([(["a", "a-2", "a", "a", "b", "a-2", "a-2-2"],), ([],), (["a"],)], "ids array<string>").select(text.unique_ids(F.col("ids")).alias("i"))
    assert [r.i for r in some.collect()] == [["a", "a-2", "a-3", "a-4", "b", "a-2-2", "a-2-2-2"], [], ["a"]]


def test_segments_of_many_hits(spark):
    n = 16_000
    rows = run(spark.createDataFrame([("ab" * n,)], "t string").select(F.size(search.search_segments(F.col("t"), "ab")).alias("n"), F.size(search.search_segments(F.col("t"), "aba")).alias("m")))
    assert (rows[0].n, rows[0].m) == (n, 2)
    small = spark.createDataFrame([("xaaaybaa",), ("",), ("b",)], "t string").select(F.transform(search.merged_spans(search.find_spans(F.col("t"), "aa")), lambda s: F.concat_ws("-", s["start"], s["end"])).alias("s"))
    assert [r.s for r in small.collect()] == [["1-4", "6-8"], [], []]


def test_trims(spark):
    t = " " * N + "a" + "\t" * N + "b" + "\n" * N
    assert run(one(spark, t).select(text.stripped(F.col("text")).alias("t")))[0].t == "a" + "\t" * N + "b"
    assert run(markdown.footnotes(one(spark, "[^a]: b" + " " * N + "c\n[^a]"), "doc_id")[0])[0].text == "b" + " " * N + "c"


def test_many_fences(spark):
    lines = ["````", "```", "~~~"] * 40_000
    rows = run(markdown.code_blocks(one(spark, "\n".join(lines)), "doc_id"))
    assert [r.line for r in sorted(rows, key=lambda r: r.line)][:3] == [1, 5, 8] and len(rows) == 40_000


def test_text_of_many_nodes(spark):
    n = 40_000
    found = markdown.nodes(one(spark, "a *b* " * n), "doc_id")
    rows = run(found.agg(F.count("*").alias("n"), F.max("start").alias("last")))
    assert (rows[0].n, rows[0].last) == (2 * n, 6 * n - 3)


def test_pages_are_cut_once(spark):
    """Each pattern stands in the plan as often as it is evaluated."""
    pages = spark.createDataFrame([(1, "<p>a</p>b")], "page_id long, html string")
    plan = html.find_in_pages(pages, "A")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == 4 and plan.count("size(filter(") == 0
