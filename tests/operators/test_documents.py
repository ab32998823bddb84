from pyspark.sql import functions as F

from linework.functions import paths, text
from linework.operators import tables, html, markdown


def docs(spark, *rows):
    return spark.createDataFrame([(f"/d/{i}.md", t) for i, t in enumerate(rows, 1)], "path string, text string")


def test_outline(spark):
    source = "# 重复标题\n重复标题\n===\n```\n# code\n```\n## `a` **b** [l](u)[^1] ##\n# !!!\n# x\n# x-2\n# x\n# x\n\n---\n> q\n---\n#nope\n####### seven\n# <b>A & B</b>"
    rows = markdown.outline(docs(spark, source), "path").orderBy("pos").collect()
    assert [(r.depth, r.id, r.text) for r in rows] == [
        (1, "重复标题", "重复标题"), (1, "重复标题-2", "重复标题"), (2, "a-b-lu", "a b l"), (1, "section", "!!!"), (1, "x", "x"), (1, "x2", "x-2"), (1, "x-2", "x"), (1, "x-3", "x"), (1, "a-b", "A & B")]


def test_unique_ids(spark):
    ids = spark.range(1).select(text.unique_ids(F.array(*map(F.lit, ["a", "a-2", "a", "a", "b"])))).first()[0]
    assert ids == ["a", "a-2", "a-3", "a-4", "b"]


def test_footnotes(spark):
    source = "see [^b] and [^a] [^none]\n[^a]: first\n  more\n[^a]: second\n[^b]:  bee \n```\n[^c]\n```\n[^c]: unused\n[^d]:\n[^b] again"
    used, dangling, unused = markdown.footnotes(docs(spark, source), "path")
    assert [(r.number, r.id, r.text, r.line) for r in used.orderBy("number").collect()] == [(1, "b", "bee", 5), (2, "a", "first more", 2)]
    assert [r.id for r in dangling.collect()] == ["none"] and [r.id for r in unused.collect()] == ["c"]


def test_links_and_images(spark):
    source = '# In\n[a](#in) [b](https://x.y/z#q) [c](2.md#there "t") [d](../r/e%20f.txt) `[n](n)` ![i](p/q.PNG) ![](x.txt) <img alt=z src="http://u/v.png"> <img alt="no">\n[e](#gone)'
    df = docs(spark, source, "## There")
    found = markdown.links(df, "path", F.col("path"))
    assert sorted((r.kind, r.href, r.target, r.fragment) for r in found.collect()) == [
        ("anchor", "#gone", "/d/1.md", "gone"), ("anchor", "#in", "/d/1.md", "in"), ("doc", "2.md#there", "/d/2.md", "there"),
        ("external", "https://x.y/z#q", None, None), ("file", "../r/e%20f.txt", "/r/e f.txt", "")]
    heads = markdown.outline(df, "path").withColumnRenamed("path", "doc")
    links = found.withColumnRenamed("path", "doc")
    bad = markdown.dangling_links(links, heads, df.select(F.col("path").alias("doc"), "path"), "doc")
    assert [r.href for r in bad.collect()] == ["#gone"]
    got = sorted((r.kind, r.src, r.target, r.label) for r in markdown.images(df, "path", F.col("path")).collect())
    assert got == [("file", "p/q.PNG", "/d/p/q.PNG", "i"), ("path", "x.txt", "/d/x.txt", "x.txt"), ("url", "http://u/v.png", "http://u/v.png", "z")]


def test_math_and_counts(spark):
    source = "质数$p$满足 $5 和 $10, $100$ $a$b$ \\(2\\) $$x+1$$\n$$\n\\frac\na\n$$\n\\[ y \\]\n`$c$`\n| a | b |\n|---|:-:|\n- [x] done\n- [ ] open\n```py k\n$z$\n```"
    rows = markdown.math_spans(docs(spark, source), "path").collect()
    assert sorted((r.display, r.tex) for r in rows) == [(False, "2"), (False, "a"), (False, "p"), (True, "\\frac\na"), (True, "x+1"), (True, "y")]
    assert [r.lang for r in markdown.code_blocks(docs(spark, source), "path").collect()] == ["py"]
    row = markdown.section_counts(docs(spark, source), "path").first()
    assert (row.lines, row.tables, row.tasks, row.tasks_done, row.code_blocks, row.math, row.images) == (14, 1, 2, 1, 1, 6, 0)


def test_paths(spark):
    cases = [("D:\\docs\\a.md", "..\\b/./c.md#x", "D:\\b\\c.md"), ("D:\\docs\\a.md", "..\\..\\..\\x", "D:\\x"), ("/n/a.md", "b%zz+c.png?q", "/n/b%zz+c.png"), ("", "..\\..\\x", "x"),
             ("/n/a.md", "file:///D:/q/a%20b.md", "D:/q/a b.md"), ("\\\\srv\\s\\a.md", "b", "\\\\srv\\s\\b"), ("/n/a.md", "/abs//p/../q", "/abs/q"), ("a.md", "b/c", "b/c")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, doc string, href string, want string")
    got = df.select("want", paths.resolved(F.col("doc"), F.col("href")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    names = spark.createDataFrame([("a/.bashrc",), ("x\\y.TAR.gz",), ("z.",)], "p string").select(paths.extension(F.col("p")), paths.base_name(F.col("p")), paths.directory(F.col("p")))
    assert [tuple(r) for r in names.collect()] == [("", ".bashrc", "a"), ("gz", "y.TAR.gz", "x"), ("", "z.", "")]


def test_html(spark):
    page = "<p style='a:b' onclick=\"x()\">Foo &amp; FOO<script>foo</script><a href='javascript:1'>b</a> <img srcset=q autofocus><form></form>"
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [tuple(r) for r in html.find_in_pages(df, "foo").collect()] == [(1, 0, 2)]
    found = sorted((r.category, r.name, r.n) for r in html.unsafe_markup(df).collect())
    assert found == [("attribute", "autofocus", 1), ("attribute", "srcset", 1), ("handler", "onclick", 1), ("style", "style", 1), ("tag", "form", 1), ("url", "javascript", 1)]
    row = df.select(text.without_styles(F.col("html")).alias("s"), text.escape_html(F.lit("<'&")).alias("e")).first()
    assert "style" not in row.s and row.e == "&lt;&#39;&amp;"


def test_error_kinds(spark):
    cases = {"": "none", "文件不存在: C:\\a.log": "missing", "schema 文件不存在: x": "missing_schema", "No such file (os error 2)": "missing", "os error 25": "other", "tab 不存在: 3": "other", "Access is DENIED.": "denied", "无权限": "denied"}
    df = spark.createDataFrame([*cases.items(), (None, "none")], "m string, want string")
    assert [r[0] for r in df.select(text.error_kind(F.col("m"))).collect()] == [r.want for r in df.collect()]


def test_long_lines_do_not_overflow_the_stack(spark):
    """A line of 100,000 characters in brackets, and shorter ones of whatever the patterns repeat."""
    n = 3_000
    long = ["[" + "x" * 100_000, "[" * n, "[![a](b) " * (n // 10) + "](t.md)", "![" * n, "> " * n, "#" * n, "# " + "a #" * n, "-" * n, "| - " * n, "`" * n, "$" * n, "$a" * n, "\\(" * n, "[^a" * n, "[^a]: " + "b " * n,
            " " * n, "<img " * n, "<img src=" + "'" * n, "* " * n, "**a" * n, "- [ ] " * n]
    docs = spark.createDataFrame([(i, "first\n" + t + "\nlast") for i, t in enumerate(long)], "doc_id long, text string")
    here = F.lit("/a/b.md")
    assert markdown.links(docs, "doc_id", here).where("doc_id != 2").count() == 0
    for df in (markdown.outline(docs, "doc_id"), *markdown.footnotes(docs, "doc_id"), markdown.links(docs, "doc_id", here), markdown.images(docs, "doc_id", here),
               markdown.math_spans(docs, "doc_id"), markdown.code_blocks(docs, "doc_id"), markdown.section_counts(docs, "doc_id")):
        df.write.format("noop").mode("overwrite").save()


def test_a_fence_ends_a_definition(spark):
    text = "see [^a] [^b]\n[^a]: text\n```\ncode\n```\n  indented\n[^b]: one\n  two\n   three\nnot more\n  [^c]: inner"
    used, dangling, unused = markdown.footnotes(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "  only indented [^z]")], "doc_id long, text string"), "doc_id")
    assert sorted((r.number, r.id, r.text, r.line) for r in used.collect()) == [(1, "a", "text", 2), (2, "b", "one two three", 7)]
    assert [(r.doc_id, r.id) for r in dangling.collect()] == [(4, "z")] and [(r.id, r.line) for r in unused.collect()] == [("c", 11)]


def test_null_keys_of_a_diff_meet(spark):
    left = spark.createDataFrame([(None, "a"), (1, "b"), (2, "c")], "k long, v string")
    right = spark.createDataFrame([(None, "x"), (1, "b"), (3, "d")], "k long, v string")
    found = lambda a, b: sorted(((r.k, r.status, r.left_value, r.right_value) for r in tables.keyed_diff(a, b, "k", ["v"]).collect()), key=repr)
    assert found(left, right) == [(2, "left_only", None, None), (3, "right_only", None, None), (None, "changed", "a", "x")]
    assert found(left.where("k = 1"), right.where("k is null or k = 1")) == [(None, "right_only", None, None)]
    assert tables.diff_totals(tables.keyed_diff(left, right, "k", ["v"]), left).first()["differing_rows"] == 3


def test_fences_by_sign_and_length(spark):
    source = "````md\n```py\n~~~\n````x\n`````\nout\n   ~~~ sql\n```\n~~\n    ~~~\n~~~~ \nout\n    ```\nout\n``` a`b\nout\n```rs\nnever closed\n~~~"
    df = docs(spark, source)
    rows = markdown.line_arrays(df, "path").select(F.inline_outer("ls")).where("outside").orderBy("line").collect()
    assert [r.line for r in rows] == [6, 12, 13, 14, 15, 16]
    assert [(r.line, r.lang) for r in markdown.code_blocks(df, "path").orderBy("line").collect()] == [(1, "md"), (7, "sql"), (17, "rs")]


def test_nodes_and_find_skip_formulas(spark):
    source = "# The *the* [the](the.md) $the$ `the` x\r\n- the ![the](i)\n```\nthe $x$\n\n```\n$$\nthe\n$$\n> 1 <b title='the'>the</b> \\(the\\)\x01"
    found = markdown.nodes(docs(spark, source), "path")
    rows = found.orderBy("node").collect()
    assert all(source.replace("\x01", "�")[r.start : r.start + len(r.text)] == r.text for r in rows)
    assert [r.text for r in rows if r.kind == "math"] == ["$the$", "$$\nthe\n$$", "\\(the\\)"] and [r.text for r in rows if r.kind == "code"] == ["the", "the $x$"]
    hits = sorted(r.offset for r in markdown.find_in_nodes(found, "THE", "path").collect())
    want = [source.index(s) + k for s, k in [("The", 0), ("*the", 1), ("[the]", 1), ("`the`", 1), ("- the", 2), ("![the", 2), ("the $x$", 0), (">the<", 1)]]
    assert hits == sorted(want)
    assert markdown.find_in_nodes(found, " ", "path").count() == 0
    assert [r.offset for r in markdown.find_in_nodes(found, "The", "path", case_sensitive=True).collect()] == [2]
