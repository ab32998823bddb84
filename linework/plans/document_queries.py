"""Document queries: Markdown that Spark makes of documents, paths, and the HTML of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.functions import paths, text
from linework.functions.arrays import let
from linework.operators import html, lines, markdown
from linework.sources import lines as source_lines

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


def notes(spark, sf_dir: str) -> DataFrame:
    """documents as Markdown: by turns a heading, references, definitions, links and formulas, and a fenced block."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("coalesce(text, '') != ''").select("doc_id", "text")

    def line(t, i):
        n = i + 1
        s = lambda x: x.cast("string")
        turn = n % 7
        return (
            F.when(turn == 0, F.concat(F.lit("## "), t))
            .when(turn == 1, F.concat(t, F.lit(" [^n"), s(n % 4), F.lit("]")))
            .when(turn == 2, F.concat(F.lit("[^n"), s((n - 1) % 5), F.lit("]: "), t))
            .when(turn == 3, F.concat(F.lit("See [x](../d/"), s(n), F.lit(".md#in) and $a_{"), s(n), F.lit("}$ for $5 ![p](i%20/"), s(n), F.lit(".png) [t](#tha)")))
            .when(turn == 4, F.concat(F.lit("```"), F.when(n % 2 == 0, F.lit("sql x")).otherwise(F.lit(""))))
            .when(turn == 6, F.lit("```"))
            .otherwise(F.concat(F.lit("## "), t))
        )

    return docs.select("doc_id", F.array_join(F.transform(lines.raw_lines(F.col("text")), line), "\n").alias("text"), F.concat(F.lit("/n/s/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))


#: Lines of documents that have the turns of ``notes``.
_L = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a, ends_with(text, chr(10)) AS closed FROM documents WHERE coalesce(text, '') != ''),
l AS (SELECT doc_id, unnest(CASE WHEN closed THEN a[:len(a) - 1] ELSE a END) AS t, unnest(range(1, len(a) + CASE WHEN closed THEN 0 ELSE 1 END)) AS n FROM d)
"""
_HEAD = r""", h AS (SELECT doc_id, n, trim(t) AS head FROM l WHERE n % 7 = 0),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(head), '[!-/:-@\[-`{-~]', '', 'g'), '\s+', '-', 'g'), '^-+|-+$', '', 'g') AS c FROM h),
o AS (SELECT doc_id, n, head, CASE WHEN c = '' THEN 'section' ELSE c END AS c FROM s),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY n) AS k FROM o),
outline AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n)::INT AS pos, 2 AS depth, c || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id,
  trim(regexp_replace(regexp_replace(head, '\*\*(\S.*?)\*\*', '\1', 'g'), '\*([^*\s][^*]*)\*', '\1', 'g')) AS text FROM u)
"""


@query("md_outline", _L + _HEAD + "SELECT * FROM outline")
def md_outline(spark, sf_dir):
    return markdown.outline(notes(spark, sf_dir), "doc_id")


_NOTES = """, r AS (SELECT doc_id, 'n' || n % 4 AS id, min(n) AS spot FROM l WHERE n % 7 = 1 GROUP BY ALL),
f AS (SELECT doc_id, 'n' || (n - 1) % 5 AS id, min(struct_pack(n := n, t := trim(t))) AS d FROM l WHERE n % 7 = 2 AND trim(t) != '' GROUP BY ALL)
"""


@query("md_footnotes", _L + _NOTES + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY spot)::INT AS number, id, d.t AS text, d.n::INT AS line FROM f JOIN r USING (doc_id, id)")
def md_footnotes(spark, sf_dir):
    return markdown.footnotes(notes(spark, sf_dir), "doc_id")[0]


@query("md_footnote_lint", _L + _NOTES + "SELECT doc_id, id, 'no definition' AS problem FROM r ANTI JOIN f USING (doc_id, id) UNION ALL SELECT doc_id, id, 'no reference' FROM f ANTI JOIN r USING (doc_id, id)")
def md_footnote_lint(spark, sf_dir):
    _, dangling, unused = markdown.footnotes(notes(spark, sf_dir), "doc_id")
    return dangling.select("doc_id", "id", F.lit("no definition").alias("problem")).unionByName(unused.select("doc_id", "id", F.lit("no reference").alias("problem")))


_LINKS = """, k AS (SELECT doc_id, n::INT AS line, 'doc' AS kind, '../d/' || n || '.md#in' AS href, '/n/d/' || n || '.md' AS target, 'in' AS fragment FROM l WHERE n % 7 = 3
UNION ALL SELECT doc_id, n, 'anchor', '#tha', '/n/s/' || doc_id || '.md', 'tha' FROM l WHERE n % 7 = 3)
"""


@query("md_links", _L + _LINKS + "SELECT * FROM k")
def md_links(spark, sf_dir):
    return markdown.links(notes(spark, sf_dir), "doc_id", F.col("path"))


@query("md_dangling", _L + _HEAD + _LINKS + "SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM outline o WHERE o.id = k.fragment AND '/n/s/' || o.doc_id || '.md' = k.target)")
def md_dangling(spark, sf_dir):
    docs = notes(spark, sf_dir)
    found = markdown.links(docs, "doc_id", F.col("path"))
    return markdown.dangling_links(found, markdown.outline(docs, "doc_id"), docs.select("doc_id", "path"), "doc_id")


@query("md_images", _L + "SELECT doc_id, n::INT AS line, 'file' AS kind, 'i%20/' || n || '.png' AS src, '/n/s/i /' || n || '.png' AS target, 'p' AS label FROM l WHERE n % 7 = 3")
def md_images(spark, sf_dir):
    return markdown.images(notes(spark, sf_dir), "doc_id", F.col("path"))


@query("md_math", _L + "SELECT doc_id, false AS display, 'a_{' || n || '}' AS tex FROM l WHERE n % 7 = 3")
def md_math(spark, sf_dir):
    return markdown.math_spans(notes(spark, sf_dir), "doc_id")


@query("md_code_langs", _L + "SELECT CASE WHEN n % 2 = 0 THEN 'sql' ELSE '' END AS lang, count(*) AS blocks FROM l WHERE n % 7 = 4 GROUP BY 1")
def md_code_langs(spark, sf_dir):
    return markdown.code_blocks(notes(spark, sf_dir), "doc_id").groupBy("lang").agg(F.count(F.lit(1)).alias("blocks"))


@query("md_sections", _L + """SELECT doc_id, count(*) AS lines, 0 AS tables, 0 AS tasks, 0 AS tasks_done, count(*) FILTER (WHERE n % 7 = 4) AS code_blocks,
  count(*) FILTER (WHERE n % 7 = 3) AS math, count(*) FILTER (WHERE n % 7 = 3) AS images FROM l GROUP BY doc_id""")
def md_sections(spark, sf_dir):
    return markdown.section_counts(notes(spark, sf_dir), "doc_id")


@query("path_functions", r"""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS u FROM pages),
q AS (SELECT page_id, '/site/' || page_id % 7 || '/a.md' AS doc, '../x/./' || u || '/../b' || page_id || '.PNG#s?q' AS href FROM p), r AS (SELECT *, split_part(split_part(href, '#', 1), '?', 1) AS clean FROM q)
SELECT page_id, extension, target, fragment, scheme FROM (
  SELECT page_id, CASE WHEN regexp_matches(clean, '\.PNG$') THEN 'png' ELSE lower(regexp_extract(regexp_extract(clean, '([^/]*)$', 1), '^.+\.([^.]*)$', 1)) END AS extension,
  regexp_extract(href, '^[^#]*#(.*)$', 1) AS fragment, false AS scheme,
  CASE WHEN regexp_matches(clean, '/\.\./b') THEN '/site/x' || array_to_string(list_transform(list_filter(string_split(clean, '/')[4:], lambda s: s != '')[:-4], lambda s: '/' || s), '') || '/b' || page_id || '.PNG'
       ELSE '/site/x' || array_to_string(list_transform(list_filter(string_split(clean, '/')[4:], lambda s: s != ''), lambda s: '/' || s), '') END AS target FROM r)""")
def path_functions(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("u"))
    n = F.col("page_id").cast("string")
    href = F.concat(F.lit("../x/./"), F.col("u"), F.lit("/../b"), n, F.lit(".PNG#s?q"))
    document = F.concat(F.lit("/site/"), (F.col("page_id") % 7).cast("string"), F.lit("/a.md"))
    return pages.select(
        "page_id", paths.extension(paths.without_fragment(href)).alias("extension"), paths.resolved(document, href).alias("target"),
        paths.fragment(href).alias("fragment"), paths.has_scheme(href).alias("scheme"),
    )


@query("display_text", "SELECT doc_id, left(text, 2000) || CASE WHEN length(text) > 2000 THEN '…' ELSE '' END AS shown FROM documents")
def display_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.display_text(F.col("text")).alias("shown"))


@query("classify_error", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'denied' WHEN 2 THEN 'other' WHEN 3 THEN 'none' ELSE 'missing_schema' END AS kind FROM documents""")
def classify_error(spark, sf_dir):
    messages = F.element_at(F.array(*map(F.lit, ("read /x: No such file", "Access is denied (os error 5)", "broken", "", "schema 文件不存在: x"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.error_kind(messages).alias("kind"))


_NODES = r""", x AS (SELECT page_id, regexp_split_to_array(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '<x>', 'g'), '<[^>]*>') AS a FROM pages),
y AS (SELECT page_id, list_filter(list_transform(a, lambda t: replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', '''')), lambda t: regexp_matches(t, '\S')) AS nodes FROM x),
z AS (SELECT page_id, (unnest(range(len(nodes))))::INT AS node, unnest(nodes) AS t FROM y)
"""


@query("page_text_find", "WITH one AS (SELECT 1)" + _NODES + "SELECT page_id, node, (len(string_split(lower(t), 'en')) - 1)::INT AS hits FROM z WHERE contains(lower(t), 'en')")
def page_text_find(spark, sf_dir):
    return html.find_in_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), "EN")


@query("page_visible_text", r"SELECT page_id, trim(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', '''')) AS text FROM pages")
def page_visible_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.visible_text(F.col("html")).alias("text"))


@query("unsafe_markup_audit", r"""WITH t AS (SELECT page_id, 'tag' AS category, lower(unnest(regexp_extract_all(html, '(?i)<(style|link|meta|base|iframe|frame|frameset|object|embed|form)\b', 1))) AS name FROM pages),
o AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS tag FROM pages),
a AS (SELECT page_id, lower(unnest(regexp_extract_all(tag, '\s([a-zA-Z-]+)\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)', 1))) AS name FROM o)
SELECT page_id, category, name, count(*) AS n FROM (
  SELECT * FROM t UNION ALL SELECT page_id, 'attribute', name FROM a WHERE name IN ('srcset', 'formaction', 'ping', 'autofocus')
  UNION ALL SELECT page_id, 'style', name FROM a WHERE name = 'style' UNION ALL SELECT page_id, 'handler', name FROM a WHERE regexp_matches(name, '^on[a-z]+$')
  UNION ALL SELECT page_id, 'url', lower(unnest(regexp_extract_all(html, '(?i)\s(?:href|src|action)\s*=\s*["'']?\s*(javascript):', 1))) FROM pages) GROUP BY ALL""")
def unsafe_markup_audit(spark, sf_dir):
    return html.unsafe_markup(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("html_escape", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;') AS escaped, html AS back FROM pages")
def html_escape(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.escape_html(F.col("html")).alias("escaped"))
    back = F.col("escaped")
    for entity, plain in text.ENTITIES[::-1]:
        back = F.replace(back, F.lit(entity), F.lit(plain))
    return pages.withColumn("back", back)


@query("style_attributes", r"""SELECT page_id, regexp_replace(html, '(?i)\sstyle\s*=\s*("[^"]*"|''[^'']*''|[^\s>]+)', '', 'g') AS html FROM pages""")
def style_attributes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.without_styles(F.col("html")).alias("html"))


@query("route_files", r"SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'config' WHEN page_id % 4 = 1 THEN 'table' WHEN page_id % 4 = 2 THEN 'document' ELSE 'lines' END AS kind FROM pages")
def route_files(spark, sf_dir):
    extension = F.element_at(F.array(*map(F.lit, (".BIN", ".tsv", ".md", ".log"))), (F.col("page_id") % 4 + 1).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("url", extension).alias("path"))
    return source_lines.route_files(pages).select("page_id", "kind")


def fenced(spark, sf_dir: str) -> DataFrame:
    """documents as Markdown with blocks that hold other fences: lines of nine turns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    turns = ["    ```", "````", "```", "~~~ `", "````x", None, "`````  ", None, "   ~~~~ sql `x`"]  # by line % 9; the last is closed by the first of the next nine only if that is bare of indentation
    line = lambda t, i: F.concat(F.coalesce(F.element_at(F.array(*map(F.lit, turns)), ((i + 1) % 9 + 1).cast("int")), F.concat(F.lit("## "), t)))
    return docs.select("doc_id", F.array_join(F.transform(lines.raw_lines(F.col("text")), line), "\n").alias("text"))


#: Of nine lines the second opens a block that the seventh closes; the ninth opens one that only the eighteenth line's kind could close.
_FENCED = """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS a, ends_with(text, chr(10)) AS closed FROM documents WHERE coalesce(text, '') != ''),
l AS (SELECT doc_id, unnest(CASE WHEN closed THEN a[:len(a) - 1] ELSE a END) AS t, unnest(range(1, len(a) + CASE WHEN closed THEN 0 ELSE 1 END))::INT AS line FROM d)
"""


@query("md_fenced_blocks", _FENCED + "SELECT doc_id, line, CASE line WHEN 1 THEN '' ELSE 'sql' END AS lang FROM l WHERE line IN (1, 8)")
def md_fenced_blocks(spark, sf_dir):
    """A block is closed by its own sign in its own length only; one that nothing closes runs to the end."""
    return markdown.code_blocks(fenced(spark, sf_dir), "doc_id")


@query("md_outside_code", _FENCED + "SELECT doc_id, line, '## ' || t AS text FROM l WHERE line = 7")
def md_outside_code(spark, sf_dir):
    rows = markdown.line_arrays(fenced(spark, sf_dir), "doc_id").select("doc_id", F.inline_outer("ls")).where("outside and text != ''")
    return rows.select("doc_id", "line", "text")


def formulas(spark, sf_dir: str) -> DataFrame:
    """documents, letters only, as Markdown whose text, code and formulas hold the same words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def line(t, i):
        turn, around = (i + 1) % 6, lambda a, t, b="": F.concat(F.lit(a), t, F.lit(b))

        def made(t):
            fence = F.when(turn.isin(2, 4), "```").when(turn == 3, t).otherwise(around("$$the$$ ", t))
            return F.when(turn == 0, around("- **", t, "** x")).when(turn == 1, around("so `the ", t, "` and $the x$ the")).otherwise(fence)

        return let(F.regexp_replace(t, "[^A-Za-z ]", "x"), made)

    return docs.select("doc_id", F.array_join(F.transform(lines.raw_lines(F.col("text")), line), "\n").alias("text"))


@query("md_find", _FENCED + r""", m AS (SELECT doc_id, line, line % 6 AS turn, regexp_replace(t, '[^A-Za-z ]', 'x', 'g') AS t FROM l),
made AS (SELECT *, CASE turn WHEN 0 THEN '- **' || t || '** x' WHEN 1 THEN 'so `the ' || t || '` and $the x$ the' WHEN 2 THEN '```' WHEN 3 THEN t WHEN 4 THEN '```' ELSE '$$the$$ ' || t END AS made FROM m),
placed AS (SELECT *, sum(length(made) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(made) - 1 AS base FROM made),
node AS (SELECT doc_id, 'text' AS kind, base + 4 AS base, t FROM placed WHERE turn = 0 UNION ALL SELECT doc_id, 'code', base + 4, 'the ' || t FROM placed WHERE turn = 1
  UNION ALL SELECT doc_id, 'text', base + length(made) - 3, 'the' FROM placed WHERE turn = 1 UNION ALL SELECT doc_id, 'code', base, t FROM placed WHERE turn = 3 UNION ALL SELECT doc_id, 'text', base + 8, t FROM placed WHERE turn = 5),
piece AS (SELECT doc_id, kind, base, string_split(lower(t), 'the') AS p FROM node), part AS (SELECT doc_id, kind, base, len(p) AS n, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS i FROM piece)
SELECT doc_id, kind, "offset" FROM (SELECT doc_id, kind, (base + sum(length(x) + 3) OVER (PARTITION BY doc_id, kind, base ORDER BY i) - 3)::INT AS "offset", i, n FROM part) WHERE i < n""")
def md_find(spark, sf_dir):
    """A word in texts and code, never in formulas."""
    return markdown.find_in_nodes(markdown.nodes(formulas(spark, sf_dir), "doc_id"), "The", "doc_id").select("doc_id", "kind", "offset")


def papers(spark, sf_dir: str) -> DataFrame:
    """documents, letters only, as Markdown of ten kinds of lines: underlined headings, four kinds of links, tables and tasks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def line(t, i):
        odd, turn = F.floor((i + 1) / 10) % 2 == 1, (i + 1) % 10
        text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

        def made(t):
            w = text("w", F.regexp_extract(t, "[A-Za-z]*", 0))
            link = lambda *href: text("so [", t, "](", *href, ") it is")
            return (
                F.when(turn == 0, text("Q ", t)).when(turn == 1, F.when(odd, "===").otherwise("---"))
                .when(turn == 2, link("https://", w, ".org/x#f")).when(turn == 3, link("../f/", w, ".pdf?v=1")).when(turn == 4, link("./", w, ".MD#", w)).when(turn == 5, link("#", w))
                .when(turn == 6, text("| ", t, " | b |")).when(turn == 7, F.when(odd, "|---|:-:|").otherwise("|---x|--|"))
                .when(turn == 8, text(F.when(odd, "- [x] ").otherwise("* [ ] "), t)).otherwise("")
            )

        return let(F.regexp_replace(t, "[^A-Za-z ]", "x"), made)

    made = F.array_join(F.transform(lines.raw_lines(F.col("text")), line), "\n")
    return docs.select("doc_id", made.alias("text"), F.concat(F.lit("/n/s/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))


_PAPERS = _FENCED + r""", p AS (SELECT doc_id, line, line % 10 AS turn, line // 10 % 2 = 1 AS odd, regexp_replace(t, '[^A-Za-z ]', 'x', 'g') AS t FROM l),
w AS (SELECT *, 'w' || regexp_extract(t, '^[A-Za-z]*') AS w FROM p)
"""


@query("md_link_kinds", _PAPERS + """SELECT doc_id, line, 'external' AS kind, 'https://' || w || '.org/x#f' AS href, NULL AS target, NULL AS fragment FROM w WHERE turn = 2
UNION ALL SELECT doc_id, line, 'file', '../f/' || w || '.pdf?v=1', '/n/f/' || w || '.pdf', '' FROM w WHERE turn = 3
UNION ALL SELECT doc_id, line, 'doc', './' || w || '.MD#' || w, '/n/s/' || w || '.MD', w FROM w WHERE turn = 4
UNION ALL SELECT doc_id, line, 'anchor', '#' || w, '/n/s/' || doc_id || '.md', w FROM w WHERE turn = 5""")
def md_link_kinds(spark, sf_dir):
    """All four kinds; addresses and labels are made of the documents' words."""
    return markdown.links(papers(spark, sf_dir), "doc_id", F.col("path"))


@query("md_setext_outline", _PAPERS + r""", h AS (SELECT a.doc_id, a.line, rtrim('Q ' || a.t) AS head, CASE WHEN b.odd THEN 1 ELSE 2 END AS depth FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.line = a.line + 1 WHERE a.turn = 0),
c AS (SELECT *, regexp_replace(lower(head), ' +', '-', 'g') AS c FROM h)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line)::INT AS pos, depth, c || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS id, head AS text
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY line) AS k FROM c)""")
def md_setext_outline(spark, sf_dir):
    """Headings by the line under them; the last line of a document has none."""
    return markdown.outline(papers(spark, sf_dir), "doc_id")


@query("md_sections_all", _PAPERS + """SELECT d.doc_id, count(p.line) AS lines, count(*) FILTER (WHERE turn = 7 AND odd) AS tables, count(*) FILTER (WHERE turn = 8) AS tasks,
  count(*) FILTER (WHERE turn = 8 AND odd) AS tasks_done, 0 AS code_blocks, 0 AS math, 0 AS images FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY d.doc_id""")
def md_sections_all(spark, sf_dir):
    """Tables, open and done tasks, and documents without text."""
    return markdown.section_counts(papers(spark, sf_dir), "doc_id")
