"""Structure of Markdown documents, as tables over a corpus.

Documents are (key, text). A document's lines are an array with a flag for fenced code, found by a fold over the lines that look
like fences, whose state is the open fence's sign and length; everything else is a pattern per line, read where the document lies. The
documented constructs are read, not all of CommonMark. No pattern or fold takes more than a few passes over a line or document.

Arrays are taken apart by generators of the outer kind: for the others Spark infers a filter on the array's size, which it
pushes down and so evaluates the whole array, and all it is made of, again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions import paths
from linework.functions.arrays import CHUNK, let, running
from linework.functions.text import slug, stripped, unique_ids, visible_text
from linework.operators.filters import quoted
from linework.operators.search import hit_offsets

#: The patterns of the constructs.
FENCE = r"^ {0,3}(`{3,}|~{3,})"
ATX = r"^ {0,3}(#{1,6})(?![^ \t])[ \t]*+(.*+)$"
ATX_END = r"(?<![^ \t])#++\z"
RULE = r"^ {0,3}(=+|-+)[ \t]*$"
DEFINITION = r"^ {0,3}\[\^([^\]\s]+)\]\s*:\s*(.*)$"
CONTINUATION = r"^ {2,}(\S.*)$"
REFERENCE = r"\[\^([^\]\s]+)\]"
TARGET = r"\(\s*<?([^)\s>]+)>?(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)"
LINK = r"(?<!!)\[([^\[\]]*(?:!\[[^\]]*\]\([^)]*\)[^\[\]]*)*+)\]" + TARGET
IMAGE = r"!\[([^\]!]*+(?:!(?!\[)[^\]!]*+)*+)\]" + TARGET
RAW_IMAGE, SOURCE = r"(?i)<img\b[^>]*>", r"(?i)\bsrc\s*="
NUMERIC = r"[0-9\s.,%+\-*/:]+"
MATH = (
    r"(?m:^\$\$\n[\s\S]+?\n\$\$(?=\n|\z))|(?m:^\\\[[\s\S]+?\\\](?=[ \t]*(?:\n|\z)))"
    r"|\\\([\s\S]*?[^\s\\]\\\)|(\${1,2})(?!" + NUMERIC + r"\1)[^\s$](?:[^$\n]*[^\s$])?\1(?!\d)"
)


def _settled(rows: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """Columns of which each is evaluated once. A column that a lambda reads would otherwise be put in its place there,
    and evaluated for each element; a generator of one row stands between."""
    return rows.select(*keep, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def _fence_marks(texts: Column, looks: Column) -> Column:
    """array<struct<sign, n, bare, opens>> of the lines that look like fences."""
    marks = F.transform(F.filter(F.zip_with(texts, looks, lambda t, f: F.struct(t.alias("t"), f.alias("f"))), lambda x: x["f"]), lambda x: x["t"])
    of = lambda t: F.regexp_extract(t, FENCE, 1)
    rest = lambda t: F.regexp_replace(t, FENCE, "")
    return F.transform(
        marks,
        lambda t: F.struct(
            F.left(of(t), F.lit(1)).alias("sign"), F.length(of(t)).alias("n"), (F.trim(rest(t), F.lit(" \t")) == "").alias("bare"),
            (F.startswith(of(t), F.lit("~")) | ~F.contains(rest(t), F.lit("`"))).alias("opens"),
        ),
    )


def _real_fences(fences: Column) -> Column:
    """array<boolean>: which of the lines that look like fences open or close a block. ``fences`` is a settled column.

    A block is closed by a bare fence of the sign it was opened with that is as long at least; all between is code. A
    fence of backticks with a backtick behind it opens nothing. The fold goes over chunks of fences, so that no long array is copied.
    """
    none = F.array().cast("array<boolean>")

    def step(acc: Column, x: Column) -> Column:
        closed = acc["sign"] == ""
        real = F.when(closed, x["opens"]).otherwise((x["sign"] == acc["sign"]) & (x["n"] >= acc["n"]) & x["bare"])
        sign = F.when(~real, acc["sign"]).when(closed, x["sign"]).otherwise("")
        return F.struct(sign.alias("sign"), F.when(real & closed, x["n"]).otherwise(acc["n"]).alias("n"), F.array_append(acc["real"], real).alias("real"))

    def chunk(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["sign"].alias("sign"), acc["n"].alias("n"), none.alias("real")), step)
        return F.struct(inner["sign"].alias("sign"), inner["n"].alias("n"), F.array_append(acc["parts"], inner["real"]).alias("parts"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(fences) - 1) / CHUNK).cast("int")), lambda c: F.slice(fences, c * CHUNK + 1, F.lit(CHUNK)))
    begin = F.struct(F.lit("").alias("sign"), F.lit(0).alias("n"), F.array().cast("array<array<boolean>>").alias("parts"))
    return F.when(F.size(fences) > 0, F.flatten(F.aggregate(chunks, begin, chunk)["parts"])).otherwise(none)


def line_arrays(docs: DataFrame, key: str, text_col: str = "text", keep: tuple[str, ...] = (), toggle: bool = False) -> DataFrame:
    """(key, kept columns, ls): of every document an array of (line, text, is_fence, fences, outside): line from
    1; fences is the number of fences before the line; outside is neither a fence nor in code. With ``toggle`` any fence opens
    or closes, whatever its sign and length."""
    cut = F.transform(F.split(F.coalesce(text_col, F.lit("")), "\n", -1), lambda t: F.regexp_replace(t, r"\r\z", ""))
    ones = F.transform("_is", lambda f: f.cast("int"))
    rows = _settled(docs, key, *keep, _texts=cut)
    rows = _settled(rows, key, *keep, "_texts", _is=F.transform("_texts", lambda t: t.rlike(FENCE)))
    rows = _settled(_settled(rows, key, *keep, "_texts", "_is", _ones=ones), key, *keep, "_texts", "_is", _before=running(F.col("_ones")))
    if not toggle:
        rows = _settled(rows, key, *keep, "_texts", "_is", "_before", _marks=_fence_marks(F.col("_texts"), F.col("_is")))
        rows = _settled(rows, key, *keep, "_texts", "_is", "_before", _real=_real_fences(F.col("_marks")))
        real = F.zip_with("_is", "_before", lambda f, n: f & F.coalesce(F.get("_real", n.cast("int")), F.lit(False)))
        rows = _settled(rows, key, *keep, "_texts", _is=real)
        rows = _settled(_settled(rows, key, *keep, "_texts", "_is", _ones=ones), key, *keep, "_texts", "_is", _before=running(F.col("_ones")))

    def line(x: Column, i: Column) -> Column:
        outside = ~x["f"] & (x["n"] % 2 == 0)
        return F.struct((i + 1).alias("line"), x["t"].alias("text"), x["f"].alias("is_fence"), x["n"].alias("fences"), outside.alias("outside"))

    return _settled(rows, key, *keep, ls=F.transform(F.arrays_zip(F.col("_texts").alias("t"), F.col("_is").alias("f"), F.col("_before").alias("n")), line))


def _outside_code(docs: DataFrame, key: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept columns, ls): (line, text) outside fenced code, without inline code."""
    ls = F.transform(F.filter("ls", lambda x: x["outside"]), lambda x: F.struct(x["line"].alias("line"), F.regexp_replace(x["text"], "`[^`]*`", "").alias("text")))
    return line_arrays(docs, key, text_col, keep).select(key, *keep, ls.alias("ls"))


def plain(text: Column) -> Column:
    """A heading without its markup."""
    for pattern, to in [(r"\[\^[^\]]+\]", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), ("`([^`]*)`", "$1"), (r"(\*\*|__|~~)(\S.*?)\1", "$2"), (r"\*([^*\s][^*]*)\*", "$1")]:
        text = F.regexp_replace(text, pattern, to)
    return visible_text(text)


def outline(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, pos, depth, id, text) of the headings outside code, ids unique in each document."""
    rows = line_arrays(docs, key, text_col)
    under = F.concat(F.slice("ls", F.lit(2), F.size("ls")), F.array(F.element_at("ls", -1)))  # of the last line, itself
    pairs = F.filter(F.arrays_zip(F.col("ls").alias("x"), under.alias("u")), lambda z: z["x"]["outside"])
    paragraph = lambda t: ~t.rlike(r"^(\s*$| {0,3}([#>|]|[-*+] |\d+[.)] )| {4}|\t)") & ~t.rlike(RULE)

    ended = lambda t: F.rtrim(t, F.lit(" \t"))
    title = lambda t: ended(F.regexp_replace(ended(F.regexp_extract(t, ATX, 2)), ATX_END, ""))

    def head(z: Column) -> Column:
        text, atx = z["x"]["text"], z["x"]["text"].rlike(ATX)
        below = z["u"]["outside"] & (z["u"]["line"] > z["x"]["line"])
        mark = F.when(below, F.regexp_extract(z["u"]["text"], RULE, 1)).otherwise("")
        depth = F.when(atx, F.length(F.regexp_extract(text, ATX, 1))).when(paragraph(text) & (mark != ""), F.when(F.startswith(mark, F.lit("=")), 1).otherwise(2))
        return F.struct(depth.alias("depth"), F.when(atx, title(text)).otherwise(F.trim(text)).alias("head"))

    found = _settled(rows, key, heads=F.filter(F.transform(pairs, head), lambda h: h["depth"].isNotNull()))
    found = found.select(key, "heads", unique_ids(F.transform("heads", lambda h: slug(h["head"]))).alias("ids"))
    rows = found.select(key, F.posexplode_outer(F.arrays_zip(F.col("heads").alias("h"), F.col("ids").alias("i"))).alias("_pos", "x")).where("_pos is not null")
    return rows.select(key, (F.col("_pos") + 1).alias("pos"), F.col("x.h.depth").alias("depth"), F.col("x.i").alias("id"), plain(F.col("x.h.head")).alias("text"))


def footnotes(docs: DataFrame, key: str, text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(used, dangling, unused): used has (key, number, id, text, line) in the order of first reference;
    dangling has (key, id) of references without a definition; unused has (key, id, line)."""
    # a definition runs on over the indented lines right behind it; a fence ends it
    is_def = lambda x: x["outside"] & x["text"].rlike(DEFINITION)
    is_more = lambda x: x["outside"] & x["text"].rlike(CONTINUATION) & ~x["text"].rlike(DEFINITION)
    rows = line_arrays(docs, key, text_col, toggle=True)
    rows = rows.select(key, "ls", F.transform(F.filter("ls", lambda x: ~is_more(x)), lambda x: x["line"]).alias("starts"))
    rows = rows.select(key, "ls", F.filter(F.arrays_zip(F.col("starts").alias("a"), F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array((F.size("ls") + 1).cast("int"))).alias("b")), lambda z: z["a"].isNotNull()).alias("parts"))
    lead = F.when(F.size("parts") > 0, F.slice("ls", F.lit(1), F.element_at("parts", 1)["a"] - 1)).otherwise(F.col("ls"))  # before the first part
    parts = F.transform("parts", lambda z: F.slice("ls", z["a"], z["b"] - z["a"]))
    rows = rows.select(key, lead.alias("lead"), parts.alias("parts"))
    defs = F.filter("parts", lambda p: is_def(p[0]))
    piece = lambda x: F.when(is_def(x), F.regexp_extract(x["text"], DEFINITION, 2)).otherwise(F.regexp_extract(x["text"], CONTINUATION, 1))
    whole = lambda p: stripped(F.array_join(F.transform(p, piece), " "))
    made = F.transform(defs, lambda p: F.struct(p[0]["line"].alias("line"), F.regexp_extract(p[0]["text"], DEFINITION, 1).alias("id"), whole(p).alias("text")))
    defined = rows.select(key, F.inline_outer(made)).select(key, "id", "line", "text").where("text != ''")
    rest = F.filter(F.concat("lead", F.flatten(F.filter("parts", lambda p: ~is_def(p[0])))), lambda x: x["outside"])
    defined = defined.groupBy(key, "id").agg(F.min(F.struct("line", "text")).alias("d")).select(key, "id", "d.line", "d.text")
    ids = rows.select(key, F.inline_outer(F.transform(rest, lambda x: F.struct(x["line"].alias("line"), x["text"].alias("text")))))
    ids = ids.select(key, "line", "text", F.explode_outer(F.regexp_extract_all("text", F.lit(REFERENCE), 1)).alias("id")).where("id is not null")
    place = F.struct("line", F.instr("text", F.concat(F.lit("[^"), F.col("id"), F.lit("]"))).alias("col"))
    refs = ids.groupBy(key, "id").agg(F.min(place).alias("at"))
    used = defined.join(refs, [key, "id"]).withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("at")))
    return (
        used.select(key, "number", "id", "text", "line"),
        refs.join(defined, [key, "id"], "left_anti").select(key, "id"),
        defined.join(refs, [key, "id"], "left_anti").select(key, "id", "line"),
    )


def links(docs: DataFrame, key: str, path: Column, text_col: str = "text") -> DataFrame:
    """(key, line, kind, href, target, fragment): kind is anchor, external, doc or file; targets of the
    last two are resolved against ``path``."""
    rows = _outside_code(docs.withColumn("_path", path), key, text_col, ("_path",)).select(key, "_path", F.inline_outer("ls"))
    found = rows.select(key, "line", "_path", F.explode_outer(F.regexp_extract_all("text", F.lit(LINK), 2)).alias("href")).where("href is not null")
    found = _settled(found, key, "line", "_path", "href", _target=paths.resolved(F.col("_path"), F.col("href")))
    href, target = F.col("href"), F.col("_target")
    kind = F.when(F.startswith(href, F.lit("#")), "anchor").when(paths.has_scheme(href), "external").when(paths.is_markdown(target), "doc").otherwise("file")
    found = found.withColumn("kind", kind).withColumn("target", F.when(F.col("kind").isin("doc", "file"), target).when(F.col("kind") == "anchor", F.col("_path")))
    return found.select(key, "line", "kind", "href", "target", F.when(~paths.has_scheme(href), paths.fragment(href)).alias("fragment"))


def dangling_links(found: DataFrame, outlines: DataFrame, path_of: DataFrame, key: str) -> DataFrame:
    """Links within the corpus whose fragment is no heading of their target. ``path_of`` has key and path."""
    heads = outlines.join(path_of, key).select(F.col("path").alias("target"), F.col("id").alias("fragment"))
    inside = found.where("kind in ('anchor', 'doc') and fragment != ''")
    return inside.join(heads, ["target", "fragment"], "left_anti")


def images(docs: DataFrame, key: str, path: Column, text_col: str = "text") -> DataFrame:
    """(key, line, kind, src, target, label): Markdown images and raw <img>; one without a source is left out."""
    rows = _outside_code(docs.withColumn("_path", path), key, text_col, ("_path",)).select(key, "_path", F.inline_outer("ls"))
    attr = lambda name: F.concat(*[F.regexp_extract("tag", rf"(?i)\b{name}\s*=\s*{q}", 1) for q in ('"([^"]*)"', "'([^']*)'", "([^\\s>\"']+)")])
    written = rows.select(key, "line", "_path", F.explode_outer(F.regexp_extract_all("text", F.lit(IMAGE), 0)).alias("tag")).where("tag is not null")
    written = written.select(key, "line", "_path", F.regexp_extract("tag", IMAGE, 2).alias("src"), F.regexp_extract("tag", IMAGE, 1).alias("alt"))
    raw = rows.select(key, "line", "_path", F.explode_outer(F.regexp_extract_all("text", F.lit(RAW_IMAGE), 0)).alias("tag")).where("tag is not null")
    raw = raw.where(F.col("tag").rlike(SOURCE)).select(key, "line", "_path", attr("src").alias("src"), attr("alt").alias("alt"))
    found = written.unionByName(raw)
    found = _settled(found, key, "line", "_path", "src", "alt", _local=~paths.has_scheme(F.col("src")))
    local = F.col("_local")
    found = _settled(found, key, "line", "src", "alt", "_local", _target=F.when(local, paths.resolved(F.col("_path"), F.col("src"))).otherwise(F.col("src")))
    target = F.col("_target")
    kind = F.when(~local, "url").when(paths.is_image(target), "file").otherwise("path")
    label = F.coalesce(F.nullif(F.trim("alt"), F.lit("")), F.when(local, paths.base_name(target)).otherwise(F.col("src")))
    return found.select(key, "line", kind.alias("kind"), "src", target.alias("target"), label.alias("label"))


def _formulas(ls: Column | str) -> Column:
    """array of the formulas in (line, text) outside code."""
    return F.regexp_extract_all(F.array_join(F.transform(ls, lambda x: x["text"]), "\n"), F.lit(MATH), 0)


def math_spans(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, display, tex) of the formulas outside code."""
    found = _outside_code(docs, key, text_col).select(key, F.explode_outer(_formulas("ls")).alias("raw")).where("raw is not null")
    tex = stripped(F.regexp_replace("raw", r"\A(\$\$?|\\[(\[])|(\$\$?|\\[)\]])\z", ""))
    return found.select(key, F.col("raw").rlike(r"\A(\$\$|\\\[)").alias("display"), tex.alias("tex"))


def code_blocks(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, line, lang): where each fenced block opens, and the first word after its fence."""
    opening = line_arrays(docs, key, text_col).select(key, F.inline_outer("ls")).where("is_fence and fences % 2 = 0")
    return opening.select(key, "line", F.regexp_extract("text", FENCE + r"\s*([^\s`]*)", 2).alias("lang"))


def _is_table_rule(text: Column) -> Column:
    """Whether a line is the one under a table's head: cells of dashes, each but the last ended by a bar."""
    cells = F.split(F.regexp_replace(text, r"^ {0,3}\|?", ""), r"\|", -1)
    ended = F.slice(cells, F.lit(1), F.greatest(F.size(cells) - 1, F.lit(0)))
    return (F.size(cells) > 1) & F.forall(ended, lambda c: c.rlike(r"^\s*:?-+:?\s*$")) & F.element_at(cells, -1).rlike(r"^\s*(:?-+:?\s*)?$")


def section_counts(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, lines, tables, tasks, tasks_done, code_blocks, math, images) of every document."""
    empty = F.coalesce(text_col, F.lit("")) == ""
    total = F.when(empty, 0).otherwise(F.size(F.split(text_col, "\n", -1))).cast("long")
    rows = line_arrays(docs.withColumn("_total", total), key, text_col, ("_total",))
    plain_lines = F.transform(F.filter("ls", lambda x: x["outside"]), lambda x: F.struct(x["line"].alias("line"), F.regexp_replace(x["text"], "`[^`]*`", "").alias("text")))
    rows = rows.select(key, "_total", "ls", plain_lines.alias("_plain"))
    having = lambda test: F.size(F.filter("ls", test)).cast("long")
    outside = lambda pattern: having(lambda x: x["outside"] & x["text"].rlike(pattern))
    of = lambda pattern, keep: F.transform("_plain", lambda x: F.size(F.filter(F.regexp_extract_all(x["text"], F.lit(pattern), F.lit(0)), keep)))
    added = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select(
        key,
        F.col("_total").alias("lines"),
        having(lambda x: x["outside"] & F.contains(x["text"], F.lit("|")) & _is_table_rule(x["text"])).alias("tables"),
        outside(r"^\s*[-*+] \[([ xX])\] ").alias("tasks"),
        outside(r"^\s*[-*+] \[[xX]\] ").alias("tasks_done"),
        having(lambda x: x["is_fence"] & (x["fences"] % 2 == 0)).alias("code_blocks"),
        F.size(_formulas("_plain")).cast("long").alias("math"),
        (added(of(IMAGE, lambda t: t != "")) + added(of(RAW_IMAGE, lambda t: t.rlike(SOURCE)))).alias("images"),
    )


#: What stands between the text nodes of a line: emphasis, brackets and targets of links, tags, marks of headings, lists and quotations.
INLINE = r"\n|\*\*|__|~~|[*_]|!?\[|\](?:\([^()\n]*+\))?|<[^<>\n]*+>|(?<![^\n]) {0,3}#{1,6}(?=[ \t])|(?<![^\n])[ \t]*+(?:[-+*]|\d{1,9}[.)])(?=[ \t])|(?<![^\n]) {0,3}>"


def _cut(text: Column, pattern: str) -> Column:
    """array<struct<hit, start, text>>: a text cut at a pattern, hits and what is between in order, with places in code points."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda z: F.array(F.struct(F.lit(False).alias("hit"), z["g"].alias("text")), F.struct(F.lit(True).alias("hit"), z["h"].alias("text")))))
    pieces = F.filter(pieces, lambda x: x["text"].isNotNull())
    placed = lambda x, at: F.struct(x["hit"].alias("hit"), at.cast("int").alias("start"), x["text"].alias("text"))
    return let(pieces, lambda ps: F.zip_with(ps, running(F.transform(ps, lambda x: F.length(x["text"]))), placed))


def nodes(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, node, kind, start, text): the texts, pieces of code and formulas of documents in their order, with their places in
    the source, in code points. A text node ends where markup is, as it does when the document is shown; blank ones are left out.
    Escapes and entities stand as they are in the source."""
    # the patterns' own marks may stand in a text
    text = F.translate(F.coalesce(text_col, F.lit("")), "\x01\x02", "\ufffd\ufffd")
    rows = line_arrays(docs.withColumn("_text", text), key, "_text", ("_text",)).withColumn("_raw", F.split("_text", "\n", -1))
    # fences and lines of code are covered by marks of the same length, for the patterns
    mark = lambda x: F.when(x["is_fence"], "\x02").when(~x["outside"], "\x01")
    covered = F.zip_with("ls", "_raw", lambda x, raw: F.coalesce(F.repeat(mark(x), F.length(raw)), raw))
    code = F.filter(F.zip_with("ls", "_raw", lambda x, raw: F.when(mark(x) == "\x01", raw)), lambda raw: raw != "")
    rows = _settled(rows, key, _code=code, _covered=F.array_join(covered, "\n"))
    rows = _settled(rows, key, "_code", _parts=_cut(F.col("_covered"), r"\x02+|\x01+|`[^`\n]*`|" + MATH))
    rows = rows.withColumn("_runs", running(F.transform("_parts", lambda p: F.startswith(p["text"], F.lit("\x01")).cast("int"))))
    node = lambda kind, start, text: F.struct(kind.alias("kind"), start.cast("int").alias("start"), text.alias("text"))

    none = F.array().cast("array<struct<kind: string, start: int, text: string>>")

    def of_part(p: Column, run: Column) -> Column:
        t, at = p["text"], p["start"]
        begins = lambda m: F.startswith(t, F.lit(m))
        inline = F.transform(F.filter(_cut(t, INLINE), lambda x: ~x["hit"]), lambda x: node(F.lit("text"), at + x["start"], x["text"]))
        code = F.when(begins("\x01"), node(F.lit("code"), at, F.get("_code", run.cast("int")))).when(begins("`"), node(F.lit("code"), at + 1, F.substr(t, F.lit(2), F.length(t) - 2)))
        return F.when(~p["hit"], inline).when(begins("\x02"), none).otherwise(F.array(F.coalesce(code, node(F.lit("math"), at, t))))

    found = F.filter(F.flatten(F.zip_with("_parts", "_runs", of_part)), lambda x: x["text"].rlike(r"\S"))
    return rows.select(key, F.posexplode_outer(found).alias("node", "x")).where("node is not null").select(key, "node", "x.kind", "x.start", "x.text")


def find_in_nodes(found: DataFrame, term: str, key: str, case_sensitive: bool = False) -> DataFrame:
    """(key, node, kind, offset): hits of a term without overlap in each node of nodes(), with their places in the source; a
    formula is never searched, and no hit goes over two nodes. A blank term has none."""
    fold = (lambda c: c) if case_sensitive else F.lower
    searched = found.where("kind != 'math'") if term.strip() else found.limit(0)
    searched = searched.where(F.contains(fold(F.col("text")), fold(F.lit(term))))
    pieces = F.split(fold(F.col("text")), quoted(term if case_sensitive else term.lower()), -1)
    rows = searched.select(key, "node", "kind", "start", F.explode_outer(hit_offsets(F.col("text"), pieces, len(term))).alias("_at")).where("_at is not null")
    return rows.select(key, "node", "kind", (F.col("start") + F.col("_at")).cast("int").alias("offset"))
