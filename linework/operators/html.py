"""HTML pages: text nodes, find in them, and an audit of unsafe markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linework.functions.arrays import let
from linework.functions.text import unescape_html
from linework.operators.filters import quoted

#: Tags and attributes that should not be in a document.
TAGS = ["style", "link", "meta", "base", "iframe", "frame", "frameset", "object", "embed", "form"]
ATTRIBUTES = ["srcset", "formaction", "ping", "autofocus"]


def _closed_only(html: Column, opener: str, closer: str) -> Column:
    """``html`` with a mark in what opens behind the last closer, so that no pattern looks for an end that isn't there."""
    def marked(html: Column, head: Column) -> Column:
        return F.concat(head, F.regexp_replace(F.substr(html, F.length(head) + 1), opener, "<\x01$1"))

    return let(html, lambda h: let(F.regexp_extract(h, rf"(?is)\A.*{closer}", 0), lambda head: marked(h, head)))


def text_nodes(html: Column) -> Column:
    """array of the texts between tags, without scripts, styles, comments and blank ones."""
    for opener, closer in (("(?i)<(script\\b)", r"</script\s*>"), ("(?i)<(style\\b)", r"</style\s*>"), ("<(!--)", "-->")):
        html = _closed_only(html, opener, closer)
    shown = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "<x>")
    shown = F.replace(shown, F.lit("<\x01"), F.lit("<"))
    # what opens behind the last end is no tag
    tags = lambda h, head: F.concat(head, F.replace(F.substr(h, F.length(head) + 1), F.lit("<"), F.lit("\x01\x01")))
    shown = let(shown, lambda h: let(F.regexp_extract(h, r"(?s)\A.*>", 0), lambda head: tags(h, head)))
    cut = F.transform(F.split(shown, r"<[^>]*>", -1), lambda t: F.replace(t, F.lit("\x01\x01"), F.lit("<")))
    return F.filter(F.transform(cut, unescape_html), lambda t: t.rlike(r"\S"))


def find_in_pages(pages: DataFrame, term: str, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """(key, node, hits): hits of a term, in any case and without overlap, in each text node that has it."""
    # of the outer kind: for the other Spark infers a filter on the array's size, which makes the array again
    nodes = pages.select(key, F.posexplode_outer(text_nodes(F.col(html_col))).alias("node", "text"))
    hits = F.size(F.split(F.lower("text"), quoted(term.lower()), -1)) - 1
    return nodes.select(key, "node", hits.alias("hits")).where("hits > 0")


def unsafe_markup(pages: DataFrame, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """(key, category, name, n): forbidden tags and attributes, inline styles, event handlers and script urls."""
    html = F.col(html_col)
    category = lambda name, found: F.transform(found, lambda x: F.struct(F.lit(name).alias("category"), F.lower(x).alias("name")))
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)<({'|'.join(TAGS)})\b"), 1)
    opening = F.regexp_extract_all(html, F.lit(r"<[a-zA-Z][^>]*>"), 0)
    names = F.flatten(F.transform(opening, lambda t: F.regexp_extract_all(t, F.lit(r"""\s([a-zA-Z-]+)(?=\s*=|\s|/?>)(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?"""), 1)))
    low = F.transform(names, F.lower)
    urls = F.regexp_extract_all(html, F.lit(r"""(?i)\s(?:href|src|action)\s*=\s*["']?\s*(javascript):"""), 1)
    found = F.concat(
        category("tag", tags),
        category("attribute", F.filter(low, lambda x: x.isin(ATTRIBUTES))),
        category("style", F.filter(low, lambda x: x == "style")),
        category("handler", F.filter(low, lambda x: x.rlike(r"^on[a-z]+$"))),
        category("url", urls),
    )
    return pages.select(key, F.inline(found)).groupBy(key, "category", "name").agg(F.count(F.lit(1)).alias("n"))
