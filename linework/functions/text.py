"""Small text expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The length of a displayed text, and the pattern of a style attribute.
DISPLAY = 2000
STYLE = r"""(?i)\sstyle\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
#: Entities and what they stand for, in the order in which they are decoded.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def display_text(text: Column, mark: str = "…") -> Column:
    """Cut to DISPLAY code points, with a mark if something was cut."""
    return F.when(F.length(text) > DISPLAY, F.concat(F.substring(text, 1, DISPLAY), F.lit(mark))).otherwise(text)


def escape_html(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape_html(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def visible_text(html: Column) -> Column:
    """Without tags, entities decoded, trimmed."""
    return F.trim(unescape_html(F.regexp_replace(html, "<[^>]*>", "")))


def without_styles(html: Column) -> Column:
    """Without style attributes."""
    return F.regexp_replace(html, STYLE, "")


#: What a heading's id replaces, before and after it is put in lower case.
SLUG_MARKUP = [("`([^`]*)`", "$1"), ("[*_~]", ""), ("<[^>]*>", ""), (r"\[\^[^\]]+\]", ""), (r"^[\s　]+|(?<![\s　])[\s　]+$", "")]
SLUG_SIGNS = [(r"[!-/:-@\[-`{-~。，、；：？！「」『』（）《》【】…—]", ""), (r"[\s　]+", "-"), ("^-+|(?<!-)-+$", "")]


def _replaced(text: Column, patterns: list[tuple[str, str]]) -> Column:
    for pattern, to in patterns:
        text = F.regexp_replace(text, pattern, to)
    return text


def slug(text: Column) -> Column:
    """The id of a heading: lower case, without markup and punctuation, spaces as hyphens."""
    found = _replaced(F.lower(_replaced(text, SLUG_MARKUP)), SLUG_SIGNS)
    return F.when(found == "", "section").otherwise(found)


def stripped(text: Column) -> Column:
    """Without white space at both ends, in one pass whatever stands there."""
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _numbered_ids(ids: pd.Series) -> pd.Series:
    def numbered(bases: list[str] | None) -> list[str] | None:
        if bases is None:
            return None
        used, last, out = set(), {}, []
        for base in bases:
            name = base
            if base in used:
                n = last.get(base, 1) + 1
                while f"{base}-{n}" in used:
                    n += 1
                last[base], name = n, f"{base}-{n}"
            used.add(name)
            out.append(name)
        return out

    return ids.map(numbered)


def unique_ids(ids: Column) -> Column:
    """array of ids, each changed by -2, -3, ... where it, or what it became, came before. Arrays in which an id occurs twice
    go through a Python function, in time linear in their length."""
    repeats = F.size(F.array_distinct(ids)) < F.size(ids)
    return F.coalesce(_numbered_ids(F.when(repeats, ids)), ids)


#: Patterns of the kinds of failure, tried in this order.
MISSING = ["文件不存在", "路径不存在", "找不到", "no such file", "file not found", "cannot find the file", "系统找不到指定的文件", r"os error 2\b"]
MISSING_SCHEMA = r"schema\s*文件不存在"
DENIED = ["拒绝访问", "无权限", "权限不足", "permission denied", "access is denied", r"os error 5\b"]


def error_kind(message: Column) -> Column:
    """none, missing_schema (something is missing, and it is the schema), missing, denied or other."""
    message = F.coalesce(message, F.lit(""))
    has = lambda patterns: message.rlike("(?i)" + "|".join(patterns))
    missing = F.when(has([MISSING_SCHEMA]), "missing_schema").otherwise("missing")
    return F.when(message == "", "none").when(has(MISSING), missing).when(has(DENIED), "denied").otherwise("other")
