"""Paths and link targets as expressions; both separators count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of images and of Markdown.
IMAGES = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "ico", "avif"]
MARKDOWN = ["md", "markdown"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"\A([\s\S]*)[/\\][^/\\]*\z", 1)


def extension(path: Column) -> Column:
    """Lower case without the dot; '' for none and for a name that only begins with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"\A.+\.([^.]*)\z", 1))


def is_image(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(IMAGES)


def is_markdown(path: Column) -> Column:
    return extension(path).isin(MARKDOWN)


def has_scheme(href: Column) -> Column:
    """A scheme of at least two characters, so that a drive is none."""
    return href.rlike(r"(?i)\A[a-z][a-z0-9+.-]+:")


def fragment(href: Column) -> Column:
    """What follows the first #."""
    return F.regexp_extract(href, r"\A[^#]*#([\s\S]*)\z", 1)


def without_fragment(href: Column) -> Column:
    """What stands before # and ?."""
    return F.substring_index(F.substring_index(href, "#", 1), "?", 1)


def percent_decoded(text: Column) -> Column:
    """Decoded; unchanged if an escape is broken. A plus sign stays."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def folded(path: Column, separator: Column) -> Column:
    """Without empty, . and .. parts; a drive, a share or a root at the start stays, and .. goes not above it."""
    drive = F.regexp_extract(path, r"\A([A-Za-z]:)", 1)
    share = path.rlike(r"\A[/\\]{2}")
    root = (drive == "") & ~share & path.rlike(r"\A[/\\]")
    free = (drive == "") & ~share & ~root
    rest = F.regexp_replace(path, r"\A[A-Za-z]:", "")
    parts = F.filter(F.when(separator == "\\", F.split(rest, r"[/\\]", -1)).otherwise(F.split(rest, "/", -1)), lambda p: ~p.isin("", "."))
    none = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        none,
        lambda acc, p: F.when(p != "..", F.array_append(acc, p))
        .when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(free, F.array_append(acc, p))
        .otherwise(acc),
    )
    body = F.replace(F.array_join(kept, "\0"), F.lit("\0"), separator)
    return F.concat(F.when(share, F.concat(separator, separator)).when(drive != "", F.concat(drive, separator)).when(root, separator).otherwise(F.lit("")), body)


def resolved(document: Column, href: Column) -> Column:
    """A link's target as a path: relative to the document's folder, with the document's separator."""
    document = F.coalesce(document, F.lit(""))
    clean = without_fragment(href)
    separator = F.when((document == "") | F.contains(document, F.lit("\\")), F.lit("\\")).otherwise(F.lit("/"))
    local = percent_decoded(F.regexp_replace(clean, r"(?i)\Afile://", ""))
    local = F.when(clean.rlike(r"(?i)\Afile://") & local.rlike(r"(?i)\A/[a-z]:"), F.substring(local, F.lit(2), F.length(local))).otherwise(local)
    target = F.when(separator == "\\", F.regexp_replace(local, r"[/\\]+", r"\\\\")).otherwise(F.regexp_replace(local, r"[/\\]+", "/"))
    absolute = target.rlike(r"(?i)\A([a-z]:[/\\]|[/\\])")
    folder = directory(document)
    whole = F.when(absolute | (folder == ""), target).otherwise(F.concat(folder, separator, target))
    return folded(whole, separator)
