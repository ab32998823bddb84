"""Line filters: keywords with ASCII case folding, and a bounded regular expression."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: longest pattern that is used, in bytes.
MAX_PATTERN = 512
#: What Java accepts and the dialect of the filters does not: look-around, back-references, possessive
#: quantifiers and atomic groups.
_FOREIGN = re.compile(r"\(\?(=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+")
_WORD = "[0-9A-Za-z_]"
#: Borders of words of ASCII. Java's own are of Unicode even without the U flag, before Java 19.
_BORDERS = {"\\b": f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))", "\\B": f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"}


def quoted(literal: str) -> str:
    """A pattern that matches just this text."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def usable_pattern(pattern: str | None, ascii_classes: bool = False) -> str | None:
    """The pattern as Spark should run it: Unicode classes (or those of ASCII, borders of words included, as SQL's
    RE2 has them), a dot for all but LF; None if it is empty, too long, invalid or of another dialect, which means
    no filter."""
    if not pattern or len(pattern.encode()) > MAX_PATTERN or _FOREIGN.search(pattern):
        return None
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?Ud)" + pattern)
    except Exception:  # py4j wraps PatternSyntaxException
        warnings.warn(f"not a usable pattern, nothing is filtered: {pattern!r}", stacklevel=2)
        return None
    if ascii_classes:
        return "(?d)" + re.sub(r"\\Q.*?(?:\\E|\Z)|\\.", lambda m: _BORDERS.get(m[0], m[0]), pattern, flags=re.S)
    return "(?Ud)" + pattern


@dataclass(frozen=True)
class FilterSpec:
    """Keywords, any of which is enough, and a pattern; both given are joined by OR."""

    keywords: tuple[str, ...] = ()
    regex: str | None = None
    case_sensitive: bool = False
    ascii_classes: bool = False

    @classmethod
    def phrase(cls, typed: str, case_sensitive: bool = False) -> FilterSpec:
        """Keyword mode: what is typed, trimmed, is one phrase."""
        typed = typed.strip()
        return cls((typed,) if typed else (), None, case_sensitive)

    @classmethod
    def pattern(cls, typed: str, ascii_classes: bool = False) -> FilterSpec:
        """Pattern mode."""
        return cls((), typed.strip() or None, ascii_classes=ascii_classes)

    def condition(self, text: Column) -> Column | None:
        """A predicate on a text column; None if nothing is filtered."""
        found = None
        if self.keywords:
            if self.case_sensitive:
                for k in self.keywords:
                    one = F.contains(text, F.lit(k))
                    found = one if found is None else found | one
            else:
                found = text.rlike("(?i)" + "|".join(map(quoted, self.keywords)))
        if (pattern := usable_pattern(self.regex, self.ascii_classes)) is not None:
            found = text.rlike(pattern) if found is None else found | text.rlike(pattern)
        return found

    @property
    def is_active(self) -> bool:
        """True only if something is really filtered."""
        return bool(self.keywords) or usable_pattern(self.regex, self.ascii_classes) is not None


def filter_lines(lines: DataFrame, spec: FilterSpec, text_col: str = "text") -> DataFrame:
    """The rows whose text passes."""
    condition = spec.condition(F.col(text_col))
    return lines if condition is None else lines.where(condition)


def matches_term(text: Column, term: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """Whether a text has a term; Unicode folding, and whole words by Unicode letters, digits and _."""
    if not term:
        return F.lit(False)
    if not case_sensitive:
        text, term = F.lower(text), term.lower()
    if whole_word:
        return text.rlike(r"(?<![\p{L}\p{N}_])" + quoted(term) + r"(?![\p{L}\p{N}_])")
    return F.contains(text, F.lit(term))


def term_report(lines: DataFrame, terms: list[tuple[str, bool, bool]], text_col: str = "text") -> DataFrame:
    """(term, case_sensitive, whole_word, lines): lines with at least one hit, all terms in one pass."""
    text = F.col(text_col)
    sums = lines.agg(*[F.count_if(matches_term(text, *t)).alias(f"n{i}") for i, t in enumerate(terms)])
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("term", "case_sensitive", "whole_word"), t, strict=True)], F.col(f"n{i}").alias("lines")) for i, t in enumerate(terms)]
    return sums.select(F.inline(F.array(*rows)))
