"""Find every hit of a text in lines: places, pages, scopes, segments.

Two rules live side by side: ``search_lines`` takes hits from left to right without overlap, folds
ASCII letters and tells words by bytes; ``find_spans`` allows overlaps, folds Unicode and tells words
by Unicode classes. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.functions.arrays import let
from linework.operators.filters import FilterSpec, filter_lines, matches_term, quoted

#: Most hits of a page, and of a search in cells.
HIT_CAP = 100_000
CELL_CAP = 5000
#: Pieces of a line whose places are summed together.
CHUNK = 500


def _ends(pieces: Column, gap: int) -> Column:
    """array<int>: where each piece but the last ends, with ``gap`` code points between pieces.

    Sums run within chunks and over chunks, so a line of 100,000 hits takes no quadratic copying.
    """
    none = F.array().cast("array<int>")

    def running(start: Column, sizes: Column) -> Column:
        """start, start + first size, start + first + second size, ...: one for each size."""
        return F.aggregate(
            sizes,
            F.struct(start.alias("end"), none.alias("at")),
            lambda acc, size: F.struct((acc["end"] + size).alias("end"), F.array_append(acc["at"], acc["end"]).alias("at")),
        )["at"]

    def over(pieces: Column) -> Column:
        lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) + gap)
        return F.when(F.size(pieces) > 1, let(lengths, lambda every: let(chunked(every), ends))).otherwise(none)

    def chunked(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int")), lambda c: F.slice(every, c * CHUNK + 1, F.lit(CHUNK)))

    def ends(sizes: Column) -> Column:
        starts = running(F.lit(0), F.transform(sizes, lambda chunk: F.aggregate(chunk, F.lit(0), lambda a, b: a + b)))
        return F.flatten(F.zip_with(sizes, starts, lambda chunk, start: F.zip_with(running(start, chunk), chunk, lambda at, size: at + size - gap)))

    return let(pieces, over)


def hit_offsets(text: Column, pieces: Column, n: int, whole_word: bool = False) -> Column:
    """array of code-point offsets of the hits of length ``n`` that cut a text into ``pieces``."""
    offsets = _ends(pieces, n)
    if whole_word:  # after the cut: a hit that is no word still uses up its text
        word = r"[A-Za-z0-9_\x{80}-\x{10FFFF}]"
        at = lambda i: F.substring(text, i + 1, F.lit(1)).rlike(word)
        offsets = F.filter(offsets, lambda i: ~((i > 0) & at(F.greatest(i - 1, F.lit(0)))) & ~at(i + n))
    return offsets


def search_lines(lines: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False, text_col: str = "text") -> DataFrame:
    """The rows' other columns and offset: one row per hit. A blank query has none."""
    rest = [c for c in lines.columns if c != text_col]
    if not query.strip():
        return lines.select(*rest, F.lit(0).alias("offset")).limit(0)
    having = filter_lines(lines, FilterSpec((query,), None, case_sensitive), text_col)
    cut = F.split(text_col, ("" if case_sensitive else "(?i)") + quoted(query), -1)
    having = having.select(*rest, F.col(text_col).alias("_text"), cut.alias("_pieces"))
    return having.select(*rest, F.explode(hit_offsets(F.col("_text"), F.col("_pieces"), len(query), whole_word)).alias("offset"))


def search_page(hits: DataFrame, order: list[str], cap: int = HIT_CAP, after: tuple | None = None) -> DataFrame:
    """The first ``cap`` hits in order, after the place ``after`` if given, with is_last: the page reaches
    the end."""
    if after is not None:
        place = F.struct(*[F.col(c) for c in order])
        hits = hits.where(place > F.struct(*[F.lit(v).cast(hits.schema[c].dataType) for c, v in zip(order, after, strict=True)]))
    page = hits.orderBy(*order).limit(cap + 1)  # a top-k: each task keeps cap + 1 rows
    numbered = page.withColumn("_k", F.row_number().over(Window.orderBy(*order)))
    more = F.max(F.col("_k") > cap).over(Window.partitionBy())
    return numbered.withColumn("is_last", ~more).where(F.col("_k") <= cap).drop("_k")


def search_scope(lines: DataFrame, spec: FilterSpec, query: str, id_col: str = "doc_id", **options) -> tuple[DataFrame, DataFrame]:
    """(hits, totals): an active filter narrows the search to the lines that pass; totals has each text's
    number of lines in scope."""
    scope = filter_lines(lines, spec)
    return search_lines(scope, query, **options), scope.groupBy(id_col).agg(F.count(F.lit(1)).alias("scope_total"))


def next_hits(hits: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Each hit with the place of the next and of the previous one, around the ends."""
    place = F.struct(*order)
    within = Window.partitionBy(group).orderBy(*order)
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hits.withColumn("next_hit", F.coalesce(F.lead(place).over(within), F.first(place).over(whole))).withColumn(
        "prev_hit", F.coalesce(F.lag(place).over(within), F.last(place).over(whole))
    )


def find_spans(text: Column, term: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """array<struct<start, end>> of all hits, overlapping ones too, in the (folded) text."""
    if not case_sensitive:
        text, term = F.lower(text), term.lower()
    n = len(term)
    starts = _ends(F.split(text, f"(?={quoted(term)})", -1), 0)  # a cut before every hit but one at the start
    starts = F.when(F.startswith(text, F.lit(term)), F.concat(F.array(F.lit(0)), starts)).otherwise(starts)
    if whole_word:
        word = r"[\p{L}\p{N}_]"
        starts = F.filter(starts, lambda i: ~((i > 0) & F.substring(text, i, F.lit(1)).rlike(word)) & ~F.substring(text, i + n + 1, F.lit(1)).rlike(word))
    spans = F.transform(starts, lambda i: F.struct(i.alias("start"), (i + n).alias("end")))
    return F.when(matches_term(text, term, True), spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def merged_spans(spans: Column) -> Column:
    """Spans of one length in order, with overlapping ones joined: one begins where the span before has ended."""
    none = F.lit(None).cast("int")
    ends = F.concat(F.array(none), F.transform(spans, lambda s: s["end"]))  # of the span before
    starts = F.concat(F.slice(F.transform(spans, lambda s: s["start"]), F.lit(2), F.greatest(F.size(spans), F.lit(1))), F.array(none))  # of the next one
    begins = F.filter(F.zip_with(spans, ends, lambda s, e: F.when(s["start"] < e, none).otherwise(s["start"])), lambda x: x.isNotNull())
    finishes = F.filter(F.zip_with(spans, starts, lambda s, n: F.when(n < s["end"], none).otherwise(s["end"])), lambda x: x.isNotNull())
    return F.zip_with(begins, finishes, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def search_segments(text: Column, term: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """array<struct<text, find>>: a text cut into hits and what lies between."""
    spans = merged_spans(find_spans(text, term, case_sensitive, whole_word))
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    begins = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    gaps = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda z: F.struct(F.substring(text, z["a"] + 1, z["b"] - z["a"]).alias("text"), F.lit(False).alias("find")))
    hits = F.transform(spans, lambda s: F.struct(F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text"), F.lit(True).alias("find")))
    both = F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), hits.alias("h")), lambda z: F.array(z["g"], z["h"])))
    return F.filter(both, lambda s: s.isNotNull() & (s["text"] != ""))


def keyword_segments(text: Column, typed: str) -> Column:
    """array<struct<text, keyword>>: a text cut at the typed keywords (split at spaces, any case; of two
    that begin at one place the first typed); keyword is its number, null in between."""
    keywords = typed.split()
    if not keywords:
        return F.array(F.struct(text.alias("text"), F.lit(None).cast("int").alias("keyword")))
    pattern = "(?iu)" + "|".join(map(quoted, keywords))
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    number = lambda hit: F.coalesce(*[F.when(F.lower(hit) == k.lower(), i) for i, k in enumerate(keywords)])
    none = F.lit(None).cast("int")
    zipped = F.transform(
        F.arrays_zip(gaps.alias("g"), hits.alias("h")),
        lambda z: F.array(F.struct(z["g"].alias("text"), none.alias("keyword")), F.struct(z["h"].alias("text"), number(z["h"]).alias("keyword"))),
    )
    return F.filter(F.flatten(zipped), lambda s: s["text"].isNotNull() & (s["text"] != ""))


def segments(text: Column, term: str, typed: str, case_sensitive: bool = False, whole_word: bool = False) -> Column:
    """array<struct<text, find, keyword>>: search hits win, keywords colour what lies between."""
    none = F.lit(None).cast("int")
    piece = lambda text, find, keyword: F.struct(text.alias("text"), find.alias("find"), keyword.alias("keyword"))
    return F.flatten(
        F.transform(
            search_segments(text, term, case_sensitive, whole_word),
            lambda s: F.when(s["find"], F.array(piece(s["text"], F.lit(True), none))).otherwise(
                F.transform(keyword_segments(s["text"], typed), lambda k: piece(k["text"], F.lit(False), k["keyword"]))
            ),
        )
    )


def cell_hits(rows: DataFrame, term: str, number: str = "row_no", cells: str = "cells", **options) -> DataFrame:
    """(row, col) of all cells that have the term."""
    found = rows.select(F.col(number).alias("row"), F.posexplode(cells).alias("col", "_cell")).where(matches_term(F.col("_cell"), term, **options))
    return found.select("row", "col")


def find_in_cells(rows: DataFrame, term: str, number: str = "row_no", cells: str = "cells", cap: int = CELL_CAP, after: tuple[int, int] | None = None, **options) -> DataFrame:
    """(row, col) of the first ``cap`` cells in row order that have the term, and capped; those behind the place ``after`` (row, col)."""
    found = cell_hits(rows, term, number, cells, **options)
    if after is not None:
        row, col = map(F.lit, after)
        found = found.where((F.col("row") > row) | ((F.col("row") == row) & (F.col("col") > col)))
    page = found.orderBy("row", "col").limit(cap)
    return page.withColumn("capped", F.count(F.lit(1)).over(Window.partitionBy()) >= cap)


def hits_by_row(hits: DataFrame) -> DataFrame:
    """(row, cols): the sorted columns with a hit."""
    return hits.groupBy("row").agg(F.array_sort(F.collect_set("col")).alias("cols"))
