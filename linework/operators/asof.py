"""As-of joins: each row meets the nearest row of another table, before or after its own place.

Both tables become one, dealt by ranges of (group, place), so a group that holds a third of all rows is cut over many
tasks. Within a range the last row of the other table is carried along; what a range begins with comes from the ranges before it, which are
a row per (group, range). There is no range join, and rows move as often as in a sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.plans.tables import materialise


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: list[str], name: str, backward: bool = True, strict: bool = False, wrap: bool = False) -> DataFrame:
    """``left`` with ``name``: the row of ``right`` (a struct of its columns but ``by``) with the same ``by`` and the greatest
    place ``on`` up to its own (backward) or the least from there on; null if there is none.

    ``strict`` leaves out the same place; ``wrap`` takes the last (first) row of the group where none is before (after).
    Null keys meet as equals; of rows of ``right`` at one place the greatest (least) counts; repeated rows of ``left`` repeat.
    """
    mine, other = [c for c in left.columns if c not in by + on], [c for c in right.columns if c not in by]
    found = F.struct(*[F.col(c) for c in other])
    # at one place: the other's rows come first, unless the same place doesn't count; that is turned round for the other direction
    first = F.lit(0 if backward != strict else 1)
    rows = left.select(*by, *on, (1 - first).alias("_side"), F.struct(*[F.col(c) for c in mine]).alias("_mine") if mine else F.struct(F.lit(1).alias("_")).alias("_mine"))
    others = right.select(*by, *on, first.alias("_side"), found.alias("_found"))
    both = rows.unionByName(others, allowMissingColumns=True).withColumn("_tie", F.xxhash64("_mine"))
    place = [*on, "_side"]
    dealt = materialise(both.repartitionByRange(*by, *place, "_found", "_tie").withColumn("_part", F.spark_partition_id()), "asof")
    turned = (lambda c: F.asc(c)) if backward else (lambda c: F.desc(c))
    within = Window.partitionBy(*by, "_part").orderBy(*map(turned, place), turned("_found"))
    carried = dealt.withColumn("_own", F.last("_found", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    # of each range the row that it hands on
    at = F.struct(*place, "_found")
    ends = dealt.groupBy(*by, "_part").agg((F.max if backward else F.min)(F.when(F.col("_found").isNotNull(), at)).alias("_end"))
    ranges = Window.partitionBy(*by).orderBy(turned("_part"))
    ends = ends.withColumn("_before", F.last("_end._found", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("_around", F.last("_end._found", ignorenulls=True).over(ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    same: Column = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_part"]])
    joined = carried.where("_mine is not null").alias("a").join(ends.alias("b"), same)
    taken = F.coalesce("a._own", "b._before", *(["b._around"] if wrap else []))
    of = lambda c: F.col(f"a.{c}") if c in by + on else F.col("a._mine")[c].alias(c)
    return joined.select(*[of(c) for c in left.columns], taken.alias(name))


def seek_hits(hits: DataFrame, cursors: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``cursors`` with next_hit and prev_hit: the nearest hits behind and before each cursor, around the ends; null in a
    group without hits. A hit at the cursor's own place is neither, unless it is the only one."""
    places = hits.select(group, *order)
    found = asof_join(cursors, places, [group], order, "next_hit", backward=False, strict=True, wrap=True)
    return asof_join(found, places, [group], order, "prev_hit", backward=True, strict=True, wrap=True)


def offsets_to_lines(offsets: DataFrame, places: DataFrame, id_col: str = "doc_id", at: str = "at") -> DataFrame:
    """``offsets`` (id, at) with lines: the complete lines that end at or before each byte offset. ``places`` as of line_bytes()."""
    ends = places.where("complete").select(id_col, (F.col("byte_offset") + F.col("bytes")).alias(at), "file_line")
    found = asof_join(offsets, ends, [id_col], [at], "_end")
    return found.select(*offsets.columns, F.coalesce("_end.file_line", F.lit(0)).cast("long").alias("lines"))
