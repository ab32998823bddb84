"""Exact numbering within groups without putting a group into one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linework.plans.tables import materialise


def _same(a: str, b: str, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, size: Column | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, ... within ``group`` by ``order``, or the sum of ``size`` up to the row.

    Rows are dealt by ranges of (group, order), so a group holding a third of all rows is cut over
    many tasks; each piece is numbered by itself and shifted by the sizes of the pieces before it.
    """
    size = F.lit(1) if size is None else size
    dealt = materialise(df.repartitionByRange(*group, *order).withColumns({"_part": F.spark_partition_id(), "_size": size.cast("long")}), "numbered")
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy(*group, "_part").agg(F.sum("_size").alias("_sum"))
    shifts = shifts.withColumn("_shift", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where("_shift > 0").drop("_sum")
    upto = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_own", F.sum("_size").over(upto))
    joined = own.alias("a").join(shifts.alias("b"), _same("a", "b", [*group, "_part"]), "left")
    return joined.select(*[f"a.{c}" for c in df.columns], (F.col("a._own") + F.coalesce("b._shift", F.lit(0))).alias(name))
