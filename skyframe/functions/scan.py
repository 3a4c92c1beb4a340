"""Running values along a long group, without one task for the group.

Rows are dealt into blocks by range of (group, order), so a group of any size is spread; values run
inside a block, and a small table of block totals tells what each block begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.session import cut


def blocked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``block``: blocks are ranges of (keys, order), numbered in that order; written, so that they stay."""
    return cut(df.repartitionByRange(*keys, *order).withColumn("block", F.spark_partition_id().cast("bigint")))


def block_sums(df: DataFrame, keys: list[str], before: dict[str, Column], whole: dict[str, Column], aggregated: bool = False) -> DataFrame:
    """(keys, block, ...): per block the sums of all earlier blocks of its group (``before``) and of the group (``whole``).

    Expressions are summed, or taken as sums where ``aggregated``.
    """
    total = lambda c: c if aggregated else F.sum(c)
    sums = df.groupBy(*keys, "block").agg(*[total(c).alias(n) for n, c in (before | whole).items()])
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    told = {n: F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in before} | {n: F.sum(n).over(group) for n in whole}
    return sums.withColumns(told)


def nearest_known(df: DataFrame, keys: list[str], at: str, known: Column) -> DataFrame:
    """``df`` with ``before`` and ``after``: the last ``known`` at or before each row and the first at or after it.

    ``known`` is a struct that begins with the position, or null.  A value is carried between blocks
    through one row per block.  What comes after is read in falling order: Spark counts a frame that is
    open towards the end anew for every row.
    """
    rows = blocked(df.withColumn("_known", known), keys, [at])
    inside, group = Window.partitionBy(*keys, "block"), Window.partitionBy(*keys)
    ends = rows.groupBy(*keys, "block").agg(F.min("_known").alias("_first"), F.max("_known").alias("_last"))
    earlier = lambda c: group.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "block", F.last("_last", True).over(earlier("block")).alias("_from"), F.last("_first", True).over(earlier(F.desc("block"))).alias("_to"))
    so_far = lambda c: inside.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"before": F.last("_known", True).over(so_far(at)), "after": F.last("_known", True).over(so_far(F.desc(at)))}).join(ends, [*keys, "block"])
    return rows.withColumns({"before": F.coalesce("before", "_from"), "after": F.coalesce("after", "_to")}).drop("_known", "_from", "_to", "block")
