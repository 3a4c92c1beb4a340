"""Rows ranked inside a group without sorting the whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.quantiles import log_bin
from skyframe.session import cut


HOT_BIN = 1_000_000  # rows one task may sort


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "rank", hot_bin: int = HOT_BIN) -> DataFrame:
    """1-based rank by ``order`` = [(column, ascending), ...]; the last column must break all ties.

    The first order column is counted in monotone bins; a row's rank is the size of the earlier bins
    plus its place inside its own bin, so a hot group is sorted by many tasks.  A bin that is hot
    itself (many equal values) is counted by exact value and ranked on by the next columns.
    """
    keys = list(keys)
    first, asc = order[0]
    b = log_bin(F.col(first).cast("double"))
    d = df.withColumn("_b", b if asc else -b)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = cut(sizes.withColumn("_off", F.coalesce(F.sum("_c").over(before), F.lit(0))))
    inside = Window.partitionBy(*keys, "_b").orderBy(*[F.col(c).asc() if a else F.col(c).desc() for c, a in order])

    def by_sort(part: DataFrame) -> DataFrame:
        j = part.join(offsets.drop("_c").hint("shuffle_hash"), [*keys, "_b"])  # the window below needs that exchange too
        return j.withColumn(name, F.col("_off") + F.row_number().over(inside)).drop("_b", "_off")

    hot = offsets.filter(F.col("_c") > hot_bin)
    if len(order) == 1 or hot.isEmpty():
        return by_sort(d)
    cold = by_sort(d.join(hot.select(*keys, "_b"), [*keys, "_b"], "left_anti"))
    h = d.join(hot.drop("_c"), [*keys, "_b"])
    w = Window.partitionBy(*keys, "_b").orderBy(F.col(first).asc() if asc else F.col(first).desc()).rowsBetween(Window.unboundedPreceding, -1)
    values = h.groupBy(*keys, "_b", first).agg(F.count(F.lit(1)).alias("_c")).select(*keys, first, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_off2"))
    deep = ranked(h.drop("_b").withColumnRenamed("_off", "_off1"), [*keys, first], order[1:], "_in", hot_bin)
    deep = deep.join(values, [*keys, first]).withColumn(name, F.col("_off1") + F.col("_off2") + F.col("_in"))
    return cold.unionByName(deep.select(*cold.columns))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The k first rows of each group; a fixed k lets Spark limit every group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
