"""Exact order statistics per group that never gather a group in one place.

``percentile``/``median`` keep every distinct value of a group in one aggregation buffer, which
does not survive an image that holds a third of the archive.  Here the values are first counted
in monotone logarithmic bins (a map-side combined count), the bin holding each wanted rank is
located on those counts, and only the values of that bin are counted one by one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.session import cut

BINS_PER_OCTAVE = 4096
#: Bins that quantiles count in.  With fine ones an image of some 10,000 pixels has about as many bins as pixels, and its
#: counts are no smaller than the image; with these a wanted bin holds about 1 % of the values of one octave.
COUNT_BINS = 256
SMALLEST_EXPONENT = -40


def log_bin(v: Column, per_octave: int = BINS_PER_OCTAVE) -> Column:
    """Monotone bin number: ``per_octave`` bins per power of two, mirrored for negative values."""
    tiny = F.lit(2.0**SMALLEST_EXPONENT)
    octave = F.log2(F.greatest(F.abs(v), tiny)) - F.lit(float(SMALLEST_EXPONENT))
    bins = F.floor(octave * F.lit(float(per_octave))).cast("int") + F.lit(1)
    side = F.when(F.abs(v) < tiny, F.lit(0)).when(v < 0, F.lit(-1)).otherwise(F.lit(1))
    # never null: a join on the bin then needs no filter that works the value out once more
    return F.coalesce(side * bins, F.lit(0))


def linear(p: float):
    """Interpolated quantile at position p(n-1)."""
    return ("linear", float(p))


def lower(p: float):
    """Element floor(p(n-1)) of the sorted values."""
    return ("lower", float(p))


def upper_median():
    """Element n div 2 of the sorted values."""
    return ("upper", 0.5)


def kth_largest(k: int):
    """The k-th largest value (the smallest when the group has fewer)."""
    return ("kth", int(k))


def at_rank(fn):
    """Element at the rank ``fn(n)`` (0-based, ascending) of a group of n values."""
    return ("fn", fn)


def _ranks(spec, n: Column) -> tuple[Column, Column, Column]:
    kind, arg = spec
    if kind == "linear":
        pos = (n - F.lit(1)) * F.lit(arg)
        return F.floor(pos).cast("long"), F.ceil(pos).cast("long"), pos - F.floor(pos)
    if kind == "lower":
        r = F.floor((n - F.lit(1)) * F.lit(arg)).cast("long")
    elif kind == "fn":
        r = arg(n).cast("long")
    elif kind == "upper":
        r = F.floor(n / F.lit(2)).cast("long")
    else:
        r = F.greatest(n - F.lit(arg), F.lit(0)).cast("long")
    return r, r, F.lit(0.0)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str | Column,
    wants: Mapping[str, tuple],
    count_as: str | None = None,
) -> DataFrame:
    """One row per group with the wanted exact order statistics of the non-null values."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    src = df.select(*keys, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not keys:
        src, keys_in = src.withColumn("_g", F.lit(0)), ["_g"]
    else:
        keys_in = keys
    src = src.withColumn("_b", log_bin(F.col("_v"), COUNT_BINS))

    by_key = Window.partitionBy(*keys_in)
    hist = (
        src.groupBy(*keys_in, "_b")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_to", F.sum("_c").over(by_key.orderBy("_b")))
        .withColumn("_n", F.sum("_c").over(by_key))
        .withColumn("_from", F.col("_to") - F.col("_c"))
    )
    names = list(wants)
    picks, holds = [], F.lit(False)
    for i, name in enumerate(names):
        lo, hi, frac = _ranks(wants[name], F.col("_n"))
        for side, rank in enumerate((lo, hi)):
            holds = holds | ((rank >= F.col("_from")) & (rank < F.col("_to")))
            picks.append(
                F.struct(F.lit(2 * i + side).alias("i"), rank.alias("r"), frac.cast("double").alias("f"))
            )
    # at most two rows per group and wanted value: the bin and the rank inside it
    targets = (
        hist.filter(holds).withColumn(
            "_p",
            F.explode(F.filter(F.array(*picks), lambda s: (s["r"] >= F.col("_from")) & (s["r"] < F.col("_to")))),
        )
        .select(*keys_in, "_b", "_n", F.col("_p.i").alias("_i"), (F.col("_p.r") - F.col("_from")).alias("_r"), F.col("_p.f").alias("_f"))
    )
    near = Window.partitionBy(*keys_in, "_i")
    # Spark takes exploded pixels for as few as the rows they come from: left alone, it may broadcast them
    found = (
        src.join(targets.hint("shuffle_hash"), [*keys_in, "_b"])
        .groupBy(*keys_in, "_n", "_i", "_r", "_f", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_vto", F.sum("_c").over(near.orderBy("_v")))
        .filter((F.col("_r") < F.col("_vto")) & (F.col("_r") >= F.col("_vto") - F.col("_c")))
    )
    aggs = [F.max("_n").alias("_n")]
    for i, _ in enumerate(names):
        for side in (0, 1):
            aggs.append(F.max(F.when(F.col("_i") == 2 * i + side, F.col("_v"))).alias(f"_q{2 * i + side}"))
        aggs.append(F.max(F.when(F.col("_i") == 2 * i, F.col("_f"))).alias(f"_f{i}"))
    out = found.groupBy(*keys_in).agg(*aggs)
    cols = [
        (F.col(f"_q{2 * i}") + (F.col(f"_q{2 * i + 1}") - F.col(f"_q{2 * i}")) * F.col(f"_f{i}")).alias(name)
        for i, name in enumerate(names)
    ]
    if count_as:
        cols.append(F.col("_n").alias(count_as))
    return out.select(*keys, *cols)


def group_median(df: DataFrame, keys: Sequence[str], value: str | Column, name: str) -> DataFrame:
    return group_quantiles(df, keys, value, {name: linear(0.5)})


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Put one-row-per-group statistics back on the rows.

    No broadcast is forced: Spark broadcasts when the statistics are under its size threshold and
    otherwise sort-merges, where adaptive execution splits a hot key.
    """
    return df.join(stats, list(keys), how)


def group_mad(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "mad", center: str = "med"
) -> DataFrame:
    """Median and raw median absolute deviation of every group."""
    med = cut(group_median(df, keys, value, center))
    dev = attach(df.select(*keys, value), med, keys).withColumn("_d", F.abs(F.col(value) - F.col(center)))
    mad = group_median(dev, keys, "_d", name)
    return attach(med, mad, keys)


def group_mads(df: DataFrame, keys: Sequence[str], wants: Mapping[str, tuple[str, str]]) -> DataFrame:
    """:func:`group_mad` of several columns in the same passes; ``wants`` has (mad, center) names by column.

    A group without a value of a column has nulls for it.
    """
    keys, cols = list(keys), list(wants)
    items = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)]))
    long = df.select(*keys, items.alias("_s")).select(*keys, F.col("_s.k").alias("_k"), F.col("_s.x").alias("_x"))
    by = [*keys, "_k"]
    med = cut(group_median(long, by, "_x", "_c"))
    dev = attach(long, med, by).withColumn("_x", F.abs(F.col("_x") - F.col("_c")))
    both = attach(med, group_median(dev, by, "_x", "_d"), by)
    at = lambda i, c, name: F.max(F.when(F.col("_k") == i, F.col(c))).alias(name)
    return both.groupBy(*keys).agg(*[a for i, c in enumerate(cols) for a in (at(i, "_d", wants[c][0]), at(i, "_c", wants[c][1]))])
