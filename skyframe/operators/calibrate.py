"""Calibration of light frames and sensor-defect repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.kernels import rank_filter
from skyframe.functions.math import clip
from skyframe.functions.quantiles import attach, group_mad, group_median
from skyframe.operators.components import label_components
from skyframe.operators.overlap import image_dims, map_overlap
from skyframe.session import cut

PIX = ["target_id", "y", "x"]


def _named(master: DataFrame | None, name: str) -> DataFrame | None:
    return None if master is None else master.select(*PIX, F.col("v").alias(name))


def calibrate_light(light, bias=None, dark=None, flat=None) -> DataFrame:
    """Subtract the dark, else the bias; divide by the mean-normalised flat; clip to [0, 1].

    Masters are one row per pixel of a target; Spark broadcasts them while they are small and
    sort-merges on (target, y, x) otherwise, which no single target can skew.
    """
    df = light
    for m, name in ((dark, "_dark"), (bias, "_bias")):
        df = df.join(_named(m, name).hint("merge"), PIX, "left") if m is not None else df.withColumn(name, F.lit(None).cast("double"))
    out = F.col("v") - F.coalesce("_dark", "_bias", F.lit(0.0))
    if flat is not None:
        mean = flat.groupBy("target_id").agg(F.avg("v").alias("_fm"))
        norm = F.when((F.col("_fm") == 0) | F.col("_fm").isNull(), F.lit(1.0)).otherwise(F.col("_fm"))
        fn = attach(_named(flat, "_f"), mean, ["target_id"]).select(*PIX, (F.col("_f") / norm).alias("_fn"))
        df = df.join(fn.hint("merge"), PIX, "left")
        out = F.when(F.col("_fn").isNull(), out).when(F.col("_fn") > 1e-6, out / F.col("_fn")).otherwise(0.0)
    return df.withColumn("v", clip(out)).select(light.columns)


def pedestal_flats(flats: DataFrame, dark_flat: DataFrame, bias: DataFrame) -> DataFrame:
    """Subtract each flat's pedestal: the dark-flat master, else the bias; clip."""
    return (
        flats.join(_named(dark_flat, "_d").hint("merge"), PIX, "left")
        .join(_named(bias, "_b").hint("merge"), PIX, "left")
        .withColumn("v", clip(F.col("v") - F.coalesce("_d", "_b", F.lit(0.0))))
        .select(flats.columns)
    )


def shape_guard(light: DataFrame, master: DataFrame, name: str) -> DataFrame:
    """Frames whose shape differs from their master's, with a message naming both shapes."""

    def dims(df, keys, tag):
        return df.groupBy(*keys).agg((F.max("y") + 1).alias(f"{tag}h"), (F.max("x") + 1).alias(f"{tag}w"))

    a = dims(light, ["target_id", "frame_id"], "l")
    m = dims(master, ["target_id"], "m")
    return a.join(m, "target_id").filter("lh <> mh or lw <> mw").select(
        "target_id",
        "frame_id",
        F.format_string(f"master {name} shape %dx%d does not match the light frame %dx%d", "mh", "mw", "lh", "lw").alias("error"),
    )


def static_pixels(px: DataFrame, frames: DataFrame, sigma=5.0, presence=0.65) -> DataFrame:
    """Pixels hot (or cold) against their 3x3 median in most frames of a target; needs three frames."""
    keys = ["target_id", "frame_id"]
    res = map_overlap(px, keys, ["v"], 1, lambda a, _: {"resid": a["v"] - rank_filter(a["v"], 3, "median")}, ["resid"], "nearest")
    res = cut(res)
    mad = group_mad(res, keys, "resid", "_d", "_c").select(*keys, (F.col("_d") * 1.4826 + 1e-9).alias("_sg"))
    n = frames.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n"))
    d = attach(res, mad, keys)
    c = d.groupBy(*PIX).agg(
        F.count_if(F.col("resid") > F.col("_sg") * sigma).alias("hot"), F.count_if(F.col("resid") < F.col("_sg") * -sigma).alias("cold")
    ).join(n, "target_id")
    need = F.greatest(F.lit(2), F.ceil(F.col("_n") * presence))
    return c.filter((F.col("_n") >= 3) & ((F.col("hot") >= need) | (F.col("cold") >= need))).select(*PIX, "hot", "cold")


def repair_pixels(px: DataFrame, bad: DataFrame) -> DataFrame:
    """Replace listed pixels of every frame by their 3x3 median."""
    med = map_overlap(px, ["target_id", "frame_id"], ["v"], 1, lambda a, _: {"m": rank_filter(a["v"], 3, "median")}, ["m"], "nearest", carry=["v"])
    return med.join(bad.select(*PIX, F.lit(True).alias("_bad")).hint("merge"), PIX, "left").select(
        "target_id", "frame_id", "y", "x", F.when(F.coalesce("_bad", F.lit(False)), F.col("m")).otherwise(F.col("v")).alias("v")
    )


def cosmetic_correct(df: DataFrame, sigma=3.0, max_component=12, keys=("image_id",)) -> DataFrame:
    """Replace isolated outliers by their 3x3 median; clusters above ``max_component`` pixels stay."""
    keys = list(keys)
    d = cut(map_overlap(df, keys, ["v"], 1, lambda a, _: {"m": rank_filter(a["v"], 3, "median")}, ["m"], "nearest", carry=["v"]).withColumn("_r", F.col("v") - F.col("m")))
    st = group_mad(d, keys, "_r", "_d", "_c").select(*keys, (F.col("_d") * 1.4826 + 1e-9).alias("_sg"))
    d = attach(d, st, keys)
    hit = (F.abs("_r") > F.col("_sg") * sigma) & (F.abs("_r") > 1e-6)
    lab = cut(label_components(d.filter(hit).select(*keys, "y", "x"), keys))
    small = lab.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") <= max_component)
    fix = lab.join(small, [*keys, "label"], "left_semi").select(*keys, "y", "x", F.lit(True).alias("_fix"))
    return d.join(fix.hint("merge"), [*keys, "y", "x"], "left").select(*keys, "y", "x", clip(F.when(F.col("_fix"), F.col("m")).otherwise(F.col("v"))).alias("v"))


def _moving_mean(profile: DataFrame, keys, at: str, value: str, half=12) -> DataFrame:
    """Centred mean over 2*half+1 lines with the end values repeated; one profile is at most a few thousand rows."""
    w = Window.partitionBy(*keys).orderBy(at)
    inner = w.rowsBetween(-half, half)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.max(at).over(Window.partitionBy(*keys))
    short_lo, short_hi = F.greatest(F.lit(0), half - F.col(at)), F.greatest(F.lit(0), half - (last - F.col(at)))
    total = F.sum(value).over(inner) + short_lo * F.first(value).over(whole) + short_hi * F.last(value).over(whole)
    return profile.select(*keys, at, (F.col(value) - total / float(2 * half + 1)).alias("_dev"))


def suppress_banding(df: DataFrame, strength=1.0, keys=("image_id",)) -> DataFrame:
    """Subtract each line's median minus its 25-line moving mean: columns first, then rows."""
    keys = list(keys)
    for at in ("x", "y"):
        dev = _moving_mean(group_median(df, [*keys, at], "v", "_p"), keys, at, "_p")
        df = cut(df.join(dev, [*keys, at]).withColumn("v", F.col("v") - F.col("_dev") * float(strength)).drop("_dev"))
    return df.withColumn("v", clip(F.col("v")))


def remove_grid(df: DataFrame, period=6, strength=1.0, keys=("image_id",)) -> DataFrame:
    """Subtract the median high-pass pattern of every (y mod p, x mod p) cell; small images stay."""
    keys, p = list(keys), int(period)
    k = p + 1
    dims = image_dims(df, keys).select(*keys, F.col("_h").alias("_rows"), F.col("_w").alias("_cols"))
    hp = map_overlap(df, keys, ["v"], k // 2, lambda a, _: {"_hp": a["v"] - rank_filter(a["v"], k, "mean")}, ["_hp"], "reflect", carry=["v"])
    d = cut(attach(hp, dims, keys).withColumns({"_cy": F.col("y") % p, "_cx": F.col("x") % p}))
    whole = (F.col("y") < F.floor(F.col("_rows") / p) * p) & (F.col("x") < F.floor(F.col("_cols") / p) * p)
    cell = group_median(d.filter(whole), [*keys, "_cy", "_cx"], "_hp", "_g")
    out = F.when(F.least("_rows", "_cols") >= 4 * p, F.col("v") - F.col("_g") * float(strength)).otherwise(F.col("v"))
    return d.join(cell, [*keys, "_cy", "_cx"], "left").select(*keys, "y", "x", clip(out).alias("v"))
