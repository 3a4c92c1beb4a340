"""Bright discs: geometry, body class, limb correction, finishing summary."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.math import clip, half_even, midtones_balance, mtf
from skyframe.functions.quantiles import attach, group_median, group_quantiles, linear
from skyframe.operators.overlap import image_dims, map_overlap
from skyframe.operators.stack import array_median
from skyframe.operators.stats import KEY, RGB, mean_of
from skyframe.session import cut

BINS = 96
RING_BINS = 120


def forward_fill(profile: DataFrame, bins: int, value: str, keys=KEY) -> DataFrame:
    """Dense 0..bins-1 profile: gaps take the last value before them, the head takes the first."""
    keys = list(keys)
    grid = profile.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    w = Window.partitionBy(*keys).orderBy("bin")  # one row per bin
    ahead = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = grid.join(profile, [*keys, "bin"], "left")
    return d.select(*keys, "bin", F.coalesce(F.last(value, True).over(w), F.first(value, True).over(ahead), F.lit(1.0)).alias(value))


def centred_median(profile: DataFrame, half: int, value: str, out: str, keys=KEY) -> DataFrame:
    """Median over the bins within ``half`` of each bin; windows shorten at the ends."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-half, half)
    return profile.withColumn(out, array_median(F.collect_list(value).over(w)))  # 2 half + 1 values


def disc_geometry(df, value="v", keys=KEY) -> DataFrame:
    """Centre, equal-area radius, fill, 96-bin radial profile (array) of the lit disc; under 100 px -> no row."""
    keys = list(keys)
    thr = group_quantiles(df, keys, value, {"_p": linear(0.999)})
    lit = attach(df, thr, keys).filter(F.col(value) > F.col("_p") * 0.5)
    g = lit.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n")).filter("n >= 100")
    g = cut(g.withColumn("radius", F.sqrt(F.col("n") / math.pi)))
    d = attach(lit, g, keys).withColumn("_r", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")))
    d = cut(d.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("_r") / (F.col("radius") * 1.03) * BINS)).cast("int")).select(*keys, "bin", "_r", F.col(value).alias("_v")))
    far = d.groupBy(*keys).agg(F.max("_r").alias("max_r"))
    med = group_quantiles(d, [*keys, "bin"], "_v", {"m": linear(0.5)}, "_n").filter("_n > 20").select(*keys, "bin", "m")
    prof = forward_fill(med, BINS, "m", keys).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "m"))), lambda s: s["m"]).alias("profile"))
    r = g.join(far, keys).join(prof, keys)
    return r.withColumn("fill", F.col("n") / (F.col("max_r") * F.col("max_r") * math.pi)).withColumn("c0", F.greatest(F.lit(1e-6), F.element_at("profile", 1), F.element_at("profile", 2)))


OFFSETS = [(0, 6), (0, -6), (6, 0), (-6, 0), (4, 4), (4, -4), (-4, 4), (-4, -4)]  # fixed values: (dy, dx) of the limb test


def classify_body(df, value="v", stride=1, keys=KEY) -> DataFrame:
    """Sun when the limb is darker than the interior, moon when brighter; ``stride`` may thin the pixels."""
    keys = list(keys)
    thr = group_quantiles(df, keys, value, {"_p": linear(0.999)}).select(*keys, (F.col("_p") * 0.5).alias("_thr"))
    d = attach(df, thr, keys)

    def kernel(a, p):
        import numpy as np

        v, t = a[value], float(p["_thr"])
        dark = np.zeros(v.shape)
        for dy, dx in OFFSETS:
            dark = np.maximum(dark, np.roll(np.where(v <= t, 1.0, 0.0), (-dy, -dx), (0, 1)))
        return {"near_dark": dark}

    e = map_overlap(d, keys, [value], 6, kernel, ["near_dark"], "nearest", ["_thr"], [value, "_thr"])
    e = attach(e, image_dims(df, keys), keys)
    grid = (F.col("y") >= 6) & (F.col("y") < F.col("_h") - 6) & (F.col("x") >= 6) & (F.col("x") < F.col("_w") - 6) & (F.col("y") % stride == 0) & (F.col("x") % stride == 0)
    lit, edge = F.col(value) > F.col("_thr"), F.col("near_dark") > 0
    s = e.filter(grid).groupBy(*keys).agg(
        F.count(F.when(lit & edge, 1)).alias("n_edge"), F.count(F.when(lit & ~edge, 1)).alias("n_interior"), F.avg(F.when(lit & edge, F.col(value))).alias("_e"), F.avg(F.when(lit & ~edge, F.col(value))).alias("_i")
    )
    ok = (F.col("n_edge") >= 50) & (F.col("n_interior") >= 200)
    ratio = F.when(ok, F.col("_e") / F.col("_i")).otherwise(1.0)
    return s.withColumn("ratio", ratio).withColumn("body", F.when(F.col("ratio") < 0.93, "sun").when(F.col("ratio") > 1.03, "moon").otherwise("unknown")).drop("_e", "_i")


def _free_mtf(m: Column, x: Column) -> Column:
    den = (m * 2.0 - 1.0) * x - m
    return (m - 1.0) * x / F.when(den == 0, 1e-12).otherwise(den)


def disc_summary(df, disc_target=0.72, keys=KEY, white_balance=True) -> DataFrame:
    """Disc and sky medians per channel, white-balance gains, black point and midtones of the lift."""
    keys = list(keys)
    d = df.withColumn("_L", mean_of(RGB))
    p = group_quantiles(d, keys, "_L", {"_p": linear(0.999)}).filter(F.col("_p") >= 0.01)
    d = attach(d, p, keys)
    parts = p.select(*keys)
    for tag, cond in (("disc", F.col("_L") > F.col("_p") * 0.5), ("sky", F.col("_L") < F.col("_p") * 0.1)):
        for c in RGB:
            parts = parts.join(group_median(d.filter(cond), keys, c, f"{tag}_{c}"), keys, "left")
    parts = cut(parts)
    gain = {c: (F.col("disc_g") / F.greatest(F.lit(1e-6), F.col(f"disc_{c}")) if white_balance else F.lit(1.0)) for c in RGB}
    dm = F.least((F.col("disc_r") * gain["r"] + F.col("disc_g") * gain["g"] + F.col("disc_b") * gain["b"]) / 3.0, F.lit(0.98))
    sm = sum((F.coalesce(f"sky_{c}", F.lit(0.0)) * gain[c] for c in RGB), F.lit(0.0)) / 3.0
    c0 = F.greatest(F.lit(0.0), sm * 0.6)
    r = parts.withColumns({"gain_r": gain["r"], "gain_b": gain["b"], "_dm": dm, "black": c0})
    x = (F.col("_dm") - F.col("black")) / (1.0 - F.col("black"))
    m = midtones_balance(disc_target, x)
    return r.withColumn("midtones", F.when((x > 0) & (x < 1), m)).drop("_dm")


def finish(df, disc_target=0.72, keys=KEY) -> DataFrame:
    """White balance and lift that puts the disc at its target level."""
    s = disc_summary(df, disc_target, keys).filter("midtones is not null").select(*keys, "gain_r", "gain_b", "black", "midtones")
    d = attach(df, s, keys)

    def one(c):
        v = clip(F.col(c) * (F.col(f"gain_{c}") if c != "g" else F.lit(1.0)))
        return clip(mtf(F.col("midtones"), clip((v - F.col("black")) / F.greatest(F.lit(1e-6), 1.0 - F.col("black"))))).alias(c)

    return d.select(*keys, "y", "x", *[one(c) for c in RGB])


def flatten_limb(df, geometry: DataFrame, midtones: DataFrame, surface=6.0, flatten=0.35, disc_target=0.72, keys=KEY, channels=RGB) -> DataFrame:
    """Divide out part of the limb darkening and boost surface contrast inside the disc.

    The 96-bin profile and the channel levels ride along as one row per image.
    """
    keys = list(keys)
    idx = F.sequence(F.lit(0), F.lit(BINS - 1))
    norm = F.transform("profile", lambda p: p / F.col("c0"))
    mean = F.aggregate(F.zip_with(idx, norm, lambda i, p: (i + 0.5) * F.greatest(F.lit(0.15), p)), F.lit(0.0), lambda a, b: a + b) / float(sum(i + 0.5 for i in range(BINS)))
    g = geometry.join(midtones, keys).select(*keys, "cx", "cy", (F.col("radius") * 1.03).alias("_R"), norm.alias("_prof"), *[(F.col(f"disc_{c}") / F.greatest(F.lit(1e-6), mean)).alias(f"_C{c}") for c in channels], (1.0 - F.col("midtones")).alias("_mi"))
    d = attach(df, g, keys, "left")
    r = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    bp = clip(r / F.col("_R") * BINS, 0.0, float(BINS - 1))
    bi = F.floor(bp).cast("int")
    d = d.withColumns({"_in": F.coalesce(r < F.col("_R"), F.lit(False)), "_bf": bp - bi, "_bi": bi})
    fl = F.greatest(F.lit(0.15), F.element_at("_prof", F.col("_bi") + 1) * (1.0 - F.col("_bf")) + F.element_at("_prof", F.least(F.lit(BINS), F.col("_bi") + 2)) * F.col("_bf"))
    d = d.withColumn("_fl", fl)
    tc = min(0.95, disc_target)
    gl = _free_mtf(F.col("_mi"), F.pow("_fl", F.lit(1.0 - flatten)) * tc) / F.greatest(F.lit(1e-6), _free_mtf(F.col("_mi"), F.lit(tc)))
    kf, fade = clip((F.col("_fl") - 0.42) / 0.13), clip((F.col("_fl") - 0.25) / 0.17)
    d = d.withColumns({"_gl": gl, "_kf": kf, "_fd": fade})

    def one(c):
        ratio = F.col(c) / F.greatest(F.lit(1e-6), F.col(f"_C{c}") * F.col("_fl"))
        b = clip(F.col("_kf") * (ratio - 1.0) * surface + 1.0, 0.45, 1.6)
        o = F.col(c) * (1.0 - F.col("_fd")) + F.col(f"_C{c}") * F.col("_gl") * b * F.col("_fd")
        return F.when(F.col("_in"), clip(o)).otherwise(F.col(c)).alias(c)

    return d.select(*keys, "y", "x", *[one(c) for c in channels])


def ring_detrend(df, geometry: DataFrame, keys=KEY, channels=RGB) -> DataFrame:
    """Even out thin rings about the limb: each of 120 bins against the median of its neighbours."""
    keys = list(keys)
    g = geometry.select(*keys, "cx", "cy", "radius")
    d = attach(df, g, keys, "left").withColumn("_L", mean_of(channels))
    lo, hi = F.col("radius") * 0.88, F.col("radius") * 1.14
    r = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    b = F.least(F.greatest(F.floor((r - lo) / ((hi - lo) / RING_BINS)).cast("int"), F.lit(0)), F.lit(RING_BINS - 1))
    d = cut(d.withColumn("bin", F.when((r >= lo) & (r < hi), b)).drop("cx", "cy", "radius"))
    m = group_quantiles(d.filter(F.col("bin").isNotNull()), [*keys, "bin"], "_L", {"p": linear(0.5)}, "_n").filter("_n > 30").select(*keys, "bin", "p")
    grid = m.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(RING_BINS - 1))))
    w = Window.partitionBy(*keys).orderBy("bin")
    prof = grid.join(m, [*keys, "bin"], "left").withColumn("p", F.coalesce(F.last("p", True).over(w), F.lit(0.0)))
    prof = centred_median(prof, 6, "p", "_ref", keys)
    f = clip(F.when(F.col("p") > 1e-5, F.col("_ref") / F.col("p")).otherwise(1.0), 0.94, 1.06)
    edge = F.least(F.lit(1.0), F.least(F.col("bin"), RING_BINS - 1 - F.col("bin")) / 8.0)
    prof = prof.withColumn("_f", f).withColumn("_dev", F.max(F.abs(F.col("_f") - 1.0)).over(Window.partitionBy(*keys)))
    prof = prof.select(*keys, "bin", F.when(F.col("_dev") > 0.01, (F.col("_f") - 1.0) * edge + 1.0).otherwise(1.0).alias("_k"))
    return d.join(prof, [*keys, "bin"], "left").select(*keys, "y", "x", *[F.when(F.col("_k").isNull(), F.col(c)).otherwise(clip(F.col(c) * F.col("_k"))).alias(c) for c in channels])


def interior_mask(df, geometry: DataFrame, feather=(40.0, 10.0), keys=KEY) -> DataFrame:
    """1 inside the limb, a cosine fall across the feather, 0 outside."""
    keys = list(keys)
    d = attach(df.select(*keys, "y", "x"), geometry.select(*keys, "cx", "cy", "radius"), keys)
    r = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))
    a, b = F.col("radius") - feather[0], F.col("radius") - feather[1]
    w = F.when(r < a, 1.0).when(r > b, 0.0).otherwise((F.cos((r - a) / F.greatest(F.lit(1e-6), b - a) * math.pi) + 1.0) / 2.0)
    return d.select(*keys, "y", "x", w.alias("w"))


def lit_box(df, pad=0.15, keys=KEY, channels=RGB) -> DataFrame:
    """Padded box of the lit pixels; images with under 50 of them keep their full frame."""
    keys = list(keys)
    d = df.select(*keys, "y", "x", mean_of(channels).alias("v"))
    thr = group_quantiles(d, keys, "v", {"_p": linear(0.999)})
    lit = attach(d, thr, keys).filter(F.col("v") > F.greatest(F.lit(0.04), F.col("_p") * 0.12))
    b = lit.groupBy(*keys).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n"))
    r = image_dims(df, keys).join(b, keys, "left")
    p = half_even(F.greatest(F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1) * pad)
    ok = F.coalesce(F.col("n") >= 50, F.lit(False))
    return r.select(
        *keys, F.when(ok, F.greatest(F.lit(0.0), F.col("y0") - p)).otherwise(0.0).cast("int").alias("y0"), F.when(ok, F.least(F.col("_h").cast("double"), F.col("y1") + 1 + p)).otherwise(F.col("_h")).cast("int").alias("y1"),
        F.when(ok, F.greatest(F.lit(0.0), F.col("x0") - p)).otherwise(0.0).cast("int").alias("x0"), F.when(ok, F.least(F.col("_w").cast("double"), F.col("x1") + 1 + p)).otherwise(F.col("_w")).cast("int").alias("x1"),
    )
