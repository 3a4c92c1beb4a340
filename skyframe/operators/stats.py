"""Per-image statistics and the tone solve they feed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.math import clip, half_up, midtones_balance, mtf, soft_knee, soft_knee_fixed
from skyframe.functions.quantiles import at_rank, attach, group_mad, group_median, group_quantiles, linear
from skyframe.operators.overlap import image_dims
from skyframe.session import cut

KEY = ["image_id"]
RGB = ("r", "g", "b")

# Knee width in average deviations, and its floor.
KNEE_WIDTH, KNEE_FLOOR = 0.30, 1.0e-5
# Dust grid (columns, rows, patch size, span) and its order statistics.
DUST = {"gx": 6, "gy": 4, "patch": 0.07, "lo": 0.08, "hi": 0.92, "min_px": 4, "min_patches": 4, "clean": 0.10, "typical": 0.45, "cap": 0.03}
# Perimeter assessment and its tiers (least gradient, crop %, use gradient removal).
ASSESS = {"sigma": -2.8, "target": 0.25, "size": 0.09, "inset": 0.02, "min_frame": 128, "drop": 1}
TIERS = [(0.45, 8, True), (0.20, 6, True), (0.00, 3, False)]


def mean_of(cols: Sequence[str]) -> Column:
    total = F.col(cols[0])
    for c in cols[1:]:
        total = total + F.col(c)
    return total / float(len(cols))


def long_channels(df: DataFrame, keep: Sequence[str], channels: Sequence[str] = RGB) -> DataFrame:
    """One row per channel sample: ``keep`` columns, channel name ``c``, value ``v``."""
    items = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in channels])
    return df.select(*keep, F.explode(items).alias("_s")).select(*keep, "_s.c", "_s.v")


def channel_medians(df, keys=KEY, channels=RGB) -> DataFrame:
    return group_median(long_channels(df, list(keys), channels), [*keys, "c"], "v", "med")


def wide(stats: DataFrame, keys, names: Mapping[str, str], channels=RGB) -> DataFrame:
    """Spread per-channel rows into one row: ``names`` maps a column to the prefix of its outputs."""
    aggs = [
        F.max(F.when(F.col("c") == c, F.col(col))).alias(f"{pre}{c}") for col, pre in names.items() for c in channels
    ]
    return stats.groupBy(*keys).agg(*aggs)


def channel_stats(df, keys=KEY, channels=RGB) -> DataFrame:
    """Median, mean and average absolute deviation of every channel."""
    lg = long_channels(df, list(keys), channels)
    med = cut(group_median(lg, [*keys, "c"], "v", "med"))
    return (
        attach(lg, med, [*keys, "c"])
        .groupBy(*keys, "c")
        .agg(F.max("med").alias("med"), F.avg("v").alias("mean"), F.avg(F.abs(F.col("v") - F.col("med"))).alias("dev"))
    )


def image_stats(df, keys=KEY, channels=RGB) -> DataFrame:
    """Channel-averaged median, mean and average deviation: one small row per image."""
    return channel_stats(df, keys, channels).groupBy(*keys).agg(
        F.avg("med").alias("med"), F.avg("mean").alias("mean"), F.avg("dev").alias("dev")
    )


def region_median(df, x0, y0, x1, y1, keys=KEY, channels=RGB) -> DataFrame:
    """Channel-averaged median of a half-open rectangle; the filter runs before anything moves."""
    inside = df.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
    return channel_medians(inside, keys, channels).groupBy(*keys).agg(F.avg("med").alias("med"))


def knee_width(dev: Column) -> Column:
    return F.greatest(F.lit(KNEE_WIDTH) * dev, F.lit(KNEE_FLOOR))


def solve_stretch(stats: DataFrame, clip_at, target) -> DataFrame:
    """Black point, knee flag and midtones of the automatic stretch, one row per image."""
    s = stats.withColumn("c0", clip(F.col("med") + F.lit(float(clip_at)) * F.col("dev")))
    s = s.withColumn("knee", (F.col("c0") > 0) & (F.col("c0") < 1))
    soft = F.when(F.col("knee"), soft_knee(F.col("med"), F.col("c0"), knee_width(F.col("dev")))).otherwise(F.col("med"))
    return s.withColumn("_soft", soft).withColumn("m", midtones_balance(target, F.col("_soft"))).drop("_soft")


def auto_stretch(df, clip_at=-1.25, target=0.25, keys=KEY, channels=RGB) -> DataFrame:
    """Knee and midtones solved per image; applied as two plain projections after one small join."""
    s = cut(solve_stretch(image_stats(df, keys, channels), clip_at, target).select(*keys, "c0", "knee", "m", knee_width(F.col("dev")).alias("_e")))
    d = attach(df, s, keys)
    d = d.withColumns({c: F.when(F.col("knee"), soft_knee_fixed(F.col(c), F.col("c0"), F.col("_e"))).otherwise(F.col(c)) for c in channels})
    d = d.withColumns({c: F.when(F.col("knee"), clip(F.col(c))).otherwise(F.col(c)) for c in channels})
    ok = (F.col("m") > 0) & (F.col("m") < 1) & (F.col("m") != 0.5)
    return d.select(*keys, "y", "x", *[F.when(ok, mtf(F.col("m"), F.col(c))).otherwise(F.col(c)).alias(c) for c in channels])


def scaled_mad(df, value, keys=KEY) -> DataFrame:
    return group_mad(df, keys, value).select(*keys, (F.col("mad") * 1.4826 + 1e-12).alias("mad"))


# --- patches: membership is computed on the pixel row, so no range join is needed


def _patches(df: DataFrame, rects: Column) -> DataFrame:
    inside = F.filter(
        rects,
        lambda q: (F.col("x") >= q["x0"]) & (F.col("x") < q["x1"]) & (F.col("y") >= q["y0"]) & (F.col("y") < q["y1"]),
    )
    return df.withColumn("_q", F.explode(inside)).withColumn("patch", F.col("_q.id")).drop("_q")


_EDGES = ("x0", "y0", "x1", "y1")


def _patches_of(df: DataFrame, dims: DataFrame, rects: Column, keys) -> DataFrame:
    """Pixels with the number of each rectangle that holds them; the few rectangles are worked out once an image."""
    at = dims.select(*keys, F.explode(rects).alias("_q")).select(*keys, F.col("_q.id").alias("patch"), *[F.col(f"_q.{e}").alias(f"_{e}") for e in _EDGES])
    inside = (F.col("x") >= F.col("_x0")) & (F.col("x") < F.col("_x1")) & (F.col("y") >= F.col("_y0")) & (F.col("y") < F.col("_y1"))
    return attach(df, at, keys).filter(inside).drop(*[f"_{e}" for e in _EDGES])


def _rect(i, x0, y0, x1, y1):
    return F.struct(F.lit(i).alias("id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def dust_patches(df, keys=KEY, channels=RGB) -> DataFrame:
    """Channel-averaged medians of the sky patch grid."""
    w, h, d = F.col("_w"), F.col("_h"), DUST
    rects, span = [], d["hi"] - d["lo"]
    for iy in range(d["gy"]):
        for ix in range(d["gx"]):
            cx, cy = d["lo"] + span * (ix / (d["gx"] - 1)), d["lo"] + span * (iy / (d["gy"] - 1))
            half = d["patch"] / 2
            rects.append(
                _rect(
                    iy * d["gx"] + ix,
                    F.greatest(F.lit(0), half_up(F.lit(cx - half) * w)),
                    F.greatest(F.lit(0), half_up(F.lit(cy - half) * h)),
                    F.least(w, half_up(F.lit(cx + half) * w)),
                    F.least(h, half_up(F.lit(cy + half) * h)),
                )
            )
    big = F.filter(F.array(*rects), lambda q: (q["x1"] - q["x0"] >= d["min_px"]) & (q["y1"] - q["y0"] >= d["min_px"]))
    p = _patches_of(df, image_dims(df, keys), big, keys)
    med = group_median(long_channels(p, [*keys, "patch"], channels), [*keys, "patch", "c"], "v", "m")
    return med.groupBy(*keys, "patch").agg(F.avg("m").alias("m"))


def measure_dust(df, keys=KEY, channels=RGB) -> DataFrame:
    """How much the typical sky patch exceeds the cleanest; fewer than four patches -> zeros."""
    s = dust_patches(df, keys, channels).groupBy(*keys).agg(F.sort_array(F.collect_list("m")).alias("_s"))  # <= 24 values
    n = F.size("_s")

    def q(p):
        return F.element_at("_s", (F.floor(F.lit(p) * (n - 1)) + 1).cast("int"))

    every = df.select(*keys).distinct()
    enough = F.coalesce(n, F.lit(0)) >= DUST["min_patches"]
    r = every.join(s, list(keys), "left").select(
        *keys,
        F.when(enough, q(DUST["clean"])).otherwise(0.0).alias("clean_sky"),
        F.when(enough, q(DUST["typical"])).otherwise(0.0).alias("typical"),
    )
    return r.withColumn("lift", F.greatest(F.lit(0.0), F.col("typical") - F.col("clean_sky"))).withColumn(
        "floor_raise", clip(F.col("lift"), 0.0, DUST["cap"])
    )


def assess_gradient(df, keys=KEY, channels=RGB) -> DataFrame:
    """Perimeter-opposition gradient and the tier it picks; frames under 128 px give nulls."""
    a, w, h = ASSESS, F.col("_w"), F.col("_h")
    e, s, hs = a["inset"], a["size"], a["size"] / 2
    edges = [(e, e), (1 - e - s, e), (e, 1 - e - s), (1 - e - s, 1 - e - s), (0.5 - hs, e), (0.5 - hs, 1 - e - s), (e, 0.5 - hs), (1 - e - s, 0.5 - hs)]
    ends = [(e + s, e + s), (1 - e, e + s), (e + s, 1 - e), (1 - e, 1 - e), (0.5 + hs, e + s), (0.5 + hs, 1 - e), (e + s, 0.5 + hs), (1 - e, 0.5 + hs)]

    def span(lo, hi, n):
        p = F.greatest(F.lit(0), half_up(n * F.lit(lo)))
        q = F.least(n, half_up(n * F.lit(hi)))
        start = F.when(q - p < 4, F.greatest(F.lit(0), F.least(p, n - 4))).otherwise(p)
        return start, F.when(q - p < 4, start + 4).otherwise(q)

    rects = []
    for i, (lo, hi) in enumerate(zip(edges, ends)):
        (x0, x1), (y0, y1) = span(lo[0], hi[0], w), span(lo[1], hi[1], h)
        rects.append(_rect(i, x0, y0, x1, y1))
    dims = image_dims(df, keys)
    big = dims.filter((w >= a["min_frame"]) & (h >= a["min_frame"]))
    p = _patches_of(df, big, F.array(*rects), keys)
    med = group_median(long_channels(p, [*keys, "patch"], channels), [*keys, "patch", "c"], "v", "pm")
    st = channel_stats(df, keys, channels).withColumn("c0", clip(F.col("med") + a["sigma"] * F.col("dev")))
    st = st.withColumn("m", midtones_balance(a["target"], F.col("med") - F.col("c0"))).select(*keys, "c", "c0", "m")
    x = clip(F.when(1.0 - F.col("c0") > 1e-8, (F.col("pm") - F.col("c0")) / (1.0 - F.col("c0"))).otherwise(0.0))
    lum = attach(med, st, [*keys, "c"]).groupBy(*keys, "patch").agg(F.avg(mtf(F.col("m"), x)).alias("v"))
    r = lum.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("_v"))  # 8 values
    r = r.select(*keys, F.element_at("_v", 1).alias("vmin"), F.element_at("_v", -1 - a["drop"]).alias("vmax"))
    g = F.when(F.col("vmax") > 1e-4, (F.col("vmax") - F.col("vmin")) / F.col("vmax")).otherwise(0.0)
    r = r.withColumn("gradient", F.greatest(g, F.lit(0.0)))
    crop, use = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    for least, pct, gc in sorted(TIERS):
        crop = F.when(F.col("gradient") >= least, F.lit(pct)).otherwise(crop)
        use = F.when(F.col("gradient") >= least, F.lit(gc)).otherwise(use)
    r = r.withColumn("crop_percent", crop).withColumn("use_gradient_removal", use)
    return dims.select(*keys).join(r, list(keys), "left")


# --- colour calibration


def _sky_threshold(df, keys, frac=0.30) -> DataFrame:
    """Luminance below which a pixel counts as sky; fewer than 64 such pixels -> every pixel."""
    thr = group_quantiles(df, keys, "_lum", {"_t": linear(frac)})
    n = attach(df.select(*keys, "_lum"), thr, keys).groupBy(*keys).agg(
        F.max("_t").alias("_t"), F.count(F.when(F.col("_lum") <= F.col("_t"), 1)).alias("_n")
    )
    return n.select(*keys, F.when(F.col("_n") >= 64, F.col("_t")).otherwise(float("inf")).alias("_sky"))


def background_neutralize(df, target=0.001, keys=KEY, channels=RGB) -> DataFrame:
    """Move the darkest-sky median of every channel to ``target``; rescale globally if out of range."""
    keys = list(keys)
    d = df.withColumn("_lum", mean_of(channels))
    d = attach(d, _sky_threshold(d, keys), keys)
    bg = wide(channel_medians(d.filter(F.col("_lum") <= F.col("_sky")), keys, channels), keys, {"med": "_bg"}, channels)
    moved = attach(d, bg, keys).select(*keys, "y", "x", *[(F.col(c) - F.col(f"_bg{c}") + target).alias(c) for c in channels])
    rng = moved.groupBy(*keys).agg(
        F.min(F.least(*channels)).alias("_mn"), F.max(F.greatest(*channels)).alias("_mx")
    )
    out = (F.col("_mn") < 0) | (F.col("_mx") > 1)

    def scale(c):
        fixed = F.when(F.col("_mx") > F.col("_mn"), (F.col(c) - F.col("_mn")) / (F.col("_mx") - F.col("_mn"))).otherwise(0.0)
        return F.when(out, fixed).otherwise(F.col(c)).alias(c)

    return attach(moved, rng, keys).select(*keys, "y", "x", *[scale(c) for c in channels])


def white_balance_structure(df, white_high=0.9, bg_high=0.3, keys=KEY, channels=RGB) -> DataFrame:
    """Gains that make the brightest unsaturated structure neutral, anchored at the background."""
    keys = list(keys)
    d = df.withColumn("_lum", mean_of(channels))
    valid = d.filter((F.col("_lum") >= 0) & (F.col("_lum") <= white_high))
    rank = at_rank(lambda n: n - F.least(n, F.greatest(F.lit(64), F.ceil(F.lit(0.01) * n))))
    thr = group_quantiles(valid, keys, "_lum", {"_thr": rank})
    d = attach(attach(d, _sky_threshold(d, keys), keys), thr, keys, "left")
    struct = (F.col("_lum") >= F.col("_thr")) & (F.col("_lum") <= white_high)
    mid = (F.col("_lum") >= 0) & (F.col("_lum") <= bg_high)
    sky = mid & (F.col("_lum") <= F.col("_sky"))
    tally = d.groupBy(*keys).agg(
        F.count(F.when(struct, 1)).alias("_ns"), F.count(F.when(sky, 1)).alias("_nb"), F.count(F.when(mid, 1)).alias("_nm"),
        *[F.avg(F.when(struct, F.col(c))).alias(f"_w{c}") for c in channels],
    )
    d = attach(d, tally, keys)
    in_bg = F.when(F.col("_nb") >= 64, sky).when(F.col("_nm") > 0, mid).otherwise(F.lit(True))
    bg = wide(channel_medians(d.filter(in_bg), keys, channels), keys, {"med": "_b"}, channels)
    d = attach(d, bg, keys)
    lift = [F.col(f"_w{c}") - F.col(f"_b{c}") for c in channels]
    ok = F.coalesce((F.col("_ns") >= 64) & (F.least(*lift) > 0), F.lit(False))

    def one(c, up):
        f = F.least(*lift) / up
        return F.when(ok, clip(F.col(f"_b{c}") + (F.col(c) - F.col(f"_b{c}")) * f)).otherwise(F.col(c)).alias(c)

    return d.select(*keys, "y", "x", *[one(c, u) for c, u in zip(channels, lift)])


def color_calibrate(df, target=0.001, keys=KEY) -> DataFrame:
    """Neutral background, neutral structure, neutral background again."""
    first = cut(background_neutralize(df, target, keys))
    return background_neutralize(cut(white_balance_structure(first, keys=keys)), target, keys)


