"""Measured advice: image metrics, suggested steps, frame report."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions import kernels as Kn
from skyframe.functions.math import clip, midtones_balance, mtf
from skyframe.functions.quantiles import attach, group_median, group_quantiles, linear
from skyframe.operators.overlap import map_overlap
from skyframe.operators.pixel import luma
from skyframe.operators.stats import ASSESS, KEY, RGB, assess_gradient, channel_stats, measure_dust
from skyframe.operators.stencil import noise_sigma
from skyframe.operators.surface import dark_lane_model, gradient_span
from skyframe.session import cut


def _box16(a: np.ndarray) -> np.ndarray:
    """Mean over sixteen lines, eight before and seven after."""
    taps = np.array([1.0] * 16 + [0.0]) / 16
    return Kn.correlate_axis(Kn.correlate_axis(a, taps, 0), taps, 1)


def metrics(df, keys=KEY) -> DataFrame:
    """One row per image: background levels, colour noise, noise, mid-scale spread, range, chroma, blown share, gradient."""
    keys = list(keys)
    d = df.withColumns({c: clip(F.col(c)) for c in RGB}).withColumn("L", luma())

    def kernel(a, _):
        hp = lambda v: v - Kn.rank_filter(v, 3, "mean")
        return {"hp": hp(a["L"]), "rg": hp(a["r"] - a["g"]), "gb": hp(a["g"] - a["b"]), "mid": a["L"] - _box16(a["L"])}

    m = cut(map_overlap(d, keys, [*RGB, "L"], 8, kernel, ["hp", "rg", "gb", "mid"], "nearest", carry=[*RGB, "L"]))
    q = group_quantiles(m, keys, "L", {"bg": linear(0.5), "_p80": linear(0.8), "_p995": linear(0.995)}, "n")
    for c in RGB:
        q = q.join(group_quantiles(m, keys, c, {f"bg_{c}": linear(0.35)}), keys)
    for c in ("rg", "gb"):
        q = q.join(group_median(m, keys, F.abs(F.col(c)), f"_{c}"), keys)
    q = cut(q)
    j = attach(m, q, keys)
    dark, bright = F.col("L") < F.col("bg") + 0.05, F.col("L") > F.col("bg") + 0.05
    n = cut(attach(j, j.groupBy(*keys).agg(F.count(F.when(dark, 1)).alias("_nd"), F.count(F.when(bright, 1)).alias("_nb")), keys))
    use_noise = F.when(F.col("_nd") > 500, dark).otherwise(True)
    use_sat = F.when(F.col("_nb") >= 500, bright).otherwise(F.col("L") > F.col("_p80"))
    noise = group_median(n.filter(use_noise), keys, F.abs(F.col("hp")), "_ln")
    agg = n.groupBy(*keys).agg(
        F.stddev_pop("mid").alias("mid_spread"), F.avg((F.col("L") > 0.98).cast("double")).alias("blown"),
        F.coalesce(F.avg(F.when(use_sat, F.greatest(*RGB) - F.least(*RGB))), F.lit(0.0)).alias("chroma"),
    )
    ptp = gradient_span(df.withColumns({c: clip(F.col(c)) for c in RGB}), luma(), keys=keys)
    r = q.join(noise, keys).join(agg, keys).join(ptp, keys)
    return r.select(
        *keys, "ptp", "bg", *[f"bg_{c}" for c in RGB], ((F.col("_rg") + F.col("_gb")) * (0.5 * 1.4826)).alias("chroma_noise"), (F.col("_ln") * 1.4826).alias("noise"),
        "mid_spread", (F.col("_p995") - F.col("bg")).alias("spread"), "chroma", "blown",
    )


def suggest(m: DataFrame, keys=KEY) -> DataFrame:
    """Suggested steps with one strength each, from the metrics row: a small rule table per image."""
    hi, lo = F.greatest("bg_r", "bg_g", "bg_b"), F.least("bg_r", "bg_g", "bg_b")
    green = F.col("bg_g") - (F.col("bg_r") + F.col("bg_b")) * 0.5
    col = F.col
    rules: list[tuple[str, str, Column, Column, int]] = [
        ("gradient_cleanup", "strength", col("ptp") > 0.02, F.least(F.lit(1.0), col("ptp") / 0.08), 2),
        ("bg_neutralize", "target", hi - lo > 0.008, clip(lo, 0.0, 0.2), 3),
        ("scnr", "amount", green > 0.006, F.least(F.lit(1.0), green / 0.03), 2),
        ("deveil", "amount", (col("bg") > 0.08) & (col("bg_r") - col("bg_b") > 0.01), F.least(F.lit(0.8), (col("bg") - 0.05) / 0.15), 2),
        ("chroma_nr", "amount", col("chroma_noise") > 0.01, F.least(F.lit(1.0), col("chroma_noise") / 0.03), 2),
        ("noise_reduction", "amount", col("noise") > 0.006, F.least(F.lit(0.85), col("noise") / 0.02), 2),
        ("local_contrast", "amount", col("mid_spread") < 0.02, F.lit(0.12), 2),
        ("contrast", "pivot", col("spread") < 0.35, col("bg"), 2),
        ("saturation", "amount", col("chroma") < 0.10, clip((F.lit(0.10) - col("chroma")) / 0.10 * 0.3 + 0.15, 0.0, 0.5), 2),
        ("highlight_rolloff", "knee", col("blown") > 0.002, F.lit(0.82), 2),
    ]
    items = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(p).alias("param"), F.bround(v, d).alias("value"))) for i, (n, p, on, v, d) in enumerate(rules)]))
    return m.select(*keys, F.explode(items).alias("_s")).select(*keys, "_s.*")


def frame_report(df, params: DataFrame, keys=KEY) -> DataFrame:
    """Readings and recommended settings: rows (image, kind, key, value, label).

    ``params``: object_class, inputStretched, gradientCleanup, reduceCast, darkLaneGC, useMask,
    dehaze, chromaNR per image.
    """
    keys = list(keys)
    a = assess_gradient(df, keys).select(*keys, "gradient")
    dust = measure_dust(df, keys).select(*keys, "clean_sky", "typical")
    noise = noise_sigma(df, keys=keys).groupBy(*keys).agg(F.avg("sigma").alias("sigma"))
    st = channel_stats(df, keys).withColumn("c0", clip(F.col("med") + ASSESS["sigma"] * F.col("dev")))
    st = cut(st.withColumn("m", midtones_balance(ASSESS["target"], F.col("med") - F.col("c0"))).join(dust, keys))

    def vis(v):
        return mtf(F.col("m"), clip(F.when(1.0 - F.col("c0") > 1e-8, (v - F.col("c0")) / (1.0 - F.col("c0"))).otherwise(0.0)))

    lift = st.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.avg(vis(F.col("typical"))) - F.avg(vis(F.col("clean_sky")))).alias("lift"))
    tilt = dark_lane_model(df, keys).groupBy(*keys).agg(F.max(F.col("hi") - F.col("lo")).alias("tilt"), F.max("kept").alias("anchors"))
    d = params.join(a, keys, "left").join(dust, keys, "left").join(noise, keys, "left").join(lift, keys, "left").join(tilt, keys, "left")
    d = d.withColumn("pct", F.when(F.col("clean_sky") > 1e-7, F.col("sigma") * 100.0 / F.col("clean_sky")).otherwise(0.0))
    c, linear_in = F.col, ~F.col("inputStretched")
    g, measured = c("gradient"), c("gradient").isNotNull()
    sev = F.when(~measured, "frame too small").when(g >= 0.45, "strong").when(g >= 0.20, "moderate").otherwise("low")
    dusty = F.when(c("lift") >= 0.015, F.when(g >= 0.5, "light pollution, not dust").when(c("object_class").isin("emission", "generic"), "dusty field").otherwise("elevated")).when(c("lift") >= 0.008, "mild dust").otherwise("clean")
    snr = F.when(c("pct") >= 5, "low SNR").when(c("pct") >= 2, "moderate SNR").when(c("pct") > 0, "deep")
    rows = [
        ("reading", "gradient", F.lit(True), F.round(g, 2), sev), ("reading", "dust_lift", linear_in & measured & (c("typical") > 0), F.round(c("lift"), 3), dusty),
        ("reading", "noise", linear_in, F.round(c("sigma"), 6), snr), ("reading", "tilt", linear_in & c("tilt").isNotNull(), F.round(c("tilt"), 4), F.concat(c("anchors").cast("string"), F.lit(" anchors"))),
        ("change", "gradientCleanup", (g >= 0.85) & (c("gradientCleanup") < 0.3), F.lit(0.4), F.lit("flatten residual mottle")), ("change", "reduceCast", (g >= 0.85) & ~c("reduceCast"), F.lit(1.0), F.lit("desaturate the tint left by light pollution")),
        ("change", "darkLaneGC", (g >= 0.85) & ~c("darkLaneGC"), F.lit(1.0), F.lit("remove the residual tilt")), ("change", "useMask", (g >= 0.5) & c("object_class").isin("emission", "generic") & c("useMask"), F.lit(0.0), F.lit("the mask would keep a milky veil")),
        ("change", "dehaze", (g >= 0.5) & (c("dehaze") < 0.5), F.lit(0.7), F.lit("clip the veil and its tint")), ("change", "chromaNR", linear_in & (c("pct") >= 5) & (c("chromaNR") < 0.5), F.lit(0.6), F.lit("colour speckle dominates")),
    ]
    items = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(k).alias("kind"), F.lit(n).alias("key"), v.cast("double").alias("value"), t.alias("label"))) for k, n, on, v, t in rows]))
    return d.select(*keys, F.explode(items).alias("_r")).select(*keys, "_r.*")
