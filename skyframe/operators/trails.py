"""Transient trails: detection, layers and display."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions import kernels as Kn
from skyframe.functions.math import clip
from skyframe.functions.quantiles import attach, group_mad, group_quantiles, linear
from skyframe.operators.components import label_components
from skyframe.operators.overlap import image_dims, map_overlap
from skyframe.session import cut


def dilate(mask: DataFrame, keys: Sequence[str], steps: int, dims: DataFrame) -> DataFrame:
    """Diamond dilation of a sparse mask, kept inside the image."""
    offs = [(dy, dx) for dy in range(-steps, steps + 1) for dx in range(-steps, steps + 1) if abs(dy) + abs(dx) <= steps]
    around = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offs])
    d = mask.select(*keys, "y", "x", F.explode(around).alias("_o")).select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))
    d = d.distinct().join(dims, list(keys))
    return d.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w"))).select(*keys, "y", "x")


def component_shape(lab: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area, box, principal-axis aspect and length of every component from its moments."""
    g = lab.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("x").alias("x1"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.var_pop("y").alias("_vy"), F.var_pop("x").alias("_vx"), F.covar_pop("y", "x").alias("_c"),
    )
    half, gap = (F.col("_vy") + F.col("_vx")) / 2, F.sqrt(F.pow((F.col("_vx") - F.col("_vy")) / 2, 2) + F.col("_c") * F.col("_c"))
    major, minor = F.sqrt(F.greatest(half + gap, F.lit(1e-9))), F.sqrt(F.greatest(half - gap, F.lit(1e-9)))
    thin = F.col("area") < 3
    return g.withColumns(
        {
            "aspect": F.when(thin, 1.0).otherwise(major / F.greatest(minor, F.lit(1e-6))), "length": F.when(thin, 0.0).otherwise(major * 4.0),
            "angle": F.atan2(F.col("_c") * 2, F.col("_vx") - F.col("_vy")) / 2,
        }
    ).drop("_vy", "_vx", "_c")


def detect_trails(transient: DataFrame, keys=("target_id",), floor=0.006, min_seg=6, connect=2, min_area=20, max_frac=0.02, min_aspect=4.0, min_length=40.0, min_share=0.6, frames: DataFrame | None = None):
    """(trails, labelled trail pixels) from rows (keys, y, x, v, frame).

    Bright pixels are grouped, specks dropped, gaps bridged, and the long thin groups that come
    mostly from one frame are kept.  ``frames`` (keys, frame, path, captured_at) names the source.
    """
    keys = list(keys)
    st = group_mad(transient, keys, "v", "_d", "_m").select(*keys, F.greatest(F.lit(floor), F.col("_d") * (8.0 * 1.4826)).alias("_thr"))
    dims = cut(image_dims(transient, keys))
    bright = attach(transient, st, keys).filter(F.col("v") > F.col("_thr")).select(*keys, "y", "x")
    first = cut(label_components(bright, keys))
    solid = first.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_seg)
    seeds = first.join(solid, [*keys, "label"], "left_semi").select(*keys, "y", "x")
    lab = cut(label_components(dilate(seeds, keys, connect, dims) if connect else seeds, keys))
    shape = component_shape(lab, keys).join(dims, keys)
    shape = shape.filter((F.col("area") >= min_area) & (F.col("area") <= F.floor(F.col("_h") * F.col("_w") * max_frac)) & (F.col("aspect") >= min_aspect) & (F.col("length") >= min_length))
    rows = lab.join(shape.select(*keys, "label"), [*keys, "label"], "left_semi").join(transient.select(*keys, "y", "x", "v", "frame").hint("merge"), [*keys, "y", "x"])
    rows = cut(rows)
    peak = rows.groupBy(*keys, "label").agg(F.max("v").alias("peak"))
    src = rows.filter(F.col("frame").isNotNull()).groupBy(*keys, "label", "frame").agg(F.count(F.lit(1)).alias("_n"))
    dom = src.groupBy(*keys, "label").agg(F.sum("_n").alias("_all"), F.max(F.struct("_n", (-F.col("frame")).alias("_f"))).alias("_best"))
    dom = dom.select(*keys, "label", (-F.col("_best._f")).alias("frame"), (F.col("_best._n") / F.col("_all")).alias("single_frame_frac")).filter(F.col("single_frame_frac") >= min_share)
    trails = shape.join(dom, [*keys, "label"]).join(peak, [*keys, "label"])
    order = Window.partitionBy(*keys).orderBy("label")  # the trails of one master: a handful
    trails = trails.withColumn("trail_id", F.row_number().over(order)).select(
        *keys, "trail_id", "label", "frame", "area", F.round("aspect", 2).alias("aspect"), F.round("length", 1).alias("length"), F.round("single_frame_frac", 2).alias("single_frame_frac"), "peak", "y0", "x0", "y1", "x1", "cy", "cx", "angle"
    )
    if frames is not None:
        trails = trails.join(frames, [*keys, "frame"], "left")
    trails = cut(trails)
    return trails, rows.join(trails.select(*keys, "label", "trail_id"), [*keys, "label"]).select(*keys, "y", "x", "trail_id")


def trail_layer(transient: DataFrame, trail_px: DataFrame, keys=("target_id",), feather=2.0) -> DataFrame:
    """Transient light through the feathered trail mask, with the id of the trail each pixel serves."""
    keys = list(keys)
    d = transient.join(trail_px.select(*keys, "y", "x", "trail_id").hint("merge"), [*keys, "y", "x"], "left")
    d = d.withColumn("_id", F.coalesce(F.col("trail_id").cast("double"), F.lit(0.0)))
    r = 3 + Kn.gaussian_radius(feather)

    def kernel(a, _):
        on = (a["_id"] > 0).astype(float)
        for _i in range(3):  # diamond growth
            p = np.pad(on, 1)
            on = np.maximum.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
        return {"mask": np.clip(Kn.gaussian(on, feather), 0, 1), "near": Kn.rank_filter(a["_id"], 7, "max")}

    m = map_overlap(d, keys, ["_id"], r, kernel, ["mask", "near"], "reflect", carry=["v"])
    return m.select(*keys, "y", "x", (F.col("v") * F.col("mask")).alias("v"), "mask", F.col("near").cast("int").alias("trail_id"))


def select_trails(layer: DataFrame, ids: DataFrame | None, keys=("target_id",)) -> DataFrame:
    """Keep the light of chosen trails only."""
    if ids is None:
        return layer
    hit = ids.select(*keys, "trail_id", F.lit(True).alias("_on")).distinct()
    return layer.join(hit, [*keys, "trail_id"], "left").withColumn("v", F.when(F.col("_on"), F.col("v")).otherwise(0.0)).drop("_on")


def develop_trails(layer: DataFrame, strength=1.0, k=10.0, target=0.75, keys=("target_id",)) -> DataFrame:
    """Asinh display of the trail light, scaled by the p99.5 of its positive part."""
    s = min(1.0, max(0.0, strength))
    keys = list(keys)
    ref = group_quantiles(layer.filter(F.col("v") > 1e-6), keys, "v", {"_q": linear(0.995)})
    out = F.asinh(F.col("v") / F.greatest("_q", F.lit(1e-4)) * k) / F.asinh(F.lit(k)) * (target * s)
    lit = F.coalesce((F.col("v") > 1e-6) & F.col("_q").isNotNull(), F.lit(False))
    return attach(layer, ref, keys, "left").withColumn("v", F.when(lit & F.lit(s > 0), clip(out)).otherwise(0.0)).drop("_q")


def taper(dev: DataFrame, keys=("target_id",), fade=0.12, min_fade=25.0, max_fade=180.0, min_ramp=8.0, margin=3.0, asym=0.6) -> DataFrame:
    """Fade both ends of every trail along its axis; ends cut by the frame border stay."""
    keys = list(keys)
    dims = image_dims(dev, keys)
    on = dev.filter("trail_id > 0")
    shape = component_shape(on.withColumnRenamed("trail_id", "label"), keys).withColumnRenamed("label", "trail_id")
    d = on.join(shape.filter("area >= 8").select(*keys, "trail_id", "cy", "cx", "angle"), [*keys, "trail_id"])
    d = d.withColumn("_t", (F.col("x") - F.col("cx")) * F.cos("angle") + (F.col("y") - F.col("cy")) * F.sin("angle"))
    tid = [*keys, "trail_id"]
    ends = d.groupBy(*tid).agg(
        F.min("_t").alias("_t0"), F.max("_t").alias("_t1"), F.min(F.struct("_t", "y", "x")).alias("_a"), F.max(F.struct("_t", "y", "x")).alias("_z"),
    )
    d = cut(d.join(ends, tid).join(dims, keys))
    seg = (F.col("_t1") - F.col("_t0")) / 3.0
    med = group_quantiles(d.filter(F.col("_t") <= F.col("_t0") + seg), tid, "v", {"_b0": linear(0.5)}).join(
        group_quantiles(d.filter(F.col("_t") >= F.col("_t1") - seg), tid, "v", {"_b1": linear(0.5)}), tid
    )
    d = attach(d, med, tid)
    length = F.col("_t1") - F.col("_t0")
    base = F.least(clip(length * fade, min_fade, max_fade), length * 0.5)
    hi, lo = F.greatest("_b0", "_b1"), F.least("_b0", "_b1")
    skew = F.when(hi > 1e-6, (1.0 - lo / hi) * asym).otherwise(0.0)

    def border(e):
        return (F.col(f"{e}.y") <= margin) | (F.col(f"{e}.x") <= margin) | (F.col(f"{e}.y") >= F.col("_h") - 1 - margin) | (F.col(f"{e}.x") >= F.col("_w") - 1 - margin)

    weak0 = F.col("_b0") <= F.col("_b1")
    f0 = F.when(border("_a"), 0.0).otherwise(clip(base * F.when(weak0, skew + 1.0).otherwise(1.0 - skew * 0.6), min_ramp, max_fade))
    f1 = F.when(border("_z"), 0.0).otherwise(clip(base * F.when(weak0, 1.0 - skew * 0.6).otherwise(skew + 1.0), min_ramp, max_fade))
    d = d.withColumns({"_f0": f0, "_f1": f1, "_len": length})
    squeeze = F.when(F.col("_f0") + F.col("_f1") > F.col("_len"), F.col("_len") / (F.col("_f0") + F.col("_f1"))).otherwise(1.0)
    d = d.withColumn("_k", squeeze)

    def ramp(dist, f):
        t = F.when(F.col(f) <= 0, 1.0).otherwise(clip(dist / (F.col(f) * F.col("_k"))))
        return t * t * (F.lit(3.0) - t * 2.0)

    env = F.when(F.col("_len") < 1, 1.0).otherwise(ramp(F.col("_t") - F.col("_t0"), "_f0") * ramp(F.col("_t1") - F.col("_t"), "_f1"))
    e = d.select(*keys, "y", "x", env.alias("_env"))
    return dev.join(e.hint("merge"), [*keys, "y", "x"], "left").withColumn("v", F.col("v") * F.coalesce("_env", F.lit(1.0))).drop("_env")
