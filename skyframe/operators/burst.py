"""Bursts: grading, shift search, registration, noise model, alignment points."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import DoubleType

from skyframe.functions import kernels as Kn
from skyframe.functions.math import clip
from skyframe.functions.quantiles import attach, group_mad, group_median, group_quantiles, linear, upper_median
from skyframe.functions.ranking import top_k
from skyframe.operators.overlap import halo_tiles, image_dims, map_overlap
from skyframe.operators.quality import evenly_spaced
from skyframe.operators.stack import frame_stats, normalize_to_ref, temporal_median
from skyframe.operators.stencil import gradient, resize, smooth
from skyframe.session import cut

FRAME = ["target_id", "frame_id"]


def tapered(df, value="mag", taper=24, keys=("image_id",)) -> DataFrame:
    """Rescale to [0, 1] per image and fade the borders with a raised cosine."""
    keys = list(keys)
    rng = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    d = attach(attach(df, rng, keys), image_dims(df, keys), keys)
    t = F.least(F.lit(taper), F.floor(F.col("_h") / 2), F.floor(F.col("_w") / 2))

    def fade(i):
        return F.when((t > 0) & (i < t), (1.0 - F.cos(i * math.pi / t)) * 0.5).otherwise(1.0)

    v = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    w = fade(F.col("y")) * fade(F.col("_h") - 1 - F.col("y")) * fade(F.col("x")) * fade(F.col("_w") - 1 - F.col("x"))
    return d.withColumn(value, v * w).drop("_lo", "_hi", "_h", "_w")


def grade_frames(df, value="v", keys=("image_id",)) -> DataFrame:
    """Sharpness (deviation of the tapered gradient) and p99.9 brightness of every frame."""
    keys = list(keys)
    g = tapered(cut(gradient(df, value, keys)), keys=keys)
    return g.groupBy(*keys).agg(F.stddev_pop("mag").alias("sharp")).join(group_quantiles(df, keys, value, {"p999": linear(0.999)}), keys)


def correlate(pairs: DataFrame, radius: int, keys=tuple(FRAME)) -> DataFrame:
    """Sum of ref * tgt over every offset within ``radius``: partial sums per tile, then one small sum.

    ``pairs`` holds both images on the same pixel rows (keys, y, x, ref, tgt).
    """
    keys, r, t = list(keys), int(radius), 128
    tiles = halo_tiles(pairs, keys, ["ref", "tgt"], (r, r), (t, t))
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", dy int, dx int, s double"

    def run(p: pa.Table) -> pa.Table:
        y0, x0 = p.column("_ty")[0].as_py() * t, p.column("_tx")[0].as_py() * t
        yy, xx = p.column("_vy").to_numpy() - y0 + r, p.column("_vx").to_numpy() - x0 + r
        # no larger than what the tile holds: small frames fill a corner of it
        h, w = (min(t, max(1, int(c.max()) + 1 - r)) for c in (yy, xx))
        ref, tgt = np.zeros((h + 2 * r, w + 2 * r)), np.zeros((h + 2 * r, w + 2 * r))
        ref[yy, xx], tgt[yy, xx] = (np.nan_to_num(p.column(c).to_numpy().astype(float)) for c in ("ref", "tgt"))
        sums = np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(tgt, (h, w)), ref[r : r + h, r : r + w])
        dy, dx = np.divmod(np.arange(sums.size, dtype=np.int32), 2 * r + 1)
        own = [pa.repeat(p.column(k)[0], sums.size) for k in keys]
        return pa.Table.from_arrays([*own, pa.array((dy - r).astype(np.int32)), pa.array((dx - r).astype(np.int32)), pa.array(sums.ravel())], names=[*keys, "dy", "dx", "s"])

    return tiles.groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema).groupBy(*keys, "dy", "dx").agg(F.sum("s").alias("s"))


def best_shift(corr: DataFrame, keys=tuple(FRAME)) -> DataFrame:
    """Peak offset of each pair, refined by a log parabola per axis (at most half a pixel)."""
    keys = list(keys)
    rng = corr.groupBy(*keys).agg(F.min("s").alias("_lo"), F.max("s").alias("_hi"), F.max(F.struct("s", (-F.col("dy")).alias("a"), (-F.col("dx")).alias("b"))).alias("_p"))
    c = attach(corr, rng, keys).withColumn("_v", F.when(F.col("_hi") > F.col("_lo"), (F.col("s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0))
    py, px = -F.col("_p.a"), -F.col("_p.b")

    def at(dy, dx):
        return F.max(F.when((F.col("dy") == py + dy) & (F.col("dx") == px + dx), F.col("_v")))

    g = c.groupBy(*keys).agg(
        F.first(py).alias("_py"), F.first(px).alias("_px"), at(0, 0).alias("_c"), at(-1, 0).alias("_u"), at(1, 0).alias("_d"), at(0, -1).alias("_l"), at(0, 1).alias("_r")
    )

    def parabola(m, p):
        fm, fc, fp = (F.ln(F.greatest(F.col(k), F.lit(1e-12))) for k in (m, "_c", p))
        d = fm - fc * 2.0 + fp
        ok = F.col(m).isNotNull() & F.col(p).isNotNull() & (F.abs(d) >= 1e-12)
        return F.when(ok, clip((fm - fp) * 0.5 / d, -0.5, 0.5)).otherwise(0.0)

    return g.select(*keys, (F.col("_px") + parabola("_l", "_r")).alias("dx"), (F.col("_py") + parabola("_u", "_d")).alias("dy"))


def pair_with_reference(px: DataFrame, reference: DataFrame, value="v") -> DataFrame:
    """Every frame's pixels beside its target's reference frame (reference: target_id, frame_id)."""
    ref = px.join(reference, FRAME, "left_semi").select("target_id", "y", "x", F.col(value).alias("ref"))
    return px.select(*FRAME, "y", "x", F.col(value).alias("tgt")).join(ref.hint("merge"), ["target_id", "y", "x"])


def whole_shift(pairs: DataFrame, keys=tuple(FRAME)) -> DataFrame:
    """Offset of each pair over the whole frame (keys, dx, dy), for frames reduced to a bounded side.

    The correlation at every offset comes from one Fourier product of the zero-padded frames.
    """
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", dx double, dy double"

    def run(t: pa.Table) -> pa.Table:
        y, x = t.column("y").to_numpy(), t.column("x").to_numpy()
        sides = []
        for c in ("ref", "tgt"):
            a = np.zeros((1, int(y.max()) + 1, int(x.max()) + 1))
            a[0, y, x] = np.nan_to_num(t.column(c).to_numpy().astype(float))
            sides.append(a)
        dy, dx = _peaks(*sides)
        return pa.Table.from_arrays([*[pa.repeat(t.column(k)[0], 1) for k in keys], pa.array(dx), pa.array(dy)], names=[*keys, "dx", "dy"])

    return pairs.groupBy(*keys).applyInArrow(run, schema)


def _reduced(px: DataFrame, factor) -> DataFrame:
    """Tapered gradient of block means, ``factor`` pixels a side."""
    small = px.groupBy(*FRAME, F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("v").alias("v"))
    return cut(tapered(gradient(small, "v", FRAME), keys=FRAME))


def register_burst(px: DataFrame, reference: DataFrame, side=128, fine_radius=3, accept=64.0, max_drift=220.0) -> DataFrame:
    """Offsets of every frame by a pyramid, then a full-resolution window about the disc.

    Each target's coarsest level has at most ``side`` pixels a side, so the first search covers the
    whole frame whatever its size; every further level is four times finer and refines the last.
    The refined offset is used while it stays within ``accept`` pixels; larger drifts are flagged.
    """
    dims = cut(image_dims(px, FRAME))
    factor = F.pow(F.lit(4.0), F.greatest(F.lit(0.0), F.ceil(F.log(4.0, F.greatest("_h", "_w") / float(side)) - 1e-9))).cast("int")
    level = cut(dims.withColumn("_f", factor).groupBy("target_id").agg(F.max("_f").alias("_f")))
    first = whole_shift(pair_with_reference(_reduced(attach(px, level, ["target_id"]), F.col("_f")), reference, "mag"))
    first = attach(first, level, ["target_id"])
    first = cut(first.select(*FRAME, F.rint(F.col("dx") * F.col("_f")).cast("int").alias("_ix"), F.rint(F.col("dy") * F.col("_f")).cast("int").alias("_iy"), (F.hypot("dx", "dy") * F.col("_f")).alias("drift")))
    step = (level.agg(F.max("_f")).first()[0] or 1) // 4
    while step > 1:
        here = attach(px, level.filter(F.col("_f") > step), ["target_id"])
        moved = here.join(first, FRAME).join(dims, FRAME).select(*FRAME, (F.col("y") - F.col("_iy")).alias("y"), (F.col("x") - F.col("_ix")).alias("x"), "v", "_h", "_w")
        moved = moved.filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w")))
        ref = _reduced(here.join(reference, FRAME, "left_semi"), step).select("target_id", "y", "x", F.col("mag").alias("ref"))
        both = _reduced(moved, step).select(*FRAME, "y", "x", F.col("mag").alias("tgt")).join(ref.hint("merge"), ["target_id", "y", "x"])
        more = best_shift(correlate(both, fine_radius)).select(*FRAME, F.rint(F.col("dx") * step).cast("int").alias("_mx"), F.rint(F.col("dy") * step).cast("int").alias("_my"))
        plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        first = cut(first.join(more, FRAME, "left").select(*FRAME, plus("_ix", "_mx"), plus("_iy", "_my"), "drift"))
        step //= 4
    moved = px.join(first, FRAME).select(*FRAME, (F.col("y") - F.col("_iy")).alias("y"), (F.col("x") - F.col("_ix")).alias("x"), "v")
    lit = group_quantiles(px.join(reference, FRAME, "left_semi"), ["target_id"], "v", {"_p": linear(0.999)})
    ctr = attach(px.join(reference, FRAME, "left_semi"), lit, ["target_id"]).filter(F.col("v") > F.col("_p") * 0.5).groupBy("target_id").agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    win = moved.join(dims, FRAME).filter((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w")))
    half = F.least("_h", "_w") / 2
    win = attach(win, ctr, ["target_id"]).filter((F.abs(F.col("y") - F.col("_cy")) <= half) & (F.abs(F.col("x") - F.col("_cx")) <= half)).select(*FRAME, "y", "x", "v")
    gy = cut(gradient(win, "v", FRAME))
    ref = gradient(px.join(reference, FRAME, "left_semi"), "v", FRAME).select("target_id", "y", "x", F.col("mag").alias("ref"))
    second = best_shift(correlate(gy.select(*FRAME, "y", "x", F.col("mag").alias("tgt")).join(ref.hint("merge"), ["target_id", "y", "x"]), fine_radius)).select(*FRAME, F.col("dx").alias("_rx"), F.col("dy").alias("_ry"))
    ok = F.coalesce(F.hypot("_rx", "_ry") < accept, F.lit(False))
    return first.join(second, FRAME, "left").select(
        *FRAME, (F.col("_ix") + F.when(ok, F.col("_rx")).otherwise(0.0)).alias("dx"), (F.col("_iy") + F.when(ok, F.col("_ry")).otherwise(0.0)).alias("dy"), "drift", (F.col("drift") > max_drift).alias("excluded")
    )


def burst_mean(px: DataFrame, kept: DataFrame, value="v") -> DataFrame:
    """Mean of the kept frames per pixel: sums and counts combine before the shuffle."""
    return px.join(kept.select(*FRAME), FRAME, "left_semi").groupBy("target_id", "y", "x").agg(clip(F.avg(value)).alias("v"), F.count(value).alias("n"))


def measure_dither(offsets: DataFrame, reference: DataFrame, cap=9) -> DataFrame:
    """Median drift of at most nine evenly spaced frames other than the reference."""
    others = offsets.join(reference, FRAME, "left_anti")
    probes = evenly_spaced(others, cap, ["target_id"])
    m = group_median(probes, ["target_id"], F.hypot("dx", "dy"), "dither")
    n = probes.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_probes"))
    return m.join(n, "target_id")


def fine_grid(measures: DataFrame, keys=("session_id",)) -> DataFrame:
    """2 where the typical star is under 2.5 px wide and at least eight frames exist, else 1."""
    keys = list(keys)
    q = group_quantiles(measures.filter("stars > 0"), keys, "fwhm", {"_f": linear(0.5)}, "_n")
    return q.select(*keys, F.when((F.col("_f") < 2.5) & (F.col("_n") >= 8), 2).otherwise(1).alias("factor"))


def static_pattern(px: DataFrame, frames: DataFrame, dither: DataFrame) -> DataFrame:
    """Fixed sensor pattern per target: temporal median minus its smooth sky, soft-thresholded.

    ``dither`` holds (target_id, dither, fwhm).  Targets with too little dither, under five frames
    or without significant pattern give no rows.
    """
    n = frames.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n"))
    ok = dither.join(n, "target_id").filter((F.col("dither") >= F.greatest(F.col("fwhm") * 2.0, F.lit(3.0))) & (F.col("dither") / 3.0 >= 1.2) & (F.col("_n") >= 5))
    ok = cut(ok.select("target_id", (F.col("dither") / 3.0).alias("_sg")))
    widest = ok.agg(F.max("_sg")).first()[0]
    src = px.join(ok.select("target_id"), "target_id", "left_semi")
    med = cut(temporal_median(src, frames))
    dev = src.join(med.select("target_id", "y", "x", F.col("v").alias("_m")).hint("merge"), ["target_id", "y", "x"]).withColumn("v", F.abs(F.col("v") - F.col("_m")))
    tm = temporal_median(dev, frames).withColumnRenamed("v", "tmad")
    d = attach(med.join(tm.hint("merge"), ["target_id", "y", "x"]), ok, ["target_id"])
    r = Kn.gaussian_radius(widest or 1.2)
    sm = map_overlap(d, ["target_id"], ["v"], r, lambda a, p: {"_s": Kn.gaussian(a["v"], float(p["_sg"]))}, ["_s"], "reflect", ["_sg"], ["v", "tmad"])
    d = cut(sm.withColumn("p", F.col("v") - F.col("_s")))
    t0 = group_median(d, ["target_id"], "tmad", "_t0")
    d = attach(d, t0, ["target_id"]).withColumn("_guard", F.col("tmad") < (F.col("_t0") + 1e-12) * 2.5)
    sg = group_mad(d.filter("_guard"), ["target_id"], "p", "_d", "_c").select("target_id", (F.col("_d") * 1.4826 + 1e-12).alias("_sig"))
    d = attach(d, sg, ["target_id"]).withColumn("p", F.when(F.col("_guard"), F.signum("p") * F.greatest(F.abs("p") - F.col("_sig"), F.lit(0.0))).otherwise(0.0))
    rms = d.groupBy("target_id").agg(F.sqrt(F.avg(F.col("p") * F.col("p"))).alias("_rms"), F.max("_sig").alias("_sx")).filter(F.col("_rms") >= F.col("_sx") * 0.25)
    return d.join(rms.select("target_id"), "target_id", "left_semi").select("target_id", "y", "x", "p")


def subtract_pattern(px: DataFrame, pattern: DataFrame) -> DataFrame:
    return px.join(pattern.hint("merge"), ["target_id", "y", "x"], "left").withColumn("v", F.when(F.col("p").isNull(), F.col("v")).otherwise(clip(F.col("v") - F.col("p")))).drop("p")


def chi2_quantile(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution by bisection on its series."""

    def cdf(x):
        a, z = dof / 2, x / 2
        term = total = 1 / a
        k = 1
        while term > total * 1e-16:
            term *= z / (a + k)
            total += term
            k += 1
        return total * math.exp(a * math.log(z) - z - math.lgamma(a))

    lo, hi = 1e-9, 10.0 * dof + 50
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def _debias(dof: pd.Series) -> pd.Series:
    """chi2 quantile (p = 1/4) over dof, by the same series for every number of frames."""
    known = {d: chi2_quantile(0.25, d) / d for d in set(dof.astype(int))}
    return dof.astype(int).map(known)


def photon_transfer(px: DataFrame, frames: DataFrame, min_pixels=10_000, min_bin=500, min_span=1e-4) -> DataFrame:
    """Noise model var = a signal + b per target, from binned lower-quartile variances.

    Every pixel takes part: it collapses to count, mean and variance before the shuffle.
    """
    key = ["target_id"]
    n = frames.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 5")
    p = px.groupBy(*key, "y", "x").agg(F.count("v").alias("_c"), F.avg("v").alias("m"), F.var_samp("v").alias("s2"))
    p = cut(attach(p, n, key).filter(F.col("_c") >= F.greatest(F.lit(5), F.floor(F.col("_n") / 2))))
    q = group_quantiles(p, key, "m", {"_cap": linear(0.8), "m_cap": linear(0.85)}, "_px").join(group_quantiles(p, key, "_c", {"_mc": linear(0.5)}), key).filter(F.col("_px") >= min_pixels)
    q = cut(q.withColumn("_db", _debias(F.greatest(F.floor(F.col("_mc")).cast("int") - 1, F.lit(4)))))
    low = cut(attach(p, q, key).filter(F.col("m") <= F.col("_cap")).select(*key, "m", "s2", "_db", "m_cap"))
    cuts = [0.02 + (0.99 - 0.02) * i / 12 for i in range(13)]
    e = group_quantiles(low, key, "m", {f"_e{i}": linear(c) for i, c in enumerate(cuts)})
    edges = F.array(*[F.struct(F.lit(i).alias("b"), F.col(f"_e{i}").alias("lo"), F.col(f"_e{i + 1}").alias("hi")) for i in range(12)])
    binned = attach(low, e, key).withColumn("_b", F.explode(F.filter(edges, lambda s: (F.col("m") >= s["lo"]) & (F.col("m") < s["hi"])))).select(*key, F.col("_b.b").alias("bin"), "m", "s2", "_db", "m_cap")
    k2 = [*key, "bin"]
    b = group_quantiles(binned, k2, "m", {"c": linear(0.5)}, "w").join(group_quantiles(binned, k2, "s2", {"_v": linear(0.25)}), k2)
    b = cut(attach(b, q.select(*key, "_db", "m_cap"), key).withColumn("e", F.col("_v") / F.col("_db")).filter(F.col("w") >= min_bin))
    wide = b.groupBy(*key).agg(F.count(F.lit(1)).alias("_nb"), (F.max("c") - F.min("c")).alias("_span")).filter((F.col("_nb") >= 4) & (F.col("_span") >= min_span))
    b = b.join(wide.select(*key), key, "left_semi")

    def line(d):
        w, c, v = F.col("w"), F.col("c"), F.col("e")
        s = d.groupBy(*key).agg(F.sum(w).alias("sw"), F.sum(w * c).alias("sc"), F.sum(w * v).alias("se"), F.sum(w * c * c).alias("cc"), F.sum(w * c * v).alias("ce"), F.count(F.lit(1)).alias("_u"))
        a = (F.col("sw") * F.col("ce") - F.col("sc") * F.col("se")) / F.nullif(F.col("sw") * F.col("cc") - F.col("sc") * F.col("sc"), F.lit(0.0))
        return s.withColumn("a", a).select(*key, "a", ((F.col("se") - F.col("a") * F.col("sc")) / F.col("sw")).alias("b"), F.col("_u"))

    one = line(b)
    j = attach(b, one, key).withColumn("_ok", F.col("e") <= F.greatest(F.col("a") * F.col("c") + F.greatest("b", F.lit(0.0)), F.lit(1e-12)) * 2.5)
    two = line(j.filter("_ok").drop("a", "b", "_u")).select(*key, F.col("a").alias("_a2"), F.col("b").alias("_b2"), F.col("_u").alias("_u2"))
    r = one.join(two, key, "left")
    use = (F.col("_u2") >= 4) & (F.col("_u2") < F.col("_u"))
    r = r.select(*key, F.when(use, F.col("_a2")).otherwise(F.col("a")).alias("a"), F.greatest(F.when(use, F.col("_b2")).otherwise(F.col("b")), F.lit(0.0)).alias("b"))
    return r.filter("a > 0").join(q.select(*key, "m_cap"), key)


def local_normalize(px: DataFrame, reference: DataFrame, target=256) -> DataFrame:
    """Global match to the reference, then its smooth low-frequency difference is removed too.

    Blocks are medians at about ``target`` a side; every frame has its own block size.
    """
    g = cut(normalize_to_ref(px, frame_stats(px), reference))
    ref = px.join(reference, FRAME, "left_semi").select("target_id", "y", "x", F.col("v").alias("_r"))
    d = g.join(ref.hint("merge"), ["target_id", "y", "x"]).select(*FRAME, "y", "x", (F.col("v") - F.col("_r")).alias("_d"))
    block = lambda n: F.greatest(F.lit(1), F.floor(F.col(n) / target)).cast("int")
    dims = cut(image_dims(px, FRAME).withColumns({"_bh": block("_h"), "_bw": block("_w")}))
    d = attach(d, dims, FRAME)
    by, bx = F.floor(F.col("y") / F.col("_bh")).cast("int"), F.floor(F.col("x") / F.col("_bw")).cast("int")
    whole = (by < F.floor(F.col("_h") / F.col("_bh"))) & (bx < F.floor(F.col("_w") / F.col("_bw")))
    large = d.filter(((F.col("_bh") > 1) | (F.col("_bw") > 1)) & whole).groupBy(*FRAME, by.alias("y"), bx.alias("x")).agg(F.median("_d").alias("_d"))
    d = cut(d.filter((F.col("_bh") == 1) & (F.col("_bw") == 1)).select(*FRAME, "y", "x", "_d").unionByName(large))
    fill = group_median(d, FRAME, "_d", "_f")
    d = attach(d, fill, FRAME, "left").withColumn("_d", F.coalesce("_d", "_f", F.lit(0.0)))
    s = smooth(d.select(*FRAME, "y", "x", "_d"), "_d", 2.0, "nearest", keys=FRAME)
    s = resize(attach(s.select(*FRAME, "y", "x", "_d"), dims.select(*FRAME, F.col("_h").alias("_nh"), F.col("_w").alias("_nw")), FRAME), "_nh", "_nw", ("_d",), keys=FRAME)
    return g.join(s.hint("merge"), [*FRAME, "y", "x"]).select(*FRAME, "y", "x", (F.col("v") - F.col("_d")).alias("v"))


# --- alignment points


def point_grid(df, size: int, keys=("image_id",)) -> DataFrame:
    """Pixels with every alignment window (half-size step) they belong to: at most four each."""
    step = size // 2
    d = attach(df, image_dims(df, list(keys)), list(keys))

    def wins(p, n):
        last = F.floor((F.col(n) - size) / step)
        lo = F.greatest(F.lit(0), F.floor((F.col(p) - size) / step) + 1)
        hi = F.least(F.floor(F.col(p) / step), last)
        return F.explode(F.when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))))

    d = d.withColumn("_ay", wins("y", "_h")).withColumn("_ax", wins("x", "_w"))
    return d.withColumns({"ay": F.col("_ay") * step, "ax": F.col("_ax") * step}).drop("_ay", "_ax", "_h", "_w")


def point_features(df, size=96, min_lit=0.40, cap=600, stride=1, keys=("image_id",)) -> DataFrame:
    """Trackable alignment points: lit enough, textured in both axes, best ``cap`` by gradient spread.

    Gradients are taken on the whole image, so a window's own border adds no false edges.  ``stride`` may
    thin the pixels that the lit share is taken from.
    """
    keys = list(keys)
    thr = group_quantiles(df, keys, "v", {"_q": linear(0.999)})
    g = gradient(df, "v", keys).join(df.select(*keys, "y", "x", "v").hint("merge"), [*keys, "y", "x"])
    d = point_grid(attach(g, thr, keys), size, keys)
    even = ((F.col("y") - F.col("ay")) % stride == 0) & ((F.col("x") - F.col("ax")) % stride == 0)
    a = cut(
        d.groupBy(*keys, "ay", "ax").agg(
            F.avg(F.when(even, (F.col("v") > F.col("_q") * 0.5).cast("double"))).alias("lit"), F.stddev_pop("mag").alias("q"),
            F.sqrt(F.avg(F.col("gx") * F.col("gx"))).alias("ex"), F.sqrt(F.avg(F.col("gy") * F.col("gy"))).alias("ey"),
        ).filter(F.col("lit") >= min_lit)
    )
    med = group_quantiles(a, keys, "q", {"_m": upper_median()})
    ok = (F.least("ex", "ey") / F.greatest(F.greatest("ex", "ey"), F.lit(1e-12)) >= 0.15) & (F.col("q") >= F.col("_m") * 0.30)
    return top_k(attach(a, med, keys).filter(ok).drop("_m"), keys, [F.col("q").desc(), F.col("ay"), F.col("ax")], cap, "rank")


def _windows(a: np.ndarray, taper: int) -> np.ndarray:
    """Windows (n, height, width) rescaled to [0, 1] with faded borders, as :func:`tapered` does for images."""
    low, span = a.min(axis=(1, 2), keepdims=True), np.ptp(a, axis=(1, 2), keepdims=True)
    a = np.where(span > 0, (a - low) / np.where(span > 0, span, 1.0), 0.0)
    t = min(taper, a.shape[1] // 2, a.shape[2] // 2)
    for axis in (1, 2):
        n = a.shape[axis]
        i = np.minimum(np.arange(n), np.arange(n)[::-1])
        fade = np.where(i < t, (1 - np.cos(i * np.pi / max(t, 1))) * 0.5, 1.0)
        a = a * (fade[:, None] if axis == 1 else fade[None, :])
    return a


def _peaks(ref: np.ndarray, tgt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dy, dx) of the peak of every pair's correlation over all offsets, refined by a log parabola per axis."""
    n, h, w = ref.shape
    s = np.fft.irfft2(np.conj(np.fft.rfft2(ref, (2 * h, 2 * w))) * np.fft.rfft2(tgt, (2 * h, 2 * w)), s=(2 * h, 2 * w))
    s = s - s.min(axis=(1, 2), keepdims=True)
    s /= np.maximum(s.max(axis=(1, 2), keepdims=True), 1e-300)
    far = np.hypot(np.fft.fftfreq(2 * h, 1 / (2 * h))[:, None], np.fft.fftfreq(2 * w, 1 / (2 * w))[None, :])
    near = np.where(s >= s.max(axis=(1, 2), keepdims=True) - 1e-9, far, np.inf).reshape(n, -1).argmin(axis=1)
    i, (py, px) = np.arange(n), np.divmod(near, 2 * w)

    def vertex(m, c, p):
        m, c, p = (np.log(np.maximum(v, 1e-12)) for v in (m, c, p))
        bend = m - 2 * c + p
        flat = np.abs(bend) < 1e-12
        return np.where(flat, 0.0, np.clip(0.5 * (m - p) / np.where(flat, 1.0, bend), -0.5, 0.5))

    fy = vertex(s[i, py - 1, px], s[i, py, px], s[i, (py + 1) % (2 * h), px])
    fx = vertex(s[i, py, px - 1], s[i, py, px], s[i, py, (px + 1) % (2 * w)])
    return np.where(py >= h, py - 2 * h, py) + fy, np.where(px >= w, px - 2 * w, px) + fx


#: Pixels of windows that are measured in one go; a worker's memory follows from it, not from the points of a tile.
PIXELS_AT_ONCE = 1 << 18


def measure_points(px: DataFrame, points: DataFrame, offsets: DataFrame, reference: DataFrame, size: int, taper=12, tile: int | None = None) -> DataFrame:
    """(frame, ay, ax, dx, dy, ox, oy, q): where each alignment point of the reference lies in every frame.

    ``points`` has target_id, ay, ax (window origins), ``offsets`` each frame's whole shift.  A frame is
    moved back by its whole pixels; what is left is measured in the point's window: ``dx, dy`` beyond
    the frame's shift, ``ox, oy`` in all, ``q`` the spread of the window's gradient.  The unit of work is a
    tile of windows with one margin of ``size`` pixels, which serves all points that begin in it.
    Windows that reach outside a frame are left out.
    """
    step = tile or 4 * size
    whole = offsets.select(*FRAME, F.rint("dx").cast("int").alias("ix"), F.rint("dy").cast("int").alias("iy"))
    g = cut(gradient(px, "v", FRAME).select(*FRAME, "y", "x", "mag"))
    ref = g.join(reference.select(*FRAME), FRAME, "left_semi").select("target_id", "y", "x", F.col("mag").alias("ref"))
    moved = g.join(whole, FRAME).select(*FRAME, (F.col("y") - F.col("iy")).alias("y"), (F.col("x") - F.col("ix")).alias("x"), F.col("mag").alias("tgt"))
    both = moved.join(ref.hint("merge"), ["target_id", "y", "x"])

    def tiles(c):
        return F.explode(F.sequence(F.floor(F.greatest(F.col(c) - (size - 1), F.lit(0)) / step), F.floor(F.col(c) / step)))

    both = both.withColumn("_ty", tiles("y")).withColumn("_tx", tiles("x")).select(*FRAME, "_ty", "_tx", "y", "x", "ref", "tgt")
    asked = whole.join(points.select("target_id", F.col("ay").cast("int").alias("ay"), F.col("ax").cast("int").alias("ax")), "target_id")
    asked = asked.withColumns({"_ty": F.floor(F.col("ay") / step), "_tx": F.floor(F.col("ax") / step)})
    at = [*FRAME, "_ty", "_tx"]
    # a tile's points come before its pixels; tiles follow each other, and a worker takes as many as its batch holds
    rows = asked.select(*at, F.lit(0).alias("_kind"), F.col("ay").alias("y"), F.col("ax").alias("x"), F.col("iy").cast("double").alias("ref"), F.col("ix").cast("double").alias("tgt"))
    rows = rows.unionByName(both.select(*at, F.lit(1).alias("_kind"), "y", "x", "ref", "tgt")).repartition(*at).sortWithinPartitions(*at, "_kind")
    schema = T.StructType([f for f in px.schema.fields if f.name in FRAME] + [T.StructField(c, T.IntegerType()) for c in ("ay", "ax")] + [T.StructField(c, T.DoubleType()) for c in ("dx", "dy", "ox", "oy", "q")])
    frame = [f.name for f in schema.fields[:2]]

    def measured(t: pa.Table, heads: np.ndarray):
        """All points of whole tiles that begin at the given rows."""
        kind, ty, tx, y, x, ref, tgt = (t.column(c).to_numpy() for c in ("_kind", "_ty", "_tx", "y", "x", "ref", "tgt"))
        held = []

        def done():
            n, a, b = (np.concatenate(p) for p in zip(*held))
            b = _windows(b, taper)
            dy, dx = _peaks(_windows(a, taper), b)
            own = [t.column(c).take(pa.array(n)).combine_chunks() for c in frame]
            out = [dx, dy, tgt[n] + dx, ref[n] + dy, b.std(axis=(1, 2))]
            return pa.RecordBatch.from_arrays([*own, *[pa.array(v[n].astype(np.int32)) for v in (y, x)], *[pa.array(v) for v in out]], schema.names)

        for lo, hi in zip(heads, [*heads[1:], len(kind)]):
            first = lo + int((kind[lo:hi] == 0).sum())
            if first == lo or first == hi:
                continue
            y0, x0 = ty[lo] * step, tx[lo] * step
            yy, xx = y[first:hi] - y0, x[first:hi] - x0
            inside = (yy >= 0) & (xx >= 0) & (yy < step + size - 1) & (xx < step + size - 1)
            # no larger than its pixels and points reach
            high, wide = (max(int(p[inside].max(initial=0)) + 1, int(q.max()) + size) for p, q in ((yy, y[lo:first] - y0), (xx, x[lo:first] - x0)))
            views = []
            for v in (ref, tgt):
                a = np.full((high, wide), np.nan)
                a[yy[inside], xx[inside]] = v[first:hi][inside]
                views.append(np.lib.stride_tricks.sliding_window_view(a, (size, size)))
            for k in range(lo, first, most):
                n = np.arange(k, min(k + most, first))
                a, b = (v[y[n] - y0, x[n] - x0] for v in views)
                whole = ~(np.isnan(a).any(axis=(1, 2)) | np.isnan(b).any(axis=(1, 2)))
                if whole.any():
                    held.append((n[whole], a[whole], b[whole]))
                if sum(len(n) for n, *_ in held) >= most:
                    yield done()
                    held.clear()
        if held:
            yield done()

    most = max(1, PIXELS_AT_ONCE // size**2)

    def run(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            # a tile of many batches is not put together anew for each of them
            if all(held[0].column(c)[0] == b.column(c)[b.num_rows - 1] for c in at):
                continue
            t, heads = together(held)
            yield from measured(t.slice(0, heads[-1]), heads[:-1])
            held = t.slice(heads[-1]).to_batches()
        if held:
            yield from measured(*together(held))

    def together(held):
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for c in at:
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return t, np.flatnonzero(new)

    return rows.mapInArrow(run, schema)


def stack_points(px: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """Blend each point's chosen frames through a raised-cosine window.

    ``chosen``: target_id, frame_id, ay, ax, ox, oy.  Every window pixel asks its four source
    corners by equal (frame, y, x) keys.
    """
    span = F.sequence(F.lit(0), F.lit(size - 1))
    c = chosen.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span))

    def win(i):
        return (1.0 - F.cos((F.col(i) + 0.5) * (2 * math.pi / size))) * 0.5

    c = c.withColumns({"_py": F.col("ay") + F.col("_i") + F.col("oy"), "_px": F.col("ax") + F.col("_j") + F.col("ox"), "_wn": win("_i") * win("_j")})

    def corners(p):
        lo = F.floor(p)
        f = p - lo
        return F.explode(F.filter(F.array(F.struct(lo.cast("int").alias("t"), (1.0 - f).alias("w")), F.struct((lo + 1).cast("int").alias("t"), f.alias("w"))), lambda s: s["w"] > 0))

    c = c.withColumn("_cy", corners(F.col("_py"))).withColumn("_cx", corners(F.col("_px")))
    c = c.select(*FRAME, F.col("_cy.t").alias("y"), F.col("_cx.t").alias("x"), (F.col("_cy.w") * F.col("_cx.w") * F.col("_wn")).alias("_k"), (F.col("ay") + F.col("_i")).alias("_oy"), (F.col("ax") + F.col("_j")).alias("_ox"))
    j = c.join(px.hint("merge"), [*FRAME, "y", "x"]).groupBy("target_id", F.col("_oy").alias("y"), F.col("_ox").alias("x")).agg((F.sum(F.col("_k") * F.col("v")) / F.sum("_k")).alias("v"), F.sum("_k").alias("weight"))
    return j.filter("weight > 0.005")
