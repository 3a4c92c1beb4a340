"""Robust integration of registered frames: master, sharp band, coverage, noise, transients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyframe.functions.math import clip
from skyframe.functions.quantiles import attach, group_median, group_quantiles, linear
from skyframe.session import cut

# Above this many frames of one target a pixel's samples are no longer gathered in one row.
GATHER_LIMIT = 50_000
MAD_SCALE = 1.4826
SCALE_FLOOR = 1e-4


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside a higher-order expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def array_median(a: Column) -> Column:
    def mid(s):
        n = F.size(s)
        lo = F.element_at(s, F.floor((n + 1) / 2).cast("int"))
        hi = F.element_at(s, F.floor((n + 2) / 2).cast("int"))
        return F.when(n > 0, (lo + hi) / 2)

    return let(F.array_sort(a), mid)


def _scale(m: Column, mad: Column, model) -> Column:
    s = F.greatest(mad * MAD_SCALE, F.lit(SCALE_FLOOR))
    if model is None:
        return s
    a, b, cap = (list(model) + [None])[:3]
    floor = F.lit(0.7) * F.sqrt(F.greatest(F.lit(float(a)) * m + F.lit(float(b)), F.lit(0.0)))
    if cap is not None:
        floor = F.when(m <= float(cap), floor).otherwise(0.0)
    return F.greatest(s, floor)


def _bounds(values: Column, low: float, high: float, iters: int, model) -> Column:
    """Clip limits after ``iters`` rounds; every round tests all valid samples again."""

    def one_round(state, _):
        kept = F.filter(values, lambda v: (v >= state["lo"]) & (v <= state["hi"]))

        def with_kept(k):
            def with_median(m):
                def with_scale(s):
                    return F.struct((m - low * s).alias("lo"), (m + high * s).alias("hi"))

                return let(_scale(m, array_median(F.transform(k, lambda v: F.abs(v - m))), model), with_scale)

            return let(array_median(k), with_median)

        return let(kept, with_kept)

    start = F.struct(F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, iters))), start, one_round)


def _wmean(samples: Column, v: str, w: str | None) -> Column:
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))

    def add(acc, x):
        wt = x[w] if w else F.lit(1.0)
        return F.struct((acc["s"] + x[v] * wt).alias("s"), (acc["w"] + wt).alias("w"))

    return F.aggregate(samples, zero, add, lambda a: F.when(a["w"] > 0, a["s"] / a["w"]))


def _gathered(px, keys, channels, low, high, iters, weight, weight_hi, model):
    fields = ["frame_id", *channels, *[w for w in (weight, weight_hi) if w]]
    df = px.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_s"))
    for c in channels:
        df = df.withColumn(f"_v_{c}", F.filter(F.transform("_s", lambda s: s[c]), lambda v: v.isNotNull()))
        df = df.withColumn(f"_b_{c}", _bounds(F.col(f"_v_{c}"), low, high, iters, model))

    def alive(s, c):
        return s[c].isNotNull() & (s[c] >= F.col(f"_b_{c}.lo")) & (s[c] <= F.col(f"_b_{c}.hi"))

    for c in channels:
        df = df.withColumn(f"_k_{c}", F.filter("_s", lambda s: alive(s, c)))
        fallback = F.when(
            F.size(f"_v_{c}") > 0, F.aggregate(f"_v_{c}", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(f"_v_{c}"), F.lit(0))
        )
        df = df.withColumn(f"_m_{c}", clip(F.coalesce(_wmean(F.col(f"_k_{c}"), c, weight), fallback)))
        if weight_hi:
            df = df.withColumn(f"_h_{c}", clip(F.coalesce(_wmean(F.col(f"_k_{c}"), c, weight_hi), fallback)))

    def every(test):
        out = test(channels[0])
        for c in channels[1:]:
            out = (lambda a, b: lambda s: a(s) & b(s))(out, test(c))
        return out

    all_valid = every(lambda c: lambda s: s[c].isNotNull())
    all_alive = every(lambda c: lambda s: alive(s, c))
    n_ch = float(len(channels))

    def lum(s):
        total = s[channels[0]]
        for c in channels[1:]:
            total = total + s[c]
        return total / n_ch

    def excess(s, c):
        rejected = s[c].isNotNull() & ~alive(s, c) & (s[c] > F.col(f"_m_{c}"))
        return F.when(rejected, s[c] - F.col(f"_m_{c}")).otherwise(0.0)

    df = df.withColumn("_l", F.transform(F.filter("_s", all_alive), lum))
    count = F.nullif(F.size("_l"), F.lit(0))
    df = df.withColumn("_lm", F.aggregate("_l", F.lit(0.0), lambda a, v: a + v) / count)
    sd = F.sqrt(F.aggregate("_l", F.lit(0.0), lambda a, v: a + (v - F.col("_lm")) * (v - F.col("_lm"))) / count)

    def mean_excess(s):
        total = excess(s, channels[0])
        for c in channels[1:]:
            total = total + excess(s, c)
        return total / n_ch

    best = F.aggregate(
        "_s",
        F.struct(F.lit(0.0).alias("e"), F.lit(None).cast("long").alias("f")),
        lambda a, s: let(
            mean_excess(s), lambda e: F.when(e > a["e"], F.struct(e.alias("e"), s["frame_id"].cast("long").alias("f"))).otherwise(a)
        ),
    )
    out = [F.col(k) for k in keys]
    for c in channels:
        out.append(F.col(f"_m_{c}").alias(f"mean_{c}"))
        if weight_hi:
            out.append(F.col(f"_h_{c}").alias(f"mean_hi_{c}"))
        out.append(
            clip(F.aggregate("_s", F.lit(0.0), lambda a, s: F.greatest(a, excess(s, c)))).alias(f"transient_{c}")
        )
    return df.select(
        *out,
        F.size(F.filter("_s", all_valid)).cast("long").alias("coverage"),
        F.size("_l").cast("long").alias("kept"),
        (sd / F.sqrt(count.cast("double"))).alias("noise"),
        best["f"].alias("transient_frame"),
    )


def _spread(px, keys, channels, low, high, iters, weight, weight_hi, model):
    """The same result without gathering: distributed medians, then ordinary aggregates."""
    bounds = None
    for c in channels:
        limit = None
        for _ in range(max(1, iters)):
            src = px.select(*keys, c)
            if limit is not None:
                src = attach(src, limit, keys).filter((F.col(c) >= F.col("lo")) & (F.col(c) <= F.col("hi")))
            med = group_median(src, keys, c, "m")
            dev = attach(src.select(*keys, c), med, keys).withColumn("d", F.abs(F.col(c) - F.col("m")))
            mad = group_median(dev, keys, "d", "mad")
            s = _scale(F.col("m"), F.col("mad"), model)
            limit = cut(
                attach(med, mad, keys).select(*keys, (F.col("m") - low * s).alias("lo"), (F.col("m") + high * s).alias("hi"))
            )
        named = limit.select(*keys, F.col("lo").alias(f"_lo_{c}"), F.col("hi").alias(f"_hi_{c}"))
        bounds = named if bounds is None else bounds.join(named, keys, "full")
    rows = px.join(bounds, keys, "left")

    def alive(c):
        return F.coalesce((F.col(c) >= F.col(f"_lo_{c}")) & (F.col(c) <= F.col(f"_hi_{c}")), F.lit(False))

    def conj(test):
        out = test(channels[0])
        for c in channels[1:]:
            out = out & test(c)
        return out

    lum = sum((F.col(c) for c in channels[1:]), F.col(channels[0])) / float(len(channels))
    aggs = [
        F.count(F.when(conj(lambda c: F.col(c).isNotNull()), 1)).alias("coverage"),
        F.count(F.when(conj(alive), 1)).alias("kept"),
        (F.stddev_pop(F.when(conj(alive), lum)) / F.sqrt(F.nullif(F.count(F.when(conj(alive), 1)), F.lit(0)))).alias("noise"),
    ]
    for c in channels:
        for w, tag in ((weight, "mean"), (weight_hi, "mean_hi")):
            if tag == "mean_hi" and not weight_hi:
                continue
            wt = F.col(w) if w else F.lit(1.0)
            sw = F.sum(F.when(alive(c), wt))
            aggs.append(
                clip(F.coalesce(F.when(sw > 0, F.sum(F.when(alive(c), F.col(c) * wt)) / sw), F.avg(c))).alias(f"{tag}_{c}")
            )
    first = cut(rows.groupBy(*keys).agg(*aggs))
    both = rows.join(first, keys)
    ex = {
        c: F.when(F.col(c).isNotNull() & ~alive(c) & (F.col(c) > F.col(f"mean_{c}")), F.col(c) - F.col(f"mean_{c}")).otherwise(0.0)
        for c in channels
    }
    mean_ex = sum((ex[c] for c in channels[1:]), ex[channels[0]]) / float(len(channels))
    tr = both.groupBy(*keys).agg(
        *[clip(F.max(ex[c])).alias(f"transient_{c}") for c in channels],
        F.max(F.when(mean_ex > 0, F.struct(mean_ex.alias("e"), (-F.col("frame_id")).cast("long").alias("f")))).alias("_t"),
    )
    out = [F.col(k) for k in keys]
    for c in channels:
        out.append(F.col(f"mean_{c}"))
        if weight_hi:
            out.append(F.col(f"mean_hi_{c}"))
        out.append(F.col(f"transient_{c}"))
    return first.join(tr, keys).select(
        *out, F.col("coverage"), F.col("kept"), F.col("noise"), (-F.col("_t.f")).alias("transient_frame")
    )


def integrate(
    px: DataFrame,
    frames: DataFrame,
    channels: Sequence[str] = ("v",),
    low: float = 4.0,
    high: float = 3.0,
    iters: int = 3,
    weight: str | None = None,
    weight_hi: str | None = None,
    model=None,
    gather_limit: int = GATHER_LIMIT,
    keys: Sequence[str] = ("target_id", "y", "x"),
) -> DataFrame:
    """Sigma-clipped (weighted) mean of every pixel of every target, with its companion maps.

    ``frames`` is the frame table (``target_id``, ``frame_id``); a target's frame count bounds the
    samples of any of its pixels.  Targets within ``gather_limit`` gather a pixel's samples in one
    row; the others take the distributed form, with the same result.
    """
    keys, channels = list(keys), list(channels)
    args = (keys, channels, low, high, iters, weight, weight_hi, model)
    hot = (
        frames.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > gather_limit).select("target_id")
    )
    if hot.isEmpty():
        return _gathered(px, *args)
    hot = cut(hot)
    return _gathered(px.join(hot, "target_id", "left_anti"), *args).unionByName(
        _spread(px.join(hot, "target_id", "left_semi"), *args)
    )


def calibration_master(px: DataFrame, frames: DataFrame, **kw) -> DataFrame:
    """Master of a calibration set: 5/5 sigma clip; a single frame is its own master, unclipped."""
    single = frames.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("target_id")
    many = integrate(px.join(single, "target_id", "left_anti"), frames, low=5.0, high=5.0, **kw).select(
        "target_id", "y", "x", F.col("mean_v").alias("v")
    )
    return many.unionByName(px.join(single, "target_id", "left_semi").select("target_id", "y", "x", "v"))


def frame_stats(px: DataFrame, keys: Sequence[str] = ("target_id", "frame_id"), value: str = "v") -> DataFrame:
    """Background (median) and signal range (p90 - median, at least 1e-6); empty frame -> (0, 1)."""
    keys = list(keys)
    q = group_quantiles(px, keys, value, {"med": linear(0.5), "p90": linear(0.9)})
    every = px.select(*keys).distinct()
    return every.join(q.hint("merge"), keys, "left").select(
        *keys,
        F.coalesce("med", F.lit(0.0)).alias("med"),
        F.when(F.col("med").isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(1e-6), F.col("p90") - F.col("med"))).alias("sig"),
    )


def normalize_to_ref(px: DataFrame, stats: DataFrame, reference: DataFrame, do_scale: bool = True) -> DataFrame:
    """Match background and signal range of every frame to its target's reference frame."""
    ref = stats.join(reference, ["target_id", "frame_id"], "left_semi").select(
        "target_id", F.col("med").alias("_rm"), F.col("sig").alias("_rs")
    )
    scale = F.least(F.greatest(F.col("_rs") / F.col("sig"), F.lit(0.5)), F.lit(2.0)) if do_scale else F.lit(1.0)
    gains = stats.join(ref, "target_id").select("target_id", "frame_id", "med", scale.alias("_k"), "_rm")
    # left alone, Spark takes the joined gains for larger than compressed pixels and broadcasts the pixels
    return px.join(gains.hint("shuffle_hash"), ["target_id", "frame_id"]).withColumn(
        "v", (F.col("v") - F.col("med")) * F.col("_k") + F.col("_rm")
    ).drop("med", "_k", "_rm")


def _leading(df: DataFrame, keys, line: str, ok: Column, n: Column) -> list[Column]:
    first = F.coalesce(F.min(F.when(ok, F.col(line))), n)
    last = F.coalesce(F.max(F.when(ok, F.col(line))), F.lit(-1))
    return [first.cast("long").alias("_lead"), (n - 1 - last).cast("long").alias("_trail")]


def lead_trail(lines: DataFrame, keys: Sequence[str], line: str, ok: str) -> DataFrame:
    """Length of the bad run at each end of a numbered profile (0..n-1): two plain aggregates."""
    n = (F.max(line) + 1).cast("long")
    return lines.groupBy(*keys).agg(*_leading(lines, keys, line, F.col(ok), n), n.alias("_n")).select(
        *keys, F.col("_lead").alias("lead"), F.col("_trail").alias("trail"), F.col("_n").alias("n")
    )


def _edges(rows: DataFrame, cols: DataFrame, keys, rule) -> DataFrame:
    t = lead_trail(rows, keys, "line", "ok").select(*keys, F.col("lead").alias("_t"), F.col("trail").alias("_b"), F.col("n").alias("_h"))
    s = lead_trail(cols, keys, "line", "ok").select(*keys, F.col("lead").alias("_l"), F.col("trail").alias("_r"), F.col("n").alias("_w"))
    return t.join(s, keys).select(
        *keys,
        rule(F.col("_l"), F.col("_w")).alias("crop_l"),
        rule(F.col("_r"), F.col("_w")).alias("crop_r"),
        rule(F.col("_t"), F.col("_h")).alias("crop_t"),
        rule(F.col("_b"), F.col("_h")).alias("crop_b"),
    )


def coverage_edges(cov: DataFrame, n_sub: DataFrame, keys=("target_id",), cover_frac=0.98, line_frac=0.90) -> DataFrame:
    """Crop from the coverage map: a line is good when >= 90 % of it has >= 98 % of the frames."""
    keys = list(keys)
    thr = F.greatest(F.lit(1.0), F.rint(F.lit(cover_frac) * F.greatest(F.lit(1), F.col("n_sub"))))
    c = cov.join(n_sub, keys).withColumn("_c", (F.col("coverage") >= thr).cast("double"))

    def profile(axis):
        return c.groupBy(*keys, F.col(axis).alias("line")).agg((F.avg("_c") >= line_frac).alias("ok"))

    return _edges(profile("y"), profile("x"), keys, lambda run, n: F.least(run, F.floor(n / 4)).cast("int"))


def darkness_edges(master: DataFrame, keys=("target_id",), value="v", floor_frac=0.02) -> DataFrame:
    """Crop from dark borders: line mean below a quarter of the interior median, 2 % at least."""
    keys = list(keys)
    dims = master.groupBy(*keys).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    m = attach(master, dims, keys)

    def mid(p, n):
        return (F.col(p) >= F.floor(F.col(n) / 4)) & (F.col(p) < F.floor(3 * F.col(n) / 4))

    med = group_median(m.filter(mid("y", "_h") & mid("x", "_w")), keys, value, "_med")
    dark = med.select(*keys, F.greatest(F.lit(1e-4), F.lit(0.25) * F.col("_med")).alias("_dark"))

    def profile(axis):
        p = master.groupBy(*keys, F.col(axis).alias("line")).agg(F.avg(value).alias("_m"))
        return attach(p, dark, keys).select(*keys, "line", (~(F.col("_m") < F.col("_dark"))).alias("ok"))

    def rule(run, n):
        return F.greatest(F.least(run, F.floor(n / 4)), F.floor(n * F.lit(floor_frac))).cast("int")

    return _edges(profile("y"), profile("x"), keys, rule)


def contract(frames: DataFrame, edges: DataFrame, version: str = "0.3.0") -> DataFrame:
    """Hand-over columns of a finished master: version, frame count, exposure total, crop."""
    return (
        frames.groupBy("target_id")
        .agg(F.count(F.lit(1)).alias("n_sub"), F.sum(F.coalesce("exposure", F.lit(0.0))).alias("exposure"))
        .join(edges, "target_id")
        .withColumn("version", F.lit(version))
    )


def temporal_median(px: DataFrame, frames: DataFrame, value: Column | str = "v", gather_limit: int = GATHER_LIMIT) -> DataFrame:
    """Median frame of every target; large targets take the distributed median."""
    keys = ["target_id", "y", "x"]
    v = F.col(value) if isinstance(value, str) else value
    hot = frames.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > gather_limit).select("target_id")
    src = px.select(*keys, v.alias("v"))
    if hot.isEmpty():
        return src.groupBy(*keys).agg(F.median("v").alias("v"))
    hot = cut(hot)
    return (
        src.join(hot, "target_id", "left_anti").groupBy(*keys).agg(F.median("v").alias("v"))
        .unionByName(group_median(src.join(hot, "target_id", "left_semi"), keys, "v", "v"))
    )


def band_weights(measures: DataFrame, reference: DataFrame | None, keys=("session_id",)) -> DataFrame:
    """Inverse-variance and sharpness weights of every frame, each normalised to mean 1."""
    keys = list(keys)
    ok_noise = F.when(F.col("noise") > 0, F.col("noise"))
    ok_fwhm = F.when(F.col("fwhm") > 0, F.col("fwhm"))
    med = group_median(measures, keys, "noise", "_mn")
    best = group_quantiles(measures, keys, "fwhm", {"_fb": linear(0.1)})
    df = measures.join(med, keys, "left").join(best, keys, "left")
    df = df.withColumn("_n", F.coalesce(ok_noise, F.col("_mn"), F.lit(1.0)))
    if reference is not None:
        ref = measures.join(reference, [*keys, "frame_id"], "left_semi").select(
            *keys, F.when(F.col("noise") > 0, F.col("noise")).alias("_rn")
        )
        df = df.join(ref, keys, "left").withColumn(
            "_n",
            F.when(
                F.col("_rn").isNotNull(),
                F.col("_n") * F.least(F.greatest(F.col("_rn") / F.col("_n"), F.lit(0.5)), F.lit(2.0)),
            ).otherwise(F.col("_n")),
        )
    fb = F.coalesce("_fb", F.lit(1.0))
    df = df.withColumn("_w", F.lit(1.0) / F.pow(F.greatest("_n", F.lit(1e-6)), 2))
    ratio = F.coalesce(ok_fwhm, fb) / F.greatest(fb, F.lit(1e-6))
    mtf = F.exp(F.lit(-0.89) * (ratio * ratio - 1.0))
    df = df.withColumn("_s", F.least(F.greatest(mtf, F.lit(1e-4)), F.lit(1.0)))
    # the mean of w_lo cancels in w_hi, so both normalisers come from one aggregation
    norm = df.groupBy(*keys).agg(F.avg("_w").alias("_wa"), F.avg(F.col("_w") * F.col("_s")).alias("_ha"))
    return attach(df, norm, keys).select(
        *keys,
        "frame_id",
        (F.col("_w") / F.col("_wa")).alias("w_lo"),
        (F.col("_w") * F.col("_s") / F.col("_ha")).alias("w_hi"),
    )


def stack_tiles(tiles: DataFrame, frames: DataFrame, low=4.0, high=3.0, iters=3, budget: int = 4_000_000) -> DataFrame:
    """Sigma-clipped mean and coverage straight from stored tiles (array column ``data``).

    A tile is cut into strips so that one group holds at most ``budget`` samples whatever the
    number of frames of a target; strips are the unit of shuffle and of work.
    """
    import numpy as np
    import pandas as pd

    strips = frames.groupBy("target_id").agg(F.count(F.lit(1)).alias("_n")).select(
        "target_id", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("_n"))).cast("int").alias("_len")
    )
    cutup = (
        tiles.join(strips, "target_id")
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("data") - 1, F.least(F.col("_len"), F.size("data")))))
        .select("target_id", "ty", "tx", "_at", F.slice("data", F.col("_at") + 1, F.col("_len")).alias("data"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cube = np.stack([np.asarray(a, dtype=float) for a in pdf["data"]])
        valid = np.isfinite(cube)
        data = np.where(valid, cube, np.nan)
        mask = valid
        with np.errstate(all="ignore"):
            for _ in range(max(1, iters)):
                kept = np.where(mask, data, np.nan)
                m = np.nanmedian(kept, axis=0)
                s = np.maximum(MAD_SCALE * np.nanmedian(np.abs(kept - m), axis=0), SCALE_FLOOR)
                mask = valid & (data >= m - low * s) & (data <= m + high * s)
            n = mask.sum(axis=0)
            mean = np.where(n > 0, np.where(mask, data, 0).sum(axis=0) / np.maximum(n, 1), np.nanmean(data, axis=0))
        first = pdf.iloc[0]
        return pd.DataFrame(
            {
                "target_id": first["target_id"], "ty": first["ty"], "tx": first["tx"],
                "pos": (np.arange(cube.shape[1]) + int(first["_at"])).astype("int32"),
                "v": np.clip(mean, 0, 1), "coverage": valid.sum(axis=0).astype("int64"),
            }
        )

    types = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    schema = f"target_id {types['target_id']}, ty {types['ty']}, tx {types['tx']}, pos int, v double, coverage long"
    return cutup.groupBy("target_id", "ty", "tx", "_at").applyInPandas(run, schema)
