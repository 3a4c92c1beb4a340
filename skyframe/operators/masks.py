"""Soft masks: building, combining and applying them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.math import clip, smoothstep
from skyframe.functions.quantiles import attach, group_quantiles, linear
from skyframe.operators.pixel import luma
from skyframe.operators.stats import KEY, RGB

PIX = ["image_id", "y", "x"]


def blend(original: DataFrame, processed: DataFrame, mask: DataFrame | None, invert=False, opacity=1.0, channels=RGB, on=PIX) -> DataFrame:
    """o(1-m) + p m per pixel; an inverted mask swaps the roles, no mask leaves the original."""
    if mask is None:
        return original
    p = processed.select(*on, *[F.col(c).alias(f"_p{c}") for c in channels])
    d = original.join(p.hint("merge"), on, "left").join(mask.select(*on, F.col("w").alias("_w")).hint("merge"), on, "left")
    w = (1.0 - F.col("_w") if invert else F.col("_w")) * float(opacity)
    return d.withColumns(
        {c: F.when(F.col("_w").isNull() | F.col(f"_p{c}").isNull(), F.col(c)).otherwise(F.col(c) * (1.0 - w) + F.col(f"_p{c}") * w) for c in channels}
    ).drop("_w", *[f"_p{c}" for c in channels])


def mix(original: DataFrame, processed: DataFrame, opacity=1.0, channels=RGB, on=PIX) -> DataFrame:
    """:func:`blend` with one weight for all pixels: a single join."""
    p = processed.select(*on, *[F.col(c).alias(f"_p{c}") for c in channels])
    w = F.lit(float(opacity))
    d = original.join(p.hint("merge"), on, "left")
    return d.withColumns({c: F.when(F.col(f"_p{c}").isNull(), F.col(c)).otherwise(F.col(c) * (1.0 - w) + F.col(f"_p{c}") * w) for c in channels}).drop(*[f"_p{c}" for c in channels])


def combine(a: DataFrame, b: DataFrame | None, op: str, on=PIX) -> DataFrame:
    """Fuzzy algebra: intersect = min, union = max, subtract = min(a, 1-b), invert = 1-a."""
    wa = clip(F.col("w"))
    if op == "invert":
        return a.select(*on, (1.0 - wa).alias("w"))
    if b is None:
        return a.select(*on, wa.alias("w"))
    wb = clip(F.coalesce("_wb", F.lit(0.0)))
    out = {"union": F.greatest(wa, wb), "subtract": F.least(wa, 1.0 - wb)}.get(op, F.least(wa, wb))
    return a.join(b.select(*on, F.col("w").alias("_wb")).hint("merge"), on, "left").select(*on, out.alias("w"))


def combined_name(a: str, op: str, b: str | None = None) -> str:
    if op == "invert":
        return f"¬{a}"
    if b is None:
        return a
    return f"{a} ∩ ¬{b}" if op == "subtract" else f"{a} {'∪' if op == 'union' else '∩' if op == 'intersect' else op} {b}"


def luminosity_mask(df, kind="lights", depth=1, keys=KEY) -> DataFrame:
    power = 2 ** (min(5, max(1, round(depth))) - 1)
    top = df.groupBy(*keys).agg(F.greatest(F.max(luma()), F.lit(1e-6)).alias("_m"))
    base = clip(luma() / F.col("_m"))
    base = 1.0 - base if kind == "darks" else base
    return attach(df, top, keys).select(*PIX, clip(F.pow(base, F.lit(float(power)))).alias("w"))


def range_weight(light: Column, low, high, fuzz=0.15) -> Column:
    """Smoothstep edges ``fuzz`` outside [low, high]."""
    if fuzz <= 0:
        return ((light >= low) & (light <= high)).cast("double")
    return smoothstep(low - fuzz, low, light) * (1.0 - smoothstep(high, high + fuzz, light))


def range_ramp(v: Column, low, high, fuzz=0.15) -> Column:
    """Linear ramps of width ``fuzz`` outside [low, high]."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return (
        F.when((v > high) & (v < high + fuzz), (high + fuzz - v) / fuzz)
        .when((v < low) & (v > low - fuzz), (v - (low - fuzz)) / fuzz)
        .when((v >= low) & (v <= high), 1.0)
        .otherwise(0.0)
    )


def scribble_mask(df, value="s", positive="sky") -> DataFrame:
    s = F.col(value) * (-1.0 if positive == "earth" else 1.0)
    return df.select(*PIX, clip(0.5 + 0.5 * clip(s, -1.0, 1.0)).alias("w"))


def snr_map(master: DataFrame, noise: DataFrame, value: Column, on=PIX) -> DataFrame:
    return master.join(noise.select(*on, F.col("noise").alias("_n")).hint("merge"), on).select(
        *on, (F.greatest(value, F.lit(0.0)) / (F.col("_n") + 1e-6)).alias("snr")
    )


def snr_protect(snr: DataFrame, coverage: DataFrame | None, keys=KEY, on=PIX, lo=0.20, hi=0.70) -> DataFrame:
    """Unsmoothed protection: 1 below the low percentile of SNR, 0 above the high one, raised where uncovered."""
    q = group_quantiles(snr, keys, "snr", {"_lo": linear(lo), "_hi": linear(hi)})
    p = clip((F.col("_hi") - F.col("snr")) / (F.col("_hi") - F.col("_lo") + 1e-9))
    d = attach(snr, q, keys)
    if coverage is not None:
        top = coverage.groupBy(*keys).agg(F.max("coverage").alias("_cm"))
        d = attach(d.join(coverage.select(*on, "coverage").hint("merge"), on, "left"), top, keys)
        full = F.when(F.col("_cm") == 0, 1.0).otherwise(F.col("_cm"))
        p = F.greatest(p, clip(1.0 - F.col("coverage") / full))
    return d.select(*on, p.alias("w"))
