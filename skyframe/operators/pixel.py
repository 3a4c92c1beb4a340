"""Per-pixel tone and colour expressions on wide (r, g, b) rows.

Everything here is a projection that stays in whole-stage codegen; an operator that needs an image
statistic takes it from a one-row-per-image table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions import math as M
from skyframe.functions.math import clip, mtf, piecewise, smoothstep
from skyframe.functions.quantiles import attach, group_quantiles, linear
from skyframe.operators.overlap import image_dims
from skyframe.operators.stats import KEY, KNEE_FLOOR, KNEE_WIDTH, RGB, image_stats, mean_of
from skyframe.session import cut

# Rec.709 luma weights, sRGB primaries, D65 white.
REC709 = (0.2126, 0.7152, 0.0722)
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
D65 = (0.95047, 1.0, 1.08883)
CHROMA_GAIN = 0.85
# Knots of the emission S-curve.
EMISSION_S = ((0.0, 0.35, 0.65, 1.0), (0.0, 0.31, 0.69, 1.0))
#: Pixels of all images together that one task sorts to join them.  A sorted pixel takes several times the bytes of a shuffled
#: one, so that the bytes shuffled do not tell how many tasks are needed.
TASK_PIXELS = 750_000


def luma(cols=RGB) -> Column:
    return F.col(cols[0]) * REC709[0] + F.col(cols[1]) * REC709[1] + F.col(cols[2]) * REC709[2]


def put(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.withColumns(new)


def each(df: DataFrame, fn, channels=RGB) -> DataFrame:
    return df.withColumns({c: fn(F.col(c)) for c in channels})


def midtones(df, m) -> DataFrame:
    return each(df, lambda v: mtf(m, v))


def levels(df, black=0.0, white=1.0, gamma=1.0) -> DataFrame:
    white = max(white, black + 1e-4)
    gamma = max(0.05, gamma)

    def one(v):
        t = clip((v - black) / (white - black))
        return F.pow(t, F.lit(1.0 / gamma)) if abs(gamma - 1) > 1e-4 else t

    return each(df, one)


def tone_triple(df, shadow, mid, high) -> DataFrame:
    """Black point, highlights and midtones in one step."""
    return each(df, lambda v: clip(mtf(mid, clip((v - shadow) / max(1e-6, high - shadow)))))


def apply_curve(df, points, channel="rgb") -> DataFrame:
    """Control-point curve through a 1024-entry table held as one array literal."""
    table = M.curve_table(points)
    lut, n = F.array(*[F.lit(t) for t in table]), len(table)

    def look(v):
        at = clip(v) * float(n - 1)
        i0 = F.floor(at)
        f = at - i0
        a = F.element_at("_lut", (i0 + 1).cast("int"))
        b = F.element_at("_lut", F.least(i0 + 2, F.lit(n)).cast("int"))
        return a * (1.0 - f) + b * f

    d = df.withColumn("_lut", lut)
    if channel == "rgb":
        out = each(d, look)
    elif channel in ("r", "g", "b"):
        out = each(d, look, (channel,))
    else:
        lum = luma()
        scale = F.when(lum > 1e-6, look(lum) / F.greatest(lum, F.lit(1e-6))).otherwise(1.0)
        out = each(d.withColumn("_k", scale), lambda v: v * F.col("_k")).drop("_k")
    return out.drop("_lut")


def contrast(df, pivot=0.12, strength=0.15) -> DataFrame:
    """S-curve about a pivot through four Akima knots."""
    pieces = M.contrast_pieces(pivot, strength)
    return each(df, lambda v: clip(piecewise(pieces, clip(v))))


def disc_contrast(df, amount=0.2) -> DataFrame:
    """S-curve with fixed knots at one quarter and four fifths."""
    pieces = M.akima_pieces((0, 0.25, 0.8, 1), (0, max(0.0, 0.25 - amount * 0.25), min(1.0, 0.8 + amount * 0.2), 1))
    return each(df, lambda v: clip(piecewise(pieces, clip(v))))


def remove_green(df, amount=1.0, preserve_lightness=True) -> DataFrame:
    neutral = F.least(F.col("g"), (F.col("r") + F.col("b")) * 0.5)
    d = df.withColumn("_g", (1.0 - amount) * F.col("g") + amount * neutral)
    after = F.col("r") + F.col("_g") + F.col("b")
    k = F.when(after > 0, (F.col("r") + F.col("g") + F.col("b")) / after).otherwise(1.0) if preserve_lightness else F.lit(1.0)
    return d.withColumn("_k", k).withColumns(
        {"r": clip(F.col("r") * F.col("_k")), "g": clip(F.col("_g") * F.col("_k")), "b": clip(F.col("b") * F.col("_k"))}
    ).drop("_g", "_k")


def _inverse3(m):
    import numpy as np

    return [[float(v) for v in row] for row in np.linalg.inv(np.asarray(m))]


def saturation(df, amount) -> DataFrame:
    """Scale CIE Lab chroma by 1 + 0.85 amount, lightness and hue held."""
    if abs(amount) < 1e-9:
        return df
    delta = 6.0 / 29.0

    def to_linear(v):
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    def lab_f(t):
        return F.when(t > delta**3, F.cbrt(t)).otherwise(t / (3 * delta * delta) + 4.0 / 29.0)

    def lab_inv(t):
        return F.when(t > delta, t * t * t).otherwise((t - 4.0 / 29.0) * (3 * delta * delta))

    def to_srgb(v):
        v = F.greatest(v, F.lit(0.0))
        return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1.0 / 2.4)) * 1.055 - 0.055)

    d = df.withColumns({f"_l{c}": to_linear(clip(F.col(c))) for c in RGB})
    d = d.withColumns(
        {f"_f{i}": lab_f(sum((F.col(f"_l{c}") * w for c, w in zip(RGB[1:], row[1:])), F.col("_lr") * row[0]) / wp)
         for i, (row, wp) in enumerate(zip(RGB_TO_XYZ, D65))}
    )
    k = 1.0 + CHROMA_GAIN * amount
    d = d.withColumns(
        {
            "_x": lab_inv(F.col("_f1") + (F.col("_f0") - F.col("_f1")) * k) * D65[0],
            "_y": lab_inv(F.col("_f1")) * D65[1],
            "_z": lab_inv(F.col("_f1") - (F.col("_f1") - F.col("_f2")) * k) * D65[2],
        }
    )
    inv = _inverse3(RGB_TO_XYZ)
    d = d.withColumns(
        {c: clip(to_srgb(F.col("_x") * row[0] + F.col("_y") * row[1] + F.col("_z") * row[2])) for c, row in zip(RGB, inv)}
    )
    return d.drop(*[c for c in d.columns if c.startswith("_") and c not in df.columns])


def mean_saturation(df, amount) -> DataFrame:
    """Scale the distance from the channel mean."""
    d = df.withColumn("_l", mean_of(RGB))
    return each(d, lambda v: clip(F.col("_l") + (v - F.col("_l")) * (1.0 + amount))).drop("_l")


def emission_boost(df) -> DataFrame:
    """Red-excess mask: saturate by 1.35, then a gentle S-curve, both through the mask."""
    d = df.withColumn("_m", clip(F.greatest(F.lit(0.0), F.col("r") - F.greatest("g", "b")) * 5.0)).withColumn("_l", mean_of(RGB))

    def mix(a, b):
        return clip(a * (1.0 - F.col("_m")) + b * F.col("_m"))

    d = each(d, lambda v: mix(v, clip(F.col("_l") + (v - F.col("_l")) * 1.35)))
    pieces = M.akima_pieces(*EMISSION_S)
    return each(d, lambda v: mix(v, clip(piecewise(pieces, clip(v))))).drop("_m", "_l")


def white_balance(df, temp=0.0, tint=0.0, keys=KEY) -> DataFrame:
    """Temperature and tint gains with the image's mean luma restored."""
    gains = {"r": 1.0 + 0.3 * temp, "g": 1.0 - 0.15 * tint, "b": 1.0 - 0.3 * temp}
    after = sum((F.col(c) * gains[c] * w for c, w in zip(RGB[1:], REC709[1:])), F.col("r") * gains["r"] * REC709[0])
    s = df.groupBy(*keys).agg(F.avg(luma()).alias("_a"), F.avg(after).alias("_b"))
    d = attach(df, s, keys).withColumn("_k", F.when(F.col("_b") > 1e-6, F.col("_a") / F.col("_b")).otherwise(1.0))
    return d.withColumns({c: clip(F.col(c) * gains[c] * F.col("_k")) for c in RGB}).drop("_a", "_b", "_k")


def golden_tone(df) -> DataFrame:
    d = df.withColumn("_l", mean_of(RGB))
    ramp = {"r": (0.85, 1.02), "g": (1.15, 0.93), "b": (1.9, 0.72)}
    return d.withColumns({c: clip(F.pow("_l", F.lit(p)) * k) for c, (p, k) in ramp.items()}).drop("_l")


def pixel_tasks(*images: DataFrame | None) -> int:
    """Number of tasks that join ``images`` on their pixels with about ``TASK_PIXELS`` in one at most; counts the pixels.

    Spark raises a smaller number to that of its shuffle partitions.
    """
    present = [i.select(F.lit(0).alias("_")) for i in images if i is not None]
    every = present[0]
    for other in present[1:]:
        every = every.union(other)
    return max(every.sparkSession.sparkContext.defaultParallelism, -(-every.count() // TASK_PIXELS))


def narrowband(ha: DataFrame, oiii: DataFrame, sii: DataFrame | None, palette: str, keys=KEY, tasks: int | None = None) -> DataFrame:
    """Join mono images on pixel and map them to r, g, b; a missing SII falls back.

    ``tasks`` is the number of tasks of the joins; calls for the same images may share one :func:`pixel_tasks`.
    """
    on = [*keys, "y", "x"]
    n = tasks or pixel_tasks(ha, oiii, sii)
    dealt = lambda d, name: d.withColumnRenamed("v", name).repartition(n, *on)
    d = dealt(ha, "_ha").join(dealt(oiii, "_o3").hint("merge"), on)
    d = d.join(dealt(sii, "_s2").hint("merge"), on, "left") if sii is not None else d.withColumn("_s2", F.lit(None).cast("double"))
    h, o, s = F.col("_ha"), F.col("_o3"), F.col("_s2")
    maps = {"SHO": (F.coalesce(s, h), h, o), "HOS": (h, o, F.coalesce(s, o))}
    r, g, b = maps.get((palette or "").upper(), (h, o, o))
    return d.select(*on, clip(r).alias("r"), clip(g).alias("g"), clip(b).alias("b"))


def osc_narrowband(df, palette: str) -> DataFrame:
    """Simulate narrowband from a colour camera: red as H-alpha, mean of green and blue as OIII."""
    h, o = F.col("r"), (F.col("g") + F.col("b")) / 2
    trio = (h, (h + o) / 2, o) if (palette or "").upper() == "SHO" else (h, o, o)
    return df.withColumns({c: clip(v) for c, v in zip(RGB, trio)})


# Selective-colour groups as (name, kind, a, b, cosine of half width, tone).
COLOUR_GROUPS = [
    ("Reds", 0, 0.872633, 0.488376, 0.151117, 0), ("Yellows", 0, -0.338233, 0.941063, 0.420635, 0),
    ("Greens", 0, -0.793304, 0.608826, 0.657706, 0), ("Cyans", 0, -0.966962, -0.254922, 0.343740, 0),
    ("Blues", 0, -0.103625, -0.994616, 0.228065, 0), ("Magentas", 0, 0.851392, -0.524530, 0.309356, 0),
    ("Whites", 1, 0.0, 0.0, 0.0, 1), ("Neutrals", 1, 0.0, 0.0, 0.0, 0), ("Blacks", 1, 0.0, 0.0, 0.0, -1),
]
# Linear RGB to cone response, and cone response to OKLab.
OKLAB_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB_OUT = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))


def colour_membership(df, group: int, width=50.0, guard=5.0, name="w") -> DataFrame:
    """Soft membership of every pixel in a hue or tonal group, measured in OKLab."""
    import math

    _, kind, ua, ub, cos_half, tone = COLOUR_GROUPS[group]

    def dot(row, cols):
        return F.col(cols[0]) * row[0] + F.col(cols[1]) * row[1] + F.col(cols[2]) * row[2]

    d = df.withColumns({f"_c{i}": F.cbrt(dot(row, RGB)) for i, row in enumerate(OKLAB_LMS)})
    d = d.withColumns({f"_k{n}": dot(row, ("_c0", "_c1", "_c2")) for n, row in zip("LAB", OKLAB_OUT)})
    d = d.withColumn("_ch", F.sqrt(F.col("_kA") * F.col("_kA") + F.col("_kB") * F.col("_kB")))
    t = min(1.0, max(0.0, width / 100.0))
    full = max(0.005, 0.30 - (0.30 - 0.06) * t)
    ch, light = F.col("_ch"), F.col("_kL")
    if kind == 0:
        half = math.acos(cos_half) * (0.6 + 0.8 * t)
        inner, outer = math.cos(min(math.pi, 0.5 * half)), math.cos(min(math.pi, half))
        cos = F.when(ch > 1e-6, (F.col("_kA") * ua + F.col("_kB") * ub) / F.greatest(ch, F.lit(1e-9))).otherwise(-1.0)
        f = smoothstep(outer, inner, cos) * clip(ch / full) * smoothstep(0.01, 0.025, ch)
    elif tone > 0:
        f = smoothstep(0.6, 0.95, light)
    elif tone < 0:
        f = 1.0 - smoothstep(0.05, 0.4, light)
    else:
        f = clip(1.0 - F.abs(light - 0.5) / 0.5) * (1.0 - smoothstep(0.025, full, ch))
    g = min(1.0, max(0.0, guard / 100.0))
    if g > 0:
        f = f * smoothstep(g * 0.6 * 0.6, g * 0.6, light)
    return d.withColumn(name, clip(f)).drop("_c0", "_c1", "_c2", "_kL", "_kA", "_kB", "_ch")


def selective_color(df, group=0, cyan=0.0, magenta=0.0, yellow=0.0, black=0.0, width=50.0, guard=5.0, absolute=False, keep_luma=True, weights: DataFrame | None = None, keys=KEY) -> DataFrame:
    """Shift the inks of one colour group; ``weights`` replaces the membership (e.g. a smoothed one)."""
    if not any((cyan, magenta, yellow, black)):
        return df
    on = [*keys, "y", "x"]
    d = df.join(weights.select(*on, F.col("w").alias("_w")).hint("merge"), on) if weights is not None else colour_membership(df, group, width, guard, "_w")

    def relative(v, ink):
        return v * (1.0 - ink) if ink >= 0 else v + (1.0 - v) * -ink

    out = {}
    for c, ink in zip(RGB, (cyan, magenta, yellow)):
        v = F.col(c) - ink if absolute else relative(F.col(c), ink)
        out[f"_o{c}"] = clip(v - black if absolute else relative(v, black))
    d = d.withColumns(out)
    if keep_luma:
        l1 = luma(("_or", "_og", "_ob"))
        d = d.withColumn("_s", F.when(l1 > 1e-6, luma() / F.greatest(l1, F.lit(1e-6))).otherwise(1.0))
        d = d.withColumns({f"_o{c}": clip(F.col(f"_o{c}") * F.col("_s")) for c in RGB}).drop("_s")
    return d.withColumns({c: clip(F.col(c) + F.col("_w") * (F.col(f"_o{c}") - F.col(c))) for c in RGB}).drop("_w", "_or", "_og", "_ob")


# --- geometry


def crop_fraction(df, fraction, keys=KEY) -> DataFrame:
    """Trim floor(fraction * side) on every edge; the offsets stay on the rows."""
    d = attach(df, image_dims(df, keys), keys)
    mx, my = F.floor(F.col("_w") * fraction), F.floor(F.col("_h") * fraction)
    keep = (F.col("x") >= mx) & (F.col("x") < F.col("_w") - mx) & (F.col("y") >= my) & (F.col("y") < F.col("_h") - my)
    return d.filter(keep).withColumns(
        {"y": (F.col("y") - my).cast("int"), "x": (F.col("x") - mx).cast("int"), "x0": mx.cast("int"), "y0": my.cast("int")}
    ).drop("_h", "_w")


def _window(d, y0, y1, x0, x1, ok):
    y0, x0 = F.when(ok, y0).otherwise(0), F.when(ok, x0).otherwise(0)
    y1, x1 = F.when(ok, y1).otherwise(F.col("_h")), F.when(ok, x1).otherwise(F.col("_w"))
    keep = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    return d.filter(keep).withColumns({"y": (F.col("y") - y0).cast("int"), "x": (F.col("x") - x0).cast("int")}).drop("_h", "_w")


def crop_percent(df, percent, keys=KEY) -> DataFrame:
    """Trim a rounded (half-even) percentage; images left under two pixels stay whole."""
    d = attach(df, image_dims(df, keys), keys)
    my, mx = F.rint(F.col("_h") * (percent / 100.0)), F.rint(F.col("_w") * (percent / 100.0))
    ok = (F.col("_h") - 2 * my >= 2) & (F.col("_w") - 2 * mx >= 2)
    return _window(d, my, F.col("_h") - my, mx, F.col("_w") - mx, ok)


def crop_rect(df, x0, y0, x1, y1, keys=KEY) -> DataFrame:
    """Crop to a rectangle in fractions of the sides (half-even)."""
    x0, x1 = sorted(min(1.0, max(0.0, v)) for v in (x0, x1))
    y0, y1 = sorted(min(1.0, max(0.0, v)) for v in (y0, y1))
    d = attach(df, image_dims(df, keys), keys)
    a, b = F.rint(F.col("_w") * x0), F.rint(F.col("_w") * x1)
    c, e = F.rint(F.col("_h") * y0), F.rint(F.col("_h") * y1)
    return _window(d, c, e, a, b, (b - a >= 2) & (e - c >= 2))


def crop_edges(df, edges: DataFrame, keys=KEY) -> DataFrame:
    """Crop by measured edge counts (crop_l, crop_r, crop_t, crop_b per image)."""
    d = attach(attach(df, image_dims(df, keys), keys), edges, keys)
    out = _window(d, F.col("crop_t"), F.col("_h") - F.col("crop_b"), F.col("crop_l"), F.col("_w") - F.col("crop_r"), F.lit(True))
    return out.drop("crop_l", "crop_r", "crop_t", "crop_b")


def orient(df, rotate=0, flip_h=False, flip_v=False, keys=KEY) -> DataFrame:
    """Rotate by quarter turns counter-clockwise, then mirror."""
    d = attach(df, image_dims(df, keys), keys)
    h, w, y, x = F.col("_h"), F.col("_w"), F.col("y"), F.col("x")
    ny, nx, nh, nw = {0: (y, x, h, w), 1: (w - 1 - x, y, w, h), 2: (h - 1 - y, w - 1 - x, h, w), 3: (x, h - 1 - y, w, h)}[rotate % 4]
    if flip_h:
        nx = nw - 1 - nx
    if flip_v:
        ny = nh - 1 - ny
    return d.withColumns({"y": ny.cast("int"), "x": nx.cast("int")}).drop("_h", "_w")


def strided_preview(df, max_dim: int, keys=KEY) -> DataFrame:
    """Every step-th pixel with step = ceil(long edge / max_dim)."""
    d = attach(df, image_dims(df, keys), keys)
    step = F.greatest(F.lit(1), F.ceil(F.greatest("_h", "_w") / F.lit(float(max_dim))))
    return d.filter((F.col("y") % step == 0) & (F.col("x") % step == 0)).withColumns(
        {"y": F.floor(F.col("y") / step).cast("int"), "x": F.floor(F.col("x") / step).cast("int")}
    ).drop("_h", "_w")


# --- operators driven by one image statistic


def background_level(df, target, keys=KEY, channels=RGB) -> DataFrame:
    """Pull a too-bright background to ``target``: knee at median - 6 average deviations, then midtones."""
    s = image_stats(df, keys, channels)
    c = F.col("med") - 6.0 * F.col("dev")
    e = F.greatest(F.lit(KNEE_WIDTH) * F.col("dev"), F.lit(KNEE_FLOOR))
    soft = M.soft_knee(F.col("med"), F.col("_c"), F.col("_e"))
    s = s.withColumns({"_c": c, "_e": e, "_on": F.col("med") > target + 0.005})
    s = s.withColumn("_v1", F.when(F.col("_c") > 0, soft).otherwise(F.col("med"))).withColumn("_m", M.midtones_balance(target, F.col("_v1")))
    d = attach(df, cut(s.select(*keys, "_c", "_e", "_on", "_m")), keys)

    # one projection per stage keeps the generated code small
    on = F.col("_on")
    d = each(d, lambda v: F.when(on & (F.col("_c") > 0), M.soft_knee(v, F.col("_c"), F.col("_e"))).otherwise(v), channels)
    d = each(d, lambda v: F.when(on & (F.col("_c") > 0), clip(v)).otherwise(v), channels)
    return each(d, lambda v: F.when(on, mtf(F.col("_m"), v)).otherwise(v), channels).drop("_c", "_e", "_on", "_m")


def shadow_anchor(df, classes: DataFrame, tau=0.65, strength=0.7, keys=KEY, channels=RGB) -> DataFrame:
    """Pull a lifted floor (p1) 70 % of the way to 0.65 of the median; some classes are exempt."""
    med = image_stats(df, keys, channels).select(*keys, F.col("med").alias("_f"))
    blk = group_quantiles(df, keys, mean_of(channels), {"_b": linear(0.01)})
    s = attach(attach(med, blk, keys), classes, keys, "left")
    target = tau * F.col("_f")
    on = (
        ~F.coalesce(F.col("object_class").isin("reflection", "galaxy"), F.lit(False))
        & (F.col("_f") > 0.001) & (F.col("_b") < F.col("_f")) & (F.col("_b") > target + 0.001)
    )
    s = s.select(*keys, "_f", (F.col("_f") - F.col("_b")).alias("_d0"), on.alias("_on"), (F.col("_b") - strength * (F.col("_b") - target)).alias("_w"))
    d = each(attach(df, cut(s), keys), clip, channels)
    kk = (F.col("_f") - F.col("_w")) / F.col("_d0")

    def pull(v):
        gap = F.col("_f") - v
        return F.when(F.col("_on") & (v < F.col("_f")), clip(F.col("_f") - gap * (1.0 + (kk - 1.0) * gap / F.col("_d0")))).otherwise(v)

    return each(d, pull, channels).drop("_f", "_d0", "_on", "_w")
