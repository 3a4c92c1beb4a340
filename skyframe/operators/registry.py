"""Named image transforms, recipe replay and edit-list algebra."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.operators import masks, pixel, stats, stencil, surface
from skyframe.operators.stats import RGB
from skyframe.session import cut

PIX = ["image_id", "y", "x"]


@dataclass
class Param:
    key: str
    kind: str = "float"
    default: object = 0.0

    def coerce(self, v):
        return {"bool": bool, "int": lambda x: int(round(float(x))), "choice": int, "float": float}.get(self.kind, lambda x: x)(v)


@dataclass
class Tool:
    name: str
    group: str
    fn: Callable[[DataFrame, dict], DataFrame]
    params: list[Param] = field(default_factory=list)
    reshapes: bool = False

    def settings(self, given: dict | None) -> dict:
        """Defaults, overridden by what is given, each coerced to its kind."""
        out = {p.key: p.default for p in self.params} | (given or {})
        for p in self.params:
            if out.get(p.key) is not None:
                out[p.key] = p.coerce(out[p.key])
        return out


TOOLS: dict[str, Tool] = {}


def register(name, group, fn, params=(), reshapes=False) -> Tool:
    if name in TOOLS:
        raise ValueError(f"duplicate tool: {name}")
    TOOLS[name] = Tool(name, group, fn, [Param(*p) for p in params], reshapes)
    return TOOLS[name]


def _rest(df: DataFrame) -> DataFrame:
    return df.select(*PIX, *RGB)


_CHANNELS = ["rgb", "lum", "r", "g", "b"]
for _n, _g, _f, _p, _r in [
    ("crop", "Geometry", lambda d, p: pixel.crop_rect(d, p["rect"].get("x0", 0.0), p["rect"].get("y0", 0.0), p["rect"].get("x1", 1.0), p["rect"].get("y1", 1.0)), [("rect", "rect", {})], True),
    ("edge_crop", "Geometry", lambda d, p: pixel.crop_percent(d, p["percent"]), [("percent", "float", 0.0)], True),
    ("orient", "Geometry", lambda d, p: pixel.orient(d, p["rotate"], p["flip_h"], p["flip_v"]), [("rotate", "choice", 0), ("flip_h", "bool", False), ("flip_v", "bool", False)], True),
    ("curves", "Tone", lambda d, p: pixel.apply_curve(d, p["points"], _CHANNELS[p["channel"]]), [("channel", "choice", 0), ("points", "curve", [[0.0, 0.0], [1.0, 1.0]])], False),
    ("levels", "Tone", lambda d, p: pixel.levels(d, p["black"], p["white"], p["gamma"]), [("black", "float", 0.0), ("white", "float", 1.0), ("gamma", "float", 1.0)], False),
    ("contrast", "Tone", lambda d, p: pixel.contrast(d, p["pivot"], p["strength"]), [("pivot", "float", 0.12), ("strength", "float", 0.15)], False),
    ("local_contrast", "Tone", lambda d, p: stencil.local_contrast(d, p["amount"]), [("amount", "float", 0.12)], False),
    ("hdr", "Tone", lambda d, p: stencil.hdr_core(d, p["layers"], p["compression"], p["detail_boost"]), [("layers", "int", 6), ("compression", "float", 0.85), ("detail_boost", "float", 1.0)], False),
    ("highlight_rolloff", "Tone", lambda d, p: stencil.highlight_rolloff(d, p["knee"]), [("knee", "float", 0.82)], False),
    ("deepen", "Tone", lambda d, p: stencil.deepen(d, p["amount"]), [("amount", "float", 0.3)], False),
    ("saturation", "Color", lambda d, p: pixel.saturation(d, p["amount"]), [("amount", "float", 0.0)], False),
    ("white_balance", "Color", lambda d, p: pixel.white_balance(d, p["temp"], p["tint"]), [("temp", "float", 0.0), ("tint", "float", 0.0)], False),
    ("scnr", "Color", lambda d, p: pixel.remove_green(d, p["amount"], p["preserve_lightness"]), [("amount", "float", 1.0), ("preserve_lightness", "bool", True)], False),
    ("chroma_nr", "Color", lambda d, p: stencil.chroma_nr(d, p["amount"]), [("amount", "float", 0.5)], False),
    ("bg_neutralize", "Color", lambda d, p: stats.background_neutralize(d, p["target"]), [("target", "float", 0.05)], False),
    ("reduce_cast", "Color", lambda d, p: stencil.reduce_cast(d), [], False),
    ("fix_chromatic", "Color", lambda d, p: _stars().correct_offsets(d, p["strength"]), [("strength", "float", 1.0)], False),
    ("emission_boost", "Color", lambda d, p: pixel.emission_boost(d), [], False),
    ("structure", "Detail", lambda d, p: stencil.structure_boost(d, p["amount"]), [("amount", "float", 0.6)], False),
    ("noise_reduction", "Detail", lambda d, p: _mixed(d, stencil.noise_reduction(d), p["amount"]), [("amount", "float", 1.0)], False),
    ("star_reduce", "Detail", lambda d, p: stencil.shrink_stars(d, p["amount"], p["small"]), [("amount", "float", 0.5), ("small", "float", 0.5)], False),
    ("halo_tamer", "Detail", lambda d, p: _tamed(d, p["strength"]), [("strength", "float", 1.0)], False),
    ("abe", "Background", lambda d, p: surface.background_extract(d, p["degree"]), [("degree", "int", 4)], False),
    ("gradient_cleanup", "Background", lambda d, p: surface.gradient_cleanup(d, p["strength"]), [("strength", "float", 0.5)], False),
    ("dehaze", "Background", lambda d, p: stencil.dehaze(d, p["strength"], p["floor"]), [("strength", "float", 0.5), ("floor", "float", 0.05)], False),
    ("deveil", "Background", lambda d, p: surface.deepen_background(d, p["amount"]), [("amount", "float", 0.5)], False),
    ("selective_color", "Studio", lambda d, p: _selective(d, p), [("group", "choice", 0), *[(k, "float", 0.0) for k in ("cyan", "magenta", "yellow", "black")], ("range", "float", 50.0), ("guard", "float", 5.0), ("smooth", "float", 5.0), ("absolute", "bool", False), ("lum_protect", "bool", True)], False),
    ("wavelet_sharpen", "Studio", lambda d, p: stencil.wavelet_sharpen(d, [p[f"sharpen{i}"] for i in range(1, 7)], [p[f"denoise{i}"] for i in range(1, 4)], p["strength"]), [*[(f"sharpen{i}", "float", 0.0) for i in range(1, 7)], *[(f"denoise{i}", "float", 0.0) for i in range(1, 4)], ("strength", "float", 100.0)], False),
    ("noisex", "External", lambda d, p: stencil.noise_reduction(d), [], False),
    ("starx", "External", lambda d, p: stencil.shrink_stars(d, p["amount"], 0.5), [("amount", "float", 0.5)], False),
]:
    register(_n, _g, _f, _p, _r)


def _stars():
    from skyframe.operators import stars

    return stars


def _mixed(a: DataFrame, b: DataFrame, amount: float) -> DataFrame:
    return a if amount <= 0 else b if amount >= 1 else blended(a, b, None, False, amount)


def _tamed(df: DataFrame, strength: float) -> DataFrame:
    st = _stars()
    return st.halo_tamer(df, cut(st.ring_stars(df)), None, strength)


def _selective(df: DataFrame, p: dict) -> DataFrame:
    w = None
    if p["smooth"] > 0:
        m = pixel.colour_membership(df, p["group"], p["range"], p["guard"]).select(*PIX, "w")
        w = stencil.smooth(m, "w", max(0.5, 12.0 * p["smooth"] / 100.0))
    return pixel.selective_color(df, p["group"], p["cyan"], p["magenta"], p["yellow"], p["black"], p["range"], p["guard"], p["absolute"], p["lum_protect"], w)


#: Tools that run at the same time: each is a chain of jobs of which few keep a cluster busy by themselves.
AT_ONCE = 6


def contract_rows(df: DataFrame, given: dict[str, dict] | None = None, tools: dict[str, Tool] | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """(tool, image_id, n, n_valid) of every tool run by itself over all images with its settings.

    A tool keeps its contract where an image has as many pixels as before, unless it reshapes, and all of
    them hold three values in [0, 1].  ``given`` overrides default settings by tool.
    """
    px = cut(_rest(df))
    ok = F.lit(True)
    for c in RGB:
        ok = ok & F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False))

    def run(item: tuple[str, Tool]) -> DataFrame:
        name, tool = item
        done = _rest(tool.fn(px, tool.settings((given or {}).get(name))))
        return cut(done.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_valid")).select(F.lit(name).alias("tool"), "image_id", "n", "n_valid"))

    with ThreadPoolExecutor(at_once) as pool:
        return reduce(DataFrame.unionByName, pool.map(run, (tools or TOOLS).items()))


def blended(before: DataFrame, after: DataFrame, mask: DataFrame | None, invert: bool, opacity: float) -> DataFrame:
    """Mix a step's result over its input by opacity and, where given, a mask."""
    if mask is None:
        return _rest(masks.mix(before, after, 0.0 if invert else opacity))
    return _rest(masks.blend(before, after, mask, invert, opacity))


def replay(df: DataFrame, steps: list[dict], named_masks: dict[str, DataFrame] | None = None, cut_every: int = 4) -> DataFrame:
    """Apply an ordered recipe; each step is gated by its mask and opacity.

    A step that changes the frame's shape skips the gate, a missing mask suppresses the step, and
    lineage is cut before a gate and every few steps.
    """
    named_masks = named_masks or {}
    out = _rest(df)
    for i, s in enumerate(steps, 1):
        tool = TOOLS[s["name"]]
        name, opacity = s.get("mask"), min(1.0, max(0.0, float(s.get("opacity", 1.0))))
        if name and name not in named_masks and not tool.reshapes:
            continue
        gated = not tool.reshapes and (bool(name) or opacity < 0.999)
        if gated:  # read twice below: left as lineage, every gate would double the joins of one task
            out = cut(out)
        done = _rest(tool.fn(out, tool.settings(s.get("params"))))
        if not gated:
            out = done
        else:
            out = blended(out, done, named_masks.get(name) if name else None, bool(s.get("mask_invert")), opacity)
        if i % cut_every == 0:
            out = cut(out)
    return out


# --- edit lists: array<struct<name, mask, opacity>> per image, with a cursor


def insert_step(steps: Column, cursor: Column, step: Column) -> Column:
    """Insert at the cursor (0-based)."""
    n = F.size(steps)
    at = F.least(F.greatest(cursor, F.lit(0)), n)
    return F.concat(F.slice(steps, 1, at), F.array(step), F.slice(steps, at + 1, F.greatest(n - at, F.lit(0))))


def replace_step(steps: Column, index: Column, step: Column) -> Column:
    return F.transform(steps, lambda s, i: F.when(i == index, step).otherwise(s))


def delete_step(steps: Column, index: Column) -> Column:
    return F.filter(steps, lambda s, i: i != index)


def rename_mask(steps: Column, old: Column, new: Column) -> Column:
    """Repoint the steps that use a renamed mask."""
    return F.transform(steps, lambda s: s.withField("mask", F.when(s["mask"] == old, new).otherwise(s["mask"])))


def active_steps(steps: Column, cursor: Column) -> Column:
    """The result of a document depends on its first ``cursor`` steps only."""
    return F.slice(steps, 1, F.least(F.greatest(cursor, F.lit(0)), F.size(steps)))


