"""Chains over an archive whose stages keep their results by frame key, and the burst run.

A stage's table only grows: a run computes the keys it lacks, appends them as a folder of their own
and names that folder in the manifest.  A folder that no manifest row names was not finished and is
never read, so a run that dies loses at most its own work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.functions.quantiles import attach, group_mad
from skyframe.operators import burst, calibrate, quality, stack, stars, stencil
from skyframe.session import cut

FRAME = ["target_id", "frame_id"]
PIX = ["target_id", "y", "x"]
#: Pixels of a row band under which a stage's pixels are dealt out.
BAND = 64


@dataclass
class Stages:
    """Stage tables below ``path``, a folder that all executors share."""

    spark: SparkSession
    path: str
    #: Stage -> (keys wanted, keys computed) of this run.
    told: dict[str, tuple[int, int]] = field(default_factory=dict)

    def _folders(self, stage: str) -> list[str]:
        try:
            rows = self.spark.read.schema("stage string, folder string").json(f"{self.path}/manifest").where(F.col("stage") == stage).collect()
        except AnalysisException:
            return []
        return sorted({r.folder for r in rows})

    def table(self, stage: str, schema) -> DataFrame:
        """All finished rows of a stage; no rows before its first run."""
        folders = self._folders(stage)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def append(self, tables: dict[str, DataFrame]) -> None:
        """Rows of one or more stages, named in the manifest by one file: all of them count as finished or none."""
        folders = [(stage, f"{self.path}/{stage}/{uuid.uuid4().hex}") for stage in tables]
        for stage, folder in folders:
            tables[stage].write.parquet(folder)
        self.spark.createDataFrame(folders, "stage string, folder string").coalesce(1).write.mode("append").json(f"{self.path}/manifest")

    def once(self, stage: str, wanted: DataFrame, keys: Sequence[str], compute: Callable[[DataFrame], DataFrame], index: bool = True) -> DataFrame:
        """The stage's rows of the ``wanted`` keys; only keys it lacks are computed.

        ``compute`` takes the missing rows of ``wanted`` and returns rows that hold the keys.  What was
        computed is noted in a small table of its own, so that a key whose result has no rows is not
        computed again, and the pixels of a stage are not read to find what is missing.
        """
        keys = list(keys)
        wanted = cut(wanted)
        have = self.table(f"{stage}-keys", wanted.select(*keys).schema)
        missing = cut(wanted.join(have.hint("merge"), keys, "left_anti"))
        n, m = wanted.count(), missing.count()
        self.told[stage] = (n, m)
        if m or not self._folders(stage):
            self.append({stage: compute(missing), f"{stage}-keys": missing.select(*keys).distinct()})
        folders, noted = self._folders(stage), self._folders(f"{stage}-keys")
        rows, live = self.spark.read.parquet(*folders), wanted.select(*keys).distinct()
        # a stage that holds wanted keys only is read as it is: keys are wide, and looking them up is work for every pixel
        # (folders are fewer or more than those of keys where a prune died, or an older run between its rows and keys)
        if len(folders) == len(noted) and self.spark.read.parquet(*noted).join(live.hint("merge"), keys, "left_anti").isEmpty():
            return rows
        return rows.join(live.hint("shuffle_hash"), keys, "left_semi")

    def prune(self, stage: str, live: DataFrame, keys: Sequence[str]) -> None:
        """Keep only the ``live`` keys: one new folder takes the place of all earlier ones."""
        keys = list(keys)
        for name in (stage, f"{stage}-keys"):
            folders = self._folders(name)
            if folders:
                kept = cut(self.spark.read.parquet(*folders).join(live.select(*keys).distinct(), keys, "left_semi"))
                others = self.spark.read.schema("stage string, folder string").json(f"{self.path}/manifest").where(F.col("stage") != name)
                others = cut(others)
                folder = f"{self.path}/{name}/{uuid.uuid4().hex}"
                kept.write.parquet(folder)
                now = others.unionByName(self.spark.createDataFrame([(name, folder)], others.schema))
                now.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest")

    def counts(self) -> DataFrame:
        return self.spark.createDataFrame([(s, n, m) for s, (n, m) in self.told.items()], "stage string, wanted bigint, computed bigint")


def set_key(frames: DataFrame, name: str) -> DataFrame:
    """(target_id, name): changes when any frame of a target's set does."""
    return frames.groupBy("target_id").agg(F.concat_ws("-", F.count("*"), F.sum(F.xxhash64("frame_key").cast("decimal(38,0)"))).alias(name))


def moment_quality(px: DataFrame, sigma: float = 5.0) -> DataFrame:
    """Width and roundness from the second moments of a whole frame's excess over its background.

    A measure for frames too small for star detection: ``stars`` counts the pixels ``sigma`` deviations
    above the background.
    """
    st = cut(group_mad(px, FRAME, "v", "_d", "bg").select(*FRAME, "bg", (F.col("_d") * 1.4826).alias("noise")))
    p = F.greatest(F.col("v") - F.col("bg"), F.lit(0.0))
    d = attach(px, st, FRAME).withColumn("_p", p)
    m = d.groupBy(*FRAME).agg(
        F.count_if(F.col("v") > F.col("bg") + F.col("noise") * sigma).cast("int").alias("stars"), F.sum("_p").alias("s"), *[F.sum(F.col("_p") * e).alias(n) for n, e in
        (("my", F.col("y")), ("mx", F.col("x")), ("yy", F.col("y") * F.col("y")), ("xx", F.col("x") * F.col("x")), ("xy", F.col("x") * F.col("y")))],
    )
    s = F.col("s")
    vy, vx, c = F.col("yy") / s - F.pow(F.col("my") / s, 2), F.col("xx") / s - F.pow(F.col("mx") / s, 2), F.col("xy") / s - F.col("my") / s * (F.col("mx") / s)
    wide = F.when(s > 0, F.sqrt(F.greatest((vy + vx) / 2, F.lit(0.0))) * 2.3548)
    ecc = F.when(s > 0, F.sqrt(F.pow(vx - vy, 2) + c * c * 4) / F.greatest(vy + vx, F.lit(1e-9)))
    return m.select(*FRAME, "stars", wide.alias("fwhm"), ecc.alias("ecc")).join(st, FRAME)


def detected_quality(px: DataFrame) -> DataFrame:
    """Detected stars' median width and roundness per frame."""
    return stars.frame_quality(px, F.col("v"), keys=FRAME).select(*FRAME, "stars", "fwhm", "ecc", "bg", "noise")


def measure_only(px: DataFrame, measure: Callable[[DataFrame], DataFrame] = detected_quality, **cull) -> DataFrame:
    """Every frame measured and judged by its target's frames; nothing is stacked."""
    m = cut(measure(px))
    told = quality.cull(m, ["target_id"], **cull)
    return told.join(m, FRAME)


@dataclass(frozen=True)
class Settings:
    """What a folder run does; a change of any value is a change of every key below it."""

    calibrate: bool = True
    register: bool = True
    normalise: bool = True
    low: float = 4.0
    high: float = 3.0
    max_drift: float = 220.0

    def key(self, *names: str) -> str:
        return ",".join(f"{n}={getattr(self, n)}" for n in names)


def folder_to_master(frames: DataFrame, px: DataFrame, stages: Stages, settings: Settings | None = None, measure: Callable[[DataFrame], DataFrame] = detected_quality) -> dict[str, DataFrame]:
    """Listing and pixels to masters: calibrate, measure, cull, register, normalise, integrate, crop edges.

    ``frames`` has target_id, frame_id, frame_key, role (light, bias, dark, flat, dark_flat) and exptime;
    ``px`` has target_id, frame_id, y, x, v.  Calibrated pixels and measures are kept by frame key and the
    key of their calibration sets, registered pixels also by their reference and settings, masters by
    all that went into them.  Returns ``measures``, ``cull``, ``master``, ``edges`` and ``contract``.
    """
    settings = settings or Settings()
    sets = {r: cut(frames.where(F.col("role") == r)) for r in ("light", "bias", "dark", "flat", "dark_flat")}
    of = lambda s: px.join(s.select(*FRAME), FRAME, "left_semi")
    lights = sets["light"]
    named = lights.select("target_id").distinct()
    masters: dict[str, DataFrame | None] = {}
    if settings.calibrate:
        for role in ("bias", "dark", "dark_flat", "flat"):
            keys = set_key(sets[role], "set_key")
            if role == "flat":  # a flat's master also depends on what its pedestal is
                for below in ("dark_flat", "bias"):
                    keys = keys.join(set_key(sets[below], "_k"), "target_id", "left").withColumn("set_key", F.concat_ws("/", "set_key", "_k")).drop("_k")

            def build(missing: DataFrame, role=role) -> DataFrame:
                source = sets[role].join(missing.select("target_id"), "target_id", "left_semi")
                raw = of(source)
                if role == "flat":
                    raw = calibrate.pedestal_flats(raw, masters["dark_flat"], masters["bias"])
                return stack.calibration_master(raw, source).join(missing, "target_id")

            masters[role] = stages.once(f"master-{role}", keys, ["target_id", "set_key"], build).drop("set_key")
            named = named.join(keys.withColumnRenamed("set_key", f"_{role}"), "target_id", "left")
        named = named.select("target_id", F.concat_ws("|", *[F.coalesce(f"_{r}", F.lit("")) for r in ("bias", "dark", "dark_flat", "flat")]).alias("calib_key"))
        lights = attach(lights, named.hint("shuffle_hash"), ["target_id"])
    else:
        lights = lights.withColumn("calib_key", F.lit("none"))
    lights = cut(lights.select(*FRAME, "frame_key", "calib_key", "exptime"))
    own = ["frame_key", "calib_key"]

    def calibrated(missing: DataFrame) -> DataFrame:
        raw = of(missing)
        if settings.calibrate:
            raw = calibrate.calibrate_light(raw, masters["bias"], masters["dark"], masters["flat"])
        return raw.join(missing.select(*FRAME, *own).hint("shuffle_hash"), FRAME)

    clean = stages.once("calibrated", lights, own, calibrated)
    # pixels meet the keys of their frames over a shuffle
    chosen = lambda s: clean.join(s.select(*own).hint("shuffle_hash"), own, "left_semi")

    def measured(missing: DataFrame) -> DataFrame:
        got = cut(chosen(missing).select(*FRAME, "y", "x", "v"))
        return missing.select(*FRAME, *own).join(measure(got).hint("merge"), FRAME, "left").fillna(0, ["stars"])

    measures = cut(stages.once("measures", lights, own, measured))
    told = cut(quality.cull(measures.select("target_id", "frame_id", "stars", "fwhm", "ecc", "bg", "noise"), ["target_id"]))
    kept = cut(told.where("status = 'keep'").select(*FRAME, "is_reference").join(lights.hint("merge"), FRAME))
    reference = kept.where("is_reference").select("target_id", "frame_id", F.col("frame_key").alias("reference_key"))
    kept = attach(kept, reference.select("target_id", "reference_key"), ["target_id"])

    if settings.register:
        kept = cut(kept.withColumn("register_key", F.lit(settings.key("max_drift"))))
        placed = ["frame_key", "calib_key", "reference_key", "register_key"]

        def registered(missing: DataFrame) -> DataFrame:
            ids = missing.select("target_id").distinct()
            ref = reference.join(ids, "target_id", "left_semi").select(*FRAME)
            need = missing.select(*own).union(kept.where("is_reference").join(ids, "target_id", "left_semi").select(*own)).distinct()
            here = chosen(need).select(*FRAME, "y", "x", "v")
            offsets = cut(burst.register_burst(here, ref, max_drift=settings.max_drift))
            inside = offsets.where("not excluded").select(*FRAME, (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))
            return stencil.shift(here, inside).join(missing.select(*FRAME, *placed).hint("shuffle_hash"), FRAME)

        aligned = stages.once("registered", kept, placed, registered)
    else:
        aligned = chosen(kept)
    # what goes into a target's master: the frames kept, how they were made, and the settings
    inputs = kept.groupBy("target_id").agg(
        F.concat_ws("-", F.count("*"), F.sum(F.xxhash64(*[c for c in kept.columns if c.endswith("_key")]).cast("decimal(38,0)"))).alias("inputs"),
    ).withColumn("stack_key", F.lit(settings.key("register", "normalise", "low", "high")))

    def master(missing: DataFrame) -> DataFrame:
        here = cut(aligned.join(missing.select("target_id"), "target_id", "left_semi").select(*FRAME, "y", "x", "v"))
        if settings.normalise:
            here = stack.normalize_to_ref(here, cut(stack.frame_stats(here)), reference)
        made = stack.integrate(here, kept, low=settings.low, high=settings.high)
        return made.select(*PIX, F.col("mean_v").alias("v"), F.col("kept").alias("n"), "coverage").join(missing, "target_id")

    done = stages.once("master", inputs, ["target_id", "inputs", "stack_key"], master).select(*PIX, "v", "n", "coverage")
    present = cut(kept.join(aligned.select(*FRAME).distinct().hint("merge"), FRAME, "left_semi"))
    n_sub = cut(present.groupBy("target_id").agg(F.count("*").alias("n_sub")))
    edges = cut(stack.coverage_edges(done.select(*PIX, "coverage"), n_sub))
    return {"measures": measures, "cull": told, "master": done, "edges": edges, "contract": stack.contract(present.select(*FRAME, F.col("exptime").alias("exposure")), edges)}


# --- bursts


def register_consensus(px: DataFrame, ranks: DataFrame, max_drift=220.0, cluster=60.0, share=0.6, **kw) -> DataFrame:
    """Offsets of ranked frames after their sharpest; bursts whose reference is the outlier register again.

    ``ranks`` has target_id, frame_id, rank.  Where more frames drift too far than stay, and they agree, the
    first of that cluster becomes the reference and the old one is left out.  Returns target_id,
    frame_id, dx, dy, drift, excluded, reference_id and rescued.
    """
    ranks = cut(ranks.select(*FRAME, "rank"))
    chosen = lambda r: px.join(r.select(*FRAME), FRAME, "left_semi")
    first = ranks.where("rank = 1").select(*FRAME)
    off = cut(burst.register_burst(chosen(ranks), first, max_drift=max_drift, **kw))
    others = off.join(first, FRAME, "left_anti").join(ranks, FRAME)
    new = cut(quality.rescue_reference(others, ["target_id"], max_drift, cluster, share).select(*FRAME))
    told = lambda d, ref, again: d.join(ref.withColumnRenamed("frame_id", "reference_id"), "target_id").withColumn("rescued", F.lit(again))
    out = told(off, first, False)
    if new.isEmpty():
        return out
    rest = ranks.join(new.select("target_id"), "target_id", "left_semi").join(first, FRAME, "left_anti")
    again = cut(burst.register_burst(chosen(rest), new, max_drift=max_drift, **kw))
    return out.join(new.select("target_id"), "target_id", "left_anti").unionByName(told(again, new, True))


def stack_burst(px: DataFrame, keep=0.5, max_drift=220.0, **kw) -> tuple[DataFrame, DataFrame]:
    """(master, summary) of every burst: grade, drop dark frames, keep the sharpest, register, mean.

    The summary has n_graded, n_kept, n_stacked, the reference and whether it was replaced.
    """
    graded = cut(burst.grade_frames(px, keys=FRAME))
    lit = cut(quality.junk_gate(graded, ["target_id"]))
    ranks = cut(quality.keep_sharpest(lit, keep, ["target_id"]))
    off = cut(register_consensus(px, ranks, max_drift, **kw))
    used = off.where("not excluded")
    moved = stencil.shift(px.join(used.select(*FRAME), FRAME, "left_semi"), used.select(*FRAME, (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy")))
    n = lit.groupBy("target_id").agg(F.count("*").alias("n_graded")).join(ranks.groupBy("target_id").agg(F.count("*").alias("n_kept")), "target_id")
    n = n.join(used.groupBy("target_id").agg(F.count("*").alias("n_stacked"), F.first("reference_id").alias("reference_id"), F.first("rescued").alias("rescued")), "target_id")
    return burst.burst_mean(moved, used), n


POINT = ["target_id", "ay", "ax"]


def stack_field(px: DataFrame, reference: DataFrame, size=96, search=8.0, keep=0.5, **points) -> dict[str, DataFrame]:
    """A burst of a field that distorts: every alignment point takes its own best frames at its own offsets.

    ``offsets`` are the frames' whole shifts, ``measures`` each point's in each frame, ``kept`` the best frames per
    point, ``spread`` how far a burst's points scatter about their frame, ``master`` the blend of the kept windows.
    """
    ref = px.join(reference.select(*FRAME), FRAME, "left_semi")
    found = cut(burst.point_features(ref.select("target_id", "y", "x", "v"), size, keys=["target_id"], **points).select(*POINT))
    offsets = cut(burst.register_burst(px, reference))
    measures = cut(burst.measure_points(px, found, offsets.where("not excluded"), reference, size))
    near = measures.where(F.hypot("dx", "dy") <= search)
    kept = cut(quality.best_per_point(near, keep, search, POINT))
    return {
        "offsets": offsets, "points": found, "measures": measures, "kept": kept, "spread": quality.field_spread(near, ["target_id"]),
        "master": burst.stack_points(px, kept.select(*FRAME, "ay", "ax", "ox", "oy"), size),
    }
