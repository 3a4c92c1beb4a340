"""The finishing run: a step plan per image, carried out over all images.

Images with the same plan shape (steps and settings in order) share one branch; there are as many
branches as shapes, however many images.  Every step is written, so that a lost executor costs one
step, and judged per image: an image whose step raises, loses its pixels or leaves fewer valid ones
keeps the pixels it had, the ledger names the reason, and its later steps go on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.functions.math import clip
from skyframe.operators import masks, pixel, registry, rules, scene, stars, stats, stencil, surface, trails
from skyframe.operators.stats import RGB
from skyframe.session import checkpoint_root, cut, scratch_path

PIX = ["image_id", "y", "x"]


class StepError(Exception):
    """A step cannot be carried out for any image of a shape."""


@dataclass
class Work:
    """Tables a run needs beside the pixels, and what earlier steps left for later ones."""

    noise: DataFrame | None = None
    coverage: DataFrame | None = None
    classes: DataFrame | None = None
    trails: DataFrame | None = None
    foreground: DataFrame | None = None
    foreground_mask: DataFrame | None = None
    made: dict[str, DataFrame] = field(default_factory=dict)

    def need(self, name: str) -> DataFrame:
        got = self.made.get(name)
        got = getattr(self, name, None) if got is None else got
        if got is None:
            raise StepError(f"no {name.replace('_', ' ')}")
        return got


@dataclass
class Step:
    """``fn(pixels, settings, work)``; ``settings`` names the columns of the parameter row it reads."""

    fn: Callable[[DataFrame, dict, Work], DataFrame]
    settings: tuple[str, ...] = ()
    reshapes: bool = False


def _snr_mask(d, s, w):
    snr = masks.snr_map(d, w.need("noise"), stats.mean_of(RGB))
    w.made["snr_mask"] = cut(masks.snr_protect(snr, w.coverage))
    return d


def _significance_map(d, s, w):
    w.made["significance_map"] = cut(stencil.significance_weight(d, w.need("noise"), w.coverage))
    return d


def _protected(before: DataFrame, after: DataFrame, s: dict, w: Work) -> DataFrame:
    """Where the signal is weak, less of the step, by the protection dial."""
    mask = w.made.get("snr_mask")
    if mask is None or not s.get("snrProtect"):
        return after
    return masks.blend(before, after, mask.withColumn("w", F.col("w") * min(1.0, s["snrProtect"])), True)


def _deepen(d, s, w):
    w.made["source"] = d
    return stencil.deepen(d, s["deepen"])


def _trails(d, s, w):
    """The developed and tapered trail layer added to the picture."""
    layer = trails.taper(trails.develop_trails(w.need("trails"), s["meteorStrength"], keys=["image_id"]), keys=["image_id"])
    layer = layer.select(*PIX, F.col("v").alias("_t"))
    return d.join(layer.hint("merge"), PIX, "left").select(*PIX, *[clip(F.col(c) + F.coalesce("_t", F.lit(0.0))).alias(c) for c in RGB])


def _foreground(d, s, w):
    return scene.composite(d, scene.develop_foreground(w.need("foreground"), s.get("nightscapeBrightness", 0.5)), w.need("foreground_mask"))


def _no_tool(d, s, w):
    raise StepError("no tool")


STEPS: dict[str, Step] = {
    "crop": Step(lambda d, s, w: pixel.crop_percent(d, s["cropPercent"]), ("cropPercent",), True),
    "snr_mask": Step(_snr_mask),
    "significance_map": Step(_significance_map),
    "background": Step(lambda d, s, w: surface.background_extract(d)),
    "dark_lane": Step(lambda d, s, w: surface.dark_lane_gradient(d)),
    "fix_chromatic": Step(lambda d, s, w: stars.correct_offsets(d)),
    "deconvolution": Step(_no_tool),
    "color_calibration": Step(lambda d, s, w: stats.color_calibrate(d)),
    "auto_stretch": Step(lambda d, s, w: stats.auto_stretch(d)),
    "deepen": Step(_deepen, ("deepen",)),
    "noise_reduction": Step(lambda d, s, w: stencil.noise_reduction(d)),
    "scnr": Step(lambda d, s, w: pixel.remove_green(d, s.get("scnrAmount", 1.0)), ("scnrAmount",)),
    "hdr": Step(lambda d, s, w: stencil.hdr_core(d)),
    "structure": Step(lambda d, s, w: stencil.structure_boost(d, s["structure"]), ("structure",)),
    "background_level": Step(lambda d, s, w: pixel.background_level(d, s.get("bgLevel", 0.05)), ("bgLevel",)),
    "contrast": Step(lambda d, s, w: pixel.contrast(d, s.get("pivot", 0.12), s.get("contrast", 0.15)), ("pivot", "contrast")),
    "chroma_nr": Step(lambda d, s, w: stencil.chroma_nr(d, s["chromaNR"]), ("chromaNR",)),
    "saturation": Step(lambda d, s, w: pixel.saturation(d, s.get("saturation", 0.0)), ("saturation",)),
    "reduce_cast": Step(lambda d, s, w: stencil.reduce_cast(d)),
    "emission_boost": Step(lambda d, s, w: pixel.emission_boost(d)),
    "dehaze": Step(lambda d, s, w: stencil.dehaze(d, s["dehaze"], s.get("bgLevel", 0.05)), ("dehaze", "bgLevel")),
    "gradient_cleanup": Step(lambda d, s, w: surface.gradient_cleanup(d, s["gradientCleanup"]), ("gradientCleanup",)),
    "local_contrast": Step(lambda d, s, w: _protected(d, stencil.local_contrast(d, s.get("localContrast", 0.12)), s, w), ("localContrast", "snrProtect")),
    "significance": Step(lambda d, s, w: stencil.significance_display(d, w.need("significance_map"), s["significance"]), ("significance",)),
    "star_shrink": Step(lambda d, s, w: stencil.shrink_stars(d, s["starShrink"], s.get("smallStars", 0.5)), ("starShrink", "smallStars")),
    "halo_tamer": Step(lambda d, s, w: registry.TOOLS["halo_tamer"].fn(d, {"strength": 1.0})),
    "restore_highlights": Step(lambda d, s, w: stencil.restore_highlights(d, w.need("source"), s["deepen"]), ("deepen",)),
    "core_transparency": Step(lambda d, s, w: stencil.core_transparency(d, s["transparency"]), ("transparency",)),
    "dim_core": Step(lambda d, s, w: stencil.dim_core(d, s["dimCore"]), ("dimCore",)),
    "shadow_anchor": Step(lambda d, s, w: pixel.shadow_anchor(d, w.classes if w.classes is not None else d.select("image_id").distinct().withColumn("object_class", F.lit("generic")))),
    "deveil": Step(lambda d, s, w: surface.deepen_background(d, s["deepenBackground"]), ("deepenBackground",)),
    "trails": Step(_trails, ("meteorStrength",)),
    "highlight_rolloff": Step(lambda d, s, w: stencil.highlight_rolloff(d, s.get("knee", 0.82)), ("knee",)),
    "foreground": Step(_foreground, ("nightscapeBrightness",)),
}


def finishing_plan(params: DataFrame, steps: dict[str, Step] = STEPS) -> DataFrame:
    """The step plan of every image with the settings (JSON) that its steps read from the parameter row."""
    have = set(params.columns)
    items = []
    for name, step in steps.items():
        values = [F.col(c).cast("double").alias(c) for c in step.settings if c in have]
        items.append(F.struct(F.lit(name).alias("step"), (F.to_json(F.struct(*values)) if values else F.lit("{}")).alias("settings")))
    each = params.select("image_id", F.explode(F.array(*items)).alias("_s")).select("image_id", "_s.*")
    return rules.step_plan(params).join(each, ["image_id", "step"], "left")


def _one_line(e: Exception) -> str:
    """What a failure says, without the addresses around it."""
    text = str(e)
    if isinstance(e, PySparkException) and e.getCondition():
        text = e.getMessageParameters().get("errorMessage", text) if e.getCondition() == "USER_RAISED_EXCEPTION" else text
    return (text.strip().splitlines() or [type(e).__name__])[0][:200]


def _counts(d: DataFrame, name: str) -> DataFrame:
    valid = F.lit(True)
    for c in RGB:
        valid = valid & F.col(c).isNotNull() & ~F.isnan(c)
    return d.groupBy("image_id").agg(F.count("*").alias(f"{name}_rows"), F.count_if(valid).alias(f"{name}_valid"))


#: Parts that the images of a failed step are split into, and parts that run at the same time.
PARTS, AT_ONCE = 8, 8
#: Images that are tried on one plan; the driver holds their numbers.
BATCH = 8192


def _images(d: DataFrame) -> DataFrame:
    return d.select("image_id").distinct()


def _as_tasks(d: DataFrame, step: Step, settings: dict, work: Work, tasks: int):
    """The step over images dealt to ``tasks`` tasks as a Java RDD without rows, or nothing where images meet after that.

    Every column is computed, by a condition that stays above the exchange and that a row meets once in 2^64.
    """
    own = replace(work, made=dict(work.made))
    done = step.fn(d.repartition(tasks, "image_id"), settings, own).select(*PIX, *RGB)
    tried = done.where(F.xxhash64(*done.columns, F.spark_partition_id()) == 0)
    plan = tried._jdf.queryExecution().executedPlan().toString()
    if plan.count("Exchange") != 1 or not re.search(rf"Exchange hashpartitioning\(image_id#\w+, {tasks}\)", plan):
        return None
    rdd = tried._jdf.toJavaRDD()
    return rdd if rdd.getNumPartitions() == tasks else None


def _stoppers(d: DataFrame, step: Step, settings: dict, work: Work) -> list[tuple] | None:
    """(image, reason) of the images of a batch that stop the step, or nothing where that is not found this way.

    Where the step moves no rows between tasks, each image gets a task of its own and a try is a job over
    some tasks of one plan: no try plans, writes or lists anything.  Images that share a task are dealt again.
    """
    sc, found = d.sparkSession.sparkContext, []
    ids = [r.image_id for r in _images(d).collect()]
    for turn in range(10):
        tasks = 4 * len(ids) + 256 + turn
        homes = d.sparkSession.createDataFrame([(i,) for i in ids], d.select("image_id").schema).select("image_id", F.pmod(F.hash("image_id"), F.lit(tasks)).alias("at")).collect()
        held = {}
        for r in homes:
            held.setdefault(r.at, []).append(r.image_id)
        try:
            rdd = _as_tasks(d, step, settings, work, tasks)
        except Exception:  # noqa: BLE001  the step runs a job of its own, or fails before its images are dealt
            return None
        if rdd is None:
            return None

        def tried(places: list[int]) -> Exception | None:
            wanted = sc._gateway.new_array(sc._jvm.int, len(places))
            for i, p in enumerate(places):
                wanted[i] = p
            try:
                rdd.glom().collectPartitions(wanted)  # an RDD of its own: Spark ends all jobs over an RDD when one of them fails
            except Exception as e:  # noqa: BLE001  an image of the part stopped the job
                return e
            return None

        again, open_ = [], [sorted(held)]
        with ThreadPoolExecutor(2 * AT_ONCE) as pool:  # such a job is mostly waiting
            while open_:
                parts = [some[i::PARTS] for some in open_ for i in range(min(PARTS, len(some)))]
                open_ = []
                for places, e in zip(parts, pool.map(tried, parts)):
                    if e is None:
                        continue
                    if len(places) > 1:
                        open_.append(places)
                    elif len(held[places[0]]) > 1:
                        again += held[places[0]]
                    else:
                        found.append((held[places[0]][0], _one_line(e)))
        if not again:
            return found
        ids, d = again, cut(d.where(F.col("image_id").isin(again)))
    return None


def _without_stoppers(d: DataFrame, step: Step, settings: dict, work: Work) -> tuple[DataFrame, DataFrame] | None:
    """(pixels, table of (image_id, reason)): the step over the images that do not stop it, the others as they were."""
    spark, schema = d.sparkSession, d.schema
    batches = -(-_images(d).count() // BATCH)
    path = scratch_path(spark, "batches")
    rows = d.withColumn("batch", F.pmod(F.xxhash64("image_id"), F.lit(batches)))
    rows.repartition("image_id").write.partitionBy("batch").parquet(path)
    told = []
    for batch in sorted(r.batch for r in spark.read.parquet(path).select("batch").distinct().collect()):
        found = _stoppers(spark.read.schema(schema).parquet(f"{path}/batch={batch}"), step, settings, work)
        if found is None:
            return None
        told.append(cut(spark.createDataFrame(found, T.StructType([schema["image_id"], T.StructField("reason", T.StringType())]))))
    bad = reduce(DataFrame.unionByName, told)
    fit = cut(d.join(bad.select("image_id"), "image_id", "left_anti").select(*d.columns))
    own = replace(work, made=dict(work.made))
    try:
        done = cut(step.fn(fit, settings, own).select(*PIX, *RGB))
    except Exception:  # noqa: BLE001  together they stop it all the same
        return None
    work.made.update(own.made)
    return done.unionByName(d.join(bad.select("image_id"), "image_id", "left_semi").select(*PIX, *RGB)), bad


def _by_parts(d: DataFrame, step: Step, settings: dict, work: Work, error: Exception) -> tuple[DataFrame, list[DataFrame]]:
    """The step's result without the images that stop it, which keep their pixels and get a reason.

    A part that fails is split by a hash of its images, and written so that each try reads its own
    images only; parts run side by side, as each is a small job.
    """
    spark, schema = d.sparkSession, d.schema

    def split(part: tuple) -> list[tuple]:
        pixels, level = part
        path = scratch_path(spark, "parts")
        rows = pixels.withColumn("part", F.pmod(F.xxhash64("image_id", F.lit(level)), F.lit(PARTS)))
        rows.repartition("image_id").write.partitionBy("part").parquet(path)
        each = spark.read.parquet(path).groupBy("part").agg(F.count_distinct("image_id").alias("n")).collect()
        return [(f"{path}/part={r.part}", level + 1, r.n) for r in each]

    def tried(part: tuple) -> tuple:
        path, level, n = part
        own, out = replace(work, made=dict(work.made)), scratch_path(spark, "cut")
        try:
            done = step.fn(spark.read.schema(schema).parquet(path), settings, own).select(*PIX, *RGB)
            done.write.parquet(out)
        except Exception as e:  # noqa: BLE001  images of the part stopped the job
            alone = n == 1 or isinstance(e, (StepError, AnalysisException))
            return ("failed", path, _one_line(e)) if alone else ("open", path, level)
        return "done", out, done.schema, own.made

    if _images(d).limit(2).count() < 2:
        return d, [_images(d).withColumn("reason", F.lit(_one_line(error)))]
    checkpoint_root(spark)  # set before the threads need it
    if found := _without_stoppers(d, step, settings, work):
        return found[0], [found[1]]
    open_, done, made, reasons = [(d, 0)], {}, {}, {}
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while open_:
            parts = [p for some in pool.map(split, open_) for p in some]
            open_ = []
            for kind, path, *rest in pool.map(tried, parts):
                if kind == "open":
                    open_.append((spark.read.schema(schema).parquet(path), rest[0]))
                elif kind == "failed":
                    reasons.setdefault(rest[0], []).append(path)
                else:
                    done.setdefault(rest[0].json(), (rest[0], []))[1].append(path)
                    for name in rest[1].keys() - work.made.keys():
                        made.setdefault(name, []).append(rest[1][name])
    work.made.update({name: reduce(DataFrame.unionByName, tables) for name, tables in made.items()})
    stopped = {reason: spark.read.schema(schema).parquet(*paths) for reason, paths in reasons.items()}
    tables = [spark.read.schema(kind).parquet(*paths) for kind, paths in done.values()] + [t.select(*PIX, *RGB) for t in stopped.values()]
    return reduce(DataFrame.unionByName, tables), [t.select("image_id").distinct().withColumn("reason", F.lit(reason)) for reason, t in stopped.items()]


def _attempt(d: DataFrame, step: Step, settings: dict, work: Work) -> tuple[DataFrame, list[DataFrame]]:
    """(pixels, tables of (image_id, reason)): the step's result where it has one."""
    told = []
    try:
        done = cut(step.fn(d, settings, work).select(*PIX, *RGB))
    except (StepError, AnalysisException) as e:
        return d, [d.select("image_id").distinct().withColumn("reason", F.lit(_one_line(e)))]
    except Exception as e:  # noqa: BLE001  some image of the shape stopped the job: look for it by parts
        done, told = _by_parts(d, step, settings, work, e)
    lost = F.coalesce("after_valid", F.lit(0)) == 0
    if not step.reshapes:
        lost = lost | (F.col("after_rows") != F.col("before_rows")) | (F.col("after_valid") < F.col("before_valid"))
    bad = _counts(d, "before").join(_counts(done, "after"), "image_id", "left").where(lost & (F.col("before_valid") > 0))
    bad = cut(bad.select("image_id", F.concat(F.lit("left "), F.coalesce("after_valid", F.lit(0)).cast("string"), F.lit(" of "), F.col("before_valid").cast("string"), F.lit(" valid pixels")).alias("reason")))
    if bad.isEmpty():
        return done, told
    ids = bad.select("image_id")
    return done.join(ids, "image_id", "left_anti").unionByName(d.join(ids, "image_id", "left_semi")), [*told, bad]


def shapes_of(plan: DataFrame) -> DataFrame:
    """(image_id, shape): the running steps with their settings in order, as JSON."""
    running = plan.where("run").groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("ord", "step", "settings"))).alias("s"))
    return running.select("image_id", F.to_json(F.expr("transform(s, x -> struct(x.ord, x.step, x.settings))")).alias("shape"))


def run_plan(px: DataFrame, plan: DataFrame, work: Work | None = None, steps: dict[str, Step] = STEPS) -> tuple[DataFrame, DataFrame]:
    """(pixels, ledger) of ``plan`` (image_id, ord, step, run, reason, settings) over ``px`` (image_id, y, x, r, g, b).

    The ledger has one row per image and step of the plan: outcome ``run``, ``skipped`` or ``failed``
    with its reason.  Images without a running step keep their pixels.  Steps that share a settings
    value share a branch, so continuous dials should be rounded before they come here.
    """
    work = work or Work()
    images = cut(shapes_of(plan))
    out = px.select(*PIX, *RGB).join(images, "image_id", "left_anti")
    failed = plan.sparkSession.createDataFrame([], "image_id bigint, ord int, reason string")
    for row in images.select("shape").distinct().toLocalIterator():
        mine = images.where(F.col("shape") == row.shape).select("image_id")
        d = px.select(*PIX, *RGB).join(mine, "image_id", "left_semi")
        own = replace(work, made={})
        for s in json.loads(row.shape):
            tool = steps.get(s["step"], Step(_no_tool))
            d, told = _attempt(d, tool, json.loads(s.get("settings") or "{}"), own)
            for t in told:
                failed = failed.unionByName(t.select("image_id", F.lit(s["ord"]).alias("ord"), "reason"))
        out = out.unionByName(d)
    ledger = plan.select("image_id", "ord", "step", "run", F.col("reason").alias("_why")).join(cut(failed), ["image_id", "ord"], "left")
    outcome: Column = F.when(~F.col("run"), "skipped").when(F.col("reason").isNotNull(), "failed").otherwise("run")
    ledger = ledger.select("image_id", "ord", "step", outcome.alias("outcome"), F.when(F.col("run"), F.col("reason")).otherwise(F.col("_why")).alias("reason"))
    return out.select(*PIX, *[clip(F.col(c)).alias(c) for c in RGB]), ledger


def finish(px: DataFrame, params: DataFrame, work: Work | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole finishing run of images with a parameter row each."""
    return run_plan(px, finishing_plan(params), work)
