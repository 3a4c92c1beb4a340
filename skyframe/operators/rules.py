"""Settings, recipes, pins and step plans: rule tables joined with data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyframe.functions.lookups import CLASSES, DIALS, PREDICATES, PROFILE_FIELDS, RECIPE_RANGES, SWITCHES, UNIT_DIALS, class_profiles
from skyframe.functions.math import clip


def with_profile(images: DataFrame, cls="object_class") -> DataFrame:
    """Attach the class profile (prefixed ``p_``); unknown classes use the generic one."""
    known = F.when(F.col(cls).isin(*CLASSES), F.col(cls)).otherwise("generic")
    prof = class_profiles(images.sparkSession).select(F.col("object_class").alias("_k"), *[F.col(f).alias(f"p_{f}") for f in PROFILE_FIELDS])
    return images.withColumn("_k", known).join(prof, "_k").drop("_k")


def effective_settings(images: DataFrame) -> DataFrame:
    """clip(profile + dial) for the five dials; a missing dial counts as zero."""
    have = set(images.columns)
    d = with_profile(images)
    out = {f"eff_{f}": clip(F.col(f"p_{f}") + (F.coalesce(F.col(a), F.lit(0.0)) if a in have else 0.0), lo, hi) for a, (f, lo, hi) in DIALS.items()}
    return d.withColumns(out).drop(*[f"p_{f}" for f in PROFILE_FIELDS])


# Which profile field seeds which switch or dial.
SEEDED = {
    "doSCNR": "scnr", "doLocalContrast": "localContrast", "doBXT": "bxt", "doNR": "nr", "doHDR": "hdr", "doStarReduce": "starReduce", "haloTamer": "haloTamer",
    "chromaNR": "chromaNR", "doBgExtract": "bgExtract", "darkLaneGC": "darkLaneGC", "reduceCast": "reduceCast", "structure": "structure",
}


def class_switches(images: DataFrame) -> DataFrame:
    """Switches seeded from the profile; an explicit column of the same name wins where not null."""
    have = set(images.columns)
    d = with_profile(images)
    out = {k: F.coalesce(F.col(k), F.col(f"p_{f}")) if k in have else F.col(f"p_{f}") for k, f in SEEDED.items()}
    return d.withColumns(out).drop(*[f"p_{f}" for f in PROFILE_FIELDS])


# Finishing presets of a bright body.
BODY_FIELDS = ["sharp", "surface", "flatten", "lhe", "sat", "ht_mid", "ht_hi", "tone", "disc_target"]
BODY_PRESETS = {
    "sun": (0.3, 6.0, 0.35, 0.0, 0.0, 0.559, 0.858, "golden", 0.72),
    "moon": (0.45, 0.0, 0.0, 0.4, 0.6, 0.5, 1.0, "neutral", 0.72),
    "neutral": (0.2, 0.0, 0.0, 0.0, 0.0, 0.5, 1.0, "neutral", 0.60),
}


def body_preset(images: DataFrame, name="body") -> DataFrame:
    """Finishing preset by body name; anything else gets the base one."""
    n = F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))
    key = F.when(n == "moon", "moon").when(n.isin("neutral", "neutral base", "neutral-base"), "neutral").otherwise("sun")
    t = images.sparkSession.createDataFrame([(k, *v) for k, v in BODY_PRESETS.items()], "_b string, " + ", ".join(f"{f} {'string' if f == 'tone' else 'double'}" for f in BODY_FIELDS))
    return images.withColumn("_b", key).join(t, "_b").drop("_b")


def applies(predicate: str, cls="object_class") -> Column:
    return F.col(cls).isin(*PREDICATES[predicate])


def effective_floor(level: Column, lift: Column) -> Column:
    """Background floor raised by the measured dust lift (at most 0.03) and clamped."""
    _, lo, hi = DIALS["bgAdj"]
    return clip(level + clip(lift, 0.0, 0.03), lo, hi)


def adaptive_floor(images: DataFrame, dust: DataFrame, on="image_id") -> DataFrame:
    """Floor per image: the class level, raised by dust for eligible unstretched images."""
    d = effective_settings(images).join(dust.select(on, "lift"), on, "left")
    go = applies("adaptive_floor") & F.col("adaptiveFloor") & ~F.col("inputStretched")
    return d.withColumn("floor", F.when(go, effective_floor(F.col("eff_bgLevel"), F.coalesce("lift", F.lit(0.0)))).otherwise(F.col("eff_bgLevel")))


def record_decisions(rows: DataFrame, pins: DataFrame) -> DataFrame:
    """Decision ledger: a pin replaces a *decided* value when it coerces to the computed type."""
    p = pins.select("run_id", F.col("key").alias("_key"), F.col("pin").alias("_pin"))
    d = rows.withColumn("_key", F.concat_ws("|", "group", "name")).join(p, ["run_id", "_key"], "left")
    pin = F.trim("_pin")
    num = F.expr("try_cast(trim(_pin) as double)")
    coerced = (
        F.when(F.col("type") == "bool", F.lower(pin).isin("1", "true", "yes", "on").cast("string"))
        .when(F.col("type") == "int", F.rint(num).cast("long").cast("string"))
        .when(F.col("type") == "float", num.cast("string"))
        .otherwise(F.col("_pin"))
    )
    usable = (F.col("kind") == "decided") & F.col("_pin").isNotNull() & coerced.isNotNull()
    return d.withColumn("pinned", usable).withColumn("value", F.when(usable, coerced).otherwise(F.col("computed"))).drop("_key", "_pin")


# --- recipes


def recipe_rules(spark) -> DataFrame:
    rows = [(k, "real", lo, hi) for k, (lo, hi) in RECIPE_RANGES.items()]
    rows += [(k, "real", 0.0, 1.0) for k in UNIT_DIALS] + [(k, "bool", None, None) for k in SWITCHES]
    return spark.createDataFrame(rows + [("objectClass", "class", None, None), ("palette", "text", None, None)], "key string, kind string, lo double, hi double")


def apply_recipes(recipes: DataFrame, doc="j", on="image_id") -> DataFrame:
    """Accepted settings of each JSON recipe, one row per (image, key).

    Only objects that say ``"recipe": 1`` are recipes; others give no rows.  Numbers must be JSON
    numbers (a boolean is not one) and are clamped, switches must be booleans, the class must be
    known, anything else is ignored, empty keys included.
    """
    v = recipes.select(on, F.try_parse_json(F.col(doc)).alias("_v"))
    v = v.filter(F.expr("schema_of_variant(_v) like 'OBJECT%' and try_variant_get(_v, '$.recipe', 'double') = 1 and schema_of_variant(variant_get(_v, '$.recipe')) <> 'STRING'"))
    each = v.sparkSession.tvf.variant_explode(F.col("_v").outer())
    d = v.lateralJoin(each).select(on, "key", F.col("value").alias("_one"))
    d = d.withColumn("_t", F.schema_of_variant("_one")).join(recipe_rules(recipes.sparkSession), "key")
    num = F.expr("try_variant_get(_one, '$', 'double')")
    text = F.expr("try_variant_get(_one, '$', 'string')")
    value = (
        F.when((F.col("kind") == "real") & F.col("_t").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.least(F.greatest(num, F.col("lo")), F.col("hi")).cast("string"))
        .when((F.col("kind") == "bool") & (F.col("_t") == "BOOLEAN"), text)
        .when((F.col("kind") == "class") & (F.col("_t") == "STRING") & text.isin(*CLASSES), text)
        .when((F.col("kind") == "text") & (F.col("_t") == "STRING") & (text != ""), text)
    )
    return d.select(on, "key", value.alias("value")).filter(F.col("value").isNotNull())


def save_recipes(settings: DataFrame, on="image_id", version="1") -> DataFrame:
    """One JSON recipe per image from (image, key, value) settings; keys are few and fixed.

    Numbers and switches are written as JSON numbers and booleans, as their rule has them.
    """
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    kinds = recipe_rules(settings.sparkSession).select("key", "kind")
    literal = F.when(F.col("kind").isin("real", "bool"), F.col("value")).otherwise(quoted("value"))
    parts = settings.join(kinds, "key", "left").select(on, F.concat(quoted("key"), F.lit(":"), literal).alias("_p"))
    body = parts.groupBy(on).agg(F.concat_ws(",", F.array_sort(F.collect_list("_p"))).alias("_b"))
    return body.select(on, F.concat(F.lit(f'{{"recipe":1,"version":"{version}",'), "_b", F.lit("}")).alias("j"))


# --- step plan


# Order of suggested steps, and the mask (inverted?) each is gated by.
SUGGESTION_ORDER = ["gradient_cleanup", "bg_neutralize", "scnr", "deveil", "chroma_nr", "noise_reduction", "local_contrast", "contrast", "saturation", "highlight_rolloff"]
GATES = {
    "saturation": ("Star cores", True), "chroma_nr": ("Detail (protect)", True), "noise_reduction": ("Detail (protect)", True), "local_contrast": ("Nebulosity", False),
    "structure": ("Nebulosity", False), "deveil": ("Bright nebulosity", True), "dehaze": ("Bright nebulosity", True), "reduce_cast": ("Sky", False),
    "highlight_rolloff": ("Cores", False), "emission_boost": ("Hα (red)", False),
}


def order_steps(steps: DataFrame) -> DataFrame:
    """Canonical position of every suggested step."""
    t = steps.sparkSession.createDataFrame([(n, i) for i, n in enumerate(SUGGESTION_ORDER)], "name string, ord int")
    return steps.join(t, "name")


def gate_steps(steps: DataFrame, available: DataFrame, on="image_id") -> DataFrame:
    """Gate each suggestion by its mask where the image has that mask."""
    t = steps.sparkSession.createDataFrame([(n, m, i) for n, (m, i) in GATES.items()], "name string, _mask string, _inv boolean")
    a = available.select(on, F.col("mask_name").alias("_mask"), F.lit(True).alias("_has")).distinct()
    d = steps.join(t, "name", "left").join(a, [on, "_mask"], "left")
    has = F.coalesce("_has", F.lit(False))
    return d.withColumn("mask", F.when(has, F.col("_mask"))).withColumn("mask_invert", has & F.coalesce("_inv", F.lit(False))).drop("_mask", "_inv", "_has")


def needed_masks(gated: DataFrame, existing: DataFrame, on="image_id") -> DataFrame:
    """Masks a gated plan refers to that the image does not have under that name yet."""
    want = gated.filter(F.col("mask").isNotNull()).select(on, F.col("mask").alias("mask_name")).distinct()
    return want.join(existing.select(on, "mask_name"), [on, "mask_name"], "left_anti")


def step_rules() -> list[tuple[str, Column, Column]]:
    """(step, runs?, reason when it does not) in finishing order, over one wide parameter row."""
    c = F.col
    color, pre, lin = c("is_color"), c("preview"), ~c("inputStretched")
    narrow = c("narrowband")
    yes = F.lit(True)

    def why(*pairs):
        out = None
        for cond, text in pairs:
            out = F.when(cond, text) if out is None else out.when(cond, text)
        return out.otherwise("switched off") if out is not None else F.lit("switched off")

    return [
        ("crop", c("cropPercent") > 0, why()),
        ("snr_mask", c("has_noise") & (c("snrProtect") > 0), why((~c("has_noise"), "no noise map"))),
        ("significance_map", c("has_noise") & (c("significance") > 0), why((~c("has_noise"), "no noise map"))),
        ("background", c("doBgExtract"), why()),
        ("dark_lane", c("darkLaneGC") & lin, why((~lin, "input already stretched"))),
        ("fix_chromatic", c("fixChromatic") & color & lin, why((~color, "mono image"), (~lin, "input already stretched"))),
        ("deconvolution", c("doBXT") & c("useClassicalDeconv") & lin & ~pre, why((~lin, "input already stretched"), (pre, "preview"), (~c("useClassicalDeconv"), "no tool"))),
        ("color_calibration", c("doColorCal") & color & lin & ~narrow, why((narrow, "narrowband"), (~lin, "input already stretched"), (~color, "mono image"))),
        ("auto_stretch", lin, why((~lin, "input already stretched"))),
        ("deepen", c("deepen") > 0, why()),
        ("noise_reduction", c("doNR") & ~pre, why((c("doNR") & pre, "preview"))),
        ("scnr", c("doSCNR") & color, why((~color, "mono image"))),
        ("hdr", c("doHDR"), why()),
        ("structure", c("structure") > 0, why()),
        ("background_level", yes, why()),
        ("contrast", yes, why()),
        ("chroma_nr", color & (c("chromaNR") > 0), why((~color, "mono image"))),
        ("saturation", color, why((~color, "mono image"))),
        ("reduce_cast", color & c("reduceCast"), why((~color, "mono image"))),
        ("emission_boost", color & c("enhanceEmission"), why((~color, "mono image"))),
        ("dehaze", color & (c("dehaze") > 0), why((~color, "mono image"))),
        ("gradient_cleanup", c("gradientCleanup") > 0, why()),
        ("local_contrast", c("doLocalContrast"), why()),
        ("significance", c("significance") > 0, why()),
        ("remove_stars", F.lit(False), why((c("removeStars") & pre, "preview"), (c("removeStars"), "no tool"))),
        ("star_reduction", F.lit(False), why((c("doStarReduce") & pre, "preview"), (c("doStarReduce"), "no tool"))),
        ("star_shrink", (c("starShrink") > 0) & ~(c("removeStars") & ~pre), why((c("removeStars"), "stars removed"))),
        ("halo_tamer", c("haloTamer") & ~pre, why((c("haloTamer") & pre, "preview"))),
        ("restore_highlights", c("inputStretched") & (c("deepen") > 0) & ~narrow, why((narrow, "narrowband"))),
        ("core_transparency", c("transparency") > 0, why()),
        ("dim_core", c("dimCore") > 0, why()),
        ("shadow_anchor", yes, why()),
        ("deveil", c("deepenBackground") > 0, why()),
        ("trails", c("has_trails") & (c("meteorStrength") > 0) & color, why((~c("has_trails"), "no trail layer"), (~color, "mono image"))),
        ("highlight_rolloff", yes, why()),
        ("foreground", c("has_foreground"), why((~c("has_foreground"), "no foreground layer"))),
    ]


def step_plan(params: DataFrame, on="image_id") -> DataFrame:
    """Which finishing steps run for every image, in order, with the reason of each omission."""
    items = [
        F.struct(F.lit(i).alias("ord"), F.lit(n).alias("step"), run.alias("run"), F.when(~run, why).alias("reason"))
        for i, (n, run, why) in enumerate(step_rules())
    ]
    return params.select(on, F.explode(F.array(*items)).alias("_s")).select(on, "_s.*")
