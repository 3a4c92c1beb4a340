"""Frame quality: culling, the reference frame, burst gates and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyframe.functions.quantiles import attach, group_mads, group_quantiles, upper_median
from skyframe.functions.ranking import ranked, top_k
from skyframe.session import cut


def cull(measures: DataFrame, keys=("session_id",), ecc_hard=0.72, fwhm_mads=3.0, bg_mads=6.0, max_frac=0.30, amplified=False, worst_first=False) -> DataFrame:
    """Keep or reject every frame of a session with one named reason, and pick its reference.

    The cap keeps at most floor(30 %) of the measured frames rejected.  By default the *least* bad
    soft rejects stay rejected (ascending by eccentricity and width), as the measured behaviour has
    it; ``worst_first`` ranks them the other way.
    """
    keys = list(keys)
    seen = measures.filter(F.col("stars") > 0)
    n = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    stats = cut(group_mads(seen, keys, {"fwhm": ("_fd", "_fm"), "bg": ("_bd", "_bm")}).join(n, keys))
    d = measures.join(stats, keys, "left")
    fwhm_bad = F.col("fwhm") > F.col("_fm") + fwhm_mads * (1.4826 * F.col("_fd") + 1e-12)
    bg_bad = F.col("bg") > F.col("_bm") + bg_mads * (1.4826 * F.col("_bd") + 1e-12)
    soft = F.when(F.col("ecc") > ecc_hard, "trailed")
    noted = F.when(F.col("ecc") > ecc_hard, F.lit(None).cast("string"))
    if amplified:
        noted = noted.when(fwhm_bad, "bloated").when(bg_bad, "background surge")
    else:
        soft = soft.when(fwhm_bad, "bloated").when(bg_bad, "background surge")
        noted = F.lit(None).cast("string")
    measured = F.col("stars") > 0
    d = d.withColumn("_soft", F.when(measured, soft)).withColumn("soft_kept", F.when(measured, noted))
    order = [("ecc", not worst_first), ("fwhm", not worst_first), ("frame_id", True)]
    rejected = ranked(d.filter(F.col("_soft").isNotNull()), keys, order, "_rk").filter(F.col("_rk") <= F.floor(F.col("_n") * max_frac))
    d = d.join(rejected.select(*keys, "frame_id", F.lit(True).alias("_cut")).hint("merge"), [*keys, "frame_id"], "left")
    reason = F.when(~measured, "no stars").when(F.col("_cut"), F.col("_soft"))
    d = d.withColumn("reason", reason)
    # a session with nothing measured keeps every frame and starts from its first
    keep = F.col("_n").isNull() | (measured & F.col("_cut").isNull())
    d = d.withColumn("_keep", keep)
    ref = d.filter(keep).groupBy(*keys).agg(
        F.min(
            F.struct(
                F.when(F.col("_n").isNull(), F.lit(0.0)).otherwise(F.abs(F.col("fwhm") - F.col("_fm"))).alias("d"),
                F.when(F.col("_n").isNotNull(), F.col("bg")).alias("bg"),
                F.when(F.col("_n").isNotNull(), F.col("ecc")).alias("ecc"),
                F.col("frame_id"),
            )
        ).alias("_r")
    ).select(*keys, F.col("_r.frame_id").alias("_ref"))
    return attach(d, ref, keys, "left").select(
        *keys, "frame_id", F.when(F.col("_keep"), "keep").otherwise("reject").alias("status"), "reason", "soft_kept",
        F.coalesce(F.col("frame_id") == F.col("_ref"), F.lit(False)).alias("is_reference"),
    )


def keep_sharpest(graded: DataFrame, keep=0.5, keys=("burst_id",), score="sharp") -> DataFrame:
    """The max(2, round(n keep)) sharpest frames (half-even), ranked."""
    keys = list(keys)
    n = graded.groupBy(*keys).agg(F.greatest(F.lit(2), F.rint(F.count(F.lit(1)) * keep)).cast("long").alias("_k"))
    r = ranked(attach(graded, n, keys), keys, [(score, False), ("frame_id", True)])
    return r.filter(F.col("rank") <= F.col("_k")).drop("_k")


def junk_gate(graded: DataFrame, keys=("burst_id",), value="p999") -> DataFrame:
    """Drop frames without a disc: far under the burst's upper-median brightness."""
    keys = list(keys)
    med = group_quantiles(graded, keys, value, {"_med": upper_median()})
    v = F.col(value)
    dark = (v < 0.15 * F.col("_med")) | ((v < 0.02) & (v < 0.5 * F.col("_med")))
    return attach(graded, med, keys).filter(~dark).drop("_med")


def rescue_reference(offsets: DataFrame, keys=("burst_id",), max_drift=220.0, cluster=60.0, share=0.6) -> DataFrame:
    """New reference per burst when most frames drifted: first frame of the consensus cluster.

    ``offsets`` has one row per kept frame after the old reference: frame_id, rank, dx, dy.
    """
    keys = list(keys)
    d = offsets.withColumn("_out", F.hypot("dx", "dy") > max_drift)
    n = d.groupBy(*keys).agg(F.count(F.when(F.col("_out"), 1)).alias("_ne"), F.count(F.when(~F.col("_out"), 1)).alias("_ns"))
    many = n.filter((F.col("_ne") >= 2) & (F.col("_ne") > F.col("_ns")))
    e = cut(d.filter("_out").join(many, keys))
    q = group_quantiles(e, keys, "dx", {"_mx": upper_median()}).join(group_quantiles(e, keys, "dy", {"_my": upper_median()}), keys)
    near = attach(e, q, keys).withColumn("_near", F.hypot(F.col("dx") - F.col("_mx"), F.col("dy") - F.col("_my")) < cluster)
    return (
        near.groupBy(*keys)
        .agg(
            F.count(F.when(F.col("_near"), 1)).alias("n_cluster"), F.max("_ne").alias("n_excluded"),
            F.min(F.when(F.col("_near"), F.struct("rank", "frame_id"))).alias("_f"),
        )
        .filter((F.col("n_cluster") >= share * F.col("n_excluded")) & (F.col("n_cluster") > 0))
        .select(*keys, "n_excluded", "n_cluster", F.col("_f.frame_id").alias("frame_id"))
    )


def field_spread(offsets: DataFrame, keys=("burst_id",), frame="frame_id") -> DataFrame:
    """Spread of the alignment-point offsets per frame (more than three points), then mean and max."""
    per = offsets.groupBy(*keys, frame).agg(
        F.sqrt(F.var_pop("dx") + F.var_pop("dy")).alias("s"), F.count(F.lit(1)).alias("n")
    ).filter("n > 3")
    return per.groupBy(*keys).agg(F.avg("s").alias("spread_mean"), F.max("s").alias("spread_max"), F.count(F.lit(1)).alias("n_frames"))


def best_per_point(meas: DataFrame, keep=0.5, search=8.0, keys=("ap_id",)) -> DataFrame:
    """Per alignment point the max(3, round(n keep)) best frames among offsets within the search radius."""
    keys = list(keys)
    near = meas.filter(F.hypot("dx", "dy") <= search)
    n = near.groupBy(*keys).agg(F.greatest(F.lit(3), F.rint(F.count(F.lit(1)) * keep)).cast("long").alias("_k"))
    r = ranked(attach(near, n, keys), keys, [("q", False), ("frame_id", True)])
    return r.filter(F.col("rank") <= F.col("_k")).drop("_k")


def evenly_spaced(frames: DataFrame, cap=9, keys=("session_id",)) -> DataFrame:
    """At most ``cap`` probes, every max(1, n div cap)-th frame."""
    keys = list(keys)
    n = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / cap))
    r = ranked(attach(frames, n, keys), keys, [("frame_id", True)]).withColumn("_i", F.col("rank") - 1)
    return r.filter((F.col("_i") % step == 0) & (F.col("_i") / step < cap)).drop("_n", "_i", "rank")


def evict(history: DataFrame, cap=20, keys=("master_id",)) -> DataFrame:
    """What stays in a capped history: protected (rated or selected) items first, newest first."""
    safe = (F.col("rating") != 0) | (F.col("status") == "selected")
    return top_k(history, list(keys), [safe.desc(), F.col("item_id").desc()], cap).drop("rank")


def edit_history(history: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply (item_id, rating, status, drop) edits: rating clamped to 0-5, unknown status ignored."""
    e = edits.select("master_id", "item_id", F.col("rating").alias("_r"), F.col("status").alias("_s"), F.col("drop").alias("_d"))
    status = F.when(F.col("_s").isin("none", "selected", "discarded"), F.col("_s"))
    return (
        history.join(e, ["master_id", "item_id"], "left").filter(~F.coalesce("_d", F.lit(False)))
        .withColumn("rating", F.coalesce(F.when(F.col("_r").isNotNull(), F.least(F.greatest("_r", F.lit(0)), F.lit(5))), F.col("rating")))
        .withColumn("status", F.coalesce(status, F.col("status"))).drop("_r", "_s", "_d")
    )


