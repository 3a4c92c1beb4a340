"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Every document has a 32-bit hash of its id.  Words are summed by source and leading hash bits; the
bucket in which a source's budget ends is the only one that is summed again by its next bits, down
to single hash values.  The result is one nested set of thresholds per source: documents below the
threshold are taken once more than the rest.  Nothing is sorted by document, and the decision for
a document needs only its own hash and its source's threshold.

Defined cases: null text has size 0; a null source is a source of its own, ordered last; rows with
one id share one decision; a source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.common import query, table, unwrapped, wrapped
from skyframe.session import cut

#: Hash bits resolved by each level of the histogram; together all 32.
LEVELS = (11, 11, 10)
#: Copies of a source's plan row in the salted join, used only where the plan is too large to broadcast.
SALTS = 16


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def id_hash(c: str = "doc_id") -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, share: float = 1.0) -> DataFrame:
    """(source, source_size, target): budgets by weight, none above ``most`` times its source.

    The excess of capped sources flows to the others by weight until none is above its cap.  That
    is one common level, found on running sums in order of cap by weight.  One row per source: the
    two windows see the configured sources, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("w").over(rest)
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") < F.col("cap"))
    # the first source below its cap fixes the level of all that follow
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(whole)
    return per.select("source", "source_size", F.when(F.col("free"), first * F.col("w")).otherwise(F.col("cap").cast("double")).alias("target"))


def _spread(plan: DataFrame) -> DataFrame:
    """The plan under a second key, so that no source meets in one task where the plan is shuffled."""
    return plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "_s")


def _meets(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, h, ...) with the plan row of their source.

    The plan is a written table of one row per source, so Spark broadcasts it only while its size
    on disk allows that, and else shuffles on (source, salt).
    """
    salt = F.pmod("h", F.lit(SALTS))
    return rows.join(_spread(plan), F.col("source").eqNullSafe(F.col("_s")) & (salt == F.col("_salt"))).drop("_s", "_salt")


def thresholds(sizes: DataFrame, weights: tuple[int, ...], most: int, share: float) -> DataFrame:
    """(source, source_size, target, rounds, threshold): whole rounds and the hash bound of one more."""
    targets = source_targets(sizes, weights, most, share)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.withColumn("rounds", rounds).withColumns({"left": F.col("target") - F.col("rounds") * F.col("source_size"), "prefix": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    plan, open_bits = cut(plan), 32
    for bits in LEVELS:
        inside = _meets(sizes, plan.select("source", "prefix")).where(F.shiftright("h", open_bits) == F.col("prefix")) if open_bits < 32 else sizes
        open_bits -= bits
        bucket = inside.groupBy("source", F.shiftright("h", open_bits).alias("b")).agg(F.sum("size").alias("n"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy("b")) - F.col("n")
        bucket = bucket.withColumn("before", before).withColumnRenamed("source", "_s")
        same = F.col("source").eqNullSafe(F.col("_s"))
        edge = plan.select("source", "left").join(bucket, same & (F.col("before") <= F.col("left")))
        edge = edge.groupBy("source").agg(F.max_by(F.struct("b", "before", "n"), "b").alias("e")).withColumnRenamed("source", "_s")
        plan = cut(plan.join(edge, same, "left").select(
            "source", "source_size", "target", "rounds", (F.col("left") - F.coalesce("e.before", F.lit(0))).alias("left"),
            F.coalesce("e.b", F.lit(0)).alias("prefix"), F.coalesce("e.n", F.lit(0)).alias("n"),
        ))
    # the last hash value is taken where that comes nearer to the target
    return plan.select("source", "source_size", "target", "rounds", (F.col("prefix") + F.when(2 * F.col("left") >= F.col("n"), 1).otherwise(0)).alias("threshold"))


def _times() -> Column:
    return F.col("rounds") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, share: float = 1.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, times) for every row of ``docs``."""
    sizes = cut(docs.select("doc_id", "source", words().alias("size"), id_hash().alias("h")))
    plan = cut(thresholds(sizes, weights, most, share))
    return _meets(sizes, plan).select("doc_id", "source", "size", "source_size", "target", _times().alias("times"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, share: float = 1.0) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its source's budget has it, same columns, whatever these are called."""
    sizes = cut(docs.select("doc_id", "source", words().alias("size"), id_hash().alias("h")))
    plan = cut(thresholds(sizes, weights, most, share)).select(F.col("source").alias("_source"), "rounds", "threshold")
    inner = plan.withColumnRenamed("_source", "source")
    rows = wrapped(docs).select("_row", F.col("_row").getField("source").alias("source"), F.col("_row").getField("doc_id").alias("doc_id")).withColumn("h", id_hash())
    taken = _meets(rows, inner).withColumn("_times", _times()).where("_times > 0")
    return unwrapped(taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))), docs.columns)


SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as h from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
ranked as (select *, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w from per),
caps as (select *, source_size * 3 as cap from ranked),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
            / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from caps),
common as (select min_by(level, (cap / w, source)) as level from levels where level * w < cap),
plan as (
  select l.source, source_size, case when l.level * w < cap then (select level from common) * w else cap::double end as target from levels l),
rounds as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as rounds from plan),
cum as (
  select d.source, h, sum(size) as n, sum(sum(size)) over (partition by d.source order by h) - sum(size) as before from d group by d.source, h),
edge as (
  select c.source, max(h) as h, max_by(n, h) as n, max_by(before, h) as before
  from cum c join rounds r on c.source is not distinct from r.source where before <= target - rounds * source_size group by c.source),
bound as (
  select r.source, source_size, target, rounds, e.h + case when 2 * (target - rounds * source_size - before) >= n then 1 else 0 end as threshold
  from rounds r left join edge e on r.source is not distinct from e.source)
select doc_id, size, source_size, target, (size * (rounds + case when h < threshold then 1 else 0 end))::bigint as taken
from d join bound b on d.source is not distinct from b.source
"""


@query("op10_mixing", SQL)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
