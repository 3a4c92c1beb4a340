"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are mapped to the unit sphere of one more dimension so that the largest inner product is
the smallest distance.  Each table projects them on Gaussian directions and cuts every projection
into cells; a bucket is one combination of cells.  A query visits buckets in the order of their
estimated success, the squared distance of its projections to the bucket's cells, as far as a
radius that is fitted on a bounded sample.  Candidates of all tables are merged and reranked by
their exact inner products.

The first coordinates of a bucket are its shard.  Shards are the unit of work: their buckets meet
the queries whose probes reach them, in blocks of bounded size on both sides.  A query carries the
score of its 2k-th best neighbour in the sample, and blocks report only what is at least as good; a
query for which too few are found that way meets every entry once, in blocks, without that bound.

Equal vectors share one entry that holds their smallest ids; entries are indexed, searched and
reranked once and expanded at the end, so a vector of many rows costs no more than one.

Defined cases: vectors that are null, zero, hold null or non-finite components or have another
dimension than most take no part; null ids take no part; a table without valid vectors gives no
rows; with fewer candidates than k all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.common import query, table
from skyframe.session import cut

TABLES = 6
COORDINATES = 12
WIDTH = 2.5
#: Vectors of the sample on which the radius is fitted, queries tried on it and recall asked of it.
SAMPLE = 16_384
TRIED = 192
RECALL = 0.97
#: Blocks report what is as good as this many times k in the sample.
SPARE = 2
#: Aims for the size of a shard, and bounds of a block: index entries and queries.
SHARD = 2048
BLOCK = 4096
SEED = 11


def valid(c: str) -> Column:
    x = F.col(c)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dim)


@dataclass
class Hashing:
    """The tables' projections, and how vectors and queries are placed on the sphere."""

    dim: int
    longest: float
    entries: int
    radius: float = np.inf
    directions: np.ndarray = field(init=False)
    offsets: np.ndarray = field(init=False)

    def __post_init__(self):
        rng = np.random.default_rng(SEED)
        self.directions = rng.normal(size=(TABLES, self.dim + 1, COORDINATES))
        self.offsets = rng.uniform(0, 1, (TABLES, COORDINATES))
        self.shard_coordinates = int(np.clip(np.ceil(np.log2(max(1, self.entries / SHARD))), 0, COORDINATES))

    def index_side(self, x: np.ndarray) -> np.ndarray:
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])

    def query_side(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))])

    def project(self, placed: np.ndarray, t: int) -> np.ndarray:
        return placed @ self.directions[t] / WIDTH + self.offsets[t]

    def shard_key(self, t: int, cells: np.ndarray) -> np.ndarray:
        """A number for the table and the first cells; cells of unit vectors lie within +-16."""
        key = np.full(len(cells), t + 1, np.int64)
        for j in range(self.shard_coordinates):
            key = key * 32 + np.clip(cells[:, j] + 16, 0, 31)
        return key

    def reached_shards(self, projected: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, shard key) of every shard within the radius, by growing perturbations."""
        row, cost = np.arange(len(projected)), np.zeros(len(projected))
        cells = np.zeros((len(projected), 0), np.int64)
        for j in range(self.shard_coordinates):
            own = np.floor(projected[row, j])
            steps = np.arange(-12, 13)
            x = projected[row, j][:, None]
            low = own[:, None] + steps
            more = cost[:, None] + np.square(np.maximum(0, np.maximum(low - x, x - low - 1)))
            keep = more <= self.radius
            keep &= np.abs(low) < 16
            i, s = np.nonzero(keep)
            row, cost, cells = row[i], more[i, s], np.hstack([cells[i], low[i, s][:, None].astype(np.int64)])
        return row, self.shard_key(t, cells)


def probe_costs(projected: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Squared distance of each query's projections to each bucket's cells: small is likely."""
    cost = np.zeros((len(projected), len(buckets)))
    for j in range(buckets.shape[1]):
        x, low = projected[:, j : j + 1], buckets[None, :, j]
        cost += np.square(np.maximum(0, np.maximum(low - x, x - low - 1)))
    return cost


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Where a row's finite scores are among its k + 1 best, as far as rounding can tell."""
    good = np.isfinite(scores)
    if scores.shape[1] > k + 1:
        edge = -np.partition(-scores, k, axis=1)[:, k]
        good &= scores >= edge[:, None] - 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)))[:, None]
    return good


def fit_radius(h: Hashing, sample: np.ndarray, k: int) -> float:
    """The smallest radius that finds RECALL of the true neighbours of the tried queries."""
    tried = sample[:: max(1, len(sample) // TRIED)][:TRIED]
    own = np.arange(len(sample))[:: max(1, len(sample) // TRIED)][:TRIED]
    scores = tried @ sample.T
    scores[np.arange(len(tried)), own] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    best = np.full(near.shape, np.inf)
    placed, asked = h.index_side(sample), h.query_side(tried)
    for t in range(TABLES):
        cells, x = np.floor(h.project(placed, t)), h.project(asked, t)[:, None, :]
        low = cells[near]
        best = np.minimum(best, np.square(np.maximum(0, np.maximum(low - x, x - low - 1))).sum(axis=2))
    return float(np.quantile(best, RECALL)) + 1e-9


def entries_of(vectors: DataFrame, k: int) -> DataFrame:
    """(entry, ids, queries, embedding): one row per distinct vector with its k + 1 smallest ids."""
    rows = vectors.where(F.col("vec_id").isNotNull() & valid("embedding")).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    # the row_number filter runs before the shuffle as well, so a vector of many rows stays small
    first = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.dropDuplicates().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "ids", "embedding")


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by ``every``, the k nearest found."""
    spark = vectors.sparkSession
    entries = cut(entries_of(vectors, k))
    sizes = entries.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))).alias("longest"))
    most = sizes.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = most["dim"]
    entries = entries.where(F.size("embedding") == dim)
    h = Hashing(dim, most["longest"] * (1 + 1e-9), most["n"])
    drawn = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE).select("entry", "embedding").toArrow()
    sample = matrix(drawn.column("embedding").combine_chunks(), dim)
    sample_ids = np.asarray(drawn.column("entry"))
    h.radius = fit_radius(h, sample, k)

    # every query id, by entry; queries of one entry are asked once
    asked_ids = vectors.where(F.col("vec_id") % every == 0).where(valid("embedding")).select(F.col("vec_id").cast("bigint").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).distinct()
    known = entries.select("entry", "embedding")
    asked = cut(asked_ids.join(known, "embedding").select("query_id", "entry"))
    queries = entries.join(asked.select("entry").distinct(), "entry", "left_semi").select("entry", "embedding")

    def place_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            placed = h.index_side(matrix(batch.column(1), dim))
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(h.shard_key(t, np.floor(h.project(placed, t)).astype(np.int64))), *batch.columns], ["shard", "entry", "embedding"])

    index = cut(entries.select("entry", "embedding").mapInArrow(place_index, "shard bigint, entry bigint, embedding array<float>"))
    bound = (sample, sample_ids, SPARE * k) if len(sample) > SPARE * k else None
    named = cut(_named(_visit(queries, index, h, k, bound), entries, k))
    short = cut(queries.join(named.groupBy("query").count().where(F.col("count") > k).select(F.col("query").alias("entry")), "entry", "left_anti"))
    few = short.count()
    if few:
        # too few found within the radius: these queries meet every entry
        again = _named(_meet_all(short, few, entries, h, k), entries, k)
        named = named.join(short.select(F.col("entry").alias("query")), "query", "left_anti").unionByName(again)
    each = asked.withColumnRenamed("entry", "query").join(named, "query").where("query_id <> vec_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _visit(queries: DataFrame, index: DataFrame, h: Hashing, k: int, bound) -> DataFrame:
    """(query, entry, score): the best k + 1 entries of each query in the buckets within the radius.

    ``bound`` is (sample, its ids, rank): only what is as good as that rank of the sample is reported.
    """
    dim = h.dim

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                x = matrix(part.column(1), dim)
                least = np.full(len(x), -np.inf)
                if bound is not None:
                    sample, sample_ids, place = bound
                    scores = x @ sample.T
                    scores[np.asarray(part.column(0))[:, None] == sample_ids[None, :]] = -np.inf
                    least = -np.partition(-scores, place - 1, axis=1)[:, place - 1]
                    # a rounding error must not drop what the sample itself holds
                    least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
                placed = h.query_side(x)
                for t in range(TABLES):
                    row, key = h.reached_shards(h.project(placed, t), t)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(key), part.column(0).take(take), part.column(1).take(take), pa.array(least[row])], ["shard", "entry", "embedding", "least"])

    probes = cut(queries.mapInArrow(place_queries, "shard bigint, entry bigint, embedding array<float>, least double"))
    held = index.groupBy("shard").agg(F.count("*").alias("n"))
    want = probes.groupBy("shard").agg(F.count("*").alias("q"))
    blocks = cut(held.join(want, "shard").select("shard", F.ceil(F.col("n") / BLOCK).alias("parts"), F.ceil(F.col("q") / BLOCK).alias("asks")))
    spread = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    left = index.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("entry"), "parts").alias("part"), F.explode(spread("asks")).alias("ask"), "entry", "embedding")
    right = probes.join(blocks, "shard").select("shard", F.explode(spread("parts")).alias("part"), F.pmod(F.xxhash64("entry"), "asks").alias("ask"), "entry", "embedding", "least")

    def rerank(key, here: pa.Table, there: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "entry": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not here.num_rows or not there.num_rows:
            return empty
        t = key[0].as_py()
        while t > TABLES:
            t //= 32
        x, ids = matrix(here.column("embedding").combine_chunks(), dim), np.asarray(here.column("entry"))
        buckets, of = np.unique(np.floor(h.project(h.index_side(x), t - 1)), axis=0, return_inverse=True)
        of = of.ravel()
        q_all, q_ids, least = matrix(there.column("embedding").combine_chunks(), dim), np.asarray(there.column("entry")), np.asarray(there.column("least"))
        out = []
        for i in range(0, len(q_all), 512):
            q = q_all[i : i + 512]
            visited = probe_costs(h.project(h.query_side(q), t - 1), buckets) <= h.radius
            scores = np.where(visited[:, of], q @ x.T, -np.inf)
            a, b = np.nonzero((scores >= least[i : i + 512, None]) & best_of(scores, k))
            exact = (q[a] * x[b]).sum(axis=1)
            out.append((q_ids[i + a], ids[b], exact))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"query": cols[0], "entry": cols[1], "score": cols[2]})

    found = left.groupBy("shard", "part", "ask").cogroup(right.groupBy("shard", "part", "ask")).applyInArrow(rerank, "query bigint, entry bigint, score double")
    return _merged(found.groupBy("query", "entry").agg(F.max("score").alias("score")), k)


def _meet_all(queries: DataFrame, asked: int, entries: DataFrame, h: Hashing, k: int) -> DataFrame:
    """(query, entry, score): the exact best k + 1 entries of each of the ``asked`` queries, each pair scored once.

    Blocks are at most about BLOCK entries by BLOCK queries whatever the number of shards.
    """
    dim = h.dim
    parts, asks = -(-h.entries // BLOCK), -(-asked // BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = lambda n: F.pmod(F.xxhash64("entry"), F.lit(n).cast("long"))
    left = entries.select(own(parts).alias("part"), every(asks).alias("ask"), "entry", "embedding")
    right = queries.select(every(parts).alias("part"), own(asks).alias("ask"), "entry", "embedding")

    def score(here: pa.Table, there: pa.Table) -> pa.Table:
        x, ids = matrix(here.column("embedding").combine_chunks(), dim), np.asarray(here.column("entry"))
        q_all, q_ids = matrix(there.column("embedding").combine_chunks(), dim), np.asarray(there.column("entry"))
        out = [(q_ids[:0], ids[:0], np.zeros(0))]
        for i in range(0, len(q_all) if len(x) else 0, 512):
            q = q_all[i : i + 512]
            a, b = np.nonzero(best_of(q @ x.T, k))
            out.append((q_ids[i + a], ids[b], (q[a] * x[b]).sum(axis=1)))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.table({"query": cols[0], "entry": cols[1], "score": cols[2]})

    found = left.groupBy("part", "ask").cogroup(right.groupBy("part", "ask")).applyInArrow(score, "query bigint, entry bigint, score double")
    return _merged(found, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k + 1 entries of each query."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place")


def _named(merged: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score): the best k + 1 ids of each query entry, so one asked often stays small."""
    named = merged.join(entries.select("entry", "ids"), "entry").select("query", "score", F.explode("ids").alias("vec_id"))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("place", F.row_number().over(near)).where(F.col("place") <= k + 1).drop("place")


@query("op3_ann")
def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
