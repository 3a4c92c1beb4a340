"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct text: its SHA-256, the row that stays and counts.
It is bucketed and sorted by digest, so each new batch meets it in a sort-merge anti-join that
moves only the batch; what the index lacks is appended.  Texts themselves never enter the index.

Defined cases: a null text counts as empty; a null ``doc_id`` ranks below every other; rows that
repeat whole (same ``doc_id`` and text) share one decision, and :func:`deduplicate` keeps one of
them; an empty table gives an empty index; further columns pass through.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.common import attach, query, shuffle_partitions, table, unwrapped, wrapped
from skyframe.session import scratch_path

INDEX_COLUMNS = "digest string, keep_id bigint, keep_rows bigint, group_size bigint"


class DigestIndex:
    """A digest table in the catalog, bucketed and sorted by ``digest``."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or scratch_path(spark, "digest-index")
        self.buckets = buckets or shuffle_partitions(spark)
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], INDEX_COLUMNS), "overwrite")

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.write.mode(mode).format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> None:
        """Append the digests of ``rows`` (digest, doc_id) that the index does not hold yet."""
        copies = rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n"))
        groups = copies.groupBy("digest").agg(F.max(F.struct("doc_id", "n")).alias("top"), F.sum("n").alias("group_size"))
        fresh = groups.select("digest", F.col("top.doc_id").alias("keep_id"), F.col("top.n").alias("keep_rows"), "group_size")
        fresh = fresh.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        self._write(fresh.repartition(self.buckets, "digest"), "append")


def digested(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))


def decide(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` (doc_id, text, ...) with digest, keep_id, keep_rows, group_size and kept."""
    index = index or DigestIndex(docs.sparkSession)
    marked = digested(docs)
    index.add(marked.select("digest", "doc_id"))
    return attach(marked, index.read(), "digest", "group_size").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the same columns, whatever these are called.

    Of several rows with the id and the text that stay, the one of smallest hash of the whole row stays.
    """
    index = DigestIndex(docs.sparkSession)
    text = F.coalesce(F.col("_row").getField("text"), F.lit(""))
    rows = wrapped(docs).select("_row", F.col("_row").getField("doc_id").alias("doc_id"), F.sha2(text, 256).alias("digest"))
    index.add(rows.select("digest", "doc_id"))
    kept = attach(rows, index.read(), "digest", "group_size").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if index.read().where("keep_rows > 1").limit(1).count():
        whole = F.xxhash64(F.to_json("_row"))
        first = Window.partitionBy("digest").orderBy("_order")
        kept = kept.withColumn("_order", whole).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return unwrapped(kept, docs.columns)


SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""


@query("op8_exact_dedup", SQL)
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = digested(docs).select("doc_id", "digest")
    index = DigestIndex(spark)
    index.add(marked)
    out = attach(marked, index.read(), "digest", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
