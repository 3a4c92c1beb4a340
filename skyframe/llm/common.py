"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A key is hot from this share of all rows on; so at most this many keys are hot.
HOT_KEYS = 512


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with optional comparison SQL."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: str | Column) -> Column:
    """A-Z to lower case, everything else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Free memory of this worker, which serves later tasks and stages too, goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at the task's end its worker gives free memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def wrapped(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``_row``, so that no column of theirs meets one of an operator."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def unwrapped(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` left-joined with the one row that ``groups`` has per ``key``; no task gets a hot key.

    ``groups[size]`` holds how many of ``rows`` have the key.  Keys holding at least one in
    ``HOT_KEYS`` of all rows number at most ``HOT_KEYS``, so their groups are broadcast; rows of
    those keys get a spread key for the sort-merge join that serves all the others.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    others = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) >= max(32, -(-total // HOT_KEYS)))
    hot = hot.select(F.col(key).alias("_hot_key"), F.struct(*others).alias("_hot"))
    cold = groups.select(F.col(key).cast("string").alias("_cold_key"), F.struct(*others).alias("_cold"))
    marked = rows.join(F.broadcast(hot), rows[key] == F.col("_hot_key"), "left")
    spread = F.concat(F.lit("hot "), F.xxhash64(*[c for c, kind in rows.dtypes if "variant" not in kind and "map<" not in kind]).cast("string"))
    marked = marked.withColumn("_join", F.when(F.col("_hot_key").isNull(), F.col(key).cast("string")).otherwise(spread))
    joined = marked.join(cold.hint("merge"), F.col("_join") == F.col("_cold_key"), "left")
    got = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[got[c].alias(c) for c in others])
