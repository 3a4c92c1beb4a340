"""8-connected components of sparse pixel masks, over images of any size."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyframe.session import cut

TILE = 256
ROW = 1 << 31  # a label is the smallest y * ROW + x of its component


def _local(pdf: pd.DataFrame) -> np.ndarray:
    """Smallest pixel id of each pixel's component inside one tile."""
    y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    y0, x0 = y.min(), x.min()
    none = np.iinfo(np.int64).max
    lab = np.full((int(y.max() - y0) + 3, int(x.max() - x0) + 3), none)
    iy, ix = (y - y0 + 1).astype(int), (x - x0 + 1).astype(int)
    lab[iy, ix] = y * ROW + x
    width = lab.shape[1]
    while True:
        best = lab[iy, ix]
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                best = np.minimum(best, lab[iy + dy, ix + dx])
        # jump to the label of the pixel a label names
        ry, rx = (best // ROW - y0 + 1).astype(int), (best % ROW - x0 + 1).astype(int)
        best = np.minimum(best, lab[ry, rx])
        if np.array_equal(best, lab[iy, ix]):
            return best
        lab[iy, ix] = best
        assert width == lab.shape[1]


def merge_labels(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root of every label in a graph of (keys, a, b) edges: neighbour minimum with pointer jumping."""
    keys = list(keys)
    both = cut(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = cut(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(lab.select(*keys, F.col("node").alias("b"), F.col("root").alias("_r")), [*keys, "b"]).groupBy(
            *keys, F.col("a").alias("node")
        ).agg(F.min("_r").alias("_m"))
        step = lab.join(near, [*keys, "node"]).select(*keys, "node", "root", F.least("root", "_m").alias("_n"))
        jump = lab.select(*keys, F.col("node").alias("_n"), F.col("root").alias("_j"))
        new = cut(step.join(jump, [*keys, "_n"], "left").select(*keys, "node", F.col("root").alias("_old"), F.least("_n", F.coalesce("_j", F.col("_n"))).alias("root")))
        moved = new.filter(F.col("root") != F.col("_old")).limit(1).count()
        lab = new.drop("_old")
        if not moved:
            return lab


def label_components(mask: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Component label of every mask pixel (keys, y, x).

    Tiles are labelled independently; only pixels along tile borders take part in the merge, so the
    iterative part works on a graph far smaller than the mask.
    """
    keys = list(keys)
    types = {f.name: f.dataType for f in mask.schema.fields}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("label", T.LongType())]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*keys, "y", "x"]].copy()
        out["label"] = _local(pdf)
        return out

    tiled = mask.select(*keys, "y", "x", F.floor(F.col("y") / TILE).alias("_ty"), F.floor(F.col("x") / TILE).alias("_tx"))
    local = cut(tiled.groupBy(*keys, "_ty", "_tx").applyInPandas(run, schema))
    edge = (F.col("y") % TILE).isin(0, TILE - 1) | (F.col("x") % TILE).isin(0, TILE - 1)
    rim = local.filter(edge)
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) > (0, 0)])
    probe = rim.withColumn("_o", F.explode(around)).select(
        *keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), F.col("label").alias("a")
    )
    links = probe.join(rim.select(*keys, "y", "x", F.col("label").alias("b")), [*keys, "y", "x"]).filter("a <> b").select(*keys, "a", "b").distinct()
    links = cut(links)
    if links.isEmpty():
        return local
    roots = merge_labels(links, keys).select(*keys, F.col("node").alias("label"), "root")
    return local.join(roots, [*keys, "label"], "left").select(*keys, "y", "x", F.coalesce("root", "label").alias("label"))
