"""Neighbourhood operators: pixels are shuffled once into tiles that carry a halo.

A pixel goes to its own tile and to every tile whose halo it falls in, so the blow-up is
(1 + 2r/T)^2 with the tile edge T >= 2r, never the k^2 of an offset self-join.  Tasks pack the pixels
they hold into arrays by tile first, and one exchange moves the arrays.  The unit of work is one
bounded tile, so an image of any size spreads over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PAD = {"nearest": "edge", "reflect": "symmetric", "mirror": "reflect"}


def _edge(r: int) -> int:
    return max(64, 4 * r if r <= 128 else 2 * r)


def image_dims(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Height and width per image (map-side combined)."""
    return df.groupBy(*keys).agg(
        (F.max("y") + 1).cast("int").alias("_h"), (F.max("x") + 1).cast("int").alias("_w")
    )


def halo_tiles(df: DataFrame, keys, columns, radius, tile, mode="nearest", dims: DataFrame | None = None) -> DataFrame:
    """Rows sent to their tile (_ty, _tx) and to the tiles whose halo holds them, at (_vy, _vx)."""
    (ry, rx), (tall, wide) = radius, tile
    dims = image_dims(df, keys) if dims is None else dims
    src = df.select(*keys, "y", "x", *columns).join(dims, keys)
    if mode == "wrap":
        def virtual(c, n, r):
            return F.filter(
                F.array(F.col(c), F.col(c) + F.col(n), F.col(c) - F.col(n)),
                lambda p: (p >= -r) & (p < F.col(n) + r),
            )
        src = (
            src.withColumn("_vy", F.explode(virtual("y", "_h", ry)))
            .withColumn("_vx", F.explode(virtual("x", "_w", rx)))
        )
    else:
        src = src.withColumn("_vy", F.col("y")).withColumn("_vx", F.col("x"))

    def tiles(p, n, r, t):
        last = F.floor((F.col(n) - 1) / t)
        lo = F.greatest(F.floor((F.col(p) - r) / t), F.lit(0))
        hi = F.least(F.floor((F.col(p) + r) / t), last)
        return F.explode(F.sequence(lo, hi))

    src = src.withColumn("_ty", tiles("_vy", "_h", ry, tall)).withColumn("_tx", tiles("_vx", "_w", rx, wide))
    return src


#: Pixel rows that a task holds before it packs them; a worker's memory follows from it, not from its task's input.
PACK_ROWS = 1 << 16


def _axis(at: np.ndarray, p: np.ndarray, n: np.ndarray, r: int, t: int, wrap: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, tile): every row at its own place, or its images around the border, in every tile whose halo holds it."""
    if wrap:
        at, p, n = np.concatenate([at, at, at]), np.concatenate([p, p + n, p - n]), np.concatenate([n, n, n])
        near = (p >= -r) & (p < n + r)
        at, p, n = at[near], p[near], n[near]
    low, high = np.maximum((p - r) // t, 0), np.minimum((p + r) // t, (n - 1) // t)
    times = np.maximum(high - low + 1, 0)
    tile = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
    return np.repeat(at, times), np.repeat(p, times), tile


def pack_tiles(df: DataFrame, keys, columns, constants, radius, tile, mode="reflect", dims: DataFrame | None = None) -> DataFrame:
    """One row per tile and batch of pixels: (keys, _ty, _tx, _h, _w, constants, _vy, _vx, columns as arrays).

    Pixels are dealt to their tile and to those whose halo holds them before the shuffle, so that what moves
    and is sorted are a few rows of arrays, not a row per pixel.
    """
    (ry, rx), (tall, wide) = radius, tile
    keys, columns, constants = list(keys), list(columns), list(constants)
    dims = image_dims(df, keys) if dims is None else dims
    src = df.select(*keys, "y", "x", *columns, *[c for c in constants if c not in columns]).join(dims, keys)
    types = {f.name: f.dataType for f in src.schema.fields}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys] + [T.StructField(c, T.IntegerType()) for c in ("_ty", "_tx", "_h", "_w")] + [T.StructField(f"_k_{c}", types[c]) for c in constants]
        + [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("_vy", "_vx")] + [T.StructField(c, T.ArrayType(types[c])) for c in columns]
    )

    def packed(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        number = lambda c: t.column(c).to_numpy().astype(np.int64)
        y, x, h, w = (number(c) for c in ("y", "x", "_h", "_w"))
        wrap = mode == "wrap"
        at, vy, ty = _axis(np.arange(len(y)), y, h, ry, tall, wrap)
        back, vx, tx = _axis(np.arange(len(at)), x[at], w[at], rx, wide, wrap)
        at, vy, ty = at[back], vy[back], ty[back]
        code = np.zeros(t.num_rows, np.int64)
        for k in keys:
            own = t.column(k).combine_chunks().dictionary_encode()
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            code = np.unique(code * (len(own.dictionary) + 1) + own.indices.fill_null(len(own.dictionary)).to_numpy(), return_inverse=True)[1]
        # one number by image and tile, in their order: a single stable sort
        down, across = int(ty.max(initial=0)) + 1, int(tx.max(initial=0)) + 1
        place = (code[at] * down + ty) * across + tx
        order = np.argsort(place, kind="stable")
        at, vy, ty, vx, tx, place = at[order], vy[order], ty[order], vx[order], tx[order], place[order]
        new = np.ones(len(at), bool)
        new[1:] = place[1:] != place[:-1]
        heads = np.flatnonzero(new)
        offsets = pa.array(np.append(heads, len(at)).astype(np.int32))
        first, rows = pa.array(at[heads]), pa.array(at)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (vy, vx)]
        lists += [pa.ListArray.from_arrays(offsets, t.column(c).take(rows).combine_chunks()) for c in columns]
        plain = [t.column(k).take(first).combine_chunks() for k in keys]
        plain += [pa.array(v[heads].astype(np.int32)) for v in (ty, tx)] + [pa.array(v[at[heads]].astype(np.int32)) for v in (h, w)]
        plain += [t.column(c).take(first).combine_chunks() for c in constants]
        return pa.RecordBatch.from_arrays([*plain, *lists], schema.names)

    def run(batches):
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACK_ROWS:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield packed(pa.Table.from_batches(held))

    return src.mapInArrow(run, schema)


def map_overlap(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    radius: int | tuple[int, int],
    kernel: Callable[[dict, dict], dict],
    outputs: Sequence[str],
    mode: str = "reflect",
    constants: Sequence[str] = (),
    carry: Sequence[str] = (),
    tile: tuple[int, int] | None = None,
    dims: DataFrame | None = None,
) -> DataFrame:
    """Apply ``kernel(arrays, constants) -> arrays`` on every tile with ``radius`` halo pixels.

    ``radius`` may be (rows, columns); a pass along one axis has no halo on the other.
    ``arrays`` holds one padded 2-D array per value column; results have the same shape and are
    cropped to the tile.  ``constants`` are per-image scalars, ``carry`` columns pass through.
    Null samples reach the kernel as NaN and NaN results become null.
    """
    keys, values, constants, carry = list(keys), list(values), list(constants), list(carry)
    ry, rx = (radius, radius) if isinstance(radius, int) else radius
    tall, wide = tile or (_edge(ry), _edge(rx))
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = list(dict.fromkeys([*values, *carry]))
    src = pack_tiles(df, keys, columns, constants, (ry, rx), (tall, wide), mode, dims)
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType())]
        + [T.StructField(c, types[c]) for c in carry]
        + [T.StructField(o, T.DoubleType()) for o in outputs]
    )
    pad_mode = _PAD.get(mode)

    def run(t: pa.Table) -> pa.Table:
        one = lambda c: t.column(c)[0].as_py()
        flat = lambda c: pa.concat_arrays([a.flatten() for a in t.column(c).chunks])
        ty, tx, h, w = (one(c) for c in ("_ty", "_tx", "_h", "_w"))
        y0, x0 = ty * tall, tx * wide
        y1, x1 = min(h, y0 + tall), min(w, x0 + wide)
        if mode == "wrap":
            ya, yb, xa, xb = y0 - ry, y1 + ry, x0 - rx, x1 + rx
        else:
            ya, yb, xa, xb = max(0, y0 - ry), min(h, y1 + ry), max(0, x0 - rx), min(w, x1 + rx)
        vy, vx = flat("_vy").to_numpy(), flat("_vx").to_numpy()
        yy, xx = vy - ya, vx - xa
        ok = (yy >= 0) & (xx >= 0) & (yy < yb - ya) & (xx < xb - xa)
        cells = {c: flat(c) for c in columns}
        arrays = {}
        for c in values:
            a = np.full((yb - ya, xb - xa), np.nan)
            a[yy[ok], xx[ok]] = cells[c].to_numpy(zero_copy_only=False).astype(float)[ok]
            if pad_mode:
                a = np.pad(a, ((ya - y0 + ry, y1 + ry - yb), (xa - x0 + rx, x1 + rx - xb)), mode=pad_mode)
            arrays[c] = a
        consts = {c: one(f"_k_{c}") for c in constants}
        consts.update(top=y0 - ry, left=x0 - rx, height=h, width=w)
        with np.errstate(all="ignore"):
            res = kernel(arrays, consts)
        core = np.flatnonzero((vy >= y0) & (vy < y1) & (vx >= x0) & (vx < x1))
        iy, ix = vy[core] - y0 + ry, vx[core] - x0 + rx
        out = [pa.repeat(t.column(k)[0], len(core)) for k in keys]
        out += [pa.array(vy[core].astype(np.int32)), pa.array(vx[core].astype(np.int32))]
        out += [cells[c].take(pa.array(core)) for c in carry]
        shape = next(iter(arrays.values())).shape
        out += [pa.array(np.broadcast_to(res[o], shape)[iy, ix].astype(float), from_pandas=True) for o in outputs]
        return pa.Table.from_arrays(out, names=schema.names)

    return src.groupBy(*keys, "_ty", "_tx").applyInArrow(run, schema)
