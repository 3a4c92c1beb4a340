import numpy as np
import pandas as pd
import pytest
from conftest import to_array
from pyspark.sql import functions as F

from skyframe.functions import kernels as Kn
from skyframe.functions import math as M
from skyframe.functions.quantiles import group_quantiles, kth_largest, linear, lower, upper_median
from skyframe.functions.ranking import ranked
from skyframe.operators import components, stack
from skyframe.operators.overlap import map_overlap
from skyframe.operators.stencil import smooth


def test_quantiles_equal_numpy_with_a_hot_constant_group(spark):
    rng = np.random.default_rng(1)
    parts = {"a": rng.normal(0, 1, 999), "b": np.full(5000, 0.25), "c": np.array([3.0]), "d": np.r_[rng.lognormal(0, 4, 400), -rng.lognormal(0, 4, 401), 0, 0]}
    df = spark.createDataFrame(pd.DataFrame([(k, float(v)) for k, vs in parts.items() for v in vs], columns=["k", "v"]))
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", {"m": linear(0.5), "q": linear(0.9), "lo": lower(0.1), "up": upper_median(), "k3": kth_largest(3)}, "n").collect()}
    for k, vs in parts.items():
        s = np.sort(vs)
        assert got[k].n == len(s)
        assert got[k].m == pytest.approx(np.median(s), abs=1e-12)
        assert got[k].q == pytest.approx(np.quantile(s, 0.9), rel=1e-12)
        assert got[k].lo == s[int(0.1 * (len(s) - 1))] and got[k].up == s[len(s) // 2] and got[k].k3 == s[max(0, len(s) - 3)]


def test_rank_without_one_big_sort_matches_a_plain_sort(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"k": rng.integers(0, 3, 600), "v": np.round(rng.normal(size=600), 1), "id": np.arange(600)})
    p.loc[:200, ["k", "v"]] = 0, 0.5  # a third of all rows share one value of one group
    want = (p.sort_values(["v", "id"], ascending=[False, True]).groupby("k").cumcount() + 1).sort_index()
    for hot in (10**6, 5):
        got = ranked(spark.createDataFrame(p), ["k"], [("v", False), ("id", True)], hot_bin=hot).toPandas().set_index("id")["rank"]
        assert (got.sort_index() == want).all()


def test_midtones_golden_values(spark):
    one = spark.range(1)
    rows = one.select(M.mtf(0.25, F.lit(0.25)).alias("a"), M.mtf(0.5, F.lit(0.3)).alias("b"), M.mtf(0.2, F.lit(-1.0)).alias("c"), M.mtf(0.2, F.lit(2.0)).alias("d"),
                      M.mtf(M.midtones_balance(0.25, F.lit(0.1)), F.lit(0.1)).alias("e"), M.mtf(M.midtones_bisect(0.25, F.lit(0.1)), F.lit(0.1)).alias("f")).first()
    assert rows.a == pytest.approx(0.5, abs=1e-12) and rows.b == pytest.approx(0.3, abs=1e-12) and rows.c == 0 and rows.d == 1
    assert rows.e == pytest.approx(0.25, abs=1e-12) and rows.f == pytest.approx(0.25, abs=5e-5)


def test_clamp_keeps_null(spark):
    assert spark.range(1).select(M.clip(F.lit(None).cast("double")).alias("v")).first().v is None


def test_splines_pass_their_knots_and_stay_monotone():
    pieces = M.contrast_pieces(0.12, 0.15)
    for x0, _, *_, c0 in pieces:
        assert 0 <= c0 <= 1
    lut = np.array(M.curve_table([(0, 0), (0.3, 0.2), (0.6, 0.9), (1, 1)]))
    assert (np.diff(lut) >= -1e-9).all() and lut[0] == 0 and lut[-1] == 1


@pytest.mark.parametrize("mode,pad", [("nearest", "edge"), ("reflect", "symmetric"), ("mirror", "reflect"), ("wrap", "wrap")])
def test_tiles_with_halo_equal_the_whole_image(image, mode, pad):
    a = np.random.default_rng(3).random((75, 91))
    df = map_overlap(image(a), ["image_id"], ["v"], 2, lambda x, _: {"m": Kn.rank_filter(x["v"], 5, "median")}, ["m"], mode, tile=(16, 32))
    w = np.lib.stride_tricks.sliding_window_view(np.pad(a, 2, mode=pad), (5, 5)).reshape(75, 91, 25)
    assert np.allclose(to_array(df, "m"), np.median(w, axis=2))


def test_wide_gaussian_runs_per_axis_and_agrees(image):
    a = np.random.default_rng(4).random((60, 200))
    got = to_array(smooth(image(a), "v", 9.0), "v")
    t, r = Kn.gaussian_taps(9.0), Kn.gaussian_radius(9.0)
    p = np.pad(a, r, mode="symmetric")
    want = np.apply_along_axis(lambda q: np.convolve(q, t, "valid"), 0, p)
    want = np.apply_along_axis(lambda q: np.convolve(q, t, "valid"), 1, want)
    assert np.allclose(got, want)


def flood(mask):
    lab, seen = {}, set()
    for s in sorted(mask):
        if s in seen:
            continue
        todo = [s]
        seen.add(s)
        while todo:
            y, x = todo.pop()
            lab[(y, x)] = s[0] * components.ROW + s[1]
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    n = (y + dy, x + dx)
                    if n in mask and n not in seen:
                        seen.add(n)
                        todo.append(n)
    return lab


def test_components_across_tiles_equal_flood_fill(spark, monkeypatch):
    monkeypatch.setattr(components, "TILE", 8)
    rng = np.random.default_rng(5)
    m = rng.random((40, 50)) < 0.35
    m[3, :] = True  # one long snake over many tiles
    m[:, 7] = True
    pts = {(int(y), int(x)) for y, x in zip(*np.nonzero(m))}
    df = spark.createDataFrame([(0, y, x) for y, x in pts], "image_id long, y int, x int")
    got = {(r.y, r.x): r.label for r in components.label_components(df).collect()}
    assert got == flood(pts)


def cube(spark, arrays):
    rows = [(0, i, int(y), int(x), None if np.isnan(a[y, x]) else float(a[y, x])) for i, a in enumerate(arrays) for y in range(a.shape[0]) for x in range(a.shape[1])]
    px = spark.createDataFrame(rows, "target_id long, frame_id long, y int, x int, v double")
    return px, px.select("target_id", "frame_id").distinct()


def test_outlier_frame_is_clipped_and_reported(spark):
    rng = np.random.default_rng(6)
    arrays = [0.4 + rng.normal(0, 0.003, (6, 6)) for _ in range(12)] + [np.full((6, 6), 0.95)]
    px, fr = cube(spark, arrays)
    p = stack.integrate(px, fr).toPandas()
    assert np.allclose(p.mean_v, 0.4, atol=0.01) and (p.coverage == 13).all() and (p.transient_frame == 12).all() and (p.transient_v > 0.5).all()


def test_gathered_and_distributed_integration_agree(spark):
    rng = np.random.default_rng(7)
    arrays = [0.4 + rng.normal(0, 0.01, (4, 5)) for _ in range(15)]
    arrays[3][:2] = 0.9
    arrays[5][1, 1] = np.nan
    for a in arrays:
        a[3, 3] = np.nan
    px, fr = cube(spark, arrays)
    px = px.withColumn("w", F.col("frame_id") + 1.0).withColumn("wh", F.lit(2.0))
    cols = ["mean_v", "mean_hi_v", "transient_v", "coverage", "kept", "noise", "transient_frame"]
    a = stack.integrate(px, fr, weight="w", weight_hi="wh").toPandas().sort_values(["y", "x"])[cols].to_numpy(float)
    b = stack.integrate(px, fr, weight="w", weight_hi="wh", gather_limit=3).toPandas().sort_values(["y", "x"])[cols].to_numpy(float)
    assert np.allclose(a, b, equal_nan=True, atol=1e-12)


def test_two_weightings_of_one_rejection(spark):
    px, fr = cube(spark, [np.full((2, 2), 0.2), np.full((2, 2), 0.4)])
    px = px.withColumn("w", F.lit(1.0)).withColumn("wh", F.when(F.col("frame_id") == 0, 1.0).otherwise(0.0))
    r = stack.integrate(px, fr, weight="w", weight_hi="wh").first()
    assert r.mean_v == pytest.approx(0.3) and r.mean_hi_v == pytest.approx(0.2)


def test_single_calibration_frame_is_its_own_master(spark):
    px, fr = cube(spark, [np.array([[1.7, -0.2]])])
    assert sorted(r.v for r in stack.calibration_master(px, fr).collect()) == [-0.2, 1.7]
