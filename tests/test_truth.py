"""Planted-truth checks of the operators that have no SQL twin."""

import json

import numpy as np
import pandas as pd
import pytest
from conftest import to_array
from pyspark.sql import functions as F

from skyframe.functions import kernels as Kn
from skyframe.functions.lookups import load_lookup
from skyframe.operators import burst as B
from skyframe.operators import quality as Q
from skyframe.operators import registry as G
from skyframe.operators import scene as N
from skyframe.operators import stars as S
from skyframe.operators import surface as U
from skyframe.operators import trails as R


def rgb(image, r, g=None, b=None):
    g, b = r if g is None else g, r if b is None else b
    on = ["image_id", "y", "x"]
    return image(r, name="r").join(image(g, name="g"), on).join(image(b, name="b"), on)


def gauss_star(shape, y, x, amp, s=2.0):
    yy, xx = np.mgrid[0 : shape[0], 0 : shape[1]]
    return amp * np.exp(-((yy - y) ** 2 + (xx - x) ** 2) / (2 * s * s))


def test_suppression_equals_the_sequential_greedy_pass(spark):
    rng = np.random.default_rng(1)
    p = pd.DataFrame({"image_id": np.int64(0), "y": rng.integers(0, 60, 150), "x": rng.integers(0, 60, 150), "flux": np.round(rng.random(150), 2)}).drop_duplicates(["y", "x"])
    kept = []
    for _, s in p.sort_values(["flux", "y", "x"], ascending=[False, True, True]).iterrows():
        if all((s.y - k[0]) ** 2 + (s.x - k[1]) ** 2 >= 49 for k in kept):
            kept.append((int(s.y), int(s.x)))
    sep = spark.createDataFrame([(0, 7.0)], "image_id long, sep double")
    got = S.suppress_close(spark.createDataFrame(p), sep).select("y", "x").collect()
    assert {(r.y, r.x) for r in got} == set(kept)


def test_streak_is_kept_and_blob_is_not(spark):
    rng = np.random.default_rng(2)
    v, f = np.abs(rng.normal(0, 0.0005, (150, 210))), np.full((150, 210), -1)
    for i in range(80):
        v[30 + i // 2, 40 + i] = 0.3
        f[30 + i // 2, 40 + i] = 3
    v[100:104, 100:104], f[100:104, 100:104] = 0.4, 5
    y, x = np.mgrid[0:150, 0:210]
    p = pd.DataFrame({"target_id": np.int64(1), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": v.ravel(), "frame": f.ravel().astype("int64")})
    df = spark.createDataFrame(p).withColumn("frame", F.when(F.col("frame") >= 0, F.col("frame")))
    trails, px = R.detect_trails(df)
    t = trails.collect()
    assert len(t) == 1 and t[0].frame == 3 and t[0].aspect > 3 and t[0].length > 40 and t[0].single_frame_frac == 1.0
    lay = R.trail_layer(df, px)
    assert lay.filter("y between 100 and 103 and x between 100 and 103").agg(F.max("v")).first()[0] < 1e-6
    dev = R.taper(R.develop_trails(lay))
    assert dev.agg(F.max("v")).first()[0] > 0.4


def test_ring_is_found_and_subtracted(spark, image):
    yy, xx = np.mgrid[0:320, 0:320]
    d = np.hypot(yy - 160, xx - 160)
    a = 0.1 + np.where((d > 70) & (d < 95), 0.05, 0.0) + gauss_star((320, 320), 160, 160, 0.6, 3)
    df = rgb(image, a)
    stars = spark.createDataFrame([(0, 160, 160, 1)], "image_id long, y int, x int, star_id int")
    ring = S.halo_rings(df, stars, 140).collect()
    assert len(ring) == 1 and 65 < ring[0].r1 < 80 and abs(ring[0].amp - 0.05) < 0.01
    out = to_array(S.halo_tamer(df, stars, 140), "r")
    assert abs(np.median(out[(d > 80) & (d < 86)]) - 0.1) < 0.02


def test_colour_offsets_shrink_below_a_third(image):
    rng = np.random.default_rng(3)
    shape, r, g, b = (220, 220), np.full((220, 220), 0.02), np.full((220, 220), 0.02), np.full((220, 220), 0.02)
    for _ in range(60):
        y, x = rng.uniform(15, 205, 2)
        sc = 0.012
        amp = rng.uniform(0.3, 0.6)
        r += gauss_star(shape, y + (y - 110) * sc, x + (x - 110) * sc, amp)
        g += gauss_star(shape, y + (y - 110) * sc / 2, x + (x - 110) * sc / 2, amp)
        b += gauss_star(shape, y, x, amp)
    df = rgb(image, r, g, b)

    def size(d):
        m = S.measure_offsets(d, S.seed_stars(d)).toPandas()
        return np.median(np.hypot(m.dy_r, m.dx_r))

    before = size(df)
    assert before > 0.3 and size(S.correct_offsets(df)) < 0.3 * before


def test_shift_of_a_disc_is_recovered(spark):
    yy, xx = np.mgrid[0:96, 0:96]
    rows = []
    for i, (dy, dx) in enumerate([(0, 0), (2.3, -1.6), (-4.4, 3.2)]):
        d = np.hypot(yy - 48 - dy, xx - 46 - dx)
        img = np.clip((26 - d) / 3, 0, 1) * (0.6 + 0.2 * np.sin((yy - dy) / 3) * np.cos((xx - dx) / 4)) + 0.01
        rows.append(pd.DataFrame({"target_id": np.int64(0), "frame_id": np.int64(i), "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "v": img.ravel()}))
    px = spark.createDataFrame(pd.concat(rows))
    ref = spark.createDataFrame([(0, 0)], "target_id long, frame_id long")
    got = {r.frame_id: (r.dy, r.dx) for r in B.register_burst(px, ref).collect()}
    for i, (dy, dx) in enumerate([(0, 0), (2.3, -1.6), (-4.4, 3.2)]):
        assert abs(got[i][0] - dy) < 0.4 and abs(got[i][1] - dx) < 0.4


def test_far_and_mixed_shifts_are_recovered(spark):
    """A disc moved 130 px, and a small target beside a large one: each has its own pyramid."""
    rows = []
    for target, size, moves in ((0, 400, [(0, 0), (6.0, 130.0)]), (1, 48, [(0, 0), (3.0, -5.0)])):
        yy, xx = np.mgrid[0:size, 0:size]
        for i, (dy, dx) in enumerate(moves):
            d = np.hypot(yy - size * 0.5 - dy, xx - size * 0.32 - dx)
            img = np.clip((size * 0.14 - d) / 3, 0, 1) * (0.6 + 0.2 * np.sin((yy - dy) / 3) * np.cos((xx - dx) / 4)) + 0.01
            rows.append(pd.DataFrame({"target_id": np.int64(target), "frame_id": np.int64(i), "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "v": img.ravel()}))
    px = spark.createDataFrame(pd.concat(rows))
    ref = spark.createDataFrame([(0, 0), (1, 0)], "target_id long, frame_id long")
    got = {(r.target_id, r.frame_id): r for r in B.register_burst(px, ref, max_drift=100.0).collect()}
    assert abs(got[0, 1].dy - 6) < 0.6 and abs(got[0, 1].dx - 130) < 0.6 and got[0, 1].excluded
    assert abs(got[1, 1].dy - 3) < 0.6 and abs(got[1, 1].dx + 5) < 0.6 and not got[1, 1].excluded


def test_local_normalisation_does_not_depend_on_neighbours_in_the_batch(spark):
    rng = np.random.default_rng(8)

    def frame(target, i, size, tilt):
        yy, xx = np.mgrid[0:size, 0:size]
        v = 0.3 + tilt * xx / size + rng.normal(0, 0.002, (size, size))
        return pd.DataFrame({"target_id": np.int64(target), "frame_id": np.int64(i), "y": yy.ravel().astype("int32"), "x": xx.ravel().astype("int32"), "v": v.ravel()})

    small, large = [frame(0, 0, 40, 0.0), frame(0, 1, 40, 0.1)], [frame(1, 0, 90, 0.0), frame(1, 1, 90, 0.1)]
    ref = spark.createDataFrame([(0, 0), (1, 0)], "target_id long, frame_id long")
    run = lambda parts: {(r.frame_id, r.y, r.x): r.v for r in B.local_normalize(spark.createDataFrame(pd.concat(parts)), ref, target=32).filter("target_id = 0").collect()}
    alone, mixed = run(small), run(small + large)
    assert alone.keys() == mixed.keys() and max(abs(alone[k] - mixed[k]) for k in alone) < 1e-9


def test_recipes_keep_every_value(spark):
    from skyframe.operators import rules

    rows = [(1, "satAdj", "0.3"), (1, "doHDR", "true"), (1, "objectClass", "galaxy"), (1, "palette", 'a "b"\\c'), (2, "deepen", "1.0"), (2, "removeStars", "false")]
    again = rules.apply_recipes(rules.save_recipes(spark.createDataFrame(rows, "image_id long, key string, value string")))
    assert sorted(map(tuple, again.collect())) == sorted(rows)
    odd = [(1, '{"recipe":1,"":5,"satAdj":9,"zzz":1}'), (2, '{"satAdj":0.1}'), (3, "[1]"), (4, "{bad"), (5, None), (6, '{"recipe":"1","satAdj":0.1}'), (7, '{"recipe":1,"satAdj":true,"doHDR":1}')]
    got = rules.apply_recipes(spark.createDataFrame(odd, "image_id long, j string")).collect()
    assert sorted(map(tuple, got)) == [(1, "satAdj", "0.5")]


def test_noise_model_slope_within_a_factor_of_two(spark):
    rng = np.random.default_rng(4)
    signal = np.tile(np.linspace(0.05, 0.8, 256), (64, 1))
    y, x = np.mgrid[0:64, 0:256]
    px = pd.concat([pd.DataFrame({"target_id": np.int64(0), "frame_id": np.int64(i), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": (signal + rng.normal(size=signal.shape) * np.sqrt(4e-5 * signal + 4e-8)).ravel()}) for i in range(16)])
    df = spark.createDataFrame(px)
    r = B.photon_transfer(df, df.select("target_id", "frame_id").distinct()).first()
    assert 2e-5 < r.a < 8e-5
    assert B.chi2_quantile(0.5, 4) == pytest.approx(3.3566940, abs=1e-5)


def test_surfaces_remove_a_tilt(image):
    rng = np.random.default_rng(5)
    yy, xx = np.mgrid[0:150, 0:240]
    a = 0.2 + 0.2 * xx / 240 + 0.1 * yy / 150 + rng.normal(0, 0.003, (150, 240))
    a[40:44, 60:64] = 0.95
    df = rgb(image, a)
    spread = lambda d: np.ptp(np.median(to_array(d, "r"), axis=0))
    assert spread(U.background_extract(df, grid=16)) < 0.03
    assert spread(U.gradient_cleanup(df, 1.0)) < 0.03


def test_dark_lane_model_removes_a_tilt(image):
    rng = np.random.default_rng(15)
    yy, xx = np.mgrid[0:250, 0:400]
    a = 0.2 + 0.2 * xx / 400 + 0.1 * yy / 250 + rng.normal(0, 0.003, (250, 400))
    df = rgb(image, a)
    assert U.dark_lane_model(df).count() == 3
    assert np.ptp(np.median(to_array(U.dark_lane_gradient(df), "r"), axis=0)) < 0.03


def test_horizon_side_and_mask(image):
    rng = np.random.default_rng(6)
    a = np.where(np.arange(120)[:, None] > 70, 0.5 + 0.3 * rng.random((120, 160)), 0.02 + 0.002 * rng.random((120, 160)))
    r = N.segment_sky(image(a))
    w = to_array(r, "w")
    first = r.first()
    assert first.axis == "horizontal" and first.sky_side == "top" and w[:60].mean() > 0.9 and w[85:].mean() < 0.1


def test_retention_equals_adding_one_by_one(spark):
    rng = np.random.default_rng(7)
    items = [(0, i, int(rng.random() < 0.4) * 3, "selected" if rng.random() < 0.2 else "none") for i in range(60)]
    state = []
    for it in items:
        state.append(it)
        while len(state) > 20:
            state.remove(next((s for s in state if s[2] == 0 and s[3] != "selected"), state[0]))
    got = Q.evict(spark.createDataFrame(items, "master_id long, item_id long, rating int, status string")).collect()
    assert {r.item_id for r in got} == {s[1] for s in state}


def test_nothing_measured_keeps_every_frame(spark):
    rows = [(0, i, 0, 2.0, 0.1, 0.1, 0.01) for i in range(3)]
    m = spark.createDataFrame(rows, "session_id long, frame_id long, stars int, fwhm double, ecc double, bg double, noise double")
    d = Q.cull(m).orderBy("frame_id").collect()
    assert [r.status for r in d] == ["keep"] * 3 and [r.is_reference for r in d] == [True, False, False]


def test_registry_refuses_duplicates_and_coerces():
    assert len(G.TOOLS) == 30
    with pytest.raises(ValueError):
        G.register("levels", "Tone", lambda d, p: d)
    assert G.TOOLS["hdr"].settings({"layers": "5.6"})["layers"] == 6


def test_replay_suppresses_a_step_without_its_mask(image):
    df = rgb(image, np.random.default_rng(8).random((12, 14)))
    same = G.replay(df, [{"name": "levels", "params": {"black": 0.3}, "mask": "none such"}])
    assert np.allclose(to_array(same, "r"), to_array(df, "r"))


def test_lookup_version_is_checked(spark, tmp_path):
    p = tmp_path / "l.json"
    p.write_text(json.dumps({"schema_version": 1, "dials": {"a": 1, "b": 2}}))
    assert {r.name: r.value for r in load_lookup(spark, str(p), "dials").collect()} == {"a": "1", "b": "2"}
    p2 = tmp_path / "m.json"
    p2.write_text(json.dumps({"schema_version": 9, "dials": {"a": 1}}))
    with pytest.raises(Exception, match="unsupported lookup version"):
        load_lookup(spark, str(p2), "dials").collect()


def test_starlet_sums_back():
    a = np.pad(np.random.default_rng(9).random((40, 40)), 14, mode="reflect")
    planes, rest = Kn.atrous_planes(a, 3)
    assert np.allclose((sum(planes) + rest)[14:-14, 14:-14], a[14:-14, 14:-14])
