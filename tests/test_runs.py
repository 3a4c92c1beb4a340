import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.operators import burst, finish, runs

from conftest import to_array
from test_truth import gauss_star


def frames_table(spark, arrays):
    """{(target, frame): 2-D array} -> (target_id, frame_id, y, x, v)."""
    parts = []
    for (t, f), a in arrays.items():
        y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
        parts.append(pd.DataFrame({"target_id": np.int64(t), "frame_id": np.int64(f), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "v": a.ravel().astype(float)}))
    return spark.createDataFrame(pd.concat(parts)).repartition(8)


def colour(spark, pictures):
    rows = []
    for i, a in pictures.items():
        y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
        rows.append(pd.DataFrame({"image_id": np.int64(i), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "r": a.ravel(), "g": a.ravel() * 0.9, "b": a.ravel() * 0.8}))
    return spark.createDataFrame(pd.concat(rows))


# --- finishing


def plan_of(spark, rows):
    return spark.createDataFrame(rows, "image_id long, ord int, step string, run boolean, reason string, settings string")


def dimmed(by):
    return finish.Step(lambda d, s, w: d.withColumns({c: F.col(c) * by for c in "rgb"}))


def test_a_failing_step_leaves_the_image_otherwise_finished(spark):
    pictures = {i: np.full((4, 4), 0.8) for i in range(6)}

    def raises(d, s, w):
        return d.withColumns({c: F.when(F.col("image_id") == 4, F.raise_error(F.lit("spoilt"))).otherwise(F.col(c) * 0.5) for c in "rgb"})

    def empties(d, s, w):
        return d.withColumns({c: F.when(F.col("image_id") != 2, F.col(c)) for c in "rgb"})

    steps = {"half": dimmed(0.5), "raises": finish.Step(raises), "empties": finish.Step(empties)}
    rows = [(i, k, n, not (i == 5 and n == "half"), "switched off" if i == 5 and n == "half" else None, "{}") for i in range(6) for k, n in enumerate(["half", "raises", "empties", "half", "unknown"])]
    rows = [(i, k, n, r, w, s) for i, k, n, r, w, s in rows if i != 0]
    px, ledger = finish.run_plan(colour(spark, pictures), plan_of(spark, rows), steps=steps)
    light = {r.image_id: r.r for r in px.groupBy("image_id").agg(F.max("r").alias("r"), F.count("*").alias("n")).where("n = 16").collect()}
    assert light == pytest.approx({0: 0.8, 1: 0.1, 2: 0.1, 3: 0.1, 4: 0.2, 5: 0.4})
    told = {(r.image_id, r.ord): (r.outcome, r.reason) for r in ledger.collect()}
    assert len(told) == 25 and told[4, 1] == ("failed", "spoilt") and told[2, 2] == ("failed", "left 0 of 16 valid pixels") and told[5, 0] == ("skipped", "switched off")
    assert {k for k, (o, _) in told.items() if o == "failed"} == {(4, 1), (2, 2), *((i, 4) for i in range(1, 6))}
    assert told[1, 4] == ("failed", "no tool")


def test_tries_after_a_failed_step_read_their_own_images_only(spark):
    pictures, read = {i: np.full((2, 2), 0.8) for i in range(30)}, []

    def raises(d, s, w):
        read.append(set(d.inputFiles()))
        return d.withColumns({c: F.when(F.col("image_id") % 5 == 3, F.raise_error(F.lit("spoilt"))).otherwise(F.col(c) * 0.5) for c in "rgb"})

    rows = [(i, 0, "raises", True, None, "{}") for i in range(30)]
    px, ledger = finish.run_plan(colour(spark, pictures), plan_of(spark, rows), steps={"raises": finish.Step(raises)})
    assert {r.image_id: r.r for r in px.groupBy("image_id").agg(F.max("r").alias("r")).collect()} == pytest.approx({i: 0.8 if i % 5 == 3 else 0.4 for i in range(30)})
    assert {r.image_id for r in ledger.where("outcome = 'failed' and reason = 'spoilt'").collect()} == {3, 8, 13, 18, 23, 28}
    assert all(read[1:]) and all(not a & b for i, a in enumerate(read[1:]) for b in read[1 + i + 1 :])


def test_images_that_stop_a_step_are_found_on_few_plans(spark):
    """Every try planned, wrote and listed, so that many stopped images took some jobs each."""
    pictures, made = {i: np.full((2, 2), 0.8) for i in range(120)}, []

    def raises(d, s, w):
        made.append(0)
        told = F.raise_error(F.concat(F.lit("spoilt "), F.col("image_id")))
        return d.withColumns({c: F.when(F.col("image_id") % 3 == 1, told).otherwise(F.col(c) * 0.5) for c in "rgb"})

    rows = [(i, 0, "raises", True, None, "{}") for i in range(120)]
    px, ledger = finish.run_plan(colour(spark, pictures), plan_of(spark, rows), steps={"raises": finish.Step(raises)})
    assert {r.image_id: r.r for r in px.groupBy("image_id").agg(F.max("r").alias("r")).collect()} == pytest.approx({i: 0.8 if i % 3 == 1 else 0.4 for i in range(120)})
    assert {r.image_id: r.reason for r in ledger.where("outcome = 'failed'").collect()} == {i: f"spoilt {i}" for i in range(120) if i % 3 == 1}
    assert len(made) <= 12


@pytest.mark.parametrize("how", ["moves rows", "runs a job", "deals anew", "looks beyond its task"])
def test_steps_that_move_rows_are_tried_by_parts(spark, how):
    pictures = {i: np.full((2, 2), 0.8) for i in range(12)}

    def raises(d, s, w):
        if how == "moves rows":
            d = d.join(d.groupBy("y").agg(F.max("x").alias("top")), "y").drop("top")
        elif how == "deals anew":
            d = d.repartition(3)
        d = d.withColumns({c: F.when(F.col("image_id") == 7, F.raise_error(F.lit("spoilt"))).otherwise(F.col(c) * 0.5) for c in "rgb"})
        if how == "looks beyond its task":
            return d.coalesce(1)
        return finish.cut(d) if how == "runs a job" else d

    rows = [(i, 0, "raises", True, None, "{}") for i in range(12)]
    px, ledger = finish.run_plan(colour(spark, pictures), plan_of(spark, rows), steps={"raises": finish.Step(raises)})
    assert {r.image_id: r.r for r in px.groupBy("image_id").agg(F.max("r").alias("r")).collect()} == pytest.approx({i: 0.8 if i == 7 else 0.4 for i in range(12)})
    assert [(r.image_id, r.reason) for r in ledger.where("outcome = 'failed'").collect()] == [(7, "spoilt")]


def test_the_whole_run_on_two_shapes(spark):
    rng = np.random.default_rng(3)
    pictures = {i: np.clip(0.25 + 0.02 * rng.standard_normal((48, 48)) + gauss_star((48, 48), 20, 25, 0.5, 4.0), 0, 1) for i in range(3)}
    off = {n: False for n in ("preview", "narrowband", "has_noise", "has_trails", "has_foreground", "doBgExtract", "darkLaneGC", "fixChromatic", "doBXT", "useClassicalDeconv", "doColorCal", "doNR", "doHDR",
                              "reduceCast", "enhanceEmission", "doLocalContrast", "removeStars", "doStarReduce", "haloTamer")}
    zero = {n: 0.0 for n in ("cropPercent", "snrProtect", "significance", "deepen", "structure", "chromaNR", "dehaze", "gradientCleanup", "starShrink", "transparency", "dimCore", "deepenBackground", "meteorStrength")}
    rows = [{"image_id": i, **off, **zero, "is_color": i != 2, "inputStretched": True, "doSCNR": True, "saturation": 0.2, "significance": 0.5 if i == 1 else 0.0} for i in range(3)]
    params = spark.createDataFrame(pd.DataFrame(rows))
    px, ledger = finish.finish(colour(spark, pictures), params)
    got = px.groupBy("image_id").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
    assert {r.image_id: r.n for r in got} == {0: 48 * 48, 1: 48 * 48, 2: 48 * 48} and all(0 <= r.lo < r.hi <= 1 for r in got)
    told = {(r.image_id, r.step): (r.outcome, r.reason) for r in ledger.collect()}
    assert told[0, "scnr"] == ("run", None) and told[2, "scnr"] == ("skipped", "mono image") and told[0, "auto_stretch"] == ("skipped", "input already stretched")
    assert told[1, "significance"] == ("failed", "no significance map") and told[1, "highlight_rolloff"] == ("run", None)
    assert {k for k, v in told.items() if v[0] == "failed"} == {(1, "significance")}


# --- keyed stages


def test_a_stage_computes_each_key_once(spark, tmp_path):
    asked = []

    def compute(missing):
        asked.append(sorted(r.k for r in missing.collect()))
        return missing.where("k <> 3").withColumn("v", F.col("k") * 10)

    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    for wanted, values in (((1, 2, 3), [10, 20]), ((2, 3, 4), [20, 40]), ((1, 4), [10, 40])):
        s = runs.Stages(spark, str(tmp_path))
        assert sorted(r.v for r in s.once("a", keys(*wanted), ["k"], compute).collect()) == values
    assert asked == [[1, 2, 3], [4], []] or asked == [[1, 2, 3], [4]]
    # a folder that no manifest row names was not finished
    keys(9).withColumn("v", F.lit(90)).write.parquet(f"{tmp_path}/a/unfinished")
    s = runs.Stages(spark, str(tmp_path))
    assert sorted(r.v for r in s.once("a", keys(9, 1), ["k"], compute).collect()) == [10, 90] and asked[-1] == [9]
    s.prune("a", keys(1, 2), ["k"])
    assert sorted(r.k for r in runs.Stages(spark, str(tmp_path)).once("a", keys(1, 4), ["k"], compute).collect()) == [1, 4] and asked[-1] == [4]


def star_field(shape=(48, 48), seed=1, n=9):
    r = np.random.default_rng(seed)
    a = np.full(shape, 0.1)
    for _ in range(n):
        a += gauss_star(shape, r.uniform(8, shape[0] - 8), r.uniform(8, shape[1] - 8), r.uniform(0.3, 0.7), 1.5)
    return a


def moved(a, dy, dx):
    return np.roll(a, (dy, dx), (0, 1))


def test_folder_to_master_reuses_what_it_has(spark, tmp_path):
    rng = np.random.default_rng(2)
    base, arrays, rows = star_field(), {}, []
    for i in range(7):
        arrays[1, i] = np.clip(moved(base, i - 3, 3 - i) + 0.05 + rng.normal(0, 0.01, base.shape), 0, 1)
        rows.append((1, i, f"light{i}", "light", 30.0))
    for i in (10, 11, 12):
        arrays[1, i] = np.full(base.shape, 0.05)
        rows.append((1, i, f"bias{i}", "bias", 0.0))
    frames = spark.createDataFrame(rows, "target_id long, frame_id long, frame_key string, role string, exptime double")
    px = frames_table(spark, arrays)
    out, counts = [], []
    for part in (frames.where("frame_id <> 6"), frames.where("frame_id <> 6"), frames):
        stages = runs.Stages(spark, str(tmp_path))
        got = runs.folder_to_master(part, px, stages, measure=lambda p: runs.moment_quality(p))
        out.append(to_array(got["master"], "v"))
        counts.append({r.stage: (r.wanted, r.computed) for r in stages.counts().collect()})
        kept = got["cull"].where("status = 'keep'").count()
        c = got["contract"].collect()[0]
        assert c.n_sub == kept >= 2 and c.exposure == 30.0 * kept
    assert counts[0]["measures"] == (6, 6) and all(m == 0 for _, m in counts[1].values()) and counts[2]["measures"] == (7, 1) and counts[2]["master-bias"] == (1, 0)
    assert np.array_equal(out[0], out[1], equal_nan=True)
    # the stack is the star field at its reference's place
    core = out[0][8:-8, 8:-8]
    best = min(np.nanstd(core - moved(base, s - 3, 3 - s)[8:-8, 8:-8]) for s in range(7))
    assert best < 0.015


def test_measure_only_measures_frames(spark):
    sharp, wide = star_field(), star_field(seed=1) * 0 + 0.1
    px = frames_table(spark, {(1, 0): sharp, (1, 1): moved(sharp, 1, 1), (1, 2): moved(sharp, -1, 2), (1, 3): wide})
    told = {r.frame_id: r for r in runs.measure_only(px).collect()}
    assert [told[i].status for i in range(4)] == ["keep", "keep", "keep", "reject"] and told[3].reason == "no stars" and told[0].stars >= 3


# --- bursts


def disc(shape=(64, 64), y=32, x=32, r=14):
    yy, xx = np.mgrid[0 : shape[0], 0 : shape[1]]
    soft = np.clip(r + 1 - np.hypot(yy - y, xx - x), 0, 1)
    return 0.05 + soft * (0.5 + 0.2 * np.sin(yy / 2.0) * np.cos(xx / 3.0))


def test_an_outlier_reference_is_replaced(spark):
    """The sharpest frame of burst 1 lies far off; burst 2 is in order."""
    base = disc()
    arrays = {(1, 0): np.roll(base, (26, 24), (0, 1))}
    arrays |= {(1, i): np.roll(base, (i % 3, -(i % 2)), (0, 1)) for i in range(1, 6)}
    arrays |= {(2, i): np.roll(base, (i, 0), (0, 1)) for i in range(4)}
    px = frames_table(spark, arrays)
    ranks = spark.createDataFrame([(t, f, f + 1) for t, f in arrays], "target_id long, frame_id long, rank int")
    got = {(r.target_id, r.frame_id): r for r in runs.register_consensus(px, ranks, max_drift=20.0, cluster=8.0).collect()}
    assert (1, 0) not in got and all(got[1, i].rescued and not got[1, i].excluded and got[1, i].reference_id == 1 for i in range(1, 6))
    for i in range(1, 6):
        assert got[1, i].dy == pytest.approx(i % 3 - 1, abs=0.3) and got[1, i].dx == pytest.approx(1 - i % 2, abs=0.3)
    assert all(not got[2, i].rescued and got[2, i].reference_id == 0 and got[2, i].dy == pytest.approx(i, abs=0.3) for i in range(4))


def test_burst_run_keeps_most_frames(spark):
    rng = np.random.default_rng(5)
    base = disc()
    arrays = {(1, i): np.roll(base, (i % 3, i % 2), (0, 1)) + rng.normal(0, 0.004, base.shape) for i in range(6)} | {(1, 9): np.full(base.shape, 0.001)}
    master, n = runs.stack_burst(frames_table(spark, arrays), keep=0.99)
    told = n.collect()[0]
    assert (told.n_graded, told.n_kept, told.n_stacked, told.rescued) == (6, 6, 6, False)
    a = to_array(master.where("n >= 6"), "v")
    ref = arrays[1, told.reference_id]
    core = (slice(16, 48), slice(16, 48))
    assert np.nanstd(a[core] - ref[core]) < 0.02


def test_points_find_their_own_offsets(spark):
    """The left half of frame 1 moved by (1, 2), its right half by (1, -1)."""
    rng = np.random.default_rng(7)
    base = np.clip(rng.random((48, 96)), 0, 1)
    k = np.ones((3, 3)) / 9
    base = sum(np.roll(base, (dy, dx), (0, 1)) * k[dy + 1, dx + 1] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    other = np.concatenate([np.roll(base, (1, 2), (0, 1))[:, :48], np.roll(base, (1, -1), (0, 1))[:, 48:]], axis=1)
    px = frames_table(spark, {(1, 0): base, (1, 1): other})
    points = spark.createDataFrame([(1, y, x) for y in (4, 12) for x in (4, 60)], "target_id long, ay int, ax int")
    offsets = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 0.0, 1.0)], "target_id long, frame_id long, dx double, dy double")
    reference = spark.createDataFrame([(1, 0)], "target_id long, frame_id long")
    got = {(r.frame_id, r.ay, r.ax): r for r in burst.measure_points(px, points, offsets, reference, 28, taper=6, tile=40).collect()}
    assert len(got) == 8
    for ay in (4, 12):
        assert got[1, ay, 4].ox == pytest.approx(2, abs=0.3) and got[1, ay, 60].ox == pytest.approx(-1, abs=0.3) and got[1, ay, 4].oy == pytest.approx(1, abs=0.3)
        assert abs(got[0, ay, 4].dx) < 0.05 and abs(got[0, ay, 4].dy) < 0.05
