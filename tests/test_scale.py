"""Operators whose rounds, writes or groups must stay bounded."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyframe.functions.quantiles import group_mad, group_mads
from skyframe.operators import polyfit, scene
from skyframe.operators import stars as S
from skyframe.streaming.frames import MeanTable


def greedy(p, sep):
    kept, cells = [], {}
    for y, x in p.sort_values(["flux", "y", "x"], ascending=[False, True, True])[["y", "x"]].to_numpy().tolist():
        near = [k for a in (-1, 0, 1) for b in (-1, 0, 1) for k in cells.get((y // sep + a, x // sep + b), [])]
        if all((y - k[0]) ** 2 + (x - k[1]) ** 2 >= sep * sep for k in near):
            kept.append((y, x))
            cells.setdefault((y // sep, x // sep), []).append((y, x))
    return set(kept)


def test_a_chain_of_ten_thousand_stars_takes_few_rounds(spark, monkeypatch):
    """Every star hangs on the brighter one before it, along a winding line through nine tiles."""
    at, y, step = [], 0, 5
    while len(at) < 10_000:
        row = [(y, x) for x in range(0, 330, step)]
        at += row if (y // 20) % 2 == 0 else row[::-1]
        at += [(y + d, at[-1][1]) for d in range(step, 20, step)]
        y += 20
    at = at[:10_000]
    p = pd.DataFrame({"image_id": np.int64(0), "y": [a for a, _ in at], "x": [b for _, b in at], "flux": np.linspace(1, 0.1, len(at))})
    written = []
    monkeypatch.setattr(S, "cut", lambda d, real=S.cut: written.append(1) or real(d))
    sep = spark.createDataFrame([(0, 7.0)], "image_id long, sep double")
    got = S.suppress_close(spark.createDataFrame(p), sep).select("y", "x").collect()
    assert {(r.y, r.x) for r in got} == greedy(p, 7) and len(written) <= 20


def test_tiles_agree_with_one_pass(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE_PIXELS", 16)
    monkeypatch.setattr(S, "TILE_SEPS", 2)
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"image_id": np.int64(0), "y": rng.integers(0, 200, 2500), "x": rng.integers(0, 200, 2500), "flux": np.round(rng.random(2500), 2)}).drop_duplicates(["y", "x"])
    other = p.assign(image_id=np.int64(1), flux=np.round(rng.random(len(p)), 2))
    sep = spark.createDataFrame([(0, 6.0), (1, 9.0)], "image_id long, sep double")
    got = S.suppress_close(spark.createDataFrame(pd.concat([p, other])), sep).collect()
    assert {(r.y, r.x) for r in got if r.image_id == 0} == greedy(p, 6) and {(r.y, r.x) for r in got if r.image_id == 1} == greedy(other, 9)


def test_running_means_survive_a_crash(spark, tmp_path):
    def batch(rows):
        return spark.createDataFrame([(t, 0, x, v) for t, x, v in rows], "target_id long, y int, x int, v double")

    def values():
        return {(r.target_id, r.x): (r.total, r.n) for r in MeanTable(spark, str(tmp_path)).read().collect()}

    table = MeanTable(spark, str(tmp_path))
    assert values() == {}
    table.put(batch([(1, 0, 2.0), (1, 0, 4.0), (2, 1, 1.0)]), 0)
    table.put(batch([(2, 1, 5.0), (2, 2, 7.0)]), 1)
    want = {(1, 0): (6.0, 2), (2, 1): (6.0, 2), (2, 2): (7.0, 1)}
    assert values() == want
    # only the target it touches is written
    assert {f.name for f in (tmp_path / "sums" / "batch=1").iterdir() if f.is_dir()} == {"target_id=2"}
    # sums written, manifest not: nobody reads them, and the batch can run again
    batch([(1, 0, 100.0)]).select("y", "x", F.col("v").alias("total"), F.lit(1).cast("long").alias("n"), "target_id").write.partitionBy("target_id").parquet(f"{tmp_path}/sums/batch=2")
    assert values() == want
    for _ in range(2):
        table.put(batch([(1, 0, 3.0), (3, 0, 9.0)]), 2)
        assert values() == want | {(1, 0): (9.0, 3), (3, 0): (9.0, 1)}
    table.put(batch([(2, 1, 5.0), (2, 2, 7.0)]), 1)  # a batch before it runs again
    assert values() == want | {(1, 0): (9.0, 3), (3, 0): (9.0, 1)}


def test_weak_lines_are_filled_across_blocks(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s, n in ((0, 400), (1, 37), (2, 5), (3, 1)):
        ok = rng.random(n) < 0.2 if s else np.isin(np.arange(n), [50, 51, 333])
        ok &= s != 2
        rows += [(s, i, float(rng.random()), bool(ok[i])) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = spark.createDataFrame(rows, "image_id long, line int, v double, ok boolean").repartition(5)
        got = {(r.image_id, r.line): r.v for r in scene.fill_weak(lines, "line", "v", "ok").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    d = pd.DataFrame(rows, columns=["s", "i", "v", "ok"])
    assert len(got) == len(d)
    for s, g in d.groupby("s"):
        good = g[g.ok]
        want = np.interp(g.i, good.i, good.v) if len(good) else g.v.to_numpy()
        assert [got[s, i] for i in g.i] == pytest.approx(list(want), abs=1e-12)


def test_binned_and_grouped_fits_reject_outliers(spark):
    rng = np.random.default_rng(10)
    rows = []
    for g, (a, b, c) in enumerate(((0.2, 0.1, -0.05), (0.5, -0.2, 0.3))):
        u, w = rng.random(3000), rng.random(3000)
        z = a + b * u + c * w + rng.normal(0, 0.003, 3000)
        z[:400] += rng.random(400) * 0.5
        rows += [(g, float(v), [1.0, float(p), float(q)]) for v, p, q in zip(z, u, w)]
    d = spark.createDataFrame(rows, "image_id long, v double, _t array<double>")
    limits = lambda mid, mad: (mid - mad * 4.4478, mid + mad * 2.2239)
    for fit in (polyfit.binned_fit, polyfit.grouped_fit):
        got = {r.image_id: r for r in fit(d, ["image_id"], 3, limits, 5, lambda chosen, every: chosen >= 8).collect()}
        for g, truth in enumerate(((0.2, 0.1, -0.05), (0.5, -0.2, 0.3))):
            assert got[g].coef == pytest.approx(truth, abs=2e-3) and 2000 < got[g].n < 2700
        none = fit(d, ["image_id"], 3, limits, 5, lambda chosen, every: False).collect()
        assert all(r.n == 3000 for r in none)


def test_several_deviations_in_one_pass(spark):
    rng = np.random.default_rng(11)
    rows = [(int(g), float(a), float(b) if g != 2 else None) for g, a, b in zip(rng.integers(0, 4, 500), rng.normal(size=500), rng.random(500))]
    d = spark.createDataFrame(rows, "g int, a double, b double")
    got = {r.g: r for r in group_mads(d, ["g"], {"a": ("am", "ac"), "b": ("bm", "bc")}).collect()}
    for c in "ab":
        one = {r.g: (r.mad, r.med) for r in group_mad(d, ["g"], c).collect()}
        assert {g: (got[g][f"{c}m"], got[g][f"{c}c"]) for g in one} == one
    assert got[2].bm is None and len(got) == 4


def _broadcasts(df):
    """Broadcast exchanges of the plan that ran."""
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


@pytest.fixture(scope="module")
def exploded(spark):
    """Pixels that Spark takes for as few rows as the arrays they come from."""
    frames = spark.range(0, 400).select(F.lit(0).alias("target_id"), F.col("id").alias("frame_id"))
    px = frames.select("target_id", "frame_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    return px.select("target_id", "frame_id", (F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), ((F.col("frame_id") * 31 + F.col("p") * 17) % 101 / 101.0).alias("v"))


def test_star_windows_and_quantiles_broadcast_no_pixels(exploded):
    from skyframe.functions.quantiles import group_quantiles, linear

    img = exploded.select(F.col("frame_id").alias("image_id"), "y", "x", "v")
    peaks = img.filter("v > 0.9").withColumn("star_id", F.concat_ws(":", "y", "x"))
    assert _broadcasts(S.star_windows(img, peaks, 2)) == 0
    q = group_quantiles(img, ["image_id"], "v", {"m": linear(0.5)})
    assert _broadcasts(q) == 0
    want = {r.image_id: r.m for r in img.groupBy("image_id").agg(F.median("v").alias("m")).collect()}
    assert {r.image_id: r.m for r in q.collect()} == pytest.approx(want)


def test_alignment_points_broadcast_no_pixels(exploded):
    from skyframe.operators import burst

    c = exploded.select("target_id", "frame_id").distinct().withColumns({"ay": F.lit(2), "ax": F.lit(2), "oy": F.lit(0.5), "ox": F.lit(0.25)})
    assert _broadcasts(burst.stack_points(exploded, c, 4)) == 0


def test_snr_maps_broadcast_no_pixels(exploded):
    from skyframe.operators import masks

    img = exploded.select(F.col("frame_id").alias("image_id"), "y", "x", "v")
    assert _broadcasts(masks.snr_map(img, img.withColumn("noise", F.lit(0.1)), F.col("v"))) == 0


def test_significance_display_broadcasts_no_pixels(exploded):
    from skyframe.operators import stencil

    rgb = exploded.select(F.col("frame_id").alias("image_id"), "y", "x", *[F.col("v").alias(c) for c in "rgb"])
    d = stencil.significance_display(rgb, rgb.select("image_id", "y", "x", F.lit(0.5).alias("w")), 0.7)
    d.write.format("noop").mode("overwrite").save()
    assert "SortMergeJoin" in d._jdf.queryExecution().executedPlan().toString()


def test_later_values_of_a_long_group_are_read_once(spark):
    """A frame open towards the end is counted anew for every row, so a group's time grows with its square."""
    from skyframe.functions.scan import nearest_known

    rows = spark.range(0, 2000).select(F.lit(0).alias("k"), F.col("id").alias("at"), F.when(F.col("id") % 7 == 3, F.struct(F.col("id").alias("p"))).alias("known"))
    d = nearest_known(rows, ["k"], "at", F.col("known"))
    assert "unboundedfollowing" not in d._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in d.collect():
        last, first = r.at - (r.at - 3) % 7, r.at + (3 - r.at) % 7
        assert (r.before.p if r.before else None) == (last if last >= 0 else None) and (r.after.p if r.after else None) == (first if first < 2000 else None)


def test_cone_search_is_spread_and_broadcasts_nothing(spark):
    from skyframe.operators.catalog import cone_search

    fields = spark.range(0, 50).select(F.col("id").alias("field_id"), (F.col("id") * 7.3 % 360).alias("ra"), (F.col("id") % 60 - 30.0).alias("dec"), F.lit(2.0).alias("fov_radius"))
    objects = spark.range(0, 500).select(F.col("id").cast("string").alias("id"), (F.col("id") * 0.73 % 360).alias("ra"), (F.col("id") % 60 - 30.0).alias("dec"), F.lit(20.0).alias("diameter"))
    d = cone_search(fields, objects)
    assert _broadcasts(d) == 0 and "REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString() and d.count() > 0


def test_packing_holds_a_bounded_number_of_pixels(image):
    """What a worker packs at a time does not grow with its task's input."""
    import numpy as np

    from skyframe.operators import overlap

    d = image(np.arange(400 * 400.0).reshape(400, 400)).coalesce(1)
    packed = overlap.pack_tiles(d, ["image_id"], ["v"], [], (1, 1), (512, 512))
    sizes = [r.n for r in packed.select(F.size("_vy").alias("n")).collect()]
    assert sum(sizes) == 400 * 400 and max(sizes) < 80_000


def test_colour_samples_are_looked_up_once_a_frame(spark):
    """As expressions of pixel rows they were repeated by every column made of them, in methods too long to be compiled."""
    from skyframe.functions.quantiles import log_bin
    from skyframe.sources.views import Views

    mean = (F.col("r") + F.col("g") + F.col("b")) / 3.0
    d = Views(spark, "/root/testdata/sf0.001").rgb.select("image_id", F.pow(mean, 2).alias("v")).withColumn("b", log_bin(F.col("v")))
    assert d.filter(F.col("b").isNotNull())._jdf.queryExecution().optimizedPlan().toString().count("element_at") <= 3


def test_star_windows_are_joined_once(image):
    import numpy as np

    from skyframe.operators.stars import frame_quality

    a = np.random.default_rng(5).normal(0.1, 0.005, (64, 64))
    y, x = np.mgrid[0:64, 0:64]
    for cy, cx in ((15, 15), (30, 45), (48, 20)):
        a += 0.5 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 4.5)
    d = frame_quality(image(a), F.col("v"))
    assert "star_id" not in d._jdf.queryExecution().optimizedPlan().toString()
    r = d.first()
    assert r.stars >= 3 and 2.5 < r.fwhm < 5


def test_twins_are_collapsed_in_many_tasks(spark):
    """Pairs pack well, so that tasks set by bytes were few and sorted many of them."""
    from skyframe.operators.catalog import collapse_twins

    c = spark.range(0, 400).select((F.col("id") % 5).alias("field_id"), (F.col("id") % 20 * 0.5).alias("ra"), (F.col("id") * -0.0).alias("dec"), F.col("id").cast("double").alias("score"), F.col("id").alias("ord"))
    d = collapse_twins(c)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    assert {(r.field_id, r.ra, r.score) for r in d.collect()} == {(i % 5, i % 20 * 0.5, float(i)) for i in range(380, 400)}


def test_twins_are_collapsed_where_the_join_put_them(spark):
    """Every pair was dealt anew by its rounded position, far more rows than both tables hold."""
    import math

    import numpy as np

    from skyframe.operators.catalog import collapse_twins, cone_search, prominence

    rng, n = np.random.default_rng(4), 600
    # positions beside the borders of sky cells, the seam of right ascension and the poles, on both sides of a rounding
    ra = rng.choice([0.0, 2.0, 16.0, 359.99, 180.0], n) + rng.choice([-0.012, -0.0049, -0.004, 0.0, 0.004, 0.0049, 0.006], n)
    dec = np.clip(rng.choice([-90.0, -88.0, 0.0, 6.0, 46.0, 90.0], n) + rng.choice([-0.006, -0.0049, 0.0, 0.004, 0.0049], n), -90, 90)
    size = rng.choice([5.0, 40.0, 200.0, 900.0], n)
    rows = [(str(i), i, float(ra[i]), float(dec[i]), None if i % 13 == 0 else float(size[i]), None if i % 11 == 0 else float(i % 9), "M" if i % 10 == 0 else "NGC/IC") for i in range(n)]
    rows += [("lost", n, None, 1.0, 5.0, 3.0, "M"), ("nan", n + 1, math.nan, 1.0, 5.0, 3.0, "M")]
    objects = spark.createDataFrame(rows, "id string, ord long, ra double, dec double, diameter double, mag double, source string")
    at = [(r, d) for r in (0.3, 1.5, 17.0, 357.0, 179.5) for d in (-89.5, -87.0, 0.7, 44.5, 88.5)]
    fields = spark.createDataFrame([(i, float(r), float(d), 0.7 + i % 4) for i, (r, d) in enumerate(at)], "field_id long, ra double, dec double, fov_radius double")
    pairs = prominence(cone_search(fields, objects))
    best = {}
    for r in pairs.collect():
        k = (r.field_id, round(r.ra * 100), round(r.dec * 100))  # half to even
        best[k] = min(best.get(k, (0, 0, "")), (-r.score, r.ord, r.id))
    told = collapse_twins(prominence(cone_search(fields, objects, twins=True)))
    assert {(r.field_id, r.id) for r in told.collect()} == {(k[0], v[2]) for k, v in best.items()} and len(best) < pairs.count()
    assert told.count() == len(best) and set(told.columns) == set(pairs.columns)
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange \w+\([^)]*field_id", plan)


def test_tools_run_side_by_side(image):
    """Each tool waited for the one before it, however little of the machine that one used."""
    import threading

    from skyframe.operators import registry

    d = image(np.linspace(0.1, 0.9, 64).reshape(8, 8), name="r").withColumns({c: F.col("r") for c in "gb"})
    met = threading.Barrier(2, timeout=60)

    def waits(px, settings):
        met.wait()  # raises unless another tool comes here as well
        return px.withColumn("r", F.col("r") * settings["by"])

    tools = {n: registry.Tool(n, "Tone", waits, [registry.Param("by", "float", 0.5)]) for n in ("a", "b")}
    got = registry.contract_rows(d, {"b": {"by": 2.0}}, tools)
    assert {(r.tool, r.image_id, r.n, r.n_valid) for r in got.collect()} == {("a", 0, 64, 64), ("b", 0, 64, 32)}


def test_patches_and_surfaces_are_not_interpreted_for_every_pixel(image):
    """Rectangles were worked out, and polynomial terms added up, by functions over arrays for each pixel."""
    from skyframe.operators import stats, surface

    a = np.random.default_rng(6).uniform(0.1, 0.9, (160, 160))
    d = image(a, name="r").withColumns({c: F.col("r") for c in "gb"})
    plan = stats.dust_patches(d)._jdf.queryExecution().optimizedPlan().toString()
    of_pixels = [x for x in plan.splitlines() if "lambdafunction" in x and re.search(r"[( ][xy]#", x)]
    assert "lambdafunction" in plan and not of_pixels
    made, real = [], surface.cut
    surface.cut = lambda t: made.append(t._jdf.queryExecution().optimizedPlan().toString()) or real(t)
    try:
        out = surface.background_extract(d)
    finally:
        surface.cut = real
    assert "zip_with" not in made[-1]
    got, v = out.orderBy("y", "x").toPandas(), np.linspace(-1, 1, 160)
    u, w = np.meshgrid(v, v)
    # the surface is a polynomial of degree 4 in x and y, less its median
    basis = np.stack([u**i * w ** (t - i) for t in range(5) for i in range(t + 1)], -1).reshape(-1, 15)
    gone = a.ravel() - got.r.to_numpy()
    inside = (got.r > 0) & (got.r < 1)
    fit = basis[inside] @ np.linalg.lstsq(basis[inside], gone[inside], rcond=None)[0]
    assert np.abs(fit - gone[inside]).max() < 1e-9 and gone.std() > 1e-4


def test_a_gated_step_joins_tables(image):
    """A step that is read twice by its gate doubled all joins before it in one task."""
    import numpy as np

    from skyframe.operators import registry

    d = image(np.linspace(0.1, 0.9, 64).reshape(8, 8), name="r").withColumns({c: F.col("r") for c in "gb"})
    step = {"name": "saturation", "params": {"amount": 0.0}, "opacity": 0.5}
    out = registry.replay(d, [step] * 3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert all(abs(a.r - b.r) < 1e-9 for a, b in zip(out.orderBy("y", "x").collect(), d.orderBy("y", "x").collect()))


def test_medians_beside_a_gap_do_not_slow_the_rest(monkeypatch):
    """One undefined value sent every window of an array to the slow median."""
    from skyframe.functions import kernels as Kn

    a = np.random.default_rng(12).random((60, 60))
    a[5, 7], a[:, 0] = np.nan, np.nan
    want = np.nanmedian(Kn.windows(a, 5), axis=2)
    slow = []
    monkeypatch.setattr(np, "nanmedian", lambda w, axis, real=np.nanmedian: slow.append(len(w)) or real(w, axis=axis))
    got = Kn.rank_filter(a, 5, "median")
    assert np.array_equal(got[2:-2, 2:-2], want) and sum(slow) < 100


def test_quantile_counts_are_smaller_than_their_image(spark):
    """Fine bins were about as many as the pixels of an image, so that its counts were sorted like pixels."""
    from skyframe.functions import quantiles as Q

    d = spark.range(0, 20_000).select(F.lit(0).alias("image_id"), (0.3 + F.rand(3) * 0.5).alias("v"))
    assert d.select(Q.log_bin(F.col("v"), Q.COUNT_BINS)).distinct().count() < 1000
    values = sorted(r.v for r in d.collect())
    got = Q.group_quantiles(d, ["image_id"], "v", {"a": Q.lower(0.25), "k": Q.kth_largest(7)}).first()
    assert (got.a, got.k) == (values[int(0.25 * 19_999)], values[-7])


def test_denoised_channels_stay_in_one_row(image):
    """Channels dealt to rows of their own had to be put together again by a shuffle of all pixels."""
    from skyframe.operators import stencil

    d = image(np.random.default_rng(13).random((40, 40)), name="r").withColumns({"g": F.col("r") * 0.5, "b": 1.0 - F.col("r")})
    for out in (stencil.noise_reduction(d), stencil.chroma_nr(d, 0.8)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 0 and out.count() == 1600


def test_points_of_a_tile_are_measured_together(monkeypatch):
    """A transform and a dozen small array calls a point took most of the time."""
    from skyframe.operators import burst

    rng = np.random.default_rng(14)
    ref, calls = rng.random((9, 12, 12)), []
    monkeypatch.setattr(np.fft, "irfft2", lambda *a, real=np.fft.irfft2, **k: calls.append(1) or real(*a, **k))
    tgt = np.stack([np.roll(a, (i % 3 - 1, i // 3 - 1), (0, 1)) for i, a in enumerate(ref)])
    dy, dx = burst._peaks(burst._windows(ref, 3), burst._windows(tgt, 3))
    assert len(calls) == 1 and np.rint(dy).tolist() == [i % 3 - 1 for i in range(9)] and np.rint(dx).tolist() == [i // 3 - 1 for i in range(9)]


def test_small_frames_are_correlated_in_small_arrays(spark, monkeypatch):
    """Frames of eight pixels a side filled arrays of a whole tile."""
    from skyframe.operators import burst

    a = np.random.default_rng(15).random((8, 9))
    y, x = np.mgrid[0:8, 0:9]
    pairs = spark.createDataFrame(pd.DataFrame({"target_id": 0, "frame_id": 1, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "ref": a.ravel(), "tgt": np.roll(a, 1, 0).ravel()}))
    got = {(r.dy, r.dx): r.s for r in burst.correlate(pairs, 2).collect()}
    wide = lambda v: np.pad(v, 2)
    want = {(i, j): float((a * wide(np.roll(a, 1, 0))[2 + i : 10 + i, 2 + j : 11 + j]).sum()) for i in range(-2, 3) for j in range(-2, 3)}
    assert got == pytest.approx(want)


def test_shifts_of_small_frames_take_no_data_frame_each(spark):
    """A pandas frame in and out of every group took most of the time of small frames."""
    from skyframe.operators import burst

    a = np.random.default_rng(16).random((8, 8))
    y, x = np.mgrid[0:8, 0:8]
    pairs = spark.createDataFrame(pd.DataFrame({"target_id": 0, "frame_id": 1, "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32"), "ref": a.ravel(), "tgt": a.ravel()}))
    for d in (burst.whole_shift(pairs), burst.best_shift(burst.correlate(pairs, 2))):
        assert "InPandas" not in d._jdf.queryExecution().executedPlan().toString()
        r = d.first()
        assert abs(r.dx) < 0.5 and abs(r.dy) < 0.5


def test_pixels_meet_the_gains_of_their_frames_over_a_shuffle(spark, exploded):
    from skyframe.operators import stack
    from skyframe.session import cut

    stats = cut(stack.frame_stats(exploded))
    got = stack.normalize_to_ref(exploded, stats, spark.createDataFrame([(0, 7)], "target_id int, frame_id long"))
    got.write.format("noop").mode("overwrite").save()
    joins = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
    assert not any("Inner, BuildLeft" in j or ("frame_id" in j and "Inner" in j) for j in joins)
    st = {r.frame_id: r for r in stats.collect()}
    want = {(r.frame_id, r.y, r.x): (r.v - st[r.frame_id].med) * min(max(st[7].sig / st[r.frame_id].sig, 0.5), 2.0) + st[7].med for r in exploded.collect()}
    assert {(r.frame_id, r.y, r.x): r.v for r in got.collect()} == pytest.approx(want)


def test_a_stage_of_wanted_keys_is_read_without_looking_them_up(spark, tmp_path):
    from skyframe.operators import runs

    def keys(*frames):
        return spark.createDataFrame([(f"frame {f}",) for f in frames], "frame_key string")

    def compute(missing):
        return missing.select("frame_key", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("x"))

    def frames(rows):
        return sorted((r.frame_key[6:], r.x) for r in rows.collect())

    stages = runs.Stages(spark, str(tmp_path))
    stages.once("a", keys(1, 2), ["frame_key"], compute)
    every = stages.once("a", keys(1, 2, 3), ["frame_key"], compute)
    assert "Join" not in every._jdf.queryExecution().executedPlan().toString()
    assert frames(every) == [(f, x) for f in "123" for x in range(4)]
    some = stages.once("a", keys(3, 1), ["frame_key"], compute)
    assert _broadcasts(some) == 0 and frames(some) == [(f, x) for f in "13" for x in range(4)]
    assert len(stages._folders("a")) == len(stages._folders("a-keys")) == 2
    # rows whose keys were not noted are never taken for wanted ones
    spark.createDataFrame([("frame 9", 0)], "frame_key string, x int").write.parquet(f"{tmp_path}/a/died")
    spark.createDataFrame([("a", f"{tmp_path}/a/died")], "stage string, folder string").coalesce(1).write.mode("append").json(f"{tmp_path}/manifest")
    assert frames(stages.once("a", keys(1, 2, 3), ["frame_key"], compute)) == [(f, x) for f in "123" for x in range(4)]


def test_tasks_that_combine_narrowband_images_hold_a_bounded_number_of_pixels(spark, monkeypatch):
    from skyframe.operators import pixel

    monkeypatch.setattr(pixel, "TASK_PIXELS", 3000, raising=False)
    grid = spark.range(0, 20_000).select((F.col("id") / 10_000).cast("long").alias("image_id"), ((F.col("id") % 10_000) / 100).cast("int").alias("y"), (F.col("id") % 100).cast("int").alias("x"))
    ha, o3, s2 = (grid.withColumn("v", (F.col("y") * a + F.col("x") * b) % 101 / 100.0) for a, b in ((3, 7), (5, 11), (13, 2)))
    o3, s2 = o3.where("x <> 9"), s2.where("x % 5 <> 0")
    value = lambda r, a, b: min((r.y * a + r.x * b) % 101 / 100.0, 1.0)
    for sii, palette in ((s2, "SHO"), (s2, "HOS"), (None, "HOS")):
        got = pixel.narrowband(ha, o3, sii, palette).cache()
        held = got.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).collect()[0]
        assert held[1] == 19_800 and held[0] < 2000
        for r in got.where("x % 7 = 0 or x = 5").collect():
            h, o = value(r, 3, 7), value(r, 5, 11)
            s = value(r, 13, 2) if sii is not None and r.x % 5 else None
            want = (h if s is None else s, h, o) if palette == "SHO" else (h, o, o if s is None else s)
            assert (r.r, r.g, r.b) == pytest.approx(want)
        got.unpersist()
