import numpy as np
from pyspark.sql import functions as F

from skyframe.llm import ann
from skyframe.llm.common import QUERIES


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r], 0) for i, r in zip(ids, x)], "vec_id long, embedding array<float>, label int")


def brute(ids, x, every=20, k=20):
    x = np.asarray(x, np.float32).astype(np.float64)
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (x * q).sum(axis=1)
            out[i] = sorted((-a, j) for a, j in zip(s.tolist(), ids) if j != i)[:k]
    return out


def recall(rows, want):
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(near) + 1))
        assert all((a[2], -a[1]) > (b[2], -b[1]) for a, b in zip(mine, mine[1:]))
        edge = -near[-1][0] - 1e-9
        hits += sum(s >= edge for _, _, s in mine)
    return hits / sum(len(n) for n in want.values())


def test_recall_on_the_test_table(spark):
    root = "/root/testdata/sf0.1"
    rows = QUERIES["op3_ann"](spark, root).collect()
    t = spark.read.parquet(f"{root}/embeddings.parquet").collect()
    assert recall(rows, brute([r.vec_id for r in t], [r.embedding for r in t])) >= 0.95


def test_unequal_lengths_and_clusters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, (1500, 1))
    x[300:900] = x[300] + rng.normal(size=(600, 16)) * 0.01
    ids = list(range(1500))
    rows = ann.search(frame(spark, ids, x).repartition(5)).collect()
    assert recall(rows, brute(ids, x)) >= 0.9


def test_copies_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8))
    x = np.vstack([x, np.repeat(x[:1], 40, axis=0)])
    ids = list(range(100))
    rows = ann.search(frame(spark, ids, x)).collect()
    first = sorted((r.rank, r.vec_id) for r in rows if r.query_id == 0)
    assert [v for _, v in first] == list(range(60, 80))
    assert [v for _, v in sorted((r.rank, r.vec_id) for r in rows if r.query_id == 80)] == [0, *range(60, 79)]


def test_queries_that_find_too_few_meet_every_entry_once(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 16)) * 0.05 + np.eye(16)[0]
    out = [0, 2000, 4000]  # outliers: nothing lies within the radius that suits the others
    x[out] = -np.eye(16)[0] + rng.normal(size=(3, 16)) * 0.05
    short, radii = [], []

    def visit(queries, index, h, k, bound, f=ann._visit):
        radii.append(h.radius)
        assert h.shard_coordinates == 3
        return f(queries, index, h, k, bound)

    def meet_all(queries, *rest, f=ann._meet_all):
        short.extend(r.entry for r in queries.select("entry").collect())
        return f(queries, *rest)

    monkeypatch.setattr(ann, "_visit", visit)
    monkeypatch.setattr(ann, "_meet_all", meet_all)
    ids = list(range(9000))
    rows = ann.search(frame(spark, ids, x).repartition(5)).collect()
    # shards are never enumerated without a radius: 25 ** shard_coordinates probes a query and table
    assert np.isfinite(radii).all() and set(out) <= set(short)
    want = brute(ids, x)
    for q in short:
        got = [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q]
        assert [g[0] for g in got] == [j for _, j in want[q]]
    assert recall(rows, want) >= 0.9


def test_invalid_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (20, [0.5, 0.5]), (8, [1.0, 0.1]), (8, [1.0, 0.1]), (None, [1.0, 1.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("extra"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df).collect())
    assert got == [(0, 1, 8), (0, 2, 20), (20, 1, 8), (20, 2, 0)]
    assert ann.search(df.limit(0)).count() == 0
