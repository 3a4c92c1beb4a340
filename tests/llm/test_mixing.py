import re

import pytest
from pyspark.sql import functions as F

from skyframe.llm import mixing
from skyframe.llm.common import QUERIES

from .conftest import ODD_ROWS


def targets(sizes, weights=(5, 2, 1), most=3):
    """Brute force: reshare the excess until no source is above its cap."""
    total, names = sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    w, out, free = {s: weights[i % 3] for i, s in enumerate(names)}, {}, set(names)
    while free:
        left = total - sum(out.values())
        now = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return out | now
        out |= {s: most * sizes[s] for s in over}
        free -= over
    return out


def test_targets_equal_resharing(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 50, None: 7}, {"a": 10, "b": 10}, {"x": 5}, {"a": 0, "b": 9, "c": 1}, {f"s{i}": (i * 37) % 101 for i in range(40)}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


def test_budgets_are_met(spark, tables):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(id % 17))").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    root = tables(documents=docs)
    rows = QUERIES["op10_mixing"](spark, root).collect()
    assert len(rows) == 3000 and all(r.taken <= 3 * r.size for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - target) <= 16 for (_, target), t in by.items())
    assert sorted(rows) == sorted(QUERIES["op10_mixing"](spark, root).collect())


def test_odd_rows(odd_documents, no_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == len(ODD_ROWS)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((r[0] or -1, words(r[1])) for r in ODD_ROWS)
    out = mixing.mixed(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == sum(r.times for r in rows)
    assert mixing.mix(no_documents).count() == 0 and mixing.mixed(no_documents).count() == 0
