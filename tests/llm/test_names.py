"""Extra columns named like the operators' own come back as they went in."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyframe.llm import exact_dedup, mixing, near_dedup

NAMES = [
    "h", "rounds", "threshold", "times", "_times", "_copy", "_salt", "_s", "_source", "size", "source_size", "target", "prefix", "left", "n", "w", "digest", "kept", "keep_id", "keep_rows",
    "group_size", "_order", "_n", "_row", "_key", "_whole", "_dropped", "component_id", "_component", "_hot", "_hot_key", "_cold", "_join", "score", "_quality_score", "a.b", "count",
]
ROWS = [(1, "a text that stands twice here", "s"), (2, "a text that stands twice here", "s"), (3, "another text of its own", None), (4, None, "t"), (5, "", "t"), (None, "no id at all", "t")]
REPEATED = [*ROWS, (3, "a second text under one id", "s"), (3, "another text of its own", None), (3, "another text of its own", None)]


def frame(spark, rows):
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, tag long")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.lit(0).cast("long").alias("n_chars"), "tag", *[F.concat(F.lit(f"{c}-"), F.col("tag")).alias(c) for c in NAMES])


@pytest.mark.parametrize("rows", [ROWS, REPEATED])
@pytest.mark.parametrize("stage", [exact_dedup.deduplicate, near_dedup.deduplicate, mixing.mixed])
def test_columns_pass_through(spark, rows, stage):
    docs = frame(spark, rows).repartition(3)
    out = stage(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}-{r.tag}" for r in got for c in NAMES)
    kept = {r.tag for r in got}
    if stage is not mixing.mixed:
        assert len(kept) == len(got) and {2, 5} <= {k if k < 6 else 2 for k in kept}
    if stage is exact_dedup.deduplicate:
        assert 1 in kept and 0 not in kept and len({r.text or "" for r in got}) == len(got)


def test_the_pipeline_keeps_them(spark, tables):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    root = tables(documents=frame(spark, REPEATED).drop("a.b"), labels=labels)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns
        assert all(r[c] == f"{c}-{r.tag}" for r in out.collect() for c in NAMES if c != "a.b")
