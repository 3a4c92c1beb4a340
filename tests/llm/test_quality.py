import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from skyframe.llm import quality, tokens
from skyframe.llm.common import QUERIES

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_quality"](spark, ROOT).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{ROOT}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    held = [(r.predicted, labels[i]) for i, r in rows.items() if r.held_out and i in labels]
    assert np.mean([p == y for p, y in held]) > 0.93


def test_labels_of_the_held_out_quarter_are_not_read(spark, tables):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet").limit(300).cache()
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (QUERIES["op5_quality"](spark, tables(documents=docs, labels=x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark, odd_documents, no_documents, tables):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = QUERIES["op5_quality"](spark, tables(documents=odd_documents, labels=labels)).collect()
    assert len(rows) == odd_documents.count() and len({r.score for r in rows}) == 1
    kept = quality.keep_good(odd_documents, spark.read.parquet(f"{ROOT}/labels.parquet"), 0.0)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()
    assert quality.keep_good(no_documents, labels).count() == 0


def test_temperature_and_training():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    net = quality.train(x, y)
    assert np.mean((net.scores(x) > 0.5) == y) > 0.9 and net.temperature > 0
    assert quality.train(x, np.ones(600)).scores(x[:2]).tolist() == [601 / 602] * 2


def test_token_hashes_equal_per_token_hashes():
    texts = ["ab  ab, 12é", "", "é ab12", " "]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    h, begins = tokens.token_hashes(raw, offsets, tokens.PIECES)
    assert begins.tolist() == [0, 5, 5, 8, 8]
    ab, comma, twelve, e = h[0], h[2], h[3], h[4]
    assert h.tolist() == [ab, ab, comma, twelve, e, e, ab, twelve]
    assert len({int(ab), int(comma), int(twelve), int(e)}) == 4
    got = [(i, j) for i, j, _, _ in tokens.buffers(pa.array(["x" * 700_000, None, "y" * 700_000, "z"]))]
    assert got == [(0, 2), (2, 4)]
