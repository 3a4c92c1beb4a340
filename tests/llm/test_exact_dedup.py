import duckdb
from pyspark.sql import functions as F

from skyframe.llm import exact_dedup
from skyframe.llm.common import ORACLES, QUERIES

from .conftest import ODD_ROWS, sha


def test_odd_rows(spark, odd_documents, tables):
    out = QUERIES["op8_exact_dedup"](spark, tables(documents=odd_documents)).collect()
    groups = {}
    for r in ODD_ROWS:
        groups.setdefault(r[1] or "", []).append(r[0])
    want = sorted((i or -1, max(x or -1 for x in g), len(g), sha(t)) for t, g in groups.items() for i in g)
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256) for r in out) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)


def test_deduplicate_keeps_one_row_of_each_text(odd_documents, no_documents):
    out = exact_dedup.deduplicate(odd_documents)
    assert out.columns == odd_documents.columns
    rows = out.collect()
    assert sorted(r.text or "" for r in rows) == sorted({r[1] or "" for r in ODD_ROWS})
    assert {r.doc_id for r in rows if r.text == "the same text in two rows"} == {6}
    assert exact_dedup.deduplicate(no_documents).count() == 0


def test_index_persists_between_batches(spark):
    make = lambda rows: exact_dedup.digested(spark.createDataFrame(rows, "doc_id long, text string"))
    index = exact_dedup.DigestIndex(spark)
    index.add(make([(1, "a"), (2, "b"), (3, "a")]))
    index.add(make([(9, "a"), (8, "c")]))
    got = {r.digest: (r.keep_id, r.group_size) for r in exact_dedup.DigestIndex(spark, index.name, index.path, index.buckets).read().collect()}
    assert got == {sha("a"): (3, 2), sha("b"): (2, 1), sha("c"): (8, 1)}


def test_hot_text_and_sql(spark, tables):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 900)).alias("text"))
    root = tables(documents=docs)
    out = QUERIES["op8_exact_dedup"](spark, root)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{root}/documents.parquet/*.parquet'")
    res = con.execute(ORACLES["op8_exact_dedup"])
    names = [d[0] for d in res.description]
    assert sorted(tuple(r[c] for c in names) for r in out.collect()) == sorted(res.fetchall())
