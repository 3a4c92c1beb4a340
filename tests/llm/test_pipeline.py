import re

import numpy as np
import pytest

import corpus_pipeline
from .conftest import ODD_ROWS
from .test_mixing import targets
from .test_near_dedup import brute
from .test_packing import check_pieces

ROOT = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output rows of each stage on the smallest table."""
    root, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, ROOT).write.parquet(f"{root}/{len(out)}")
        after = spark.read.parquet(f"{root}/{len(out)}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_return_documents(steps):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _, _ in steps] == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    assert all(after.columns == names for _, _, after in steps[:-1])


def test_exact_and_near_stage_against_brute_force(steps):
    rows = [(r.doc_id, r.text) for r in steps[1][1].collect()]
    last = {}
    for i, t in rows:
        last[t or ""] = max(i, last.get(t or "", -1))
    assert sorted(r.doc_id for r in steps[1][2].collect()) == sorted(last.values())
    rows = [(r.doc_id, r.text) for r in steps[2][1].collect()]
    want, _ = brute(rows, 5)
    assert sorted(r.doc_id for r in steps[2][2].collect()) == sorted({c for c in want.values()})


def test_mixing_stage_meets_targets(steps):
    before, after = steps[3][1].collect(), steps[3][2].collect()
    sizes, taken, most = {}, {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
        most[r.source] = max(most.get(r.source, 0), words(r.text))
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + words(r.text)
    assert all(abs(taken.get(s, 0) - t) <= most[s] for s, t in targets(sizes).items())


def test_packing_stage_and_run(spark, steps):
    mixed, packed = steps[4][1].collect(), steps[4][2].collect()
    check_pieces(packed, {r.doc_id: r.text for r in mixed})
    run = corpus_pipeline.run(spark, ROOT)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, packed))


def test_rejected_documents_go(spark, steps):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[0][2].collect()}
    told = [(i in kept, y == 1) for i, y in labels.items()]
    assert np.mean([a == b for a, b in told]) > 0.9


def test_odd_rows_pass_every_stage(spark, odd_documents, no_documents, tables):
    labels = spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd_documents, no_documents):
        root = tables(documents=docs, labels=labels)
        read = spark.read.parquet(f"{root}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, read, root).columns == read.columns
        out = corpus_pipeline.run(spark, root)
        assert {r.doc_id for r in out.collect()} <= {r[0] for r in ODD_ROWS}
