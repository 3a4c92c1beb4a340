"""A sample of registered queries against their SQL twins, and the registry's own rules."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
SAMPLE = ["a01_sigma_clip_mean", "a01_tile_stack", "a06_transient", "a26_coverage_edges", "p09_lab_saturation", "p14_selective_colour", "w01_cull", "s02_frame_sets", "j06_cone_search", "j07_find_by_name", "f05_tolerant_recipe", "r04_step_plan", "t04_starlet_planes", "j18_ring_subtraction", "x01_frame_ledger", "x02_running_mean"]


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows), sorted(cols)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(ROOT).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, ROOT)
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(res.fetchall(), cols)


def test_every_comparison_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 640
