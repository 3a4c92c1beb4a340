import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyframe.llm import near_dedup
from skyframe.llm.common import QUERIES

from .conftest import ODD_ROWS


def shingles(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent=80):
    """doc_id -> smallest doc_id it reaches, by all pairs."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}, {i: len(s) for i, s in sets}


def corpus(seed=5):
    """Originals, chains of edits around the threshold, exact copies and unrelated texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        text = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 40, 90, 200]))]
        for _ in range(rng.randint(1, 8)):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 12))):
                text[rng.randrange(len(text))] = rng.choice(vocab)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_equals_all_pairs(spark, width):
    rows = corpus()
    want, sizes = brute(rows, width)
    got = near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n for r in got} == sizes


def test_large_groups_keep_every_link(spark):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(700):
        t = list(base)
        for _ in range(3):
            t[rng.randrange(len(t))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, " ".join(base[:60] + [f"o{i}-{j}" for j in range(60)])) for i in range(80)]
    want, _ = brute([r for r in rows if r[0] < 60 or r[0] >= 1000], 2)
    got = {r.doc_id: r.component_id for r in near_dedup.near_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert all(got[i] == c for i, c in want.items())
    assert {got[i] for i in range(700)} == {0}


def test_odd_rows(spark, odd_documents, no_documents, tables):
    rows = QUERIES["op9_near_dedup"](spark, tables(documents=odd_documents)).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert len(rows) == len(ODD_ROWS)
    assert got[1] == (0, 1, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True)
    assert got[5][1] == got[6][1] == 5 and not got[6][2] and got[None][1] is None and got[8] == (1, 8, True)
    out = near_dedup.deduplicate(odd_documents)
    assert out.columns == odd_documents.columns
    assert sorted(r.doc_id or -1 for r in out.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert near_dedup.deduplicate(no_documents).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    text = lambda name, changed=0: " ".join(f"{name}{i}" for i in range(60 - changed)) + " end" * changed
    rows = [(1, text("a"), "s"), (2, text("a", 1), "s"), (2, text("b"), "s"), (2, text("c"), "s"), (3, text("c", 1), "s")]
    rows += [(4, text("d"), "s"), (4, text("d"), "s"), (5, "", "s"), (5, "", "t"), (5, "", "t"), (5, text("a"), "s"), (None, text("b"), "s"), (None, text("b"), "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kept = near_dedup.deduplicate(df)
    assert kept.columns == df.columns
    want = [rows[0], rows[2], rows[3], rows[5], rows[7], rows[8], rows[11], rows[12]]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    found = near_dedup.near_components(df.select("doc_id", "text"))
    got = sorted((r.doc_id or 0, r.n, r.component_id or 0) for r in found.collect())
    n = 56
    assert got == sorted([(1, n, 1), (2, n, 1), (2, n, 2), (2, n, 2), (3, n, 2), (4, n, 4), (4, n, 4), (5, 0, 5), (5, 0, 5), (5, 0, 5), (5, n, 1), (0, n, 0), (0, n, 0)])


def test_odd_sketch_estimates():
    rng = random.Random(2)
    words = [f"a{i}" for i in range(2000)]
    limit = near_dedup.most_differing(80)
    for share, links in ((0.95, True), (0.9, True), (0.2, False)):
        a = words[:1000]
        keep = int(1000 * share)
        b = a[:keep] + [f"z{rng.random()}" for _ in range(1000 - keep)]
        (_, shingle, begins), = near_dedup.shingle_sets(pa.array([" ".join(a), " ".join(b)]), 1)
        sketch = near_dedup.odd_sketches(near_dedup.minhashes(shingle, begins))
        differ = sum(bin(int(x)).count("1") for x in sketch[0] ^ sketch[1])
        assert (differ <= limit) == links


def test_components_of_paths(spark):
    n = 60
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(101, 100), (102, 101)], "a long, b long"))
    got = {r.v: r.component for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(n)} | {100: 100, 101: 100, 102: 100}
