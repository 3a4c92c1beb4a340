import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from skyframe.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(t)] for c, t in convs.items()}
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5
        seqs[c] = tuple(convs.get(c - base, [])[:h] + own[h:])
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    nodes = set(members)
    kids = defaultdict(list)
    for s in nodes:
        if s:
            kids[s[:-1]].append(s)
    below = {}
    for s in sorted(nodes, key=len, reverse=True):
        saved = (len(members[s]) - 1) * (len(s[-1][1].encode()) if s else 0)
        below[s] = (saved + sum(below[k][0] for k in kids[s]), sum(below[k][1] for k in kids[s]) or 1)
    out = []
    for s in nodes:
        ends = ",".join(map(str, sorted(c for c in members[s] if len(seqs[c]) == len(s))))
        parent = min(members[s[:-1]]) if s else None
        out.append((min(members[s]), len(s), parent, len(members[s]), len(kids[s]), below[s][1], below[s][0], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def conversations():
    """Copies, shared beginnings, ties, repeated rows, nulls, a long conversation and one without turns."""
    r = random.Random(5)
    rows = [(None, 0, "user", "no number"), (None, None, None, None), (1003, 1, "user", "cut away: its base is absent")]
    for c in range(-12, 90):
        n = r.randint(1, 6)
        style = r.randint(0, 3)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if style else r.randint(0, 9)} ä") for t in range(n)]
    rows += [(201, t, "user", "the same") for t in range(40)] + [(202, t, "user", "the same") for t in range(40)] + [(203, t, "user", "the same") for t in range(37)]
    rows += [(300, None, "user", "x"), (300, None, None, None), (300, None, "user", "x"), (300, 2, "user", None), (301, 2, None, "late"), (301, None, "", "early")]
    return rows


def test_against_brute_force(spark, tables, conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    monkeypatch.setattr(prefix_trie, "PIECE", 4)
    schema = "conv_id long, turn long, role string, text string, block string, `key` string, depth string, place string"
    df = spark.createDataFrame([(*x, "a", "b", "c", "d") for x in conversations], schema).repartition(5)
    assert found(prefix_trie.op11_prefix_trie(spark, tables(conversations=df))) == brute(conversations)


def test_identical_conversations_collapse(spark, tables):
    rows = [(5 * c, t, "user", f"t{t}") for c in range(60) for t in range(3)]
    out = found(prefix_trie.op11_prefix_trie(spark, tables(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    assert out == brute(rows) and len(out) == 4


def test_as_they_are(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (2, 1, "u", "c"), (3, 0, "u", "a")]
    out = prefix_trie.trie(*prefix_trie.as_they_are(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in out) == [(1, 0, 3, 1, 2, 2), (1, 1, 3, 2, 2, 2), (1, 2, 1, 0, 1, 0), (2, 2, 1, 0, 1, 0)]


def test_no_conversations(spark, tables):
    root = tables(conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert prefix_trie.op11_prefix_trie(spark, root).collect() == []
