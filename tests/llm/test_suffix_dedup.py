import hashlib
import random

import numpy as np

from skyframe.llm import suffix_dedup


def brute(rows):
    """From (doc_id, text)."""
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        if i is not None:
            for k in range(len(raw) - 49):
                g = raw[k : k + 50]
                first[g] = min(i, first.get(g, i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        if i is not None:
            for k in range(len(raw) - 49):
                if first[raw[k : k + 50]] < i:
                    gone[k : k + 50] = True
        gone = gone[:-1] if len(raw) else np.zeros(0, bool)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def planted(seed):
    """Texts that share passages of 45 to 200 characters, at borders, overlapping, repeated, with few letters."""
    r = random.Random(seed)
    word = lambda n, letters="abcdefghijklmno é": "".join(r.choices(letters, k=n))
    passages = [word(r.randint(45, 200)) for _ in range(12)] + [word(50), word(49), word(51), "z" * 70, "ab" * 40, "abc" * 30]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            k = r.choice([0, 0, 0, r.randint(0, 20)])
            parts += [word(r.choice([0, 1, 3, 30, 80])), p[k : len(p) - r.choice([0, 0, k])]]
        rows.append((i, "".join(parts)))
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = planted(seed)
        df = spark.createDataFrame([(*x, "a", "b") for x in rows], "doc_id long, text string, `row` string, shard string").repartition(4)
        assert found(suffix_dedup.repeats(df)) == brute(rows)


def test_many_shards_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 300)
    rows = planted(3)
    assert found(suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_rows_of_one_id_nulls_and_copies(spark):
    a, b = "".join(map(chr, range(97, 123))) * 3, "0123456789" * 9
    rows = [(None, a), (None, None), (1, a), (1, a), (1, a + b), (2, a), (2, b), (2, b + a), (3, b), (3, None), (4, ""), (5, a[:49]), (6, a[:50])] + [(i, a + b) for i in range(10, 60)]
    assert found(suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_texts_longer_than_a_piece(spark):
    r = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz   ", np.uint8)
    text = lambda n: letters[r.integers(0, len(letters), n)].tobytes().decode()
    big, other, flat = text(700_000), text(600_000), "q" * 300_000
    assert len(other) > 2 * suffix_dedup.PIECE
    cut = suffix_dedup.PIECE
    rows = [(1, big), (2, other[: cut - 30] + big[1000:1060] + other[cut - 30 :]), (3, big[600_000:] + other[100:300_000]), (4, flat), (5, flat + "x"), (6, big[5:])]
    assert found(suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_names_tell_swapped_bytes_apart():
    base = np.arange(40, 40 + suffix_dedup.GRAM, dtype=np.uint8)
    names = {int(suffix_dedup.gram_names(base)[0])}
    for i in range(suffix_dedup.GRAM):
        for j in range(i):
            other = base.copy()
            other[i], other[j] = base[j], base[i]
            names.add(int(suffix_dedup.gram_names(other)[0]))
    assert len(names) == 1 + suffix_dedup.GRAM * (suffix_dedup.GRAM - 1) // 2


def test_texts_that_differ_by_swapped_letters(spark):
    """Copies of one text in which every swap of two letters eight places apart is made once."""
    r = random.Random(5)
    text = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=110))
    swapped = lambda i: text[:i] + text[i + 8] + text[i + 1 : i + 8] + text[i] + text[i + 9 :]
    rows = [(0, text)] + [(i + 1, swapped(i)) for i in range(len(text) - 8)]
    assert found(suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_long_texts_among_short_ones(spark):
    """A shard's texts keep their order when one of them is longer than a piece."""
    r = np.random.default_rng(6)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz   ", np.uint8)
    text = lambda n: letters[r.integers(0, len(letters), n)].tobytes().decode()
    shared = [text(60) for _ in range(6)]
    rows = [(2 * i, text(40) + shared[i % 6][: 52 + i % 9] + text(40)) for i in range(40)]
    rows += [(2 * i + 1, text(70_000) + shared[i % 6] + text(3000) + shared[(i + 1) % 6][3:] + text(9)) for i in range(0, 40, 7)]
    assert found(suffix_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_odd_rows_and_no_rows(spark, odd_documents, no_documents):
    assert found(suffix_dedup.repeats(odd_documents)) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])
    assert suffix_dedup.repeats(no_documents).collect() == []


def test_texts_without_repeats(spark):
    a = "The same long passage stands in both of these documents, ünd it is 漢字 long."
    rows = [(1, "one " + a), (2, "two " + a + " end"), (None, a)]
    out = {r.doc_id: r.text for r in suffix_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == rows[0][1] and out[None] == a and out[2] == "two end"
