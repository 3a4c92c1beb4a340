import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyframe.llm import packing
from skyframe.llm.common import QUERIES

from .conftest import ODD_ROWS

tokenizers = pytest.importorskip("tokenizers")


def ids_of(text):
    t = tokenizers.Tokenizer.from_file(packing.tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing_equals_brute_force(lengths):
    lengths = sorted(lengths, reverse=True)
    left, want = [], []
    for n in lengths:
        fits = [(c, -i) for i, c in enumerate(left) if c >= n]
        tight = min(fits)[0] if fits else None
        want.append(tight)
        if fits:
            left[-min(fits)[1]] -= n
        else:
            left.append(64 - n)
    number, offset = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    got = np.bincount(number, weights=lengths) if lengths else np.zeros(0)
    assert sorted((64 - got).astype(int).tolist()) == sorted(left)
    assert all(o == (0 if w is None else 64 - w) for o, w in zip(offset.tolist(), want))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_word_encoder_equals_tokenizer(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["a\x1fb \x1f c", "x<|endoftext|>y  z\x1c\xa0q"]
    ids, starts = packing.encoder(packing.tokenizer_path())(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == [ids_of(t) for t in texts]


def check_pieces(rows, texts):
    """Every id in exactly one piece; sequences gapless and within the window."""
    parts, sequences = {}, {}
    for r in rows:
        parts.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
    for doc, text in texts.items():
        ids = np.array(ids_of(text), "<u4")
        own = sorted(set((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in parts[doc]))
        assert sum(p[1] for p in own) == len(ids) and own[0][3] == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc, _ in own)


def test_odd_rows(spark, odd_documents, no_documents, tables):
    rows = QUERIES["op1_packing"](spark, tables(documents=odd_documents)).collect()
    check_pieces(rows, {r[0]: r[1] for r in ODD_ROWS})
    assert sum(r.doc_id == 7 for r in rows) == 2
    assert packing.pack(no_documents).count() == 0


def test_little_padding_and_sequences(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('token ', int(5 + (id * 7919) % 2500))").alias("text"))
    out = packing.pack(docs, with_ids=True).cache()
    assert out.agg(F.sum("length")).first()[0] >= 0.97 * packing.WINDOW * out.select("sequence_id").distinct().count()
    for r in packing.sequences(out).limit(50).collect():
        assert len(r.ids) == (r.filled if r.filled & (r.filled - 1) == 0 else packing.WINDOW)
