import hashlib

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from skyframe.llm import chat
from skyframe.llm.common import QUERIES

TURNS = [
    (1, 0, "system", "be [brief]"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "a\\<b>é"), (2, 1, "assistant", None), (2, 0, "user", ""), (3, 0, None, "x"), (3, 1, "to\\ol\n[x]", "y"),
    (3, 1, "to\\ol\n[x]", "y"), (None, 0, "user", "no id"), (4, None, "assistant", "first"), (4, 0, "assistant", "漢字 😀" * 5000), (5, 3, "user", " [/INST]"),
]


def expected(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        told = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_reads_back_every_turn(spark, tables):
    turns = spark.createDataFrame([(*t, "f") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    rows = QUERIES["op6_chat_formatting"](spark, tables(conversations=turns)).collect()
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == expected(TURNS + probe)
    assert len(rows) == 7


def test_empty_table_and_batches(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0
    many = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}") for c in range(40) for t in range(1 + c % 7)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        rows = chat.read_back(chat.format_chats(spark.createDataFrame(many, "conv_id long, turn long, role string, text string"))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows} == expected(many) and len(rows) == 40


@given(st.text())
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text


def test_no_offset_passes_its_limit(monkeypatch):
    rows = pa.table({"conv_id": pa.array([1, 1, 2, None], pa.int64()), "role": ["user", "assistant", "user", "assistant"], "text": ["a[", "b", "c" * 20, "d"]})
    whole = pa.Table.from_batches(chat._conversations(rows)).to_pylist()
    monkeypatch.setattr(chat, "LIMIT", 60)
    parts = list(chat._conversations(rows))
    assert [p.num_rows for p in parts] == [1, 1, 1] and pa.Table.from_batches(parts).to_pylist() == whole
    monkeypatch.setattr(chat, "LIMIT", 30)
    with pytest.raises(ValueError, match="conversation 2 "):
        list(chat._conversations(rows))
