import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from skyframe.llm import licenses
from skyframe.llm.common import QUERIES

from .conftest import ODD_ROWS


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = sorted(p for p, _ in places)
    return len(words), len(places), starts[0] if starts else None, starts[-1] if starts else None, ",".join(sorted({x for _, x in places}))


@given(st.lists(st.sampled_from(["mit", "license", "MIT", "cc", "by", "CC-BY", "apache", "gnu general public license", "GPL", "é", "x1", "\n", "--", "İ"])).map(" ".join))
def test_base_equals_brute_force(text):
    out = licenses.scan(text)
    assert out[:5] == brute(text)
    assert set(filter(None, out[4].split(","))) <= set(out[5].split(",")) | {""} and 0 <= out[6] <= 1


@pytest.mark.parametrize(
    ("expression", "order", "families", "openness"),
    [
        ("MIT OR GPL-3.0-only", ["MIT", "GPL-3.0-only", "or"], {"mit", "gpl"}, 0.95),
        ("MIT AND (GPL-2.0+ OR Apache-2.0)", ["MIT", "GPL-2.0+", "Apache-2.0", "or", "and"], {"mit", "gpl", "apache"}, 0.9),
        ("GPL-2.0 WITH Classpath-exception-2.0 OR AGPL-3.0", ["GPL-2.0", "Classpath-exception-2.0", "with", "AGPL-3.0", "or"], {"gpl", "agpl"}, 0.65),
        ("MIT or", ["MIT", "or"], {"mit"}, 0.95),
        ("((BSD-3-Clause)) */ more text", ["BSD-3-Clause"], {"bsd"}, 0.95),
        ("", [], set(), None),
    ],
)
def test_expressions(expression, order, families, openness):
    assert licenses.postfix(expression) == order
    names, value = licenses.evaluate(expression)
    assert names == families and (value == openness if openness is None else value == pytest.approx(openness))


def test_tags_and_notices():
    assert licenses.scan("x\n// SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1 -- \ny")[5] == "apache,lgpl,mit"
    assert licenses.scan("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by", "cc-by,cc-by-nc")
    assert licenses.scan("All rights reserved. MIT License")[6] == 0.0


def test_rows(spark, odd_documents, no_documents, tables):
    rows = QUERIES["op7_licenses"](spark, tables(documents=odd_documents)).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_base) for r in rows) == sorted((x[0] or -1, *brute(x[1])[:2]) for x in ODD_ROWS)
    assert licenses.scan_licenses(no_documents).count() == 0
