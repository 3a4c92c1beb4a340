"""License scans: Aho-Corasick over identifier tags and notice phrases, and licence expressions.

A text is lowered (A-Z) and read as words; one automaton per worker finds every place where the
words of a phrase stand consecutively.  Where it meets an identifier tag, the rest of that line is
read as a licence expression: a shunting-yard parser orders its ``and``, ``or`` and ``with`` and
evaluates it to the set of licence families and an openness between 0 and 1.  ``or`` leaves the
choice to the user (the most open term), ``and`` binds to all (the least open), ``with`` adds an
exception (half way to the next).  Notices of one document bind together.

Defined cases: null and empty texts have no words and no labels; texts of any length are read
whole; a broken expression gives the families it names; rows that repeat are scanned alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import query, table

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notice phrases and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "isc license": "isc",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "cc0": "cc0",
    "public domain": "public-domain",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc",
    "cc by nc nd": "cc-by-nc",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Openness of each family.
OPENNESS = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl": 0.95, "zlib": 0.95, "apache": 0.9, "cc-by": 0.85,
    "mpl": 0.6, "epl": 0.6, "cc-by-sa": 0.5, "lgpl": 0.5, "gpl": 0.3, "cc-by-nd": 0.25, "agpl": 0.2, "cc-by-nc": 0.15, "proprietary": 0.0,
}
UNKNOWN = 0.1

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAG_LINE = re.compile(r"spdx[^\w\n]{1,3}license[^\w\n]{1,3}identifier\s*:?[ \t]*([^\n]*)", re.I)
_TERM = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The family of a licence identifier such as ``Apache-2.0``."""
    name = identifier.lower().rstrip("+.-")
    for known in sorted(OPENNESS, key=len, reverse=True):
        if name == known or name.startswith(known + "-") or name == known + "-only":
            return known
    return "cc0" if name.startswith("cc0") else "bsl" if name.startswith("boost") else name


def postfix(expression: str) -> list[str]:
    """Shunting-yard: terms and operators of a licence expression in postfix order.

    Reading stops where an operand follows an operand: the tag's line goes on with other text.
    """
    out: list[str] = []
    held: list[str] = []
    operand = False
    for m in _TERM.finditer(expression):
        token, word = m[0], m[0].lower()
        if word in _BINDS:
            if not operand:
                continue
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand = False
        elif token == "(":
            if operand:
                break
            held.append(token)
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if held:
                held.pop()
        else:
            if operand:
                break
            out.append(token)
            operand = True
    out += [x for x in reversed(held) if x != "("]
    return out


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """(families, openness) of an expression; openness is None if it names nothing."""
    stack: list[tuple[set[str], float, str]] = []
    for token in postfix(expression):
        if token not in _BINDS:
            name = family(token)
            stack.append(({name}, OPENNESS.get(name, UNKNOWN), token))
        elif len(stack) > 1:
            (names2, open2, _), (names1, open1, first) = stack.pop(), stack.pop()
            if token == "with":
                stack.append((names1, (1 + open1) / 2, first))
            else:
                stack.append((names1 | names2, (max if token == "or" else min)(open1, open2), first))
    if not stack:
        return set(), None
    return set().union(*(s[0] for s in stack)), min(s[1] for s in stack)


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE | {TAG: ""}).items():
        a.add_word(f" {phrase} ", (phrase, label))
    a.make_automaton()
    return a


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    line = (b" " + b" ".join(parts) + b" ").decode("latin-1")
    base: list[tuple[int, str]] = []
    found: dict[str, float] = {}
    bounds: list[float] = []
    tagged = False
    for end, (phrase, label) in automaton().iter(line):
        if not label:
            tagged = True
            continue
        found[label] = OPENNESS[label]
        if phrase in BASE:
            base.append((end - len(phrase) - 1, label))
    bounds += found.values()
    if tagged:
        for m in _TAG_LINE.finditer(text):
            names, openness = evaluate(m[1])
            found |= {n: OPENNESS.get(n, UNKNOWN) for n in names}
            if openness is not None:
                bounds.append(openness)
    places, at, seen = [], 0, 0
    for begin, _ in sorted(base):
        seen += line.count(" ", at, begin)
        at = begin
        places.append(seen)
    return (
        len(parts), len(places), places[0] if places else None, places[-1] if places else None,
        ",".join(sorted({label for _, label in base})), ",".join(sorted(found)), min(bounds) if bounds else 0.0,
    )


SCANNED = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row of findings per row of ``docs`` (doc_id, text)."""
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
    names = [c.split()[0] for c in SCANNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t.as_py()) for t in batch.column(1)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCANNED)


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
