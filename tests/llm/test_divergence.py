import random
import re
from collections import Counter, defaultdict

import numpy as np

from skyframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """From (text, lang, source)."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(LOWER))
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        df[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        whole = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, 200)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items)]
    return sorted(out)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_against_brute_force(spark):
    r = random.Random(1)
    words = [f"{a}{b}" for a in ("Na", "ko", "ÄLÜ", "ti", "漢") for b in ("ra", "so", "ß", "Mi", "")] + ["one", "Two2three"]
    rows = [(" ".join(r.choices(words, weights=range(1, len(words) + 1), k=r.randint(0, 60))), r.choice(["en", "de", None]), r.choice(["a", "b", "c", "d", None])) for _ in range(150)]
    rows += [("only here", "xx", "a"), ("", "xx", "b"), (None, "yy", "z")] + [("hot term " * 50, "en", "a")] * 60
    df = spark.createDataFrame([(i, *x, "n", "s") for i, x in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, place string").repartition(6)
    assert found(divergence.audit(df)) == brute(rows)


def test_many_terms_keep_the_top_ranks(spark):
    rows = [(" ".join(f"w{'abcdefghij'[i // 100]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i % 10]}" for i in range(k, 700, 2)), "en", "ab"[k]) for k in (0, 1) for _ in range(3)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert found(divergence.audit(df)) == brute(rows)


def test_a_long_text_is_one_document(spark):
    r = np.random.default_rng(2)
    names = np.array(["".join(x) for x in r.choice(list("abcdefgh"), (40, 5))])
    long = " ".join(names[r.integers(0, 40, 1_200_000)])
    assert len(long) > divergence.CHUNK_BYTES
    rows = [(long, "en", "a"), (" ".join(names[:5]), "en", "b"), (" ".join(names[:4]), "en", "b"), ("x" * 5_000_000, "en", "b")]
    assert found(divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string"))) == brute(rows)


def test_odd_rows_and_no_rows(spark, odd_documents, no_documents):
    assert found(divergence.audit(odd_documents)) == brute([(r.text, r.lang, r.source) for r in odd_documents.collect()])
    assert divergence.audit(no_documents).collect() == []


def test_the_tree_equals_all_pairs():
    r = np.random.default_rng(3)
    paths = sorted({tuple((int(s), int(r.integers(5, 9)) * 10**6) for s in np.flatnonzero(r.random(7) < 0.5)) for _ in range(200)})
    paths = [p for p in paths if p]
    weight = r.integers(1, 9, len(paths))
    zero = np.arange(1, 8) * 1000
    flat = [e for p in paths for e in p]
    source, share = np.array([e[0] for e in flat]), np.array([e[1] for e in flat])
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    a, b, high, low = divergence.tree_corrections(source, share, zero[source], offsets, weight)
    got = {(i, j): (h << 32) + k for i, j, h, k in zip(a.tolist(), b.tolist(), high.tolist(), low.tolist())}
    f = lambda p, q: (p - q) ** 2 // q
    want = Counter()
    for p, w in zip(paths, weight.tolist()):
        for s, x in p:
            for o, y in p:
                if s != o:
                    zs, zo = int(zero[s]), int(zero[o])
                    want[s, o] += w * (f(x, y) - f(x, zo) - f(zs, y) + f(zs, zo))
    assert got == dict(want)
