"""Source divergence audit over a frequent-pattern tree of term rows.

Each language keeps the terms of at least ``least`` documents; a group (language, source) gives a
term the scaled smoothed share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``.  The divergence of
a group from another source of its language sums ``f(p, q) = floor((p - q)**2 / q)`` over all kept
terms.  With z for the share of a term that does not occur,

    sum f(p, q) = V f(zp, zq)
                + over terms of the group:        f(p, zq) - f(zp, zq)
                + over terms of the other source: f(zp, q) - f(zp, zq)
                + over terms of both:             f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq)

The first sums need only how often each share occurs in a group.  The last is taken on the tree: a
term's row lists its nonzero shares in order of source, equal rows are one with a multiplicity, and
rows are inserted in order of path.  A node is a shared path, its weight the multiplicity of all
rows through it; every node meets each of its ancestors once, with that weight.  Rows are dealt by
range of path, so shared paths meet in one task, and a task builds a tree per batch of rows.

All arithmetic is exact: shares by long division, sums in two halves of 64-bit numbers and decimals.
A term's row has one entry per source that uses it; no other group is gathered.

Defined cases: null text, lang and source are ''; rows that repeat count each; a text of any length
is cut between terms and counts as one document; groups without terms are groups; a language without
kept terms has pair values 0; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.common import query, table
from skyframe.llm.tokens import byte_table
from skyframe.session import cut

SCALE = 1_000_000_000
#: Text bytes counted at once, and node-ancestor combinations worked on at once.
CHUNK_BYTES = 1 << 22
COMBINATIONS = 1 << 19
#: Copies of a language's groups in the join with the occurring shares.
SALTS = 16
LETTERS = byte_table(0, c1=bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))).astype(bool)


def _runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The terms of a buffer of texts, and the text of each."""
    letter = LETTERS[raw]
    edge = np.diff(np.concatenate([[False], letter]).astype(np.int8)) == 1
    inside = offsets[:-1][offsets[:-1] < len(raw)]
    edge[inside] = letter[inside]
    starts = np.flatnonzero(edge)
    upto = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
    ends = np.concatenate([upto[starts], upto[-1:]]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw[letter]))
    return pc.ascii_lower(terms), np.searchsorted(offsets, starts, side="right") - 1


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in pieces that end between terms."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + CHUNK_BYTES)
        while end < len(raw):
            free = np.flatnonzero(~LETTERS[raw[end : end + CHUNK_BYTES]])
            if len(free):
                end += int(free[0])
                break
            end = min(len(raw), end + CHUNK_BYTES)
        yield raw[at:end]
        at = end


def _counted(terms: pa.StringArray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, term, row, occurrences) of each distinct (row, term)."""
    coded = terms.dictionary_encode()
    width = max(1, len(coded.dictionary))
    pairs, times = np.unique(rows.astype(np.int64) * width + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, pairs % width, pairs // width, times


def _summed(groups: np.ndarray, names: pa.Array, term: np.ndarray, row: np.ndarray, times: np.ndarray, lang: pa.Array, source: pa.Array) -> pa.RecordBatch:
    """Occurrences and documents per (group, term); ``groups`` has the group of each row."""
    width = max(1, len(names))
    key, first, back, docs = np.unique(groups[row] * width + term, return_index=True, return_inverse=True, return_counts=True)
    counts = np.zeros(len(key), np.int64)
    np.add.at(counts, back, times)
    at = pa.array(row[first])
    return pa.RecordBatch.from_arrays([lang.take(at), source.take(at), names.take(pa.array(key % width)), pa.array(counts), pa.array(docs.astype(np.int64))], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) partly summed, from (text, lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lang, source = batch.columns
            if not len(texts):
                continue
            own = pc.add(pc.multiply(pc.cast(lang.dictionary_encode().indices, pa.int64()), len(texts)), pc.cast(source.dictionary_encode().indices, pa.int64())).to_numpy()
            groups = np.unique(own, return_inverse=True)[1].astype(np.int64)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = texts.buffers()[2]
            raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
                chunk = raw[offsets[i] : offsets[j]]
                if len(chunk) <= CHUNK_BYTES:
                    terms, rows = _runs(chunk, offsets[i : j + 1] - offsets[i])
                    yield _summed(groups[i:j], *_counted(terms, rows), lang.slice(i, j - i), source.slice(i, j - i))
                else:  # one long text: its distinct terms are summed over pieces, so that it counts as one document
                    held = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
                    for piece in _pieces(chunk):
                        terms, rows = _runs(piece, np.array([0, len(piece)]))
                        names, term, _, times = _counted(terms, rows)
                        held = pa.concat_tables([held, pa.table({"term": names.take(pa.array(term)), "n": pa.array(times.astype(np.int64))})])
                        held = held.group_by("term").aggregate([("n", "sum")]).rename_columns(["term", "n"])
                    names = held.column("term").combine_chunks()
                    yield _summed(groups[i:j], names, np.arange(len(names)), np.zeros(len(names), np.int64), held.column("n").to_numpy(), lang.slice(i, 1), source.slice(i, 1))
                i = j

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain("text"), plain("lang"), plain("source")).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _share(count: Column | str, base: str) -> Column:
    return F.expr(f"1 + (cast({SCALE} as decimal(38,0)) * ({count} + 1)) div {base}")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})")


def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tree_corrections(source: np.ndarray, share: np.ndarray, zero: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, other, high, low) halves of the corrections of terms in both, from rows in order of path.

    Row r has the entries ``offsets[r]:offsets[r + 1]``; rows with equal prefixes must be neighbours.
    """
    length = np.diff(offsets)
    rows = len(length)
    # the length of the prefix that a row shares with the row before: its first entry that differs
    shared = np.zeros(rows, np.int64)
    if rows > 1:
        least = np.minimum(length[1:], length[:-1])
        at = np.repeat(offsets[1:-1] - np.concatenate([[0], np.cumsum(least)[:-1]]), least) + np.arange(least.sum())
        prior = np.repeat(offsets[:-2] - np.concatenate([[0], np.cumsum(least)[:-1]]), least) + np.arange(least.sum())
        differs = (source[at] != source[prior]) | (share[at] != share[prior])
        depth = at - np.repeat(offsets[1:-1], least)
        first = np.full(rows - 1, np.iinfo(np.int64).max)
        np.minimum.at(first, np.repeat(np.arange(rows - 1), least)[differs], depth[differs])
        shared[1:] = np.minimum(first, least)
    # nodes: entries beyond the shared prefix, weighted by all rows up to the next that leaves the path
    node_row, node_depth, node_weight = [], [], []
    for d in range(int(length.max(initial=0))):
        leaves = np.flatnonzero(shared <= d)
        total = np.add.reduceat(weight, leaves)
        real = length[leaves] > d
        node_row.append(leaves[real])
        node_depth.append(np.full(real.sum(), d))
        node_weight.append(total[real])
    row, depth, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (node_row, node_depth, node_weight))
    found: dict[tuple[int, int], list[int]] = {}
    upto = np.concatenate([[0], np.cumsum(depth)])
    width = int(source.max(initial=0)) + 1
    i = 0
    while i < len(row):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + COMBINATIONS, side="right")) - 1)
        n = depth[i:j]
        own = np.repeat(offsets[row[i:j]] + n, n)
        above = np.repeat(offsets[row[i:j]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        w = np.repeat(times[i:j], n)
        for a, b in ((own, above), (above, own)):
            value = f(share[a], share[b]) - f(share[a], zero[b]) - f(zero[a], share[b]) + f(zero[a], zero[b])
            pair, back = np.unique(source[a] * width + source[b], return_inverse=True)
            high, low = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
            np.add.at(high, back, (value >> 32) * w)
            np.add.at(low, back, (value & 0xFFFFFFFF) * w)
            for p, h, k in zip(pair.tolist(), high.tolist(), low.tolist()):
                got = found.setdefault((p // width, p % width), [0])
                got[0] += (h << 32) + k
        i = j
    keys = np.array(list(found), np.int64).reshape(-1, 2)
    values = [x[0] for x in found.values()]
    return keys[:, 0], keys[:, 1], np.array([v >> 32 for v in values], np.int64), np.array([v & 0xFFFFFFFF for v in values], np.int64)


def _tree(paths: DataFrame) -> DataFrame:
    """(lang, a, b, high, low) from (lang, path, weight) in order of path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_numpy(zero_copy_only=False)
            begins = np.append(np.flatnonzero(np.concatenate([[True], langs[1:] != langs[:-1]])), len(langs)) if len(langs) else [0]
            for i, j in zip(begins[:-1], begins[1:]):
                path = batch.column(1).slice(i, j - i)
                entries = path.flatten()
                offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(path).to_numpy())]).astype(np.int64)
                source, share, zero = (pc.struct_field(entries, k).to_numpy().astype(np.int64) for k in range(3))
                a, b, high, low = tree_corrections(source, share, zero, offsets, batch.column(2).slice(i, j - i).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array([langs[i]] * len(a), pa.string()), pa.array(a), pa.array(b), pa.array(high), pa.array(low)], ["lang", "a", "b", "high", "low"])

    return paths.mapInArrow(run, "lang string, a bigint, b bigint, high bigint, low bigint")


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): divergences from other sources, and the ``top`` terms above the language."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("used"))
    terms = cut(terms.where(F.col("docs") >= least).drop("docs"))
    per_lang = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    per_group = terms.select("lang", F.explode("used").alias("u")).groupBy("lang", "u.source").agg(F.sum("u.n").alias("n"))
    groups = docs.select(plain("lang"), plain("source")).distinct().join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left")
    groups = groups.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint"))
    # a language without kept terms divides by 1, and nothing by that
    base = lambda n: F.greatest(F.coalesce(n, F.lit(0)) + F.coalesce("v", F.lit(0)), F.lit(1))
    groups = groups.withColumns({"base": base(F.col("n")), "lang_base": base(F.col("lang_n")), "v": F.coalesce("v", F.lit(0))})
    groups = cut(groups.withColumn("zero", _share("0", "base")).select("lang", "source", "place", "base", "lang_base", "v", "zero"))

    # one row per language with what its terms need
    known = cut(groups.groupBy("lang").agg(
        F.map_from_entries(F.collect_list(F.struct("source", F.struct("place", "base", "zero")))).alias("known"), F.max("lang_base").alias("lang_base"),
    ))
    used = terms.join(known, "lang").withColumn("q", _share("n", "lang_base"))
    used = used.withColumn("path", F.expr(
        f"transform(used, u -> struct(known[u.source].place as place, 1 + (cast({SCALE} as decimal(38,0)) * (u.n + 1)) div known[u.source].base as share, known[u.source].zero as zero, u.source as source))"
    ))
    used = cut(used.select("lang", "term", "q", F.sort_array("path").alias("path")))

    # terms above their language
    here = used.select("lang", "term", "q", F.explode("path").alias("u")).where("u.share > q").select("lang", "u.source", F.col("term").alias("item"), _apart("u.share", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = here.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    by_term = by_term.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # equal rows are one with a multiplicity, dealt by range of path
    paths = used.select("lang", F.expr("transform(path, u -> struct(u.place as place, u.share as share, u.zero as zero))").alias("path"))
    paths = cut(paths.groupBy("lang", "path").agg(F.count("*").alias("weight")))
    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path")
    both = _tree(ordered).groupBy("lang", "a", "b").agg((F.sum(F.col("high").cast("decimal(28,0)")) * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(F.col("low").cast("decimal(28,0)"))).cast("decimal(38,0)").alias("s"))

    # terms of one side, whatever the other: by how often each share occurs
    shares = paths.select("lang", "weight", F.explode("path").alias("u")).groupBy("lang", F.col("u.place").alias("a"), F.col("u.share").alias("p"), F.col("u.zero").alias("zp")).agg(F.sum("weight").alias("w"))
    others = groups.select("lang", F.col("place").alias("b"), F.col("zero").alias("zq"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = shares.withColumn("salt", F.pmod(F.xxhash64("a", "p"), F.lit(SALTS)).cast("int")).join(others, ["lang", "salt"]).where("a <> b")
    one = lambda c: F.sum(F.col("w") * c.cast("decimal(19,0)")).cast("decimal(38,0)")
    met = met.groupBy("lang", "a", "b").agg(one(_apart("p", "zq") - _apart("zp", "zq")).alias("out"), one(_apart("zq", "p") - _apart("zq", "zp")).alias("in"))
    pairs = both.unionByName(met.select("lang", "a", "b", F.col("out").alias("s"))).unionByName(met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("in").alias("s")))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("s").alias("s"))
    side = lambda x: groups.select("lang", F.col("place").alias(x), F.col("source").alias(f"{x}_source"), F.col("zero").alias(f"{x}_zero"), "v")
    # every group meets the other groups of its language: that is the result
    pairs = side("a").join(side("b").drop("v"), "lang").where("a <> b").join(pairs, ["lang", "a", "b"], "left")
    value = (F.col("v") * _apart("a_zero", "b_zero").cast("decimal(19,0)") + F.coalesce("s", F.lit(0))).cast("bigint")
    pairs = pairs.select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), F.when(F.col("v") > 0, value).otherwise(0).cast("bigint").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(by_term)


SQL = r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
t as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as n from t group by lang, term having count(distinct r) >= 3),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by lang, source, term),
langs as (select lang, count(*) as v, sum(n) as n from kept group by lang),
g as (select distinct lang, source from d),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0) as n from g left join c using (lang, source) group by g.lang, g.source),
p as (
  select gn.lang, gn.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (gn.n + l.v) as p,
         1 + (1000000000::hugeint * (k.n + 1)) // (l.n + l.v) as q
  from gn join kept k using (lang) join langs l using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source
  left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by a.lang, a.source, b.source),
terms as (
  select lang, source, term as item, (((p - q) * (p - q)) // q)::bigint as value from p where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all
select * from (
  select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from terms) where rank <= 200
"""


@query("op13_source_divergence", SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))
