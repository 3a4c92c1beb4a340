"""Trie of conversation prefixes by whole-sequence collapse.

Identical conversations become one weighted sequence with the list of conversations that end there;
an anti-join against all proper prefixes leaves the sequences at leaves; every node's figures are
then sums over the weighted sequences that run through it, taken from their prefixes in one pass:

* members: the sum of weights;
* bytes of all members in a subtree: the sum of weight times the bytes from the node on;
* bytes of the distinct nodes in a subtree: each node is owned by the smallest leaf below it, the
  nodes a leaf owns are the end of its path, so the sum over leaves of their owned bytes.

No level is visited after another, and no group of sequences is gathered.  A prefix is named by its
depth and two sums of 64-bit hashes of (SHA-256 of role and text, place).  Conversations are numbered
in blocks of rows, so one that holds a third of all rows is spread like any other.  A list of ends is
joined in pieces of ``PIECE`` numbers; only its SHA-256, which has no parallel form, reads the pieces
one after the other as a stream.

Defined cases: rows are ordered by turn (null first), then role, then text, and repeated rows are
repeated turns; null role and text are empty; rows with a null ``conv_id`` belong to no conversation;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.functions.scan import blocked, block_sums
from skyframe.llm.common import attach, query, table
from skyframe.session import cut

#: Turns of a conversation in one block, and conversation numbers in one piece of a list of ends.
BLOCK = 4096
PIECE = 4096
#: A conversation shares at most this many leading turns with its base.
MOST_SHARED = 8


def _crc(c: str) -> Column:
    return F.crc32(F.col(c).cast("string").cast("binary"))


def _turns(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), text("role").alias("role"), text("text").alias("text")).where("conv_id is not null")


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, block, local, digest, bytes), (conv_id, block, before, n)): local plus before is a turn's place."""
    order = ["turn", "role", "text"]
    rows = blocked(_turns(turns), ["conv_id"], order)
    local = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(*order)).cast("bigint")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.select("conv_id", "block", local.alias("local"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("bytes"))
    return rows, cut(block_sums(rows, ["conv_id"], {"before": F.lit(1)}, {"n": F.lit(1)}))


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, place, digest, bytes), (conv_id, n)) of conversations as the table has them."""
    rows, offsets = numbered(turns)
    placed = rows.join(offsets, ["conv_id", "block"]).select("conv_id", (F.col("local") + F.col("before")).alias("place"), "digest", "bytes")
    return placed, offsets.select("conv_id", "n").distinct()


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like :func:`as_they_are`, with the first turns of c from conversation c - c % 5.

    c takes that one's first h turns (crc32 of its number modulo 9) and its own turns after its first h.
    """
    rows, offsets = numbered(turns)
    convs = offsets.select("conv_id", "n").distinct().withColumns({"base": F.expr("conv_id - conv_id % 5"), "h": _crc("conv_id") % (MOST_SHARED + 1)})
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")))
    placed = rows.join(offsets.select("conv_id", "block", "before").join(convs, "conv_id"), ["conv_id", "block"]).withColumn("place", F.col("local") + F.col("before"))
    own = placed.where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "bytes")
    heads = rows.join(offsets.where(F.col("before") < MOST_SHARED).select("conv_id", "block", "before"), ["conv_id", "block"])
    heads = heads.select(F.col("conv_id").alias("base"), (F.col("local") + F.col("before")).alias("place"), "digest", "bytes").where(F.col("place") <= MOST_SHARED)
    shared = convs.select("conv_id", "base", "h").join(heads, "base").where("place <= h").select("conv_id", "place", "digest", "bytes")
    return own.unionByName(shared), convs.select("conv_id", "n")


def _key(depth: Column | str, a: Column | str, b: Column | str) -> Column:
    return F.concat_ws(":", F.col(depth) if isinstance(depth, str) else depth, F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def _per_block(sequences: DataFrame) -> DataFrame:
    """One row per block of turns of each sequence, so that a long one meets its turns block by block."""
    return sequences.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.expr(f"(n - 1) div {BLOCK}"), F.lit(0).cast("bigint")))))


def prefixes(placed: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, block, depth, key, parent, until, upto), (conv_id, n, key, bytes)).

    ``until`` and ``upto`` are the bytes before and with the turn at ``depth``.
    """
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    mark = lambda seed: F.xxhash64(F.lit(seed), F.col("digest"), F.col("place"))
    rows = placed.withColumns({"block": F.expr(f"(place - 1) div {BLOCK}"), "x": mark(1), "y": mark(2)})
    rows = cut(rows.select("conv_id", "block", "place", "bytes", "x", "y"))
    sums = {"x0": total("x"), "y0": total("y"), "b0": F.sum("bytes")}
    offsets = block_sums(rows, ["conv_id"], sums, {}, aggregated=True)
    here = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"x1": total("x").over(here), "y1": total("y").over(here), "b1": F.sum("bytes").over(here)}).join(offsets, ["conv_id", "block"])
    rows = rows.withColumns({"x1": F.expr("cast(x1 + x0 as decimal(38,0))"), "y1": F.expr("cast(y1 + y0 as decimal(38,0))"), "b1": F.col("b1") + F.col("b0")})
    before = lambda c, own: F.expr(f"cast({c} - {own} as decimal(38,0))")
    rows = cut(rows.select(
        "conv_id", "block", F.col("place").alias("depth"), _key("place", "x1", "y1").alias("key"),
        _key(F.col("place") - 1, before("x1", "x"), before("y1", "y")).alias("parent"), (F.col("b1") - F.col("bytes")).alias("until"), F.col("b1").alias("upto"),
    ))
    last = rows.select(F.col("conv_id"), F.col("depth").alias("n"), "key", F.col("upto").alias("bytes"))
    ends = convs.join(last, ["conv_id", "n"], "left")
    return rows, cut(ends.select("conv_id", "n", F.coalesce("key", F.lit("0:0:0")).alias("key"), F.coalesce("bytes", F.lit(0).cast("bigint")).alias("bytes")))


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest of the numbers of the conversations that end at ``key``, ascending, joined by commas."""
    pieces = ends.groupBy("key", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("key", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            keys, found = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        found.append(digest.hexdigest())
                    key, digest = k, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def trie(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, place, digest, bytes) and (conv_id, n)."""
    rows, ends = prefixes(placed, convs)
    # the collapse: one weighted sequence for all identical conversations
    seqs = cut(ends.groupBy("key", "n", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("weight")))
    turns = rows.join(_per_block(seqs.select("conv_id", "n", "bytes", "weight")), ["conv_id", "block"])
    turns = turns.select("conv_id", "block", "depth", "key", "parent", "until", "bytes", "weight")
    roots = seqs.select(
        "conv_id", F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("depth"), F.lit("0:0:0").alias("key"),
        F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("until"), "bytes", "weight",
    )
    through = cut(turns.unionByName(roots))
    after = F.col("bytes") - F.col("until")
    nodes = cut(through.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * after).alias("all_bytes"),
    ))
    inner = cut(nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")))
    leaves = _per_block(seqs.join(inner.select("key"), "key", "left_anti").select("conv_id", "n"))
    below = cut(through.join(cut(leaves), ["conv_id", "block"], "left_semi").select("conv_id", "block", "depth", "key", "until", "bytes"))
    lowest = cut(below.groupBy("key").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_leaves")))
    owned = attach(below.select("conv_id", "depth", "until", "key"), lowest, "key", "n_leaves").where("owner = conv_id")
    owned = owned.groupBy("conv_id").agg(F.min(F.struct("depth", "until")).alias("own"))
    owned = _per_block(seqs.select("conv_id", "n").join(owned, "conv_id")).select("conv_id", "block", "own")
    once = below.join(cut(owned), ["conv_id", "block"]).groupBy("key").agg(F.sum(F.col("bytes") - F.greatest("until", "own.until")).alias("own_bytes"))
    above = cut(inner.join(nodes.select("key", F.col("conv_id").alias("parent_conv_id")), "key"))
    told = attach(nodes, above.withColumnsRenamed({"key": "parent", "n_children": "siblings"}), "parent", "siblings")
    out = told.join(lowest.select("key", "n_leaves"), "key").join(once, "key").join(inner, "key", "left").join(end_digests(ends), "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves",
        (F.col("all_bytes") - F.col("own_bytes")).cast("bigint").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


SQL = r"""
with recursive t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as base, cast(conv_id as varchar) as s, count(*) as n from t group by conv_id),
steps as (
  select conv_id, base, n, s, 0 as k, 4294967295::bigint as crc from c
  union all
  select conv_id, base, n, s, k + 1,
         xor(xor(crc, case when k % 8 = 0 then ascii(substr(s, k // 8 + 1, 1)) else 0 end) >> 1,
             case when xor(crc, case when k % 8 = 0 then ascii(substr(s, k // 8 + 1, 1)) else 0 end) % 2 = 1 then 3988292384::bigint else 0 end)
  from steps where k < 8 * length(s)),
h as (select conv_id, base, n, xor(crc, 4294967295::bigint) % 9 as h from steps where k = 8 * length(s)),
parts as (
  select h.conv_id, 0 as part, t.place, t.role, t.text from h join t on t.conv_id = h.base where t.place <= h.h
  union all
  select h.conv_id, 1, t.place, t.role, t.text from h join t on t.conv_id = h.conv_id where t.place > h.h),
placed as (select conv_id, row_number() over (partition by conv_id order by part, place) as d, sha256(role || chr(10) || length(role) || chr(10) || text) as x, strlen(text) as b from parts),
chains as (
  select conv_id, d, b, string_agg(x, ',') over (partition by conv_id order by d) as key from placed
  union all select conv_id, 0, 0, '' from h),
lens as (select conv_id, max(d) as n from chains group by conv_id),
nodes as (
  select key, min(ch.conv_id) as conv_id, any_value(d) as depth, any_value(b) as b, count(*) as n_convs,
         string_agg(case when d = n then cast(ch.conv_id as varchar) end, ',' order by ch.conv_id) as ends
  from chains ch join lens using (conv_id) group by key),
up as (select a.key, p.key as parent from nodes a join nodes p on a.conv_id is not null and p.depth = a.depth - 1
       and p.key = case when a.depth = 1 then '' else substr(a.key, 1, length(a.key) - 65) end),
kids as (select parent as key, count(*) as n_children from up group by parent),
inside as (
  select key, key as top from nodes
  union all
  select i.key, up.parent from inside i join up on up.key = i.top),
sums as (
  select i.top as key, sum((n.n_convs - 1) * n.b)::bigint as saved, sum(case when k.key is null then 1 else 0 end)::bigint as n_leaves
  from inside i join nodes n on n.key = i.key left join kids k on k.key = i.key group by i.top)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves, s.saved as saved_tokens,
       sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join sums s using (key) left join kids k using (key) left join up using (key) left join nodes p on p.key = up.parent
"""


@query("op11_prefix_trie", SQL)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))
