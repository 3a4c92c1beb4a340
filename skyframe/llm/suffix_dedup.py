"""Removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``WIDTH`` bytes around it also starts in a document with a smaller
``doc_id``.  A suffix begins in the bucket of its first ``GRAM`` bytes; buckets are refined by the
buckets at later offsets, and each refinement uses the names that the one before gave:

* names of 1, 2, 4, 8 and 16 bytes, each made of two names of the step before at two offsets, give
  names of ``GRAM`` = 25 bytes; two of these, 25 bytes apart, name a string of 50;
* of the 26 starts of a 25-byte bucket inside a 50-byte string the one of smallest hash is its anchor
  (the leftmost of equals), which depends on the string alone, so about every 13th suffix is enough;
* round 1 sorts anchors by bucket, then by the pointers at -25 and +25: equal triples are equal
  neighbourhoods of 75 bytes.  A triple that is in a smaller document too settles all strings around
  its anchor.  A bucket of one triple has nothing more to tell; buckets of several stay open;
* round 2 refines only strings whose own anchor is open and that no settled anchor covers, by the
  pair of pointers.

Rows are dealt into shards of ``SHARD_BYTES`` of text by a hash of the row; a shard sends each
distinct bucket entry once, as packed arrays with its smallest document, and gets two bits back.  So a
passage that a third of all documents hold meets its bucket once per shard, not once per document.
Names are 64-bit hashes; two are equal by chance with probability 2**-64, and round 1 compares them
only inside a bucket of 32 more bits.

Memory of a worker: the text of a shard (a longer document is a shard's row of its own size, worked on
in pieces of ``PIECE`` bytes) and about 24 bytes per anchor; in a bucket's task about ``BUCKET`` entries.

Defined cases: null and empty texts have no bytes; a null ``doc_id`` is neither smaller nor larger
than any, so its row keeps all its bytes and removes none; rows that share a ``doc_id`` remove
nothing from each other; strings are judged on the input; an empty table gives no rows; further
columns are not read by :func:`repeats` and pass through :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import give_back, query, shuffle_partitions, table
from skyframe.llm.tokens import mix64
from skyframe.session import cut, scratch_path

WIDTH, GRAM = 50, 25
REACH = WIDTH - GRAM
#: Bytes of text per shard, hashed at once, and entries per bucket of a round.
SHARD_BYTES = 8 << 20
PIECE = 1 << 16
BUCKET = 1 << 20
#: Bytes of text per anchor (two per window of 26, and some for ties).
SPACING = 12

_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_A, _B, _C = np.uint64(0xD1342543DE82EF95), np.uint64(0xAF251AF3B0F025B5), np.uint64(0xB564EF22EC7AECE5)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a string from the names at two of its offsets."""
    x = a * _A
    x += b
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def gram_names(raw: np.ndarray) -> np.ndarray:
    """The name of the ``GRAM`` bytes from each offset, by doubling; mixed once, when 16 bytes meet 16.

    The first 16 get a factor of their own: with that of the doubling alone, bytes 8 and 16 would weigh
    the same, and strings that swap them would share a name.
    """
    name, factor = _BYTES[raw], _A
    for step in (1, 2, 4, 8):
        longer = name[:-step] * factor
        longer += name[step:]
        name, factor = longer, factor * factor
    return _pair(name[: -(GRAM - 16)] * _C, name[GRAM - 16 :])


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width``."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


class Piece:
    """Names and anchors of bytes ``lo:hi`` of a document whose strings start in ``begin:end``."""

    def __init__(self, doc: int, n: int, begin: int, end: int, lo: int, names: np.ndarray):
        self.doc, self.n, self.begin, self.end, self.lo, self.names = doc, n, begin, end, lo, names

    def own_anchors(self) -> np.ndarray:
        """The anchor of each string that starts in ``begin:end``, as an offset in the document."""
        own = self.names[self.begin - self.lo : self.end + REACH - self.lo]
        place = np.arange(len(own), dtype=np.uint64)
        best = _smallest((own & np.uint64(0xFFFFFFFF00000000)) | place, REACH + 1) & np.uint64(0xFFFFFFFF)
        return best.astype(np.int64) + self.begin

    def anchors(self) -> np.ndarray:
        best = self.own_anchors()
        return best[np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))]

    def triples(self, at: np.ndarray) -> np.ndarray:
        """Names of the neighbourhoods of ``at``; at a text's border with the distance to it."""
        left, right = at - REACH, at + GRAM
        before = self.names[np.maximum(left, 0) - self.lo]
        last = self.n - GRAM
        after = self.names[np.minimum(right, last) - self.lo]
        edge = np.where(left < 0, -left, 0).astype(np.uint64) + (np.where(right > last, right - last, 0).astype(np.uint64) << np.uint64(8))
        return _pair(_pair(before, self.names[at - self.lo]), _pair(after, edge * _C))

    def strings(self, at: np.ndarray) -> np.ndarray:
        return _pair(self.names[at - self.lo], self.names[at + GRAM - self.lo])


def pieces(texts: list[np.ndarray]) -> Iterator[Piece]:
    """Pieces of the texts that have ``WIDTH`` bytes, in order of the texts; short texts are hashed together."""
    waiting: list[tuple[int, np.ndarray]] = []
    held = 0

    def joined():
        names = gram_names(np.concatenate([t for _, t in waiting]))
        at = 0
        for d, t in waiting:
            yield Piece(d, len(t), 0, len(t) - WIDTH + 1, 0, names[at : at + len(t) - GRAM + 1])
            at += len(t)

    for d, t in enumerate(texts):
        if len(t) < WIDTH:
            continue
        if len(t) > PIECE:
            if waiting:  # the texts before come first
                yield from joined()
                waiting, held = [], 0
            for begin in range(0, len(t) - WIDTH + 1, PIECE):
                end = min(begin + PIECE, len(t) - WIDTH + 1)
                lo, hi = max(0, begin - REACH), min(len(t), end + 2 * WIDTH)
                yield Piece(d, len(t), begin, end, lo, gram_names(t[lo:hi]))
            continue
        waiting.append((d, t))
        held += len(t)
        if held > PIECE:
            yield from joined()
            waiting, held = [], 0
    if waiting:
        yield from joined()


class Shard:
    """The texts of a shard in order of (doc_id, text), and what the rounds know of them."""

    def __init__(self, rows: pa.Table):
        #: The distinct ids of the shard, and the place of each text's among them.
        self.names, self.rank = np.unique(rows.column("doc_id").to_numpy(), return_inverse=True)
        column = rows.column("text").combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]

    def anchors(self) -> None:
        doc, at, bucket, triple = [], [], [], []
        for p in pieces(self.texts):
            a = p.anchors()
            doc.append(np.full(len(a), p.doc, np.int32))
            at.append(a)
            bucket.append(p.names[a - p.lo])
            triple.append(p.triples(a))
        self.doc, self.at, self.bucket, self.triple = _flat(doc, np.int32), _flat(at, np.int64), _flat(bucket, np.uint64), _flat(triple, np.uint64)
        self.entries = Entries(self.bucket, self.triple, self.rank[self.doc], self.names)

    def candidates(self, settled: np.ndarray, open_: np.ndarray) -> None:
        """Strings whose anchor is open, away from settled anchors; both by anchor."""
        sides = [(self.at[x], np.searchsorted(self.doc[x], np.arange(len(self.texts) + 1))) for x in (open_, settled)]
        any_open = np.diff(sides[0][1]) > 0
        doc, at, name = [], [], []
        for p in pieces([t if any_open[d] else t[:0] for d, t in enumerate(self.texts)]):
            n = p.end - p.begin
            marked, covered = np.zeros(n + REACH, bool), np.zeros(n + 1, np.int32)
            offsets, shut = (x[y[p.doc] : y[p.doc + 1]] for x, y in sides)
            marked[offsets[(offsets >= p.begin) & (offsets < p.end + REACH)] - p.begin] = True
            shut = shut[(shut >= p.begin) & (shut < p.end + REACH)]
            np.add.at(covered, np.maximum(shut - REACH, p.begin) - p.begin, 1)
            np.add.at(covered, np.minimum(shut + 1, p.end) - p.begin, -1)
            found = np.flatnonzero(marked[p.own_anchors() - p.begin] & (np.cumsum(covered[:-1]) == 0)) + p.begin
            doc.append(np.full(len(found), p.doc, np.int32))
            at.append(found)
            name.append(p.strings(found))
        self.string_doc, self.string_at, name = _flat(doc, np.int32), _flat(at, np.int64), _flat(name, np.uint64)
        self.strings = Entries(name, name, self.rank[self.string_doc], self.names)

    def spans(self, settled: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, begin, end) of the maximal removed runs, from anchors and strings that are in smaller documents."""
        length = np.array([len(t) for t in self.texts], np.int64)
        doc = np.concatenate([self.doc[settled], self.string_doc[repeated]])
        begin = np.concatenate([np.maximum(self.at[settled] - REACH, 0), self.string_at[repeated]])
        end = np.concatenate([np.minimum(self.at[settled] + WIDTH, length[self.doc[settled]]), self.string_at[repeated] + WIDTH])
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        if not len(doc):
            return doc, begin, end
        # one line for all documents: ends never reach into the next one
        first = np.concatenate([[0], np.cumsum(length + 1)])[doc]
        begin, end = begin + first, np.maximum.accumulate(end + first)
        new = np.concatenate([[True], begin[1:] > end[:-1]])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(new)) - 1
        return doc[heads], begin[heads] - first[heads], end[tails] - first[heads]


class Entries:
    """Distinct (bucket, key) of a shard, each with its smallest document.

    ``rank`` tells each row's document by its place in the sorted ``ids``.  Rows are sorted by key alone;
    equal keys of different buckets would only make an entry twice.
    """

    def __init__(self, bucket: np.ndarray, key: np.ndarray, rank: np.ndarray, ids: np.ndarray):
        order = np.argsort(key)
        b, k = bucket[order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (b[1:] != b[:-1])
        heads = np.flatnonzero(new)
        self.ids = ids
        self.first = np.minimum.reduceat(rank[order], heads) if len(heads) else np.zeros(0, rank.dtype)
        self.bucket, self.key = b[heads], k[heads]
        #: The entry of each given row, and whether its document is the entry's smallest.
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.least = rank == self.first[self.of]
        self._dealt: tuple | None = None

    def parts(self, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket task, its entries in order of smallest document)."""
        if self._dealt is None:
            to = (self.bucket % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to * (len(self.ids) + 1) + self.first, kind="stable")  # the same on every machine
            self._dealt = order, np.searchsorted(to[order], np.arange(buckets + 1))
        order, bounds = self._dealt
        for p in np.flatnonzero(np.diff(bounds)).tolist():
            yield p, order[bounds[p] : bounds[p + 1]]

    def marked(self, rows: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(settled, open) of all entries, from the bits that came back."""
        settled, open_ = np.zeros(len(self.key), bool), np.zeros(len(self.key), bool)
        back = dict(zip(rows.column("part").to_pylist(), zip(rows.column("settled").to_pylist(), rows.column("open").to_pylist())))
        for p, at in self.parts(buckets):
            if p in back:
                settled[at], open_[at] = (np.unpackbits(np.frombuffer(x, np.uint8), count=len(at)).astype(bool) for x in back[p])
        return settled, open_


def _flat(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


ENTRIES = "part bigint, shard bigint, ids binary, counts binary, buckets binary, keys binary"
BITS = "shard bigint, part bigint, settled binary, open binary"


def _packed(shard: int, entries: Entries, buckets: int) -> pa.Table:
    rows = []
    for p, at in entries.parts(buckets):
        ids, counts = np.unique(entries.first[at], return_counts=True)
        ids = entries.ids[ids]
        rest = (entries.bucket[at] // np.uint64(buckets)).astype(np.uint32)
        rows.append((p, shard, ids.tobytes(), counts.astype(np.uint32).tobytes(), rest.tobytes(), entries.key[at].tobytes()))
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["part", "shard", "ids", "counts", "buckets", "keys"])


def _judged(rows: pa.Table) -> pa.Table:
    """For every entry of a bucket task: in a smaller document too, or first of its key in a bucket that tells more."""
    get = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)]
    sizes = [len(x) for x in get("keys", np.uint64)]
    first = np.concatenate([np.repeat(i, c) for i, c in zip(get("ids", np.int64), get("counts", np.uint32))])
    key, bucket = np.concatenate(get("keys", np.uint64)), np.concatenate(get("buckets", np.uint32))
    order = np.lexsort((first, key, bucket))
    k, b, d = key[order], bucket[order], first[order]
    del key, bucket, first
    new_bucket = np.ones(len(order), bool)
    new_bucket[1:] = b[1:] != b[:-1]
    new_key = new_bucket.copy()
    new_key[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new_key) - 1
    least = d[new_key][group]
    # a bucket tells more if its keys begin in different documents
    heads = np.flatnonzero(new_bucket)
    of_bucket = np.cumsum(new_bucket) - 1
    firsts = np.where(new_key, d, d[heads][of_bucket])
    several = (np.minimum.reduceat(firsts, heads) != np.maximum.reduceat(firsts, heads))[of_bucket]
    settled, open_ = np.empty(len(order), bool), np.empty(len(order), bool)
    settled[order] = d > least
    open_[order] = (d == least) & several
    out, at = [], 0
    for s, p, n in zip(rows.column("shard").to_pylist(), rows.column("part").to_pylist(), sizes):
        x, y = settled[at : at + n], open_[at : at + n]
        at += n
        if x.any() or y.any():
            out.append((s, p, np.packbits(x).tobytes(), np.packbits(y).tobytes()))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["shard", "part", "settled", "open"])


def _ordered(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("doc_id", "ascending"), ("row", "ascending")])


def _each(texts: DataFrame, bits: DataFrame, run: Callable[[int, Shard, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` for every shard of ``texts`` with the bits that came back to it."""

    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _ordered(left)
        return run(rows.column("shard")[0].as_py(), rows, right)

    return texts.groupBy("shard").cogroup(bits.groupBy("shard")).applyInArrow(lambda a, b: _tidy(shard, a, b) if a.num_rows else _nothing(schema), schema)


def _tidy(run: Callable[..., pa.Table], *groups: pa.Table) -> pa.Table:
    """``run`` on one group, after which its worker gives free memory back."""
    try:
        return run(*groups)
    finally:
        give_back()


def _nothing(schema: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.table({x.split()[0]: pa.array([], kinds[x.split()[1]]) for x in schema.split(", ")})


SPANS = "doc_id bigint, row bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _rounds(docs: DataFrame, finish: Callable[[Shard, pa.Table, tuple], pa.Table], schema: str) -> DataFrame:
    """``finish(shard, rows, spans)`` over all shards of ``docs`` (row, doc_id, text)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    buckets = max(1, -(-total // (SPACING * BUCKET)))
    # three passes read the texts: dealt out once, as a table bucketed by shard
    spark = docs.sparkSession
    name, slices = f"texts_{uuid.uuid4().hex}", min(shards, shuffle_partitions(spark))
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards))).repartition(slices, "shard")
    dealt.write.format("parquet").option("path", scratch_path(spark, "texts")).bucketBy(slices, "shard").saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: its files stay for the plans below

    def first(rows: pa.Table) -> pa.Table:
        rows = _ordered(rows)
        shard = Shard(rows)
        shard.anchors()
        return _packed(rows.column("shard")[0].as_py(), shard.entries, buckets)

    def judged(entries: DataFrame) -> DataFrame:
        return cut(entries.groupBy("part").applyInArrow(lambda rows: _tidy(_judged, rows), BITS))

    def known(rows: pa.Table, bits: pa.Table) -> tuple[Shard, np.ndarray]:
        """The shard, and its anchors that are in smaller documents, with strings left to refine."""
        shard = Shard(rows)
        shard.anchors()
        settled, open_ = shard.entries.marked(bits, buckets)
        settled = settled[shard.entries.of] | ~shard.entries.least
        shard.candidates(settled, open_[shard.entries.of] & ~settled)
        return shard, settled

    def second(number: int, rows: pa.Table, bits: pa.Table) -> pa.Table:
        return _packed(number, known(rows, bits)[0].strings, buckets)

    def last(number: int, rows: pa.Table, bits: pa.Table) -> pa.Table:
        turn = bits.column("turn").to_numpy()
        shard, settled = known(rows, bits.filter(pa.array(turn == 1)))
        repeated = shard.strings.marked(bits.filter(pa.array(turn == 2)), buckets)[0]
        return finish(shard, rows, shard.spans(settled, repeated[shard.strings.of] | ~shard.strings.least))

    one = judged(texts.groupBy("shard").applyInArrow(lambda rows: _tidy(first, rows), ENTRIES))
    two = judged(_each(texts, one, second, ENTRIES))
    return _each(texts, one.withColumn("turn", F.lit(1)).union(two.withColumn("turn", F.lit(2))), last, schema)


def _kept(shard: Shard, spans: tuple) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(removed bytes, removed runs, kept pieces) of each text."""
    doc, begin, end = spans
    bounds = np.searchsorted(doc, np.arange(len(shard.texts) + 1))
    for d, t in enumerate(shard.texts):
        b, e = begin[bounds[d] : bounds[d + 1]], end[bounds[d] : bounds[d + 1]]
        kept = [t[x:y] for x, y in zip([0, *e.tolist()], [*b.tolist(), len(t)])]
        yield int((e - b).sum()), len(b), kept


def _digests(shard: Shard, rows: pa.Table, spans: tuple) -> pa.Table:
    removed, runs, sha = [], [], []
    for n, k, kept in _kept(shard, spans):
        digest = hashlib.sha256()
        for x in kept:
            digest.update(x)
        removed.append(n)
        runs.append(k)
        sha.append(digest.hexdigest())
    sizes = [len(t) for t in shard.texts]
    return pa.table([rows.column("doc_id"), rows.column("row"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string())], names=[x.split()[0] for x in SPANS.split(", ")])


def _texts(shard: Shard, rows: pa.Table, spans: tuple) -> pa.Table:
    """The texts without their repeats; a character that a removed run cuts goes whole."""
    kept = [b"".join(x.tobytes() for x in k).decode(errors="ignore") for _, _, k in _kept(shard, spans)]
    return pa.table([rows.column("doc_id"), rows.column("row"), pa.array(kept, pa.string())], names=["doc_id", "row", "text"])


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` deals the rows out and orders those of one id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("row", F.xxhash64("text"))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text)."""
    rows = _keyed(docs)
    found = _rounds(rows.where("doc_id is not null"), _digests, SPANS).drop("row")
    alone = rows.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")
    )
    return found.unionByName(alone)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every row of ``docs``, the text without its repeated bytes."""
    rows = _keyed(docs)
    found = _rounds(rows.where("doc_id is not null"), _texts, "doc_id bigint, row bigint, text string").select("doc_id", "text")
    return found.unionByName(rows.where("doc_id is null").select("doc_id", "text"))


SQL = r"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x, strlen(coalesce(text, '')) as n from documents),
cuts as (select r, doc_id, n, x, unnest(range(0, n - 49, 200)) as c from d where n >= 50 and doc_id is not null),
parts as (select r, doc_id, n, c, substr(x, 2 * c + 1, 500) as y from cuts),
grams as (select r, doc_id, c, y, unnest(range(least(200, n - 49 - c))) as i from parts),
named as (select r, doc_id, c + i as i, hash(substr(y, 2 * i + 1, 100)) as g from grams),
least as (select g, min(doc_id) as first from named group by g having min(doc_id) < max(doc_id)),
hit as (select distinct r, i from named join least using (g) where doc_id > first),
runs as (
  select r, i, sum(new) over (partition by r order by i) as k
  from (select r, i, case when i > lag(i) over (partition by r order by i) + 50 or lag(i) over (partition by r order by i) is null then 1 else 0 end as new from hit)),
spans as (select r, k, min(i) as a, max(i) + 50 as b from runs group by r, k),
gaps as (
  select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as before from spans),
kept as (
  select d.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) || any_value(substr(x, 2 * last + 1)) as x, sum(b - a)::bigint as n_removed, count(*) as n_spans
  from d join gaps using (r) join (select r, max(b) as last from spans group by r) using (r) group by d.r)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept.x, d.x))) as kept_sha256
from d left join kept using (r)
"""


@query("op12_suffix_dedup", SQL)
def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
