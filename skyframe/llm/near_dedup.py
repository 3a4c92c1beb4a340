"""MinHash near-deduplication with odd sketches.

Every document is a set of word shingles.  ``BANDS`` x ``ROWS`` MinHash samples give band keys and
an odd sketch: a bitmap whose bits flip with each sample, so that the population count of the XOR of
two sketches estimates how many samples differ.  Documents that share a band key are candidates;
sketches and set sizes discard those that are clearly apart; what is left is confirmed on the full
sets, read again from the texts.

Equal sets are one vertex.  In a bucket every vertex first meets only one partner, the bucket's
smallest vertex, and of several such partners the one it shares most bands with: a group of
thousands of copies costs a star, not all pairs.  Afterwards the vertices of a bucket that are not
in its largest component meet that component and each other, in blocks that compare full sets and
report no more links than vertices; a pair inside one component has nothing left to tell.  So no
link between different components is lost.

With 40 bands of 5 rows a pair of similarity 0.8 shares no band with probability 1e-7.

Defined cases: null or empty texts and texts without words have the empty set and are linked with
nothing; texts with fewer words than a shingle are one shingle of all their words; rows that share
a ``doc_id`` with different texts are linked, kept and dropped text by text, and a null ``doc_id`` takes no part in links; an
empty table gives no rows; further columns pass through :func:`deduplicate` and are else not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyframe.llm.common import attach, query, table, tidy, unwrapped, wrapped
from skyframe.llm.tokens import LOWER, WORDS, buffers, mix64, token_hashes
from skyframe.session import cut

BANDS, ROWS = 40, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Standard deviations of the estimate that the sketch filter leaves below the threshold.
SLACK = 6.0
#: Hash values of the bitmap that marks needed documents, and vertices in one side of a block.
MARKS = 1 << 23
BLOCK = 768
#: Shingles of a vertex that counts once in a block.
BLOCK_SHINGLES = 512
#: Up to so many vertices meet pair by pair, filtered by sketches; more meet in blocks.
FEW = 8

_SEEDS = mix64(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FLIP = (_SEEDS[:SAMPLES] >> np.uint64(32)).astype(np.uint32)
_FACTOR = (_SEEDS[SAMPLES:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingle hashes of a chunk of texts, where each text's begin): sorted and distinct."""
    for i, j, raw, offsets in buffers(texts):
        words, begins = token_hashes(raw, offsets, WORDS, LOWER)
        count = np.diff(begins)
        n = len(words)
        run = np.zeros(n, np.uint64)
        for d in range(width):  # positions whose shingle would cross a text's end are dropped below
            run[: n - d] = mix64(run[: n - d] * np.uint64(0x9E3779B97F4A7C15) + words[d:]) if n > d else run[: n - d]
        sets = []
        for b, c in zip(begins[:-1].tolist(), count.tolist()):
            if c >= width:
                sets.append(np.unique(run[b : b + c - width + 1]))
            elif c:
                whole = np.uint64(c)
                for w in words[b : b + c]:
                    whole = mix64(np.array([whole], np.uint64) * np.uint64(0xD1342543DE82EF95) + w)[0]
                sets.append(np.array([whole], np.uint64))
            else:
                sets.append(np.zeros(0, np.uint64))
        sizes = np.array([len(s) for s in sets], np.int64)
        yield i, np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)])


def minhashes(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """SAMPLES minima per set; sets must not be empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((SAMPLES, len(begins) - 1), np.uint32)
    y = np.empty_like(x)
    for s in range(SAMPLES):
        np.bitwise_xor(x, _FLIP[s], out=y)
        np.multiply(y, _FACTOR[s], out=y)
        np.minimum.reduceat(y, begins[:-1], out=out[s])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and set."""
    keys = np.empty((samples.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for r in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + samples[b * ROWS + r])
        keys[:, b] = key
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words."""
    place = mix64((np.arange(1, SAMPLES + 1, dtype=np.uint64)[:, None] << np.uint64(32)) + samples) % np.uint64(SKETCH_BITS)
    sets = samples.shape[1]
    cell = place.astype(np.int64) + np.arange(sets) * SKETCH_BITS
    odd = np.bincount(cell.ravel(), minlength=sets * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(sets, SKETCH_BITS), axis=1).view(np.uint64)


def most_differing(percent: int) -> int:
    """The largest XOR population count at which a pair of the threshold's similarity may be."""
    t = percent / 100
    low = max(0.0, t - SLACK * (t * (1 - t) / SAMPLES) ** 0.5)
    differ = 2 * SAMPLES * (1 - low)
    filled = (1 - 2 / SKETCH_BITS) ** differ
    return int(SKETCH_BITS / 2 * (1 - filled) + SLACK * (SKETCH_BITS / 4 * (1 - filled**2)) ** 0.5) + 1


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, set_key, bands, sketch) per row of ``docs``; empty sets have no bands."""
    schema = "doc_id bigint, n bigint, set_key binary, bands array<bigint>, sketch array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, shingles, begins in shingle_sets(batch.column(1), width):
                n = np.diff(begins)
                full = np.flatnonzero(n)
                key = np.zeros((len(n), 2), np.uint64)
                bands, sketch = np.zeros((0, BANDS), np.uint64), np.zeros((0, SKETCH_BITS // 64), np.uint64)
                if len(full):
                    own = np.append(begins[full], len(shingles))
                    samples = minhashes(shingles, own)
                    bands, sketch = band_keys(samples), odd_sketches(samples)
                    key[full, 0] = np.add.reduceat(mix64(shingles), own[:-1])
                    key[full, 1] = np.add.reduceat(mix64(shingles ^ np.uint64(0xA0761D6478BD642F)), own[:-1]) + n[full].astype(np.uint64)
                raw = key.tobytes()
                cols = [ids.slice(i, len(n)), pa.array(n), pa.array([raw[16 * r : 16 * r + 16] for r in range(len(n))], pa.binary())]
                has = np.concatenate([[0], np.cumsum(n > 0)])
                for values in (bands, sketch):
                    cols.append(pa.ListArray.from_arrays(pa.array((has * values.shape[1]).astype(np.int32)), pa.array(values.view(np.int64).ravel())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "set_key", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), schema)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches of two rows allow a link."""
    differ = sum(F.bit_count(F.col(f"{a}_sketch")[i].bitwiseXOR(F.col(f"{b}_sketch")[i])) for i in range(SKETCH_BITS // 64))
    sizes = 100 * F.least(f"{a}_n", f"{b}_n") >= percent * F.greatest(f"{a}_n", f"{b}_n")
    return sizes & (differ <= most_differing(percent))


def texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents whose ids are in ``needed`` (doc_id), as a written table.

    A bitmap of ``MARKS`` hash values of the needed ids, at most 1 MB in rows of 4 KB, is broadcast
    so that only few other texts take part in the exact semi-join.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    marks = needed.groupBy(F.bitmap_bucket_number(place).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_marks"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    rows = rows.withColumns({"_part": F.bitmap_bucket_number(place), "_bit": F.bitmap_bit_position(place)})
    marked = F.expr("cast(conv(hex(substring(_marks, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(_bit % 8 as int)) <> 0")
    rows = rows.join(F.broadcast(marks), "_part").where(marked).select("doc_id", "text")
    return cut(rows.join(needed, "doc_id", "left_semi"))


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, shingles, begins in shingle_sets(column, width):
        out += [shingles[x:y] for x, y in zip(begins[:-1].tolist(), begins[1:].tolist())]
    return out


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full shingle sets are similar enough."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = texts_of(docs, needed)
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"{x}_text"))
    rows = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                keep = []
                for x, y in zip(sets_of(part.column(2), width), sets_of(part.column(3), width)):
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    keep.append(len(x) > 0 and 100 * common >= percent * (len(both) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidy(run), "a bigint, b bigint").distinct()


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    counts = np.zeros((len(left), len(right)), np.float32)
    flat = [np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    known = np.intersect1d(*flat)
    at = [np.searchsorted(known, f) for f in flat]
    for k in (0, 1):  # only what occurs on both sides
        at[k] = np.where((at[k] < len(known)) & (known[np.minimum(at[k], max(0, len(known) - 1))] == flat[k]), at[k], -1) if len(known) else np.full(len(flat[k]), -1)
    for begin in range(0, len(known), 4096):
        wide = min(4096, len(known) - begin)
        sides = []
        for k, n in ((0, len(left)), (1, len(right))):
            here = (at[k] >= begin) & (at[k] < begin + wide)
            m = np.zeros((n, wide), np.float32)
            m[row[k][here], at[k][here] - begin] = 1
            sides.append(m)
        counts += sides[0] @ sides[1].T
    return counts


def block_links(groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) such that components of the result hold every link between the two sides of a group.

    ``groups`` has (grp, side 0 or 1, v, n).  Sides are dealt into blocks of about ``BLOCK`` vertices
    (large sets count for several) and every pair of blocks is one task, which counts all intersections of its full sets at once
    and reports at most one link per vertex and linked part: rows never grow with pairs.
    """
    groups = cut(groups)
    texts = texts_of(docs, groups.select(F.col("v").alias("doc_id")).distinct())
    load = F.greatest(F.lit(1.0), F.col("n") / BLOCK_SHINGLES)
    sizes = groups.groupBy("grp").agg(*[F.ceil(F.sum(F.when(F.col("side") == k, load)) / BLOCK).alias(f"parts{k}") for k in (0, 1)]).where("parts0 > 0 and parts1 > 0")
    sizes = cut(sizes)  # a written table, so that a group of many vertices is not shuffled to meet its sizes
    rows = groups.join(sizes, "grp")
    own = F.pmod(F.xxhash64("v"), F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col("parts1")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("parts1")).otherwise(F.col("parts0")) - 1))
    rows = rows.withColumns({"own": own, "other": other})
    part = lambda k: F.when(F.col("side") == k, F.col("own")).otherwise(F.col("other"))
    rows = rows.select("grp", part(0).alias("l"), part(1).alias("r"), "side", "v").join(texts.withColumnRenamed("doc_id", "v"), "v")

    def run(block: pa.Table) -> pa.Table:
        side, v = np.asarray(block.column("side")), np.asarray(block.column("v"))
        sets = sets_of(pa.concat_arrays(block.column("text").chunks) if block.column("text").num_chunks else pa.array([], pa.string()), width)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        common = common_counts([sets[i] for i in left], [sets[i] for i in right])
        sizes = np.array([len(s) for s in sets], np.float64)
        both = sizes[left][:, None] + sizes[right][None, :] - common
        linked = (100 * common.astype(np.float64) >= percent * both) & (both > 0) & (v[left][:, None] != v[right][None, :])
        # one link per left vertex, and one per right vertex, to a spanning set of this block's links
        up = {x: x for x in v.tolist()}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        a, b = [], []
        for i, j in zip(*(k.tolist() for k in np.nonzero(linked))):
            x, y = int(v[left[i]]), int(v[right[j]])
            if (p := top(x)) != (q := top(y)):
                up[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("grp", "l", "r").applyInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex that each vertex of ``links`` (a, b) reaches.

    In each round a vertex takes the smallest of its neighbours' labels' own labels, so rounds grow
    with the logarithm of the longest path.  Labels only fall, so an equal sum ends the rounds; they
    are written once a round.
    """
    pairs = links.where("a <> b")
    both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).union(pairs.select(F.col("a"), F.col("a"))).union(pairs.select(F.col("b"), F.col("b")))
    both = cut(both.distinct())
    labels, before = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("component"))), None
    while True:
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        further = labels.select(F.col("v").alias("_v"), F.col("component").alias("_c"))
        near = both.join(labels, F.col("b") == F.col("v")).select("a", "component").join(further, F.col("component") == F.col("_v")).select("a", "_c")
        labels = cut(near.groupBy(F.col("a").alias("v")).agg(F.min("_c").alias("component")))


def keyed(docs: DataFrame) -> DataFrame:
    """(_row, doc_id, _key): a number of its own for each row of ``docs``, null where the doc_id is; written, so that keys stay."""
    rows = wrapped(docs).withColumn("doc_id", F.col("_row").getField("doc_id").cast("bigint"))
    return cut(rows.withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))


def _texts(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_key").alias("doc_id"), F.col("_row").getField("text").cast("string").alias("text"))


def near_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n, component_id) for every row of ``docs`` (doc_id, text)."""
    sig = cut(signatures(docs, width))
    own = F.xxhash64("set_key")
    shared = sig.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(own).alias("low"), F.max(own).alias("high")).where("low <> high")
    if not shared.limit(1).count():
        return _linked(sig, docs, width, percent)
    # an id of several texts does not name a vertex: rows are linked by keys, and ids come back at the end
    rows = keyed(docs.select("doc_id", "text"))
    texts = _texts(rows)
    found = cut(_linked(cut(signatures(texts, width)), texts, width, percent).withColumnRenamed("doc_id", "_key"))
    ids = rows.where("_key is not null").select("_key", "doc_id")
    members = cut(found.join(ids, "_key").select("doc_id", "n", F.col("component_id").alias("_component")))
    least = cut(members.groupBy("_component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")))
    named = attach(members, least, "_component", "rows").select("doc_id", "n", "component_id")
    return named.unionByName(found.where("_key is null").select(F.col("_key").alias("doc_id"), "n", "component_id"))


def _linked(sig: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The result of :func:`near_components` for rows of which no two share an id but not their set."""
    sets = cut(sig.where("n > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("v"), F.count("*").alias("rows")))
    vertices = sig.join(sets.select("v", F.col("set_key").alias("_key")), (F.col("doc_id") == F.col("v")) & (F.col("set_key") == F.col("_key")))
    vertices = cut(vertices.dropDuplicates(["v", "set_key"]).select("v", "n", "bands", "sketch"))
    facts = lambda x: vertices.select(F.col("v").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch"))

    banded = vertices.select("v", "n", F.explode("bands").alias("band"))
    buckets = cut(banded.groupBy("band").agg(F.min("v").alias("hub"), F.count("*").alias("members")).where("members > 1"))
    shared = cut(banded.join(buckets, "band").select("band", "v", "n", "hub"))
    met = shared.where("v <> hub").groupBy("v", "hub").agg(F.count("*").alias("times"))
    nearest = met.groupBy("v").agg(F.max(F.struct("times", -F.col("hub"))).alias("top")).select(F.col("v").alias("a"), (-F.col("top.col2")).alias("b"))
    may = lambda pairs: cut(pairs.join(facts("a"), "a").join(facts("b"), "b").where(_may_link("a", "b", percent)).select("a", "b"))
    nearest = cut(nearest)
    links = cut(confirmed(may(nearest), docs, width, percent))
    labels = components(links)

    # buckets whose vertices are still in several components
    placed = shared.join(labels.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left")
    placed = cut(placed.select("band", "v", "n", F.coalesce("component", "v").alias("component")))
    parts = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    open_bands = parts.groupBy("band").agg(F.count("*").alias("several"), F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all")).where("several > 1")
    open_bands = cut(open_bands.select("band", F.col("top.component").alias("largest"), (F.col("all") - F.col("top.size")).alias("crowd")))
    others = cut(placed.join(open_bands, "band").where("component <> largest"))
    towards = others.select("largest", "v", "n").distinct()
    homes = placed.select(F.col("component").alias("largest"), F.col("v").alias("m"), F.col("n").alias("m_n")).distinct()
    homes = homes.join(towards.select("largest").distinct(), "largest", "left_semi")
    sizes = homes.groupBy("largest").agg(F.count("*").alias("size"))
    homes = cut(homes.join(sizes, "largest"))

    # few against one, or few among themselves: pair by pair
    w = others.where(F.col("crowd") <= FEW).select("band", F.col("v").alias("b"), F.col("component").alias("b_c"))
    among = others.where(F.col("crowd") <= FEW).select("band", F.col("v").alias("a"), F.col("component").alias("a_c")).join(w, "band").where("a < b and a_c <> b_c").select("a", "b")
    facing = towards.join(homes.where(F.col("size") <= FEW), "largest").select(F.least("v", "m").alias("a"), F.greatest("v", "m").alias("b"))
    told = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = may(among.union(facing).distinct().join(told, ["a", "b"], "left_anti"))
    more = confirmed(pairs, docs, width, percent)

    # many: block by block
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("grp")
    many = homes.where(F.col("size") > FEW)
    groups = towards.join(many.select("largest").distinct(), "largest", "left_semi").select(name("c", "largest"), F.lit(0).alias("side"), "v", "n")
    groups = groups.union(many.select(name("c", "largest"), F.lit(1), "m", "m_n"))
    for side in (0, 1):
        groups = groups.union(others.where(F.col("crowd") > FEW).select(name("b", "band"), F.lit(side), "v", "n"))
    more = cut(more.union(block_links(groups, docs, width, percent)))
    if more.limit(1).count():
        labels = components(links.union(more))

    placed = sets.join(labels.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left").select("set_key", "rows", F.coalesce("component", "v").alias("component_id"))
    out = attach(sig.select("doc_id", "n", F.hex("set_key").alias("set_key")), cut(placed.withColumn("set_key", F.hex("set_key"))), "set_key", "rows")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates of ``docs``, with the same columns, whatever these are called."""
    repeated = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if not repeated.limit(1).count():
        found = cut(near_components(docs.select("doc_id", "text"), width, percent))
        dropped = found.where("component_id <> doc_id").select("doc_id")
        rows = wrapped(docs).withColumn("doc_id", F.col("_row").getField("doc_id").cast("bigint"))
        return unwrapped(rows.join(dropped, "doc_id", "left_anti"), docs.columns)
    # rows that share an id are kept or dropped each by its own text
    rows = keyed(docs)
    texts = _texts(rows)
    found = cut(_linked(cut(signatures(texts, width)), texts, width, percent).withColumnRenamed("doc_id", "_key"))
    place = rows.select("_key", "doc_id", F.xxhash64(F.col("_row").getField("text").cast("string")).alias("text"))
    first = found.where("n > 0").join(place, "_key").groupBy("component_id").agg(F.min(F.struct("doc_id", "text", "_key")).alias("top"))
    kept = rows.join(first.select("top._key"), "_key", "left_semi").select("_row")
    # empty sets have no near copy: only rows equal in whole are one
    empty = rows.join(found.where("n = 0").select("_key"), "_key", "left_semi").withColumn("_whole", F.sha2(F.to_json("_row"), 256))
    empty = empty.dropDuplicates(["_whole"]).select("_row")
    return unwrapped(kept.unionByName(empty).unionByName(rows.where("_key is null").select("_row")), docs.columns)


@query("op9_near_dedup")
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
