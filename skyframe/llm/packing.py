"""Packing tokenised documents into windows by best-fit decreasing.

Documents are tokenised in tasks, cut into full windows and one rest, and dealt by hash into shards
of a bounded number of pieces.  Inside a shard, rests are placed longest first into the tightest
open window; a segment tree indexed by remaining capacity finds it in log(window) steps.  Shards
are independent, so packing scales with the input and only a shard's last windows stay open.

Defined cases: null text is empty and gives one piece that holds the closing id only; rows that
repeat are packed as often as they occur; a text of any length is cut; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm.common import query, table, tidy

WINDOW = 2048
#: Closes every document.
END_ID = 1
#: Rows dealt to one shard on average.
SHARD_ROWS = 2048
#: Text bytes tokenised at once and distinct words a task remembers twice over: bounds on memory only.
CHUNK_BYTES = 6 << 20
REMEMBERED = 300_000
LONG_WORD = 64
#: Stands between words that are encoded together; no word of a text is this character alone.
PARTING = "\x1f"

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_workers: dict[str, "WordEncoder"] = {}


class WordEncoder:
    """Token ids of texts, word by word.

    The vocabulary's ids never cross ASCII white space, so each distinct word of a chunk is encoded
    once; ids of a text are gathered from those of its words.  Words new to a worker are encoded
    many at a time, with a control character between them whose id parts them again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parting = self.tokenizer.encode(PARTING, add_special_tokens=False).ids
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, each as little-endian bytes; words met lately are remembered."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        got = [known.get(w) for w in words]
        missing = []
        for i, x in enumerate(got):
            if x is None:
                if (x := before.get(words[i])) is None:
                    missing.append(i)
                else:
                    got[i] = known[words[i]] = x
        for i in range(0, len(missing), 8192):
            part = missing[i : i + 8192]
            fresh = [words[j] for j in part]
            for j, w, ids in zip(part, fresh, self._fresh(fresh)):
                got[j] = ids
                if len(w) <= LONG_WORD:
                    known[w] = ids
        return got

    def _fresh(self, words: list[str]) -> list[bytes]:
        if len(self.parting) == 1:
            runs = [words[i : i + 64] for i in range(0, len(words), 64)]
            out: list[bytes] = []
            for run, e in zip(runs, self.tokenizer.encode_batch_fast([f" {PARTING} ".join(r) for r in runs], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == self.parting[0])
                if len(cuts) == len(run) - 1:
                    begins, ends, raw = [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)], ids.tobytes()
                    out += [raw[b:e] for b, e in zip(begins, ends)]
                else:  # a word holds the character itself
                    out += self._single(run)
            return out
        return self._single(words)

    def _single(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the closing id after each text, and where each text begins."""
        split = pc.ascii_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        ids = self._encode(flat.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), "<u4")
        begins = (np.cumsum(lengths) - lengths).astype(np.int32)
        index = flat.indices.to_numpy(zero_copy_only=False)
        each = lengths[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        place = np.repeat(begins[index] - ends[:-1].astype(np.int32), each)
        place += np.arange(ends[-1], dtype=np.int32)
        body = pool[place]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        starts = ends[offsets] + np.arange(len(offsets))
        out = np.full(starts[-1], END_ID, dtype="<u4")
        inside = np.ones(starts[-1], bool)
        inside[starts[1:] - 1] = False
        out[inside] = body
        return out, starts


def encoder(path: str) -> WordEncoder:
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, one row at least."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield i, j
        i = j


def tokenised(docs: DataFrame, window: int = WINDOW, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document (doc_id, text): full windows, then the rest."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        try:
            for batch in batches:
                texts = pc.fill_null(batch.column(1), "")
                sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
                for i, j in chunks(sizes, CHUNK_BYTES):
                    ids, starts = encode(texts.slice(i, j - i))
                    whole = np.diff(starts)
                    count = -(-whole // window)
                    doc = np.repeat(np.arange(len(whole)), count)
                    start = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * window
                    length = np.minimum(window, whole[doc] - start)
                    begin = starts[doc] + start
                    crc = [zlib.crc32(ids[b : b + n].data) for b, n in zip(begin.tolist(), length.tolist())]
                    cols = {"doc_id": batch.column(0).slice(i, j - i).take(pa.array(doc)), "start": start, "length": length, "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": whole[doc]}
                    if with_ids:
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(ids.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(cols)
        finally:  # a worker that is used again holds no words of this task
            encode.known, encode.before = {}, {}

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), PIECES + (", ids array<int>" if with_ids else ""))


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece; ``lengths`` are in falling order, none above ``window``."""
    base = 1 << window.bit_length()
    tree = [False] * (2 * base)  # whether a window with this remaining capacity, or one below this node, is open
    open_windows: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def mark(capacity: int, on: bool) -> None:
        node = base + capacity
        tree[node] = on
        while node > 1:
            node >>= 1
            on = tree[2 * node] or tree[2 * node + 1]
            if tree[node] == on:
                return
            tree[node] = on

    for i, n in enumerate(lengths.tolist()):
        node = base + n
        if not tree[node]:
            while node > 1 and not (node % 2 == 0 and tree[node + 1]):  # climb to a subtree with more capacity
                node >>= 1
            node = node + 1 if node > 1 else 0
        if not node:
            at, capacity = made, window
            made += 1
        else:
            while node < base:  # down to its tightest window
                node = 2 * node if tree[2 * node] else 2 * node + 1
            capacity = node - base
            at = open_windows[capacity].pop()
            if not open_windows[capacity]:
                mark(capacity, False)
        number[i], offset[i] = at, window - capacity
        if left := capacity - n:
            if not open_windows[left]:
                mark(left, True)
            open_windows[left].append(at)
    return number, offset


def packed(pieces: DataFrame, rows: int, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset; ``rows`` is about their number and sets the shards."""
    shards = max(1, -(-rows // shard_rows))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)))

    def place(key, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        number, offset = best_fit_decreasing(shard["length"].to_numpy(), window)
        return shard.drop(columns="shard").assign(sequence_id=(np.int64(key[0]) << 32) + number, offset=offset)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("shard").applyInPandas(place, schema)


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with the sequence and offset of each."""
    return packed(tokenised(docs, window, path, with_ids), docs.count(), window)


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids, filled) from packed pieces with ids; padded unless the length is a power of two."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").cast("int").alias("filled"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    gap = F.when(F.expr("bit_count(filled)") == 1, F.lit(0)).otherwise(F.lit(window) - F.col("filled"))
    return whole.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), gap)).alias("ids"), "filled")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
