"""Hashes of the tokens of a batch of texts, for whole byte buffers at once.

A token is a run of bytes of one class.  Its hash is taken from running sums of byte values times
powers of an odd number, which modulo 2**64 can be divided out again, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
#: Text bytes worked on at once; a longer text is taken alone.
CHUNK_BYTES = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_ODD, _INVERSE)):
            x = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(default: int, **classes: bytes) -> np.ndarray:
    t = np.full(256, default, np.uint8)
    for k, members in classes.items():
        t[list(members)] = int(k[1:])
    return t


SPACES = b"\t\n\v\f\r "
#: Runs of anything but ASCII white space.
WORDS = byte_table(1, c0=SPACES)
#: Runs of letters (and all of UTF-8 beyond ASCII), of digits, of symbols.
PIECES = byte_table(2, c0=SPACES + bytes(range(9)), c1=bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)), c3=b"0123456789")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def buffers(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of chunks of ``texts``; nulls are empty."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def token_hashes(raw: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, fold: np.ndarray = SAME) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, and how many precede each text (one more value at the end)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = kinds[raw]
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin[offsets[:-1][offsets[:-1] < n]] = True
    runs = np.flatnonzero(begin)
    ends = np.append(runs[1:], n)
    real = kind[runs] != 0
    starts, ends = runs[real], ends[real]
    up, down = powers(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((fold[raw].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)
