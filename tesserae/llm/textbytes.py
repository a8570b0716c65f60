"""Texts of Arrow batches as numpy arrays of UTF-8 bytes, and hashes of words, shingles and windows of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that end a word: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache
def byte_values(seed: int = 1) -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, modulo 2**64, of an odd base and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x reaches every bit of the result."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def prefix_hash(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums from which range_hash() takes the polynomial hash of any range; one longer than data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each range of bytes; equal bytes give equal hashes wherever they stand.

    Texts can be built whose hashes agree, so it only chooses places; what tells bytes apart is span_hashes().
    """
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


#: Ranges of more bytes are hashed one by one.
LONG = 1024
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each range of bytes, eight bytes a step. Each step mixes, so that no choice of bytes cancels out.

    Hashes under two seeds are as good as one of 128 bits.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    n = ends - starts
    h = mix(n.astype(U64) * U64(0x9FB21C651E98DF25) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64) | 1))
    todo = np.flatnonzero((n > 0) & (n <= LONG))
    at = 0
    while len(todo):
        left = n[todo] - at
        block = eight[starts[todo] + at] & _LOW_BYTES[np.minimum(left, 8)]
        h[todo] = mix(h[todo] * U64(0xD6E8FEB86659FD93) ^ block)
        at += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(n > LONG).tolist():
        whole = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = int.from_bytes(whole.digest(), "little")
    return h


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given ranges of values, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)]


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) of runs of whole rows of about `most` bytes; nulls are empty."""
    arr = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        width = np.int64
    elif pa.types.is_string(arr.type) or pa.types.is_binary(arr.type):
        width = np.int32
    else:
        raise TypeError(f"{column} is {arr.type}, not a string")
    if not len(arr):
        return
    if arr.null_count:
        arr = arr.fill_null(b"" if "binary" in str(arr.type) else "")
    _, offsets, data = arr.buffers()
    offsets = np.frombuffer(offsets, width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(arr):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the rows, and the rows' offsets in them. No word crosses from one row to the next."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    last = ~space
    last[:-1] &= space[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = ~space[edges]
    last[edges - 1] = ~space[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and the rows' offsets in them."""
    data = LOWER[data] if lower else data
    starts, ends, rows = word_spans(data, offsets)
    return span_hashes(data, starts, ends), rows


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's k-word shingles, and the rows' offsets in them.

    A row with fewer than k words, but one at least, has its whole sequence as its one shingle.
    """
    words, rows = word_hashes(data, offsets)
    n = np.diff(rows)
    per_row = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    total = int(per_row.sum())
    out_rows = np.zeros(len(rows), np.int64)
    np.cumsum(per_row, out=out_rows[1:])
    if not total:
        return np.zeros(0, U64), out_rows
    at = np.arange(total) - np.repeat(out_rows[:-1] - rows[:-1], per_row)  # the first word of each shingle
    end = np.repeat(rows[1:], per_row)
    h = np.zeros(total, U64)
    for i in range(k):
        w = np.where(at + i < end, words[np.minimum(at + i, len(words) - 1)], U64(0))
        h = (h ^ w) * U64(0x9FB21C651E98DF25) + U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(29)
    h = mix(h)
    for s, e in zip(out_rows[:-1].tolist(), out_rows[1:].tolist()):
        if e - s > 1:
            h[s:e].sort()
    fresh = np.ones(total, bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[out_rows[:-1][per_row > 0]] = True
    kept = np.zeros(total + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return h[fresh], kept[out_rows]


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    """The largest of each w neighbours, by prefix and suffix maxima of blocks (van Herk)."""
    n = len(x)
    padded = np.zeros(-(-n // w) * w, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    up = np.maximum.accumulate(rows, axis=1).ravel()
    down = np.maximum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(down[: n - w + 1], up[w - 1 : n])
