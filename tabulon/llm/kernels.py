"""Vectorised hashing over Arrow string buffers (numpy, no per-character Python).

A text column arrives as one byte buffer with offsets.  ``chunks`` walks it in
pieces of about a megabyte of whole texts, so working memory follows the chunk
(or the longest single text), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd multipliers of the two rolling hashes; any odd 64-bit constants do.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bytes between words of white space; any other byte belongs to a word.
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift-xor-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls.kept.get(which)
        if have is None or len(have[0]) < n:
            size = max(1 << 20, 1 << (n - 1).bit_length())
            base = BASES[which]
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                out = np.empty(size, U64)
                out[0] = 1
                done, step = 1, b
                while done < size:
                    out[done : 2 * done] = out[: min(done, size - done)] * U64(step)
                    step = step * step % (1 << 64)
                    done *= 2
                pair.append(out)
            have = cls.kept[which] = (pair[0], pair[1])
        return have


def byte_values(which: int) -> np.ndarray:
    """A random-looking 64-bit value for each byte."""
    return mix64(np.arange(1, 257, dtype=U64) * U64(BASES[which]) + U64(which + 1))


class Rolling:
    """Hashes of any slice of a sequence of 64-bit values in O(1) by prefix sums."""

    def __init__(self, values: np.ndarray, which: int = 0):
        n = len(values)
        power, inverse = Powers.of(which, n + 1)
        self.inverse = inverse
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of every k consecutive values; shorter than the input by k - 1."""
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, U64)
        return mix64((self.prefix[k:] - self.prefix[: n - k + 1]) * self.inverse[: n - k + 1])


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string or binary array; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if len(arr) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(arr: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts, about ``most`` bytes each."""
    data, offsets = buffers(arr)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def texts_in(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The ``text`` column, or the field of ``carried`` that holds the text, so that it travels once."""
    if "text" in batch.schema.names:
        return batch.column("text")
    return batch.column("carried").field(text_col)


def class_table(members: np.ndarray | list[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~class_table(SPACE_BYTES)
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
ALNUM = class_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: The identity but for A-Z, which become a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the word offsets of each text."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = table[data]
    joined = np.empty(n + 1, bool)  # position i continues a word of position i - 1
    joined[0] = joined[n] = False
    np.logical_and(inside[1:], inside[:-1], out=joined[1:n])
    joined[offsets] = False
    starts = np.flatnonzero(inside & ~joined[:n])
    ends = np.flatnonzero(inside & ~joined[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    return Rolling(byte_values(which)[data], which).slices(starts, ends)


def slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive entries, by doubling; shorter than the input by w - 1."""
    if len(x) < w:
        return x[:0]
    have, size = x, 1
    while size * 2 <= w:
        have = op(have[: len(have) - size], have[size:])
        size *= 2
    if size < w:
        have = op(have[: len(x) - w + 1], have[w - size : w - size + len(x) - w + 1])
    return have


def minimisers(h: np.ndarray, starts_ok: np.ndarray, w: int) -> np.ndarray:
    """Positions that hold the least hash of some window of w hashes.

    ``starts_ok[i]`` tells whether the window that begins at i counts.  Ties
    keep every least position, so the choice depends on the window's content
    alone.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    h = h | U64(1)
    least = slide(h, w, np.minimum)
    least[~starts_ok[: len(least)]] = 0
    padded = np.zeros(len(h) + w - 1, U64)
    padded[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(slide(padded, w, np.maximum) == h)


def ends_of(offsets: np.ndarray) -> np.ndarray:
    """For every position, the end of the text that holds it."""
    return np.repeat(offsets[1:], np.diff(offsets))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
