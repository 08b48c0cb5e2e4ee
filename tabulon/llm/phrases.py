"""Content-defined phrases of texts and the windows that start in them (numpy kernels).

A text is a sequence of units (words or bytes).  Rolling-hash triggers cut it:
a gram of ``gram`` units is a trigger of the window of ``width`` units that
starts at s if its hash is the least among the first ``reach`` grams of that
window (the first one, of equals).  The choice depends on the window alone, so
equal windows have the same trigger at the same offset wherever they stand.

Window starts fall into runs with one trigger each: a *phrase* is such a run.
Its *head* is what all windows of that trigger share, ``width - reach + 1``
units from the trigger; its *body* is every unit of its windows.  So a window
can stand in two phrases only if their heads are equal, and all windows of two
phrases are equal if their bodies are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from . import kernels as K

U64 = np.uint64
#: Low bits that hold a position while the least hash of a window is sought.
PLACE_BITS = 31
PLACE = U64((1 << PLACE_BITS) - 1)
#: Units of a longer text that are worked on at once.
PIECE = 1 << 21


@dataclass(frozen=True)
class Cut:
    """What a unit is, how many make a window, a gram, and how many grams compete for the trigger."""

    unit: str  # "word" or "byte"
    width: int
    gram: int
    reach: int

    @classmethod
    def of(cls, unit: str, width: int, gram: int, reach: int) -> Cut:
        gram = min(gram, width)
        return cls(unit, width, gram, min(reach, width - gram + 1))

    @property
    def head(self) -> int:
        return self.width - self.reach + 1


def bounds(cut: Cut, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every unit (None for bytes: a unit is its place), and the unit offsets of each text."""
    if cut.unit == "byte":
        return None, None, offsets
    return K.word_bounds(data, offsets, K.NOT_SPACE)


def values(cut: Cut, data: np.ndarray, s: np.ndarray, e: np.ndarray, which: int = 0) -> np.ndarray:
    if cut.unit == "byte":
        return K.byte_values(which)[data]
    return K.word_hashes(data, s, e, which)


def pieces(cut: Cut, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(unit values, unit offsets of texts, place of the first unit): the whole chunk, or overlapping parts of one long text."""
    s, e, off = bounds(cut, data, offsets)
    n = int(off[-1])
    if n <= PIECE or len(off) > 2:
        yield values(cut, data, s, e), off, 0
        return
    for lo in range(0, n - cut.width + 1, PIECE):
        hi = min(n, lo + PIECE + cut.width - 1)
        if cut.unit == "byte":
            part = values(cut, data[lo:hi], s, e)
        else:
            part = values(cut, data[s[lo] : e[hi - 1]], s[lo:hi] - s[lo], e[lo:hi] - s[lo])
        yield part, np.array([0, hi - lo]), lo


def phrases(cut: Cut, vals: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first window start in it, head hash, body hash) of every phrase, in order."""
    roll = K.Rolling(vals)
    grams = roll.grams(cut.gram)
    none = np.zeros(0, np.int64)
    if len(vals) < cut.width:
        return none, none, none.view(U64), none.view(U64)
    tagged = (grams & ~PLACE) | np.arange(len(grams), dtype=U64)
    least = K.slide(tagged, cut.reach, np.minimum)
    size = np.diff(off)
    start = np.flatnonzero(np.arange(len(vals)) + cut.width <= np.repeat(off[1:], size))
    if not len(start):
        return none, none, none.view(U64), none.view(U64)
    owner = (least[start] & PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    # the next window belongs to the same phrase if it starts one unit later and has the same trigger
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    s0, s1, at = start[first], start[last], owner[first]
    text = np.searchsorted(off, s0, "right") - 1
    head = roll.slices(at, at + cut.head)
    body = roll.slices(s0, s1 + cut.width) + K.mix64(((at - s0) * (cut.reach + 1) + (s1 - s0)).astype(U64) + U64(1))
    return text, s0 - off[text], head, body


PARSED = "n long, s array<int>, h array<long>, u array<long>"


def parsed(cut: Cut):
    """Batches with a ``text`` column to the same with n (units), s, h, u (start, head and body of each phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column("text")):
                found = [[], [], [], []]
                counts = np.diff(bounds(cut, data, offsets)[2])
                for vals, off, base in pieces(cut, data, offsets):
                    text, s, h, u = phrases(cut, vals, off)
                    for col, x in zip(found, (text, s + base, h, u), strict=True):
                        col.append(x)
                text, s, h, u = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in found)
                edges = pa.array(np.searchsorted(text, np.arange(hi - lo + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (s.astype(np.int32), h.view(np.int64), u.view(np.int64))]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts.astype(np.int64)), *lists], [*batch.schema.names, "n", "s", "h", "u"])

    return run


class Lists:
    """Rows of a list column as numpy slices."""

    def __init__(self, column: pa.Array):
        self.offsets, self.values = np.asarray(column.offsets), np.asarray(column.values)

    def __getitem__(self, row: int) -> np.ndarray:
        return self.values[self.offsets[row] : self.offsets[row + 1]]


def ends(cut: Cut, n: int, s: np.ndarray) -> np.ndarray:
    """The last window start of each phrase."""
    return np.append(s[1:] - 1, n - cut.width) if len(s) else s


def windows(cut: Cut, keys: tuple[str, ...]):
    """(keys, text, n, s, open) to (w1, w2, keys, at): the 128-bit hash of every window of the open phrases.

    ``open`` has the starts of phrases; -1 - start asks for windows without a
    place of their own (``at`` is -1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, opened = Lists(batch.column("s")), Lists(batch.column("open"))
            count = batch.column("n").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in K.chunks(batch.column("text")):
                us, ue, off = bounds(cut, data, offsets)
                row, first, last, placed = [], [], [], []
                for r in range(lo, hi):
                    s, want = starts[r].astype(np.int64), opened[r].astype(np.int64)
                    placed.append(want >= 0)
                    i = np.searchsorted(s, np.where(want < 0, -1 - want, want))
                    row.append(np.full(len(i), r))
                    first.append(s[i])
                    last.append(ends(cut, int(count[r]), s)[i])
                row, first, last = (np.concatenate(x).astype(np.int64) for x in (row, first, last))
                placed = np.concatenate(placed)
                sizes = np.concatenate(([0], np.cumsum(last - first + cut.width)))
                x = 0
                while x < len(row):
                    y = max(x + 1, int(np.searchsorted(sizes, sizes[x] + (PIECE >> 1), "right")) - 1)
                    yield hashed(cut, batch, keys, data, us, ue, off[row[x:y] - lo], row[x:y], first[x:y], last[x:y], placed[x:y])
                    x = y

    return run


def hashed(cut: Cut, batch: pa.RecordBatch, keys: tuple[str, ...], data, us, ue, base, row, first, last, placed) -> pa.RecordBatch:
    """The windows first .. last of each given row, whose units start at ``base``."""
    size = last - first + cut.width  # units of each range
    edge = np.concatenate(([0], np.cumsum(size)))
    unit = np.repeat(base + first - edge[:-1], size) + np.arange(edge[-1])
    n_starts = last - first + 1
    step = np.arange(int(n_starts.sum())) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    at = np.repeat(edge[:-1], n_starts) + step
    cols = []
    for which in (0, 1):
        if cut.unit == "byte":
            vals = K.byte_values(which)[data[unit]]
        else:
            # the bytes from the first to the last word of each range, one range after another
            b0, b1 = us[base + first], ue[base + last + cut.width - 1]
            at_byte = np.concatenate(([0], np.cumsum(b1 - b0)))
            shift = np.repeat(at_byte[:-1] - b0, size)
            place = np.repeat(b0 - at_byte[:-1], b1 - b0) + np.arange(at_byte[-1])
            vals = K.word_hashes(data[place], us[unit] + shift, ue[unit] + shift, which)
        cols.append(pa.array(K.signed(K.Rolling(vals, which).slices(at, at + cut.width))))
    rows = pa.array(np.repeat(row, n_starts))
    where = np.where(np.repeat(placed, n_starts), np.repeat(first, n_starts) + step, -1)
    return pa.RecordBatch.from_arrays([*cols, *(batch.column(c).take(rows) for c in keys), pa.array(where.astype(np.int32))], ["w1", "w2", *keys, "at"])


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(cut: Cut, n: int, s: np.ndarray, known: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units that repeated windows cover.

    ``known``: starts of phrases without a repeated window; ``single``: windows
    that are not repeated, of phrases whose windows were looked at one by one.
    All other windows are.
    """
    if not len(s):
        return s, s
    whole = np.ones(len(s), bool)
    whole[np.searchsorted(s, known)] = False
    flag = np.repeat(whole, ends(cut, n, s) - s + 1)
    flag[single - s[0]] = False
    r0, r1 = runs(flag)
    r1 = r1 + cut.width - 1
    if not len(r0):
        return r0, r1
    # runs closer than a window overlap
    new = np.ones(len(r0), bool)
    new[1:] = r0[1:] > r1[:-1]
    first = np.flatnonzero(new)
    return r0[first], r1[np.append(first[1:], len(r0)) - 1]


KEPT = "id long, n_units long, kept binary, starts array<long>, lengths array<long>"


def without_repeats(cut: Cut):
    """(id, text, n, s, known, single) to (id, n_units, kept, starts, lengths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [Lists(batch.column(c)) for c in ("s", "known", "single")]
            count = batch.column("n").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in K.chunks(batch.column("text")):
                kept, starts, lengths = [], [], []
                for r in range(lo, hi):
                    raw = data[offsets[r - lo] : offsets[r - lo + 1]].tobytes()
                    a, b = covered(cut, int(count[r]), *(x[r].astype(np.int64) for x in lists))
                    seq = raw.split() if cut.unit == "word" else raw
                    parts = [seq[i:j] for i, j in zip([0, *b.tolist()], [*a.tolist(), len(seq)], strict=True)]
                    kept.append(b" ".join(w for p in parts for w in p) if cut.unit == "word" else b"".join(parts))
                    starts.append(a)
                    lengths.append(b - a)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n"), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64()))],
                    ["id", "n_units", "kept", "starts", "lengths"],
                )

    return run
