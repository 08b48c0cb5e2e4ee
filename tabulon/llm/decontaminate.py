"""Benchmark decontamination by winnowing.

Texts become lower-case words.  Of every window of ``window`` words the least
``gram``-word hash is a fingerprint, for documents and benchmark items alike,
so two equal windows always share one.  Documents' fingerprints are joined with
the items', and every hit is extended: all windows around it are compared by a
128-bit hash.  No shared window is missed, and none is reported that is not there.

The item index is broadcast only while its measured size stays under
``broadcast_bytes``; beyond it the same fingerprints meet in shuffled joins.

Defined results: null or wordless texts have no words and no hits; an item of
fewer words than the window counts as one window; an item without words never
occurs; repeated items count once; items without an id hit words like any other
and are one null in the list of items, last; item ids may be numbers or texts
and are listed as text; repeated documents each get their row; no items: nothing
is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .phrases import runs
from .storage import materialise

WINDOW = 10
GRAM = 5
#: Largest item index that is sent to every executor.
BROADCAST_BYTES = 64 << 20
U64 = np.uint64


def gram_of(m: int) -> int:
    return min(GRAM, m)


def two_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Rolling, K.Rolling, np.ndarray]:
    data = K.LOWER[data]
    s, e, off = K.word_bounds(data, offsets, K.ALNUM)
    return K.Rolling(K.word_hashes(data, s, e, 0), 0), K.Rolling(K.word_hashes(data, s, e, 1), 1), off


def window_ok(off: np.ndarray, m: int) -> np.ndarray:
    n = int(off[-1]) - m + 1
    return np.arange(max(n, 0)) + m <= K.ends_of(off)[: max(n, 0)]


def fingerprints(roll: K.Rolling, off: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed positions for windows of m words, and their hashes."""
    k = gram_of(m)
    grams = roll.grams(k)
    at = K.minimisers(grams, window_ok(off, m), m - k + 1)
    return at, grams[at]


def around(at: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """Starts of the windows of m words that may hold the fingerprints, each once."""
    reach = m - gram_of(m) + 1
    doc = np.searchsorted(off, at, "right") - 1
    s = at[:, None] - np.arange(reach)
    ok = (s >= off[doc][:, None]) & (s + m <= off[doc + 1][:, None])
    return np.unique(s[ok])


def item_windows(window: int):
    """(item, text) to (m, v1, v2, item) of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item")
            for lo, _hi, data, offsets in K.chunks(batch.column("text")):
                ra, rb, off = two_hashes(data, offsets)
                count = np.diff(off)
                for m in np.unique(np.minimum(count, window)):
                    if m == 0:
                        continue
                    ok = window_ok(off, int(m))
                    s = np.flatnonzero(ok)
                    doc = np.searchsorted(off, s, "right") - 1
                    if m < window:
                        s, doc = s[count[doc] == m], doc[count[doc] == m]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), m, np.int32)), pa.array(K.signed(ra.slices(s, s + m))), pa.array(K.signed(rb.slices(s, s + m))), ids.take(pa.array(doc + lo)), pa.array(K.signed(window_prints(ra, s, int(m))))],
                        ["m", "v1", "v2", "item", "h"],
                    )

    return run


def window_prints(roll: K.Rolling, s: np.ndarray, m: int) -> np.ndarray:
    """The least gram hash of each window, as documents winnow it."""
    grams = roll.grams(gram_of(m)) | U64(1)
    least = K.slide(grams, m - gram_of(m) + 1, np.minimum)
    return least[s]


ITEM_WINDOWS = "m int, v1 long, v2 long, item string, h long"


class Index:
    """Sorted item windows: fingerprint hashes per length, and window hashes with the items that hold them."""

    def __init__(self, windows: pa.Table):
        m, v1, v2, h = (windows.column(c).to_numpy() for c in ("m", "v1", "v2", "h"))
        coded = windows.column("item").combine_chunks().dictionary_encode(null_encoding="encode")
        self.names = coded.dictionary
        item = np.asarray(coded.indices).astype(np.int64)
        self.by_length = {}
        for length in np.unique(m):
            pick = m == length
            a, b, own, prints = v1[pick].view(U64), v2[pick].view(U64), item[pick], np.unique(h[pick].view(U64))
            order = np.lexsort((own, b, a))
            a, b, own = a[order], b[order], own[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            first = np.flatnonzero(new)
            self.by_length[int(length)] = (prints, a[first], b[first], first, np.append(first[1:], len(a)), own)


def member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where each value stands in the sorted table, -1 if nowhere."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


def lookup(index: Index, text_col: str = "text"):
    """Documents to hits against a broadcast index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            for lo, hi, data, offsets in K.chunks(K.texts_in(batch, text_col)):
                ra, rb, off = two_hashes(data, offsets)
                n = int(off[-1])
                edges = np.zeros(n + 1, np.int64)
                docs, items = [], []
                for m, (prints, a, b, first, last, own) in index.by_length.items():
                    if n < m:
                        continue
                    at, h = fingerprints(ra, off, m)
                    s = around(at[member(h | U64(1), prints) >= 0], off, m)
                    # equal first hashes are next to each other in a: try each of them
                    v1, v2 = ra.slices(s, s + m), rb.slices(s, s + m)
                    left, right = np.searchsorted(a, v1, "left"), np.searchsorted(a, v1, "right")
                    where = np.full(len(s), -1)
                    for step in range(int((right - left).max(initial=0))):
                        x = left + step
                        hit = (x < right) & (b[np.minimum(x, len(b) - 1)] == v2)
                        where[hit] = x[hit]
                    s, where = s[where >= 0], where[where >= 0]
                    np.add.at(edges, s, 1)
                    np.add.at(edges, s + m, -1)
                    doc = np.searchsorted(off, s, "right") - 1
                    pairs = np.unique(np.stack([doc, where], 1), axis=0) if len(s) else np.zeros((0, 2), np.int64)
                    for d, x in pairs:
                        items.append(own[first[x] : last[x]])
                        docs.append(np.full(len(items[-1]), d))
                covered = np.cumsum(edges[:n]) > 0
                doc_of = np.concatenate(docs) if docs else np.zeros(0, np.int64)
                item_of = np.concatenate(items) if items else np.zeros(0, np.int64)
                starts, lengths, found = [], [], []
                order = np.argsort(doc_of, kind="stable")
                doc_of, item_of = doc_of[order], item_of[order]
                cut = np.searchsorted(doc_of, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    found.append(np.unique(item_of[cut[i] : cut[i + 1]]))
                    if len(found[-1]):
                        x, y = runs(covered[off[i] : off[i + 1]])
                    else:
                        x = y = np.zeros(0, np.int64)
                    starts.append(x)
                    lengths.append(y - x)
                part = batch.slice(lo, hi - lo)
                edge = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                named = pa.ListArray.from_arrays(pa.array(edge), index.names.take(pa.array(np.concatenate(found))))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(np.diff(off)), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), named],
                    [*kept, "n_words", "starts", "lengths", "items"],
                )

    return run


HITS = "n_words long, starts array<long>, lengths array<long>, items array<string>"


def doc_prints(lengths: list[int]):
    """(rid, text) to (m, h, rid, a): winnowed fingerprints for every window length in use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            for lo, _hi, data, offsets in K.chunks(batch.column("text")):
                ra, _, off = two_hashes(data, offsets)
                for m in lengths:
                    if int(off[-1]) < m:
                        continue
                    at, h = fingerprints(ra, off, m)
                    doc = np.searchsorted(off, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), m, np.int32)), pa.array(K.signed(h | U64(1))), pa.array(rids[doc + lo]), pa.array((at - off[doc]).astype(np.int32))],
                        ["m", "h", "rid", "a"],
                    )

    return run


def doc_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, text, ms, at) to (m, v1, v2, rid, s): the windows around fingerprints that hit."""
    for batch in batches:
        rids = batch.column("rid").to_numpy(zero_copy_only=False)
        ms, at = batch.column("ms"), batch.column("at")
        for lo, hi, data, offsets in K.chunks(batch.column("text")):
            ra, rb, off = two_hashes(data, offsets)
            for row in range(lo, hi):
                own_m = np.asarray(ms[row].as_py())
                own_a = np.asarray(at[row].as_py()) + off[row - lo]
                for m in np.unique(own_m):
                    s = around(own_a[own_m == m], off, int(m))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(s), m, np.int32)), pa.array(K.signed(ra.slices(s, s + m))), pa.array(K.signed(rb.slices(s, s + m))), pa.array(np.full(len(s), rids[row])), pa.array((s - off[row - lo]).astype(np.int32))],
                        ["m", "v1", "v2", "rid", "s"],
                    )


def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, hits of (m, s), items) to the result rows."""
    for batch in batches:
        kept = [c for c in batch.schema.names if c not in ("text", "hits", "items")]
        for lo, hi, data, offsets in K.chunks(batch.column("text")):
            s, e, off = K.word_bounds(K.LOWER[data], offsets, K.ALNUM)
            starts, lengths = [], []
            for row in range(lo, hi):
                n = int(off[row - lo + 1] - off[row - lo])
                edges = np.zeros(n + 1, np.int64)
                for hit in batch.column("hits")[row].as_py():
                    edges[hit["s"]] += 1
                    edges[hit["s"] + hit["m"]] -= 1
                x, y = runs(np.cumsum(edges[:n]) > 0)
                starts.append(x)
                lengths.append(y - x)
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array(np.diff(off)), pa.array(starts, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int64())), part.column("items")],
                [*kept, "n_words", "starts", "lengths", "items"],
            )


def by_shuffle(docs: DataFrame, windows: DataFrame, shape: str) -> DataFrame:
    kept = [c for c in docs.columns if c != "text"]
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())
    stored = materialise(docs.withColumn("rid", F.monotonically_increasing_id()), "docs")
    prints = stored.select("rid", "text").mapInArrow(doc_prints(lengths), "m int, h long, rid long, a int")
    hot = (
        prints.join(windows.select("m", "h").distinct(), ["m", "h"])
        .groupBy("rid")
        .agg(F.collect_list(F.struct("m", "a")).alias("x"))
        .select("rid", F.col("x.m").alias("ms"), F.col("x.a").alias("at"))
    )
    near = stored.select("rid", "text").join(hot, "rid").mapInArrow(doc_windows, "m int, v1 long, v2 long, rid long, s int")
    held = materialise(near.join(windows.select("m", "v1", "v2").distinct(), ["m", "v1", "v2"]), "held")
    places = held.groupBy("rid").agg(F.collect_list(F.struct("m", "s")).alias("hits"))
    # each distinct window of a document meets the items that hold it
    items = (
        held.select("rid", "m", "v1", "v2").distinct()
        .join(windows.select("m", "v1", "v2", "item").distinct(), ["m", "v1", "v2"])
        .groupBy("rid")
        .agg(F.collect_set(F.struct("item")).alias("x"))
        .select("rid", F.col("x.item").alias("items"))
    )
    no_hits = F.array().cast("array<struct<m:int,s:int>>")
    return (
        stored.join(places, "rid", "left")
        .join(items, "rid", "left")
        .select(*kept, "text", F.coalesce("hits", no_hits).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .mapInArrow(assemble, shape)
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_bytes: int = BROADCAST_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """id, ``carry`` as a struct if any, n_words, spans of hit words (start, length), ids (as text, sorted) of the items whose windows occur."""
    windows = materialise(
        items.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
        .mapInArrow(item_windows(window), ITEM_WINDOWS),
        "windows",
    )
    kept = [F.struct(*carry).alias("carried")] if carry else []
    texts = docs.select(F.col(id_col).cast("long").alias("id"), *kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shape = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema.fields[:-1]), HITS])
    if (windows.agg(F.sum(F.coalesce(F.length("item"), F.lit(0)) + 36)).first()[0] or 0) <= broadcast_bytes:
        # the index goes with the plan, so that it ends with it
        index = Index(windows.toArrow())
        # a text among the carried columns travels once
        once = texts.drop("text") if text_col in carry and dict(docs.dtypes)[text_col] == "string" else texts
        hits = once.mapInArrow(lookup(index, text_col), shape)
    else:
        hits = by_shuffle(texts, windows, shape)
    return hits.select(*texts.columns[:-1], "n_words", F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length")).alias("spans"), F.array_sort("items").alias("items"))
