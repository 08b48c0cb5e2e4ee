"""MinHash near-duplicates by DartMinHash signatures.

Every element (word shingle) throws darts: a Poisson process of ranks along
each unit cell of its weight, seeded by the element alone.  A set of total
weight W keeps its darts of rank below t / W, about t in all whatever its
size; each dart falls on one of ``coords`` coordinates, and the earliest dart
of a coordinate is its signature there.  Coordinates left empty get more darts
(t doubles).  Two sets agree on a coordinate with probability equal to their
weighted Jaccard similarity.

Texts are read once: signatures, cut into bands, and the sorted elements of
each text are stored, and no later step moves a text.

1. *Leaders.*  The least text of a bucket leads it; each member is compared with
   its leader by exact similarity, which costs one comparison a member whatever
   the size of the bucket.  Links become classes by connected components.
2. *The rest.*  The texts of every bucket that still holds several classes are
   joined exactly, by filters that lose no similar pair: similar sets share one
   of their rarest elements, early enough in both to leave room for the overlap
   (a pair meets at the first such element); sets whose distances to a common
   leader differ by more than 1 - ``threshold`` are no pair, as the distance is
   a metric.  Only texts of different classes meet.

So no link between classes is lost that shares a band, and a large class is not
paired with itself.  What grows with the square of a group is only the number of
pairs of different classes just below the threshold that no filter tells apart.

Texts are named by a 64-bit hash; two different texts of one hash would count
as equal.

Defined results: null or wordless texts are classes of their own; a text of
fewer than ``shingle`` words is one shingle; equal texts always share a class,
whatever their ids; repeated rows keep their rows; a null id orders last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .storage import discard, materialise

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
U64 = np.uint64
#: Darts thrown at once by an element.
VOLLEY = 4
#: Elements of a prefix that are looked through for an earlier meeting of a pair.
EARLIER = 48
#: Leaders of a text that serve as its pivots.
PIVOTS = 8


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their offsets; texts shorter than k words (but not empty) give one shingle."""
    s, e, off = K.word_bounds(data, offsets, K.NOT_SPACE)
    words = K.Rolling(K.word_hashes(data, s, e))
    count = np.diff(off)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(off[:-1], n) + np.arange(out[-1]) - np.repeat(out[:-1], n)
    return words.slices(first, first + np.repeat(np.minimum(count, k), n)), out


def elements(h: np.ndarray, off: np.ndarray, weighting: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each set as (set, hash, weight), sorted by set then hash."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(h))) if weighting == "count" else np.ones(len(first), np.int64)
    return doc[first], h[first], weight


def exponentials(seed: np.ndarray) -> np.ndarray:
    u = (K.mix64(seed) >> U64(11)).astype(np.float64)
    return -np.log((u + 0.5) * 2.0**-53)


def darts(doc: np.ndarray, cell: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, rank, dart id) of every dart below its set's rank limit. ``cell`` seeds one unit of weight."""
    ranks, ids, owners = [], [], []
    live, base, turn = np.arange(len(cell)), np.zeros(len(cell)), 0
    while len(live):
        for _ in range(VOLLEY):
            seed = cell[live] + U64((turn + 1) * K.BASES[1] % (1 << 64))
            base = base + exponentials(seed)
            ok = base < limit[doc[live]]
            live, base = live[ok], base[ok]
            ranks.append(base)
            ids.append(K.mix64(seed[ok] ^ U64(0xA0761D6478BD642F)))
            owners.append(doc[live])
            turn += 1
            if not len(live):
                break
    return np.concatenate(owners or [np.zeros(0, np.int64)]), np.concatenate(ranks or [np.zeros(0)]), np.concatenate(ids or [np.zeros(0, U64)])


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_sets: int, coords: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_sets, coords) signature, and which sets have one (those with elements)."""
    total = np.bincount(doc, weight, n_sets)
    sig = np.zeros((n_sets, coords), U64)
    has = total > 0
    if weight.max(initial=1) > 1:
        copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
        doc, h = np.repeat(doc, weight), np.repeat(h, weight)
        cell = K.mix64(h + copy.astype(U64) * U64(K.BASES[0]))
    else:
        cell = K.mix64(h)
    t = coords * (np.log(coords) + 4.0)
    todo = has.copy()
    while todo.any():
        mine = todo[doc]
        limit = np.where(todo, t / np.maximum(total, 1), 0.0)
        owner, rank, ident = darts(doc[mine], cell[mine], limit)
        slot = owner * coords + (ident % U64(coords)).astype(np.int64)
        earliest = np.full(sig.size, np.inf)
        np.minimum.at(earliest, slot, rank)
        first = rank == earliest[slot]
        sig.reshape(-1)[slot[first]] = ident[first] | U64(1)
        todo &= (sig == 0).any(axis=1)
        t *= 2
    return sig, has


def sketches(shingle: int, weighting: str, n_bands: int, rows: int):
    """(id, k, text) to (id, k, worded, keys, els, wts).

    Band keys, sorted 32-bit shingle hashes and counts as bytes; all empty but
    in a task's first row of each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            k = batch.column("k").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in K.chunks(batch.column("text"), 1 << 19):
                new = np.zeros(hi - lo, bool)
                for i, x in enumerate(k[lo:hi].tolist()):
                    if x not in met:
                        met.add(x)
                        new[i] = True
                h, off = shingles(data, offsets, shingle)
                worded = np.diff(off) > 0
                size = np.where(new, np.diff(off), 0)
                h, off = h[np.repeat(new, np.diff(off))], np.concatenate(([0], np.cumsum(size)))
                doc, el, weight = elements(h, off, weighting)
                sig, has = signatures(doc, el, weight, hi - lo, n_bands * rows)
                cut = sig[has].reshape(-1, n_bands, rows)
                key = np.broadcast_to(np.arange(1, n_bands + 1, dtype=U64), cut.shape[:2]).copy()
                for r in range(rows):
                    key = K.mix64(key + cut[:, :, r])
                small = (el >> U64(32)).astype("<u4")
                first = np.ones(len(small), bool)
                first[1:] = (small[1:] != small[:-1]) | (doc[1:] != doc[:-1])
                if weighting == "count":
                    weight = np.add.reduceat(weight, np.flatnonzero(first)) if len(weight) else weight
                doc, small = doc[first], small[first]
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                raw = pa.py_buffer(small.tobytes())
                wts = pa.py_buffer(weight.astype("<u4").tobytes()) if weighting == "count" else pa.py_buffer(b"")
                at = pa.py_buffer((edge * 4).astype(np.int32).tobytes())
                none = pa.py_buffer(np.zeros(hi - lo + 1, np.int32).tobytes())
                key_edge = np.concatenate(([0], np.cumsum(np.where(has, n_bands, 0)))).astype(np.int32)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("k"), pa.array(worded), pa.ListArray.from_arrays(pa.array(key_edge), pa.array(K.signed(key.ravel()))),
                        pa.Array.from_buffers(pa.binary(), hi - lo, [None, at, raw]), pa.Array.from_buffers(pa.binary(), hi - lo, [None, at if weighting == "count" else none, wts]),
                    ],
                    ["id", "k", "worded", "keys", "els", "wts"],
                )

    return run


SKETCH = "id long, k long, worded boolean, keys array<long>, els binary, wts binary"


def jaccard(a: bytes, wa: bytes, b: bytes, wb: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = y[at] == x
    if wa:
        u, v = np.frombuffer(wa, "<u4"), np.frombuffer(wb, "<u4")
        shared = int(np.minimum(u[both], v[at[both]]).sum())
        return shared / (int(u.sum()) + int(v.sum()) - shared)
    shared = int(both.sum())
    return shared / (len(x) + len(y) - shared)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., els, wts, lead_els, lead_wts) to (..., sim)."""
    for batch in batches:
        cols = [batch.column(c) for c in ("els", "wts", "lead_els", "lead_wts")]
        sim = [jaccard(*(c[i].as_py() for c in cols)) for i in range(batch.num_rows)]
        kept = [c for c in batch.schema.names if c not in ("els", "wts", "lead_els", "lead_wts")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sim, pa.float64())], [*kept, "sim"])


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (k, lead, ...) with their exact similarity."""
    other = sets.select(F.col("k").alias("lead"), F.col("els").alias("lead_els"), F.col("wts").alias("lead_wts"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    joined = pairs.join(sets, "k").join(other, "lead").select(*pairs.columns, "els", "wts", "lead_els", "lead_wts")
    return materialise(joined.mapInArrow(compared, f"{shape}, sim double"), "similar")


def element_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, els, wts) to (k, size, el): one row an element; the copies of a weighted element are elements of their own."""
    for batch in batches:
        ks = batch.column("k").to_numpy(zero_copy_only=False)
        out, sizes = [], []
        for els, wts in zip(batch.column("els"), batch.column("wts"), strict=True):
            el, w = np.frombuffer(els.as_py(), "<u4").astype(U64), np.frombuffer(wts.as_py(), "<u4")
            if len(w):
                copy = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                el = K.mix64(np.repeat(el, w) + (copy.astype(U64) << U64(32)))
            out.append(el)
            sizes.append(len(el))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ks, sizes)), pa.array(np.repeat(sizes, sizes).astype(np.int32)), pa.array(K.signed(np.concatenate(out)))], ["k", "size", "el"]
        )


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the class of each k; a text without links is its own class."""
    return rows.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """The keys that rows of several classes share."""
    return rows.groupBy(key).agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select(key)


def candidates(buckets: DataFrame, roots: DataFrame, sets: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """(k, lead, root, lead_root): pairs of texts of different classes that share a bucket's text and pass all filters."""
    placed = materialise(with_roots(buckets.select("key", "k"), roots), "placed")
    open_texts = placed.join(mixed(placed, "key"), "key", "left_semi").select("k", "root").distinct()
    pivots = known.groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("lead", "sim"))), 1, PIVOTS).alias("pivots"))
    open_texts = materialise(open_texts.join(pivots, "k", "left").withColumn("pivots", F.coalesce("pivots", F.array().cast("array<struct<lead:bigint,sim:double>>"))), "open")
    rows = materialise(sets.join(open_texts.select("k"), "k").select("k", "els", "wts").mapInArrow(element_rows, "k long, size int, el long"), "elements")
    held = rows.groupBy("el").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    # rarest first; the elements of no other text come before all of these
    ranked = rows.join(materialise(held, "held"), "el").groupBy("k", "size").agg(F.array_sort(F.collect_list(F.struct("held", "el"))).alias("els"))
    alone = F.col("size") - F.size("els")
    wide = F.greatest(F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - 1e-6) + 1 - alone, F.lit(0)).cast("int")
    ranked = ranked.withColumns({"alone": alone, "els": F.slice(F.col("els.el"), F.lit(1), wide)})
    ranked = ranked.select("k", "size", "alone", F.slice("els", 1, EARLIER).alias("early"), F.posexplode("els").alias("at", "el"))
    prefix = ranked.select("el", "k", "size", (F.col("alone") + F.col("at") + 1).alias("nth"), F.slice("early", F.lit(1), F.least("at", F.lit(EARLIER))).alias("early"))
    prefix = materialise(prefix.join(open_texts, "k"), "prefix")
    prefix = prefix.join(mixed(prefix, "el"), "el", "left_semi")
    lead = prefix.select("el", *[F.col(c).alias("lead" if c == "k" else f"lead_{c}") for c in prefix.columns if c != "el"])
    # two sets of enough overlap have their first common element early in both
    overlap = F.ceil((F.col("size") + F.col("lead_size")) * (threshold / (1 + threshold)) - 1e-6)
    room = (F.col("size") - F.col("nth") + 1 >= overlap) & (F.col("lead_size") - F.col("lead_nth") + 1 >= overlap)
    apart = F.exists("pivots", lambda x: F.exists("lead_pivots", lambda y: (x["lead"] == y["lead"]) & (F.abs(x["sim"] - y["sim"]) > 1 - threshold + 1e-9)))
    met = prefix.join(lead, "el").filter((F.col("k") < F.col("lead")) & (F.col("root") != F.col("lead_root")) & room & ~F.arrays_overlap("early", "lead_early") & ~apart)
    out = materialise(met.select("k", "lead", "root", "lead_root").distinct(), "rest")
    discard(placed, open_texts, rows)
    return out


def classes_of_links(sketched: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of the texts that have a link."""
    keyed = sketched.select("k", F.explode("keys").alias("key"))
    # one order of leaders in all bands, so that few pairs differ
    leaders = keyed.groupBy("key").agg(F.min("k").alias("lead"), F.max("k").alias("last")).filter("lead < last").select("key", "lead")
    buckets = materialise(keyed.join(materialise(leaders, "leaders"), "key").select("key", "k", "lead"), "buckets")
    wanted = buckets.select("k").distinct()
    held = sketched.filter(F.length("els") > 0).select("k", "els", "wts").join(wanted, "k", "left_semi")
    # a text has a row in every task that met it
    sets = materialise(held.groupBy("k").agg(F.max(F.struct("els", "wts")).alias("x")).select("k", "x.els", "x.wts"), "sets")
    known = similarities(buckets.filter("k <> lead").select("k", "lead").distinct(), sets)
    roots = materialise(components(known.filter(F.col("sim") >= threshold).select(F.col("k").alias("u"), F.col("lead").alias("v"))), "roots")
    rest = candidates(buckets, roots, sets, known, threshold)
    more = similarities(rest, sets)
    discard(buckets, sets, known, rest)
    joined = components(more.filter(F.col("sim") >= threshold).select(F.col("root").alias("u"), F.col("lead_root").alias("v")))
    joined = materialise(joined.select(F.col("node").alias("of"), F.col("root").alias("top")), "joined")
    # a text without links before may have one now
    both = roots.join(joined, roots.root == joined.of, "left").select("node", F.coalesce("top", "root").alias("root"))
    out = materialise(both.union(joined.join(roots, joined.of == roots.node, "left_anti").select("of", "top")), "classes")
    discard(roots, more, joined)
    return out


def near_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    weighting: str = "set",
    n_bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per input row: id, k (text key), class_id (least id of the class), class_k (text key of its first text), worded."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))
    sketched = materialise(texts.mapInArrow(sketches(shingle, weighting, n_bands, rows), SKETCH), "sketches")
    links = classes_of_links(sketched, threshold)
    slim = materialise(sketched.select("id", "k", "worded"), "rows")
    discard(sketched)
    nodes = slim.groupBy("k").agg(F.min(F.struct(F.col("id").isNull().alias("nil"), "id")).alias("f"))
    nodes = materialise(with_roots(nodes, links).select("k", "root", "f"), "nodes")
    least = nodes.groupBy("root").agg(F.min(F.struct("f", "k")).alias("x")).select("root", F.col("x.f.id").alias("least_id"), F.col("x.k").alias("class_k"))
    named = nodes.join(least, "root").select("k", "least_id", "class_k")
    return slim.join(named, "k").select("id", "k", F.when(F.col("worded"), F.col("least_id")).otherwise(F.col("id")).alias("class_id"), "class_k", "worded")
