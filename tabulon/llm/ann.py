"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where Euclidean order is cosine order.  Each
of ``tables`` hash tables cuts ``bits`` Gaussian projections into cells of
width ``width``.  A query visits, besides its own bucket, the neighbouring
buckets of each table in the order of estimated success: the sum of squared
distances from its projections to the crossed cell borders.  The candidates of
all tables are merged and reranked by exact cosine in double precision.

Equal vectors are one entry of the index (the smallest ids stand for them), so
a vector that a third of all rows share costs one candidate.  A bucket is cut
into blocks of at most about ``BLOCK`` entries, and its queries likewise; a task
gets one block of either, multiplies them and keeps each query's best.  No
bucket is capped.

How much a query visits depends on the data: on clustered vectors ten bits and
some thirty probes a table reach the nearest ones through a few hundredths of
the rows; vectors without structure, whose nearest neighbours are hardly nearer
than the rest, are found only by visiting most buckets, whatever the settings.

Defined results: null, empty, zero or non-finite vectors take no part; vectors
of different lengths never meet (each length has its own projections); ties go
to the smaller id; a query with fewer than k other rows found lists those;
of rows with one id the least vector counts; no rows in, no rows out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import kernels as K
from .storage import materialise

#: Set for recall of 0.9 and more on vectors with little structure (nearest cosines near 0.4), where that takes
#: most buckets; for well-separated data at scale raise BITS.
TABLES = 5
BITS = 4
WIDTH = 1.2
PROBES = 40
#: Index entries and queries of a bucket that meet in one task.
BLOCK = 4096
SEED = 20_240_117


class Family:
    """The projections of all tables, drawn from a seed."""

    def __init__(self, dim: int, tables: int, bits: int, width: float):
        rng = np.random.default_rng([SEED, dim, tables, bits])
        self.a = rng.standard_normal((dim, tables * bits))
        self.b = rng.random(tables * bits) * width
        self.tables, self.bits, self.width = tables, bits, width

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells (n, tables, bits) and the place inside the cell, 0 to 1."""
        at = (x @ self.a + self.b) / self.width
        cell = np.floor(at)
        shape = (len(x), self.tables, self.bits)
        return cell.astype(np.int64).reshape(shape), (at - cell).reshape(shape)

    def keys(self, cell: np.ndarray) -> np.ndarray:
        out = np.zeros(cell.shape[:-1], np.uint64)
        for i in range(self.bits):
            out = K.mix64(out + cell[..., i].astype(np.int64).view(np.uint64) * np.uint64(K.BASES[0]) + np.uint64(i))
        return out


def perturbations(bits: int, most: int) -> list[tuple[int, ...]]:
    """Sets of ranks, best first in expectation.

    Ranks 0 .. 2 bits - 1 order the single moves of a query by cost; move
    r and its partner (the other side of the same projection) are never
    combined.  The order uses the expected squared cost of each rank.
    """
    m = 2 * bits
    rank = np.arange(1, bits + 1)
    low = rank * (rank + 1) / (4.0 * (bits + 1) * (bits + 2))
    high = 1 - (m + 1 - np.arange(bits + 1, m + 1)) / (bits + 1.0) + (m + 1 - np.arange(bits + 1, m + 1)) * (m + 2 - np.arange(bits + 1, m + 1)) / (4.0 * (bits + 1) * (bits + 2))
    cost = np.concatenate([low, high])
    heap, out = [(cost[0], (0,))], []
    while heap and len(out) < most:
        score, move = heapq.heappop(heap)
        if len({min(r, m - 1 - r) for r in move}) == len(move):
            out.append(move)
        last = move[-1]
        if last + 1 < m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*move[:-1], last + 1)))
            heapq.heappush(heap, (score + cost[last + 1], (*move, last + 1)))
    return out


def plain_rows(arr: pa.Array) -> np.ndarray:
    return np.asarray(arr.flatten()).astype(np.float64).reshape(len(arr), -1)


def unit_rows(arr: pa.Array) -> np.ndarray:
    flat = plain_rows(arr)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


class Families:
    """The family of each vector length, made when it is met."""

    def __init__(self, tables: int, bits: int, width: float):
        self.settings, self.made = (tables, bits, width), {}

    def parts(self, batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[Family, int, pa.RecordBatch]]:
        """(family, length, rows) of a batch, rows of one length at a time."""
        size = np.diff(np.asarray(batch.column(column).offsets))
        for dim in np.unique(size).tolist():
            if dim not in self.made:
                self.made[dim] = Family(dim, *self.settings)
            rows = np.flatnonzero(size == dim)
            for lo in range(0, len(rows), most):
                yield self.made[dim], dim, batch.take(pa.array(rows[lo : lo + most]))


def index_keys(families: Families):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for family, dim, part in families.parts(batch, "v", 4096):
                keys = family.keys(family.cells(unit_rows(part.column("v")))[0])
                n, t = keys.shape
                at = pa.array(np.repeat(np.arange(n), t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n * t, dim, np.int32)), pa.array(np.tile(np.arange(t, dtype=np.int32), n)), pa.array(K.signed(keys.ravel())), part.column("g").take(at), part.column("v").take(at)],
                    ["dim", "t", "key", "g", "v"],
                )

    return run


def probe_table(bits: int, probes: int) -> np.ndarray:
    """(probe, rank of the move) flags: the own bucket, then the perturbations."""
    moves = perturbations(bits, probes)
    table = np.zeros((len(moves) + 1, 2 * bits), bool)
    for i, move in enumerate(moves):
        table[i + 1, list(move)] = True
    return table


def probed_keys(family: Family, table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(probe, row, table): the keys that each unit vector visits."""
    bits = family.bits
    cell, inside = family.cells(x)
    cost = np.concatenate([inside, 1 - inside], -1)  # to the lower and to the upper border
    rank = np.argsort(np.argsort(cost, axis=-1, kind="stable"), axis=-1, kind="stable")
    moved = table[:, rank]  # (probe, n, t, 2 bits)
    shift = moved[..., bits:].astype(np.int64) - moved[..., :bits].astype(np.int64)
    return family.keys(cell[None] + shift)


def probe_keys(families: Families, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = probe_table(families.settings[1], probes)
        for batch in batches:
            for family, dim, part in families.parts(batch, "qv", 256):
                keys = probed_keys(family, table, unit_rows(part.column("qv")))
                p, n, t = keys.shape
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(p * n * t, dim, np.int32)), pa.array(np.tile(np.arange(t, dtype=np.int32), p * n)), pa.array(K.signed(keys.ravel())), part.column("q").take(pa.array(np.tile(np.repeat(np.arange(n), t), p)))],
                    ["dim", "t", "key", "q"],
                )

    return run


def block_best(most: int):
    """A block of the index and a block of queries to each query's best entries."""

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["q", "g", "score"]
        if not index.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        index, asked = index.combine_chunks(), asked.combine_chunks()
        g, y = np.asarray(index.column("g")), plain_rows(index.column("v").chunk(0))
        q, x = np.asarray(asked.column("q")), plain_rows(asked.column("qv").chunk(0))
        size_x, size_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        out = []
        for lo in range(0, len(q), 256):
            rough = (x[lo : lo + 256] / size_x[lo : lo + 256, None]) @ (y / size_y[:, None]).T
            keep = min(most, len(g))
            # ties at the edge are kept, so that ids decide
            edge = np.partition(rough, len(g) - keep, axis=1)[:, len(g) - keep, None] - 1e-9
            i, j = np.nonzero(rough >= edge)
            score = (x[lo + i] * y[j]).sum(1) / (size_x[lo + i] * size_y[j])
            order = np.lexsort((g[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            first = np.searchsorted(i, i)
            top = np.arange(len(i)) - first < most
            out.append((q[lo + i[top]], g[j[top]], score[top]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return run


def usable(v: Column) -> Column:
    return (
        v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    tables: int = TABLES,
    bits: int = BITS,
    width: float = WIDTH,
    probes: int = PROBES,
) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found, nearest first. ``is_query`` is a condition on ``id``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    # of equal vectors the k + 1 smallest ids can be in a list; the limit applies before the shuffle
    members = rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    members = materialise(members.withColumn("g", F.min("id").over(W.partitionBy("v"))), "members")
    groups = members.filter("n = 1").select("g", "v")
    queries = rows.filter(is_query).join(groups, "v").select("id", "g")
    queries = materialise(queries, "queries")
    asked = materialise(groups.join(queries.select("g").distinct(), "g").select(F.col("g").alias("q"), F.col("v").alias("qv")), "asked")
    families = Families(tables, bits, width)
    vector = groups.schema["v"].dataType.simpleString()
    index = materialise(groups.mapInArrow(index_keys(families), f"dim int, t int, key long, g long, v {vector}"), "index")
    probed = materialise(asked.mapInArrow(probe_keys(families, probes), "dim int, t int, key long, q long"), "probes")
    held = index.groupBy("dim", "t", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    sought = probed.groupBy("dim", "t", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("q_parts"))
    blocks = materialise(held.join(sought, ["dim", "t", "key"]), "blocks")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(blocks, ["dim", "t", "key"]).withColumn("part", F.pmod(F.xxhash64("g"), F.col("parts")).cast("int")).withColumn("q_part", every("q_parts"))
    right = probed.join(blocks, ["dim", "t", "key"]).withColumn("q_part", F.pmod(F.xxhash64("q"), F.col("q_parts")).cast("int")).withColumn("part", every("parts"))
    block = ["dim", "t", "key", "part", "q_part"]
    scored = (
        left.select(*block, "g", "v").groupBy(*block)
        .cogroup(right.join(asked, "q").select(*block, "q", "qv").groupBy(*block))
        .applyInArrow(block_best(k + 1), "q long, g long, score double")
        .distinct()
    )
    best_first = W.partitionBy("q").orderBy(F.desc("score"), "g")
    close = scored.withColumn("n", F.row_number().over(best_first)).filter(F.col("n") <= k + 1).drop("n")
    listed = close.join(members.select("g", "id"), "g")
    listed = listed.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k + 1)
    lists = listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("near"))
    own = queries.join(lists, queries.g == lists.q).select(F.col("id").alias("query_id"), F.filter("near", lambda x: x["id"] != F.col("id")).alias("near"))
    return own.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("place", "x")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score")
    )
