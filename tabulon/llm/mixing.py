"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Sources are queues, documents are sent in packets of at most ``PACKET`` words.
Each source gets a target (its weighted share of the budget; no source above
``repeats`` times its size, the excess reshared by weight).  A source's
documents stand in a shuffled order that depends on their ids alone, offered
``repeats`` times over.  A packet's virtual finish time is the words of its
source up to its end, divided by the source's target.  All packets are range
sorted by finish time; a running total over that global order truncates the mix
where the budget of all sources together is spent, inside a packet if need be.
What each source was served by then, less than a packet from its target, says
how much of each document the mix takes.

No running sum needs a task per source or for all: a first sum over slices (of
a source's shuffled order, of the global order) gives each slice its offset,
the second runs inside a slice.  A source of a third of all rows spreads over
all slices.

Defined results: null texts have size 0 and nothing taken; a null source is a
source of its own, last in order; sources order by code point; repeated rows
are documents of their own, one after the other; rows of one id and different
texts stand by size; if all sizes are 0 all targets are 0; no rows in, no rows
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import discard, materialise, n_parts

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Hex digits of the shuffled order that make a slice: 16**3 slices a source.
SLICE_DIGITS = 3
#: Words served at once.
PACKET = 256
#: Files of a stored result, for each core of the session.
FILES_PER_CORE = 2


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(src, src_null, source_size) to the same with ``target``; one row a source.

    Ordered by cap / weight, the sources that reach their cap come first; the
    level at which the others share the rest by weight follows from running sums.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("src_null", "src")) - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.get(cycle, F.pmod("rank", F.lit(len(weights)))).cast("long")).withColumn("cap", F.col("source_size") * repeats)
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("cap") / F.col("weight"))
    settled = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    return ranked.select(
        "src", "src_null", "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), settled["level"] * F.col("weight")), F.col("cap").cast("double")).alias("target"),
    )


def schedule(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken, finish (virtual time of the first copy), and ``carry`` as a struct."""
    ident = F.col(id_col).cast("long")
    source = F.col(source_col).cast("string")
    kept = [F.struct(*[F.col(c) for c in carry]).alias("carried")] if carry else []
    rows = docs.select(
        ident.alias("id"), n_words(F.col(text_col)).alias("size"),
        F.coalesce(source, F.lit("")).alias("src"), source.isNull().alias("src_null"),
        F.md5(F.coalesce(ident.cast("string"), F.lit("null")).cast("binary")).alias("turn"), *kept,
    ).withColumn("slice", F.substring("turn", 1, SLICE_DIGITS))
    # without what is carried, so that the order of service moves no text
    slim = materialise(rows.drop("carried"), "sizes")
    slices = slim.groupBy("src", "src_null", "slice").agg(F.sum("size").alias("slice_size"))
    sizes = slices.groupBy("src", "src_null").agg(F.sum("slice_size").alias("source_size"))
    in_order = W.partitionBy("src", "src_null").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = slices.select("src", "src_null", "slice", F.coalesce(F.sum("slice_size").over(in_order), F.lit(0)).alias("offset"))
    placed = offsets.join(source_targets(sizes, weights, share, repeats), ["src", "src_null"])
    inside = W.partitionBy("src", "src_null", "slice").orderBy("turn", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    # the sum inside a slice uses the exchange that the join on the same keys needs
    def timed(rows: DataFrame, placed: DataFrame) -> DataFrame:
        placed_rows = rows.withColumn("upto", F.sum("size").over(inside)).join(placed.hint("merge"), ["src", "src_null", "slice"])
        return placed_rows.withColumn("end", F.col("offset") + F.col("upto")).drop("offset", "upto", "slice", "turn")

    placed = materialise(placed, "placed")
    served = served_words(timed(slim, placed).select("src", "src_null", "source_size", "target", "size", "end"), sizes, share, repeats)
    # joined to the slices, so that no text moves for it
    placed = placed.join(served, ["src", "src_null"], "left").withColumn("served", F.coalesce("served", F.lit(0)))
    mixed = timed(rows if carry else slim, placed)
    first = F.col("end") - F.col("size")
    taken = sum(
        F.greatest(F.lit(0), F.least(F.col("size"), F.col("served") - (first + F.col("source_size") * turn))) for turn in range(repeats)
    )
    return mixed.select(
        "id", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.when(F.col("target") > 0, F.col("end") / F.col("target")).alias("finish"), *(["carried"] if carry else []),
    )


def served_words(timed: DataFrame, sizes: DataFrame, share: float, repeats: int) -> DataFrame:
    """(src, src_null, served): the words of each source in the mix, cut where the running total over all packets meets the budget."""
    copy = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy")
    copies = timed.filter("size > 0 and target > 0").select("src", "src_null", "target", "size", "source_size", "end", copy)
    start = F.col("end") - F.col("size") + F.col("source_size") * F.col("copy")
    nth = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / PACKET)))
    packets = copies.select("src", "src_null", "target", "size", start.alias("start"), nth.alias("nth"))
    words = F.least(F.col("size") - F.col("nth") * PACKET, F.lit(PACKET).cast("long"))
    packets = packets.select("src", "src_null", "target", words.alias("words"), (F.col("start") + F.col("nth") * PACKET + words).alias("end"))
    packets = packets.select("src", "src_null", "words", "end", (F.col("end") / F.col("target")).alias("finish"))
    key = ["finish", "src_null", "src", "end"]
    spark = timed.sparkSession
    # stored as they come, several parts to a file, since every file costs the executor processes that set its permissions
    n_files = FILES_PER_CORE * spark.sparkContext.defaultParallelism
    queue = materialise(packets.repartitionByRange(n_parts(spark), *key).withColumn("part", F.spark_partition_id()).coalesce(n_files), "packets")
    # one row a partition of the global order
    parts = queue.groupBy("part").agg(F.sum("words").alias("total"))
    order = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy(*key).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = queue.withColumn("total", F.sum("words").over(inside)).join(F.broadcast(parts), "part").withColumn("total", F.col("total") + F.col("before"))
    budget = sizes.agg(F.floor(F.sum("source_size") * F.lit(share)).alias("budget"))
    cut = F.greatest(F.lit(0), F.least(F.col("words"), F.col("budget") - (F.col("total") - F.col("words"))))
    served = total.join(F.broadcast(budget)).groupBy("src", "src_null").agg(F.sum(cut).cast("long").alias("served"))
    served = materialise(served.coalesce(n_files), "served")
    discard(queue)
    return served


def mix(docs: DataFrame, **options) -> DataFrame:
    """The schedule in service order: a global range sort by virtual finish time."""
    return schedule(docs, **options).orderBy("finish", "id", "size")
