"""Substring dedup by relative Lempel-Ziv parsing against the whole corpus.

*Reference.*  Every text is a reference.  Texts are cut into content-defined
phrases of words (see ``phrases``); the index holds each distinct phrase with
the first place, in the order of ids and words, at which it stands.  It is cut
into blocks by the hash of a phrase's head, so a phrase meets every block that
can hold a copy of it, which is one.

*Factors.*  A phrase whose first place is elsewhere is copied from there.  A
text is factored greedily from its start: consecutive copied phrases make one
factor as long as they go on.

*Boundaries.*  A factor may reach into the phrases next to it.  Those share
their head with another phrase of the index; there the windows of ``window``
words are looked up one by one, each with its own first place.

A factor of at least ``window`` words, boundaries included, is a duplicate
span: exactly the words that windows with an earlier copy cover.

Per phrase one row moves (two hashes and its place, least places taken before
the move), texts move once.

Defined results: a null or blank text has no words and nothing removed; a text
shorter than the window is kept; of repeated rows with one id and one text none
is the earlier; different texts of one id are ordered by a hash of the text; a
null id orders after all others; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .phrases import KEPT, PARSED, Cut, parsed, windows, without_repeats
from .storage import bucketed, discard, materialise, n_parts

WINDOW = 20
#: Words of a trigger.
GRAM = 5
REACH = 16
NONE = "array<int>"
#: A place is one number: the id (nulls last), a hash of the text, and the word, so that the least place is a sum-like aggregate.
WORD_BITS = 30
PLACE = "decimal(38,0)"


def text_place(ident: Column, text: Column) -> Column:
    """The place of a text's first word: ids from 0 up, null after all, then 30 bits of the text's hash."""
    order = F.when(ident.isNull(), F.lit(str(1 << 64)).cast(PLACE)).otherwise(ident.cast(PLACE) + F.lit(str(1 << 63)).cast(PLACE))
    tie = F.pmod(F.xxhash64(text), F.lit(1 << WORD_BITS))
    scaled = (order.cast("decimal(20,0)") * F.lit(1 << WORD_BITS).cast("decimal(10,0)")).cast("decimal(30,0)") + tie.cast("decimal(10,0)")
    return (scaled.cast("decimal(30,0)") * F.lit(1 << WORD_BITS).cast("decimal(10,0)")).cast(PLACE)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """id, n_units (words), kept (UTF-8 bytes: kept words joined by one space), spans (start, length in words)."""
    cut = Cut.of("word", window, gram, reach)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("p", text_place(F.col("id"), F.col("text")))
    rows = rows.select(F.xxhash64("p").alias("k"), "p", "id", "text").repartition(n_parts(docs.sparkSession), "k")
    texts = bucketed(rows.mapInArrow(parsed(cut), f"k long, p {PLACE}, id long, text string, {PARSED}"), "k", "parse")

    def placed(word: str) -> Column:
        return (F.col("p") + F.col(word)).cast(PLACE).alias("o")

    word = F.pmod("o", F.lit(1 << WORD_BITS).cast(PLACE)).cast("int")
    back = [F.xxhash64((F.col("o") - F.pmod("o", F.lit(1 << WORD_BITS).cast(PLACE))).cast(PLACE)).alias("k"), word.alias("s")]
    index = texts.select("p", F.inline(F.arrays_zip("s", "h", "u"))).select("h", "u", placed("s")).groupBy("h", "u").agg(F.min("o").alias("o"))
    index = materialise(index.select("h", *back), "index")
    near = index.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", F.lit(True).alias("near"))
    entries = index.join(near, "h", "left").select("k", "s", F.coalesce("near", F.lit(False)).alias("near"))

    marks = entries.groupBy("k").agg(*[F.collect_list(F.expr(f"if(near, {a}, {b})")).alias(c) for c, a, b in (("known", "null", "s"), ("open", "s", "null"))])
    marks = materialise(marks, "marks")
    edges = texts.select("k", "p", "text", "n", "s").join(marks.filter("size(open) > 0").select("k", "open"), "k").drop("k")
    found = edges.mapInArrow(windows(cut, ("p",)), f"w1 long, w2 long, p {PLACE}, at int")
    first = found.select("w1", "w2", placed("at")).groupBy("w1", "w2").agg(F.min("o").alias("o")).select(*back)
    single = materialise(first.groupBy("k").agg(F.collect_list("s").alias("single")), "single")
    discard(index)
    cut_texts = (
        texts.select("k", "id", "text", "n", "s").join(marks.select("k", "known"), "k", "left").join(single, "k", "left")
        .select("id", "text", "n", "s", *[F.coalesce(c, F.array().cast(NONE)).alias(c) for c in ("known", "single")])
        .mapInArrow(without_repeats(cut), KEPT)
    )
    return cut_texts.select("id", "n_units", "kept", F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length")).alias("spans"))
