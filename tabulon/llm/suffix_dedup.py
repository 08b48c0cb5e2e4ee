"""Byte-level dedup by prefix-free parsing, to the depth of the window.

*Parse.*  Rolling-hash triggers cut every text into phrases (see ``phrases``):
where a trigger stands depends on the bytes there alone, so repetitive text is
cut alike wherever it stands.  *Dictionary.*  The distinct phrases, each with
its count.  *Corpus order.*  In a suffix array of the corpus, suffixes that
share ``window`` bytes are neighbours, and a byte is repeated if a suffix near
it has such a neighbour.  That order is made in two steps, as in prefix-free
parsing, and only as deep as the window:

1. Dictionary entries that agree from the trigger on (their heads) stand
   together.  An entry that occurs twice has only repeated suffixes; one that
   occurs once and has no neighbour with its head has none.
2. What is left, entries of one occurrence with a neighbour, lies at the edges
   of repeated passages.  Only there are the suffixes that start inside the
   phrase compared one by one.

Neighbours are brought together by the hash of what they share and not by a
sort: no result depends on which of two different suffixes comes first, and a
sort of 400-byte keys would move the corpus several times.  So no suffix array
is stored, and nothing tells how suffixes that share fewer bytes are ordered.

Texts are read once to parse; later steps move phrases, and texts again only
into the task that holds them.  A hot phrase is counted before it moves, and a
repeated phrase sends nothing back: only what occurs once does.

Defined results: a null text is empty; a text shorter than the window is kept;
every place of a repeat goes, the first one too; repeated rows repeat each
other; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .phrases import KEPT, PARSED, Cut, parsed, windows, without_repeats
from .storage import bucketed, discard, materialise, n_parts

WINDOW = 400
#: Bytes of a trigger.
GRAM = 32
#: Grams among which the trigger is the least.
REACH = 128
NONE = "array<int>"


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, reach: int = REACH) -> DataFrame:
    """id, n_units (bytes), kept (remaining bytes), spans (start, length in bytes)."""
    cut = Cut.of("byte", window, gram, reach)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.xxhash64("id", "text").alias("k"), "id", "text").repartition(n_parts(docs.sparkSession), "k")
    texts = bucketed(rows.mapInArrow(parsed(cut), f"k long, id long, text string, {PARSED}"), "k", "parse")

    once = F.count(F.lit(1)) == 1
    place = [F.first("k").alias("k"), F.first("s").alias("s")]
    dictionary = texts.select("k", F.inline(F.arrays_zip("s", "h", "u"))).groupBy("h", "u").agg(once.alias("once"), *place)
    dictionary = materialise(dictionary.drop("u"), "dictionary")
    near = dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", F.lit(True).alias("near"))
    entries = dictionary.join(near, "h", "left").select("k", "s", "once", F.coalesce("near", F.lit(False)).alias("near")).filter("once or near")

    def starts(value: str):
        return F.collect_list(F.expr(value))

    # entries that occur more than once take part in the comparison, but are known to be repeated
    marks = entries.groupBy("k").agg(starts("if(near, null, s)").alias("known"), starts("if(near, if(once, s, -1 - s), null)").alias("open"))
    marks = materialise(marks, "marks")
    edges = texts.select("k", "text", "n", "s").join(marks.filter("size(open) > 0").select("k", "open"), "k")
    suffixes = edges.mapInArrow(windows(cut, ("k",)), "w1 long, w2 long, k long, at int")
    single = suffixes.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k"), F.first("at").alias("at")).filter("n = 1 and at >= 0")
    single = materialise(single.groupBy("k").agg(F.collect_list("at").alias("single")), "single")
    discard(dictionary)
    cut_texts = (
        texts.select("k", "id", "text", "n", "s").join(marks.select("k", "known"), "k", "left").join(single, "k", "left")
        .select("id", "text", "n", "s", *[F.coalesce(c, F.array().cast(NONE)).alias(c) for c in ("known", "single")])
        .mapInArrow(without_repeats(cut), KEPT)
    )
    return cut_texts.select("id", "n_units", "kept", F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length")).alias("spans"))
