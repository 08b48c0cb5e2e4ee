"""Corpus pipeline: language, near-duplicates, benchmark passages, personal data, mix.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; ``run`` writes each stage's result and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import pii
from tabulon.llm.decontaminate import decontaminate
from tabulon.llm.language import UNKNOWN, identify
from tabulon.llm.minhash import near_classes
from tabulon.llm.mixing import schedule
from tabulon.llm.storage import LIVE, discard, settled

#: The least posterior of a language for a document to stay.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or without a clear language go; the predicted language replaces the label."""
    found = identify(docs, carry=tuple(docs.columns))
    good = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return good.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col("carried")[c].alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one with the least id."""
    classes = near_classes(docs)
    # the key of the class's first text, and its least id, name the document that stays
    keep = classes.filter(F.col("id").eqNullSafe(F.col("class_id")) & ((F.col("k") == F.col("class_k")) | ~F.col("worded")))
    names = ("__nil", "__id", "__k")

    def keys(ident, k) -> dict:
        return dict(zip(names, (ident.isNull(), F.coalesce(ident, F.lit(0).cast("long")), k), strict=True))

    keep = keep.select(*[c.alias(n) for n, c in keys(F.col("id"), F.col("k")).items()])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumns(keys(F.col("doc_id").cast("long"), F.xxhash64(text)))
    # repeated rows share all keys, so one exchange serves the join and their removal
    return keyed.join(keep, list(names), "left_semi").dropDuplicates(list(names)).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    hits = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(docs.columns))
    return hits.filter(F.size("spans") == 0).select(*[F.col("carried")[c].alias(c) for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words from, with how many and when their turn ends."""
    planned = schedule(docs, carry=tuple(docs.columns))
    return planned.filter("taken > 0").select(*[F.col("carried")[c].alias(c) for c in docs.columns], "size", "source_size", "target", "taken", "finish")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII", personal_data),
    ("mixing to target weights", mixture),
]

#: Trained and signature-based stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        earlier = set(LIVE)
        docs = settled(stage(spark, docs, sf_dir), earlier, name.split()[0])
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
