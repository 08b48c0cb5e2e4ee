"""The operators over the driver's tables: one query each, and the pipeline's table reader."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii
from .ann import nearest
from .decontaminate import decontaminate
from .html_text import main_text
from .language import identify
from .minhash import near_classes
from .mixing import mix
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .toxicity import THRESHOLD, score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(ident: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(parts))


def removed(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["length"])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(F.concat("base", "extra")).alias("spans"),
        F.size("extra").cast("long").alias("n_extra"),
        (F.size("base") + F.size("extra")).cast("long").alias("n_spans"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels, usable=fold(F.col("rid"), 3) != 1)
    return scored.select(
        F.col("id").alias("doc_id"), (fold(F.col("id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select(F.col("id").alias("doc_id"), F.col("n_units").alias("n_words"), removed(F.col("spans")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(table(spark, sf_dir, "documents"))
    return kept.select(
        F.col("id").alias("doc_id"), F.col("n_units").alias("n_bytes"), removed(F.col("spans")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_classes(table(spark, sf_dir, "documents"))
    return classes.select(F.col("id").alias("doc_id"), "class_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, trainable=fold(F.col("doc_id"), 4) != 2)
    return found.select(F.col("id").alias("doc_id"), (fold(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = removed(F.col("spans"))
    listed = F.array_join("items", ",")
    return hits.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_mixing, op2_pii, op3_toxicity, op4_ann, op5_substring_dedup, op6_suffix_dedup, op7_minhash, op8_language, op9_html, op10_decontaminate)
    }


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, 'null')) AS turn
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rank % 3) + 1]::BIGINT AS weight, source_size * 2 AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
f AS (SELECT level FROM l WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM f) * weight) AS target FROM w),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM d),
b AS (SELECT floor(sum(source_size) * 1.5::DOUBLE)::BIGINT AS budget FROM s),
k AS (
  SELECT c.source, t.target, size, upto - size + source_size * copy AS start, unnest(range(0, (size - 1) // 256 + 1)) AS nth
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS v(copy) WHERE size > 0 AND target > 0),
p AS (SELECT source, target, least(size - nth * 256, 256)::BIGINT AS words, (start + nth * 256 + least(size - nth * 256, 256))::BIGINT AS until FROM k),
q AS (SELECT source, words, sum(words) OVER (ORDER BY until / target, source NULLS LAST, until ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM p),
r AS (SELECT source, sum(greatest(0, least(words, budget - (total - words))))::BIGINT AS served FROM q, b GROUP BY source)
SELECT c.doc_id, c.size, t.source_size, coalesce(t.target, 0) AS target,
  (greatest(0, least(c.size, coalesce(r.served, 0) - (upto - c.size))) + greatest(0, least(c.size, coalesce(r.served, 0) - (upto - c.size + t.source_size))))::BIGINT AS taken
FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source LEFT JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 18)) AS s, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM p),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS nth FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r WHERE nth > 1),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
o AS (
  SELECT x.doc_id, count(g.i) AS n_removed, coalesce(string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(o.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
m AS (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM m)),
ls AS (SELECT DISTINCT m FROM v),
p AS (SELECT doc_id, m, s, array_to_string(w[s:s + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, ls WHERE len(w) >= m)),
h AS (SELECT p.doc_id, p.s, p.m, v.item_id FROM p JOIN v ON p.m = v.m AND p.win = v.win),
n AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS i FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op10_decontaminate": OP10_SQL}
