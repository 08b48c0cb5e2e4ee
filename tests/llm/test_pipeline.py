import re

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    rng = __import__("random").Random(3)
    words = {"en": ["the", "of", "and", "this", "ring"], "fr": ["leur", "avec", "été", "pour", "dans"]}
    make = lambda k, n: " ".join("".join(rng.choice(words[k]) for _ in range(2)) for _ in range(n))
    rows = [(i, make(k, 60), k, f"s{i % 3}", 0) for i, k in enumerate(["en", "fr"] * 40)]
    leak = make("en", 30)
    near = rows[0][1].split()
    near[30] = "other"
    rows += [(100, rows[0][1], "en", "s1", 0), (101, " ".join(near), "en", "s2", 0), (102, f"{make('en', 20)} {leak} {make('en', 9)}", "en", "s0", 0), (103, "123 456", "en", "s0", 0), (104, None, "fr", "s0", 0), (105, f"{make('fr', 30)} joe@mail.org {make('fr', 30)}", "fr", "s1", 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, shrinking = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        if (name, stage) != corpus_pipeline.STAGES[-1]:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{len(shrinking)}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{len(shrinking)}"))
        shrinking.append({r.doc_id for r in kept.collect()})
    everything = {r[0] for r in rows}
    assert shrinking[0] == everything - {103, 104}
    assert shrinking[1] == shrinking[0] - {100, 101}
    assert shrinking[2] == shrinking[1] - {102}
    assert shrinking[3] == shrinking[2]
    assert shrinking[4] <= shrinking[3]
    final = {r.doc_id: r for r in kept.collect()}
    assert all(r.taken > 0 for r in final.values())
    redacted = spark.read.parquet(str(tmp_path / "stage3")).filter("doc_id = 105").first().text
    assert "[EMAIL]" in redacted and not re.search("@", redacted)
    whole = {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {(i, r.taken) for i, r in final.items()}


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, k string, carried string, spans string, size int, src string, base string, key int, lead int, root string, `end` int, score string, missing int"


def clashing_rows(rng):
    word = lambda: "".join(rng.choice(["th", "an", "er", "on", "re"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    rest = (1, "k", None, "s", 2, "src", "b", 3, 4, "r", 5, "x", 0)
    shared = text(70)
    rows = [(i, text(40 + i), "en", ["a", None, "b"][i % 3], 0, *rest) for i in range(12)]
    rows += [(50, shared, "en", "a", 0, *rest), (50, shared, "en", "a", 0, *rest), (51, shared, None, "b", 0, *rest), (None, shared, "en", None, 0, *rest)]
    rows += [(60, None, None, None, None, *([None] * 13)), (61, "", "en", "a", 0, *rest), (62, text(60_000) + " me@mail.org", "en", "a", 0, *rest), (63, "x" * 200_000 + " é word", "en", "b", 0, *rest)]
    return rows


def test_stages_on_clashing_columns_long_null_and_repeated_rows(spark, tmp_path):
    rng = __import__("random").Random(4)
    rows = clashing_rows(rng)
    spark.createDataFrame(rows, CLASHING).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, rows[3][1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if (name, stage) != corpus_pipeline.STAGES[-1]:
            assert out.columns == docs.columns and out.schema == docs.schema
        kept[name] = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
    every = [r[0] for r in rows]
    assert kept["language ID"] == sorted((i for i in every if i not in (60, 61)), key=str)
    # of the equal texts the row with the least id stays, repeated rows once; null and empty texts are no copies
    assert kept["MinHash near-dedup"] == sorted([i for i in every if i not in (50, 51, None)] + [50], key=str)
    assert kept["benchmark decontamination"] == sorted((i for i in every if i != 3), key=str)
    assert kept["PII"] == sorted(every, key=str)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], CLASHING).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
