"""The whole pipeline on odd and on empty tables."""

import random

import corpus_pipeline

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_llm_key` string, `row` int"


def tables(spark, root, docs, labels, items):
    spark.createDataFrame(docs, DOC).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def test_odd_tables(spark, tmp_path):
    rng = random.Random(1)
    item = prose(rng, 40)
    texts = {1: prose(rng, 80), 2: None, 3: "", 4: " \n ", 5: prose(rng, 4000), 6: f"{prose(rng, 30)} {item} {prose(rng, 30)}", 7: "one two", 9: prose(rng, 60)}
    texts[8] = texts[1] + " tail"
    docs = [(i, t, None, "s" if i % 2 else None, None, "k", 1) for i, t in sorted(texts.items())] + [(None, prose(rng, 50), "en", "s", 3, None, None), (9, texts[9], None, "s", None, "k", 1)]
    labels = [(i, 1, int(i == 11)) for i in range(1, 12)] + [(None, None, None)]
    out = corpus_pipeline.run(spark, tables(spark, tmp_path / "odd", docs, labels, [(1, item), (2, None), (3, "")]))
    assert out.columns[:7] == ["doc_id", "text", "lang", "source", "n_chars", "_llm_key", "row"]
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {1, 2, 3, 4, 5, 7, 9, None}


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [], [], [])).count() == 0
