"""The pipeline on tables without rows and with columns named like those that its stages add."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def test_no_documents(spark, tmp_path, docs_schema):
    save(spark, tmp_path, "documents", [], docs_schema)
    save(spark, tmp_path, "labels", [], LABELS)
    save(spark, tmp_path, "benchmark", [], ITEMS)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clashing_columns_stay(spark, tmp_path, docs_schema):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    docs = [(k, " ".join(word() for _ in range(80)), "en", "s", 80) for k in range(60)]
    docs += [(100, None, None, None, None), (101, "", "en", "s", 0), docs[5], docs[5], (102, docs[6][1], "en", "s", 80)]
    save(spark, tmp_path, "labels", [(k, 1, 0) for k in range(60)], LABELS)
    save(spark, tmp_path, "benchmark", [(0, " ".join(word() for _ in range(30)))], ITEMS)
    added = ["kept", "score", "probability", "predicted", "spans", "n_words", "component_id", "class_id"]
    table = spark.createDataFrame(docs, docs_schema)
    for k, name in enumerate(added):
        table = table.withColumn(name, F.lit(f"own {k}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.columns == table.columns, name
        table = spark.createDataFrame(out.collect(), table.schema)
        assert all(r[c] == f"own {k}" for r in table.collect() for k, c in enumerate(added)), name
    left = sorted(r["doc_id"] for r in table.collect())
    assert left.count(5) == 1 and len({5, 6, 102} & set(left)) == 2 and 100 not in left and 101 not in left  # rows without words fail the base rules
    pieces = corpus_pipeline.packed_sequences(spark, table, str(tmp_path))
    assert sorted(r["doc_id"] for r in pieces.collect()) == left
