"""The registered queries on a small fixture, each against a plain computation over whole rows."""

import random
import re
import zlib

import numpy as np
import pytest
from test_joins_and_pipeline import components_by_hand, tiles_by_hand
from test_quality_and_toxicity import counts_by_hand
from tokenizers import Tokenizer

import corpus_pipeline
from vitalgrid.llm import decontaminate, packing, quality, queries, toxicity

BAD, FOUL = ["***", "###", "%%%"], ["grumble", "grumbling", "zonkhead"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents, labels and benchmark: nulls, empty and long texts, repeats, copies, odd characters."""
    rng = random.Random(17)
    syllables = ["an", "er", "ti", "on", "re", "st", "he", "in", "ou", "al", "ß", "é"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(4)] + [(4, None), (5, "")]
    docs, labels = [], []
    for k in range(200):
        words = [word() for _ in range(rng.randint(55, 110))]
        good, toxic = k % 3 != 0, k % 4 == 0
        if not good:
            words = [w + rng.choice(BAD) for w in words]
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(FOUL))
        if k in (70, 71):
            part = items[k - 70][1].split()
            words[20:20] = part[15:] + part[:15]
        docs.append((k, " ".join(words), "en", f"s{k % 5}", len(words)))
        labels.append((k, int(good), int(toxic)))
    copy = docs[1][1].split()
    copy[5] = "changed"
    odd = [None, "", " \n ", "short", "<|endoftext|> in a text", "世界 ́ ", " ".join(word() for _ in range(9000)), docs[2][1].upper(), " ".join(copy), docs[4][1], docs[4][1]]
    docs += [(1000 + k, t, None, "s0", 0) for k, t in enumerate(odd)] + [docs[7], docs[7], (8, "another text of the same id " * 12, "en", "s1", 5)]
    folder = tmp_path_factory.mktemp("tables")
    save = lambda rows, schema, name: spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    save(docs, "doc_id long, text string, lang string, source string, n_chars long", "documents")
    save(labels, "doc_id long, quality int, toxic int", "labels")
    save(items, "item_id long, text string", "benchmark")
    return str(folder), docs, labels, items


def ids_by_library(name, text, end):
    library = Tokenizer.from_file(queries.vocabulary(name))
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def pieces_by_library(docs):
    out = []
    for i, t in docs:
        ids = ids_by_library("word_bpe_49k.json", t, 1)
        out += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    return sorted(out)


def check_sequences(rows):
    spans: dict = {}
    for r in rows:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(spans) <= 1.05 * sum(r["length"] for r in rows) / packing.CAPACITY + 2


def test_op2(spark, tables):
    folder, docs, _, _ = tables
    rows = queries.op2_nnls_packing(spark, folder).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == pieces_by_library([d[:2] for d in docs])
    check_sequences(rows)


def test_op3(spark, tables):
    folder, docs, _, _ = tables
    rows = queries.op3_hilbert_sharding(spark, folder).collect()
    data = [(d[0], (d[1] or "").encode()) for d in docs]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows) == sorted((i, len(t) + 16, zlib.crc32(t), "rows", None) for i, t in data)
    slots: dict = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op4(spark, tables):
    folder, docs, _, _ = tables
    rows = sorted(queries.op4_repair_ids(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(d[0] for d in docs)
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    want = [(i, ids_by_library("byte_bpe_50k.json", t, 2)) for i, t, *_ in docs]
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted((i, len(ids), zlib.crc32(ids.tobytes())) for i, ids in want)


def contaminated(text, items):
    out = []
    doc = decontaminate.words_of(text)
    for k, t in items:
        item = decontaminate.words_of(t)
        if item and (set(zip(*(item[j:] for j in range(5)), strict=False)) & set(zip(*(doc[j:] for j in range(5)), strict=False))):
            covered = sum(n for *_, n in tiles_by_hand(item, doc, decontaminate.MIN_TILE))
            if covered >= decontaminate.MIN_COVERAGE * len(item):
                out.append((k, len(item), covered))
    return out


def test_op5(spark, tables):
    folder, docs, _, items = tables
    got = sorted((r["doc_id"], r["item_id"], r["item_words"], r["covered_words"]) for r in queries.op5_greedy_tiling(spark, folder).collect())
    assert got == sorted((d[0], *c) for d in docs for c in contaminated(d[1], items)) and [g[0] for g in got] == [70, 71]


def quality_by_hand(model, text):
    n, chars, symbols, lines, repeated = counts_by_hand(text)
    failed = n < 50 or 100 * repeated > 50 * n
    return n, chars, symbols, lines, repeated, failed, not failed and model.probability(text) >= quality.MIN_PROBABILITY


def fitted(spark, folder, fit, **options):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    return fit(docs.select("doc_id", "text"), labels, **options)


def test_op7(spark, tables):
    folder, docs, labels, _ = tables
    rows = queries.op7_quality_rules(spark, folder).collect()
    model = fitted(spark, folder, quality.fit_quality)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert sorted(tuple(r[c] for c in ["doc_id", *names]) for r in rows) == sorted((d[0], *quality_by_hand(model, d[1])) for d in docs)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert np.mean([kept[k] == bool(q) for k, q, _ in labels]) > 0.95


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_op10(spark, tables, tmp_path):
    folder, docs, labels, _ = tables
    rows = queries.op10_toxicity_crf(spark, folder).collect()
    from pyspark.sql import functions as F

    model = fitted(spark, folder, toxicity.fit_toxicity, where=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    run = model.scorer()
    want = [(d[0], held_out(d[0]), run([d[1]])[0][0]) for d in docs]
    got = sorted((r["doc_id"], r["held_out"], r["score"]) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)] and np.allclose([g[2] for g in got], [w[2] for w in sorted(want)])
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    by_id = {r["doc_id"]: r["predicted"] for r in rows}
    assert np.mean([by_id[k] == t for k, _, t in labels if held_out(k)]) > 0.95
    # labels of held-out rows are of no influence
    turned = tmp_path / "turned"
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{turned}/{name}.parquet")
    spark.createDataFrame([(k, q, 1 - t if held_out(k) else t) for k, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{turned}/labels.parquet")
    again = {(r["doc_id"], r["score"]) for r in queries.op10_toxicity_crf(spark, str(turned)).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in rows}


def test_pipeline_stage_by_stage(spark, tables):
    folder, docs, _, items = tables
    from pyspark.sql import functions as F

    model = fitted(spark, folder, quality.fit_quality)
    left = [d for d in docs if quality_by_hand(model, d[1])[-1]]
    kept = spark.createDataFrame(left, spark.read.parquet(f"{folder}/documents.parquet").schema)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    run = toxicity.fit_toxicity(kept.select("doc_id", "text"), labels, where=F.crc32(F.col("doc_id").cast("string")) % 3 != 1).scorer()
    left = [d for d in left if run([d[1]])[0][0] < toxicity.MIN_SCORE]
    # rows by place, as ids repeat; of a component the row of the smallest id and, among its rows, any text stays
    component = [c for *_, c in components_by_hand([d[1] for d in left], list(range(len(left))))]
    first: dict = {}
    for k, c in enumerate(component):
        first.setdefault(c, []).append(left[k])
    chosen = [min(group, key=lambda d: d[0]) for group in first.values()]
    clean = [d for d in chosen if not contaminated(d[1], items)]
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == pieces_by_library([d[:2] for d in clean])
    check_sequences(rows)
    assert len(docs) > len(left) > len(chosen) > len(clean) > 50 and re.search("s0", str(clean))
