import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    seen = Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x\n\nx\n x\nx", "é ü\x1c# <>", "a\x85b a\xa0b", "\x0b\x0c a"] + ["".join(rng.choice("ab #\n\t") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    assert [quality.text_counts(t) for t in texts] == [counts_by_hand(t) for t in texts]


def test_word_hashes_depend_on_the_word_alone():
    data = b"alpha beta\talpha\n\nbeta alpha"
    _, h = quality.word_hashes(np.frombuffer(data, np.uint8))
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]


def features_by_hand(text):
    """Counts of n-grams, by what they are made of."""
    words = WORD.findall(text)
    return [Counter(words), Counter(itertools.pairwise(words)), Counter(zip(text, text[1:], text[2:], strict=False)), Counter(zip(text, text[1:], text[2:], text[3:], strict=False))]


@pytest.mark.parametrize("size", [4, 7, 50, 1 << 20])
def test_ngrams_across_blocks(size, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", size)
    rng = random.Random(size)
    for text in ["", " ", "a", "\n\na b", "longerthanablock " * 3, "世界 naïve 𝒳y\t\t z"] + ["".join(rng.choice("abé \n") for _ in range(rng.randint(0, 90))) for _ in range(60)]:
        parts = list(quality.blocks(text))
        assert "".join(text[a:b] for _, a, b in parts) == text
        got = [np.concatenate([quality.block_features(text, *p)[k] for p in parts]) for k in range(4)]
        for ids, want in zip(got, features_by_hand(text), strict=True):
            assert len(ids) == sum(want.values()) and len(want) - 3 <= len(set(ids.tolist())) <= len(want)  # few share a hash
        for ids, once in zip(got, quality.block_features(text, 0, 0, len(text)), strict=True):
            assert sorted(ids.tolist()) == sorted(once.tolist())


def test_sample_is_bounded_by_rows(spark, docs_schema):
    df = spark.createDataFrame([(3, f"text {k}", "x", "y", 0) for k in range(500)] + [(k, "t", "x", "y", 0) for k in range(40)], docs_schema)
    lab = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    got = quality.labelled_sample(df, lab, "toxic", 15).collect()
    assert len(got) <= 30 and len({r["doc_id"] for r in got}) == len(got)


def test_long_rows_are_cut_to_windows():
    words = [f"w{k}" for k in range(toxicity.ROW_WINDOWS * toxicity.WINDOW + 1)]
    assert toxicity.excerpt(None) == "" and toxicity.excerpt("a  b\n") == "a  b\n"
    got = toxicity.excerpt(" ".join(words * 4)).split()
    assert len(got) == toxicity.ROW_WINDOWS * toxicity.WINDOW and got[0] == "w0" and got[-1] == words[-1]


def corpus(n=240):
    rng = random.Random(7)
    syllables = ["an", "er", "ti", "on", "re", "st", "he", "in", "ou", "al"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for k in range(n):
        words = [word() for _ in range(rng.randint(60, 120))]
        good, toxic = k % 3 != 0, k % 4 == 0
        if not good:
            words = [w + rng.choice(["***", "###", "%%%"]) for w in words]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grumble", "grumbling", "zonkhead"]))
        docs.append((k, " ".join(words), "en", "s", 1))
        labels.append((k, int(good), int(toxic)))
    return docs, labels


def test_quality_model(spark, docs_schema):
    docs, labels = corpus()
    extra = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "w " * 100_000, "en", "s", 0), (None, docs[1][1], "en", "s", 0), docs[1], docs[1]]
    df = spark.createDataFrame(docs + extra, docs_schema).withColumn("KEPT", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    out = quality.apply_quality(df, quality.fit_quality(df, lab))
    rows = out.collect()
    assert len(rows) == len(docs) + len(extra) and "KEPT" not in out.columns
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert np.mean([by_id[k]["kept"] == bool(q) for k, q, _ in labels]) > 0.97
    assert all(by_id[k]["base_failed"] and not by_id[k]["kept"] for k in (900, 901, 902))
    assert len({r["probability"] for r in rows if r["doc_id"] in (1, None)}) == 1
    assert quality.apply_quality(df.limit(0), quality.fit_quality(df.limit(0), lab)).count() == 0
    assert quality.fit_quality(df, lab.limit(0)).probability("x") == pytest.approx(1.0, abs=1e-4)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    transition, start = rng.normal(size=(2, 2)), 0.3
    chains = [rng.normal(size=n).tolist() for n in (1, 2, 5, 7, 0, 3)]
    for got, u in zip(toxicity.chain_marginals(chains, start, transition), chains, strict=True):
        weight, total = np.zeros(len(u)), 0.0
        for tags in itertools.product((0, 1), repeat=len(u)):
            if not tags:
                continue
            z = start * tags[0] + sum(a for a, t in zip(u, tags, strict=True) if t) + sum(transition[a, b] for a, b in itertools.pairwise(tags))
            total += np.exp(z)
            weight += np.exp(z) * np.array(tags)
        assert np.allclose(got, weight / total if total else weight)
        if u:
            assert np.allclose(toxicity._alone(u, start, transition), got)


def test_toxicity_model(spark, docs_schema):
    docs, labels = corpus(400)
    held = [k for k in range(400) if k % 5 == 0]
    extra = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, ("fine words here " * 5000) + "Grumble!", "en", "s", 0), docs[3], docs[3]]
    df = spark.createDataFrame(docs + extra, docs_schema).withColumn("Score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(df, lab, where=F.col("doc_id") % 5 != 0)
    rows = toxicity.apply_toxicity(df, model).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(docs) + len(extra) and all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([by_id[k]["predicted"] == int(k % 4 == 0) for k in held]) > 0.97
    for r in rows:
        text = dict((d[0], d[1]) for d in docs + extra)[r["doc_id"]]
        for s in r["spans"]:
            assert any(w in text[s["start"] : s["end"]].lower() for w in ("grumbl", "zonk"))
    assert by_id[902]["spans"] and by_id[900]["score"] == by_id[901]["score"] < 0.7
    assert toxicity.apply_toxicity(df.limit(0), model).count() == 0
    assert toxicity.fit_toxicity(df, lab.limit(0)).score(np.zeros(0)) == 0.0


def test_features_of_ascii_words_are_those_of_any_word():
    rng = random.Random(6)
    words = ["...", "A", "Ab", "ABC", "don't", "a1", "12", "(Hello),", "x" * 20, "#*!", "é", "Straße"] + ["".join(rng.choice("abCD12.,'-éß") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    for x in words:
        assert toxicity.features(x.encode()) == toxicity._features(x.encode()), x


def test_fit_holds_the_stems_of_one_document_at_a_time(spark, monkeypatch):
    held, own = [], toxicity._toxic_stems

    def seen(docs, y):
        held.append(isinstance(docs, list))
        return own(docs, y)

    monkeypatch.setattr(toxicity, "_toxic_stems", seen)
    rows = [(k, f"plain words of text number {k} " + ("vile insult here" if k % 2 else "kind remark here")) for k in range(40)]
    toxicity.fit_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int"))
    assert held == [False]
