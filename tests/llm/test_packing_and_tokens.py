import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vitalgrid.llm import packing, sharding, token_output, tokens
from vitalgrid.llm.queries import packed_documents, vocabulary


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_encoding_equals_the_library(name, monkeypatch):
    enc, rng = tokens.Encoder(vocabulary(name)), random.Random(5)
    plain = [*"abZé' ,\n\t\r 1!<|«–’Жя", "'s", "'LL", "  ", " \n", "the", " The"]
    odd = [*"\x85\x1c\u0301İſ世²", "<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(plain + odd * (k % 5 == 0)) for _ in range(rng.randint(0, 40))) for k in range(4000)] + [None, "", " ", "<|endoftext|> x"]
    library = Tokenizer.from_file(vocabulary(name))
    want = [b"" if not t else np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want
    monkeypatch.setattr(tokens, "STRETCH", 300)
    monkeypatch.setattr(tokens, "CACHE_UNITS", 50)
    assert tokens.Encoder(vocabulary(name)).encode(texts) == want
    long = " ".join(t for t in texts[1:500] if "\u0301" not in (t or "") and t)
    parts = list(tokens.stretches(long, 300))
    assert len(parts) > 5 and "".join(parts) == long
    assert enc.encode([long])[0] == np.array(library.encode(long, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 300))
    lengths = np.concatenate([rng.integers(1, capacity + 1, 2000), np.full(700, rng.integers(1, capacity + 1))])
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plan = packing.plan_packing(histogram, capacity, ((4, 3), (16, 3)))
    used: dict[int, list] = {}
    placed: dict[int, int] = {}
    for length, rank, first, copies, offset in sorted(plan.entries):
        assert rank == placed.get(length, 0)
        following = [e[1] for e in plan.entries if e[0] == length and e[1] > rank]
        n = (min(following) if following else histogram[length]) - rank
        placed[length] = rank + n
        for k in range(n):
            used.setdefault(first + k // copies, []).append((offset + k % copies * length, length))
    assert placed == histogram
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
    big = sum(c for n, c in histogram.items() if 2 * n > capacity)
    assert plan.n_sequences <= 1.05 * max(bound, big) + 3


def test_packing_a_table(spark, docs_schema):
    rng = random.Random(2)
    texts = [None, "", "word " * 5000, *(" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 900))) for _ in range(60)), *["same text"] * 80]
    df = spark.createDataFrame([(k % 130, t, "x", "y", 0) for k, t in enumerate(texts)], docs_schema).withColumn("offset", F.lit("clash"))
    got = packing.pack(packing.token_pieces(df, vocabulary("word_bpe_49k.json"), with_ids=True))
    rows = got.collect()
    assert sum(1 for r in rows if r["piece"] == 0) == len(texts)
    by_sequence: dict = {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["start"] == 4096 * r["piece"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_sequence.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 4096
    whole = packing.sequences(got).collect()
    assert sum(len(r["ids"]) for r in whole) == 4 * sum(r["length"] for r in rows)
    assert packing.pack(packing.token_pieces(df.limit(0), vocabulary("word_bpe_49k.json"))).count() == 0


def test_written_sequences_hold_every_id(spark, docs_schema, monkeypatch):
    texts = ["b c", None, "", "some words " * 5000, "b c", "é ü"]
    ids = [5, 3, None, 1, 5, 9]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in zip(ids, texts, strict=True)], docs_schema)
    written = []
    write = packing.write_sequences
    monkeypatch.setattr(packing, "write_sequences", lambda packed: written.append(write(packed)) or written[-1])
    got = packed_documents(df).collect()
    enc, tail = tokens.Encoder(vocabulary("word_bpe_49k.json")), np.array([packing.END_ID], np.uint32).tobytes()
    want = []
    for i, t in zip(ids, texts, strict=True):
        all_ids = enc.encode([t])[0] + tail
        for k, at in enumerate(range(0, len(all_ids), 4 * 4096)):
            part = all_ids[at : at + 4 * 4096]
            want.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    files = {r["sequence_id"]: np.frombuffer(r["ids"], "<u2").astype("<u4") for r in written[0].collect()}
    assert all(zlib.crc32(files[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) == r["ids_crc32"] for r in got)
    assert sum(map(len, files.values())) == sum(w[3] for w in want)
    assert packed_documents(df.limit(0)).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    docs = [np.concatenate([rng.integers(0, 6, int(rng.integers(0, 60))), [2]]).astype(np.uint32) for _ in range(200)] + [np.array([7] * 5000 + [2], np.uint32), np.array([2], np.uint32)]
    block = token_output.Block.build([None, *range(1, len(docs))], [d.tobytes() for d in docs])
    assert len(block.symbols) < sum(map(len, docs)) / 2
    back = token_output.Block.unpack(block.pack())
    got = list(back.documents())
    assert got[0][0] is None and [d for d, _ in got[1:]] == list(range(1, len(docs)))
    assert all(np.array_equal(a, b) for a, (_, b) in zip(docs, got, strict=True))
    for k in (0, 5, 200):
        for start, n in ((0, 1), (len(docs[k]) // 2, max(1, len(docs[k]) // 3)), (0, len(docs[k]))):
            assert np.array_equal(back.span(k, start, n), docs[k][start : start + n])


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(4)
    for k in range(60):
        ids = rng.integers(0, rng.integers(1, 9), int(rng.integers(1, 900))).astype(np.uint32)
        ends = rng.random(len(ids)) < 0.05
        ends[-1] = True
        least = 2 + k % 7
        symbols, last, left, right, bases = token_output.compress(ids, ends, least)
        assert np.array_equal(token_output.expand(symbols, left, right, bases), ids)
        inside = ~last[:-1]
        pairs = list(zip(symbols[:-1][inside].tolist(), symbols[1:][inside].tolist(), strict=True))
        # a symbol twice is counted by places that may overlap
        assert all(sum(p == q for q in pairs) < (2 * least if p[0] == p[1] else least) for p in set(pairs))


def test_token_files(spark, docs_schema):
    texts = ["b c", None, "", "x" * 300_000, "b c", "é ü"]
    ids = [5, 3, None, 1, 5, 9]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in zip(ids, texts, strict=True)], docs_schema)
    enc = tokens.Encoder(vocabulary("byte_bpe_50k.json"))
    got = sorted(token_output.read_ids(token_output.write_ids(df, vocabulary("byte_bpe_50k.json"), block_ids=1000)).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 1, 3, 5, 5, 9]
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = sorted(zlib.crc32(enc.encode([t])[0] + np.array([2], np.uint32).tobytes()) for t in texts)
    assert sorted(r["ids_crc32"] for r in got) == want
    manifest = token_output.write_ids(df, vocabulary("byte_bpe_50k.json"), block_ids=1000)
    for m in manifest.collect():
        k = 0
        for block in token_output.read_blocks(m["file"]):
            for _, ids in block.documents():
                at, n = len(ids) // 3, max(1, len(ids) // 2)
                assert np.array_equal(token_output.read_span(m["file"], k, at, n), ids[at : at + n])
                k += 1
        assert k == m["documents"]
    assert token_output.read_ids(token_output.write_ids(df.limit(0), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_hilbert_curve_visits_every_cell_by_unit_steps():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        index = sharding.hilbert_index(cells, bits)
        order = cells[np.argsort(index)]
        assert sorted(index.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(spark, law):
    df = spark.createDataFrame([(k if k % 50 else None, f"s{k % 7}" if k % 11 else None, k % 13, 10 + k % 90) for k in range(1003)], "doc_id long, source string, n int, size long").withColumns({"shard": F.lit(9), "Slot": F.lit("clash"), "curve": F.lit(None).cast("string")})
    out = sharding.hilbert_shards(df, ["source", "n"], 7, law, "size", ("doc_id",))
    assert out.columns == ["doc_id", "source", "n", "size", "curve", "shard", "slot"]
    assert sharding.hilbert_shards(df, ["shard", "n"], 7, law, "size", ("curve",)).count() == 1003
    rows = sharding.hilbert_shards(df, ["source", "n"], 7, law, "size", ("doc_id",)).collect()
    assert len(rows) == 1003
    shards: dict = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert sorted(shards) == list(range(7))
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    sizes = [len(s) if law == "rows" else sum(r["size"] for r in s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= (1 if law == "rows" else 200)
    ends = [(min(r["curve"] for r in shards[k]), max(r["curve"] for r in shards[k])) for k in range(7)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert sharding.hilbert_shards(df.limit(0), ["source", "n"], 7, law, "size").count() == 0


def test_strings_are_ranked_by_whole_values(spark, tmp_path):
    values = [f"https://www.example.org/a/long/shared/prefix/{k:04d}" for k in range(640)] + ["!outlier", None] + ["hot"] * 300
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "doc_id long, url string")
    cuts = sharding._string_cuts(df, "url", 3)
    ordered = sorted(v for v in values if v)
    assert cuts == sorted({ordered[-(-len(ordered) * k // 8) - 1] for k in range(1, 8)})
    sharded = sharding.hilbert_shards(df, ["url"], 5, tie_cols=("doc_id",))
    bounds = {r["shard"]: r for r in sharding.shard_bounds(sharded, ["url"]).collect()}
    assert sum(r["n_rows"] for r in bounds.values()) == len(values) and len({r["min_url"] for r in bounds.values()}) == 5
    sharding.write_shards(sharded, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in sharded.collect())


def test_grammar_holds_short_numbers_and_gaps_are_filled():
    # arrays over a block's places take four bytes a place where they fit: 71 bytes an id at the peak, 92 with eight
    import tracemalloc

    ids = np.tile(np.arange(1 << 12, dtype=np.uint32), 1 << 7)
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    tracemalloc.start()
    symbols, _, left, right, bases = token_output.compress(ids, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(token_output.expand(symbols, left, right, bases), ids)
    assert peak < 80 * len(ids)
    # units met again, met for the first time and longer than those that are kept, in one call and the next
    enc = tokens.Encoder(vocabulary("byte_bpe_50k.json"))
    texts = ["one two one " + "x" * 500 + " zwölf", "two three two", "", "zwölf " + "xyz" * 90]
    for _ in range(2):
        assert enc.encode(texts) == [enc.whole(t) for t in texts]


def test_new_units_share_calls_of_the_library():
    enc = tokens.Encoder(vocabulary("byte_bpe_50k.json"))
    texts = [" ".join(f"{a}{b}{c}zq" for c in "abcdefgh") for a in "klmnoäß" for b in "pqrstuvwx"]
    calls, model = [], enc.model

    class Counted:
        tokenize = staticmethod(lambda unit: calls.append(unit) or model.tokenize(unit))

    enc.model = Counted
    for _ in range(2):  # of more than 500 units, the second time all are held
        assert enc.encode(texts) == [enc.whole(t) for t in texts]
    assert len(calls) <= 20


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_in_a_small_table(name, monkeypatch):
    # many units of one hash, tables begun anew between slices, units of 15 to 18 characters, contractions at all places
    monkeypatch.setattr(tokens, "_SLOT_BITS", 9)
    monkeypatch.setattr(tokens, "CACHE_UNITS", 200)
    monkeypatch.setattr(tokens, "SLICE_UNITS", 120)
    enc, rng = tokens.Encoder(vocabulary(name)), random.Random(8)
    parts = ["'", "'", "s", "r", "e", "v", "l", "L", " ", " ", "\n", "1", "é", "Ж", "“", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    texts += [f"{'é' * n}{'a' * m} {'-' * (n + m)}\n{'7' * n}{' ' * n}x{' ' * n}" for n in range(7, 10) for m in range(7, 10)]
    assert enc.encode(texts) == [enc.whole(t) for t in texts]
    long = "".join(t for t in texts if " " not in t)  # no place to cut at, so all in one stretch
    monkeypatch.setattr(tokens, "STRETCH", 1000)
    assert len(long) > 9000 and enc.encode([long, None, long]) == [enc.whole(long), b"", enc.whole(long)]
