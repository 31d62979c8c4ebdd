import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitalgrid.llm import arrow_map, decontaminate, jaccard_join

SMALL = "/root/testdata/sf0.001"


def tiles_by_hand(item, doc, least):
    """Greedy string tiling without hashing."""
    free_i, free_d, tiles = [True] * len(item), [True] * len(doc), []
    while True:
        best, found = least - 1, []
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and free_i[i + n] and free_d[d + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, d)]
                elif n == best and n >= least:
                    found.append((i, d))
        if best < least or not found:
            return sorted(tiles)
        for i, d in found:
            if all(free_i[i : i + best]) and all(free_d[d : d + best]):
                free_i[i : i + best] = [False] * best
                free_d[d : d + best] = [False] * best
                tiles.append((i, d, best))


@pytest.mark.parametrize("seed", range(8))
def test_tiling(seed):
    rng = random.Random(seed)
    item = [rng.randint(0, 3) for _ in range(rng.randint(3, 25))]
    doc = [rng.randint(0, 3) for _ in range(rng.randint(0, 20))] + item[len(item) // 2 :] + [9] + item[: len(item) // 2]
    for least in (2, 4):
        assert decontaminate.greedy_tiles(np.array(item), np.array(doc), least) == tiles_by_hand(item, doc, least)


def test_contaminated_pairs(spark, docs_schema):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    item = " ".join(rng.sample(words, 40))
    parts = item.split()
    turned = " ".join(parts[25:] + ["gap"] + parts[:25])
    clean = " ".join(rng.sample(words, 300))
    rows = [(1, f"{clean}\n{item.upper()}.", "x", "y", 0), (2, turned, "x", "y", 0), (3, clean, "x", "y", 0), (4, None, "x", "y", 0), (5, "", "x", "y", 0), (6, " ".join(parts[:15]), "x", "y", 0), (7, "only three words", "x", "y", 0), (2, turned, "x", "y", 0)]
    docs = spark.createDataFrame(rows, docs_schema).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "three words"), (14, "never seen " * 30)], "item_id long, text string")
    for block in (5, 10**6):
        got = decontaminate.contaminated_pairs(docs, bench, block_words=block).collect()
        assert sorted((r["doc_id"], r["item_id"], r["covered_words"]) for r in got) == [(1, 10, 40), (2, 10, 40), (2, 10, 40), (7, 13, 2)]
        assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench, block_words=block).collect()) == [3, 4, 5, 6]
    assert decontaminate.contaminated_pairs(docs.limit(0), bench).count() == 0 and decontaminate.contaminated_pairs(docs, bench.limit(0)).count() == 0


def near_copies():
    """Texts of many lengths with copies at, above and below the similarity, a chain, and a shared passage."""
    rng = random.Random(11)
    words = [f"v{k}" for k in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    texts = [None, "", "one", "One", "a b c d", "A b c d", "a b c d e"]
    for n in (6, 8, 12, 30, 66, 70, 84, 90, 130, 160, 260, 340, 520):
        base = [rng.choice(words) for _ in range(n)]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[rng.choice(words)], [], [copy[k], rng.choice(words)]])
            texts.append(" ".join(copy + [rng.choice(words) for _ in range(rng.randint(0, n // 6))]))
    chain = [rng.choice(words) for _ in range(400)]
    texts += [" ".join(chain[k : k + 200]) for k in range(0, 200, 13)]
    texts += [" ".join([rng.choice(words) for _ in range(20)] + passage) for _ in range(40)]
    return texts + ["same text of seven words for all"] * 50


def components_by_hand(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members: dict = {}
    for k in range(len(texts)):
        members.setdefault(find(k), []).append(ids[k])
    return [(ids[k], len(sets[k]), min(members[find(k)])) for k in range(len(texts))]


def test_components(spark, docs_schema):
    texts = near_copies()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in zip(ids, texts, strict=True)], docs_schema).repartition(5).withColumn("component_id", F.lit("clash"))
    want = sorted(components_by_hand(texts, ids))
    assert sorted(tuple(r)[:3] for r in jaccard_join.components(df).collect()) == want
    kept = sorted(r["doc_id"] for r in jaccard_join.one_of_each(df).collect())
    assert kept == sorted(i for i, n, c in want if i == c)


def test_every_link_is_kept(spark, docs_schema, monkeypatch):
    texts = near_copies()
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set() for w in ((t or "").encode().lower().split() for t in texts)]
    near = [{b for b in range(len(sets)) if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])} for a in range(len(sets))]
    df = spark.createDataFrame([(k, t, "x", "y", 0) for k, t in enumerate(texts)], docs_schema).repartition(5)
    for classes in (jaccard_join.BLOCK_CLASSES, 3):
        monkeypatch.setattr(jaccard_join, "BLOCK_CLASSES", classes)
        monkeypatch.setattr(jaccard_join, "PORTION", classes)
        lists, members = jaccard_join.links(df)
        rows: dict = {}
        for r in members.where("class is not null").collect():
            rows.setdefault(r["class"], []).append(r["doc_id"])
        got = [(x, y) for p in lists.collect() for q in p["partners"] for x in rows[p["class"]] for y in rows[q]] + [(x, y) for c in rows.values() for x in c for y in c if x != y]
        assert sorted(got) == sorted((a, b) for a in range(len(sets)) for b in near[a])
        assert sorted((r["doc_id"], r["n_links"]) for r in jaccard_join.components(df).collect()) == [(a, len(near[a])) for a in range(len(sets))]


@pytest.mark.parametrize("seed", range(6))
def test_alike(seed, monkeypatch):
    monkeypatch.setattr(jaccard_join, "AT_ONCE", 64)
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64)
    draw = lambda: np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.05, 0.15, 0.9])], rng.integers(0, 2**63, int(rng.integers(1, 30))).astype(np.uint64)]))
    x, y = [draw() for _ in range(20)], [draw() for _ in range(15)]
    assert jaccard_join.alike(x, y).tolist() == [[jaccard_join._similar(a, b) for b in y] for a in x]


def test_odd_rows(spark, docs_schema):
    rows = [(None, "a b c d e f", "x", "y", 0), (4, "a b c d e f", "x", "y", 0), (4, "other words are in this row", "x", "y", 0), (5, None, "x", "y", 0), (5, None, "x", "y", 0)]
    df = spark.createDataFrame(rows, docs_schema)
    got = sorted((tuple(r) for r in jaccard_join.components(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, 1), (4, 2, 4, 1), (4, 2, 4, 0), (5, 0, 5, 0), (5, 0, 5, 0)], key=str)
    assert jaccard_join.components(df.limit(0)).count() == 0 and jaccard_join.one_of_each(df.limit(0)).count() == 0
    assert sorted((tuple(r) for r in jaccard_join.one_of_each(df).collect()), key=str) == sorted([*rows[1:3], *rows[3:]], key=str)


def test_rows_that_share_an_id_are_judged_each_for_itself(spark, docs_schema):
    a, b, c, d = ("first text of six whole words", "second text of six other words", "third one is unlike all others", "fourth text has null ids only here")
    given = [(1, a), (4, a), (4, "nothing like it in this table"), (7, b), (7, c), (9, c.upper()), (8, b), (8, b), (None, d), (None, d), (None, "and one more null id stays")]
    df = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in given], docs_schema).withColumn("class", F.lit("clash")).withColumn("_h", F.lit("clash"))
    got = jaccard_join.one_of_each(df)
    assert got.columns == df.columns
    want = [(1, a), (4, "nothing like it in this table"), (7, b), (7, c), (None, d), (None, "and one more null id stays")]
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(want, key=str)


def test_sketch_bounds():
    rng = np.random.default_rng(5)
    none = np.zeros(0, np.uint64)
    for n in (1, 2, 5, 20, 63, 64, 70, 85, 100, 128, 150, 200, 500, 1000):
        for _ in range(10):
            x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for cells, d in jaccard_join.bands(len(x)):
                assert len(jaccard_join.cells_of(x, cells, 0, none, none)[0]) > d
            # a partner at the very limit shares a key
            drop = len(x) // 8
            y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)]))
            if jaccard_join._similar(x, y):
                keys = [{int(k) for c, d in jaccard_join.bands(len(s)) for k in jaccard_join.cells_of(s, c, 0, none, none)[0][: d + 1]} for s in (x, y)]
                assert keys[0] & keys[1]


def test_keys_of_many_sets_are_those_of_one():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.choice(1 << 62, n, replace=False).astype(np.uint64)) for n in (0, 1, 63, 64, 70, 90, 128, 500, 0, 3000)] + [np.zeros(0, np.uint64)]
    frequent = np.sort(np.concatenate([sets[7][:100], sets[9][::7]]))
    often = rng.integers(4, 1000, len(frequent))
    names, sketches = jaccard_join.summaries(sets)
    assert names.tolist() == [jaccard_join.class_of(s) for s in sets]
    assert all((a == jaccard_join.parity_sketch(s)).all() for a, s in zip(sketches, sets, strict=True))
    full = [s for s in sets if len(s)]
    for seed in (0, 3):
        want = [np.concatenate([jaccard_join.cells_of(s, c, seed, frequent, often)[0][: d + 1] for c, d in jaccard_join.bands(len(s))]) for s in full]
        assert [sorted(k.tolist()) for k in jaccard_join.first_cells(full, seed, frequent, often)] == [sorted(k.tolist()) for k in want]
    narrow = (np.arange(200, dtype=np.uint64) << np.uint64(1)) + np.uint64(1)
    for seed in range(4):
        none = np.zeros(0, np.uint64)
        want = [int(any(c and len(jaccard_join.cells_of(s, c, seed, none, none)[0]) <= d for c, d in jaccard_join.bands(len(s)))) if len(s) else 0 for s in [*sets, narrow]]
        assert jaccard_join.too_few([*sets, narrow], seed).tolist() == want


def test_texts_that_nobody_wants_are_not_shuffled(spark, tmp_path, monkeypatch):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(20))) for k in range(400)]
    rows += [(k, rows[k - 400][1] + " end") for k in range(400, 410)]
    df, plans, own = spark.createDataFrame(rows, "doc_id long, text string"), [], jaccard_join.settle
    df.write.parquet(f"{tmp_path}/docs")

    def seen(table, name, codec=None):
        if name in ("links", "partners"):
            plans.append(table._jdf.queryExecution().executedPlan().toString())
        return own(table, name, codec)

    monkeypatch.setattr(jaccard_join, "settle", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    assert got == {k: k % 400 for k in range(410)}
    # the marks of the wanted texts meet the texts as a broadcast, before any exchange
    assert plans and all("bit_or" in p and "BroadcastHashJoin" in p for p in plans)


def test_connected(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in jaccard_join.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(len(root)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in got.items()} == {k: v for k, v in root.items() if any(k in p and p[0] != p[1] for p in pairs)}


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the driver's tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0] and sizes[1] < sizes[0]
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}


def test_keys_side_by_side_and_wide_sketches(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    key, name, size = rng.integers(0, 40, 500), rng.integers(1, 60, 500), np.zeros(500, np.int64)
    size = name * 7 % 50 + 1  # a class has one size
    (k, c, one, before), kept = jaccard_join.side_by_side(key, name, size)
    buckets: dict = {}
    for a, b, n in zip(key.tolist(), name.tolist(), size.tolist(), strict=True):
        buckets.setdefault(a, set()).add((n, b))
    assert sorted(zip(k.tolist(), c.tolist(), strict=True)) == sorted((a, b) for a, v in buckets.items() if len(v) > 1 for _, b in v)
    assert sorted(key[kept].tolist()) == sorted(buckets)
    fits = lambda x, y: 100 * min(x, y) >= 75 * max(x, y)
    for a, b, x, y in zip(k.tolist(), c.tolist(), one.tolist(), before.tolist(), strict=True):
        v = sorted(buckets[a])
        at = [q for _, q in v].index(b)
        assert x == (v[0][1] if at and fits(v[0][0], v[at][0]) else 0) and y == (v[at - 1][1] if at and fits(v[at - 1][0], v[at][0]) else 0)
    # a wide sketch's distance never exceeds the symmetric difference, whatever the two lengths, and drops pairs that 512 bits don't
    pool = np.sort(jaccard_join.mix(np.arange(1, 9000, dtype=np.uint64)))
    for n, m in ((300, 400), (2000, 2600), (2000, 2001), (4000, 5300)):
        x, y = np.sort(rng.choice(pool, n, False)), np.sort(rng.choice(pool, m, False))
        for b in (y, np.unique(np.concatenate((x, y[: n // 5])))):
            assert jaccard_join.wide_distance(*map(jaccard_join.wide_sketch, (x, b))) <= len(np.setxor1d(x, b))
        assert 7 * jaccard_join.wide_distance(*map(jaccard_join.wide_sketch, (x, y))) > n + m
    assert jaccard_join.wide_sketch(pool[:10]) is None
    # buckets that a task can't hold at once lose no link, and few jobs are run
    rows = [(k, " ".join(f"w{k % 30}x{j}" for j in range(40)) + f" end{k}") for k in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(jaccard_join, "HELD_KEYS", 16)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("join", "join")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {k: k % 30 for k in range(150)}
    assert len(tracker.getJobIdsForGroup("join")) < 120


def test_tasks_give_memory_back_and_deal_few_keys_at_a_time(spark, monkeypatch):
    given = []
    monkeypatch.setattr(arrow_map, "give_back", lambda: given.append(1))
    assert list(arrow_map.giving_back(iter)([1, 2])) == [1, 2] and len(given) == 1
    left = arrow_map.giving_back(iter)([1, 2])
    next(left)
    left.close()  # a task that ends early gives back as well
    assert len(given) == 2
    # keys that are dealt out in many small rows meet like those of one
    rows = [(k, " ".join(f"w{k % 30}x{j}" for j in range(40)) + f" end{k}") for k in range(150)]
    monkeypatch.setattr(jaccard_join, "DEALT_KEYS", 16)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k % 30 for k in range(150)}
