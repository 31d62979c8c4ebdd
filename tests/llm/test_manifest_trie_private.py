"""Merkle manifest, prefix trie and personal data: against plain computations over whole rows, and their odd cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalgrid.llm import merkle, numbering, prefix_trie, private_spans, queries

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
CRC = lambda n: zlib.crc32(str(n).encode())


# ---------------------------------------------------------------- Merkle manifest


def leaf_by_hand(cells):
    return H("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def path_by_hand(nodes, k):
    """Siblings of node k up to the single node that remains, and that node."""
    out = []
    while len(nodes) > 1:
        pair = nodes[k & ~1 : (k & ~1) + 2]
        out += [x for j, x in enumerate(pair) if j != (k & 1)]
        nodes, k = [H(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)], k >> 1
    return out, nodes[0]


def fold_by_hand(nodes, k, seen):
    if len(nodes) == 1:
        return seen
    nodes = nodes[:k] + [seen] + nodes[k + 1 :]
    # only the path from k changes: recompute it beside the original siblings
    ups = [H(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)]
    return fold_by_hand(ups, k >> 1, ups[k >> 1])


def manifest_by_hand(rows):
    """Contract rows of (doc_id, text, lang, source, n_chars) without repeated ids."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    cells = lambda r, more=0: (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
    leaves = {}
    for v in order:
        trees[v].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_by_hand(cells(r))))
        leaves[v] = [leaf_by_hand(cells(r)) for r in trees[v]]
    subroots = [path_by_hand(leaves[v], 0)[1] for v in order]
    out = []
    for t, v in enumerate(order):
        for k, r in enumerate(trees[v]):
            inner, subroot = path_by_hand(leaves[v], k)
            outer, root = path_by_hand(subroots, t)
            changed = r[0] is not None and CRC(r[0]) % 7 == 0
            seen = leaf_by_hand(cells(r, int(changed)))
            folded = fold_by_hand(subroots, t, fold_by_hand(leaves[v], k, seen))
            out.append((r[0], leaves[v][k], subroot, root, H(*inner, *outer), folded, folded == root))
    return sorted(out, key=repr)


def documents(n, seed=3):
    rng = random.Random(seed)
    langs = ["en"] * 6 + ["de", "é", "", None]
    rows = [(k, "".join(rng.choice("ab é世\n|") for _ in range(rng.randrange(40))), rng.choice(langs), f"s{k % 3}", k) for k in range(n)]
    rows += [(n, None, "en", None, None), (n + 1, "", "lone", "s", 0), (n + 2, "x" * 300_000, "en", "s", 1), (None, "no id", "en", "s", 2), (None, "no id", "en", "s", 2), (7, rows[7][1], rows[7][2], "other", 5)]
    return rows


def contract_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("height", [2, 11])
def test_merkle_against_hand(spark, tmp_path, docs_schema, monkeypatch, height):
    whole = merkle.merkle_proofs
    monkeypatch.setattr(merkle, "merkle_proofs", lambda *a, **b: whole(*a, **b, height=height))  # 2: several rounds over superblocks
    rows = documents(90)
    spark.createDataFrame(rows, docs_schema).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = contract_rows(queries.op11_merkle_manifest(spark, str(tmp_path)))
    assert got == manifest_by_hand(rows)
    found = [r for r in got if not r[-1]]
    assert found and all(CRC(r[0]) % 7 == 0 for r in found)


def test_merkle_proofs_stand_alone_and_show_changes(spark, docs_schema):
    rows = [(k, f"text {k}", "en" if k % 4 else "de", "s", k) for k in range(40)]
    docs = spark.createDataFrame(rows, docs_schema).withColumn("leaf", F.lit("clash")).withColumn("node", F.lit(1))
    proofs = merkle.merkle_proofs(docs, ["doc_id", "text"], "lang", "doc_id").cache()
    for r in proofs.collect():
        assert r["verified"]
        assert merkle.folded_root(r["leaf"], r["pos"], r["n_leaves"], r["tree_pos"], r["n_trees"], r["proof"]) == r["root"]
        assert merkle.folded_root(H("other"), r["pos"], r["n_leaves"], r["tree_pos"], r["n_trees"], r["proof"]) != r["root"]
    old = merkle.manifest(proofs, "lang")
    assert {(r["lang"], r["n_leaves"]) for r in old.collect()} == {("en", 30), ("de", 10)}
    other = docs.withColumn("text", F.when(F.col("doc_id") == 4, "changed").otherwise(F.col("text"))).withColumn("lang", F.when(F.col("doc_id") == 1, "fr").otherwise(F.col("lang")))
    new = merkle.manifest(merkle.merkle_proofs(other, ["doc_id", "text"], "lang", "doc_id"), "lang")
    assert {(r["lang"], r["change"]) for r in merkle.changed_trees(old, new, "lang").collect()} == {("de", "changed"), ("en", "changed"), ("fr", "added")}
    assert merkle.changed_trees(old, old, "lang").isEmpty()


def test_merkle_of_nothing_and_of_one_row(spark, docs_schema):
    assert merkle.merkle_proofs(spark.createDataFrame([], docs_schema), ["doc_id"], "lang", "doc_id").collect() == []
    (one,) = merkle.merkle_proofs(spark.createDataFrame([(1, None, None, None, None)], docs_schema), ["doc_id"], "lang", "doc_id").collect()
    assert one["leaf"] == one["subroot"] == one["root"] == one["folded_root"] and one["proof"] == "" and one["lang"] is None


def test_places_are_spread_over_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, "small").otherwise("large").alias("g"), F.lit(1).alias("same"), F.col("id").alias("row"))
    out = numbering.numbered(df, "g", ["same", "row"], "places").toPandas()
    for _, rows in out.groupby("g"):
        assert rows.sort_values("row")["pos"].tolist() == list(range(len(rows))) and set(rows["n"]) == {len(rows)}
    assert numbering.sorted_parts(df, "g", ["same", "row"], "ranges").where("g = 'large'").select("part").distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# ---------------------------------------------------------------- prefix trie


def trie_by_hand(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(x)] for c, x in own.items()}
    rebuilt = {c: own.get(c - c % 20, [])[: CRC(c) % 4] + x[CRC(c) % 4 :] for c, x in own.items()}
    members = {}
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    out = []
    for p, convs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(p))
        leaves = sum(not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members) for q in below)
        out.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), sum(len(q) == len(p) + 1 for q in below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id long, turn long, role string, text string"


def turns_rows(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, t, ("user", "assistant")[t % 2], rng.choice(["hi", "a b c", "a  b\tc", "", "世界 x"])))
    rows += [(500, t, "user", f"long {t % 3}") for t in range(260)] + [(501, t, "user", f"long {t % 3}") for t in range(250)]
    rows += [(502, None, None, None), (502, 3, None, "x"), (502, 3, "user", None), (502, 3, "user", None), (None, 1, "user", "of no conversation"), (503, 1, "user", "w " * 50_000)]
    rows += [(c, t, "user", "same") for c in range(1000, 1040) for t in range(3)]
    return rows


def trie_rows(df):
    return sorted((tuple(r[c] for c in TRIE) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_hand(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 3)  # several blocks of ids for a node
    rows = turns_rows(seed)
    spark.createDataFrame(rows, TURNS).repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    assert trie_rows(queries.op12_prefix_trie(spark, str(tmp_path))) == trie_by_hand(rows)


def test_trie_starts_again_when_fingerprints_clash(spark, monkeypatch):
    rows = [(c, t, "user", f"{(c * 7 + t) % 5}") for c in range(30) for t in range(3)]
    conv = F.col("conv_id")
    tried = []
    rebuilt = prefix_trie.rebuilt_rows

    def watched(stored, base, head, attempt):
        tried.append(attempt)
        if attempt == 0:  # as if all turns had one map: every prefix of equal length gets one fingerprint
            return rebuilt(stored, base, head, 1).withColumn("a", F.lit(1).cast("long")).withColumn("b", F.lit(0).cast("long"))
        return rebuilt(stored, base, head, attempt)

    monkeypatch.setattr(prefix_trie, "rebuilt_rows", watched)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), conv - conv % 20, F.crc32(conv.cast("string")) % 4)
    assert trie_rows(got) == trie_by_hand(rows) and tried == [0, 1]


def test_trie_of_nothing_and_other_columns(spark):
    conv = F.col("conv_id")
    base, head = conv - conv % 20, F.crc32(conv.cast("string")) % 4
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TURNS), base, head).collect() == []
    rows = [(c, t, "u", "x y") for c in range(5) for t in range(2)]
    odd = spark.createDataFrame(rows, "id long, turn long, who string, said string").withColumn("digest", F.lit(1)).withColumn("words", F.lit(2)).withColumn("a", F.lit(3))
    assert trie_rows(prefix_trie.prefix_trie(odd, base, head, conv_col="id", role_col="who", text_col="said")) == trie_by_hand(rows)


@given(st.lists(st.tuples(st.integers(1, prefix_trie.PRIME - 1), st.integers(0, prefix_trie.PRIME - 1)), min_size=3, max_size=3))
def test_maps_form_a_group(maps):
    x, y, z = maps
    t = prefix_trie.times
    assert t(t(x, y), z) == t(x, t(y, z)) and t(x, prefix_trie.inverse(x)) == prefix_trie.IDENTITY == t(prefix_trie.inverse(x), x)


# ---------------------------------------------------------------- personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    def holds(kind, s):
        digits = [int(c) for c in s if c in "0123456789"]
        if kind == "card":
            doubled = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and doubled % 10 == 0
        return kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in s.split("."))) or (kind == "phone" and 8 <= len(digits) <= 15)

    return {k: [m.span() for m in re.finditer(r, text) if holds(k, m[0])] for k, r in PATTERNS.items()}


@given(st.text(alphabet="0123456789.@+- ()aZ_%é\n", max_size=60))
@settings(max_examples=3000, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert private_spans.base_spans(text) == base_by_hand(text)


def segmentations(n, segments, at=0, before=0):
    """All ways to cut n atoms into text and candidates: (list of candidates, transitions)."""
    if at == n:
        yield [], []
        return
    for rest, moves in segmentations(n, segments, at + 1, 0):
        yield rest, [(before, 0), *moves]
    for k, (i, j) in enumerate(segments):
        if i == at:
            for rest, moves in segmentations(n, segments, j, 1):
                yield [k, *rest], [(before, 1), *moves]


def test_recursions_against_all_segmentations():
    rng = np.random.default_rng(5)
    pieces, owner, at, to = [], [], [], []
    for e in range(6):
        n = int(rng.integers(1, 6))
        segments = [(i, j) for i in range(n) for j in range(i + 1, n + 1) if rng.random() < 0.6]
        pieces.append((n, segments))
        owner += [e] * len(segments)
        at += [i for i, _ in segments]
        to += [j for _, j in segments]
    scores, transition = rng.normal(size=(len(at), 4)), rng.normal(size=(2, 2))
    p, z, moved = private_spans.segment_marginals(np.array([n for n, _ in pieces]), np.array(owner), np.array(at), np.array(to), scores, transition)
    for e, (n, segments) in enumerate(pieces):
        mine = np.flatnonzero(np.array(owner) == e)
        weights, share, moves = 0.0, np.zeros((len(mine), 4)), np.zeros((2, 2))
        best, best_weight = None, -np.inf
        for chosen, steps in segmentations(n, segments):
            for kinds in itertools.product(range(4), repeat=len(chosen)):
                x = sum(scores[mine[k], c] for k, c in zip(chosen, kinds, strict=True)) + sum(transition[m] for m in steps)
                weights += np.exp(x)
                for k, c in zip(chosen, kinds, strict=True):
                    share[k, c] += np.exp(x)
                for m in steps:
                    moves[m] += np.exp(x)
                if x > best_weight:
                    best, best_weight = list(zip(chosen, kinds, strict=True)), x
        assert np.isclose(z[e], np.log(weights)) and np.allclose(p[mine], share / weights) and np.allclose(moved[e], moves / weights)
        assert private_spans.best_segmentation(n, segments, scores[mine], transition) == best


WORDS = ["alpha", "beta", "gamma", "delta", "of", "the"]


def with_luhn(rng, n=16):
    d = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(d + c for c in "0123456789" if private_spans.luhn(d + c))


def texts_with_data(rng, n):
    some = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9)))
    made = {
        "email": lambda: f"{rng.choice(WORDS)}.{rng.randint(1, 99)}@{rng.choice(WORDS)}{rng.randint(1, 9)}.example.com",
        "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        "card": lambda: with_luhn(rng),
        "phone": lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
    }
    out = []
    for k in range(n):
        kind = private_spans.KINDS[k % 4]
        out.append((kind, some(), made[kind](), some()))
    return out


def test_field_finds_other_writings_and_leaves_the_rest(spark):
    rng = random.Random(11)
    train = [f"{a} {x} {b}" for _, a, x, b in texts_with_data(rng, 240)] + [f"In {rng.randint(1900, 2030)} {rng.choice(WORDS)} {rng.randint(1, 10**9)} x" for _ in range(60)]
    model = private_spans.fit_private(spark.createDataFrame([(t,) for t in train], "text string"))
    assert model.known == (True,) * 4
    hit = total = false = misses = 0
    for kind, a, x, b in texts_with_data(rng, 60):
        for written in private_spans.other_writings(kind, x):
            text, at = f"{a} {written} {b}", len(a) + 1
            if not any(base_by_hand(text).values()):
                total += 1
                hit += any((s["kind"], s["start"], s["end"]) == (kind, at, at + len(written)) for s in private_spans.find_private(text, model))
        for written in private_spans.near_misses(kind, x):
            text = f"{a} {written} {b}"
            if not any(base_by_hand(text).values()):
                misses += 1
                false += bool(private_spans.find_private(text, model))
    assert hit >= 0.9 * total and false <= 0.1 * misses, (hit, total, false, misses)
    clean = " ".join(f"{rng.choice(WORDS)} at {rng.choice(WORDS)}, section {k}. In 19{k % 90 + 10} it was 3.{k}." for k in range(300))
    assert private_spans.find_private(clean, model) == []


def test_private_rows(spark, docs_schema):
    rng = random.Random(2)
    rows = [(k, f"{a} {x} {b}", "en", "s", 1) for k, (_, a, x, b) in enumerate(texts_with_data(rng, 80))]
    rows += [(100, None, None, None, None), (101, "", "en", "s", 0), rows[0], rows[0], (102, "1 " * 20_000 + "a.1@b.example.com " + "9" * 50_000 + "@" * 3000 + "." * 5000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, docs_schema).withColumn("redacted", F.lit("clash"))
    model = private_spans.fit_private(docs)
    out = private_spans.apply_private(docs, model).collect()
    assert len(out) == len(rows) and sorted(out[0].asDict()) == sorted([*docs.columns, "private_spans"])
    for r in out:
        if r["text"] is None:
            assert r["private_spans"] == [] and r["redacted"] is None
            continue
        base = [(k, *s) for k, found in base_by_hand(r["text"]).items() for s in found]
        assert [(s["kind"], s["start"], s["end"]) for s in r["private_spans"] if s["fixed"]] == base
        order = [(private_spans.KINDS.index(s["kind"]), s["start"]) for s in r["private_spans"]]
        assert order == sorted(order)
        assert not any(k in r["redacted"] for k in ("@b.example", "555-")) and ("[" in r["redacted"]) == bool(r["private_spans"])
    nothing = private_spans.fit_private(docs.where("false"))
    assert not any(nothing.known) and private_spans.apply_private(docs.where("false"), nothing).collect() == []
    assert private_spans.find_private("call (017) 555-7713", nothing) == []


def test_op13_columns(spark, tmp_path, docs_schema):
    rng = random.Random(4)
    rows = [(k, f"{a} {x} {b}", "en", "s", 1) for k, (_, a, x, b) in enumerate(texts_with_data(rng, 40))] + [(90, None, None, None, None), (91, "none", "en", "s", 1)]
    spark.createDataFrame(rows, docs_schema).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op13_private_spans(spark, str(tmp_path)).collect():
        base = base_by_hand(next(t for i, t, *_ in rows if i == r["doc_id"]) or "")
        assert [r[f"n_{k}"] for k in private_spans.KINDS] == [len(base[k]) for k in private_spans.KINDS]
        listed = [f"{k}:{a}:{b}" for k in private_spans.KINDS for a, b in base[k]]
        assert r["base_sha256"] == H(",".join(listed)) and set(listed) <= set(r["spans"].split(",") if r["spans"] else [])
