r"""The prefix trie of rebuilt conversations, from products of turn hashes.

A rebuilt conversation is the head of a base conversation (its first ``head``
turns) followed by its own turns after the first ``head``. No rebuilt text is
ever made. A turn stands for the map x -> a x + b modulo a prime, its a and b drawn
from the SHA-256 of role and text; such maps form a group, so

* products of a conversation's turns are built range by range of one sort, and
  ranges are put together by multiplying what each of them comes to;
* the fingerprint of a rebuilt prefix is (product of the base's head) (product
  of the own head)^-1 (product of the own turns so far): three stored values.

Rows of equal depth and fingerprint are a node of the trie. Each such row refers to a
stored turn, its last one; a node is accepted if the turns that its rows refer to have one
SHA-256. As a map has an inverse, equal products with equal last turns have equal
products before them, so by induction over depths an accepted trie has only true prefixes.
If any node isn't accepted, all is done again with other maps.

A node belongs to its smallest member. What a conversation owns is the end of its path
from some depth on, so sums over a subtree are sums over members: the owned values of each member,
from the node's depth on for the owner and all of them for the others. Nothing is done level by level, so
depth costs no rounds. A conversation of any length is spread over ranges; (conversation, range) is the key
of windows, so none is larger than a range. Joins have one row per key on one side; where the other side's key is hot
(a common first turn), adaptive execution splits it. The conversations that end in a node are joined to text
in blocks of ``1 << ID_BITS`` ids and hashed as a stream in order.

Order of turns: turn (null first), role, SHA-256. Null role and text are empty; rows
without a conversation id belong to none and are left out. Repeated rows are turns of
their own. Texts of any length are hashed and counted by Spark. Other columns aren't
read. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.arrow_map import bound_batches
from vitalgrid.llm.common import settle
from vitalgrid.llm.numbering import group_runs, sorted_parts

PRIME = (1 << 61) - 1
IDENTITY = (1, 0)
ID_BITS = 16
#: Most turns of a base's head.
MOST_HEAD = 3
NODE = ["depth", "a", "b"]
NO_IDS = sha256(b"").hexdigest()


def turn_map(digest: bytes, attempt: int) -> tuple[int, int]:
    h = blake2b(digest, digest_size=16, salt=attempt.to_bytes(8, "little")).digest()
    return 1 + int.from_bytes(h[:8], "little") % (PRIME - 1), int.from_bytes(h[8:], "little") % PRIME


def times(x: tuple[int, int], y: tuple[int, int]) -> tuple[int, int]:
    """First y, then x."""
    return x[0] * y[0] % PRIME, (x[0] * y[1] + x[1]) % PRIME


def inverse(x: tuple[int, int]) -> tuple[int, int]:
    a = pow(x[0], -1, PRIME)
    return a, -a * x[1] % PRIME


def _running_products(attempt: int):
    """Adds ``a`` and ``b``, the product of a conversation's turns from the range's first to this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, product = None, IDENTITY
        for batch in batches:
            out = []
            for conv, digest in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                product = times(product if conv == at else IDENTITY, turn_map(digest, attempt))
                at = conv
                out.append(product)
            added = [pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "a", "b"])

    return lambda df: df.mapInArrow(run, f"{_ddl(df)}, a long, b long")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _earlier_products(runs: DataFrame) -> DataFrame:
    """(conv_id, part, ea, eb): the product of a conversation's earlier ranges. Only conversations cut by a range's end have any: at most as many as there are ranges."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows, product, out = rows.sort_values("part"), IDENTITY, []
        for a, b in zip(rows["ra"].tolist(), rows["rb"].tolist(), strict=True):
            out.append(product)
            product = times(product, (a, b))
        return pd.DataFrame({"conv_id": rows["conv_id"].to_numpy(), "part": rows["part"].to_numpy(), "ea": [p[0] for p in out], "eb": [p[1] for p in out]})

    cut = runs.where(F.col("n_run") < F.col("n")).select("conv_id", "part", F.col("last.a").alias("ra"), F.col("last.b").alias("rb"))
    return cut.groupBy("conv_id").applyInPandas(scan, "conv_id long, part long, ea long, eb long")


_HEAD = "array<struct<depth:long,a:long,b:long,words:long,digest:binary>>"


def _heads(plans: DataFrame, attempt: int) -> DataFrame:
    """Adds to a conversation ``pa``, ``pb`` (what its own products are multiplied by) and ``head`` (root and turns taken from the base)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64()), ("digest", pa.binary())]))
        for batch in batches:
            before, heads = [], []
            for r in batch.select(["h", "hb", "first", "base_first"]).to_pylist():
                head, product = [{"depth": 0, "a": 1, "b": 0, "words": 0, "digest": b""}], IDENTITY
                for depth, turn in enumerate((r["base_first"] or [])[: r["hb"]], 1):
                    product = times(product, turn_map(turn["digest"], attempt))
                    head.append({"depth": depth, "a": product[0], "b": product[1], "words": turn["words"], "digest": turn["digest"]})
                own = IDENTITY
                for turn in (r["first"] or [])[: r["h"]]:
                    own = times(own, turn_map(turn["digest"], attempt))
                before.append(times(product, inverse(own)))
                heads.append(head)
            kept = batch.select(["conv_id", "n", "h", "hb"])
            added = [pa.array([p[k] for p in before], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept.columns, *added, pa.array(heads, kind)], names=[*kept.schema.names, "pa", "pb", "head"])

    return plans.mapInArrow(run, f"conv_id long, n long, h long, hb long, pa long, pb long, head {_HEAD}")


def _suffix_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprint of an own turn: (head and inverse) (earlier ranges) (this range so far)."""
    for batch in batches:
        x = [batch.column(c).to_pylist() for c in ("pa", "pb", "ea", "eb", "a", "b")]
        out = [times(times((p, q), (e, f)), (a, b)) for p, q, e, f, a, b in zip(*x, strict=True)]
        kept = batch.select(["conv_id", "part", "depth", "words", "digest", "ends"])
        added = [pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*kept.columns, *added], names=[*kept.schema.names, "a", "b"])


def stored_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """What is kept of a turn: its place in the order, SHA-256 and number of words."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    made = turns.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    )
    return settle(made, "trie-turns")


def rebuilt_rows(stored: DataFrame, base: Column, head: Column, attempt: int) -> DataFrame:
    """(conv_id, part, depth, a, b, words, digest, ends): every prefix of every rebuilt conversation by its fingerprint and last turn; written."""
    placed = sorted_parts(stored, "conv_id", ["turn", "role", "digest", "row"], "trie-order", _running_products(attempt))
    runs = settle(group_runs(placed, "conv_id", F.max_by(F.struct("a", "b"), "at").alias("last")), "trie-runs")
    where = runs.select("conv_id", "part", (F.col("before") - F.col("first")).alias("shift"), "n")
    early = runs.where(F.col("before") < MOST_HEAD).select("conv_id", "part", (F.col("before") - F.col("first")).alias("shift"), "n")
    first = placed.join(early, ["conv_id", "part"]).where(F.col("at") + F.col("shift") < MOST_HEAD)
    first = first.groupBy("conv_id", "n").agg(F.sort_array(F.collect_list(F.struct((F.col("at") + F.col("shift")).alias("pos"), "words", "digest"))).alias("first"))
    convs = settle(first.withColumn("base", base).withColumn("h", head.cast("long")), "trie-convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("first").alias("base_first"))
    plans = convs.join(bases, "base", "left").withColumn("hb", F.least("h", F.coalesce("n_base", F.lit(0))).cast("long"))
    plans = settle(_heads(plans.select("conv_id", "n", "h", "hb", "first", "base_first"), attempt).withColumn("len", F.col("hb") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "trie-plans")

    taken = plans.select("conv_id", "len", F.explode("head").alias("t")).select("conv_id", F.lit(-1).cast("long").alias("part"), "t.*", (F.col("t.depth") == F.col("len")).alias("ends"))
    ranges = where.join(plans.drop("head", "n"), "conv_id").join(_earlier_products(runs), ["conv_id", "part"], "left").fillna({"ea": 1, "eb": 0})
    own = placed.join(ranges, ["conv_id", "part"]).withColumn("pos", F.col("at") + F.col("shift")).where(F.col("pos") >= F.col("h"))
    own = own.withColumn("depth", F.col("pos") + 1 + F.col("hb") - F.col("h")).withColumn("ends", F.col("depth") == F.col("len"))
    own = own.select("conv_id", "part", "depth", "words", "digest", "ends", "pa", "pb", "ea", "eb", "a", "b")
    own = own.mapInArrow(_suffix_products, "conv_id long, part long, depth long, words long, digest binary, ends boolean, a long, b long")
    return settle(taken.unionByName(own), "trie-rows")


def _nodes(rows: DataFrame) -> DataFrame:
    made = rows.groupBy(*NODE).agg(
        F.count(F.lit(1)).alias("n_convs"),
        F.min(F.struct("conv_id", "part", "ends")).alias("owner"),
        F.max("words").alias("words"),
        F.sum(F.col("ends").cast("long")).alias("n_ends"),
        (F.min("digest") == F.max("digest")).alias("same"),
    )
    flat = made.select(*NODE, "n_convs", "words", "n_ends", "same", F.col("owner.conv_id").alias("conv_id"), F.col("owner.part").alias("part"), (~F.col("owner.ends")).alias("goes_on"))
    return settle(flat.withColumn("childless", F.col("n_ends") == F.col("n_convs")).withColumn("value", (F.col("n_convs") - 1) * F.col("words")), "trie-nodes")


def _end_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end in a node, in order, joined by commas: a stream over blocks of ids."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.where("ends").groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("block")).agg(text.alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, sha256()
        for batch in batches:
            done = []
            for node in batch.to_pylist():
                key = tuple(node[c] for c in NODE)
                if key != at:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = key, sha256()
                else:
                    state.update(b",")
                state.update(node["ids"].encode())
            if done:
                yield _ended(done)
        if at is not None:
            yield _ended([(*at, state.hexdigest())])

    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return ordered.mapInArrow(stream, "depth long, a long, b long, ends_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, base: Column, head: Column, attempts: int = 8, **names: str) -> DataFrame:
    """One row per node: its smallest member, depth, parent's smallest member, counts, tokens that sharing saves in its subtree, and the digest of the ids that end there.

    ``base`` and ``head`` are expressions over ``conv_id``: whose head a
    conversation begins with, and how many turns that is (0 to ``MOST_HEAD``).
    ``names``: ``conv_col``, ``turn_col``, ``role_col``, ``text_col``.
    """
    bound_batches(turns.sparkSession)
    stored = stored_turns(turns, **names)
    for attempt in range(attempts):
        rows = rebuilt_rows(stored, base, head, attempt)
        nodes = _nodes(rows)
        if nodes.where(~F.col("same")).isEmpty():
            return _with_subtrees(rows, nodes)
    raise RuntimeError(f"fingerprints clash under {attempts} choices of maps")


def _with_subtrees(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    run = Window.partitionBy("conv_id", "part")
    below = run.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = nodes.groupBy("conv_id", "part").agg(F.sum("value").alias("total"), F.max("childless").alias("leaf"), F.min("depth").alias("from"))
    parts = settle(parts.withColumn("after", F.coalesce(F.sum("total").over(later), F.lit(0))), "trie-parts")
    owners = parts.groupBy("conv_id").agg(F.sum("total").alias("total"), F.max("leaf").cast("long").alias("leaf"), F.min("from").alias("from"))

    # what members that don't own a node bring to its subtree
    shared = rows.select("conv_id", *NODE).join(owners, "conv_id").where(F.col("depth") < F.col("from"))
    brought = shared.groupBy(*NODE).agg(F.sum("total").alias("total"), F.sum("leaf").alias("leaves"), F.sum((F.col("from") == F.col("depth") + 1).cast("long")).alias("branches"))
    forks = shared.where(F.col("from") == F.col("depth") + 1).select("conv_id", *NODE).join(nodes.select(*NODE, F.col("conv_id").alias("fork")), NODE).select("conv_id", "fork")

    owned = nodes.withColumn("sum", F.sum("value").over(below)).join(parts.select("conv_id", "part", "after"), ["conv_id", "part"])
    owned = owned.join(owners.select("conv_id", "leaf", "from").join(forks, "conv_id", "left"), "conv_id").join(brought, NODE, "left").join(_end_digests(rows), NODE, "left")
    return owned.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.when(F.col("depth") > F.col("from"), F.col("conv_id")).otherwise(F.col("fork"))).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("branches", F.lit(0)) + F.col("goes_on").cast("long")).alias("n_children"),
        (F.col("leaf") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
        (F.col("sum") + F.col("after") + F.coalesce(F.col("total"), F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )
