"""Merkle manifest of a dataset: one binary hash tree per value of a column, one tree over these, and a checked proof for every row.

A leaf is H over the row's columns, each ``-`` if null, else UTF-8 byte count,
``:`` and value; H is lowercase hex SHA-256 and takes digests as hex text. Nodes
are joined in pairs, level by level; a lone last node is hashed alone.

Every tree is cut into superblocks of ``1 << HEIGHT`` leaves. A first pass reduces each
superblock to its root; the roots are the leaves of a tree that many
times smaller and is treated the same way (two rounds reach four million rows a
value, three eight thousand million). What a superblock needs from outside, the
siblings of its root up to the tree's root and from there to the dataset's, is
one row. Leaves and these rows are then cogrouped by superblock: one call per
superblock rebuilds its levels, appends the outer siblings to the inner ones and
folds every row's leaf, or the leaf of its changed version, up to the root.
Texts are read once, when leaves are made; only digests are shuffled. No group
is larger than a superblock, however large a value's tree is.

Nulls: a null cell is ``-``, a null value of the tree column is a tree of its
own, before all others; a null order value comes first. Ties and repeated rows
keep a leaf each, in order of their digests. Texts of any length are hashed by
Spark in place. Only the columns asked for are read, so other columns can't
clash. An empty table has no rows and no root.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.arrow_map import bound_batches
from vitalgrid.llm.common import settle
from vitalgrid.llm.numbering import numbered

#: Leaves of a superblock: a power of two.
HEIGHT = 11
DIGEST = 64


def digest(*hexes: str) -> str:
    return sha256("".join(hexes).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    def cell(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*(cell(c) for c in columns)).cast("binary"), 256)


def levels_of(nodes: list[str], height: int | None = None) -> list[list[str]]:
    """``nodes`` and the levels above them: ``height`` many, or up to a single node."""
    levels = [nodes]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        low = levels[-1]
        levels.append([digest(*low[k : k + 2]) for k in range(0, len(low), 2)])
    return levels


def siblings(levels: list[list[str]], k: int) -> str:
    """Digests beside the path from node ``k`` of the lowest level to the highest, joined."""
    out = []
    for level in levels[:-1]:
        if (k ^ 1) < len(level):
            out.append(level[k ^ 1])
        k >>= 1
    return "".join(out)


def fold(node: str, k: int, n: int, proof: str, at: int = 0) -> tuple[str, int]:
    """The root that node ``k`` of ``n`` leads to with the proof's digests from ``at`` on, and where they end."""
    while n > 1:
        if (k ^ 1) < n:
            other, at = proof[at : at + DIGEST], at + DIGEST
            node = digest(other, node) if k & 1 else digest(node, other)
        else:
            node = digest(node)
        k, n = k >> 1, (n + 1) >> 1
    return node, at


def folded_root(leaf: str, pos: int, n_leaves: int, tree_pos: int, n_trees: int, proof: str) -> str:
    """What a holder of one row, its places and its proof computes; equals the root if nothing was changed."""
    subroot, at = fold(leaf, pos, n_leaves, proof)
    return fold(subroot, tree_pos, n_trees, proof, at)[0]


def _own_height(n: int, height: int) -> int | None:
    """Levels of a superblock in a tree of n leaves: fixed where there are others beside it."""
    return height if n > 1 << height else None


def _block(df: DataFrame, height: int) -> DataFrame:
    return df.withColumn("block", F.shiftright("pos", height))


def _block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, pos, n, node) of the superblocks' roots."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        n = int(rows["n"].iloc[0])
        top = levels_of(rows["node"].tolist(), _own_height(n, height))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "pos": [key[1]], "n": [-(-n >> height)], "node": [top]})

    cut = _block(nodes.select("tree", "pos", "n", "node"), height)
    return cut.groupBy("tree", "block").applyInPandas(reduce, "tree string, pos long, n long, node string")


def _paths(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, pos, path, top): siblings of every node up to its tree's root, and that root."""
    schema = "tree string, pos long, path string, top string"
    nodes = _block(nodes.select("tree", "pos", "n", "node"), height)

    def inner(rows: pd.DataFrame, tree: str, outer: str, top: str | None) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = levels_of(rows["node"].tolist(), _own_height(int(rows["n"].iloc[0]), height))
        paths = [siblings(levels, k) + outer for k in range(len(rows))]
        return pd.DataFrame({"tree": tree, "pos": rows["pos"].to_numpy(), "path": paths, "top": top or levels[-1][0]})

    if (nodes.agg(F.max("n")).first()[0] or 0) <= 1 << height:
        return nodes.groupBy("tree").applyInPandas(lambda key, rows: inner(rows, key[0], "", None), schema)
    above = _paths(settle(_block_roots(nodes, height), "merkle-roots"), height).withColumnRenamed("pos", "block")
    both = nodes.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
    return both.applyInPandas(lambda key, rows, up: inner(rows, key[0], up["path"].iloc[0], up["top"].iloc[0]), schema)


def merkle_proofs(docs: DataFrame, columns: list[str], tree_col: str, order_col: str, changed: dict[str, Column] | None = None, changed_where: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs``: the order and the tree column, ``leaf``, ``subroot``, ``root``, ``proof`` (sibling digests, joined), the four places that a check needs, ``folded_root`` and ``verified``.

    ``changed`` replaces columns where ``changed_where`` holds: such rows fold the
    changed leaf with the proof of the original, so ``verified`` shows whether
    the change is found. Order values may be integers, strings or dates.
    """
    bound_batches(docs.sparkSession)
    plain = lambda c: F.col(f"`{c}`")
    tree = F.coalesce(F.concat(F.lit("="), plain(tree_col).cast("string")), F.lit(""))
    other = leaf_digest([(changed or {}).get(c, plain(c)) for c in columns])
    made = docs.select(
        tree.alias("tree"),
        plain(order_col).alias("key"),
        leaf_digest([plain(c) for c in columns]).alias("node"),
        F.when(F.coalesce(changed_where, F.lit(False)), other).alias("seen") if changed else F.lit(None).cast("string").alias("seen"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = _block(numbered(settle(made, "merkle-leaves"), "tree", ["key", "node", "row"], "merkle-order"), height)

    roots = settle(_block_roots(leaves, height), "merkle-blocks")
    above = settle(_paths(roots, height), "merkle-paths")
    subroots = above.groupBy("tree").agg(F.first("top").alias("node"))
    tops = settle(numbered(subroots.withColumn("all", F.lit("")), "all", ["tree"], "merkle-trees"), "merkle-tops")
    over = _paths(tops.select(F.col("all").alias("tree"), "pos", "n", "node"), height).select("pos", F.col("path").alias("top_path"), F.col("top").alias("root"))
    trees = tops.join(over, "pos").select("tree", F.col("pos").alias("tree_pos"), F.col("n").alias("n_trees"), "top_path", "root")
    outer = settle(above.join(trees, "tree").withColumnRenamed("pos", "block"), "merkle-outer")

    schema = "key string, tree string, pos long, n_leaves long, tree_pos long, n_trees long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"

    def finish(key: tuple, rows: pd.DataFrame, up: pd.DataFrame) -> pd.DataFrame:
        rows, out = rows.sort_values("pos"), up.iloc[0]
        n, nodes = int(rows["n"].iloc[0]), rows["node"].tolist()
        levels = levels_of(nodes, _own_height(n, height))
        proofs = [siblings(levels, k) + out["path"] + out["top_path"] for k in range(len(nodes))]
        seen = [s or x for s, x in zip(rows["seen"], nodes, strict=True)]
        folded = [folded_root(s, p, n, int(out["tree_pos"]), int(out["n_trees"]), proof) for s, p, proof in zip(seen, rows["pos"].tolist(), proofs, strict=True)]
        whole = {"key": rows["key"].to_numpy(), "tree": key[0], "pos": rows["pos"].to_numpy(), "n_leaves": n, "tree_pos": int(out["tree_pos"]), "n_trees": int(out["n_trees"]), "leaf": nodes, "subroot": out["top"], "root": out["root"], "proof": proofs, "folded_root": folded}
        return pd.DataFrame(whole | {"verified": [f == out["root"] for f in folded]})

    text_keys = leaves.withColumn("key", F.col("key").cast("string"))  # a null would turn a pandas column of integers into floats
    done = text_keys.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)
    value = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).cast(docs.schema[tree_col].dataType)
    names = ["leaf", "subroot", "root", "proof", "pos", "n_leaves", "tree_pos", "n_trees", "folded_root", "verified"]
    return done.select(F.col("key").cast(docs.schema[order_col].dataType).alias(order_col), value.alias(tree_col), *names)


def manifest(proofs: DataFrame, tree_col: str) -> DataFrame:
    """One row per tree: its value, place, number of leaves and subroot, and the dataset's root."""
    return proofs.groupBy("tree_pos").agg(*(F.first(c).alias(c) for c in (tree_col, "n_leaves", "subroot", "n_trees", "root")))


def changed_trees(old: DataFrame, new: DataFrame, tree_col: str) -> DataFrame:
    """Trees of two manifests that differ: added, removed or changed."""
    a, b = (m.select(F.col(f"`{tree_col}`").alias(f"{name}_tree"), F.col("subroot").alias(name)) for m, name in ((old, "was"), (new, "now")))
    both = a.join(b, F.col("was_tree").eqNullSafe(F.col("now_tree")), "full").where(~F.col("was").eqNullSafe(F.col("now")))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("was_tree", "now_tree").alias(tree_col), "was", "now", kind.alias("change"))
