"""Sharding along a Hilbert curve.

Several metadata columns are each quantised to a few bits, the bits are turned
into a position on a Hilbert curve, and the rows, sorted by that position, are
cut into runs. Rows close in all columns at once share a shard, so the
minimum and maximum of each column prune whole shards.

Quantisation is by quantiles over all rows; those of strings come from the
running counts of their sorted whole values. Nulls take level 0. Ties on the
curve are ordered by the tie columns, so a hot value spreads over several sort
partitions. Repeated rows each get their own place. Columns named like the
added ones are replaced, but still read where they are named as a dimension,
a size or a tie. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.llm.common import settle

#: Levels of a dimension are 2 to this power.
BITS = 5
#: Bytes of a sort partition, counted over the strings and 16 bytes for each other column of a row.
PART_BYTES = 256 << 20
ADDED = ("curve", "shard", "slot")


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of ``coords`` (n, dims), by Skilling's transform."""
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _string_cuts(df: DataFrame, d: str, bits: int) -> list[str]:
    """The quantiles of a string column, from the running counts of its sorted values."""
    counted = df.select(F.col(f"`{d}`").alias("_v")).where("_v is not null").groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    ordered = settle(counted.repartitionByRange("_v").sortWithinPartitions("_v").withColumn("_p", F.spark_partition_id()), "values")
    parts = ordered.groupBy("_p").agg(F.sum("_c").alias("c"), F.min("_v").alias("v")).orderBy("v").collect()  # one row per sort partition
    total, before, starts = sum(p["c"] for p in parts), 0, []
    for p in parts:
        starts.append((p["_p"], before))
        before += p["c"]
    base = F.broadcast(df.sparkSession.createDataFrame(starts, "_p int, _s long"))
    running = F.col("_s") + F.sum("_c").over(Window.partitionBy("_p").orderBy("_v"))
    level = lambda n: F.least(F.floor(n * F.lit(1 << bits) / F.lit(max(total, 1))), F.lit((1 << bits) - 1))
    at = ordered.join(base, "_p").withColumn("_r", running).where(level(F.col("_r")) > level(F.col("_r") - F.col("_c")))
    return sorted((r["_v"] for r in at.select("_v").collect()), key=str.encode)  # at most a row for each level


def _levels(df: DataFrame, dims: list[str], bits: int) -> list[Column]:
    """A column of 0 .. 2**bits-1 for each dimension, from quantiles over all rows."""
    kinds = {f.name: f.dataType for f in df.schema}
    strings = [d for d in dims if isinstance(kinds[d], T.StringType)]
    value = {d: F.col(f"`{d}`") if d in strings else F.col(f"`{d}`").cast("double") for d in dims}
    share = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [d for d in dims if d not in strings]
    cuts = {}
    if numbers:
        got = df.agg(*(F.percentile_approx(value[d], F.array(*map(F.lit, share)), F.lit(10_000)).alias(f"c{k}") for k, d in enumerate(numbers))).first()
        cuts = {d: sorted(set(got[f"c{k}"] or [])) for k, d in enumerate(numbers)}
    out = []
    for d in dims:
        level = F.lit(0)
        for b in _string_cuts(df, d, bits) if d in strings else cuts[d]:
            level = level + F.when(value[d] > F.lit(b), 1).otherwise(0)
        out.append(level)
    return out


@F.pandas_udf(T.LongType())
def _curve(coords: pd.Series, bits: pd.Series) -> pd.Series:
    if not len(coords):
        return pd.Series([], dtype="int64")
    return pd.Series(hilbert_index(np.array(coords.tolist()), int(bits.iloc[0])))


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int, law: str = "rows", size_col: str | None = None, tie_cols: tuple[str, ...] = (), bits: int = BITS) -> DataFrame:
    """``df`` with ``curve`` (long), ``shard`` (int) and ``slot`` (long, gapless from 0 in its shard).

    ``law``: ``rows`` makes counts differ by one at most; ``bytes`` cuts where the
    running sum of ``size_col`` passes each multiple of the mean.
    """
    if law not in ("rows", "bytes") or (law == "bytes" and not size_col):
        raise ValueError("law is rows, or bytes with a size_col")
    if bits * len(dims) > 62:
        raise ValueError("more than 62 bits on the curve")
    spark = df.sparkSession
    levels = _levels(df, dims, bits)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")
    ties = [F.col(f"`{c}`").alias(f"_t{k}") for k, c in enumerate(tie_cols)]
    weight = F.coalesce(F.col(f"`{size_col}`").cast("long"), F.lit(0)) if law == "bytes" else F.lit(1).cast("long")
    keyed = df.select(row, _curve(F.array(*levels), F.lit(bits)).alias("_curve"), *ties, weight.alias("_w"))
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wide = F.coalesce(sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in text), F.lit(16 * len(df.columns))).cast("long"), F.lit(0))
    total_bytes = df.agg(F.sum(wide)).first()[0] or 0
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // PART_BYTES))
    order = ["_curve", *(f"_t{k}" for k in range(len(tie_cols)))]
    ranged = keyed.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    at = F.col("_at")
    ordered = settle(ranged.withColumn("_at", F.monotonically_increasing_id()), "curve").withColumns({"_part": F.shiftright(at, 33), "_pos": at.bitwiseAND(F.lit((1 << 33) - 1))}).drop("_at")
    # one row per sort partition, as many as the shuffle has partitions
    parts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w")).orderBy("_part").collect()
    rows, total = sum(p["n"] for p in parts), sum(p["w"] or 0 for p in parts)
    before_n, before_w, starts = 0, 0, []
    for p in parts:
        starts.append((p["_part"], before_n, before_w))
        before_n, before_w = before_n + p["n"], before_w + (p["w"] or 0)
    base = F.broadcast(spark.createDataFrame(starts, "_part long, _n0 long, _w0 long"))
    placed = ordered.join(base, "_part").withColumn("_rank", F.col("_n0") + F.col("_pos"))
    if law == "rows":
        # shard k holds ranks ceil(k * rows / n) to ceil((k + 1) * rows / n) - 1
        cut = placed.withColumn("_shard", F.expr(f"cast(_rank * {n_shards}L div {max(rows, 1)}L as long)"))
        slot = F.col("_rank") - F.expr(f"cast(({rows}L * _shard + {n_shards - 1}L) div {n_shards}L as long)")
    else:
        # cut by the running sum of sizes; windows run within one sort partition each
        running = F.col("_w0") + F.sum("_w").over(Window.partitionBy("_part").orderBy("_pos"))
        shard = F.least(F.lit(n_shards - 1), F.floor((running.cast("double") - 1) * n_shards / F.lit(float(max(total, 1)))).cast("long"))
        cut = placed.withColumn("_shard", F.greatest(F.lit(0), shard))
        first = F.broadcast(cut.groupBy("_shard").agg(F.min("_rank").alias("_first")))  # n_shards rows
        cut, slot = cut.join(first, "_shard"), F.col("_rank") - F.col("_first")
    names = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c.lower() not in ADDED]
    return cut.select(*names, F.col("_curve").alias("curve"), F.col("_shard").cast("int").alias("shard"), slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder of Parquet files per shard, each in curve order; a large shard is several files."""
    n = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_bounds(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Rows, and smallest and largest value of each dimension, per shard: what pruning consults."""
    ends = [f(F.col(f"`{d}`")).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ends)
