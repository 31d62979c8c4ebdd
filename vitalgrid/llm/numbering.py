"""Places of rows inside their groups, without one task or window per group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import settle


def sorted_parts(df: DataFrame, group: str, order: list[Column | str], name: str, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``df`` in order of ``group`` and ``order``, dealt into ranges and written, with ``part`` (the range) and ``at`` (place in it).

    ``then`` may add columns to the sorted ranges, row after row, before they are written.

    ``order`` should end in a column that tells rows apart: then a group of any
    size is spread over several ranges, so (group, part) is a key of bounded size.
    """
    cols = [F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in order)]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_id", F.monotonically_increasing_id())
    out = placed.withColumn("part", F.shiftright("_id", 33)).withColumn("at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")
    return settle(then(out), name)


def group_runs(placed: DataFrame, group: str, *extra: Column) -> DataFrame:
    """One row per group and range: ``first`` (place where it begins), ``n_run``, ``before`` (rows of the group in earlier ranges), ``n``.

    The window has at most as many rows per group as there are ranges.
    """
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n_run"), *extra)
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("*", F.coalesce(F.sum("n_run").over(earlier), F.lit(0)).cast("long").alias("before"), F.sum("n_run").over(whole).alias("n"))


def numbered(df: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """``df`` with ``pos`` (from 0 inside the group) and ``n`` (rows of the group). ``group`` must not be null."""
    placed = sorted_parts(df, group, order, name)
    joined = placed.join(group_runs(placed, group), [group, "part"])
    return joined.withColumn("pos", F.col("before") + F.col("at") - F.col("first")).drop("part", "at", "first", "n_run", "before")
