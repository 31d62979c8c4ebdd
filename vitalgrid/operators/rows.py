"""Row order, lookups by name, and keyed replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """``df`` with a gapless index from 0 in the order of the scan.

    Counts per partition are summed up; nothing is sorted and no single task
    sees all rows. The counts are taken by a run of their own, so ``df`` must give
    the same partitions twice, as files do; a row that the counts don't know stops
    the job instead of getting a wrong number.
    """
    spark = df.sparkSession
    tagged = df.withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["p"], r["n"]) for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total, n))
        total += n
    base = F.broadcast(spark.createDataFrame(starts, "_p long, _start long, _many long"))
    known = F.coalesce(place < F.col("_many"), F.lit(False))
    index = F.when(known, F.col("_start") + place).otherwise(F.raise_error(F.lit("the table's partitions changed while its rows were numbered")).cast("long"))
    return tagged.join(base, part == F.col("_p"), "left").withColumn(name, index).drop("_at", "_p", "_start", "_many")


def by_upper_name(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns renamed by position, and the map from upper-case names to them; the last of equal names counts."""
    renamed = df.toDF(*(f"_c{k}" for k in range(len(df.columns))))
    return renamed, {c.upper(): f"_c{k}" for k, c in enumerate(df.columns)}


def first_present(names: dict[str, str], candidates: tuple[str, ...]) -> Column:
    """The first non-null of the candidate columns that exist; null if none does. An empty text is not null."""
    found = [F.col(names[c]) for c in candidates if c in names]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both tables, one per key: the one that comes last (new after old, later rows after earlier).

    ``order`` names a column of ``new`` that tells later rows from earlier ones; else the order of the scan does.
    """
    place = lambda df, own: df.withColumnRenamed(order, "_at") if own else df.withColumn("_at", F.monotonically_increasing_id())
    numbered = place(old, False).withColumn("_batch", F.lit(0)).unionByName(place(new, bool(order)).withColumn("_batch", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_batch"), F.desc("_at"))
    return numbered.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_batch", "_at", "_rank")


def reinject_columns(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """``processed`` with the columns that only ``raw`` has, row by row; unchanged if the row counts differ."""
    have = {c.upper() for c in processed.columns}
    missing = [c for c in raw.columns if c.upper() not in have]
    if not missing or raw.count() != processed.count():
        return processed
    left, right = with_row_index(processed, "_row"), with_row_index(raw.select(*missing), "_row")
    return left.join(right, "_row").select(*processed.columns, *missing)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) by falling count; null is a value of its own, rendered as ``None``; ties by value."""
    text = F.coalesce(F.col(column).cast("string"), F.lit("None"))
    return df.groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def distinct_with_null(column: str) -> Column:
    """Number of distinct values, null being one."""
    return F.count_distinct(F.col(column)) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))
