"""Table reading and shared scratch tables for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: list[str] = []

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the setting is absent and all runs on this machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="scratch-"))
    return "file://" + _LOCAL[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; ``codec`` compresses it.

    Cuts the lineage: what follows survives the loss of any executor, and
    expensive or order-dependent columns are computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, text_col: str, part_bytes: int) -> int:
    """Partitions of about ``part_bytes`` of a column's bytes each, at least as many as a shuffle has; one pass over its lengths."""
    total = df.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long"))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)
