"""Table readers by file kind. CSV columns are all text; nothing is inferred."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.sources.split_csv import quoted_ranges, read_records

#: No cell holds this, so only cells without any text are null; quoted empty ones stay ``""``.
_NO_TEXT = "\u0000"


def _delimited(spark: SparkSession, path: str, separator: str, all_text: bool, multi_line: bool) -> DataFrame:
    options = {"sep": separator, "quote": '"', "escape": '"'}
    if all_text:
        options |= {"inferSchema": "false", "emptyValue": "", "nullValue": _NO_TEXT}
    else:
        options |= {"inferSchema": "true", "samplingRatio": "1.0"}
    ranges = None if multi_line else quoted_ranges(spark, path, separator)
    if ranges is None or not all_text:
        return spark.read.options(header="true", multiLine=str(multi_line or ranges is not None), **options).csv(path)
    names = spark.read.options(header="true", multiLine="true", **options).csv(path).columns
    cells = F.from_csv("text", _ddl(names), options | {"multiLine": "true"})
    return read_records(spark, path, separator, ranges).select(cells.alias("r")).select("r.*")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def read_table(spark: SparkSession, path: str, all_text: bool = True, multi_line: bool = False) -> DataFrame:
    """A CSV, TSV or Parquet table, by its suffix in any case. Any path that Spark can read.

    An unquoted empty cell is null, a quoted one is an empty text. Files are
    split among tasks at line ends. A pass over the lines with quotes finds out
    first whether quoted cells hold line ends; then records are put together as
    ``split_csv`` describes (with inferred types: by one task per file).
    ``multi_line`` skips that pass and makes each file one task.
    """
    path = str(path)
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix == ".parquet":
        _must_exist(spark, path)
        return spark.read.parquet(path)
    if suffix == ".csv":
        _must_exist(spark, path)
        return _delimited(spark, path, ",", all_text, multi_line)
    if suffix in (".tsv", ".txt"):
        _must_exist(spark, path)
        return _delimited(spark, path, "\t", all_text, multi_line)
    raise ValueError(f"unknown kind of table: {path}")


def spread(df: DataFrame) -> DataFrame:
    """A table from fewer files than there are cores, dealt evenly: for costly work. Splits of a file don't tell where its rows are, as those of a row group are all in one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, df.rdd.getNumPartitions())) if len(df.inputFiles()) < cores else df


def _must_exist(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Overwrite ``path``; hive-like folders for ``partition_by``."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(str(path))
    return str(path)
