"""Arrow batches in, the same rows with more columns out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Most rows and bytes of an Arrow batch; texts are long, so fewer than Spark's defaults. A longer row is a batch by itself.
BATCH_ROWS = 500
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session to these bounds; every operator here uses the same ones."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system; a worker waits for its next task beside those of other stages, with all that its allocators keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def giving_back(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, with freed memory returned at the end of each task."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def add_columns(df: DataFrame, text_col: str, fields: list[T.StructField], work: Callable[[], Callable[[list], list[list]]]) -> DataFrame:
    """``df`` with ``fields`` added; a column of the same name (in any case) is replaced.

    ``work()`` is called once per task and returns a function from a list of
    texts (None for null) to one list of values per field.
    """
    bound_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    base = df.select(*(df[f"`{c}`"] for c in kept)) if len(kept) < len(df.columns) else df
    position = kept.index(text_col)
    schema = T.StructType([*base.schema.fields, *fields])
    kinds = [f.type for f in to_arrow_schema(T.StructType(fields))]
    names = schema.names

    def run(batches):
        each = work()
        for batch in batches:
            values = each(batch.column(position).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=names)

    return base.mapInArrow(giving_back(run), schema)
