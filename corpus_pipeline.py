"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything that its
predecessor kept; its result is written as Parquet and read again as the next
stage's documents. The first four return the columns of ``documents``, the last
writes the packed sequences and returns the pieces read from them. Models are
fitted on the labelled rows among the documents that a stage is given; the
toxicity model leaves out the rows whose crc32(doc_id as text) modulo 3 is 1, so
what it says about these is said about unseen rows.

Null, empty and blank texts have fewer than 50 words, so the quality rules reject
them; the later stages would keep them. Texts of any length run whole. Rows that
are equal or nearly so are ties: the join keeps the one with the smallest id, of
repeated rows one. Columns named like those that a stage adds keep their own
values. Without documents, labels or test items a stage keeps what it is given, and an empty
table packs into nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import decontaminate, jaccard_join, quality, toxicity
from vitalgrid.llm.common import settle, table
from vitalgrid.llm.queries import packed_documents


def _judged(docs: DataFrame, added: list, judge) -> DataFrame:
    """What ``judge`` keeps of ``docs``, with the columns of ``docs``; those named like the ``added`` ones are out of its way meanwhile."""
    names = {f.name.lower() for f in added}
    away = {c: f"_own_{k}" for k, c in enumerate(docs.columns) if c.lower() in names}
    kept = judge(docs.withColumnsRenamed(away) if away else docs)
    return kept.select(*(F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep."""
    model = quality.fit_quality(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _judged(docs, quality.FIELDS, lambda d: quality.apply_quality(d, model).where("kept"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    seen = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = toxicity.fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), where=seen)
    return _judged(docs, toxicity.FIELDS, lambda d: toxicity.apply_toxicity(d, model).where(F.col("predicted") == 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the Jaccard join."""
    return jaccard_join.one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of the documents' ids, written to the shared folder; the pieces as read back from them."""
    return packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("best-fit packing", packed_sequences),
]

#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, f"stage{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
