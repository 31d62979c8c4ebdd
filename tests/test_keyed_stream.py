"""A stream of events into a keyed table: repeats, late rows and batches that run again."""

from pyspark.sql import functions as F
from test_events_and_fields import RAW, raw_table

from vitalgrid.operators import fields, normalize
from vitalgrid.streaming import events as stream


def counts(df):
    return sorted(tuple(r) for r in fields.event_counts(df).collect())


def test_replayed_and_late_batches_leave_the_batch_counts(spark, tmp_path):
    raw = raw_table(spark).withColumn("row_key", F.monotonically_increasing_id())
    raw.coalesce(1).write.parquet(str(tmp_path / "all"))
    raw = spark.read.parquet(str(tmp_path / "all"))
    n, source = raw.count(), tmp_path / "source"
    want = normalize.normalize_events(raw, row_index="row_key")
    table = stream.event_table(spark, str(tmp_path / "events"))
    put = stream.merge_batches(table, "deaths")
    batches = [raw.limit(2), raw, raw.where("row_key >= 1")]  # each repeats rows of the one before
    for k, b in enumerate(batches):
        b.withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000 + 10_000 * k))).coalesce(1).write.parquet(f"{source}/part={k}")

    def run(checkpoint):
        files = spark.readStream.schema(spark.read.parquet(f"{source}/part=0").schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/part=*")
        both = stream.normalized_stream(files.drop("arrived"), "row_key")
        query = both.writeStream.foreachBatch(put).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination(120)

    run(tmp_path / "one")
    assert table.read().count() == n and counts(table.read()) == counts(want)
    version = table.manifest()["version"]
    assert table.manifest()["marks"] == {"deaths": 2}
    run(tmp_path / "two")  # the same batches again, as after a lost checkpoint
    assert table.manifest()["version"] == version and counts(table.read()) == counts(want)
    assert len(RAW) == n


def test_repeats_within_the_watermark_are_dropped(spark, tmp_path):
    rows = [("a", 0), ("a", 5), ("b", 6), ("a", 10)]
    spark.createDataFrame(rows, "event_id string, s long").select("event_id", F.timestamp_seconds("s").alias("arrived")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id string, arrived timestamp").parquet(str(tmp_path / "in"))
    query = stream.keyed_events(source, "arrived").writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.table("kept").collect()) == ["a", "b"]
