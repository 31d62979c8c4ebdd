"""Keyed tables: what a merge rewrites, what a crash leaves, and digests of files in pieces."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.plans import bundle
from vitalgrid.plans.keyed_table import ConflictError, KeyedTable
from vitalgrid.sources import files

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def rows(spark, values):
    return spark.createDataFrame(values, SCHEMA)


def state(t, version=None):
    return sorted(tuple(r) for r in t.read(version).collect())


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"]).create(buckets=8)
    assert t.read().collect() == [] and t.stored_schema() == SCHEMA
    t.merge(rows(spark, [(k, f"old {k}") for k in range(100)]))
    first = t.manifest()
    assert len(first["buckets"]) == 8
    t.merge(rows(spark, [(5, "a"), (5, "b"), (1000, "new")]).coalesce(1))
    second = t.manifest()
    changed = [b for b in first["buckets"] if first["buckets"][b] != second["buckets"][b]]
    assert 1 <= len(changed) <= 2
    assert state(t) == sorted([(k, f"old {k}") for k in range(100) if k != 5] + [(5, "b"), (1000, "new")])
    assert state(t, 1) == sorted((k, f"old {k}") for k in range(100))  # a pinned reader
    t.vacuum()
    assert t.versions() == [2] and len(state(t)) == 101


def test_append_keeps_files_and_uses_many_tasks(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA).create()
    t.append(spark.range(1000, numPartitions=4).select(F.col("id").alias("k")))
    t.append(rows(spark, [(7, "x"), (7, "x")]))
    assert t.read().count() == 1002 and t.manifest()["version"] == 2
    assert len([n for n in t.files.names(str(tmp_path / "t" / t.manifest()["loose"][0])) if n.endswith(".parquet")]) == 4


@pytest.mark.parametrize("step", ["data", "manifest", "rename"])
def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"]).create(buckets=2)
    t.merge(rows(spark, [(1, "old")]))

    def fail(*_, **__):
        raise OSError("lost")

    with monkeypatch.context() as m:
        if step == "data":
            m.setattr(KeyedTable, "_read", fail)
        else:
            m.setattr(files.Files, "write_text" if step == "manifest" else "rename", fail)
        with pytest.raises((OSError, ConflictError)):
            t.merge(rows(spark, [(1, "new"), (2, "new")]))
    assert state(t) == [(1, "old")]
    t.merge(rows(spark, [(2, "later")]))
    assert state(t) == [(1, "old"), (2, "later")]


def test_the_second_of_two_writers_fails(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"]).create(buckets=2)
    m = t.manifest()
    t.merge(rows(spark, [(1, "a")]))
    with pytest.raises(ConflictError):
        t._commit(m["version"] + 1, m)
    assert state(t) == [(1, "a")]


def test_the_plan_of_new_rows_runs_once(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"]).create(buckets=2)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    t.merge(rows(spark, [(k, "x") for k in range(50)]).mapInArrow(count, SCHEMA))
    assert seen.value == 50 and t.read().count() == 50


def test_catalog_tables_can_be_exported(spark, tmp_path):
    b = bundle.Bundle(spark, str(tmp_path / "run"))
    b.initialize()
    b.upsert("V_fields", spark.createDataFrame([("f", "one")], "field_id string, name string"))
    b.upsert("V_fields", spark.createDataFrame([("f", "two")], "field_id string, name string"))
    b.export("V_fields", str(tmp_path / "plain"))
    assert [r["name"] for r in spark.read.parquet(str(tmp_path / "plain")).collect()] == ["two"]
    assert [x for x in b.problems() if "parquet" in x or "V_fields" in x] == []


def test_edge_ids_are_those_of_single_edges(spark):
    edges = [('a"b', "c\\d", "RN"), ("é", "x/y", "o p"), ("1", "2", "RN")]
    df = spark.createDataFrame(edges, "p string, c string, o string")
    params, versions = {"scale": 1.5, "axes": ["a", "b"]}, {"r": "1"}
    compact = lambda v: F.lit(json.dumps(v, sort_keys=True, separators=(",", ":")))
    got = [r[0] for r in df.select(bundle.edge_ids(F.col("p"), F.col("c"), F.col("o"), compact(params), compact(versions))).collect()]
    assert got == [bundle.edge_id(p, c, o, params, versions) for p, c, o in edges]


def test_digest_in_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "d").mkdir()
    data = {"a.bin": bytes(range(256)) * 5000, "b.bin": b"", "c d.txt": "é\n".encode()}
    for name, x in data.items():
        (tmp_path / "d" / name).write_bytes(x)
    want = {(len(x), hashlib.sha256(x).hexdigest()) for x in data.values()}
    for chunk in (1000, files.CHUNK):
        assert {(r["bytes"], r["sha256"]) for r in files.file_hashes(spark, str(tmp_path / "d"), chunk).collect()} == want
    monkeypatch.setattr(files, "_STREAMED", ())  # a store that only the JVM opens
    assert {r["sha256"] for r in files.file_hashes(spark, str(tmp_path / "d")).collect()} == {x for _, x in want}
    with (tmp_path / "large").open("wb") as f:
        f.truncate(2_200_000_000)  # sparse: more than a row can hold
    assert files.file_hash(spark, str(tmp_path / "large")) == files.stream_digest(f"file:{tmp_path}/large", 1 << 24)
