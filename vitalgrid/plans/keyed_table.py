"""Tables with a key on plain files: buckets by key hash, and a manifest file per version as the point of commit.

    table/_versions/00000003.json    which folders hold each bucket's rows, and rows without a bucket
    table/data/<id>/b=<bucket>/      Parquet files, never changed once a manifest names them

A merge rewrites only the buckets that new rows fall into; an append adds a
folder and rewrites nothing. Both write their files first and the manifest last, under a name
of its own that is then renamed to the next number: a crash before that leaves the
old version, after it the new one, and of two writers at a time the second one's
rename fails. Readers take the newest version or one that they name; files that no kept
version names are removed by ``vacuum``.

A few thousand rows, or thousands of millions: the number of buckets is chosen when a table is
made, and a bucket is one task's rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.operators.rows import keep_last
from vitalgrid.schemas import enforce_schema
from vitalgrid.sources.files import Files, join_path

BUCKETS = 16
_BUCKET = "b"


class ConflictError(RuntimeError):
    """Another writer has committed in between."""


class KeyedTable:
    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: list[str] | None = None):
        self.spark, self.folder, self.schema, self.keys, self.files = spark, str(folder), schema, keys or [], Files(spark)

    def create(self, buckets: int = BUCKETS) -> KeyedTable:
        """An empty first version, unless there is one."""
        if not self.versions():
            self.files.make_folder(join_path(self.folder, "data"))
            self._commit(0, {"n_buckets": buckets, "schema": self.schema.json(), "keys": self.keys, "buckets": {}, "loose": []})
        return self

    def versions(self) -> list[int]:
        """Versions that are there, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(join_path(self.folder, "_versions")) if n.endswith(".json") and n[:1].isdigit())

    def _manifest_path(self, version: int) -> str:
        return join_path(self.folder, "_versions", f"{version:08d}.json")

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            found = self.versions()
            if not found:
                raise FileNotFoundError(self.folder)
            version = found[-1]
        return json.loads(self.files.read_text(self._manifest_path(version))) | {"version": version}

    def _commit(self, version: int, manifest: dict) -> None:
        body = {k: v for k, v in manifest.items() if k != "version"}
        path, draft = self._manifest_path(version), join_path(self.folder, "_versions", f".draft-{uuid.uuid4().hex}")
        self.files.make_folder(join_path(self.folder, "_versions"))
        self.files.write_text(draft, json.dumps(body, sort_keys=True))
        try:
            if self.files.exists(path):
                raise ConflictError(path)
            self.files.rename(draft, path)
        except OSError as e:
            raise ConflictError(path) from e
        finally:
            self.files.remove(draft)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(join_path(self.folder, f) for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; files of later ones don't change it."""
        m = self.manifest(version)
        return self._read([*m["buckets"].values(), *m["loose"]])

    def stored_schema(self) -> T.StructType:
        """What the files themselves say; the manifest's schema if there are none."""
        m = self.manifest()
        folders = [*m["buckets"].values(), *m["loose"]]
        return self.spark.read.parquet(*(join_path(self.folder, f) for f in folders)).schema if folders else T.StructType.fromJson(json.loads(m["schema"]))

    def append(self, rows: DataFrame) -> int:
        """Add rows as they are; the new version."""
        m, folder = self.manifest(), f"data/{uuid.uuid4().hex}"
        enforce_schema(rows, self.schema).write.parquet(join_path(self.folder, folder))
        self._commit(m["version"] + 1, m | {"loose": [*m["loose"], folder]})
        return m["version"] + 1

    def merge(self, rows: DataFrame, marks: dict | None = None) -> int:
        """One row per key: the new one replaces the old one, a later new one an earlier one. Returns the new version.

        New rows are written once, by bucket, so that their plan runs once; then each touched bucket is merged.
        ``marks`` are kept in the same manifest, so what they say of the rows is true of every version.
        """
        m, new, merged = self.manifest(), *(f"data/{uuid.uuid4().hex}" for _ in range(2))
        bucket = F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(m["n_buckets"]))
        fresh = enforce_schema(rows, self.schema).withColumn("_at", F.monotonically_increasing_id()).withColumn(_BUCKET, bucket)
        fresh.write.partitionBy(_BUCKET).parquet(join_path(self.folder, new))
        touched = {n.removeprefix(f"{_BUCKET}=") for n in self.files.names(join_path(self.folder, new)) if n.startswith(f"{_BUCKET}=")}
        marks = {"marks": m.get("marks", {}) | (marks or {})}
        if not touched:
            self.files.remove(join_path(self.folder, new))
            if marks["marks"] == m.get("marks", {}):
                return m["version"]
            self._commit(m["version"] + 1, m | marks)
            return m["version"] + 1
        staged = self.spark.read.schema(T.StructType([*self.schema, T.StructField("_at", T.LongType())])).parquet(*(join_path(self.folder, new, f"{_BUCKET}={k}") for k in sorted(touched)))
        both = keep_last(self._read([f for k, f in m["buckets"].items() if k in touched]), staged, self.keys, "_at").withColumn(_BUCKET, bucket)
        both.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(join_path(self.folder, merged))
        self._commit(m["version"] + 1, m | marks | {"buckets": m["buckets"] | {k: f"{merged}/{_BUCKET}={k}" for k in touched}})
        self.files.remove(join_path(self.folder, new))
        return m["version"] + 1

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` versions, and data that none of these names. Not beside a writer."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            self.files.remove(self._manifest_path(v))
        named = {f.split("/")[1] for v in versions[-keep:] for m in [self.manifest(v)] for f in [*m["buckets"].values(), *m["loose"]]}
        for name in self.files.names(join_path(self.folder, "data")):
            if name not in named:
                self.files.remove(join_path(self.folder, "data", name))
