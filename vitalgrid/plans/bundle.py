"""Run bundle: eleven catalog tables, four JSON documents and two folders.

Catalog tables are keyed tables: an upsert rewrites the buckets that its rows
fall into, an append rewrites nothing, and a manifest file is the point of commit, so a failure leaves the
old version. Read them by ``Bundle.table``; ``export`` writes one as a plain Parquet folder.
Field data is written straight to its own path. All of it stands on the file system that Spark writes to.
"""

from __future__ import annotations

import json
import platform
from dataclasses import asdict
from importlib import metadata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.plans.contracts import METRICS, CompiledField, fresh_id, utc_now
from vitalgrid.plans.registries import Registries, sha256_json
from vitalgrid.plans.keyed_table import KeyedTable
from vitalgrid.schemas import BUNDLE_TABLES, schema_problems
from vitalgrid.sources.files import Files, file_hashes, join_path

DOCUMENTS = ("UserIntent", "RunConfig", "P_vector", "ReproducibilityManifest")
FOLDERS = ("fields", "artifacts")
KEYS = {"V_fields": ["field_id"], "E_DAG": ["edge_id"], "Q_tensor": ["field_id"]}
Q_SCHEMA_VERSION = "1.0"


class BundleError(ValueError):
    pass


def environment(spark: SparkSession) -> dict:
    """Versions that a run depends on; packages that aren't installed are null."""

    def version(package: str) -> str | None:
        try:
            return metadata.version(package)
        except metadata.PackageNotFoundError:
            return None

    return {"python": platform.python_version(), "platform": platform.platform(), "spark": spark.version, "packages": {p: version(p) for p in ("pyspark", "pyarrow", "pandas", "numpy")}}


def spaced_json(value) -> str:
    """JSON with sorted keys, as catalog columns hold it."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


class Bundle:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, str(folder), Files(spark)

    @classmethod
    def create(cls, spark: SparkSession, runs: str, registries: Registries, intent: dict | None = None, config: dict | None = None, inputs: tuple[str, ...] = ()) -> Bundle:
        """A new bundle with typed empty tables; the intent is kept as it is. The manifest has the hashes of ``inputs``."""
        run_id = fresh_id("run")
        out = cls(spark, join_path(runs, run_id))
        out.initialize()
        manifest = {"run_id": run_id, "created_at": utc_now(), "environment": environment(spark), "registries": registries.hashes(), "config_hash": sha256_json(config or {}), "files": [r.asDict() for p in inputs for r in file_hashes(spark, p).orderBy("path").collect()], "notes": []}
        for name, value in zip(DOCUMENTS, (intent or {}, config or {}, {}, manifest), strict=True):
            out.write_document(name, value)
        return out

    def initialize(self) -> None:
        for name in FOLDERS:
            self.files.make_folder(self.path(name))
        for name in BUNDLE_TABLES:
            self.keyed(name).create()

    def path(self, name: str) -> str:
        return join_path(self.folder, f"{name}.json" if name in DOCUMENTS else name if name in FOLDERS else f"{name}.parquet")

    def write_document(self, name: str, value) -> None:
        self.files.write_text(self.path(name), json.dumps(value, indent=2, ensure_ascii=False))

    def document(self, name: str):
        return json.loads(self.files.read_text(self.path(name)))

    def keyed(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, self.path(name), BUNDLE_TABLES[name], KEYS.get(name))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A catalog table, its newest version or the one named."""
        return self.keyed(name).read(version)

    def export(self, name: str, path: str) -> None:
        """The newest version as a plain Parquet folder."""
        self.table(name).write.mode("overwrite").parquet(path)

    def problems(self) -> list[str]:
        """Absent keys and tables of another shape."""
        keys = [*BUNDLE_TABLES, *DOCUMENTS, *FOLDERS]
        absent = {k for k in keys if not self.files.exists(self.path(k))}
        out = [f"{k} is missing" for k in keys if k in absent]
        for name, schema in BUNDLE_TABLES.items():
            if name not in absent:
                keyed = self.keyed(name)
                out += [f"{name}: {x}" for x in schema_problems(keyed.stored_schema(), schema)] if keyed.versions() else [f"{name} has no version"]
        return out

    def validate(self) -> None:
        if found := self.problems():
            raise BundleError("; ".join(found))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """One row per key: the new one replaces the old one."""
        self.keyed(name).merge(rows)

    def append(self, name: str, rows: DataFrame) -> None:
        self.keyed(name).append(rows)

    def write_field(self, compiled: CompiledField) -> str:
        """Data, then catalog row, edges, quality and warnings."""
        data = join_path(self.path("fields"), f"{compiled.field.id}.parquet")
        compiled.data.write.mode("overwrite").parquet(data)
        rows = encode_field(compiled, data)
        for name, values in rows.items():
            if values:
                df = self.spark.createDataFrame(values, BUNDLE_TABLES[name])
                self.append(name, df) if name == "Warnings" else self.upsert(name, df)
        return data

    def fields(self) -> DataFrame:
        """The catalog's listing."""
        return self.table("V_fields").select("field_id", "name", "kind", "carrier", "unit", "state", "dashboard_safe", "materialization_state", "path")

    def field(self, field_id: str) -> dict:
        """Exactly one field of that id."""
        return point_lookup(self.table("V_fields"), field_id)

    def read_field(self, field_id: str) -> DataFrame:
        path = self.field(field_id)["path"]
        if not path:
            raise BundleError(f"field {field_id} has no data")
        return self.spark.read.parquet(path)


def point_lookup(catalog: DataFrame, field_id: str) -> dict:
    found = catalog.where(F.col("field_id") == field_id).limit(2).collect()
    if len(found) != 1:
        raise BundleError(f"{'no' if not found else 'more than one'} field has the id {field_id}")
    return found[0].asDict()


def json_column(row: dict, name: str) -> dict:
    """A JSON column of a catalog row; blank is empty."""
    value = row.get(name)
    if value is None or (isinstance(value, str) and not value.strip()):
        return {}
    if not isinstance(value, str):
        raise BundleError(f"{name} is not text")
    return json.loads(value)


def edge_ids(parent: Column, child: Column, operator: Column, params_json: Column, versions_json: Column) -> Column:
    """``edge_id`` of every row of a table of edges; the last two are JSON texts with sorted keys and no blanks."""
    quoted = lambda c: F.to_json(F.array(c.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(c.cast("string")))) - 2)
    parts = (("child_field_id", quoted(child)), ("operator", quoted(operator)), ("operator_params", params_json), ("parent_field_id", quoted(parent)), ("registry_versions", versions_json))
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), v) for k, v in parts)), F.lit("}")), 256)


def edge_id(parent: str, child: str, operator: str, params: dict, versions: dict) -> str:
    """Depends on what the edge says, not on when it was written."""
    return sha256_json({"parent_field_id": parent, "child_field_id": child, "operator": operator, "operator_params": params, "registry_versions": versions})


def encode_field(compiled: CompiledField, path: str) -> dict[str, list[tuple]]:
    """Catalog rows of a field, in the tables' column order."""
    f, line, q = compiled.field, compiled.field.lineage, compiled.q_state
    field = (
        f.id, f.name, f.kind, f.carrier, f.unit, f.aggregation, f.role, f.source, spaced_json(f.support), spaced_json(f.axes), f.operator, f.provenance, f.state, str(f.dashboard_safe), f.warnings,
        line.stable_hash(), sha256_json(line.registry_versions), f.materialization_state, path,
    )
    edges = [(edge_id(p, f.id, line.operator_type, line.operator_params, line.registry_versions), p, f.id, line.operator_type, spaced_json(line.operator_params), spaced_json(line.registry_versions), utc_now()) for p in line.parent_ids]
    number = lambda x: None if x is None else float(x)
    quality = (q.field_id, *(number(q.metrics[m]) for m in METRICS), q.state, str(q.dashboard_safe), q.warnings, utc_now(), Q_SCHEMA_VERSION)
    order = [c.name for c in BUNDLE_TABLES["Warnings"]]
    warnings = [tuple(asdict(w)[c] for c in order) for w in compiled.warnings]
    return {"V_fields": [field], "E_DAG": edges, "Q_tensor": [quality], "Warnings": warnings}
