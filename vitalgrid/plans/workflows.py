"""Workflows: files in, typed fields in a run bundle out. Plans stay lazy until an artifact is written."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from vitalgrid.operators import cube, fields
from vitalgrid.operators.normalize import OPTIONAL_COLUMNS, REQUIRED_COLUMNS, SOURCE_SYSTEM, column_warnings, normalize_events
from vitalgrid.operators.profile import compare_profiles, profile_columns, row_count_warnings
from vitalgrid.plans.bundle import Bundle, json_column
from vitalgrid.plans.contracts import CompiledField, FieldNode, Lineage, QState
from vitalgrid.plans.registries import Registries, sha256_json, validate
from vitalgrid.sources.cube_client import CubeQuery, fetch_facts, write_payload
from vitalgrid.sources.files import Files, file_hash, join_path
from vitalgrid.sources.readers import read_table, write_parquet


@dataclass(frozen=True)
class Adapter:
    """What a source system brings: its normalizer, the columns it wants and where their records are kept."""

    system: str
    normalize: Callable[..., DataFrame]
    required: tuple[str, ...]
    optional: tuple[str, ...]
    hash_column: str = "raw_record_hash"

    def contract(self, columns: list[str]) -> dict:
        """Whether a table has the required columns, with warnings for both kinds."""
        have = {c.upper() for c in columns}
        missing = [c for c in self.required if c not in have]
        return {"system": self.system, "ok": not missing, "missing_required": missing, "missing_optional": [c for c in self.optional if c not in have], "warnings": column_warnings(columns)}


#: Adapters by source system.
ADAPTERS = {SOURCE_SYSTEM: Adapter(SOURCE_SYSTEM, normalize_events, REQUIRED_COLUMNS, OPTIONAL_COLUMNS)}


def adapter(system: str) -> Adapter:
    if system not in ADAPTERS:
        raise ValueError(f"no adapter for {system}; there are {sorted(ADAPTERS)}")
    return ADAPTERS[system]


def process_local(spark: SparkSession, raw_path: str, out_root: str, processed_path: str | None = None, system: str = SOURCE_SYSTEM, normalize_from: str = "raw") -> dict:
    """Profile the files, compare them, normalize one of them; returns the manifest.

    The workflow's id needs only hashes and paths, so it is known before the
    events are normalized, once, with it.
    """
    normalizer = adapter(system).normalize
    if normalize_from not in ("raw", "processed") or (normalize_from == "processed" and not processed_path):
        raise ValueError("normalize_from is raw, or processed with a processed_path")
    paths = {"raw": raw_path} | ({"processed": processed_path} if processed_path else {})
    files = {k: {"path": str(p), "sha256": file_hash(spark, p)} for k, p in paths.items()}
    workflow_id = sha256_json({"source_system": system, "files": files, "normalization_input_kind": normalize_from})
    tables = {k: read_table(spark, p) for k, p in paths.items()}
    profiles, artifacts = {}, {}
    for kind, df in tables.items():
        artifacts[f"{kind}_profile"] = write_parquet(profile_columns(df), join_path(out_root, f"{workflow_id}.{kind}_profile.parquet"))
        profiles[kind] = spark.read.parquet(artifacts[f"{kind}_profile"])
    warnings = column_warnings(tables[normalize_from].columns)
    if len(tables) == 2:
        artifacts["comparison"] = write_parquet(compare_profiles(profiles["raw"], profiles["processed"]), join_path(out_root, f"{workflow_id}.comparison.parquet"))
        warnings += row_count_warnings(*(profiles[k].agg({"n_rows": "max"}).first()[0] or 0 for k in ("raw", "processed")))
    artifacts["normalized"] = write_parquet(normalizer(tables[normalize_from], workflow_id), join_path(out_root, f"{workflow_id}.normalized.parquet"))
    manifest = {"workflow_id": workflow_id, "status": "ok", "source_system": system, "files": files, "artifacts": artifacts, "warnings": warnings}
    Files(spark).write_text(join_path(out_root, f"{workflow_id}.manifest.json"), json.dumps(manifest, ensure_ascii=False, indent=2))
    return manifest


def compile_bundle(spark: SparkSession, runs: str, intent: dict | None = None, config: dict | None = None, registries: Registries | None = None) -> Bundle:
    """An empty, valid bundle; the intent is kept, not interpreted."""
    registries = registries or Registries()
    validate(registries)
    bundle = Bundle.create(spark, runs, registries, intent, config)
    bundle.validate()
    return bundle


def compile_counts(bundle: Bundle, normalized: str | DataFrame, registries: Registries, geography: str = "residence") -> CompiledField:
    events = bundle.spark.read.parquet(normalized) if isinstance(normalized, str) else normalized
    out = fields.compile_event_counts(events, registries, geography)
    bundle.write_field(out)
    return out


def import_population(bundle: Bundle, population: str | DataFrame, registries: Registries, source_label: str = "imported_population_fixture") -> CompiledField:
    table = read_table(bundle.spark, population) if isinstance(population, str) else population
    out = fields.compile_population(table, registries, source_label)
    bundle.write_field(out)
    return out


def stored_field(bundle: Bundle, field_id: str) -> CompiledField:
    """A field of the catalog with its data; its lineage is known by its id alone."""
    row = bundle.field(field_id)
    node = _StoredNode(
        name=row["name"], kind=row["kind"], carrier=row["carrier"], unit=row["unit"], support=json_column(row, "support_json"), axes=json_column(row, "axes_json"), aggregation=row["aggregation"], role=row["role"], source=row["source"], operator=row["operator"],
        provenance=row["provenance"], state=row["state"], dashboard_safe=row["dashboard_safe"], lineage=Lineage(row["operator"], {}), warnings=row["warnings"], path=row["path"],
    )
    object.__setattr__(node, "_id", field_id)
    return CompiledField(node, bundle.read_field(field_id), QState(field_id, {}, row["state"], row["dashboard_safe"]), [])


class _StoredNode(FieldNode):
    @property
    def id(self) -> str:
        return self._id


def compile_rate(bundle: Bundle, counts_id: str, population_id: str, registries: Registries, scale: float = fields.SCALE) -> CompiledField:
    """Catalog rows and data of both parents, then the rate; the bundle stays valid."""
    out = fields.compile_crude_rate(stored_field(bundle, counts_id), stored_field(bundle, population_id), registries, scale)
    bundle.write_field(out)
    bundle.validate()
    return out


def mortality_run(spark: SparkSession, raw_path: str, population: str | DataFrame, out_root: str, intent: dict | None = None, processed_path: str | None = None, source_label: str = "imported_population_fixture", geography: str = "residence", registries: Registries | None = None) -> dict:
    """The whole way from local files to a rate, with a summary."""
    registries = registries or Registries()
    bundle = compile_bundle(spark, join_path(out_root, "runs"), intent, registries=registries)
    manifest = process_local(spark, raw_path, join_path(out_root, "processed"), processed_path)
    counts = compile_counts(bundle, manifest["artifacts"]["normalized"], registries, geography)
    people = import_population(bundle, population, registries, source_label)
    rate = compile_rate(bundle, counts.field.id, people.field.id, registries)
    return {
        "run_dir": str(bundle.folder), "workflow_id": manifest["workflow_id"], "death_count_field_id": counts.field.id, "population_field_id": people.field.id, "mortality_rate_field_id": rate.field.id,
        "n_fields": bundle.fields().count(), "n_edges": bundle.table("E_DAG").count(), "n_warnings": bundle.table("Warnings").count(), "rate_state": rate.field.state,
    }


def prepare_population(spark: SparkSession, spec: str | CubeQuery, cube_root: str, denominator_path: str, table_id: str | None = None, variable_id: str | None = None, source_label: str = "SIDRA_population", level_id: str | None = cube.MUNICIPALITY_LEVEL, **options) -> dict:
    """Cube query to facts to a denominator table with its report."""
    query = CubeQuery.load(spec) if isinstance(spec, str) else spec
    facts, manifest = fetch_facts(spark, query, cube_root, **options)
    denominator = cube.facts_to_denominator(facts, table_id, variable_id, source_label, level_id)
    write_parquet(denominator, denominator_path)
    report = cube.projection_report(facts, spark.read.parquet(denominator_path), table_id=table_id, variable_id=variable_id, level_id=level_id)
    write_payload(str(denominator_path).removesuffix(".parquet") + ".projection_report.json", report)
    return {"manifest": manifest, "report": report, "denominator": denominator_path}


def cube_mortality_run(spark: SparkSession, raw_path: str, spec: str | CubeQuery, out_root: str, source_label: str = "SIDRA_population", **options) -> dict:
    """A mortality run whose denominator comes from a fact cube."""
    prepared = prepare_population(spark, spec, join_path(out_root, "cube"), join_path(out_root, "denominator.parquet"), source_label=source_label, **options)
    return mortality_run(spark, raw_path, spark.read.parquet(prepared["denominator"]), out_root, source_label=source_label) | {"projection_report": prepared["report"]}
