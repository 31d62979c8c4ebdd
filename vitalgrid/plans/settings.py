"""Typed settings from five files: project, paths, compute, the aggregates API, and the external ingest."""

from __future__ import annotations

from dataclasses import MISSING, asdict, dataclass, field, fields
from pathlib import Path

from vitalgrid.plans.registries import read_settings


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Project:
    name: str
    package_name: str
    version: str
    registry_version: str
    timezone: str
    default_locale: str


@dataclass(frozen=True)
class Paths:
    root: str
    data_root: str
    raw: str
    processed: str
    metadata: str
    cache: str
    manifests: str
    intermediate: str
    runs: str
    diagnostics: str
    config: str
    registries: str
    intents: str


@dataclass(frozen=True)
class Compute:
    """Which engine computes; accelerators are Spark's matter here, so their switches are read and not used."""

    data_backend: str
    numerical_backend: str
    rapids_enabled: bool = False
    cudf_enabled: bool = False
    polars_gpu_enabled: bool = False
    wsl_required: bool = False
    cuda: dict = field(default_factory=dict)


@dataclass(frozen=True)
class CubeApi:
    base_url: str
    max_cells_per_request: int = 49_900
    view_mode: str = "flat"
    concurrency: int = 16
    timeout_seconds: int = 60
    retry_status_codes: list = field(default_factory=lambda: [429, 500, 502, 503, 504])
    max_retries: int = 5
    backoff_initial_seconds: float = 0.25
    backoff_max_seconds: float = 10.0
    persist_raw_chunks: bool = True
    persist_normalized_facts: bool = True
    persist_full_tables_by_default: bool = False


@dataclass(frozen=True)
class Ingest:
    backend: str = "microdatasus"
    rscript_path: str = "Rscript"
    preserve_raw: bool = True
    preserve_processed: bool = True
    systems: list = field(default_factory=list)
    optional_ftp_discovery: bool = False
    r_timeout_seconds: int = 7200
    heartbeat_timeout_seconds: int = 900


#: File and section of each part.
PARTS = {"project": Project, "paths": Paths, "compute": Compute, "sidra": CubeApi, "datasus": Ingest}
_KINDS = {"str": str, "int": int, "bool": bool, "float": float, "list": list, "dict": dict}


def typed(kind: type, values: dict, where: str):
    """``values`` as ``kind``: required keys must be there, values must have or take the type, other keys are left out."""
    if not isinstance(values, dict):
        raise SettingsError(f"{where} must be a mapping")
    got = {}
    for f in fields(kind):
        if f.name not in values:
            if f.default is MISSING and f.default_factory is MISSING:
                raise SettingsError(f"{where} lacks {f.name}")
            continue
        value, wanted = values[f.name], _KINDS[f.type]
        if wanted in (int, float) and isinstance(value, str):
            try:
                value = wanted(value)
            except ValueError:
                pass
        if wanted is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if not isinstance(value, wanted) or (wanted is int and isinstance(value, bool)):
            raise SettingsError(f"{where}.{f.name} must be {f.type}, not {value!r}")
        got[f.name] = value
    return kind(**got)


def load_settings(folder: str | Path) -> dict:
    """All five parts as plain mappings, from YAML or JSON files named like the part; an absent file is an error."""
    out = {}
    for name, kind in PARTS.items():
        found = [p for suffix in (".yaml", ".yml", ".json") if (p := Path(folder) / f"{name}{suffix}").exists()]
        if not found:
            raise SettingsError(f"{name} has no file in {folder}")
        whole = read_settings(found[0]) or {}
        if not isinstance(whole, dict):
            raise SettingsError(f"{found[0]} must hold a mapping")
        out[name] = asdict(typed(kind, whole.get(name, {}), name))
    return out
