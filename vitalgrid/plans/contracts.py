"""Typed fields: a small table with its carrier, unit, axes, lineage and quality."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from vitalgrid.plans.registries import sha256_json


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def fresh_id(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


@dataclass(frozen=True)
class Lineage:
    """What a field was made from; its hash is the field's id, whatever the data."""

    operator_type: str
    operator_params: dict
    registry_versions: dict[str, str] = field(default_factory=dict)
    parent_ids: list[str] = field(default_factory=list)

    def stable_hash(self) -> str:
        return sha256_json(asdict(self))


@dataclass(frozen=True)
class FieldNode:
    name: str
    kind: str
    carrier: str
    unit: str
    support: dict
    axes: dict
    aggregation: str
    role: list[str]
    source: list[str]
    operator: str
    provenance: list[str]
    state: str
    dashboard_safe: bool | str
    lineage: Lineage
    warnings: list[str] = field(default_factory=list)
    materialization_state: str = "materialized"
    path: str | None = None

    @property
    def id(self) -> str:
        return self.lineage.stable_hash()


@dataclass(frozen=True)
class WarningRecord:
    source: str
    severity: str
    code: str
    message: str
    field_id: str | None = None
    parent_warning_ids: list[str] = field(default_factory=list)
    warning_id: str = field(default_factory=lambda: fresh_id("warning"))
    created_at: str = field(default_factory=utc_now)


#: Metrics of a quality state, in order; most are slots that no operator fills yet.
METRICS = ("n_events", "n_denom", "n_eff", "cov_S", "cov_T", "missingness", "zero_inflation", "denom_fragility", "cv", "moran_i", "temporal_roughness", "spatial_entropy", "provenance_risk", "race_bridge_cv", "sensitivity_width")


@dataclass(frozen=True)
class QState:
    field_id: str
    metrics: dict[str, float | None]
    state: str
    dashboard_safe: bool | str
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class CompiledField:
    """A field with its lazy data and its quality state."""

    field: FieldNode
    data: DataFrame
    q_state: QState
    warnings: list[WarningRecord]


def compiled(node: FieldNode, data: DataFrame, metrics: dict[str, float | None], warnings: list[WarningRecord]) -> CompiledField:
    q = QState(node.id, {m: metrics.get(m) for m in METRICS}, node.state, node.dashboard_safe, node.warnings)
    return CompiledField(node, data, q, [replace(w, field_id=node.id) for w in warnings])
