"""Registries: which rates are legal, which axes meet, what a state permits.

The built-in entries are fixed values. ``load_registries`` reads a folder of
YAML or JSON files in their place; ``*_table`` functions give them as
DataFrames for batch checks.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class RegistryError(ValueError):
    """A registry is missing or contradicts itself."""


#: Numerator carrier, denominator carrier, role.
CARRIER_RULES = (
    ("Deaths", "Population", "mortality_rate"),
    ("HospitalAdmissions", "Population", "hospitalization_rate"),
    ("LiveBirths", "Population", "birth_rate"),
    ("BirthsToWomen", "Women15_49", "fertility_rate"),
    ("InfantDeaths", "LiveBirths", "infant_mortality"),
    ("NeonatalDeaths", "LiveBirths", "neonatal_mortality"),
    ("PostNeonatalDeaths", "LiveBirths", "postneonatal_mortality"),
    ("MaternalDeaths", "LiveBirths", "maternal_mortality"),
    ("HospitalDeaths", "HospitalAdmissions", "inpatient_mortality"),
    ("ICUAdmissions", "HospitalAdmissions", "icu_use_share"),
    ("Beds", "Population", "capacity_density"),
    ("Facilities", "Population", "facility_density"),
    ("Physicians", "Population", "workforce_density"),
)
#: Numerator unit, denominator unit, output unit, roles.
UNIT_RULES = (
    ("counts", "person_years", "rate", ("mortality_rate", "hospitalization_rate", "birth_rate", "fertility_rate")),
    ("counts", "counts", "proportion", ("infant_mortality", "neonatal_mortality", "postneonatal_mortality", "maternal_mortality", "inpatient_mortality", "icu_use_share", "birth_outcome_share", "delivery_share", "anomaly_prevalence")),
    ("currency_real", "counts", "mean_cost", ("mean_cost",)),
    ("days", "counts", "mean_duration", ("mean_LOS",)),
    ("grams", "counts", "mean_weight", ("mean_birth_weight",)),
    ("beds", "person_years", "capacity_density", ("capacity_density",)),
    ("facilities", "person_years", "facility_density", ("facility_density",)),
    ("physicians", "person_years", "workforce_density", ("workforce_density",)),
    ("domiciles", "domiciles", "coverage", ("sanitation_coverage", "household_coverage")),
)
#: Source system, race axis, usable as a denominator, bridge to the self-declared axis.
RACE_AXES = (
    ("IBGE", "self_declared", True, None),
    ("SIM-DO", "administrative_death_declaration", False, "Bridge_R"),
    ("SIH-RD", "billing_record", False, "Bridge_R"),
    ("SINASC", "administrative_mixed", False, "Bridge_R"),
)
#: What each state permits.
PERMISSIONS = ("model_outcome", "model_covariate", "generate_rn", "icd_descend", "dashboard_safe", "hsic_scan")
QUALITY = {
    "verified": (True, True, True, True, True, True),
    "fragile": (True, True, False, True, "warning", True),
    "forced_fragile": (True, True, False, False, False, False),
    "quarantined_descriptive": (False, True, False, False, False, False),
    "quarantined_nochildren": (False, False, False, False, False, False),
    "illegal_excluded": (False, False, False, False, False, False),
    "blocked_solver_pending": (False, False, False, False, False, False),
}
#: Aggregation kind, may be summed up, how rates are handled.
AGGREGATIONS = (
    ("additive", True, "requires_numerator_denominator"),
    ("weighted_mean", True, "requires_weight"),
    ("statistical_functional", False, "non_aggregable_without_distributional_model"),
    ("compositional", True, "requires_compositional_operator"),
    ("non_aggregable", False, "forbidden"),
)
#: Risk of a provenance label; others count 0.4.
PROVENANCE_RISK = {
    "official": 0.0,
    "harmonized": 0.2,
    "deflated": 0.2,
    "AMC_contracted": 0.2,
    "imported_fixture": 0.2,
    "reconstructed": 0.4,
    "geneallocated": 0.4,
    "SIM_informed_denominator_prior": 0.5,
    "latent": 0.8,
    "synthetic": 1.0,
}
OTHER_RISK = 0.4
#: Raw columns that the death system's source registry must list.
FIRST_FIELDS = ("DTOBITO", "IDADE", "SEXO", "RACACOR", "CODMUNRES", "CAUSABAS")
SYSTEM_ALIASES = {"SIM": "SIM-DO", "DO": "SIM-DO", "SIM-DO": "SIM-DO", "SINASC": "SINASC", "SIH": "SIH-RD", "SIH-RD": "SIH-RD", "CNES": "CNES-ST", "CNES-ST": "CNES-ST"}


@dataclass(frozen=True)
class Registries:
    carriers: tuple = CARRIER_RULES
    units: tuple = UNIT_RULES
    race_axes: tuple = RACE_AXES
    quality: dict = field(default_factory=lambda: dict(QUALITY))
    aggregations: tuple = AGGREGATIONS
    source_fields: tuple = FIRST_FIELDS
    provenance_labels: tuple = tuple(PROVENANCE_RISK)
    provenance_rules: tuple = ()
    #: Hashes of the files that entries came from.
    file_hashes: dict = field(default_factory=dict)

    def carrier_legal(self, numerator: str, denominator: str, role: str) -> bool:
        return (numerator, denominator, role) in {tuple(c[:3]) for c in self.carriers}

    def unit_legal(self, numerator: str, denominator: str, role: str) -> bool:
        return any((n, d) == (numerator, denominator) and role in roles for n, d, _, roles in self.units)

    def race_axis(self, source: str | None) -> str | None:
        return next((axis for s, axis, _, _ in self.race_axes if s == source), None)

    def permissions(self, state: str) -> dict:
        return dict(zip(PERMISSIONS, self.quality[state], strict=True))

    def inherited(self, labels: set[str], numerator_sources: set[str] = frozenset(), role: str | None = None) -> tuple[list[str], bool | str]:
        """What rules say of a field made from parents with these labels: warnings in order, and the strictest ``dashboard_safe``."""
        warnings, safe = [], True
        for r in self.provenance_rules:
            if r.label not in labels or (r.numerator_source and not any(s == r.numerator_source or s.startswith(f"{r.numerator_source}-") for s in numerator_sources)) or (r.blocked_role and r.blocked_role != role):
                continue
            warnings.append(r.warning)
            safe = False if False in (safe, r.dashboard_safe) else "warning" if "warning" in (safe, r.dashboard_safe) else True
        return warnings, safe

    def hashes(self) -> dict[str, str]:
        """SHA-256 of each registry's file, of built-in entries that of their canonical JSON."""
        return {k: sha256_json(v) for k, v in (("aggregation_registry", self.aggregations), ("carrier_registry", self.carriers), ("quality_permissions", self.quality), ("race_axis_registry", self.race_axes), ("source_fields", self.source_fields), ("unit_registry", self.units))} | self.file_hashes


def sha256_json(value) -> str:
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def read_settings(path: str | Path):
    """A YAML or JSON file; a byte-order mark is skipped."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if Path(path).suffix.lower() == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RegistryError("YAML files need PyYAML; JSON files don't") from e
    return yaml.safe_load(text)


@dataclass(frozen=True)
class ProvenanceRule:
    """A warning that a field inherits from a parent with a label."""

    id: str
    label: str
    warning: str
    dashboard_safe: bool | str = True
    numerator_source: str | None = None
    blocked_role: str | None = None


def _provenance(path: Path) -> dict:
    """Labels and rules of a provenance registry's file."""
    data = read_settings(path)
    if not isinstance(data, dict) or not isinstance(data.get("primitive"), list):
        raise RegistryError(f"{path} must be a mapping with a list of primitive labels")
    labels = tuple(str(x) for x in data["primitive"])
    rules = tuple(ProvenanceRule(r["id"], r["if_any_parent"], r["child_warning"], r.get("dashboard_safe", True), r.get("with_numerator_source"), r.get("blocked_role")) for r in data.get("rules") or [])
    if unknown := sorted({r.label for r in rules} - set(labels)):
        raise RegistryError(f"{path} has rules for labels that it doesn't list: {unknown}")
    if len({r.id for r in rules}) < len(rules):
        raise RegistryError(f"{path} has duplicate ids of rules")
    return {"provenance_labels": labels, "provenance_rules": rules}


#: Registries by name.
NAMES = ("carrier_registry", "unit_registry", "race_axis_registry", "quality_permissions", "aggregation_registry", "source_fields")


def _sha256(path: Path) -> str:
    return hashlib.sha256(path.read_bytes()).hexdigest()


def registry_files(folder: str | Path) -> tuple[dict[str, Path], dict[str, str]]:
    """File of each registry in a folder, and hashes of the files.

    A ``registry_manifest`` names the files, and all that it names must be there;
    without one, files named like a registry are taken.
    """
    folder = Path(folder)
    suffixes = (".yaml", ".yml", ".json")
    manifest = next((p for x in suffixes if (p := folder / f"registry_manifest{x}").exists()), None)
    if manifest:
        listed = (read_settings(manifest) or {}).get("registries") or {}
        if nameless := sorted(name for name, item in listed.items() if not (isinstance(item, dict) and item.get("path"))):
            raise RegistryError(f"entries of the manifest without a path: {nameless}")
        files = {name: folder / item["path"] for name, item in listed.items()}
        if absent := sorted(str(p) for p in files.values() if not p.exists()):
            raise RegistryError(f"the manifest names files that are absent: {absent}")
    else:
        files = {name: p for name in (*NAMES, "provenance_registry") for x in suffixes if (p := folder / f"{name}{x}").exists()}
    hashes = {name: _sha256(p) for name, p in files.items()} | ({"registry_manifest": _sha256(manifest)} if manifest else {})
    return files, hashes


def load_registries(folder: str | Path) -> Registries:
    """Registries from a folder's files; those without a file keep the built-in entries. Their hashes are the files'."""
    files, hashes = registry_files(folder)
    found = {}
    for name, path in files.items():
        if name in NAMES:
            data = read_settings(path)
            if not isinstance(data, dict) or "entries" not in data:
                raise RegistryError(f"{path} must be a mapping with entries")
            found[name] = data["entries"]
    for name, entries in found.items():
        ids = [e["id"] for e in entries]
        twice = sorted({i for i in ids if ids.count(i) > 1})
        if twice:
            raise RegistryError(f"{name} has duplicate ids: {twice}")
    out = _provenance(files["provenance_registry"]) if "provenance_registry" in files else {}
    if "carrier_registry" in found:
        out["carriers"] = tuple((e["numerator_carrier"], e["denominator_carrier"], e["role"]) for e in found["carrier_registry"] if e.get("legal", True))
    if "unit_registry" in found:
        out["units"] = tuple((e["numerator_unit"], e["denominator_unit"], e["output_unit"], tuple(e["legal_roles"])) for e in found["unit_registry"])
    if "race_axis_registry" in found:
        out["race_axes"] = tuple((e["source_system"], e["race_axis"], e["denominator_compatible"], e.get("required_bridge_to_self_declared")) for e in found["race_axis_registry"])
    if "quality_permissions" in found:
        out["quality"] = {e["state"]: tuple(e["permissions"][p] for p in PERMISSIONS) for e in found["quality_permissions"]}
    if "aggregation_registry" in found:
        out["aggregations"] = tuple((e["aggregation"], e["allowed_pushforward"], e["rate_handling"]) for e in found["aggregation_registry"])
    if "source_fields" in found:
        out["source_fields"] = tuple(e["raw_field"] for e in found["source_fields"])
    return Registries(**out, file_hashes=hashes)


def validate(registries: Registries) -> None:
    """Raise RegistryError at the first contradiction."""
    if missing := sorted(set(FIRST_FIELDS) - set(registries.source_fields)):
        raise RegistryError(f"source fields lack: {missing}")
    unit_roles = {r for *_, roles in registries.units for r in roles}
    if missing := sorted({c[2] for c in registries.carriers} - unit_roles):
        raise RegistryError(f"carrier roles without a unit rule: {missing}")
    if missing := sorted(set(QUALITY) - set(registries.quality)):
        raise RegistryError(f"quality states missing: {missing}")
    axes = {s: (axis, usable, bridge) for s, axis, usable, bridge in registries.race_axes}
    if missing := sorted({a[0] for a in RACE_AXES} - set(axes)):
        raise RegistryError(f"race axes lack sources: {missing}")
    if axes["IBGE"][0] != "self_declared":
        raise RegistryError("the census axis must be self_declared")
    for source in ("SIM-DO", "SIH-RD", "SINASC"):
        if axes[source][1] or axes[source][2] != "Bridge_R":
            raise RegistryError(f"{source} must need Bridge_R and be no denominator by itself")


def carrier_table(spark: SparkSession, registries: Registries) -> DataFrame:
    return spark.createDataFrame([tuple(c[:3]) for c in registries.carriers], "numerator_carrier string, denominator_carrier string, role string")


def unit_table(spark: SparkSession, registries: Registries) -> DataFrame:
    """One row per legal role."""
    rows = [(n, d, role, out) for n, d, out, roles in registries.units for role in roles]
    return spark.createDataFrame(rows, "numerator_unit string, denominator_unit string, role string, output_unit string")


def race_axis_table(spark: SparkSession, registries: Registries) -> DataFrame:
    return spark.createDataFrame([a[:2] for a in registries.race_axes], "source_system string, race_axis string")
