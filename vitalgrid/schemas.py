"""Table contracts. Column names, types and order are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(), "a": T.ArrayType(T.StringType())}


def _schema(text: str) -> T.StructType:
    """From words ``name`` or ``name:kind`` (s string, l long, i int, d double, b boolean, a list of strings)."""
    pairs = (w.partition(":") for w in text.split())
    return T.StructType([T.StructField(name, _KINDS[kind or "s"]) for name, _, kind in pairs])


NORMALIZED_EVENTS = _schema("""
    event_id source_system source_manifest_hash row_number:l
    death_date death_date_state birth_date birth_date_state
    raw_age age_years:d age_days:d age_state age_source
    sex sex_state
    race_color_admin race_color_state race_axis_type race_missingness_state
    mun_residence_cod6 mun_residence_cod7 mun_residence_state
    mun_occurrence_cod6 mun_occurrence_cod7 mun_occurrence_state
    facility_code facility_code_state
    underlying_icd_raw underlying_icd_norm underlying_icd_parse_state underlying_icd_warnings:a
    cause_chain_raw:a cause_chain_norm:a cause_chain_parse_states:a cause_chain_warnings:a
    reporting_delay:d reporting_delay_state investigation_status investigation_status_state
    cause_altered cause_altered_state medical_assistance medical_assistance_state
    death_during_pregnancy death_during_pregnancy_state
    death_during_puerperium death_during_puerperium_state
    death_type death_type_state gestational_weeks_death:d gestational_weeks_death_state
    raw_record_hash processed_record_hash normalization_warnings:a
""")

FACTS = _schema("""
    table_id variable_id variable_name unit period locality_id locality_name
    locality_level_id locality_level_name classification_tuple_json dimension_tuple_json
    value_raw value:d value_state
""")

DENOMINATOR = _schema("""
    year:i municipality_cod7 municipality_cod6 population:d population_state
    denominator_source provenance sidra_measure_id municipality_name
""")

BUNDLE_TABLES = {
    "V_fields": _schema("""
        field_id name kind carrier unit aggregation role:a source:a support_json axes_json operator
        provenance:a state dashboard_safe warnings:a lineage_hash registry_hash materialization_state path
    """),
    "E_DAG": _schema("edge_id parent_field_id child_field_id operator operator_params_json registry_versions_json created_at"),
    "Q_tensor": _schema("""
        field_id n_events:d n_denom:d n_eff:d cov_S:d cov_T:d missingness:d zero_inflation:d denom_fragility:d
        cv:d moran_i:d temporal_roughness:d spatial_entropy:d provenance_risk:d race_bridge_cv:d
        sensitivity_width:d state dashboard_safe warnings:a computed_at q_schema_version
    """),
    "Warnings": _schema("warning_id field_id source severity code message parent_warning_ids:a created_at"),
    "ModelAssociations": _schema("model_id outcome_field_id family status covariate_field_ids:a offset_field_id diagnostics_json warnings:a"),
    "ResidualAssociations": _schema("residual_field_id parent_model_id outcome_field_id residual_type support_json provenance:a state warnings:a"),
    "Hypotheses": _schema("""
        hypothesis_id outcome_field_id covariate_field_id residual_field_id statistic:d p_value:d q_value:d
        hsic_mode null_strategy fdr_method n_eff:d state warnings:a approximation_diagnostics_json
    """),
    "VariableDictionary": _schema("""
        field_id display_name technical_name definition estimand_label source_systems:a carrier unit
        support_description axis_description provenance_description state dashboard_safe interpretation_warning
    """),
    "FailedBranches": _schema("failed_branch_id attempted_operator parent_field_ids:a reason_code delta_result_json recoverable:b suggested_route"),
    "QuarantinedFields": _schema("field_id state reason_code warnings:a"),
    "ForcedFields": _schema("field_id force_selector state warnings:a"),
}


def lenient_cast(c: Column, kind: T.DataType) -> Column:
    """A cast that gives null instead of failing."""
    return c.try_cast(kind) if isinstance(kind, T.AtomicType) else c.cast(kind)


def enforce_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the contract's columns, in order: missing ones typed null, extra ones dropped, casts lenient."""
    if [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]:
        return df
    present = {c.lower(): c for c in df.columns}

    def column(f: T.StructField) -> Column:
        name = present.get(f.name.lower())
        if name is None:
            return F.lit(None).cast(f.dataType).alias(f.name)
        own = F.col(f"`{name}`")
        return (own if df.schema[name].dataType == f.dataType else lenient_cast(own, f.dataType)).alias(f.name)

    return df.select([column(f) for f in schema])


def schema_problems(actual: T.StructType, contract: T.StructType) -> list[str]:
    """Missing columns and other types; columns beyond the contract are fine."""
    have = {f.name: f.dataType for f in actual}
    out = [f"missing column: {f.name}" for f in contract if f.name not in have]
    return out + [f"{f.name}: {have[f.name].simpleString()} instead of {f.dataType.simpleString()}" for f in contract if f.name in have and have[f.name] != f.dataType]


def require(df: DataFrame, names: set[str], what: str) -> None:
    missing = sorted(names - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks required columns: {missing}")
