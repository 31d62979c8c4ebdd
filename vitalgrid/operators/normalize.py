"""Death events: raw all-string columns to the 54-column contract, in one projection."""

from __future__ import annotations

from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions import parsers as P
from vitalgrid.operators.rows import by_upper_name, first_present, with_row_index
from vitalgrid.schemas import NORMALIZED_EVENTS, enforce_schema

#: Names of the source system and its columns.
SOURCE_SYSTEM = "SIM-DO"
CAUSE_COLUMNS = ("LINHAA", "LINHAB", "LINHAC", "LINHAD", "LINHAII", "CAUSABAS_O")
REQUIRED_COLUMNS = ("DTOBITO", "IDADE", "SEXO", "RACACOR", "CODMUNRES", "CAUSABAS")
OPTIONAL_COLUMNS = ("DTNASC", "CODMUNOCOR", "CODESTAB", "DIFDATA", "TPPOS", "ALTCAUSA", "ASSISTMED", "GRAVIDEZ", "PUERPERIO", "TIPOBITO", "SEMAGESTAC", *CAUSE_COLUMNS)
SEX_VALUES, SEX_UNKNOWN = ("0", "1", "2", "9", "M", "F", "I"), ("0", "9", "I")
RACE_AXIS = "administrative_death_declaration"
CATEGORICAL = {
    "race_color_admin": (("RACACOR",), "race_color_state"),
    "facility_code": (("CODESTAB",), "facility_code_state"),
    "investigation_status": (("TPPOS",), "investigation_status_state"),
    "cause_altered": (("ALTCAUSA",), "cause_altered_state"),
    "medical_assistance": (("ASSISTMED",), "medical_assistance_state"),
    "death_during_pregnancy": (("GRAVIDEZ", "OBITOGRAV", "GESTACAO"), "death_during_pregnancy_state"),
    "death_during_puerperium": (("PUERPERIO", "OBITOPUER"), "death_during_puerperium_state"),
    "death_type": (("TIPOBITO", "TIPOBITO1"), "death_type_state"),
}
NUMERIC = {
    "reporting_delay": (("DIFDATA",), "reporting_delay_state"),
    "gestational_weeks_death": (("SEMAGESTAC", "SEMAGEST", "GESTACAO"), "gestational_weeks_death_state"),
}


def column_warnings(columns: list[str]) -> list[str]:
    """What the column contract has to say about a raw table; never an error."""
    have = {c.upper() for c in columns}
    out = []
    for kind, wanted in (("required", REQUIRED_COLUMNS), ("optional", OPTIONAL_COLUMNS)):
        missing = [c for c in wanted if c not in have]
        if missing:
            out.append(f"missing_{kind}_columns:" + ",".join(missing))
    return out


def canonical_json(columns: dict[str, Column]) -> Column:
    """Compact JSON object with sorted keys; nulls are written."""
    return F.to_json(F.struct(*(columns[k].alias(k) for k in sorted(columns))), {"ignoreNullFields": "false"})


def _after(prefix: str):
    return lambda w: F.concat(F.lit(prefix), w)


def cause_chain(texts: dict[str, Column], codes: dict[str, Column] | None = None) -> Column:
    """array<struct(raw, norm, state, warnings)> of the lines that hold something, from cleaned texts in order."""
    lines = []
    for name, t in texts.items():
        code = P.parse_icd10(t, cleaned=True, code=codes and codes[name])
        prefixed = F.transform(code["warnings"], _after(f"{name}:"))
        lines.append(F.struct(t.alias("raw"), code["normalized"].alias("norm"), code["state"].alias("state"), prefixed.alias("warnings")))
    return F.filter(F.array(*lines), lambda x: x["raw"].isNotNull() & (x["raw"] != ""))


def normalize_events(raw: DataFrame, manifest_hash: str = "", processed_hash_column: str | None = None, row_index: str | None = None) -> DataFrame:
    """The contract's columns for every row of ``raw``.

    Missing columns count as missing values. Column names are matched in any
    case; of equal names the last counts. ``row_index`` names a column that
    already holds the row number (as a streaming table must); else rows are
    numbered in scan order.
    """
    own = [c for c in raw.columns if c != row_index]
    numbered = raw if row_index else with_row_index(raw, "_row")
    index = row_index or "_row"
    table = numbered.select(*(F.col(f"`{c}`") for c in own), F.col(index).cast("long")) if len({c.upper() for c in own}) == len(own) else numbered
    renamed, names = by_upper_name(table)
    context = raw.sparkSession.sparkContext
    row_number, hashed = names.pop(index.upper()), (processed_hash_column or "").upper()
    texts = renamed.select(*_cell_columns(context, tuple(names.items()), tuple(own), row_number, names.get(hashed)))
    # projections in a row, so that a cleaned text or a parsed value is computed once and generated code stays small
    parsed = texts.withColumns(_read_columns(context)).select(*_parsed_columns(context)).withColumn("age", _age(context))
    return enforce_schema(parsed.select(*_contract_columns(context, manifest_hash)), NORMALIZED_EVENTS)


# Expressions depend on names alone. They are built once per context: there are some thousands, and building them takes longer than planning the job.

_CELLS = {"DTOBITO": ("DTOBITO",), "DTNASC": ("DTNASC",), "IDADE": ("IDADE",), "SEXO": ("SEXO",), "CODMUNRES": ("CODMUNRES",), "CODMUNOCOR": ("CODMUNOCOR",), "CAUSABAS": ("CAUSABAS",)}
_CELLS |= {c: (c,) for c in CAUSE_COLUMNS} | {out: candidates for out, (candidates, _) in (CATEGORICAL | NUMERIC).items()}


@lru_cache(maxsize=16)
def _cell_columns(context: SparkContext, names: tuple[tuple[str, str], ...], own: tuple[str, ...], row_number: str, processed: str | None) -> list[Column]:
    """Row number, hashes, two raw texts and the cleaned text ``t_...`` of every cell that is parsed."""
    at = dict(names)
    # by once: a fused method for all cells at once would be too large to be compiled
    raw_hash = P.once(canonical_json({c: F.col(at[c.upper()]).cast("string") for c in own}), lambda j: F.sha2(j, 256))
    given = F.coalesce(F.col(processed).cast("string"), F.lit("")) if processed else F.lit("")
    return [
        F.col(row_number).alias("row_number"), raw_hash.alias("raw_record_hash"), given.alias("processed_record_hash"),
        first_present(at, ("IDADE",)).cast("string").alias("raw_age"), first_present(at, ("CAUSABAS",)).cast("string").alias("underlying_icd_raw"),
        *(P.clean(first_present(at, candidates)).alias(f"t_{out}") for out, candidates in _CELLS.items()),
    ]


@lru_cache(maxsize=4)
def _read_columns(context: SparkContext) -> dict[str, Column]:
    """Dates ``d_...``, codes ``i_...`` and numbers ``n_...`` of the cleaned texts, and the decoded age."""
    read = {f"d_{c}": P.once(F.col(f"t_{c}"), P.text_to_date) for c in ("DTOBITO", "DTNASC")}
    read |= {f"i_{c}": P.icd_text(F.col(f"t_{c}")) for c in ("CAUSABAS", *CAUSE_COLUMNS)} | {f"n_{c}": P.comma_number(F.col(f"t_{c}")) for c in NUMERIC}
    return read | {"decoded": P.parse_age(F.col("t_IDADE"), cleaned=True)}


@lru_cache(maxsize=4)
def _parsed_columns(context: SparkContext) -> list[Column]:
    """A struct of value, state and warnings per field."""
    t = {out: F.col(f"t_{out}") for out in _CELLS}
    return [
        *(F.col(c) for c in ("row_number", "raw_record_hash", "processed_record_hash", "raw_age", "underlying_icd_raw", "decoded")),
        P.parse_date(t["DTOBITO"], cleaned=True, iso=F.col("d_DTOBITO")).alias("death"), P.parse_date(t["DTNASC"], cleaned=True, iso=F.col("d_DTNASC")).alias("birth"),
        P.parse_categorical(t["SEXO"], SEX_VALUES, SEX_UNKNOWN, cleaned=True).alias("sex"),
        P.parse_municipality(t["CODMUNRES"], cleaned=True).alias("residence"), P.parse_municipality(t["CODMUNOCOR"], cleaned=True).alias("occurrence"),
        P.parse_icd10(t["CAUSABAS"], cleaned=True, code=F.col("i_CAUSABAS")).alias("underlying"), cause_chain({c: t[c] for c in CAUSE_COLUMNS}, {c: F.col(f"i_{c}") for c in CAUSE_COLUMNS}).alias("chain"),
        *(P.parse_categorical(t[out], cleaned=True).alias(f"p_{out}") for out in CATEGORICAL), *(P.parse_numeric(t[out], cleaned=True, number=F.col(f"n_{out}")).alias(f"p_{out}") for out in NUMERIC),
    ]


@lru_cache(maxsize=4)
def _age(context: SparkContext) -> Column:
    return P.resolve_age(F.col("death.normalized"), F.col("birth.normalized"), F.col("decoded"))


@lru_cache(maxsize=16)
def _contract_columns(context: SparkContext, manifest_hash: str) -> list[Column]:
    event = canonical_json({"source_system": F.lit(SOURCE_SYSTEM), "source_manifest_hash": F.lit(manifest_hash), "row_number": F.col("row_number"), "raw_record_hash": F.col("raw_record_hash")})
    chain_warnings = F.flatten(F.transform("chain", lambda x: x["warnings"]))
    out = {
        "event_id": F.sha2(event, 256), "source_system": F.lit(SOURCE_SYSTEM), "source_manifest_hash": F.lit(manifest_hash), "row_number": F.col("row_number"),
        "death_date": F.col("death.normalized"), "death_date_state": F.col("death.state"), "birth_date": F.col("birth.normalized"), "birth_date_state": F.col("birth.state"),
        "raw_age": F.col("raw_age"), "age_years": F.col("age.age_years"), "age_days": F.col("age.age_days"), "age_state": F.col("age.state"), "age_source": F.col("age.source"),
        "sex": F.col("sex.normalized"), "sex_state": F.col("sex.state"), "race_axis_type": F.lit(RACE_AXIS), "race_missingness_state": F.col("p_race_color_admin.state"),
        "underlying_icd_raw": F.col("underlying_icd_raw"), "underlying_icd_norm": F.col("underlying.normalized"), "underlying_icd_parse_state": F.col("underlying.state"), "underlying_icd_warnings": F.col("underlying.warnings"),
        "cause_chain_raw": F.transform("chain", lambda x: x["raw"]), "cause_chain_norm": F.array_compact(F.transform("chain", lambda x: x["norm"])),
        "cause_chain_parse_states": F.transform("chain", lambda x: x["state"]), "cause_chain_warnings": chain_warnings,
        "raw_record_hash": F.col("raw_record_hash"), "processed_record_hash": F.col("processed_record_hash"), "normalization_warnings": F.concat(F.col("age.warnings"), chain_warnings),
    }
    for place in ("residence", "occurrence"):
        out |= {f"mun_{place}_{part}": F.col(f"{place}.{part}") for part in ("cod6", "cod7", "state")}
    for name, (_, state) in (CATEGORICAL | NUMERIC).items():
        out |= {name: F.col(f"p_{name}.normalized"), state: F.col(f"p_{name}.state")}
    return [out[f.name].alias(f.name) for f in NORMALIZED_EVENTS]
