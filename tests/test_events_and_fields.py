import hashlib
import json

import pytest

from vitalgrid.operators import fields, legality, normalize, rows
from vitalgrid.operators.legality import RateRequest, judge_rate
from vitalgrid.plans.bundle import Bundle, BundleError, json_column
from vitalgrid.plans.registries import Registries, RegistryError, validate
from vitalgrid.schemas import NORMALIZED_EVENTS, schema_problems

NAMES = ["DTOBITO", "DTNASC", "IDADE", "SEXO", "RACACOR", "CODMUNRES", "CODMUNOCOR", "CODESTAB", "CAUSABAS", "DIFDATA", "TPPOS", "ALTCAUSA"]
RAW = [
    ("20190614", "19440309", "4075", "2", "1", "355030", "355030", "2077485", "C349", "12", "2", "1"),
    ("20190702", None, "4031", "1", "4", "355030", "330455", None, "*V892", "1", None, "2"),
    ("20200318", "20200301", "2017", "1", "2", "330455", "330455", "2269311", "P220", "", None, None),
    ("2020-13-45", "", "7012", "3", "9", "12", "330455", None, "zz", "abc", "1", "2"),
]


def raw_table(spark, rows_=RAW, names=NAMES):
    return spark.createDataFrame(rows_, ", ".join(f"{n} string" for n in names)).coalesce(1)


def population(spark):
    return spark.createDataFrame([(2019, "355030", 800.0, "valid"), (2020, "330455", 500.0, "valid")], "year int, municipality_cod6 string, population double, population_state string")


def test_contract_and_states(spark):
    out = normalize.normalize_events(raw_table(spark), "m1")
    assert len(out.columns) == 54 and schema_problems(out.schema, NORMALIZED_EVENTS) == []
    got = out.orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == [0, 1, 2, 3]
    assert (got[0]["death_date"], got[0]["age_source"], got[0]["sex"], got[0]["underlying_icd_norm"]) == ("2019-06-14", "date_difference", "2", "C34.9")
    last = got[3]
    assert (last["death_date_state"], last["sex_state"], last["race_color_state"], last["underlying_icd_parse_state"], last["age_state"]) == ("unparseable", "invalid", "valid", "unparseable", "invalid")
    assert last["normalization_warnings"] == ["age_unit_invalid:7"] and got[1]["underlying_icd_warnings"] == ["icd_prefixed_asterisk"]


def test_hashes_equal_canonical_json(spark):
    got = normalize.normalize_events(raw_table(spark), "m1").orderBy("row_number").first()
    record = json.dumps(dict(zip(NAMES, RAW[0], strict=True)), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    record_hash = hashlib.sha256(record.encode()).hexdigest()
    event = json.dumps({"source_system": "SIM-DO", "source_manifest_hash": "m1", "row_number": 0, "raw_record_hash": record_hash}, sort_keys=True, separators=(",", ":"))
    assert (got["raw_record_hash"], got["event_id"]) == (record_hash, hashlib.sha256(event.encode()).hexdigest())


def test_cause_chain_and_names_in_any_case(spark):
    df = spark.createDataFrame([("*A419", "R99", "*", "4")], "LinhaA string, LINHAB string, linhac string, extra string")
    got = normalize.normalize_events(df).first()
    assert got["cause_chain_raw"] == ["*A419", "R99", "*"] and got["cause_chain_norm"] == ["A41.9", "R99"] and got["cause_chain_parse_states"] == ["valid", "ill_defined", "blank"]
    assert got["cause_chain_warnings"] == ["LINHAA:icd_prefixed_asterisk", "LINHAB:icd10_ill_defined:R99", "LINHAC:icd_prefixed_asterisk"]
    assert got["death_date_state"] == "missing"
    assert normalize.column_warnings(["DTOBITO"])[0].startswith("missing_required_columns:IDADE,")


def test_row_order_does_not_change_counts(spark):
    a = {tuple(r) for r in fields.event_counts(normalize.normalize_events(raw_table(spark))).collect()}
    b = {tuple(r) for r in fields.event_counts(normalize.normalize_events(raw_table(spark, RAW[::-1]))).collect()}
    assert a == b == {("SIM-DO", "municipality_residence", 2019, "355030", 2), ("SIM-DO", "municipality_residence", 2020, "330455", 1)}


def test_rates_and_bundle(spark, tmp_path):
    r = Registries()
    counts = fields.compile_event_counts(normalize.normalize_events(raw_table(spark)), r)
    people = fields.compile_population(population(spark), r)
    rate = fields.compile_crude_rate(counts, people, r)
    assert {tuple(x) for x in rate.data.collect()} == {(2019, "355030", 2.0, 800.0, 0.0025, 250.0, 100000.0, "deaths_per_100k_person_years"), (2020, "330455", 1.0, 500.0, 0.002, 200.0, 100000.0, "deaths_per_100k_person_years")}
    assert (counts.q_state.metrics["n_events"], counts.q_state.metrics["missingness"], counts.field.state) == (3.0, 0.25, "fragile")
    assert counts.warnings[0].severity == "severe" and rate.field.state == "fragile"
    (tmp_path / "in.csv").write_text("a\n1\n")
    bundle = Bundle.create(spark, str(tmp_path), r, {"any": "intent"}, inputs=(str(tmp_path / "in.csv"),))
    manifest = bundle.document("ReproducibilityManifest")
    assert manifest["files"][0]["sha256"] == hashlib.sha256(b"a\n1\n").hexdigest() and manifest["files"][0]["bytes"] == 4
    assert manifest["environment"]["packages"]["pyspark"] and bundle.document("UserIntent") == {"any": "intent"}
    for f in (counts, people, rate, rate):
        bundle.write_field(f)
    bundle.validate()
    assert (bundle.fields().count(), bundle.table("Q_tensor").count(), bundle.table("E_DAG").count()) == (3, 3, 2) and bundle.table("Warnings").count() >= 1
    assert bundle.read_field(rate.field.id).count() == 2
    assert json_column(bundle.field(rate.field.id), "axes_json") == {"S*": "municipality", "T": "year"}
    with pytest.raises(BundleError):
        bundle.field("nothing")


def test_population_split_is_not_a_complement(spark):
    df = spark.createDataFrame([(2022, "1", 5.0, None), (2022, "1", 5.0, "valid"), (2022, "1", -5.0, None)], "year int, municipality_cod6 string, population double, population_state string")
    q = fields.population_quality(df).first()
    assert (q["n_total"], q["n_invalid"], q["n_denom"]) == (3, 1, 5.0)


def test_empty_tables(spark):
    empty = normalize.normalize_events(raw_table(spark, []))
    assert fields.event_counts(empty).count() == 0 and fields.event_quality(empty).first()["missingness"] == 1.0
    with pytest.raises(ValueError, match="required"):
        fields.event_counts(population(spark))


def test_legality(spark):
    r = Registries()
    crude = dict(numerator_carrier="Deaths", denominator_carrier="Population", role="mortality_rate", numerator_unit="counts", denominator_unit="person_years")
    assert judge_rate(RateRequest(**crude), r).legal
    assert judge_rate(RateRequest(**crude, numerator_source="SIM-DO", denominator_source="IBGE"), r).legal
    race = judge_rate(RateRequest(**crude, numerator_source="SIM-DO", denominator_source="IBGE", declaration_required=True), r)
    assert race.failed_terms == ["delta_declaration"] and "noncommensurable" in race.warnings[0]
    assert judge_rate(RateRequest(**crude, numerator_source="SIM-DO", denominator_source="IBGE", declaration_required=True, bridge="Bridge_R"), r).legal
    assert judge_rate(RateRequest(**{**crude, "denominator_carrier": "LiveBirths"}), r).failed_terms == ["delta_carrier"]
    df = spark.createDataFrame([("Deaths", "Population", "mortality_rate", "counts", "person_years", "SIM-DO", "IBGE", None, None, True, None, True, True, True, True, True)], "numerator_carrier string, denominator_carrier string, role string, numerator_unit string, denominator_unit string, numerator_source string, denominator_source string, numerator_axis string, denominator_axis string, declaration_required boolean, bridge string, support boolean, axes boolean, aggregation boolean, provenance boolean, quality boolean")
    row = legality.judge_rates(df, r).first()
    assert (row["delta_carrier"], row["delta_unit"], row["delta_declaration"], row["legal"]) == (1, 1, 0, False)


def test_registry_validation():
    validate(Registries())
    with pytest.raises(RegistryError):
        validate(Registries(units=()))
    with pytest.raises(RegistryError):
        validate(Registries(quality={}))


def test_keep_last_and_reinjection(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("b", 4), ("c", 5)], "k string, v int").coalesce(1)
    assert {tuple(r) for r in rows.keep_last(old, new, ["k"]).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    raw, processed = spark.range(5).selectExpr("id", "id * 2 as only_raw").coalesce(1), spark.range(5).select("id").coalesce(1)
    assert {tuple(r) for r in rows.reinject_columns(raw, processed).collect()} == {(k, 2 * k) for k in range(5)}
    assert rows.reinject_columns(raw.limit(3), processed).columns == ["id"]


def test_a_parser_runs_once_in_a_count(spark):
    """Filters above the counts aren't merged into what parses the cells."""
    plan = fields.event_counts(normalize.normalize_events(raw_table(spark)))._jdf.queryExecution().optimizedPlan().toString()
    death = [line for line in plan.splitlines() if "DTOBITO" in line or "regexp_replace" in line]
    assert plan.count("regexp_replace(") <= 16 and not any(line.lstrip(" :+-").startswith("Filter") for line in death)


def test_fields_and_quality_come_from_one_run(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    r, raw, people = Registries(), raw_table(spark), population(spark)
    n, m = raw.count(), people.count()
    events = normalize.normalize_events(raw).cache()
    counts = fields.compile_event_counts(counted(events), r)
    assert seen.value == n and counts.data.count() == fields.event_counts(events).count() and seen.value == n
    q = fields.event_quality(events).first()
    assert (counts.q_state.metrics["n_events"], counts.q_state.metrics["missingness"]) == (float(q["n_valid"]), q["missingness"])
    seen.value = 0
    field = fields.compile_population(counted(people), r)
    p = fields.population_quality(people).first()
    assert seen.value == m and field.data.count() == p["n_keys"] and seen.value == m
    assert (field.q_state.metrics["n_denom"], field.q_state.metrics["missingness"]) == (p["n_denom"], p["missingness"]) and field.field.provenance == p["provenance"]
    rate, x = fields.compile_crude_rate(counts, field, r), fields.rate_quality(counts.data, field.data).first()
    assert (rate.q_state.metrics["n_events"], rate.q_state.metrics["n_denom"], rate.q_state.metrics["n_eff"], rate.q_state.metrics["missingness"]) == (x["n_events"], x["n_denom"], float(x["n_eff"]), x["missingness"])
    assert seen.value == m  # a rate reads the written fields
    # order is part of the tables
    years = [(row["year"], row["municipality_cod6"]) for row in counts.data.collect()]
    assert years == sorted(years) and [tuple(row)[:2] for row in fields.event_counts(events).collect()] == [("SIM-DO", "municipality_residence")] * len(years)


def test_fields_of_empty_tables(spark):
    r = Registries()
    counts = fields.compile_event_counts(normalize.normalize_events(raw_table(spark, [])), r)
    people = fields.compile_population(population(spark).where("false"), r)
    rate = fields.compile_crude_rate(counts, people, r)
    for f in (counts, people, rate):
        assert f.data.count() == 0 and f.q_state.metrics["missingness"] == 1.0 and f.field.state == "fragile"
