import json

import pytest
from pyspark.sql import functions as F

from vitalgrid.operators import cube, profile


def profiled(spark, rows, schema, **kw):
    return {r["column"]: r for r in profile.profile_columns(spark.createDataFrame(rows, schema).coalesce(1), **kw).collect()}


def test_profile(spark):
    rows = [("20220131", "270430", "I219", "00000000000000", "10,5"), ("20220201", "270030", "*A419", "12345678000199", "20"), (None, "", "R99", "00000000000000", "x")]
    got = profiled(spark, rows, "DTOBITO string, CODMUNRES string, CAUSABAS string, CGC_HOSP string, VAL_TOT string")
    d, m, c, z, v = (got[k] for k in ("DTOBITO", "CODMUNRES", "CAUSABAS", "CGC_HOSP", "VAL_TOT"))
    assert (d["observed_kind"], d["n_null"], d["date_min"], d["name_based_role"]) == ("date_like", 1, "2022-01-31", "date_or_period")
    assert (m["n_blank"], m["missing_rate"], m["digit_lengths"]) == (1, 1 / 3, {"6": 2}) and "digit_length_6" in m["shape_flags"]
    assert "contains_prefixed_asterisk_values" in c["shape_flags"]
    assert "contains_zero_filler_identifier" in z["shape_flags"] and z["warnings"] == ["corporate_identifier_zero_filler_present"]
    assert [tuple(x) for x in z["top_values"]] == [("00000000000000", 2), ("12345678000199", 1)]
    assert (v["numeric_parse_rate"], v["numeric_max"], v["value_length_distribution"]) == (2 / 3, 20.0, {"1": 1, "2": 1, "4": 1})


def test_sample_limit_takes_the_first_nonblank_values(spark):
    got = profiled(spark, [("",), ("1",), ("x",), ("2",), ("3",)], "a string", sample_limit=2)["a"]
    assert (got["numeric_parse_rate"], got["numeric_max"], got["n_unique"]) == (0.5, 1.0, 4)


def test_empty_profile(spark):
    assert profiled(spark, [], "a string") == {}
    assert profiled(spark, [(None,)], "a string")["a"]["observed_kind"] == "empty"


def test_roles(spark):
    names = {"CODMUNRES": "municipality_code", "cnes": "facility_identifier", "CNPJ_MANT": "corporate_identifier", "LINHAA": "diagnosis_or_cause_code", "PROC_REA": "procedure_code", "VAL_TOT": "monetary_or_numeric_measure", "DTNASC": "date_or_period", "OTHER": None}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", profile.name_role(F.col("n")).alias("r"))
    assert {r["n"]: r["r"] for r in df.collect()} == names


def test_comparison(spark):
    raw = profile.profile_columns(spark.createDataFrame([("1", "a", "x")] * 4, "A string, B string, RAW_ONLY string"))
    new = profile.profile_columns(spark.createDataFrame([("1", None, 1), ("2", "a", 1), ("3", "a", 1), ("4", "a", 1)], "A string, B string, PROCESSED_ONLY int"))
    got = {r["column"]: r for r in profile.compare_profiles(raw, new).collect()}
    assert got["RAW_ONLY"]["flags"] == ["raw_only"] and got["PROCESSED_ONLY"]["flags"] == ["processed_only"]
    assert got["A"]["flags"] == ["cardinality_changed"] and got["B"]["warnings"] == ["missingness_changed:raw=0.0000;processed=0.2500"]
    assert profile.row_count_warnings(4, 5) == ["row_count_changed:raw=4;processed=5"]


FLAT = [
    {"NC": "Nível", "NN": "Nível", "MN": "Unidade", "V": "Valor", "D1C": "Município (Código)", "D1N": "Município", "D2C": "Ano (Código)", "D2N": "Ano", "D3C": "Variável (Código)", "D3N": "Variável", "D10C": "Sexo (Código)", "D10N": "Sexo"},
    {"NC": "6", "NN": "Município", "MN": "Pessoas", "V": "1.031.597", "D1C": "2704302", "D1N": "Maceió", "D2C": "2021", "D2N": "2021", "D3C": "9324", "D3N": "População residente", "D10C": "0", "D10N": "Total"},
    {"NC": "6", "NN": "Município", "MN": "Pessoas", "V": None, "D1C": "2700300", "D1N": 'Ara"piraca', "D2C": "2021", "D2N": "2021", "D3C": "9324", "D3N": "População residente", "D10C": "0", "D10N": "Total"},
]


@pytest.mark.parametrize("variables", [("9324",), ()])
def test_flat_cube(spark, variables):
    facts, warnings = cube.facts_of(spark, FLAT, "6579", variables, ())
    got = {r["locality_id"]: r for r in facts.collect()}
    assert warnings == [] and set(got) == {"2704302", "2700300"}
    a = got["2704302"]
    assert (a["variable_id"], a["variable_name"], a["period"], a["value"], a["value_state"], a["locality_level_id"], a["unit"]) == ("9324", "População residente", "2021", 1031597.0, "valid", "6", "Pessoas")
    dims = [{"index": "1", "code": "2704302", "name": "Maceió"}, {"index": "2", "code": "2021", "name": "2021"}, {"index": "3", "code": "9324", "name": "População residente"}, {"index": "10", "code": "0", "name": "Total"}]
    assert a["dimension_tuple_json"] == json.dumps(dims, sort_keys=True, ensure_ascii=False) and a["classification_tuple_json"] == json.dumps(dims[3:], sort_keys=True, ensure_ascii=False)
    assert got["2700300"]["value_state"] == "missing" and got["2700300"]["locality_name"] == 'Ara"piraca'


def test_nested_cube(spark):
    classes = [{"nome": 'Sexo", "id":{,', "id": "2", "categoria": {"6795": "a\\b", "6794": "Total: all, \u00e9"}, "n": 3}]
    payload = [{"id": "93", "variavel": "População", "unidade": "Pessoas", "resultados": [{"classificacoes": classes, "series": [{"localidade": {"id": "2704302", "nome": "Maceió", "nivel": {"id": "N6", "nome": "Município"}}, "serie": {"2020": "10", "2021": "..."}}]}]}]
    facts, _ = cube.facts_of(spark, payload, "202")
    got = {r["period"]: r for r in facts.collect()}
    assert (got["2020"]["value"], got["2021"]["value_state"], got["2020"]["locality_level_id"]) == (10.0, "not_available", "N6")
    assert got["2020"]["classification_tuple_json"] == json.dumps(classes, sort_keys=True, ensure_ascii=False)


def test_odd_payloads(spark):
    facts, warnings = cube.facts_of(spark, [], "1")
    assert facts.count() == 0 and len(facts.columns) == 14 and warnings == ["sidra_empty_top_level_payload"]
    assert cube.facts_of(spark, [{"a": 1}], "1")[1] == ["sidra_unrecognized_response_shape"]
    assert cube.facts_of(spark, [{"V": "Valor"}], "1")[1] == ["sidra_flat_no_data_rows_after_header_removal"]
    with pytest.raises(ValueError):
        cube.payload_form({})


def test_nested_warnings(spark):
    good = {"localidade": {"id": "1"}, "serie": {"2020": "5"}}
    payload = [
        {"id": "a", "resultados": "x"}, {"id": "b", "resultados": [7, {"series": {}}, {"series": [3, {"localidade": [], "serie": {}}, {"localidade": {}, "serie": None}, good]}, {}]}, {"resultados": None}, {"id": 9},
    ]
    facts, warnings = cube.facts_of(spark, payload, "1")
    assert facts.count() == 1
    assert warnings == ["unexpected_resultados_type:a", "unexpected_result_type:b", "unexpected_series_type:b", "unexpected_series_item_type:b", "unexpected_locality_or_serie_type:b", "unexpected_locality_or_serie_type:b", "unexpected_resultados_type:"]
    odd = spark.createDataFrame([(json.dumps([1, {"V": "2"}, "x"]),)], "j string")
    assert [r["code"] for r in cube.flat_warnings(odd, "j").collect()] == ["sidra_flat_non_dict_row"] * 2
    assert [r["code"] for r in cube.nested_warnings(odd, "j").collect()] == ["unexpected_variable_block_type"] * 2
    assert cube.facts_of(spark, [{"resultados": []}], "1")[1] == ["sidra_nested_no_series_facts"]


def test_funnel_denominator_and_diagnostics(spark):
    rows = [("t", "v", "2021", "2704302", "A", "6", 10.0, "valid"), ("t", "v", "2021", "2704302", "A", "6", 11.0, "valid"), ("t", "w", "x", "2704302", None, "6", 1.0, "valid"), ("u", "v", "2021", None, "B", "3", None, "missing")]
    facts = spark.createDataFrame(rows, "table_id string, variable_id string, period string, locality_id string, locality_name string, locality_level_id string, value double, value_state string")
    f = cube.facts_funnel(facts, "t", "v").first()
    assert (f["n_input_facts"], f["n_after_table"], f["n_after_variable"], f["n_after_value_state"], f["excluded_by_table"]) == (4, 3, 2, 2, 1)
    den = cube.facts_to_denominator(facts, "t", "v")
    assert {(r["year"], r["municipality_cod6"], r["population"], r["sidra_measure_id"]) for r in den.collect()} == {(2021, "270430", 10.0, "t:v"), (2021, "270430", 11.0, "t:v")}
    assert cube.projection_report(facts, den, table_id="t", variable_id="v")["warnings"] == ["duplicate_population_keys:1"]
    d = cube.diagnose(facts)
    assert (d["n_rows"], d["n_unique_localities"], d["n_null_value"], d["n_duplicate_measure_keys"], d["locality_level_id_counts"]) == (4, 2, 1, 1, {"6": 3, "3": 1})
    assert cube.diagnose(facts.drop("value"))["warnings"] == ["missing_expected_columns:value"]
