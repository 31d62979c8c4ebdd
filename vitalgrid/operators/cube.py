"""Statistical-office fact cubes: JSON text to long facts, facts to denominators, diagnostics.

A payload is a JSON array in a text column. The flat form is a list of objects
with ``V`` and ``DnC``/``DnN`` pairs, a header object among them; the nested
form is variables, results, series and a map of periods. Both are taken apart
with ``from_json`` and ``explode``, so payloads of any number are handled in
parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.functions.parsers import parse_cube_value
from vitalgrid.operators.rows import distinct_with_null, duplicate_keys, value_counts
from vitalgrid.schemas import DENOMINATOR, FACTS, enforce_schema, require

MEASURE_KEYS = ["table_id", "variable_id", "period", "locality_id"]
#: The territorial level of municipalities, and texts that mark header objects and variables.
MUNICIPALITY_LEVEL = "6"
HEADER_VALUES, HEADER_CODES, VARIABLE_NAMES = ("valor", "v"), ("código", "codigo"), ("população", "variável")


def dimensions(row: Column) -> Column:
    """array<struct(index, code, name)> of a flat object's DnC/DnN pairs, by the number n."""
    keys = F.filter(F.map_keys(row), lambda k: k.rlike(r"^D[0-9]+C\z"))
    pair = lambda k: F.struct(
        F.regexp_extract(k, r"^D([0-9]+)C\z", 1).cast("int").alias("place"),
        F.regexp_extract(k, r"^D([0-9]+)C\z", 1).alias("index"),
        F.coalesce(F.try_element_at(row, k), F.lit("")).alias("code"),
        F.coalesce(F.try_element_at(row, F.concat(F.lit("D"), F.regexp_extract(k, r"^D([0-9]+)C\z", 1), F.lit("N"))), F.lit("")).alias("name"),
    )
    return F.transform(F.array_sort(F.transform(keys, pair)), lambda d: F.struct(d["index"].alias("index"), d["code"].alias("code"), d["name"].alias("name")))


def is_header(row: Column) -> Column:
    """The object that carries labels instead of data."""
    value = F.lower(F.trim(F.coalesce(F.try_element_at(row, F.lit("V")), F.lit(""))))
    codes = F.filter(F.map_entries(row), lambda e: e["key"].rlike(r"^D[0-9]+C\z") & e["value"].isNotNull())
    labelled = F.exists(codes, lambda e: F.contains(F.lower(e["value"]), F.lit(HEADER_CODES[0])) | F.contains(F.lower(e["value"]), F.lit(HEADER_CODES[1])))
    return value.isin(*HEADER_VALUES) | labelled


def assign_roles(dims: Column, variables: tuple[str, ...], periods: tuple[str, ...]) -> Column:
    """struct(variable, period, rest): one pass over the dimensions in order.

    The first expected variable, then the first expected period or four-digit
    code are taken; the others stay in ``rest``.
    """
    dim = "struct<index:string,code:string,name:string>"
    none = F.lit(None).cast(dim)
    start = F.struct(none.alias("variable"), none.alias("period"), F.array().cast(f"array<{dim}>").alias("rest"))
    listed = lambda d, values: d["code"].isin(*values) if values else F.lit(False)

    def step(acc: Column, d: Column) -> Column:
        is_variable = listed(d, variables) & acc["variable"].isNull()
        is_period = ~is_variable & acc["period"].isNull() & (listed(d, periods) | d["code"].rlike(r"^[0-9]{4}\z"))
        return F.struct(
            F.when(is_variable, d).otherwise(acc["variable"]).alias("variable"),
            F.when(is_period, d).otherwise(acc["period"]).alias("period"),
            F.when(is_variable | is_period, acc["rest"]).otherwise(F.array_append(acc["rest"], d)).alias("rest"),
        )

    return F.aggregate(dims, start, step)


def dims_json(dims: Column) -> Column:
    """JSON of dimensions with sorted keys and a blank after commas and colons."""
    quoted = lambda c: F.to_json(F.array(c))  # noqa: E731  a one-text array, for its escapes
    text = lambda c: F.substring(quoted(c), F.lit(2), F.length(quoted(c)) - 2)
    each = F.transform(dims, lambda d: F.concat(F.lit('{"code": '), text(d["code"]), F.lit(', "index": '), text(d["index"]), F.lit(', "name": '), text(d["name"]), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def spaced_json(text: Column) -> Column:
    """JSON text with sorted keys and a blank after commas and colons, but not inside of texts."""
    ordered = F.to_json(F.try_parse_json(text))  # a variant holds its keys in order
    return F.regexp_replace(ordered, r'\G((?:"(?:[^"\\]|\\.)*"|[^",:])*+)([,:])', "$1$2 ")


def flat_facts(payloads: DataFrame, text_col: str, table_id: str | Column, variables: tuple[str, ...] = (), periods: tuple[str, ...] = ()) -> DataFrame:
    """Facts of flat payloads, header objects left out."""
    table = F.lit(table_id) if isinstance(table_id, str) else table_id
    rows = payloads.select(table.alias("table_id"), F.explode(F.from_json(F.col(text_col), "array<map<string,string>>")).alias("row")).where(F.col("row").isNotNull() & ~is_header(F.col("row")))
    rows = rows.withColumn("dims", dimensions(F.col("row"))).withColumn("roles", assign_roles(F.col("dims"), variables, periods)).withColumn("rest", F.col("roles.rest"))
    # the first dimension left is the place; a variable that wasn't named is looked for among the others
    rows = rows.withColumns({"place": F.try_element_at("rest", F.lit(1)), "rest": F.slice("rest", 2, 1 << 20)})
    named = lambda d: F.contains(F.lower(d["name"]), F.lit(VARIABLE_NAMES[0])) | F.contains(F.lower(d["name"]), F.lit(VARIABLE_NAMES[1]))
    late = F.when(F.col("roles.variable").isNull(), F.try_element_at(F.filter("rest", named), F.lit(1)))
    rows = rows.withColumn("late", late).withColumn("variable", F.coalesce("roles.variable", "late"))
    gone = F.array_position(F.transform("rest", named), F.lit(True))
    rest = F.when(F.col("late").isNull(), F.col("rest")).otherwise(F.filter("rest", lambda d, k: k + 1 != gone))
    get = lambda k: F.coalesce(F.try_element_at("row", F.lit(k)), F.lit(""))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    raw = F.try_element_at("row", F.lit("V"))
    value = parse_cube_value(raw)
    out = rows.select(
        "table_id", blank("variable.code").alias("variable_id"), blank("variable.name").alias("variable_name"), get("MN").alias("unit"), blank("roles.period.code").alias("period"),
        blank("place.code").alias("locality_id"), blank("place.name").alias("locality_name"), get("NC").alias("locality_level_id"), get("NN").alias("locality_level_name"),
        dims_json(rest).alias("classification_tuple_json"), dims_json(F.col("dims")).alias("dimension_tuple_json"), raw.alias("value_raw"), value["value"].alias("value"), value["state"].alias("value_state"),
    )
    return enforce_schema(out, FACTS)


def _object(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit("{")), F.lit(False))


def _list(c: Column) -> Column:
    return F.coalesce(F.startswith(c, F.lit("[")), F.lit(False))


def _parts(c: Column) -> Column:
    """JSON texts of an array's elements."""
    return F.from_json(c, "array<string>")


def _member(c: Column, name: str, absent: str) -> Column:
    """JSON text of an object's member, null if it is null, ``absent`` if there is none."""
    members = F.from_json(c, "map<string,string>")
    return F.when(F.map_contains_key(members, name), F.try_element_at(members, F.lit(name))).otherwise(F.lit(absent))


class _Nested:
    """Nested payloads level by level, as JSON texts: each level goes on with what has the right shape."""

    def __init__(self, payloads: DataFrame, text_col: str, *more: Column):
        x = F.col("_x")
        own, head = ["_id", "_name", "_unit", *(f"_m{k}" for k in range(len(more)))], [c.alias(f"_m{k}") for k, c in enumerate(more)]
        self.blocks = payloads.select(*head, F.posexplode(_parts(F.col(text_col))).alias("_p0", "_x"))
        member = lambda name, absent="": _member(x, name, absent)
        variable = [member("id").alias("_id"), member("variavel").alias("_name"), member("unidade").alias("_unit"), *own[3:]]
        self.results = self.blocks.where(_object(x)).select(*variable, "_p0", member("resultados", "[]").alias("_x"))
        self.each = self.results.where(_list(x)).select(*own, "_p0", F.posexplode(_parts(x)).alias("_p1", "_x"))
        self.series = self.each.where(_object(x)).select(*own, "_p0", "_p1", member("classificacoes", "[]").alias("_classes"), member("series", "[]").alias("_x"))
        self.items = self.series.where(_list(x)).select(*own, "_classes", "_p0", "_p1", F.posexplode(_parts(x)).alias("_p2", "_x"))
        self.ends = self.items.where(_object(x)).select(*own, "_classes", "_p0", "_p1", "_p2", member("localidade", "{}").alias("_place"), member("serie", "{}").alias("_serie"))
        self.sound = _object(F.col("_place")) & _object(F.col("_serie"))


def nested_facts(payloads: DataFrame, text_col: str, table_id: str | Column) -> DataFrame:
    """Facts of nested payloads: one per variable, result, series and period. Parts of another shape give none, and harm no others."""
    table = F.lit(table_id) if isinstance(table_id, str) else table_id
    nested = _Nested(payloads, text_col, table)
    good = nested.ends.where(nested.sound).withColumn("_level", _member(F.col("_place"), "nivel", "{}"))
    p = good.select("*", F.explode(F.from_json("_serie", "map<string,string>")).alias("period", "raw"))
    blank = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(""))
    level = lambda name: F.when(_object(F.col("_level")), _member(F.col("_level"), name, "")).otherwise(F.lit(""))
    value = parse_cube_value(F.col("raw"))
    out = p.select(
        F.col("_m0").alias("table_id"), blank("_id").alias("variable_id"), blank("_name").alias("variable_name"), blank("_unit").alias("unit"), "period",
        blank(_member(F.col("_place"), "id", "")).alias("locality_id"), blank(_member(F.col("_place"), "nome", "")).alias("locality_name"),
        blank(level("id")).alias("locality_level_id"), blank(level("nome")).alias("locality_level_name"), F.coalesce(spaced_json(F.col("_classes")), F.lit("null")).alias("classification_tuple_json"), F.lit("[]").alias("dimension_tuple_json"),
        F.col("raw").alias("value_raw"), value["value"].alias("value"), value["state"].alias("value_state"),
    )
    return enforce_schema(out, FACTS)


def payload_form(payload: list) -> str:
    """``flat``, ``nested``, ``empty`` or ``unknown``."""
    if not isinstance(payload, list):
        raise ValueError("a payload must be a list")
    if not payload:
        return "empty"
    if all(isinstance(x, dict) for x in payload):
        if any("V" in x for x in payload):
            return "flat"
        if any("resultados" in x for x in payload):
            return "nested"
    return "unknown"


def flat_warnings(payloads: DataFrame, text_col: str) -> DataFrame:
    """(at, code): elements of flat payloads that aren't objects, with their places."""
    rows = payloads.select(F.posexplode(_parts(F.col(text_col))).alias("p", "row"))
    return rows.where(~_object(F.col("row"))).select(F.array("p").alias("at"), F.lit("sidra_flat_non_dict_row").alias("code"))


def nested_warnings(payloads: DataFrame, text_col: str) -> DataFrame:
    """(at, code): parts of nested payloads of another shape than expected, with their places from the outermost array inwards."""
    n, x = _Nested(payloads, text_col), F.col("_x")
    code = lambda text: F.concat(F.lit(f"{text}:"), F.coalesce(F.col("_id"), F.lit("")))
    found = [
        (n.blocks, ~_object(x), 1, F.lit("unexpected_variable_block_type")),
        (n.results, ~_list(x), 1, code("unexpected_resultados_type")),
        (n.each, ~_object(x), 2, code("unexpected_result_type")),
        (n.series, ~_list(x), 2, code("unexpected_series_type")),
        (n.items, ~_object(x), 3, code("unexpected_series_item_type")),
        (n.ends, ~n.sound, 3, code("unexpected_locality_or_serie_type")),
    ]
    each = [df.where(bad).select(F.array(*(F.col(f"_p{k}").cast("int") for k in range(depth))).alias("at"), text.alias("code")) for df, bad, depth, text in found]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


def facts_of(spark, payload: list, table_id: str, variables: tuple[str, ...] = (), periods: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Facts of one payload by its form, with warnings in the payload's order; typed and empty for an empty or unknown one."""
    import json

    form = payload_form(payload)
    if form not in ("flat", "nested"):
        return spark.createDataFrame([], FACTS), ["sidra_empty_top_level_payload" if form == "empty" else "sidra_unrecognized_response_shape"]
    df = spark.createDataFrame([(json.dumps(payload, ensure_ascii=False),)], "payload string")
    if form == "flat":
        facts, said, none = flat_facts(df, "payload", str(table_id), variables, periods), flat_warnings(df, "payload"), "sidra_flat_no_data_rows_after_header_removal"
    else:
        facts, said, none = nested_facts(df, "payload", str(table_id)), nested_warnings(df, "payload"), "sidra_nested_no_series_facts"
    warnings = [r["code"] for r in said.orderBy("at").collect()]
    return facts, warnings + [none] * facts.isEmpty()


def _stages(table_id: str | None, variable_id: str | None, level_id: str | None) -> list[tuple[str, Column]]:
    """The filters in order, each with those before it."""
    eq = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False)) if v is not None else F.lit(True)
    table = eq("table_id", table_id)
    variable = table & eq("variable_id", variable_id)
    level = variable & eq("locality_level_id", level_id)
    valid = level & F.col("period").isNotNull() & F.col("locality_id").isNotNull() & F.col("value").isNotNull() & F.coalesce(F.startswith("value_state", F.lit("valid")), F.lit(False))
    return [("table", table), ("variable", variable), ("level", level), ("value_state", valid)]


def facts_funnel(facts: DataFrame, table_id: str | None = None, variable_id: str | None = None, level_id: str | None = MUNICIPALITY_LEVEL) -> DataFrame:
    """One row: facts after each filter and those that each one excluded, in a single pass."""
    require(facts, {"period", "locality_id", "value", "value_state", "table_id", "variable_id", "locality_name", *(["locality_level_id"] if level_id is not None else [])}, "the table of facts")
    stages = _stages(table_id, variable_id, level_id)
    counts = facts.agg(F.count(F.lit(1)).alias("n_input_facts"), *(F.count(F.when(test, 1)).alias(f"n_after_{name}") for name, test in stages))
    names = ["n_input_facts", *(f"n_after_{name}" for name, _ in stages)]
    return counts.select(*names, *((F.col(a) - F.col(b)).alias(b.replace("n_after", "excluded_by")) for a, b in zip(names, names[1:], strict=False)))


def facts_to_denominator(facts: DataFrame, table_id: str | None = None, variable_id: str | None = None, source_label: str = "SIDRA_population", level_id: str | None = MUNICIPALITY_LEVEL) -> DataFrame:
    """Denominator rows of the facts that pass all filters, sorted by year and area; nothing is summed up."""
    require(facts, {"period", "locality_id", "value", "value_state", "table_id", "variable_id", "locality_name"}, "the table of facts")
    good = facts.where(_stages(table_id, variable_id, level_id)[-1][1])
    out = good.select(
        F.col("period").try_cast("int").alias("year"), F.col("locality_id").cast("string").alias("municipality_cod7"), F.substring(F.col("locality_id").cast("string"), 1, 6).alias("municipality_cod6"),
        F.col("value").cast("double").alias("population"), F.lit("valid").alias("population_state"), F.lit(source_label).alias("denominator_source"), F.lit("official").alias("provenance"),
        F.concat(F.col("table_id").cast("string"), F.lit(":"), F.col("variable_id").cast("string")).alias("sidra_measure_id"), F.col("locality_name").cast("string").alias("municipality_name"),
    )
    return enforce_schema(out, DENOMINATOR).orderBy("year", "municipality_cod7")


def projection_report(facts: DataFrame, denominator: DataFrame, **filters) -> dict:
    """The funnel with counts by level and state, and warnings."""
    report = facts_funnel(facts, **filters).first().asDict()
    twice = duplicate_keys(denominator, ["year", "municipality_cod7"]).count()
    warnings = ["no_rows_after_locality_level_filter"] * (report["n_after_level"] == 0) + ["no_valid_population_values_after_value_state_filter"] * (report["n_after_value_state"] == 0)
    report |= {f"{c}_counts": {r["value"]: r["n"] for r in value_counts(facts, c).collect()} for c in ("locality_level_id", "value_state")}
    return report | {"warnings": warnings + ([f"duplicate_population_keys:{twice}"] if twice else [])}


def facts_diagnostics(facts: DataFrame) -> DataFrame:
    """One row: facts, distinct tables, variables, periods and places (null is one), null and valid values."""
    n = lambda c: (distinct_with_null(c) if c in facts.columns else F.lit(0)).cast("long")
    has = set(facts.columns)
    return facts.agg(
        F.count(F.lit(1)).alias("n_rows"), n("table_id").alias("n_unique_tables"), n("variable_id").alias("n_unique_variables"), n("period").alias("n_unique_periods"), n("locality_id").alias("n_unique_localities"),
        (F.count(F.when(F.col("value").isNull(), 1)) if "value" in has else F.lit(0).cast("long")).alias("n_null_value"),
        (F.count(F.when(F.startswith("value_state", F.lit("valid")), 1)) if "value_state" in has else F.lit(0).cast("long")).alias("n_valid_value"),
    )


def diagnose(facts: DataFrame) -> dict:
    """All diagnostics of a facts table, with counts by column and warnings instead of errors."""
    wanted = {"table_id", "variable_id", "period", "locality_id", "locality_level_id", "value", "value_state"}
    missing = sorted(wanted - set(facts.columns))
    out = facts_diagnostics(facts).first().asDict()
    for c in ("table_id", "variable_id", "period", "locality_level_id", "value_state"):
        out[f"{c}_counts"] = {r["value"]: r["n"] for r in value_counts(facts, c).collect()} if c in facts.columns else {}
    twice = 0 if missing else duplicate_keys(facts, MEASURE_KEYS).count()
    warnings = ["missing_expected_columns:" + ",".join(missing)] if missing else []
    return out | {"n_duplicate_measure_keys": twice, "warnings": warnings + ([f"duplicate_sidra_measure_keys:{twice}"] if twice else [])}
