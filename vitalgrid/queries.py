"""Registered queries of the library's own operators, with their DuckDB twins.

The driver's tables hold no death records, so messy raw columns are derived
from their integer keys, by the same expressions in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.functions import parsers as P
from vitalgrid.operators import cube, fields, legality, normalize, profile, rows
from vitalgrid.plans import bundle, registries
from vitalgrid.schemas import enforce_schema
from vitalgrid.sources.files import scratch_folder
from vitalgrid.sources.readers import read_table, spread, write_parquet

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Areas and years of the derived tables.
AREAS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- derived raw tables -------------------------------------------------------------------------------------


def _literal(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _pick(values: list[str | None], key: str, spark: bool) -> str:
    items, n = ", ".join(map(_literal, values)), len(values)
    return f"element_at(array({items}), cast({key} % {n} + 1 as int))" if spark else f"list_extract([{items}], {key} % {n} + 1)"


#: Raw texts that the parsers meet.
AGES = ["4035", "3006", "9001", "", "2012", "1045", "5003", None, "4", "4 0 7", "abc"]
SEXES = ["1", "2", "9", "M", "X", "", None, "0"]
RACES = ["1", "2", "4", "NULL", None]
CAUSES = ["I219", "A419", "*R99", "j18.9", "R95", "U071", "", None, "C50", "*", " K70 0 ", "12"]
LINE_A, LINE_B = ["*A419", None, "R99", "", "bad code"], ["I10", "*", None]
DELAYS = ["1,25", "3", "abc", "1_000", "", None, "1e3", ".5", "5.", "1d", "-7"]
CELLS = ["123", "1.031.597", "12,5", "-", "0", "...", "..", "X", "", None, "abc", "1.5"]


def _raw(spark: bool) -> dict[str, str]:
    """Raw columns over ``orders``."""
    text = "string" if spark else "varchar"
    fmt = (lambda d, s, j: f"date_format({d}, '{j}')") if spark else (lambda d, s, j: f"strftime({d}, '{s}')")
    day = "o_orderdate"
    born = "date_sub(o_orderdate, cast(o_orderkey * 37 % 33000 as int))" if spark else "(o_orderdate::date - (o_orderkey * 37 % 33000)::int)"
    late = "date_add(o_orderdate, 40)" if spark else "(o_orderdate::date + 40)"
    pick = lambda values: _pick(values, "o_orderkey", spark)
    area = f"cast(270000 + o_custkey % {AREAS} as {text})"
    return {
        "row_key": "o_orderkey",
        "DTOBITO": f"case o_orderkey % 16 when 0 then '00000000' when 1 then '' when 2 then null when 3 then 'not-a-date' when 4 then ' NA ' when 5 then {fmt(day, '%d/%m/%Y', 'dd/MM/yyyy')} when 6 then {fmt(day, '%Y-%m-%d', 'yyyy-MM-dd')}"
        f" when 7 then {fmt(day, '%d%m%Y', 'ddMMyyyy')} when 8 then {fmt(day, '%Y/%m/%d', 'yyyy/MM/dd')} when 9 then {fmt(day, '%Y-%m-%d', 'yyyy-MM-dd')} || ' 07:05:09' when 10 then {fmt(day, '%d-%m-%Y', 'dd-MM-yyyy')} else {fmt(day, '%Y%m%d', 'yyyyMMdd')} end",
        "DTNASC": f"case o_orderkey % 9 when 0 then null when 1 then {fmt(late, '%Y%m%d', 'yyyyMMdd')} else {fmt(born, '%Y%m%d', 'yyyyMMdd')} end",
        "IDADE": pick(AGES),
        "SEXO": pick(SEXES),
        "RACACOR": pick(RACES),
        "CODMUNRES": f"case o_orderkey % 10 when 0 then '123' when 1 then '' when 2 then null when 3 then cast(2700000 + (o_custkey % {AREAS}) * 10 + 7 as {text}) else {area} end",
        "CODMUNOCOR": f"case when o_orderkey % 4 = 0 then null else {area} end",
        "CODESTAB": pick(["1234567", None, ""]),
        "CAUSABAS": pick(CAUSES),
        "LINHAA": pick(LINE_A),
        "LINHAB": pick(LINE_B),
        "DIFDATA": pick(DELAYS),
        "TPPOS": pick(["1", None, "N/A"]),
        "ALTCAUSA": pick(["1", "2"]),
        "GESTACAO": pick(["5", "x", None]),
        "TIPOBITO": pick(["2", ""]),
    }


def raw_events(spark: SparkSession, sf_dir: str, *names: str, evenly: bool = False) -> DataFrame:
    """Raw columns of every order; ``evenly``: orders are spread over all cores before their texts are made."""
    cols, orders = _raw(True), table(spark, sf_dir, "orders")
    return (spread(orders) if evenly else orders).selectExpr(*(f"{cols[n]} as {n}" for n in names or cols))


RAW = "raw as (select " + ", ".join(f"{e} as {n}" for n, e in _raw(False).items()) + " from orders)"


def _clean_sql(c: str) -> str:
    t = rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
    return f"(case when {c} is null then null when upper({t}) in ({', '.join(map(_literal, P.BLANK_TEXTS))}) then '' else {t} end)"


def _state_sql(t: str, rest: str) -> str:
    return f"(case when {t} is null then 'missing' when {t} = '' then 'blank' else {rest} end)"


def _date_sql(t: str) -> str:
    tries = []
    for pattern, (y, m, d) in P.DATE_PATTERNS:
        p = pattern.removeprefix("^").removesuffix("\\z")
        g = lambda k, p=p: f"regexp_extract({t}, '{p}', {k})"
        tries.append(f"case when regexp_full_match({t}, '{p}') and {g(y)} <> '0000' then strftime(try_cast({g(y)} || '-' || lpad({g(m)}, 2, '0') || '-' || lpad({g(d)}, 2, '0') as date), '%Y-%m-%d') end")
    return f"(case when {t} in ({', '.join(map(_literal, P.DATE_PLACEHOLDERS))}) then null else coalesce({', '.join(tries)}) end)"


def _date_state_sql(t: str, iso: str) -> str:
    return _state_sql(t, f"case when {t} in ({', '.join(map(_literal, P.DATE_PLACEHOLDERS))}) then 'invalid' when {iso} is null then 'unparseable' else 'valid' end")


_NUMBER = r"[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?"


def _number_sql(t: str) -> str:
    return f"(case when regexp_full_match({t}, '{_NUMBER}') then cast(replace({t}, '_', '') as double) end)"


def _icd_sql(t: str) -> str:
    up = f"trim(upper({t}))"
    bare = rf"replace(trim(regexp_replace({up}, '^\*', '')), ' ', '')"
    return f"(case when length({bare}) > 3 and not contains({bare}, '.') then left({bare}, 3) || '.' || substr({bare}, 4) else {bare} end)"


def _icd_state_sql(code: str) -> str:
    shape = P.ICD_SHAPE.removeprefix("^").removesuffix("\\z")
    return _state_sql(code, f"case when not regexp_full_match({code}, '{shape}', 'i') then 'unparseable' when left(replace({code}, '.', ''), 3) in ({', '.join(map(_literal, P.ILL_DEFINED))}) then 'ill_defined' else 'valid' end")


def _age_sql(t: str) -> tuple[str, str, str]:
    """Years, days and state."""
    digits = f"regexp_replace({t}, '[^0-9]', '', 'g')"
    unit, amount = f"left({digits}, 1)", f"try_cast(substr({digits}, 2) as double)"
    state = _state_sql(t, f"case when length({digits}) < 2 then 'unparseable' when {unit} not in ('1', '2', '3', '4', '5') then 'invalid' else 'valid' end")
    days = f"case {unit} when '1' then {amount} / 1440.0 when '2' then {amount} / 24.0 when '3' then {amount} * 30.4375::double when '4' then {amount} * 365.25::double else ({amount} + 100) * 365.25::double end"
    years = f"case {unit} when '1' then {amount} / 1440.0::double / 365.25::double when '2' then {amount} / 24.0::double / 365.25::double when '3' then {amount} / 12.0::double when '4' then {amount} else {amount} + 100 end"
    return f"(case when {state} = 'valid' then {years} end)", f"(case when {state} = 'valid' then {days} end)", state


def _cell_sql(c: str) -> tuple[str, str]:
    t = f"trim({c})"
    number = _number_sql(f"replace(replace({t}, '.', ''), ',', '.')")
    state = f"(case when {c} is null then 'missing' when {t} = '' then 'blank' when {t} = '-' then 'valid_zero_absolute' when {t} = '0' then 'valid_zero_rounded_or_exact' when {t} = '...' then 'not_available' when {t} = '..' then 'not_applicable' when upper({t}) = 'X' then 'inhibited' when {number} is null then 'unparseable' else 'valid' end)"
    return f"(case when {state} like 'valid_zero%' then 0.0::double when {state} = 'valid' then {number} end)", state


# ---- scalar parsers -----------------------------------------------------------------------------------------


@query(f"with {RAW}, c as (select row_key, {_clean_sql('DTOBITO')} as t from raw), d as (select row_key, t, {_date_sql('t')} as iso from c) select row_key, iso as death_date, {_date_state_sql('t', 'iso')} as state from d")
def parse_date_values(spark, sf_dir):
    d = P.parse_date(F.col("DTOBITO"))
    return raw_events(spark, sf_dir, "row_key", "DTOBITO").select("row_key", d["normalized"].alias("death_date"), d["state"].alias("state"))


@query(f"with {RAW}, c as (select {_clean_sql('DTOBITO')} as t from raw), d as (select t, {_date_sql('t')} as iso from c) select {_date_state_sql('t', 'iso')} as state, count(*) as n from d group by 1")
def parse_date_states(spark, sf_dir):
    return raw_events(spark, sf_dir, "DTOBITO").groupBy(P.parse_date(F.col("DTOBITO"))["state"].alias("state")).agg(F.count(F.lit(1)).alias("n"))


_DELAY = _number_sql("replace(t, ',', '.')")


@query(f"with {RAW}, c as (select row_key, {_clean_sql('DIFDATA')} as t from raw) select row_key, {_DELAY} as number, {_state_sql('t', f'''case when {_DELAY} is null then 'unparseable' else 'valid' end''')} as state from c")
def parse_numeric_values(spark, sf_dir):
    n = P.parse_numeric(F.col("DIFDATA"))
    return raw_events(spark, sf_dir, "row_key", "DIFDATA").select("row_key", n["normalized"].alias("number"), n["state"].alias("state"))


@query(f"with {RAW}, c as (select {_clean_sql('SEXO')} as t from raw) select nullif(t, '') as sex, {_state_sql('t', '''case when t in ('0', '9', 'I') then 'unknown' when t not in ('0', '1', '2', '9', 'M', 'F', 'I') then 'invalid' else 'valid' end''')} as state, count(*) as n from c group by 1, 2")
def parse_categorical_states(spark, sf_dir):
    s = P.parse_categorical(F.col("SEXO"), normalize.SEX_VALUES, normalize.SEX_UNKNOWN)
    return raw_events(spark, sf_dir, "SEXO").groupBy(s["normalized"].alias("sex"), s["state"].alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with t as (select c_custkey, case c_custkey % 6 when 0 then ' n/a ' when 1 then chr(9) || c_mktsegment || chr(10) when 2 then '   ' when 3 then null when 4 then 'None' else c_name end as raw from customer) select c_custkey, {_clean_sql('raw')} as cleaned from t")
def clean_string_tokens(spark, sf_dir):
    raw = "case c_custkey % 6 when 0 then ' n/a ' when 1 then concat(char(9), c_mktsegment, char(10)) when 2 then '   ' when 3 then null when 4 then 'None' else c_name end"
    return table(spark, sf_dir, "customer").select("c_custkey", P.clean(F.expr(raw)).alias("cleaned"))


@query(f"with {RAW}, c as (select row_key, {_icd_sql(_clean_sql('CAUSABAS'))} as code from raw) select row_key, nullif(code, '') as code, {_icd_state_sql('code')} as state from c")
def icd_parse(spark, sf_dir):
    i = P.parse_icd10(F.col("CAUSABAS"))
    return raw_events(spark, sf_dir, "row_key", "CAUSABAS").select("row_key", i["normalized"].alias("code"), i["state"].alias("state"))


_AGE = _age_sql("t")


@query(f"with {RAW}, c as (select row_key, {_clean_sql('IDADE')} as t from raw) select row_key, round({_AGE[0]}, 9) as age_years, round({_AGE[1]}, 9) as age_days, {_AGE[2]} as state from c")
def age_decode(spark, sf_dir):
    a = P.parse_age(F.col("IDADE"))
    return raw_events(spark, sf_dir, "row_key", "IDADE").select("row_key", F.round(a["age_years"], 9).alias("age_years"), F.round(a["age_days"], 9).alias("age_days"), a["state"].alias("state"))


_DIGITS = "regexp_replace(t, '[^0-9]', '', 'g')"
_PLACE_STATE = _state_sql("t", f"case when length({_DIGITS}) in (6, 7) then 'valid' else 'invalid' end")


@query(f"with {RAW}, c as (select row_key, {_clean_sql('CODMUNRES')} as t from raw) select row_key, case when {_PLACE_STATE} = 'valid' then left({_DIGITS}, 6) end as cod6, case when length({_DIGITS}) = 7 then {_DIGITS} end as cod7, {_PLACE_STATE} as state from c")
def municipality_codes(spark, sf_dir):
    m = P.parse_municipality(F.col("CODMUNRES"))
    return raw_events(spark, sf_dir, "row_key", "CODMUNRES").select("row_key", m["cod6"].alias("cod6"), m["cod7"].alias("cod7"), m["state"].alias("state"))


_RESOLVED = f"""r as (select row_key, death, birth, t, date_diff('day', birth::date, death::date) as days, {_AGE[0]} as y, {_AGE[1]} as d, {_AGE[2]} as s
  from (select row_key, {_date_sql("dt")} as death, {_date_sql("bt")} as birth, t from (select row_key, {_clean_sql("DTOBITO")} as dt, {_clean_sql("DTNASC")} as bt, {_clean_sql("IDADE")} as t from raw)))"""


@query(f"with {RAW}, {_RESOLVED} select row_key, round(case when days >= 0 then days / 365.25::double else y end, 9) as age_years, round(case when days >= 0 then days::double else d end, 9) as age_days, case when days >= 0 then 'valid' else s end as state, case when days >= 0 then 'date_difference' else 'datasus_idade' end as source, coalesce(days < 0, false) as late_birth from r")
def age_resolve(spark, sf_dir):
    r = P.resolve_age(P.parse_date(F.col("DTOBITO"))["normalized"], P.parse_date(F.col("DTNASC"))["normalized"], P.parse_age(F.col("IDADE")))
    raw = raw_events(spark, sf_dir, "row_key", "DTOBITO", "DTNASC", "IDADE").withColumn("r", r)
    return raw.select("row_key", F.round("r.age_years", 9).alias("age_years"), F.round("r.age_days", 9).alias("age_days"), "r.state", "r.source", F.array_contains("r.warnings", "birth_date_after_death_date").alias("late_birth"))


def _chain_sql() -> str:
    parts = []
    for name in ("LINHAA", "LINHAB"):
        t, code = _clean_sql(name), _icd_sql(_clean_sql(name))
        parts.append(f"case when {t} <> '' then {{'raw': {t}, 'norm': nullif({code}, ''), 'state': {_icd_state_sql(code)}}} end")
    return f"list_filter([{', '.join(parts)}], lambda x: x is not null)"


@query(f"with {RAW}, c as (select row_key, {_chain_sql()} as chain from raw) select row_key, array_to_string(list_transform(chain, lambda x: x.raw), '|') as raw_codes, array_to_string(list_filter(list_transform(chain, lambda x: x.norm), lambda x: x is not null), '|') as norm_codes, array_to_string(list_transform(chain, lambda x: x.state), '|') as states from c")
def cause_chain_arrays(spark, sf_dir):
    chain = normalize.cause_chain({c: P.clean(F.col(c)) for c in ("LINHAA", "LINHAB")})
    raw = raw_events(spark, sf_dir, "row_key", "LINHAA", "LINHAB").withColumn("chain", chain)
    join = lambda f: F.array_join(F.array_compact(F.transform("chain", f)), "|")
    return raw.select("row_key", join(lambda x: x["raw"]).alias("raw_codes"), join(lambda x: x["norm"]).alias("norm_codes"), join(lambda x: x["state"]).alias("states"))


_LINE_CELL = _pick(CELLS, "(l_orderkey * 7 + l_linenumber)", False)
_CELL = _cell_sql("v")


@query(f"with t as (select l_orderkey, l_linenumber, {_LINE_CELL} as v from lineitem) select l_orderkey, l_linenumber, {_CELL[0]} as cell_value, {_CELL[1]} as state from t")
def cube_value_states(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.parse_cube_value(F.expr(_pick(CELLS, "(l_orderkey * 7 + l_linenumber)", True))).alias("c"))
    return cells.select("l_orderkey", "l_linenumber", F.col("c.value").alias("cell_value"), "c.state")


# ---- rows, hashes, schemas ----------------------------------------------------------------------------------


@query("""select c_custkey, sha256('{"c_custkey":"' || c_custkey || '","c_name":' || to_json(c_name)::varchar || ',"nothing":null}') as row_hash from customer""")
def event_hash(spark, sf_dir):
    cols = {"c_name": F.col("c_name"), "c_custkey": F.col("c_custkey").cast("string"), "nothing": F.lit(None).cast("string")}
    return table(spark, sf_dir, "customer").select("c_custkey", F.sha2(normalize.canonical_json(cols), 256).alias("row_hash"))


@query("select null::varchar as absent, c_name, cast(c_custkey as bigint) as c_custkey, try_cast(c_name as double) as c_phone from customer")
def schema_enforce(spark, sf_dir):
    from pyspark.sql import types as T

    people = table(spark, sf_dir, "customer").withColumn("c_phone", F.col("c_name"))
    wanted = T.StructType([T.StructField("absent", T.StringType()), T.StructField("c_name", T.StringType()), T.StructField("c_custkey", T.LongType()), T.StructField("c_phone", T.DoubleType())])
    return enforce_schema(people, wanted)


@query("select count(*)::bigint as n_rows, min(i)::bigint as first_index, max(i)::bigint as last_index, count(distinct i)::bigint as n_distinct from (select row_number() over () - 1 as i from orders)")
def row_index(spark, sf_dir):
    i = F.col("i")
    return rows.with_row_index(table(spark, sf_dir, "orders").select("o_orderkey"), "i").agg(F.count(i).alias("n_rows"), F.min(i).alias("first_index"), F.max(i).alias("last_index"), F.count_distinct(i).alias("n_distinct"))


@query("select o_orderkey, o_custkey, o_orderstatus from orders")
def positional_reinject(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rows.reinject_columns(orders.select("o_orderkey", "o_orderstatus"), orders.select("o_orderkey", "o_custkey"))


@query("select o_orderkey, case when o_orderstatus = 'F' then 'new' else o_orderstatus end as o_orderstatus, o_totalprice from orders union all select -o_orderkey, 'new', o_totalprice from orders where o_orderstatus = 'F'")
def upsert_keep_last(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    changed = orders.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("new"))
    return rows.keep_last(orders, changed.unionByName(changed.withColumn("o_orderkey", -F.col("o_orderkey"))), ["o_orderkey"])


def _bundle(spark) -> bundle.Bundle:
    out = bundle.Bundle(spark, scratch_folder(spark, "bundle"))
    out.initialize()
    return out


@query("select c_name as code, 'customer' as source from customer union all select s_name, 'supplier' from supplier")
def append_rows(spark, sf_dir):
    catalog = _bundle(spark)
    for name, column in (("customer", "c_name"), ("supplier", "s_name")):
        catalog.append("Warnings", table(spark, sf_dir, name).select(F.col(column).alias("code"), F.lit(name).alias("source")))
    return catalog.table("Warnings").select("code", "source")


def _round_trip(spark, sf_dir, suffix: str, separator: str):
    path = scratch_folder(spark, "raw") + suffix
    raw_events(spark, sf_dir).select(*(F.col(c).cast("string") for c in _raw(True))).write.options(header=True, sep=separator, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return read_table(spark, path)


_AS_TEXT = f"with {RAW} select " + ", ".join(f"{c}::varchar as {c}" for c in _raw(False)) + " from raw"


@query(_AS_TEXT)
def csv_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".csv", ",")


@query(_AS_TEXT)
def tsv_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, ".TSV", "\t")


@query("select o_orderstatus, count(*) as n from orders group by 1")
def parquet_partitions(spark, sf_dir):
    path = write_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), scratch_folder(spark, "orders") + ".parquet", ("o_orderstatus",))
    return read_table(spark, path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


# ---- events, denominators, rates ----------------------------------------------------------------------------

_EVENTS = f"""{RAW}, cleaned as (select row_key, CODMUNRES, SEXO, {_clean_sql("DTOBITO")} as dt, {_clean_sql("CODMUNRES")} as t, {_icd_sql(_clean_sql("CAUSABAS"))} as code, {_clean_sql("SEXO")} as sx, {_clean_sql("DIFDATA")} as delay, {_clean_sql("GESTACAO")} as weeks from raw),
dated as (select *, {_date_sql("dt")} as death_date, {_PLACE_STATE} as place_state, {_DIGITS} as digits from cleaned),
events_ as (select *, {_date_state_sql("dt", "death_date")} as date_state, case when place_state = 'valid' then left(digits, 6) end as cod6 from dated)"""
_COUNTS = f"{_EVENTS}, counts as (select cast(left(death_date, 4) as int) as year, cod6 as municipality_cod6, count(*) as death_count from events_ where date_state = 'valid' and place_state = 'valid' group by 1, 2)"
_POPULATION = f"""people as (select y.year, cast(270000 + c_custkey % {AREAS - 1} as varchar) as municipality_cod6, case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then -5.0 else 100.0 + c_custkey % 7 end::double as population,
  case when c_custkey % 17 = 0 then null when c_custkey % 19 = 0 then 'estimated' else 'valid' end as population_state from customer, (select unnest([1992, 1993, 1994, 1995, 1996, 1997]) as year) y)"""
_VALID_PEOPLE = "year is not null and municipality_cod6 is not null and population is not null and population > 0 and population_state = 'valid'"
_BAD_PEOPLE = "year is null or municipality_cod6 is null or population is null or population <= 0 or population_state <> 'valid'"
_DENOMINATOR = f"{_POPULATION}, den as (select year, municipality_cod6, sum(population) as population from people where {_VALID_PEOPLE} group by 1, 2)"
_JOINED = f"{_COUNTS}, {_DENOMINATOR}, joined as (select c.year, c.municipality_cod6, death_count::double as death_count, population from counts c left join den using (year, municipality_cod6))"


def normalized_events(spark, sf_dir):
    return normalize.normalize_events(raw_events(spark, sf_dir, evenly=True), row_index="row_key")


def population_table(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr(
        f"cast(270000 + c_custkey % {AREAS - 1} as string) as municipality_cod6", "cast(case when c_custkey % 11 = 0 then null when c_custkey % 13 = 0 then -5.0 else 100.0 + c_custkey % 7 end as double) as population",
        "case when c_custkey % 17 = 0 then null when c_custkey % 19 = 0 then 'estimated' else 'valid' end as population_state",
    )
    return people.withColumn("year", F.explode(F.array(*(F.lit(y) for y in range(1992, 1998)))))


def counts_and_population(spark, sf_dir):
    return fields.event_counts(normalized_events(spark, sf_dir)), fields.population_denominator(population_table(spark, sf_dir))


@query(f"with {_EVENTS} select row_key as row_number, death_date, date_state as death_date_state, cod6 as mun_residence_cod6, place_state as mun_residence_state, nullif(sx, '') as sex, {_state_sql('sx', '''case when sx in ('0', '9', 'I') then 'unknown' when sx not in ('0', '1', '2', '9', 'M', 'F', 'I') then 'invalid' else 'valid' end''')} as sex_state, nullif(code, '') as underlying_icd_norm, {_icd_state_sql('code')} as underlying_icd_parse_state, {_number_sql('''replace(delay, ',', '.')''')} as reporting_delay, {_number_sql('''replace(weeks, ',', '.')''')} as gestational_weeks_death, nullif(weeks, '') as death_during_pregnancy from events_")
def normalize_event_columns(spark, sf_dir):
    names = ["row_number", "death_date", "death_date_state", "mun_residence_cod6", "mun_residence_state", "sex", "sex_state", "underlying_icd_norm", "underlying_icd_parse_state", "reporting_delay", "gestational_weeks_death", "death_during_pregnancy"]
    return normalized_events(spark, sf_dir).select(*names)


def _icd_warnings_sql(t: str, code: str, prefix: str = "") -> str:
    shape, ill = P.ICD_SHAPE.removeprefix("^").removesuffix("\\z"), ", ".join(map(_literal, P.ILL_DEFINED))
    kind = f"case when {code} = '' then null when not regexp_full_match({code}, '{shape}', 'i') then '{prefix}icd10_shape_unparseable:' || {code} when left(replace({code}, '.', ''), 3) in ({ill}) then '{prefix}icd10_ill_defined:' || {code} end"
    return f"list_filter([case when starts_with(upper({t}), '*') then '{prefix}icd_prefixed_asterisk' end, {kind}], lambda x: x is not null)"


def _contract_sql() -> str:
    """All columns of the event contract; lists as texts."""
    raw = [c for c in _raw(False) if c != "row_key"]
    record = " || ',' || ".join(f"""'"{c}":' || coalesce('"' || {c} || '"', 'null')""" for c in sorted(raw))
    first = lambda names: "coalesce(" + ", ".join([n for n in names if n in raw] or ["null::varchar"]) + ")"
    singles = {"DTOBITO": ("DTOBITO",), "DTNASC": ("DTNASC",), "IDADE": ("IDADE",), "SEXO": ("SEXO",), "CODMUNRES": ("CODMUNRES",), "CODMUNOCOR": ("CODMUNOCOR",), "CAUSABAS": ("CAUSABAS",), "LINHAA": ("LINHAA",), "LINHAB": ("LINHAB",)}
    wanted = singles | {name: candidates for name, (candidates, _) in (normalize.CATEGORICAL | normalize.NUMERIC).items()}
    texts = ", ".join(f"{_clean_sql(first(names))} as t_{out}" for out, names in wanted.items())
    lines = []
    for name in ("LINHAA", "LINHAB"):
        t, code = f"t_{name}", f"i_{name}"
        lines.append(f"case when {t} <> '' then {{'raw': {t}, 'norm': nullif({code}, ''), 'state': {_icd_state_sql(code)}, 'warnings': {_icd_warnings_sql(t, code, name + ':')}}} end")
    years, days, age_state = _age_sql("t_IDADE")
    digits = "regexp_replace(t_IDADE, '[^0-9]', '', 'g')"
    sex = "case when t_SEXO in ('0', '9', 'I') then 'unknown' when t_SEXO not in ('0', '1', '2', '9', 'M', 'F', 'I') then 'invalid' else 'valid' end"
    text = lambda x: f"array_to_string({x}, '|')"
    out = {
        "event_id": """sha256('{"raw_record_hash":"' || raw_record_hash || '","row_number":' || row_key || ',"source_manifest_hash":"","source_system":"SIM-DO"}')""",
        "source_system": "'SIM-DO'", "source_manifest_hash": "''", "row_number": "row_key", "raw_record_hash": "raw_record_hash", "processed_record_hash": "''", "raw_age": "IDADE", "underlying_icd_raw": "CAUSABAS",
        "death_date": "death", "death_date_state": _date_state_sql("t_DTOBITO", "death"), "birth_date": "birth", "birth_date_state": _date_state_sql("t_DTNASC", "birth"),
        "age_years": f"round(case when days >= 0 then days / 365.25::double else {years} end, 9)", "age_days": f"round(case when days >= 0 then days::double else {days} end, 9)",
        "age_state": f"case when days >= 0 then 'valid' else {age_state} end", "age_source": "case when days >= 0 then 'date_difference' else 'datasus_idade' end",
        "sex": "nullif(t_SEXO, '')", "sex_state": _state_sql("t_SEXO", sex), "race_axis_type": f"'{normalize.RACE_AXIS}'", "race_missingness_state": _state_sql("t_race_color_admin", "'valid'"),
        "underlying_icd_norm": "nullif(i_CAUSABAS, '')", "underlying_icd_parse_state": _icd_state_sql("i_CAUSABAS"), "underlying_icd_warnings": text(_icd_warnings_sql("t_CAUSABAS", "i_CAUSABAS")),
        "cause_chain_raw": text("list_transform(chain, lambda x: x.raw)"), "cause_chain_norm": text("list_filter(list_transform(chain, lambda x: x.norm), lambda x: x is not null)"),
        "cause_chain_parse_states": text("list_transform(chain, lambda x: x.state)"), "cause_chain_warnings": text("flatten(list_transform(chain, lambda x: x.warnings))"),
        "normalization_warnings": text(f"list_concat(case when days >= 0 then [] else list_filter([case when days < 0 then 'birth_date_after_death_date' end, case {age_state} when 'unparseable' then 'age_unparseable:' || t_IDADE when 'invalid' then 'age_unit_invalid:' || left({digits}, 1) end], lambda x: x is not null) end, flatten(list_transform(chain, lambda x: x.warnings)))"),
    }
    for place, c in (("residence", "CODMUNRES"), ("occurrence", "CODMUNOCOR")):
        state, number = _PLACE_STATE.replace("(t,", f"(t_{c},").replace("when t ", f"when t_{c} "), f"regexp_replace(t_{c}, '[^0-9]', '', 'g')"
        out |= {f"mun_{place}_cod6": f"case when {state} = 'valid' then left({number}, 6) end", f"mun_{place}_cod7": f"case when length({number}) = 7 then {number} end", f"mun_{place}_state": state}
    for name, (_, state) in normalize.CATEGORICAL.items():
        out |= {name: f"nullif(t_{name}, '')", state: _state_sql(f"t_{name}", "'valid'")}
    for name, (_, state) in normalize.NUMERIC.items():
        number = _number_sql(f"replace(t_{name}, ',', '.')")
        out |= {name: number, state: _state_sql(f"t_{name}", f"case when {number} is null then 'unparseable' else 'valid' end")}
    codes = ", ".join(f"{_icd_sql(f't_{c}')} as i_{c}" for c in ("CAUSABAS", "LINHAA", "LINHAB"))
    return f"""with {RAW}, texts as (select row_key, IDADE, CAUSABAS, sha256('{{' || {record} || '}}') as raw_record_hash, {texts} from raw),
dated as (select *, {_date_sql("t_DTOBITO")} as death, {_date_sql("t_DTNASC")} as birth, {codes} from texts),
linked as (select *, date_diff('day', birth::date, death::date) as days, list_filter([{", ".join(lines)}], lambda x: x is not null) as chain from dated)
select {", ".join(f"{e} as {n}" for n, e in out.items())} from linked"""


@query(_contract_sql())
def normalize_events(spark, sf_dir):
    events = normalized_events(spark, sf_dir)
    lists = [f.name for f in events.schema if f.dataType.typeName() == "array"]
    return events.withColumns({c: F.array_join(c, "|") for c in lists} | {c: F.round(c, 9) for c in ("age_years", "age_days")})


@query(f"with {_COUNTS} select 'SIM-DO' as source_system, 'municipality_residence' as geography_basis, year, municipality_cod6, death_count from counts")
def event_count_by_area_year(spark, sf_dir):
    return fields.event_counts(normalized_events(spark, sf_dir))


@query(f"with {_EVENTS} select count(*) as n_total, count(*) filter (date_state = 'valid' and place_state = 'valid') as n_valid, count(*) - count(*) filter (date_state = 'valid' and place_state = 'valid') as n_excluded, (count(*) - count(*) filter (date_state = 'valid' and place_state = 'valid'))::double / count(*) as missingness from events_")
def event_missingness(spark, sf_dir):
    return fields.event_quality(normalized_events(spark, sf_dir))


@query(f"with {_DENOMINATOR} select year, municipality_cod6, population, 'Population' as carrier, 'person_years' as unit, 'municipality' as geography_basis, 'imported_population_fixture' as denominator_source, 'imported_fixture' as provenance from den")
def population_denominator(spark, sf_dir):
    return fields.population_denominator(population_table(spark, sf_dir))


@query(f"with {_POPULATION} select count(*) as n_total, count(*) filter ({_BAD_PEOPLE}) as n_invalid, sum(population) filter ({_VALID_PEOPLE}) as n_denom, count(distinct (year, municipality_cod6)) filter ({_VALID_PEOPLE}) as n_keys, count(*) filter ({_BAD_PEOPLE})::double / count(*) as missingness, 'imported_population_fixture' as denominator_source, 'imported_fixture' as provenance from people")
def population_excluded(spark, sf_dir):
    return fields.population_quality(population_table(spark, sf_dir)).select("n_total", "n_invalid", "n_denom", "n_keys", "missingness", "denominator_source", F.array_join("provenance", ",").alias("provenance"))


@query(f"with {_JOINED} select year, municipality_cod6, death_count, population, death_count / population as mortality_rate, death_count / population * 100000.0::double as mortality_rate_scaled, 100000.0::double as scale, 'deaths_per_100k_person_years' as unit from joined where population > 0")
def crude_rate(spark, sf_dir):
    return fields.crude_rates(*counts_and_population(spark, sf_dir))


@query(f"with {_JOINED} select year, municipality_cod6, death_count, population from joined where population is null or population <= 0")
def rate_missing_denominator(spark, sf_dir):
    return fields.without_denominator(*counts_and_population(spark, sf_dir))


@query(f"with {_JOINED} select count(*) as n_joined, count(*) filter (population is null or population <= 0) as n_missing, count(*) filter (population > 0) as n_eff, coalesce(sum(death_count) filter (population > 0), 0) as n_events, sum(population) filter (population > 0) as n_denom, count(*) filter (population is null or population <= 0)::double / count(*) as missingness from joined")
def rate_quality(spark, sf_dir):
    return fields.rate_quality(*counts_and_population(spark, sf_dir))


@query("""with labels_ as (select o_orderkey, list_filter([case when o_orderkey % 2 = 0 then 'official' end, case when o_orderkey % 3 = 0 then 'latent' end, case when o_orderkey % 5 = 0 then 'reconstructed' end, case when o_orderkey % 7 = 0 then 'something' end], lambda x: x is not null) as labels from orders)
select o_orderkey, coalesce(list_max(list_transform(labels, lambda x: case x when 'official' then 0.0::double when 'latent' then 0.8::double else 0.4::double end)), 0.4::double) as risk from labels_""")
def provenance_risk(spark, sf_dir):
    labels = F.array_compact(F.array(*(F.when(F.col("o_orderkey") % k == 0, F.lit(v)) for k, v in ((2, "official"), (3, "latent"), (5, "reconstructed"), (7, "something")))))
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.provenance_risk(labels).alias("risk"))


@query(f"with {_JOINED} select 'IBGE,SIM-DO,imported_population_fixture' as sources, 'harmonized,imported_fixture,official' as provenance, 2 as n_parents, coalesce(sum(death_count) filter (population > 0), 0) as n_events, sum(population) filter (population > 0) as n_denom from joined")
def lineage_union(spark, sf_dir):
    r = registries.Registries()
    rate = fields.compile_crude_rate(fields.compile_event_counts(normalized_events(spark, sf_dir), r), fields.compile_population(population_table(spark, sf_dir), r), r)
    f, q = rate.field, rate.q_state.metrics
    return spark.createDataFrame([(",".join(f.source), ",".join(f.provenance), len(f.lineage.parent_ids), q["n_events"], q["n_denom"])], "sources string, provenance string, n_parents int, n_events double, n_denom double")


# ---- legality and registries --------------------------------------------------------------------------------

_CARRIERS = ", ".join(f"('{n}', '{d}', '{r}')" for n, d, r in registries.CARRIER_RULES)
_UNITS = ", ".join(f"('{n}', '{d}', '{r}')" for n, d, _, roles in registries.UNIT_RULES for r in roles)
_AXES = ", ".join(f"('{s}', '{a}')" for s, a, _, _ in registries.RACE_AXES)
_CHOICES = {
    "numerator_carrier": ["Deaths", "LiveBirths", "Beds"],
    "denominator_carrier": ["Population", "LiveBirths"],
    "role": ["mortality_rate", "capacity_density", "birth_rate"],
    "numerator_unit": ["counts", "counts", "beds"],
    "denominator_unit": ["person_years", "counts", "person_years", "person_years"],
    "numerator_source": ["SIM-DO", "SINASC", None, "IBGE"],
    "denominator_source": ["IBGE", None, "IBGE"],
    "numerator_axis": [None, None, None, None, "self_declared"],
    "denominator_axis": [None, "self_declared", None],
    "bridge": [None, None, "Bridge_R"],
}


def _requests(spark: bool) -> list[str]:
    cols = [f"{_pick(v, f'(o_orderkey * {k + 3} + o_custkey)', spark)} as {n}" for k, (n, v) in enumerate(_CHOICES.items())]
    flags = [f"(o_orderkey % {m} <> 0) as {n}" for n, m in (("support", 41), ("axes", 43), ("aggregation", 47), ("provenance", 53), ("quality", 59))]
    return ["o_orderkey as request_id", *cols, *flags, "(o_orderkey % 4 = 0) as declaration_required"]


_DECLARED = "case when not declaration_required and numerator_axis is null and denominator_axis is null then 1 when coalesce(numerator_axis, a.axis) is null or coalesce(denominator_axis, b.axis) is null then 0 when coalesce(numerator_axis, a.axis) = coalesce(denominator_axis, b.axis) or bridge = 'Bridge_R' then 1 else 0 end"


@query(f"""with q as (select {", ".join(_requests(False))} from orders), c(n, d, r) as (values {_CARRIERS}), u(n, d, r) as (values {_UNITS}), x(source, axis) as (values {_AXES}),
t as (select request_id, (exists (select 1 from c where c.n = numerator_carrier and c.d = denominator_carrier and c.r = role))::int as delta_carrier, (exists (select 1 from u where u.n = numerator_unit and u.d = denominator_unit and u.r = role))::int as delta_unit,
 {_DECLARED} as delta_declaration, (support and axes and aggregation and provenance and quality) as given from q left join x a on a.source = numerator_source left join x b on b.source = denominator_source)
select request_id, delta_carrier, delta_unit, delta_declaration, (given and delta_carrier = 1 and delta_unit = 1 and delta_declaration = 1) as legal from t""")
def legality_batch(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").selectExpr(*_requests(True))
    return legality.judge_rates(requests, registries.Registries()).select("request_id", "delta_carrier", "delta_unit", "delta_declaration", "legal")


@query(f"""with q as (select {", ".join(_requests(False))} from orders), c(n, d, r) as (values {_CARRIERS}), u(n, d, r) as (values {_UNITS})
select role, count(*) as n_requests, count(distinct (numerator_carrier, denominator_carrier)) as n_pairs, role in (select r from c) as has_carriers, role in (select r from u) as has_units from q group by role""")
def registry_role_coverage(spark, sf_dir):
    requests, r = table(spark, sf_dir, "orders").selectExpr(*_requests(True)), registries.Registries()
    asked = requests.groupBy("role").agg(F.count(F.lit(1)).alias("n_requests"), F.count_distinct(F.struct("numerator_carrier", "denominator_carrier")).alias("n_pairs"))
    for name, known in (("has_carriers", registries.carrier_table(spark, r)), ("has_units", registries.unit_table(spark, r))):
        asked = asked.join(known.select("role").distinct().withColumn(name, F.lit(True)), "role", "left").fillna({name: False})
    return asked


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'fragile' else 'verified' end as state, o_orderkey % 3 <> 0 as generate_rn from orders")
def quality_permissions(spark, sf_dir):
    r = registries.Registries()
    allowed = F.broadcast(spark.createDataFrame([(s, bool(r.permissions(s)["generate_rn"])) for s in r.quality], "state string, generate_rn boolean"))
    states = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "fragile").otherwise("verified").alias("state"))
    return states.join(allowed, "state").select("o_orderkey", "state", "generate_rn")


# ---- profiles -----------------------------------------------------------------------------------------------

#: Columns of the profiled table, named so that roles apply.
_PROFILED = {"DT_EVENT": "DTOBITO", "CODMUNRES": "CODMUNRES", "CAUSABAS": "CAUSABAS", "VAL_DELAY": "DIFDATA", "SEXO": "SEXO", "CNPJ": None}


def profiled_table(spark, sf_dir):
    raw = raw_events(spark, sf_dir, *(c for c in _PROFILED.values() if c), "row_key")
    cnpj = F.when(F.col("row_key") % 2 == 0, "00000000000000").otherwise(F.lpad(F.col("row_key").cast("string"), 14, "9"))
    return raw.select(*((cnpj if c is None else F.col(c)).alias(n) for n, c in _PROFILED.items()))


_CELLS_SQL = f"{RAW}, cells as (" + " union all ".join(f"select '{n}' as \"column\", {c or '''case when row_key % 2 = 0 then '00000000000000' else lpad(row_key::varchar, 14, '9') end'''} as v from raw" for n, c in _PROFILED.items()) + ")"
_PROFILE_SQL = f"""{_CELLS_SQL}, texts as (select "column", v, {_clean_sql("v")} as t from cells), parsed as (select *, coalesce(t <> '', false) as full_, {_number_sql("replace(t, ',', '.')")} as num, {_date_sql("t")} as iso from texts),
stats as (select "column", count(*) as n_rows, count(*) filter (v is null) as n_null, count(*) filter (t = '') as n_blank, count(*) filter (full_) as n_nonblank, count(distinct v) filter (full_) as n_unique,
 coalesce(count(num) filter (full_) / nullif(count(*) filter (full_), 0)::double, 0) as numeric_parse_rate, min(num) filter (full_) as numeric_min, max(num) filter (full_) as numeric_max,
 coalesce(count(iso) filter (full_) / nullif(count(*) filter (full_), 0)::double, 0) as date_parse_rate, min(iso) filter (full_) as date_min, max(iso) filter (full_) as date_max from parsed group by 1)"""


@query(f"""with {_PROFILE_SQL} select "column", n_rows, n_null, n_blank, n_nonblank, n_unique, (n_null + n_blank) / n_rows::double as missing_rate, numeric_parse_rate, numeric_min, numeric_max, date_parse_rate, date_min, date_max from stats""")
def profile_columns(spark, sf_dir):
    names = ["column", "n_rows", "n_null", "n_blank", "n_nonblank", "n_unique", "missing_rate", "numeric_parse_rate", "numeric_min", "numeric_max", "date_parse_rate", "date_min", "date_max"]
    return profile.profile_columns(profiled_table(spark, sf_dir), sample_limit=None).select(*names)


@query(f"""with {_PROFILE_SQL} select "column", case when n_nonblank = 0 then 'empty' when date_parse_rate >= 0.8 then 'date_like' when numeric_parse_rate >= 0.95 then 'numeric_like' when n_unique / n_nonblank::double <= 0.2 or n_unique <= 30 then 'categorical_like' when numeric_parse_rate > 0.05 then 'mixed' else 'string_like' end as observed_kind from stats""")
def profile_observed_kind(spark, sf_dir):
    return profile.profile_columns(profiled_table(spark, sf_dir), sample_limit=None).select("column", "observed_kind")


@query(f"""with {_PROFILE_SQL}, lengths as (select "column", length(t)::varchar as k from parsed where full_ and regexp_full_match(t, '[0-9]+') group by all),
l as (select "column", list_sort(list('digit_length_' || k)) as ks from lengths group by 1), marks as (select "column", bool_or(t like '*%') filter (full_) as starred, bool_or(regexp_full_match(t, '0+')) filter (full_) as zeros from parsed group by 1)
select s."column", array_to_string(list_filter(list_concat(case when ks is null then [] else list_concat(['digit_code_like'], ks) end, [case when numeric_parse_rate >= 0.95 then 'numeric_like' end, case when date_parse_rate >= 0.8 then 'date_like' end, case when starred then 'contains_prefixed_asterisk_values' end, case when zeros and s."column" = 'CNPJ' then 'contains_zero_filler_identifier' end]), lambda x: x is not null), ',') as shape_flags
from stats s left join l using ("column") join marks using ("column")""")
def profile_shape_flags(spark, sf_dir):
    return profile.profile_columns(profiled_table(spark, sf_dir), sample_limit=None).select("column", F.array_join("shape_flags", ",").alias("shape_flags"))


_FIRST = 400


@query(f"""with {RAW.replace(" from orders)", ", row_number() over (order by o_orderkey) as place from orders)")}, cells as (select 'DT_EVENT' as "column", DTOBITO as v, place from raw union all select 'VAL_DELAY', DIFDATA, place from raw), texts as (select "column", place, {_clean_sql("v")} as t from cells),
first_ as (select *, row_number() over (partition by "column" order by place) as k from texts where t <> '')
select "column", count({_number_sql("replace(t, ',', '.')")}) / count(*)::double as numeric_parse_rate, count({_date_sql("t")}) / count(*)::double as date_parse_rate from first_ where k <= {_FIRST} group by 1""")
def profile_sample(spark, sf_dir):
    # the table's rows stand in the order of their keys
    raw = raw_events(spark, sf_dir, "DTOBITO", "DIFDATA").withColumnsRenamed({"DTOBITO": "DT_EVENT", "DIFDATA": "VAL_DELAY"})
    return profile.profile_columns(raw, sample_limit=_FIRST).select("column", "numeric_parse_rate", "date_parse_rate")


@query(f"""with {_CELLS_SQL}, counted as (select "column", v, count(*) as n from cells where {_clean_sql("v")} <> '' group by 1, 2) select "column", max(n) as n_most, (array_agg(n order by n desc))[1:10].list_sum()::bigint as n_top from counted group by 1""")
def profile_top_values(spark, sf_dir):
    # which of equally frequent values are listed depends on the order of rows; their counts don't
    top = profile.profile_columns(profiled_table(spark, sf_dir)).select("column", "top_values")
    return top.select("column", F.col("top_values")[0]["n"].alias("n_most"), F.expr("aggregate(top_values, 0L, (a, x) -> a + x.n)").alias("n_top"))


@query(f"""with {_CELLS_SQL} select "column", length(v)::varchar as len, count(*) as n from cells where {_clean_sql("v")} <> '' group by 1, 2""")
def profile_lengths(spark, sf_dir):
    return profile.profile_columns(profiled_table(spark, sf_dir), sample_limit=None).select("column", F.explode("value_length_distribution").alias("len", "n"))


#: Raw column names and the role that a name alone tells.
_ROLES = {"CODMUNRES": "municipality_code", "cnes_x": "facility_identifier", "CGC_HOSP": "corporate_identifier", "LINHAB": "diagnosis_or_cause_code", "PROC_REA": "procedure_code", "VAL_TOT": "monetary_or_numeric_measure", "DTOBITO": "date_or_period", "BASEDATA": "date_or_period", "SEXO": None, "CID_1": "diagnosis_or_cause_code"}


@query(f"select o_orderkey, {_pick(list(_ROLES), 'o_orderkey', False)} as name, {_pick(list(_ROLES.values()), 'o_orderkey', False)} as role from orders")
def infer_roles(spark, sf_dir):
    names = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_pick(list(_ROLES), 'o_orderkey', True)} as name")
    return names.withColumn("role", profile.name_role(F.col("name")))


@query("""with c as (select * from orders), s as (select count(*) as n, count(distinct o_orderstatus) as u, count(distinct o_orderpriority) as p from c)
select * from (values ('o_custkey', true, false, 'raw_only'), ('o_orderstatus', true, true, 'missingness_changed'), ('o_orderpriority', true, true, ''), ('o_flag', false, true, 'processed_only')) t("column", raw_present, processed_present, flags)""")
def compare_profiles(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    raw = orders.select("o_custkey", "o_orderstatus", "o_orderpriority")
    processed = orders.select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority", F.lit("x").alias("o_flag"))
    both = profile.compare_profiles(profile.profile_columns(raw), profile.profile_columns(processed))
    return both.select("column", "raw_present", "processed_present", F.array_join("flags", ",").alias("flags"))


# ---- fact cubes ---------------------------------------------------------------------------------------------

#: Series of a payload: with two periods, well below the cells that one request may ask for.
_SERIES = 5000


def _payload_number():
    return F.floor(F.col("c_custkey") / _SERIES).alias("payload_number")


_FLAT_COLUMNS = ["table_id", "variable_id", "variable_name", "unit", "period", "locality_id", "locality_name", "locality_level_id", "classification_tuple_json", "value", "value_state"]


@query(f"""with n as (select c_custkey, c_name, {_pick(CELLS, "c_custkey", False)} as v from customer) select '6579' as table_id, '9324' as variable_id, 'Population' as variable_name, 'People' as unit, '2021' as period, (2700000 + c_custkey)::varchar as locality_id, c_name as locality_name, '6' as locality_level_id,
'[{{"code": "0", "index": "4", "name": "Total"}}]' as classification_tuple_json, {_CELL[0]} as value, {_CELL[1]} as value_state from n""")
def cube_flat_explode(spark, sf_dir):
    cell = F.expr(_pick(CELLS, "c_custkey", True))
    place = (F.col("c_custkey") + 2700000).cast("string")
    pairs = [("NC", F.lit("6")), ("NN", F.lit("Municipality")), ("MN", F.lit("People")), ("V", cell), ("D1C", place), ("D1N", F.col("c_name")), ("D2C", F.lit("9324")), ("D2N", F.lit("Population")), ("D3C", F.lit("2021")), ("D3N", F.lit("2021")), ("D4C", F.lit("0")), ("D4N", F.lit("Total"))]
    rows_ = table(spark, sf_dir, "customer").select(_payload_number(), F.to_json(F.create_map(*(x for k, v in pairs for x in (F.lit(k), v)))).alias("j"))
    header = '{"NC":"Nivel (Codigo)","V":"Valor","D1C":"Municipio (Codigo)"}'
    payloads = rows_.groupBy("payload_number").agg(F.concat(F.lit(f"[{header},"), F.concat_ws(",", F.collect_list("j")), F.lit("]")).alias("payload"))
    return cube.flat_facts(payloads, "payload", "6579", ("9324",), ("2021",)).select(*_FLAT_COLUMNS)


@query("""select '1' as table_id, '93' as variable_id, 'Population' as variable_name, 'People' as unit, p as period, c_custkey::varchar as locality_id, c_name as locality_name, 'N6' as locality_level_id, '[]' as classification_tuple_json,
case p when '2020' then c_custkey * 10.0::double end as value, case p when '2020' then case when c_custkey = 0 then 'valid_zero_rounded_or_exact' else 'valid' end else 'not_available' end as value_state from customer, (select unnest(['2020', '2021']) as p)""")
def cube_nested_explode(spark, sf_dir):
    series = F.to_json(F.struct(
        F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("nome"), F.struct(F.lit("N6").alias("id"), F.lit("Municipality").alias("nome")).alias("nivel")).alias("localidade"),
        F.struct((F.col("c_custkey") * 10).cast("string").alias("2020"), F.lit("...").alias("2021")).alias("serie"),
    ))
    nested = table(spark, sf_dir, "customer").groupBy(_payload_number()).agg(F.concat_ws(",", F.collect_list(series)).alias("s"))
    payloads = nested.select(F.concat(F.lit('[{"id":"93","variavel":"Population","unidade":"People","resultados":[{"classificacoes":[],"series":['), F.col("s"), F.lit("]}]}]")).alias("payload"))
    return cube.nested_facts(payloads, "payload", "1").select(*_FLAT_COLUMNS)


_ODD = ['[{"id":"k","resultados":5}]', '[{"id":"k","resultados":[5,{"series":"x"}]}]', '[{"id":"k","resultados":[{"series":[1,{"localidade":1}]}]}]', '[7,{"id":"k","resultados":[{"series":[{"localidade":{},"serie":{"2020":"1"}}]}]}]']


@query("""select code, count(*) as n from (select unnest(case c_custkey % 4 when 0 then ['unexpected_resultados_type:k'] when 1 then ['unexpected_result_type:k', 'unexpected_series_type:k'] when 2 then ['unexpected_series_item_type:k', 'unexpected_locality_or_serie_type:k'] else ['unexpected_variable_block_type'] end) as code from customer) group by 1""")
def cube_nested_warnings(spark, sf_dir):
    payloads = table(spark, sf_dir, "customer").select(F.expr(_pick(_ODD, "c_custkey", True)).alias("payload"))
    return cube.nested_warnings(payloads, "payload").groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def _facts_columns(spark: bool) -> list[str]:
    text = "string" if spark else "varchar"
    year = "date_format(l_shipdate, 'yyyy')" if spark else "strftime(l_shipdate, '%Y')"
    key = "(l_orderkey * 7 + l_linenumber)"
    return [
        f"cast(l_linenumber % 2 as {text}) as table_id", f"cast(l_linenumber % 3 as {text}) as variable_id", f"case when l_orderkey % 29 = 0 then null when l_orderkey % 31 = 0 then 'n/a' else {year} end as period",
        f"case when l_orderkey % 37 = 0 then null else cast(2700000 + l_suppkey % 50 as {text}) end as locality_id", f"cast(l_suppkey as {text}) as locality_name", f"{_pick(['6', '6', '3', None], key, spark)} as locality_level_id", f"{_pick(CELLS, key, spark)} as v",
    ]


_FACTS = f"facts as (select * exclude (v), {_CELL[0]} as value, {_CELL[1]} as value_state from (select {', '.join(_facts_columns(False))} from lineitem))"
_GOOD = "period is not null and locality_id is not null and value is not null and starts_with(value_state, 'valid')"


def facts_table(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").selectExpr(*_facts_columns(True)).withColumn("c", P.parse_cube_value(F.col("v")))
    return cells.select("table_id", "variable_id", "period", "locality_id", "locality_name", "locality_level_id", F.col("c.value").alias("value"), F.col("c.state").alias("value_state"))


@query(f"""with {_FACTS}, n as (select count(*) as a, count(*) filter (table_id = '1') as b, count(*) filter (table_id = '1' and variable_id = '2') as c, count(*) filter (table_id = '1' and variable_id = '2' and locality_level_id = '6') as d, count(*) filter (table_id = '1' and variable_id = '2' and locality_level_id = '6' and {_GOOD}) as e from facts)
select a as n_input_facts, b as n_after_table, c as n_after_variable, d as n_after_level, e as n_after_value_state, a - b as excluded_by_table, b - c as excluded_by_variable, c - d as excluded_by_level, d - e as excluded_by_value_state from n""")
def facts_funnel(spark, sf_dir):
    return cube.facts_funnel(facts_table(spark, sf_dir), "1", "2")


@query(f"with {_FACTS} select case when regexp_full_match(period, '[0-9]+') then period::int end as year, locality_id as municipality_cod7, left(locality_id, 6) as municipality_cod6, value as population, 'valid' as population_state, 'SIDRA_population' as denominator_source, 'official' as provenance, table_id || ':' || variable_id as sidra_measure_id, locality_name as municipality_name from facts where table_id = '1' and locality_level_id = '6' and {_GOOD}")
def facts_to_denominator(spark, sf_dir):
    return cube.facts_to_denominator(facts_table(spark, sf_dir), "1")


@query(f"with {_FACTS} select coalesce(locality_level_id, 'None') as value, count(*) as n from facts group by 1")
def facts_value_counts(spark, sf_dir):
    return rows.value_counts(facts_table(spark, sf_dir), "locality_level_id")


@query(f"with {_FACTS} select table_id, variable_id, period, locality_id, count(*) as n from facts group by 1, 2, 3, 4 having count(*) > 1")
def facts_duplicates(spark, sf_dir):
    return rows.duplicate_keys(facts_table(spark, sf_dir), cube.MEASURE_KEYS)


@query(f"with {_FACTS} select count(*) as n_rows, count(distinct table_id) as n_unique_tables, count(distinct variable_id) as n_unique_variables, count(distinct period) + (count(*) filter (period is null) > 0)::bigint as n_unique_periods, count(distinct locality_id) + (count(*) filter (locality_id is null) > 0)::bigint as n_unique_localities, count(*) filter (value is null) as n_null_value, count(*) filter (starts_with(value_state, 'valid')) as n_valid_value from facts")
def facts_diagnostics(spark, sf_dir):
    return cube.facts_diagnostics(facts_table(spark, sf_dir))


# ---- catalog ------------------------------------------------------------------------------------------------


def _catalog(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.sha2(F.col("n_name"), 256).alias("field_id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "fragile").otherwise("verified").alias("state"), F.concat(F.lit("fields/"), "n_name").alias("path"))


@query("select sha256(n_name) as field_id, n_name as name, case when n_regionkey = 0 then 'fragile' else 'verified' end as state, 'fields/' || n_name as path from nation where n_nationkey = 7")
def field_point_lookup(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").where("n_nationkey = 7").select(F.sha2("n_name", 256)).first()[0]
    row = bundle.point_lookup(_catalog(spark, sf_dir), wanted)
    return spark.createDataFrame([tuple(row.values())], "field_id string, name string, state string, path string")


@query("select sha256(c_name) as field_id, c_name as name, case when c_mktsegment = 'BUILDING' then 'fragile' else 'verified' end as state from customer")
def field_listing(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.sha2("c_name", 256).alias("field_id"), F.col("c_name").alias("name"), F.lit("verified").alias("state"), "c_mktsegment")
    catalog = _bundle(spark)
    catalog.upsert("V_fields", people.drop("c_mktsegment"))
    catalog.upsert("V_fields", people.where("c_mktsegment = 'BUILDING'").withColumn("state", F.lit("fragile")).drop("c_mktsegment"))
    return catalog.fields().select("field_id", "name", "state")


@query("""select c_custkey, sha256('{"child_field_id":"' || c_custkey || '","operator":"RN","operator_params":{"scale":100000.0},"parent_field_id":"' || c_nationkey || '","registry_versions":{}}') as edge_id from customer""")
def lineage_edges(spark, sf_dir):
    ids = bundle.edge_ids(F.col("c_nationkey"), F.col("c_custkey"), F.lit("RN"), F.lit('{"scale":100000.0}'), F.lit("{}"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), ids.alias("edge_id"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
