"""Column profiles of a whole table in a fixed number of jobs, and their comparison.

The table is turned into (column, value) rows once and grouped by column and
value; parsing then runs once per distinct value, whatever its count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.functions import parsers as P
from vitalgrid.sources.files import scratch_folder

#: Parse rates and length histograms come from the first so many non-blank values of a column.
SAMPLE_LIMIT = 100_000
TOP_VALUES = 10
#: Shares from which a column counts as dates, numbers or categories.
DATE_SHARE, NUMERIC_SHARE, CATEGORY_SHARE, CATEGORY_VALUES, MIXED_SHARE = 0.80, 0.95, 0.20, 30, 0.05
#: Column names and what they say about a column, tried in this order.
ROLE_RULES = (
    ("municipality_code", ("CODMUNRES", "CODMUNOCOR", "CODMUNNASC", "CODUFMUN", "MUNIC_RES", "MUNIC_MOV"), (), ()),
    ("facility_identifier", ("CNES", "CODESTAB", "CO_CNES"), ("CNES_",), ()),
    ("corporate_identifier", (), (), ("CNPJ", "CGC")),
    ("diagnosis_or_cause_code", ("CAUSABAS", "CAUSABAS_O", "DIAG_PRINC", "DIAG_SECUN", "CODANOMAL"), ("CID_", "LINHA"), ()),
    ("procedure_code", (), ("PROC_",), ()),
    ("monetary_or_numeric_measure", (), ("VAL_",), ()),
    ("date_or_period", (), ("DT",), ("DATA", "DATE")),
)


def name_role(name: Column) -> Column:
    """The role that a column's name suggests, or null."""
    up, out = F.upper(name), None
    for role, equal, starts, holds in ROLE_RULES:
        test = F.lit(False)
        if equal:
            test = test | up.isin(*equal)
        for x in starts:
            test = test | F.startswith(up, F.lit(x))
        for x in holds:
            test = test | F.contains(up, F.lit(x))
        out = (F if out is None else out).when(test, F.lit(role))
    return out


def observed_kind(n_nonblank: Column, n_unique: Column, numeric_rate: Column, date_rate: Column) -> Column:
    share = F.try_divide(n_unique.cast("double"), n_nonblank.cast("double"))
    return (
        F.when(n_nonblank == 0, F.lit("empty"))
        .when(date_rate >= DATE_SHARE, F.lit("date_like"))
        .when(numeric_rate >= NUMERIC_SHARE, F.lit("numeric_like"))
        .when((share <= CATEGORY_SHARE) | (n_unique <= CATEGORY_VALUES), F.lit("categorical_like"))
        .when(numeric_rate > MIXED_SHARE, F.lit("mixed"))
        .otherwise("string_like")
    )


def unpivot_values(df: DataFrame) -> DataFrame:
    """(column, kind, part, idx, value) of every cell, the value as text."""
    tagged = df.withColumn("_at", F.monotonically_increasing_id())
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("kind"), F.col(f"`{c}`").cast("string").alias("value")) for c, t in df.dtypes))
    return tagged.select(F.col("_at").alias("idx"), F.shiftright("_at", 33).alias("part"), F.explode(cells).alias("x")).select("x.column", "x.kind", "part", "idx", "x.value")


def distinct_values(df: DataFrame, sample_limit: int | None = SAMPLE_LIMIT) -> DataFrame:
    """(column, kind, value, text, n, n_sampled, first) per distinct value of a column; ``first`` is where it first stands.

    The first ``sample_limit`` non-blank values of a column end in one partition,
    which the partitions' counts tell; only there are values ranked, and the
    place of the last one decides for all others.
    """
    text = P.clean(F.col("value"))
    cells = unpivot_values(df).withColumn("text", text).withColumn("full", F.col("text").isNotNull() & (F.col("text") != ""))
    if sample_limit is None:
        sampled = F.col("full")
    else:
        counts = cells.where("full").groupBy("column", "part").agg(F.count(F.lit(1)).alias("m"))
        upto = F.sum("m").over(Window.partitionBy("column").orderBy("part"))
        reached = counts.withColumn("upto", upto).where(F.col("upto") >= sample_limit)
        border = reached.groupBy("column").agg(F.min(F.struct("part", (F.col("upto") - F.col("m")).alias("base"))).alias("b"))
        border = F.broadcast(border.select(F.col("column").alias("_c"), F.col("b.part").alias("_p"), F.col("b.base").alias("_base")))  # a row for each column
        inside = cells.where("full").join(border, (F.col("column") == F.col("_c")) & (F.col("part") == F.col("_p")))
        ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("idx")))
        cut = ranked.where(F.col("rank") + F.col("_base") == sample_limit).select(F.col("column").alias("_c"), F.col("idx").alias("_cut"))
        cells = cells.join(F.broadcast(cut), F.col("column") == F.col("_c"), "left")
        sampled = F.col("full") & (F.col("_cut").isNull() | (F.col("idx") <= F.col("_cut")))
    return cells.groupBy("column", "kind", "value", "text").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(sampled, 1)).alias("n_sampled"), F.min("idx").alias("first"))


def _histogram(values: DataFrame, key: Column, name: str) -> DataFrame:
    counted = values.select("column", key.cast("string").alias("k"), "n_sampled").where(F.col("k").isNotNull() & (F.col("n_sampled") > 0))
    sums = counted.groupBy("column", "k").agg(F.sum("n_sampled").alias("m"))
    return sums.groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "m")))).alias(name))


def profile_columns(df: DataFrame, sample_limit: int | None = SAMPLE_LIMIT, top_values: int = TOP_VALUES) -> DataFrame:
    """One row per column with counts, rates, ranges, histograms, flags, role, kind and warnings.

    Distinct values are found once and written, four small aggregates read them; only values of the sample are parsed.
    """
    seen, path = F.col("n_sampled") > 0, scratch_folder(df.sparkSession, "distinct-values")
    number, date = (F.when(seen, P.once(F.col("text"), f)) for f in (P.comma_number, P.text_to_date))
    found = distinct_values(df, sample_limit).withColumns({"full": F.col("text").isNotNull() & (F.col("text") != ""), "number": number, "date": date})
    found.write.parquet(path)
    values = df.sparkSession.read.schema(found.schema).parquet(path)
    digits = F.col("text").rlike(r"^[0-9]+\z")
    stats = values.groupBy("column", "kind").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.coalesce(F.sum(F.when(F.col("text") == "", F.col("n"))), F.lit(0)).alias("n_blank"),
        F.count(F.when(F.col("full"), 1)).alias("n_unique"), F.sum("n_sampled").alias("sampled"),
        F.coalesce(F.sum(F.when(F.col("number").isNotNull(), F.col("n_sampled"))), F.lit(0)).alias("numbers"), F.min(F.when(seen, F.col("number"))).alias("numeric_min"), F.max(F.when(seen, F.col("number"))).alias("numeric_max"),
        F.coalesce(F.sum(F.when(F.col("date").isNotNull(), F.col("n_sampled"))), F.lit(0)).alias("dates"), F.min(F.when(seen, F.col("date"))).alias("date_min"), F.max(F.when(seen, F.col("date"))).alias("date_max"),
        F.coalesce(F.bool_or(seen & F.startswith("text", F.lit("*"))), F.lit(False)).alias("starred"), F.coalesce(F.bool_or(seen & F.col("text").rlike(r"^0+\z")), F.lit(False)).alias("zeros"),
    )
    ranked = values.where("full").withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "first"))).where(F.col("rank") <= top_values)
    top = ranked.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias("top_values"))
    stats = stats.join(_histogram(values, F.when(digits, F.length("text")), "digit_lengths"), "column", "left").join(_histogram(values.where("full"), F.length("value"), "value_length_distribution"), "column", "left").join(top, "column", "left")
    rate = lambda n, of: F.coalesce(F.try_divide(n.cast("double"), of.cast("double")), F.lit(0.0))
    full = F.col("n_rows") - F.col("n_null") - F.col("n_blank")
    out = stats.withColumns({"n_blank_or_null": F.col("n_null") + F.col("n_blank"), "n_nonblank": full, "numeric_parse_rate": rate(F.col("numbers"), F.col("sampled")), "date_parse_rate": rate(F.col("dates"), F.col("sampled")), "name_based_role": name_role(F.col("column"))})
    out = out.withColumns({"missing_rate": rate(F.col("n_blank_or_null"), F.col("n_rows")), "unique_rate": rate(F.col("n_unique"), F.col("n_nonblank")), "observed_kind": observed_kind(F.col("n_nonblank"), F.col("n_unique"), F.col("numeric_parse_rate"), F.col("date_parse_rate"))})
    lengths = F.array_sort(F.map_keys("digit_lengths"))  # as text, so 14 stands before 6
    flag = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(P.no_warnings())
    flags = F.concat(
        F.when(F.col("digit_lengths").isNotNull(), F.concat(F.array(F.lit("digit_code_like")), F.transform(lengths, lambda x: F.concat(F.lit("digit_length_"), x)))).otherwise(P.no_warnings()),
        flag(F.col("numeric_parse_rate") >= NUMERIC_SHARE, "numeric_like"), flag(F.col("date_parse_rate") >= DATE_SHARE, "date_like"),
        flag(F.col("starred"), "contains_prefixed_asterisk_values"), flag((F.col("name_based_role") == "corporate_identifier") & F.col("zeros"), "contains_zero_filler_identifier"),
    )
    out = out.withColumn("shape_flags", flags)
    role, has = F.col("name_based_role"), lambda x: F.array_contains("shape_flags", x)
    warnings = F.concat(
        flag((role == "date_or_period") & (F.col("date_parse_rate") < DATE_SHARE) & (F.col("n_nonblank") > 0), "date_named_column_low_date_parse_rate"),
        flag((role == "municipality_code") & ~(has("digit_length_6") | has("digit_length_7")), "municipality_named_column_unexpected_digit_shape"),
        flag((role == "corporate_identifier") & has("contains_zero_filler_identifier"), "corporate_identifier_zero_filler_present"),
    )
    return out.select(
        "column", F.col("kind").alias("dtype_observed"), "n_rows", "n_null", "n_blank", "n_blank_or_null", "missing_rate", "n_nonblank", "n_unique", "unique_rate", "top_values",
        "numeric_parse_rate", "numeric_min", "numeric_max", "date_parse_rate", "date_min", "date_max", "digit_lengths", "value_length_distribution", "shape_flags", "name_based_role", "observed_kind", warnings.alias("warnings"),
    )


def compare_profiles(raw: DataFrame, processed: DataFrame, missing_delta: float = 0.05, unique_delta: float = 0.50) -> DataFrame:
    """One row per column of either profile: presence, both sides' figures, flags and warnings."""
    names = {"dtype_observed": "dtype", "missing_rate": "missing_rate", "n_unique": "n_unique", "observed_kind": "observed_kind", "n_nonblank": "n_nonblank"}
    side = lambda df, p: df.select(F.col("column").alias(f"{p}_column"), *(F.col(a).alias(f"{p}_{b}") for a, b in names.items()))
    both = side(raw, "raw").join(side(processed, "processed"), F.col("raw_column") == F.col("processed_column"), "full_outer")
    r, p = (lambda c: F.col(f"raw_{c}")), (lambda c: F.col(f"processed_{c}"))
    in_raw, in_processed = r("column").isNotNull(), p("column").isNotNull()
    common = in_raw & in_processed
    change = F.abs(p("n_unique") - r("n_unique")) / F.when(r("n_unique") > 0, r("n_unique").cast("double"))
    tests = [
        ("raw_only", ~in_processed, F.lit("raw_column_absent_from_processed")),
        ("processed_only", ~in_raw, F.lit("processed_column_absent_from_raw")),
        ("dtype_changed", common & (r("dtype") != p("dtype")), F.lit(None)),
        ("missingness_changed", common & (F.abs(p("missing_rate") - r("missing_rate")) >= missing_delta), F.format_string("missingness_changed:raw=%.4f;processed=%.4f", r("missing_rate"), p("missing_rate"))),
        ("cardinality_changed", common & (change >= unique_delta), F.format_string("cardinality_changed:raw=%d;processed=%d", r("n_unique"), p("n_unique"))),
        ("observed_kind_changed", common & (r("observed_kind") != p("observed_kind")), F.format_string("observed_kind_changed:raw=%s;processed=%s", r("observed_kind"), p("observed_kind"))),
        ("fewer_nonblank_but_more_unique", common & (p("n_nonblank") < r("n_nonblank")) & (p("n_unique") > r("n_unique")), F.lit("processed_not_simple_decode_inspect")),
    ]
    pick = lambda what: F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name) if what == "flag" else warning.cast("string")) for name, test, warning in tests)))
    shown = [F.col(f"{s}_{c}") for c in ("dtype", "missing_rate", "n_unique", "observed_kind") for s in ("raw", "processed")]
    return both.select(F.coalesce("raw_column", "processed_column").alias("column"), in_raw.alias("raw_present"), in_processed.alias("processed_present"), *shown, pick("flag").alias("flags"), pick("warning").alias("warnings"))


def row_count_warnings(raw_rows: int, processed_rows: int) -> list[str]:
    return [f"row_count_changed:raw={raw_rows};processed={processed_rows}"] if raw_rows != processed_rows else []
