import pytest
from pyspark.sql import functions as F

from vitalgrid.functions import parsers as P


def parsed(spark, f, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["p"] for r in df.select("k", f(F.col("v")).alias("p")).orderBy("k").collect()]


def test_dates(spark):
    got = parsed(spark, P.parse_date, ["20220131", "00000000", "not-a-date", None, " ", "31/12/1999", "1999-02-30", "2020-02-29 23:59:59", "270430", "0000-01-01", "na"])
    assert [(r["normalized"], r["state"]) for r in got] == [
        ("2022-01-31", "valid"), (None, "invalid"), (None, "unparseable"), (None, "missing"), (None, "blank"), ("1999-12-31", "valid"), (None, "unparseable"),
        ("2020-02-29", "valid"), ("0430-07-02", "valid"), (None, "unparseable"), (None, "blank"),
    ]
    assert got[1]["warnings"] == ["invalid_date_placeholder:00000000"] and got[2]["warnings"] == ["date_unparseable:not-a-date"] and got[0]["warnings"] == []


def test_icd10(spark):
    got = parsed(spark, P.parse_icd10, ["I219", "", "*A419", "R99", "U071", "*", " k70 0", None, "C50", "I21.9"])
    assert [(r["normalized"], r["state"]) for r in got] == [
        ("I21.9", "valid"), (None, "blank"), ("A41.9", "valid"), ("R99", "ill_defined"), ("U07.1", "unparseable"), (None, "blank"), ("K70.0", "valid"), (None, "missing"), ("C50", "valid"), ("I21.9", "valid"),
    ]
    assert got[2]["warnings"] == ["icd_prefixed_asterisk"] and got[3]["warnings"] == ["icd10_ill_defined:R99"] and got[4]["warnings"] == ["icd10_shape_unparseable:U07.1"]


def test_ages(spark):
    got = parsed(spark, P.parse_age, ["4035", "3006", "9001", "5003", "2012", "1045", "4", None, "NULL"])
    assert [(r["age_years"], r["state"]) for r in got[:4]] == [(35.0, "valid"), (0.5, "valid"), (None, "invalid"), (103.0, "valid")]
    assert got[4]["age_days"] == 12 / 24 and got[5]["age_days"] == 45 / (24 * 60) and got[5]["age_years"] == 45 / (24 * 60) / 365.25
    assert [r["state"] for r in got[6:]] == ["unparseable", "missing", "blank"]
    assert got[2]["warnings"] == ["age_unit_invalid:9"]


def test_municipalities(spark):
    got = parsed(spark, P.parse_municipality, ["270430", "2704302", "123", "", None, "27.0430-2"])
    assert [(r["cod6"], r["cod7"], r["state"]) for r in got] == [("270430", None, "valid"), ("270430", "2704302", "valid"), (None, None, "invalid"), (None, None, "blank"), (None, None, "missing"), ("270430", "2704302", "valid")]


def test_categories(spark):
    got = parsed(spark, lambda c: P.parse_categorical(c, ("1", "2"), ("9",), ("8",)), ["1", "7", "9", "8", "", None])
    assert [(r["normalized"], r["state"]) for r in got] == [("1", "valid"), ("7", "invalid"), ("9", "unknown"), ("8", "not_applicable"), (None, "blank"), (None, "missing")]
    assert got[1]["warnings"] == ["categorical_value_not_in_registry:7"]
    assert parsed(spark, P.parse_categorical, ["x"])[0]["state"] == "valid"


def test_numbers(spark):
    got = parsed(spark, P.parse_numeric, ["1,25", "1_000", "1d", "inf", "-Infinity", "5.", ".5", "1__0", "", None, "1e3", "+nan"])
    values = [r["normalized"] for r in got]
    assert values[:2] == [1.25, 1000.0] and values[2] is None and values[3:7] == [float("inf"), float("-inf"), 5.0, 0.5] and values[7] is None and values[10] == 1000.0
    assert values[11] != values[11]
    assert [r["state"] for r in got[7:10]] == ["unparseable", "blank", "missing"]


@pytest.mark.parametrize(
    ("text", "value", "state"),
    [(None, None, "missing"), ("", None, "blank"), ("-", 0.0, "valid_zero_absolute"), ("0", 0.0, "valid_zero_rounded_or_exact"), ("...", None, "not_available"), ("..", None, "not_applicable"), ("x", None, "inhibited"), ("1.031.597", 1031597.0, "valid"), ("12,5", 12.5, "valid"), ("1.5", 15.0, "valid"), ("abc", None, "unparseable")],
)
def test_cube_values(spark, text, value, state):
    got = parsed(spark, P.parse_cube_value, [text])[0]
    assert (got["value"], got["state"]) == (value, state)


def test_age_resolution(spark):
    df = spark.createDataFrame([("2020-01-01", "2000-01-01", "4035"), ("2020-01-01", "2021-01-01", "4035"), (None, "2000-01-01", "9001")], "d string, b string, a string")
    got = [r["r"] for r in df.select(P.resolve_age(F.col("d"), F.col("b"), P.parse_age(F.col("a"))).alias("r")).collect()]
    assert (got[0]["age_days"], got[0]["source"]) == (7305.0, "date_difference")
    assert (got[1]["age_years"], got[1]["warnings"]) == (35.0, ["birth_date_after_death_date"])
    assert (got[2]["state"], got[2]["age_years"]) == ("invalid", None)


def test_shapes_and_printable_ends_change_nothing(spark):
    """Dates by shape are those of the patterns in their order, and trimming by ends is that of the pattern."""
    import random

    rng = random.Random(8)
    dates = ["1/2/2020", "31/12/1999", "2020-2-30", "0000-01-01", "20201301", "13012020", "2020123", "1112020", "202011", "2020-1-5 7:05:09", "2020-01-05\t\t23:59:61", "2020/1-5", "٢٠٢٠-01-05"]
    texts = [None, "", "ﬀ", "\x1f20200105", " n/a", "NuLL "] + dates
    texts += ["".join(rng.choice("0123456789") for _ in range(rng.randint(5, 9))) for _ in range(3000)]
    texts += [rng.choice("-/").join([str(rng.randint(0, 33)).zfill(2), str(rng.randint(0, 14)), str(rng.randint(0, 2100)).zfill(4)][:: rng.choice([1, -1])]) for _ in range(3000)]
    texts += ["".join(rng.choice("0129-/: \t\u00a0é") for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    trimmed = F.regexp_replace("t", P._EDGES, "")
    slow = F.when(F.upper(trimmed).isin(*P.BLANK_TEXTS), F.lit("")).otherwise(trimmed)
    by_patterns = F.when(~F.col("t").isin(*P.DATE_PLACEHOLDERS), P._by_patterns(F.col("t"), P.DATE_PATTERNS).cast("string"))
    pairs = ((P.clean(F.col("t")), slow), (P.text_to_date(F.col("t")), by_patterns))
    for got, want in pairs:
        assert df.where(~got.eqNullSafe(want)).collect() == []
