"""Scalar parsers as Column expressions.

Each returns a struct that keeps the state of a value apart from the value:
``missing`` (null or NaN), ``blank``, ``invalid``, ``unparseable`` and so on
never turn into a default. All of it is built-in expressions, so it stays in
generated code and works alike on batch and streaming tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as blank, and dates that are placeholders.
BLANK_TEXTS = ("", "NA", "N/A", "NULL", "NONE", "NAN")
DATE_PLACEHOLDERS = ("00000000", "0000-00-00", "00/00/0000", "99999999", "9999-99-99", "0")
#: Shape of a code, and prefixes of ill-defined causes.
ICD_SHAPE = r"^[A-TV-Z][0-9][0-9A-Z](?:\.?[0-9A-Z]{1,2})?\z"
ILL_DEFINED = ("R95", "R96", "R97", "R98", "R99")
#: Days of a month and of a year.
MONTH_DAYS, YEAR_DAYS = 30.4375, 365.25

_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"
_YEAR, _MONTH, _DAY = "([0-9]{4})", "(1[0-2]|0[1-9]|[1-9])", "(3[0-1]|[1-2][0-9]|0[1-9]|[1-9])"
_CLOCK = r"\s+(?:2[0-3]|[0-1][0-9]|[0-9]):(?:[0-5][0-9]|[0-9]):(?:6[0-1]|[0-5][0-9]|[0-9])"
#: Patterns in the order in which they are tried, with the groups of year, month and day.
DATE_PATTERNS = (
    (f"^{_YEAR}-{_MONTH}-{_DAY}\\z", (1, 2, 3)),
    (f"^{_YEAR}-{_MONTH}-{_DAY}{_CLOCK}\\z", (1, 2, 3)),
    (f"^{_DAY}/{_MONTH}/{_YEAR}\\z", (3, 2, 1)),
    (f"^{_DAY}-{_MONTH}-{_YEAR}\\z", (3, 2, 1)),
    (f"^{_YEAR}/{_MONTH}/{_DAY}\\z", (1, 2, 3)),
    (f"^{_YEAR}{_MONTH}{_DAY}\\z", (1, 2, 3)),
    (f"^{_DAY}{_MONTH}{_YEAR}\\z", (3, 2, 1)),
)

TEXTS = T.ArrayType(T.StringType())


def no_warnings() -> Column:
    return F.array().cast(TEXTS)


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def once(c: Column, f) -> Column:
    """``f(c)`` with ``c`` evaluated a single time. Takes the projection out of the one fused method, whose size is limited."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def clean(c: Column, floating: bool = False) -> Column:
    """Text without white space at its ends; blank tokens are ``""``, null (and NaN if ``floating``) is null."""
    if floating:
        c = F.when(~F.isnan(c), c)
    text = c.cast("string")
    text = F.when(_printable(text) & _printable(F.right(text, F.lit(1))), text).otherwise(F.regexp_replace(text, _EDGES, ""))
    short = F.octet_length(text) <= max(map(len, BLANK_TEXTS))
    return F.when(short & F.upper(text).isin(*BLANK_TEXTS), F.lit("")).otherwise(text)


def _printable(text: Column) -> Column:
    """Begins with a visible ASCII character: most cells do at both ends and need no pattern."""
    return (text >= F.lit("!")) & (text < F.lit("\x7f"))


def _states(t: Column, rest: Column) -> Column:
    """``missing`` and ``blank`` first, then ``rest``."""
    return F.when(t.isNull(), F.lit("missing")).when(t == "", F.lit("blank")).otherwise(rest)


def _only(t: Column, c: Column) -> Column:
    """``c`` where the text is neither missing nor blank."""
    return F.when(t.isNotNull() & (t != ""), c)


def parse_categorical(c: Column, valid: tuple[str, ...] | None = None, unknown: tuple[str, ...] = (), not_applicable: tuple[str, ...] = (), cleaned: bool = False) -> Column:
    """struct(normalized, state, warnings); values outside the registry are kept but invalid."""
    t = c if cleaned else clean(c)
    kind = F.when(t.isin(*not_applicable), F.lit("not_applicable")) if not_applicable else None
    if unknown:
        kind = (F if kind is None else kind).when(t.isin(*unknown), F.lit("unknown"))
    if valid is not None:
        kind = (F if kind is None else kind).when(~t.isin(*valid), F.lit("invalid"))
    state = _states(t, F.lit("valid") if kind is None else kind.otherwise("valid"))
    warnings = F.when(state == "invalid", F.array(F.concat(F.lit("categorical_value_not_in_registry:"), t))).otherwise(no_warnings())
    return F.struct(_only(t, t).alias("normalized"), state.alias("state"), warnings.alias("warnings"))


def text_to_double(t: Column) -> Column:
    """A decimal number as Python's ``float`` reads it (digit groups by ``_``, inf and nan in any case), else null."""
    digits = r"[0-9]+(?:_[0-9]+)*"
    plain = rf"^[+-]?(?:{digits}(?:\.(?:{digits})?)?|\.{digits})(?:[eE][+-]?{digits})?\z"
    special = F.lower(t)
    return (
        F.when(t.rlike(plain), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
        .when(~F.contains(special, F.lit("n")), _null("double"))  # no word below is without one
        .when(special.rlike(r"^[+]?inf(?:inity)?\z"), F.lit(float("inf")))
        .when(special.rlike(r"^-inf(?:inity)?\z"), F.lit(float("-inf")))
        .when(special.rlike(r"^[+-]?nan\z"), F.lit(float("nan")))
    )


def comma_number(t: Column) -> Column:
    return text_to_double(F.replace(t, F.lit(","), F.lit(".")))


def parse_numeric(c: Column, cleaned: bool = False, number: Column | None = None) -> Column:
    """struct(normalized double, state, warnings); a comma is a decimal point. ``number``: as for dates."""
    if not cleaned:
        return once(clean(c), lambda t: parse_numeric(t, True, number))
    if number is None:
        return once(comma_number(c), lambda x: parse_numeric(c, True, x))
    t = c
    state = _states(t, F.when(number.isNull(), F.lit("unparseable")).otherwise("valid"))
    warnings = F.when(state == "unparseable", F.array(F.concat(F.lit("numeric_unparseable:"), t))).otherwise(no_warnings())
    return F.struct(_only(t, number).alias("normalized"), state.alias("state"), warnings.alias("warnings"))


def _shapes(*orders: tuple[str, str, str]) -> list[str]:
    return [f"{a}{sep}{b}{sep}{c}" for a, b, c in orders for sep in "-/"]


#: Digits of the fields of a date with year or day first, as shapes: every digit is a 9.
_YEAR_FIRST = _shapes(*(("9999", m, d) for m in ("9", "99") for d in ("9", "99")))
_DAY_FIRST = _shapes(*((d, m, "9999") for m in ("9", "99") for d in ("9", "99")))


def date_shape(t: Column) -> Column:
    """The text with every digit as 9: what decides how a date is cut."""
    return F.translate(t, "0123456789", "9" * 10)


def _by_patterns(t: Column, patterns: tuple) -> Column:
    tries = []
    for pattern, (y, m, d) in patterns:
        known = pattern.replace(_YEAR, "((?!0000)[0-9]{4})")
        tries.append(F.when(t.rlike(known), F.regexp_replace(t, known, f"${y}-${m}-${d}").try_cast("date")))
    return F.coalesce(*tries)


def text_to_date(t: Column, shape: Column | None = None) -> Column:
    """ISO text of the first pattern that gives a real date, else null; placeholders give none.

    A text's shape picks the only patterns that can fit; fields of fixed width are cut by position, and only
    rare shapes (six or seven digits, a time of day) are matched. ``shape``: ``date_shape`` of the text, if there is a column of it.
    """
    shape = date_shape(t) if shape is None else shape
    cut = lambda *places: F.concat_ws("-", *(F.substring(t, a, n) for a, n in places))
    dated = lambda iso: F.when(~F.startswith(iso, F.lit("0000")), iso.try_cast("date"))
    dashed = F.translate(t, "/", "-")
    day_first = F.concat_ws("-", F.right(t, F.lit(4)), F.split_part(dashed, F.lit("-"), F.lit(2)), F.split_part(dashed, F.lit("-"), F.lit(1)))
    day = (
        F.when(shape == "9" * 8, F.coalesce(dated(cut((1, 4), (5, 2), (7, 2))), dated(cut((5, 4), (3, 2), (1, 2)))))
        .when(shape.isin(*_YEAR_FIRST), dated(dashed))
        .when(shape.isin(*_DAY_FIRST), dated(day_first))
        .when(shape.isin("9" * 6, "9" * 7), _by_patterns(t, DATE_PATTERNS[5:]))
        .when(F.startswith(shape, F.lit("9999-")) & F.contains(shape, F.lit(":")), _by_patterns(t, DATE_PATTERNS[1:2]))
    )
    return F.when(~t.isin(*DATE_PLACEHOLDERS), day.cast("string"))


def parse_date(c: Column, cleaned: bool = False, iso: Column | None = None) -> Column:
    """struct(normalized ISO text, state, warnings). ``iso``: ``text_to_date`` of the cleaned text, if there is a column of it."""
    if not cleaned:
        return once(clean(c), lambda t: parse_date(t, True, iso))
    if iso is None:
        return once(text_to_date(c), lambda x: parse_date(c, True, x))
    t = c
    state = _states(t, F.when(t.isin(*DATE_PLACEHOLDERS), F.lit("invalid")).when(iso.isNull(), F.lit("unparseable")).otherwise("valid"))
    mark = F.when(t.isNull() | (t == "") | iso.isNotNull(), None).when(t.isin(*DATE_PLACEHOLDERS), F.lit("invalid_date_placeholder:")).otherwise("date_unparseable:")
    return F.struct(iso.alias("normalized"), state.alias("state"), F.array_compact(F.array(F.concat(mark, t))).alias("warnings"))


def icd_text(t: Column) -> Column:
    """A cleaned code in upper case, without a leading asterisk and blanks, with its point."""
    up = F.upper(t)
    stripped = F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(up, _EDGES, ""), r"^\*", ""), _EDGES, ""), F.lit(" "), F.lit(""))
    bare = F.when(F.rtrim(up, F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.")) == "", up).otherwise(stripped)
    return F.when((F.length(bare) > 3) & ~F.contains(bare, F.lit(".")), F.concat(F.substring(bare, 1, 3), F.lit("."), F.substring(bare, 4, 1 << 30))).otherwise(bare)


def parse_icd10(c: Column, cleaned: bool = False, code: Column | None = None) -> Column:
    """struct(normalized, state, warnings); an unparseable code keeps its text. ``code``: ``icd_text`` of the cleaned text, if there is a column of it."""
    if not cleaned:
        return once(clean(c), lambda t: parse_icd10(t, True, code))
    if code is None:
        return once(icd_text(c), lambda x: parse_icd10(c, True, x))
    t = c
    bad = ~code.rlike("(?i)" + ICD_SHAPE)
    ill = F.substring(F.replace(code, F.lit("."), F.lit("")), 1, 3).isin(*ILL_DEFINED)
    state = _states(code, F.when(bad, F.lit("unparseable")).when(ill, F.lit("ill_defined")).otherwise("valid"))
    starred = F.when(F.startswith(F.upper(t), F.lit("*")), F.lit("icd_prefixed_asterisk"))
    shape = F.when(code == "", None).when(bad, F.concat(F.lit("icd10_shape_unparseable:"), code)).when(ill, F.concat(F.lit("icd10_ill_defined:"), code))
    return F.struct(_only(code, code).alias("normalized"), state.alias("state"), F.array_compact(F.array(starred, shape)).alias("warnings"))


def only_digits(t: Column) -> Column:
    """The digits of a text; one that has nothing else needs no pattern."""
    return F.when(F.rtrim(t, F.lit("0123456789")) == "", t).otherwise(F.regexp_replace(t, r"[^0-9]", ""))


def parse_age(c: Column, cleaned: bool = False) -> Column:
    """struct(age_years, age_days, state, source, warnings) of a unit digit followed by an amount."""
    if not cleaned:
        return once(clean(c), lambda t: parse_age(t, True))
    return once(F.struct(c.alias("t"), only_digits(c).alias("digits")), lambda x: _decoded_age(x["t"], x["digits"]))


def _decoded_age(t: Column, digits: Column) -> Column:
    unit, amount = F.substring(digits, 1, 1), F.substring(digits, 2, 1 << 30).try_cast("double")
    short = F.length(digits) < 2
    state = _states(t, F.when(short, F.lit("unparseable")).when(~unit.isin("1", "2", "3", "4", "5"), F.lit("invalid")).otherwise("valid"))
    good = state == "valid"
    minutes, hours = amount / F.lit(24.0 * 60), amount / F.lit(24.0)
    old = amount + F.lit(100.0)
    days = F.when(unit == "1", minutes).when(unit == "2", hours).when(unit == "3", amount * F.lit(MONTH_DAYS)).when(unit == "4", amount * F.lit(YEAR_DAYS)).otherwise(old * F.lit(YEAR_DAYS))
    years = F.when(unit == "1", minutes / F.lit(YEAR_DAYS)).when(unit == "2", hours / F.lit(YEAR_DAYS)).when(unit == "3", amount / F.lit(12.0)).when(unit == "4", amount).otherwise(old)
    warnings = (
        F.when(state == "unparseable", F.array(F.concat(F.lit("age_unparseable:"), t)))
        .when(state == "invalid", F.array(F.concat(F.lit("age_unit_invalid:"), unit)))
        .otherwise(no_warnings())
    )
    return F.struct(F.when(good, years).alias("age_years"), F.when(good, days).alias("age_days"), state.alias("state"), F.lit("datasus_idade").alias("source"), warnings.alias("warnings"))


def parse_municipality(c: Column, cleaned: bool = False) -> Column:
    """struct(cod6, cod7, state, warnings) by the number of digits alone."""
    if not cleaned:
        return once(clean(c), lambda t: parse_municipality(t, True))
    t, digits = c, only_digits(c)
    n = F.length(digits)
    state = _states(t, F.when(n.isin(6, 7), F.lit("valid")).otherwise("invalid"))
    warnings = F.when(state == "invalid", F.array(F.concat(F.lit("municipality_code_invalid_shape:"), t))).otherwise(no_warnings())
    good = state == "valid"
    return F.struct(F.when(good, F.substring(digits, 1, 6)).alias("cod6"), F.when(good & (n == 7), digits).alias("cod7"), state.alias("state"), warnings.alias("warnings"))


def resolve_age(death_iso: Column, birth_iso: Column, age: Column) -> Column:
    """struct(age_years, age_days, state, source, warnings): the dates' difference, else the decoded age."""
    days = F.datediff(death_iso.try_cast("date"), birth_iso.try_cast("date"))
    return once(F.struct(days.alias("days"), age.alias("age")), lambda x: _by_days(x["days"], x["age"]))


def _by_days(days: Column, age: Column) -> Column:
    by_dates = F.coalesce(days >= 0, F.lit(False))
    value = days.cast("double")
    late = F.when(days < 0, F.lit("birth_date_after_death_date"))
    warnings = F.when(by_dates, no_warnings()).otherwise(F.concat(F.array_compact(F.array(late)), age["warnings"]))
    return F.struct(
        F.when(by_dates, value / F.lit(YEAR_DAYS)).otherwise(age["age_years"]).alias("age_years"),
        F.when(by_dates, value).otherwise(age["age_days"]).alias("age_days"),
        F.when(by_dates, F.lit("valid")).otherwise(age["state"]).alias("state"),
        F.when(by_dates, F.lit("date_difference")).otherwise(age["source"]).alias("source"),
        warnings.alias("warnings"),
    )


def parse_cube_value(c: Column) -> Column:
    """struct(value double, state) of a statistical office's cell: marks for zero, absence and secrecy.

    A point groups thousands and a comma is the decimal point.
    """
    t = F.regexp_replace(c.cast("string"), _EDGES, "")
    number = text_to_double(F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    state = (
        F.when(t.isNull(), F.lit("missing"))
        .when(t == "", F.lit("blank"))
        .when(t == "-", F.lit("valid_zero_absolute"))
        .when(t == "0", F.lit("valid_zero_rounded_or_exact"))
        .when(t == "...", F.lit("not_available"))
        .when(t == "..", F.lit("not_applicable"))
        .when(F.upper(t) == "X", F.lit("inhibited"))
        .when(number.isNull(), F.lit("unparseable"))
        .otherwise("valid")
    )
    value = F.when(state.isin("valid_zero_absolute", "valid_zero_rounded_or_exact"), F.lit(0.0)).when(state == "valid", number)
    return F.struct(value.alias("value"), state.alias("state"))
