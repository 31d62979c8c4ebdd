"""Field compilers: event counts, denominators and crude rates over year and area.

Each has a lazy table expression of its own (``event_counts``,
``population_denominator``, ``crude_rates``), a one-row quality aggregate, and
a compiler that puts both together with lineage and warnings. A compiler reads its
input once: what a row of the field's table stands for, rows that are lost among it, is
grouped first; quality is observed on these groups while they are written, in the
last stage, whose tasks count once however often executors are lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from vitalgrid.operators.legality import RateRequest, judge_rate
from vitalgrid.plans.contracts import CompiledField, FieldNode, Lineage, WarningRecord, compiled
from vitalgrid.plans.registries import OTHER_RISK, PROVENANCE_RISK, Registries
from vitalgrid.schemas import require
from vitalgrid.sources.files import scratch_folder

KEYS = ["year", "municipality_cod6"]
#: A share of lost rows from which a field is fragile, and a warning severe.
COUNT_LIMIT, DENOMINATOR_LIMIT, SEVERE = 0.10, 0.05, 0.20
COUNT_RISK = RATE_RISK = 0.20
SCALE = 100_000.0


def missing_share(lost: Column, total: Column) -> Column:
    """Lost over total; all is lost where there is nothing."""
    return F.coalesce(F.try_divide(lost.cast("double"), total.cast("double")), F.lit(1.0))


def valid_event(geography: str = "residence") -> Column:
    state, code = F.col(f"mun_{geography}_state"), F.col(f"mun_{geography}_cod6")
    return F.coalesce((F.col("death_date_state") == "valid") & (state == "valid"), F.lit(False)) & F.col("death_date").isNotNull() & code.isNotNull()


def computed_once(df: DataFrame, *columns: str) -> DataFrame:
    """These columns behind a generator of one row: filters and projections above aren't merged into what computes them."""
    return df.select(F.inline(F.array(F.struct(*columns))))


def _placed_events(events: DataFrame, geography: str) -> DataFrame:
    """Year and area of every event; both null where the event doesn't count."""
    columns = ("death_date", "death_date_state", f"mun_{geography}_cod6", f"mun_{geography}_state")
    require(events, set(columns), "the table of events")
    valid = valid_event(geography)
    year, area = F.substring("death_date", 1, 4).cast("int"), F.col(columns[2])
    return computed_once(events, *columns).select(valid.alias("valid"), F.when(valid, year).alias("year"), F.when(valid, area).alias("municipality_cod6"))


def _count_columns(geography: str) -> list[Column | str]:
    return [F.lit("SIM-DO").alias("source_system"), F.lit(f"municipality_{geography}").alias("geography_basis"), *KEYS, "death_count"]


def event_counts(events: DataFrame, geography: str = "residence") -> DataFrame:
    """Events per year and area; rows without a valid date and area don't count. Sorted by both."""
    counts = _placed_events(events, geography).where("valid").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("death_count"))
    return counts.select(*_count_columns(geography)).orderBy(*KEYS)


def event_quality(events: DataFrame, geography: str = "residence") -> DataFrame:
    """One row: total, valid and excluded events, and the missing share."""
    sums = _placed_events(events, geography).agg(F.count(F.lit(1)).alias("n_total"), F.count(F.when(F.col("valid"), 1)).alias("n_valid"))
    lost = F.col("n_total") - F.col("n_valid")
    return sums.select("n_total", "n_valid", lost.alias("n_excluded"), missing_share(lost, F.col("n_total")).alias("missingness"))


def written_with_metrics(groups: DataFrame, keep: Column, columns: list[Column | str], path: str, **metrics: Column) -> tuple[DataFrame, Row]:
    """Write those of ``groups`` that ``keep`` holds for; the table as read back, and ``metrics`` over all groups from the same run."""
    seen = Observation()
    kept = groups.observe(seen, *(c.alias(name) for name, c in metrics.items())).where(keep).select(*columns)
    kept.write.mode("overwrite").parquet(path)
    return groups.sparkSession.read.schema(kept.schema).parquet(path), Row(**{name: seen.get.get(name) for name in metrics})


def _table_path(df: DataFrame, path: str | None, name: str) -> str:
    return path or scratch_folder(df.sparkSession, name)


def _lost_warning(lost: int, total: int, share: float, code: str, source: str, what: str) -> list[WarningRecord]:
    if not lost:
        return []
    return [WarningRecord(source=source, severity="warning" if share < SEVERE else "severe", code=code, message=f"{lost}/{total} {what}")]


def compile_event_counts(events: DataFrame, registries: Registries, geography: str = "residence", path: str | None = None) -> CompiledField:
    """The field's table, written to ``path`` (else to the shared scratch folder) in the run that measures its quality."""
    groups = _placed_events(events, geography).groupBy("valid", *KEYS).agg(F.count(F.lit(1)).alias("death_count")).orderBy(*KEYS)
    n, good, place = F.col("death_count"), F.col("valid"), _table_path(events, path, "event-counts")
    data, seen = written_with_metrics(groups, good, _count_columns(geography), place, n_total=F.sum(n), n_valid=F.sum(F.when(good, n)))
    q = {k: seen[k] or 0 for k in ("n_total", "n_valid")}
    q |= {"n_excluded": q["n_total"] - q["n_valid"]}
    q |= {"missingness": q["n_excluded"] / q["n_total"] if q["n_total"] else 1.0}
    basis = f"municipality_{geography}"
    warnings = _lost_warning(q["n_excluded"], q["n_total"], q["missingness"], "sim_events_excluded_from_count", "compile_event_counts", "events were left out: their date or area is missing or invalid.")
    state = "verified" if q["n_valid"] and q["missingness"] < COUNT_LIMIT else "fragile"
    lineage = Lineage("event_count", {"source_system": "SIM-DO", "event": "death", "geography": geography, "geo_basis": basis, "time_axis": "year", "measure": "death_count"}, registries.hashes())
    node = FieldNode(
        name=f"SIM-DO death count by {basis} and year", kind="extensive_measure", carrier="Deaths", unit="counts",
        support={"time": "year", "geography": basis, "spatial_code": "municipality_cod6"}, axes={"T": "year", "S*": basis}, aggregation="additive",
        role=["outcome", "death_numerator"], source=["SIM-DO"], operator="event_count", provenance=["official", "harmonized"],
        state=state, dashboard_safe=True if state == "verified" else "warning", lineage=lineage, warnings=[w.code for w in warnings],
    )
    n = float(q["n_valid"])
    return compiled(node, data, {"n_events": n, "n_eff": n, "missingness": q["missingness"], "provenance_risk": COUNT_RISK}, warnings)


def _population(table: DataFrame, source_label: str) -> DataFrame:
    require(table, {*KEYS, "population"}, "the population table")
    either = lambda name, default: F.col(name).cast("string") if name in table.columns else F.lit(default)
    return table.select(
        F.col("year").try_cast("int").alias("year"), F.col("municipality_cod6").cast("string").alias("municipality_cod6"), F.col("population").try_cast("double").alias("population"),
        either("population_state", "valid").alias("population_state"), either("denominator_source", source_label).alias("denominator_source"), either("provenance", "imported_fixture").alias("provenance"),
    )


def _usable() -> tuple[Column, Column]:
    """Valid and invalid rows; they aren't complements: a null state is neither, unless something else is wrong."""
    known = F.col("year").isNotNull() & F.col("municipality_cod6").isNotNull() & F.col("population").isNotNull()
    return known & (F.col("population") > 0) & (F.col("population_state") == "valid"), ~known | (F.col("population") <= 0) | (F.col("population_state") != "valid")


def population_denominator(table: DataFrame, source_label: str = "imported_population_fixture") -> DataFrame:
    """Population per year and area from valid rows; labels of the row that is read first. Sorted by both."""
    rows = _population(table, source_label).where(_usable()[0]).withColumn("_at", F.monotonically_increasing_id())
    sums = rows.groupBy(*KEYS).agg(F.sum("population").alias("population"), F.min_by("denominator_source", "_at").alias("denominator_source"), F.min_by("provenance", "_at").alias("provenance"))
    return sums.select(*_population_columns()).orderBy(*KEYS)


def _population_columns() -> list[Column | str]:
    return [*KEYS, "population", F.lit("Population").alias("carrier"), F.lit("person_years").alias("unit"), F.lit("municipality").alias("geography_basis"), "denominator_source", "provenance"]


def _population_groups(table: DataFrame, source_label: str) -> DataFrame:
    """Valid rows by year and area, all others in one group, with what both the table and its quality need."""
    good, bad = _usable()
    rows = _population(table, source_label).withColumn("_at", F.monotonically_increasing_id())
    rows = rows.select(F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(bad, F.lit(False)).alias("bad"), *KEYS, "population", "denominator_source", "provenance", "_at")
    keys = [F.when(F.col("good"), F.col(k)).alias(k) for k in KEYS]
    named = F.col("denominator_source").isNotNull()
    return rows.groupBy("good", *keys).agg(
        F.sum("population").alias("population"), F.min_by("denominator_source", "_at").alias("denominator_source"), F.min_by("provenance", "_at").alias("provenance"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad"), F.collect_set("provenance").alias("labels"),
        F.min(F.when(named, F.struct("_at", "denominator_source"))).alias("first"),
    )


def population_quality(table: DataFrame, source_label: str = "imported_population_fixture") -> DataFrame:
    """One row: totals, keys, the first source, the sorted provenance labels and the missing share."""
    rows = _population(table, source_label).withColumn("_at", F.monotonically_increasing_id())
    good, bad = _usable()
    out = rows.agg(
        F.count(F.lit(1)).alias("n_total"), F.count(F.when(bad, 1)).alias("n_invalid"), F.sum(F.when(good, F.col("population"))).alias("n_denom"),
        F.count_distinct(F.when(good, F.struct(*KEYS))).alias("n_keys"),
        F.min_by(F.when(good, F.col("denominator_source")), F.when(good & F.col("denominator_source").isNotNull(), F.col("_at"))).alias("denominator_source"),
        F.array_sort(F.collect_set(F.when(good, F.col("provenance")))).alias("provenance"),
    )
    return out.withColumn("missingness", missing_share(F.col("n_invalid"), F.col("n_total")))


def provenance_risk(labels: Column) -> Column:
    """The largest risk of an array of labels; 0.4 for labels that are unknown and for none at all."""
    risks = F.create_map(*(x for k, v in PROVENANCE_RISK.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.array_max(F.transform(labels, lambda x: F.coalesce(F.try_element_at(risks, x), F.lit(OTHER_RISK)))), F.lit(OTHER_RISK))


def compile_population(table: DataFrame, registries: Registries, source_label: str = "imported_population_fixture", path: str | None = None) -> CompiledField:
    """As for counts. The set of labels that is observed is as small as the labels are few."""
    good, place = F.col("good"), _table_path(table, path, "population")
    data, seen = written_with_metrics(
        _population_groups(table, source_label).orderBy(*KEYS), good, _population_columns(), place,
        n_total=F.sum("n"), n_invalid=F.sum("n_bad"), n_denom=F.sum(F.when(good, F.col("population"))), n_keys=F.count(F.when(good, 1)),
        first=F.min(F.when(good, F.col("first"))), provenance=F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(good, F.col("labels")))))),
    )
    q = {k: seen[k] or 0 for k in ("n_total", "n_invalid", "n_keys")} | {"n_denom": seen["n_denom"], "provenance": seen["provenance"]}
    q |= {"denominator_source": seen["first"]["denominator_source"] if seen["first"] else None, "missingness": q["n_invalid"] / q["n_total"] if q["n_total"] else 1.0}
    source, provenance = q["denominator_source"] or source_label, q["provenance"] or ["imported_fixture"]
    warnings = _lost_warning(q["n_invalid"], q["n_total"], q["missingness"], "population_rows_excluded", "compile_population", "population rows were left out: year, area, population or its state is missing or invalid.")
    state = "verified" if q["n_keys"] and q["missingness"] < DENOMINATOR_LIMIT else "fragile"
    params = {"source_label": source, "geography": "municipality", "time_axis": "year", "carrier": "Population", "unit": "person_years", "provenance": provenance}
    node = FieldNode(
        name=f"{source} population denominator by municipality and year", kind="extensive_measure", carrier="Population", unit="person_years",
        support={"time": "year", "geography": "municipality", "spatial_code": "municipality_cod6"}, axes={"T": "year", "S*": "municipality"}, aggregation="additive",
        role=["exposure_offset", "denominator", "population"], source=["IBGE", source], operator="import_population_denominator", provenance=provenance,
        state=state, dashboard_safe=True if state == "verified" else "warning", lineage=Lineage("import_population_denominator", params, registries.hashes()), warnings=[w.code for w in warnings],
    )
    risk = max(PROVENANCE_RISK.get(p, OTHER_RISK) for p in provenance)
    metrics = {"n_denom": q["n_denom"], "n_eff": float(q["n_keys"]), "missingness": q["missingness"], "denom_fragility": q["missingness"], "provenance_risk": risk}
    return compiled(node, data, metrics, warnings)


def joined_rates(counts: DataFrame, population: DataFrame) -> DataFrame:
    """Numerators with their denominator, if any. Both sides are aggregated before they meet."""
    require(counts, {*KEYS, "death_count"}, "the table of counts")
    require(population, {*KEYS, "population"}, "the population table")
    side = lambda df, value: df.select(F.col("year").try_cast("int").alias("year"), F.col("municipality_cod6").cast("string").alias("municipality_cod6"), F.col(value).try_cast("double").alias(value))
    return side(counts, "death_count").join(side(population, "population"), KEYS, "left")


def crude_rates(counts: DataFrame, population: DataFrame, scale: float = SCALE) -> DataFrame:
    """Rates where there is a positive denominator, sorted by year and area."""
    return joined_rates(counts, population).where(_has_people()).select(*_rate_columns(scale)).orderBy(*KEYS)


def _has_people() -> Column:
    return F.col("population").isNotNull() & (F.col("population") > 0)


def _rate_columns(scale: float) -> list[Column | str]:
    rate = F.col("death_count") / F.col("population")
    return [*KEYS, "death_count", "population", rate.alias("mortality_rate"), (rate * F.lit(scale)).alias("mortality_rate_scaled"), F.lit(scale).alias("scale"), F.lit("deaths_per_100k_person_years").alias("unit")]


def without_denominator(counts: DataFrame, population: DataFrame) -> DataFrame:
    """Numerators whose denominator is absent or not positive."""
    return joined_rates(counts, population).where(F.col("population").isNull() | (F.col("population") <= 0))


def rate_quality(counts: DataFrame, population: DataFrame) -> DataFrame:
    """One row: joined rows, rows that lack a denominator, sums over the rest, and the missing share."""
    good = _has_people()
    bad = F.col("population").isNull() | (F.col("population") <= 0)
    out = joined_rates(counts, population).agg(
        F.count(F.lit(1)).alias("n_joined"), F.count(F.when(bad, 1)).alias("n_missing"), F.count(F.when(good, 1)).alias("n_eff"),
        F.coalesce(F.sum(F.when(good, F.col("death_count"))), F.lit(0.0)).alias("n_events"), F.sum(F.when(good, F.col("population"))).alias("n_denom"),
    )
    return out.withColumn("missingness", missing_share(F.col("n_missing"), F.col("n_joined")))


def compile_crude_rate(counts: CompiledField, population: CompiledField, registries: Registries, scale: float = SCALE, path: str | None = None) -> CompiledField:
    """As for counts, from two fields. Legality is judged before any plan is built; an illegal rate raises ValueError."""
    above, below = counts.field, population.field
    verdict = judge_rate(RateRequest(above.carrier, below.carrier, "mortality_rate", above.unit, below.unit, (above.source or [None])[0], (below.source or [None])[0]), registries)
    if not verdict.legal:
        raise ValueError(f"illegal rate: {verdict.failed_terms}; {verdict.warnings}")
    good, n = _has_people(), F.lit(1)
    data, seen = written_with_metrics(
        joined_rates(counts.data, population.data).orderBy(*KEYS), good, _rate_columns(scale), _table_path(counts.data, path, "crude-rate"),
        n_joined=F.count(n), n_eff=F.count(F.when(good, n)), n_events=F.sum(F.when(good, F.col("death_count"))), n_denom=F.sum(F.when(good, F.col("population"))),
    )
    q = {k: seen[k] or 0 for k in ("n_joined", "n_eff")} | {"n_events": seen["n_events"] or 0.0, "n_denom": seen["n_denom"]}
    q |= {"n_missing": q["n_joined"] - q["n_eff"]}
    q |= {"missingness": q["n_missing"] / q["n_joined"] if q["n_joined"] else 1.0}
    warnings = _lost_warning(q["n_missing"], q["n_joined"], q["missingness"], "mortality_rate_rows_missing_denominator", "compile_crude_rate", "counts were left out: they have no valid denominator.")
    states = {above.state, below.state}
    state = "illegal_excluded" if "illegal_excluded" in states else "fragile" if "fragile" in states or q["missingness"] >= DENOMINATOR_LIMIT else "verified"
    inherited, safe = registries.inherited({*above.provenance, *below.provenance}, set(above.source), "mortality_rate")
    params = {"role": "mortality_rate", "scale": scale, "formula": "death_count / population * scale", "join_axes": KEYS}
    node = FieldNode(
        name="Crude mortality rate by municipality and year", kind="intensive_density", carrier="Deaths/Population", unit="deaths_per_100k_person_years",
        support={"time": "year", "geography": "municipality", "spatial_code": "municipality_cod6"}, axes={"T": "year", "S*": "municipality"}, aggregation="rate_requires_numerator_denominator",
        role=["outcome", "mortality_rate"], source=sorted({*above.source, *below.source}), operator="RN", provenance=sorted({*above.provenance, *below.provenance}),
        state=state, dashboard_safe=safe if safe is not True else True if state == "verified" else "warning", lineage=Lineage("RN", params, registries.hashes(), [above.id, below.id]), warnings=verdict.warnings + inherited + [w.code for w in warnings],
    )
    risk = above.provenance.count("latent") * 0.8 if "latent" in node.provenance else RATE_RISK
    metrics = {"n_events": q["n_events"], "n_denom": q["n_denom"], "n_eff": float(q["n_eff"]), "missingness": q["missingness"], "denom_fragility": q["missingness"], "provenance_risk": risk}
    return compiled(node, data, metrics, warnings)
