"""Legality of a rate: eight yes-or-no terms that must all hold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.plans.registries import Registries, carrier_table, race_axis_table, unit_table

TERMS = ("support", "axes", "carrier", "unit", "aggregation", "provenance", "quality", "declaration")
BRIDGE = "Bridge_R"


@dataclass(frozen=True)
class RateRequest:
    numerator_carrier: str
    denominator_carrier: str
    role: str
    numerator_unit: str
    denominator_unit: str
    numerator_source: str | None = None
    denominator_source: str | None = None
    numerator_axis: str | None = None
    denominator_axis: str | None = None
    declaration_required: bool = False
    bridge: str | None = None
    support: bool = True
    axes: bool = True
    aggregation: bool = True
    provenance: bool = True
    quality: bool = True


@dataclass(frozen=True)
class Verdict:
    terms: dict[str, int]
    warnings: list[str] = field(default_factory=list)

    @property
    def legal(self) -> bool:
        return all(self.terms.values())

    @property
    def failed_terms(self) -> list[str]:
        return [f"delta_{t}" for t in TERMS if not self.terms[t]]


def judge_rate(request: RateRequest, registries: Registries) -> Verdict:
    """One request, on the driver: the gate in front of a rate's plan."""
    r, warnings = request, []
    terms = {t: int(getattr(r, t)) for t in ("support", "axes", "aggregation", "provenance", "quality")}
    terms["carrier"] = int(registries.carrier_legal(r.numerator_carrier, r.denominator_carrier, r.role))
    if not terms["carrier"]:
        warnings.append(f"carrier_incompatible:{r.numerator_carrier}/{r.denominator_carrier}->{r.role}")
    terms["unit"] = int(registries.unit_legal(r.numerator_unit, r.denominator_unit, r.role))
    if not terms["unit"]:
        warnings.append(f"unit_incompatible:{r.numerator_unit}/{r.denominator_unit}->{r.role}")
    terms["declaration"], more = _declaration(r, registries)
    return Verdict(terms, warnings + more)


def _declaration(r: RateRequest, registries: Registries) -> tuple[int, list[str]]:
    if not r.declaration_required and r.numerator_axis is None and r.denominator_axis is None:
        return 1, []
    above = r.numerator_axis or registries.race_axis(r.numerator_source)
    below = r.denominator_axis or registries.race_axis(r.denominator_source)
    if above is None or below is None:
        return 0, [f"race_axis_required_but_unresolved:numerator={above}; denominator={below}"]
    if above == below:
        return 1, []
    if r.bridge == BRIDGE:
        return 1, [f"race_axis_bridge_applied:{above}->self_declared via {BRIDGE}"]
    return 0, [f"race_axis_noncommensurable:numerator={above}; denominator={below}; {BRIDGE} required"]


def judge_rates(requests: DataFrame, registries: Registries) -> DataFrame:
    """A table of requests with ``delta_*`` terms and ``legal``: joins with the rule tables.

    The rule tables are some dozens of rows, fixed by the registries' files.
    """
    spark = requests.sparkSession
    carriers = F.broadcast(carrier_table(spark, registries).withColumn("_c", F.lit(1)).distinct())
    units = F.broadcast(unit_table(spark, registries).drop("output_unit").withColumn("_u", F.lit(1)).distinct())
    axis = race_axis_table(spark, registries)
    above = F.broadcast(axis.select(F.col("source_system").alias("numerator_source"), F.col("race_axis").alias("_above")))
    below = F.broadcast(axis.select(F.col("source_system").alias("denominator_source"), F.col("race_axis").alias("_below")))
    df = requests.join(carriers, ["numerator_carrier", "denominator_carrier", "role"], "left").join(units, ["numerator_unit", "denominator_unit", "role"], "left")
    df = df.join(above, "numerator_source", "left").join(below, "denominator_source", "left")
    a, b = F.coalesce("numerator_axis", "_above"), F.coalesce("denominator_axis", "_below")
    free = ~F.col("declaration_required") & F.col("numerator_axis").isNull() & F.col("denominator_axis").isNull()
    declared = F.when(free, 1).when(a.isNull() | b.isNull(), 0).when((a == b) | F.col("bridge").eqNullSafe(F.lit(BRIDGE)), 1).otherwise(0)
    given = {f"delta_{t}": F.col(t).cast("int") for t in ("support", "axes", "aggregation", "provenance", "quality")}
    terms = given | {"delta_carrier": F.coalesce("_c", F.lit(0)), "delta_unit": F.coalesce("_u", F.lit(0)), "delta_declaration": declared}
    out = df.withColumns(terms)
    return out.withColumn("legal", F.least(*(F.col(f"delta_{t}") for t in TERMS)) == 1).select(*requests.columns, *(f"delta_{t}" for t in TERMS), "legal")
