"""Three-valued screening and eligibility."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import COMPLETE

KEYS = ["grid_id", "design_id", "scenario_id"]


@dataclass(frozen=True)
class Requirement:
    """One screening rule on one metric of the long evidence table."""

    requirement_id: str
    metric: str
    operator: str  # ge or le
    threshold: float | None
    unit: str
    critical: bool = True
    informational: bool = False
    statuses: tuple[str, ...] = ("observed", "calculated")
    sources: tuple[str, ...] | None = None
    minimum_coverage: float = 1.0
    needs_method: bool = True


def requirement_table(spark, requirements: Sequence[Requirement]) -> DataFrame:
    rows = [(r.requirement_id, r.metric, r.operator, r.threshold, r.unit, r.critical, r.informational, list(r.statuses), list(r.sources) if r.sources else None, r.minimum_coverage, r.needs_method) for r in requirements]
    schema = "requirement_id string, metric string, operator string, threshold double, required_unit string, critical boolean, informational boolean, statuses array<string>, sources array<string>, minimum_coverage double, needs_method boolean"
    return spark.createDataFrame(rows, schema)


def screen(evidence: DataFrame, requirements: DataFrame) -> DataFrame:
    """One row an evidence row and requirement: PASS, FAIL or UNKNOWN with the first reason that applies.

    A unit other than the required one is an error of the data, not a screening result.
    """
    r = F.broadcast(requirements)  # a rule list, written by hand
    both = evidence.join(r, "metric")
    passes = F.when(F.col("operator") == "ge", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    calculated = (F.col("status") == "calculated") & F.col("needs_method") & F.col("method").isNull()
    unit_error = (F.col("unit") != F.col("required_unit")) & F.lit(True)
    reason = (
        F.when(F.col("informational"), "informational")
        .when(F.col("threshold").isNull(), "threshold_missing")
        .when(F.col("value").isNull() | (F.col("status") == "unknown"), "value_unknown")
        .when(~F.array_contains("statuses", F.col("status")), "status_not_accepted")
        .when(F.col("sources").isNotNull() & ~F.coalesce(F.array_contains("sources", F.col("source_id")), F.lit(False)), "source_not_accepted")
        .when(calculated, "undocumented_calculation")
        .when(F.coalesce(F.col("coverage"), F.lit(0.0)) + COMPLETE < F.col("minimum_coverage"), "partial_coverage")
        .when(unit_error, F.raise_error(F.concat(F.lit("unit mismatch for "), F.col("metric"))).cast("string"))
    )
    out = both.withColumn("reason", reason)
    return out.withColumn("result", F.when(F.col("reason").isNotNull(), "UNKNOWN").when(passes, "PASS").otherwise("FAIL"))


def eligibility(screened: DataFrame, keys: Sequence[str], mode: str = "STRICT") -> DataFrame:
    """Per alternative: hard_fail, critical_unknown, eligible, conditional."""
    rolled = screened.groupBy(*keys).agg(
        F.bool_or((F.col("result") == "FAIL") & F.col("critical") & ~F.col("informational")).alias("hard_fail"),
        F.bool_or((F.col("result") == "UNKNOWN") & F.col("critical") & ~F.col("informational")).alias("critical_unknown"),
    )
    return rolled.withColumns(eligibility_columns(F.col("hard_fail"), F.col("critical_unknown"), mode))


def eligibility_columns(hard_fail: Column, unknown: Column, mode: str) -> dict[str, Column]:
    if mode == "STRICT":
        return {"eligible": ~hard_fail & ~unknown, "conditional": F.lit(False)}
    return {"eligible": ~hard_fail, "conditional": ~hard_fail & unknown}


def with_reasons(df: DataFrame, rules: Sequence[tuple[str, Column]], name: str = "reasons") -> DataFrame:
    """All reasons that apply to a row, in rule order, and whether there is none."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for text, c in rules]))
    return df.withColumn(name, found).withColumn("accepted", F.size(name) == 0)


def exclusion_counts(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Counts by the first rule that excludes a row (mutually exclusive), in one pass."""
    reason = F.lit("kept")
    for text, c in reversed(list(rules)):
        reason = F.when(F.coalesce(c, F.lit(False)), text).otherwise(reason)
    return df.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def land_gate(members: DataFrame, keys: Sequence[str], minimum_km2: float) -> DataFrame:
    """Region land: null-strict sum; null is UNKNOWN (kept and flagged), too little is FAIL."""
    total = F.when(F.count("land_km2") == F.count("*"), F.sum("land_km2"))
    out = members.groupBy(*keys).agg(total.alias("land_km2"), F.count("*").alias("n_cells"))
    status = F.when(F.col("land_km2").isNull(), "UNKNOWN").when(F.col("land_km2") >= minimum_km2, "PASS").otherwise("FAIL")
    return out.withColumn("land_status", status).withColumn("kept", F.col("land_status") != "FAIL")
