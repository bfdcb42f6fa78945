"""Lifecycle inventories and temporal scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregates

#: Kilograms of a mass unit, cubic metres of a volume unit, pieces of a count unit.
UNITS = [("mass", "kg", 1.0), ("mass", "t", 1000.0), ("mass", "short_ton", 907.18474), ("mass", "lb", 0.45359237), ("volume", "m3", 1.0), ("volume", "l", 0.001), ("volume", "yd3", 0.764554857984), ("count", "each", 1.0)]


def unit_table(spark) -> DataFrame:
    return spark.createDataFrame(UNITS, "family string, unit string, factor double")


def material_emissions(items: DataFrame, factors: DataFrame, units: DataFrame) -> DataFrame:
    """quantity * factor where both are of one unit family and cover the same modules; else null with the reason."""
    u = F.broadcast(units)  # a fixed list
    own = u.select(F.col("unit"), F.col("family").alias("family"), F.col("factor").alias("scale"))
    per = u.select(F.col("unit").alias("per_unit"), F.col("family").alias("per_family"), F.col("factor").alias("per_scale"))
    out = items.join(own, "unit", "left").join(factors.join(per, "per_unit", "left"), "material", "left")
    same = F.array_sort("modules").eqNullSafe(F.array_sort("factor_modules"))
    reason = F.when(F.col("kg_per_unit").isNull(), "factor_missing").when(F.col("quantity").isNull(), "quantity_missing").when(~F.col("family").eqNullSafe(F.col("per_family")), "unit_family").when(~same, "modules_differ")
    return out.withColumn("reason", reason).withColumn("kg", F.when(F.col("reason").isNull(), F.col("quantity") * F.col("scale") / F.col("per_scale") * F.col("kg_per_unit")))


def freight(items: DataFrame, modes: DataFrame) -> DataFrame:
    """mass * distance * factor of the mode; an unknown mode is an error, not a zero."""
    out = items.join(modes, "mode", "left")
    factor = F.coalesce(F.col("kg_per_t_km"), F.raise_error(F.concat(F.lit("unknown mode "), F.col("mode"))).cast("double"))
    return out.withColumn("kg", F.col("mass_kg") / 1000.0 * F.col("km") * factor)


def roll_up(items: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    return aggregates.component_rollup(items, keys, required)


def annual_rows(alternatives: DataFrame, opening: int, years: int, extended: bool) -> DataFrame:
    """One row a year; without extension only the opening year has values, later ones are unknown."""
    out = alternatives.withColumn("year", F.explode(F.sequence(F.lit(opening), F.lit(opening + years - 1))))
    known = F.lit(extended) | (F.col("year") == opening)
    return out.withColumn("carbon_kg", F.when(known, F.col("carbon_kg"))).withColumn("value_status", F.when(known & F.col("carbon_kg").isNotNull(), "scenario").otherwise("unknown"))


def window_rows(alternatives: DataFrame, windows: Sequence[tuple[str, int, int]]) -> DataFrame:
    """Values of a source's own period: one row a period, never interpolated."""
    periods = F.array(*[F.struct(F.lit(n).alias("period"), F.lit(a).alias("period_start_year"), F.lit(b).alias("period_end_year")) for n, a, b in windows])
    return alternatives.withColumn("__p", F.explode(periods)).select(*alternatives.columns, "__p.*")


def electricity_lifetime(annual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null as soon as one year is unknown, with the known part beside it."""
    return annual.groupBy(*keys).agg(aggregates.strict_sum("carbon_kg").alias("electricity_kg"), F.coalesce(F.sum("carbon_kg"), F.lit(0.0)).alias("known_electricity_kg"), F.count("*").alias("n_years"))
