"""Feature adapters: from source tables to one metric row a cell, with coverage and status."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import aggregates as A


def land_cover(pixels: DataFrame, key: str, classes: Sequence[int], suitable: Sequence[int], water: Sequence[int]) -> DataFrame:
    """Class shares of the valid area, coverage, and land / water / suitable area; pixels (key, class, area)."""
    valid = F.col("class").isNotNull()
    shares = A.class_fractions(pixels, [key], "class", "area", classes, valid)
    pick = lambda codes: F.sum(F.when(F.col("class").isin(list(codes)), F.col("area")).otherwise(0.0))
    areas = pixels.groupBy(key).agg(pick(suitable).alias("suitable_area"), pick(water).alias("water_area"), F.sum(F.when(valid & ~F.col("class").isin(list(water)), F.col("area")).otherwise(0.0)).alias("land_area"))
    return shares.join(areas, key)


def area_metric(pieces: DataFrame, key: str, value: str, code: str) -> DataFrame:
    """Area-weighted mean of a region value over a cell's pieces (key, code, value, area, cell_area).

    Unknown pieces stay out of the mean and lower the coverage; the primary region and all regions go with it.
    """
    share = F.col("area") / F.col("cell_area")
    mean = pieces.groupBy(key).agg(A.weighted_mean(value, "area").alias(value), A.coverage(value, share).alias("coverage_frac"), F.count_distinct(code).alias("n_regions"))
    out = mean.join(A.primary_and_all(pieces, [key], code, "area"), key).join(A.share_map(pieces, [key], code, "area"), key)
    return out.withColumn("is_ambiguous", F.col("n_regions") > 1).withColumn("status", F.when(F.col(value).isNull(), "unknown").otherwise("calculated"))


def water_stress(pieces: DataFrame, key: str) -> DataFrame:
    """Ratio without the extreme code, score, plurality category and the share of extreme scarcity."""
    s = S.sentinel("raw_ratio")
    x = pieces.withColumn("ratio", s["value"]).withColumn("extreme", s["is_extreme"])
    out = x.groupBy(key).agg(
        A.weighted_mean("ratio", "area").alias("stress_ratio"), A.weighted_mean("score", "area").alias("stress_score"),
        (F.sum(F.when(F.col("extreme"), F.col("area")).otherwise(0.0)) / F.sum("area")).alias("extreme_share"),
    )
    category = A.primary_and_all(x.where(F.col("category").isNotNull()), [key], "category", "area").select(key, F.col("primary_code").alias("category"))
    return out.join(category, key, "left")


def future_water(pieces: DataFrame, key: str, pathways: Sequence[str], years: Sequence[int], unsupported: Sequence[int]) -> DataFrame:
    """One row a pathway and milestone; an unsupported year is unknown with coverage 0, never interpolated."""
    cases = F.explode(F.array(*[F.struct(F.lit(p).alias("pathway"), F.lit(y).alias("year")) for p in pathways for y in years]))
    cells = pieces.select(key).distinct().withColumn("c", cases).select(key, "c.*")
    known = pieces.groupBy(key, "pathway", "year").agg(A.weighted_mean("score", "area").alias("score"), A.coverage("score", F.col("area") / F.col("cell_area")).alias("coverage_frac"))
    out = cells.join(known, [key, "pathway", "year"], "left")
    off = F.col("year").isin(list(unsupported))
    return out.withColumn("score", F.when(~off, F.col("score"))).withColumn("coverage_frac", F.when(off, 0.0).otherwise(F.coalesce("coverage_frac", F.lit(0.0))))


def zonal_mean(pixels: DataFrame, key: str, value: str, most: float | None = None) -> DataFrame:
    """Mean of valid pixels; a value beyond `most` makes the cell invalid."""
    bad = F.bool_or(F.col(value) > most) if most is not None else F.lit(False)
    out = pixels.groupBy(key).agg(F.avg(value).alias("mean"), F.coalesce(bad, F.lit(False)).alias("bad"), (F.count(value) / F.count("*")).alias("coverage_frac"))
    return out.select(key, F.when(~F.col("bad"), F.col("mean")).alias(value), F.when(F.col("bad"), "invalid_source_value").when(F.col("mean").isNull(), "no_valid_pixel").alias("missing_reason"), "coverage_frac")


def flood_share(pieces: DataFrame, key: str) -> DataFrame:
    """Special flood hazard share of the area whose classification is known; known only with complete coverage."""
    known = F.col("zone").isNotNull()
    out = pieces.groupBy(key).agg(F.sum(F.when(F.col("zone") == "SFHA", F.col("area")).otherwise(0.0)).alias("h"), F.sum(F.when(known, F.col("area")).otherwise(0.0)).alias("k"), F.first("cell_area").alias("cell_area"))
    cov = F.col("k") / F.col("cell_area")
    return out.select(key, F.when(cov >= 1 - S.COMPLETE, F.col("h") / F.col("k")).alias("sfha_frac"), cov.alias("coverage_frac"))


def protected_share(lattice: DataFrame, key: str, total: str) -> DataFrame:
    """Union shares of protection classes 1+2 and 1..4 over distinct lattice squares (key, square, gap, total)."""
    per = lattice.groupBy(key, "square", total).agg(F.min("gap").alias("gap"))
    return per.groupBy(key).agg((F.count_if(F.col("gap") <= 2) / F.first(total)).alias("gap12_frac"), (F.count_if(F.col("gap") <= 4) / F.first(total)).alias("gap14_frac"))


def drought(weeks: DataFrame, key: str, expected_weeks: int) -> DataFrame:
    """D2-or-worse area-time mean, share of weeks with any, and temporal coverage.

    Cumulative classes must not rise with severity: a week that breaks this is invalid.
    """
    ok = (F.col("d0") >= F.col("d1")) & (F.col("d1") >= F.col("d2")) & (F.col("d2") >= F.col("d3")) & (F.col("d3") >= F.col("d4"))
    x = weeks.withColumn("ok", F.coalesce(ok, F.lit(False)))
    return x.groupBy(key).agg(
        F.avg(F.when(F.col("ok"), F.col("d2") / 100.0)).alias("d2_area_time"), F.avg(F.when(F.col("ok"), (F.col("d2") > 0).cast("double"))).alias("any_d2_share"), (F.count_if("ok") / float(expected_weeks)).alias("temporal_coverage")
    )


def interconnection_queue(rows: DataFrame, key: str) -> DataFrame:
    """Active projects, their capacity (null-strict) and the share that reports one."""
    active = rows.where(F.col("is_active"))
    return active.groupBy(key).agg(F.count("*").alias("n_active"), A.strict_sum("mw").alias("active_mw"), F.coalesce(F.sum("mw"), F.lit(0.0)).alias("reported_mw"), (F.count("mw") / F.count("*")).alias("reporting_share"))


def daily_climate(days: DataFrame, key: str, value: str, expected_days: int) -> DataFrame:
    """Annual mean only if every expected day is valid."""
    out = days.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("m"))
    return out.select(key, F.when(F.col("n") == expected_days, F.col("m")).alias(value), (F.col("n") / float(expected_days)).alias("temporal_coverage"))


def series_summary(points: DataFrame, key: str, time: str, value: str, step_seconds: float) -> DataFrame:
    """Mean and integral (value hours) of a series, and whether its steps are uniform."""
    w = W.partitionBy(key).orderBy(time)
    gap = (F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w)) / 1e6
    return points.withColumn("__g", gap).groupBy(key).agg(F.avg(value).alias("mean"), (F.sum(value) * step_seconds / 3600.0).alias("integral_hours"), F.coalesce(F.bool_and(F.col("__g") == step_seconds), F.lit(True)).alias("is_uniform"))


def interval_estimate(df: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Estimate with half-width of its interval; an interval that misses its estimate is an error of the source."""
    sane = (F.col(low) <= F.col(value)) & (F.col(value) <= F.col(high))
    return df.withColumn("moe", F.when(sane, (F.col(high) - F.col(low)) / 2.0)).withColumn("is_sane", F.coalesce(sane, F.lit(False)))


def reliability(utilities: DataFrame, links: DataFrame, key: str, region: str, columns: Sequence[str]) -> DataFrame:
    """Area-associated means of a region table's columns."""
    x = links.join(utilities, region, "left")
    return x.groupBy(key).agg(*[A.weighted_mean(c, "area").alias(c) for c in columns], A.coverage(columns[0], F.col("area") / F.col("cell_area")).alias("coverage_frac"))


def candidate_table(counties: DataFrame, lookups: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Counties with all their lookups, each many-to-one on its key columns in common."""
    out = counties
    for df in lookups.values():
        out = out.join(df, [c for c in df.columns if c in out.columns] or [key], "left")
    return out


def coverage_report(long: DataFrame, by: Sequence[str] = ("source_id", "status")) -> DataFrame:
    """Known, unknown and coverage by source and status, with subtotals of every subset of `by`."""
    return long.cube(*by).agg(F.count("*").alias("n"), F.count("value").alias("n_known"), F.min("coverage").alias("min_coverage"))


def fine_surface(parents: DataFrame, factor: int, features: DataFrame, score, by: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """Children of parents, their features and score, and a summary of each parent."""
    from . import spatial

    cells = spatial.children(parents, factor).join(features, ["grid_row", "grid_col"], "left")
    scored = cells.withColumn("score", score)
    return scored, A.parent_summary(scored, [by])
