"""Aggregates with the null, tie and interval rules of the decision model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import C, col


def strict_sum(x: C) -> Column:
    """Null as soon as one member is."""
    return F.when(F.count(col(x)) == F.count("*"), F.sum(col(x)))


def weighted_mean(value: C, weight: C) -> Column:
    valid = col(value).isNotNull()
    return F.sum(F.when(valid, col(value) * col(weight))) / F.nullif(F.sum(F.when(valid, col(weight))), F.lit(0.0))


def coverage(value: C, share: C) -> Column:
    return F.least(F.lit(1.0), F.coalesce(F.sum(F.when(col(value).isNotNull(), col(share))), F.lit(0.0)))


def complete_year_mean(month: C, price: C, sales: C) -> Column:
    """Sales-weighted, only where exactly the twelve months are valid."""
    ok = col(price).isNotNull() & col(sales).isNotNull()
    full = (F.count_distinct(F.when(ok, col(month))) == 12) & (F.count(F.when(ok, 1)) == 12)
    return F.when(full, F.sum(F.when(ok, col(price) * col(sales))) / F.sum(F.when(ok, col(sales))))


def primary_and_all(df: DataFrame, keys: Sequence[str], code: str, area: str) -> DataFrame:
    """Code of the largest area (ties: the lowest code), all codes joined, and how many."""
    per = df.groupBy(*keys, code).agg(F.sum(area).alias("__area"))
    return per.groupBy(*keys).agg(
        F.min(F.struct((-F.col("__area")).alias("a"), F.col(code).alias("c")))["c"].alias("primary_code"),
        F.array_join(F.array_sort(F.collect_set(code)), ";").alias("all_codes"),
        F.count("*").alias("n_codes"),
    )


def share_map(df: DataFrame, keys: Sequence[str], code: str, area: str) -> DataFrame:
    """{code: share of the keys' area} as canonical JSON."""
    per = df.groupBy(*keys, code).agg(F.sum(area).alias("__area"))
    total = F.sum("__area").over(W.partitionBy(*keys))
    entries = F.array_sort(F.collect_list(F.struct(F.col(code).cast("string").alias("key"), F.round(F.col("__area") / F.col("__total"), 6).alias("value"))))
    return per.withColumn("__total", total).groupBy(*keys).agg(F.to_json(F.map_from_entries(entries)).alias("shares_json"))


def class_fractions(df: DataFrame, keys: Sequence[str], kind: str, area: str, classes: Sequence, valid: Column | None = None) -> DataFrame:
    """Share of each class in the valid area, and the valid share of all area."""
    ok = F.lit(True) if valid is None else valid
    sums = [F.sum(F.when(ok & (F.col(kind) == c), F.col(area)).otherwise(0.0)).alias(f"__{i}") for i, c in enumerate(classes)]
    out = df.groupBy(*keys).agg(*sums, F.sum(F.when(ok, F.col(area)).otherwise(0.0)).alias("__valid"), F.sum(area).alias("__all"))
    shares = [(F.col(f"__{i}") / F.nullif(F.col("__valid"), F.lit(0.0))).alias(f"frac_{c}") for i, c in enumerate(classes)]
    return out.select(*keys, *shares, (F.col("__valid") / F.col("__all")).alias("coverage_frac"))


def cvar_upper(df: DataFrame, keys: Sequence[str], value: str, alpha: float, name: str = "cvar") -> DataFrame:
    """Mean of the worst (1 - alpha) share, with a fractional part of the last observation."""
    w = W.partitionBy(*keys)
    placed = df.where(F.col(value).isNotNull()).withColumn("__n", F.count("*").over(w)).withColumn("__rn", F.row_number().over(w.orderBy(F.desc(value))))
    mass = F.col("__n") * F.lit(1.0 - alpha)
    weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mass - (F.col("__rn") - 1)))
    return placed.groupBy(*keys).agg((F.sum(weight * F.col(value)) / F.first(mass)).alias(name))


def distribution(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.95) -> DataFrame:
    v = F.col(value)
    plain = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.percentile(v, F.lit(0.05)).alias("p05"), F.percentile(v, F.lit(0.95)).alias("p95"))
    return plain.join(cvar_upper(df, keys, value, alpha), list(keys))


def wilson(successes: C, n: C, z: float = 1.959963984540054) -> dict[str, Column]:
    p, n = col(successes) / col(n), col(n).cast("double")
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return {"wilson_low": F.greatest(F.lit(0.0), mid - half), "wilson_high": F.least(F.lit(1.0), mid + half)}


def midrank_percentile(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "percentile") -> DataFrame:
    """(average rank - 1) / (n - 1) * 100; one value is 50; nulls stay out."""
    out, ties, below, n = _placed(df, value, by)
    mid = below + (ties - 1.0) / 2.0
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.when(n == 1.0, 50.0).otherwise(mid / (n - 1.0) * 100.0))).select(*df.columns, name)


def percentile_of_score(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "percentile") -> DataFrame:
    """(below + half of the ties) / n, among values that are known."""
    out, ties, below, n = _placed(df, value, by)
    return out.withColumn(name, F.when(F.col(value).isNotNull(), (below + 0.5 * ties) / n)).select(*df.columns, name)


def _placed(df: DataFrame, value: str, by: Sequence[str]) -> tuple[DataFrame, Column, Column, Column]:
    """`df` with how many of its group have the same value, a smaller one, and any.

    Rows are counted by distinct value first; these counts are summed over range partitions and meet the rows again, so no
    task holds a whole group.
    """
    from .decision import prefix_sums

    per = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__ties"))
    placed = prefix_sums(per, [value], {"__below": F.col("__ties")}, by)
    names = [f"__k_{i}" for i in range(len(by))]
    rows = placed.select(*[F.col(k).alias(n) for k, n in zip(by, names)], F.col(value).alias("__value"), "__ties", "__below")
    total = per.groupBy(*by).agg(F.sum("__ties").alias("__n")).select(*[F.col(k).alias(f"{n}_n") for k, n in zip(by, names)], "__n")
    same, near = df[value] == rows["__value"], F.lit(True)
    for k, n in zip(by, names):
        same, near = same & df[k].eqNullSafe(F.col(n)), near & F.col(k).eqNullSafe(F.col(f"{n}_n"))
    out = df.join(rows, same, "left")
    out = out.join(total, near, "left") if by else out.crossJoin(F.broadcast(total))  # one row
    return out, *(F.col(c).cast("double") for c in ("__ties", "__below", "__n"))


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Presence against all background: mean percentile of the positives, ties one half.

    Counts per distinct score are pre-aggregated, and summed over range partitions.
    """
    from .decision import prefix_sums

    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count_if(F.col(positive)).alias("k"))
    placed = prefix_sums(per, [score], {"below": F.col("n")})
    return placed.agg(
        (F.sum(F.col("k") * (F.col("below") + 0.5 * F.col("n"))) / F.nullif(F.sum("k") * F.sum("n"), F.lit(0))).alias("auc"),
        F.sum("k").alias("n_positive"),
        F.sum("n").alias("n_valued"),
    )


def hit_rates(df: DataFrame, rank: str, km: str, tops: Sequence[int], radii: Sequence[float]) -> DataFrame:
    """Share of the first N within r km, for each N and r; an N beyond the list is left out."""
    cells = F.array(*[F.struct(F.lit(n).alias("top_n"), F.lit(float(r)).alias("radius_km")) for n in tops for r in radii])
    out = df.where(F.col(rank) <= max(tops)).withColumn("c", F.explode(cells)).where(F.col(rank) <= F.col("c.top_n"))
    out = out.groupBy("c.top_n", "c.radius_km").agg(F.avg((F.col(km) <= F.col("c.radius_km")).cast("double")).alias("hit_rate"), F.count("*").alias("n"))
    return out.where("n = top_n").drop("n")


def empirical_p(df: DataFrame, keys: Sequence[str], observed: str, draw: str) -> DataFrame:
    """One-sided (1 + draws at least as large) / (1 + draws), and lift over the mean draw."""
    at_least = F.count_if(F.col(draw) >= F.col(observed) - 1e-12)
    return df.groupBy(*keys).agg(((1 + at_least) / (1 + F.count(draw))).alias("p_value"), (F.first(observed) / F.nullif(F.avg(draw), F.lit(0.0))).alias("lift"))


def conflicts(df: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """One row a key: each attribute, null where it is contradictory (null counts as a value), and a conflict list."""
    # every count is a plain distinct-set size of few values a key
    aggs = [F.size(F.collect_set(F.coalesce(F.col(a).cast("string"), F.lit("\u0000")))).alias(f"__{a}") for a in attributes] + [F.max(a).alias(a) for a in attributes]
    out = df.groupBy(*keys).agg(*aggs, F.count("*").alias("n_rows"))
    listed = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"__{a}") > 1, F.lit(a)) for a in attributes])), ";")
    return out.select(*keys, *[F.when(F.col(f"__{a}") == 1, F.col(a)).alias(a) for a in attributes], listed.alias("conflicts"), "n_rows")


def collected(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(value)), ";").alias(name), F.count("*").alias("n_rows"))


def first_row(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def codes_by_count(df: DataFrame, keys: Sequence[str], code: str, name: str) -> DataFrame:
    """Codes by falling count, then name; null if one member has none."""
    per = df.groupBy(*keys, code).agg(F.count("*").alias("__n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col(code).alias("c"))))
    return per.groupBy(*keys).agg(F.when(~F.bool_or(F.col(code).isNull()), F.array_join(F.transform(listed, lambda x: x["c"]), ";")).alias(name))


def most_frequent(df: DataFrame, keys: Sequence[str], code: str, k: int = 3) -> DataFrame:
    per = df.groupBy(*keys, code).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy(F.desc("n"), code)
    return per.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def parent_summary(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    """Best cell (ties: smallest row, then column), number of scored cells and 90th percentile."""
    best = F.max(F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("s"), (-F.col("grid_row")).alias("r"), (-F.col("grid_col")).alias("c"), F.col("grid_id").alias("g"))))
    return df.groupBy(*keys).agg(best.alias("b"), F.count(score).alias("n_scored"), F.percentile(score, F.lit(0.9)).alias("p90")).select(*keys, F.col("b.g").alias("best_grid_id"), F.col("b.s").alias("best_score"), "n_scored", "p90")


def sphere_centroid(df: DataFrame, keys: Sequence[str], lat: str, lon: str) -> DataFrame:
    a, b = F.radians(lat), F.radians(lon)
    out = df.groupBy(*keys).agg(F.avg(F.cos(a) * F.cos(b)).alias("x"), F.avg(F.cos(a) * F.sin(b)).alias("y"), F.avg(F.sin(a)).alias("z"), F.count("*").alias("n"))
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return out.select(*keys, F.degrees(F.asin(F.col("z") / norm)).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lon"), "n")


def completeness(df: DataFrame, keys: Sequence[str], valid: Column, expected: int | Column) -> DataFrame:
    n = F.lit(expected) if isinstance(expected, int) else expected
    return df.groupBy(*keys).agg((F.count_if(valid) / n).alias("temporal_coverage"), F.count_if(valid).alias("n_valid"))


def component_rollup(df: DataFrame, keys: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Total only if every item is known and all modules are covered; the known subtotal beside it."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.collect_set("module"))
    whole = (F.count("kg") == F.count("*")) & (F.size(missing) == 0)
    return df.groupBy(*keys).agg(F.when(whole, F.sum("kg")).alias("total_kg"), F.coalesce(F.sum("kg"), F.lit(0.0)).alias("known_kg"), F.array_join(F.array_sort(missing), ";").alias("missing_modules"))


def status_ladder(expected: C, ready: C) -> Column:
    return F.when(col(ready) == 0, "BLOCKED").when(col(ready) < col(expected), "PARTIAL").otherwise("READY")


def bootstrap_means(df: DataFrame, keys: Sequence[str], draw: str, value: str, n_draws: int, rounds: int, seed: int = 42) -> DataFrame:
    """Paired bootstrap of the mean: all keys share the resampled draw numbers.

    How often a round takes a draw is aggregated before the join, so the join has one row a (round, draw).
    """
    from ..functions.scalar import hashed_uniform

    spark = df.sparkSession
    picks = spark.range(rounds * n_draws).select((F.col("id") / n_draws).cast("int").alias("round"), F.floor(hashed_uniform(F.lit(seed), "id") * n_draws).cast("bigint").alias(draw))
    picks = picks.groupBy("round", draw).agg(F.count("*").alias("times"))
    means = df.join(picks, draw).groupBy(*keys, "round").agg((F.sum(F.col(value) * F.col("times")) / F.sum("times")).alias("m"))
    return means.groupBy(*keys).agg(F.stddev_samp("m").alias("se"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
