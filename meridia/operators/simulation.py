"""Monte Carlo trade-offs: seeded draws, trajectories, lifetime accounting and frontiers per draw."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import aggregates, decision


def uniform_draws(spark: SparkSession, factors: Sequence[str], n: int, seed: int) -> DataFrame:
    """(draw, u_<factor>...): one generator a factor, so a longer run begins with the shorter one.

    The draws are few numbers (n a factor) and come from the driver, so they do not depend on partitions.
    """
    columns = {"draw": range(n)}
    for f in factors:
        word = int.from_bytes(hashlib.sha256(f.encode()).digest()[:8], "big")
        columns[f"u_{f}"] = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, word]))).random(n).tolist()
    schema = "draw int, " + ", ".join(f"`u_{f}` double" for f in factors)
    return spark.createDataFrame(list(zip(*columns.values())), schema)


def hashed_draws(spark: SparkSession, factors: Sequence[str], n: int, seed: int) -> DataFrame:
    """The same from SHA-256, for engines without that generator."""
    return spark.range(n).select(F.col("id").cast("int").alias("draw"), *[S.hashed_uniform(F.lit(seed), F.lit(f), "id").alias(f"u_{f}") for f in factors])


def comonotonic(draws: DataFrame, factors: Sequence[str]) -> DataFrame:
    """All factors move together: every one takes the first one's draws."""
    return draws.select("draw", *[F.col(f"u_{factors[0]}").alias(f"u_{f}") for f in factors])


def priors_for(candidates: DataFrame, scenario: Mapping[str, Mapping[str, float]], region: DataFrame, county: DataFrame) -> DataFrame:
    """Prior bounds of every candidate: county before region before scenario."""
    out = candidates.join(F.broadcast(region) if region.count() < 10_000 else region, "grid_region", "left").join(county, "candidate_id", "left")
    for factor, p in scenario.items():
        for k in ("low", "mode", "high"):
            name = f"{factor}_{k}"
            own = [F.col(f"{level}_{name}") for level in ("county", "region") if f"{level}_{name}" in out.columns]
            out = out.withColumn(name, F.coalesce(*own, F.lit(float(p[k]))))
    return out.drop(*[c for c in out.columns if c.startswith(("county_", "region_")) and c.endswith(("_low", "_mode", "_high"))])


def lifetime_samples(candidates: DataFrame, draws: DataFrame, config: Mapping[str, float]) -> DataFrame:
    """(candidate_id, draw, cost, co2e, water): lifetime sums over the years.

    Per year: energy * price growing yearly, discounted to the opening year; emissions declining yearly; water constant.
    All three are closed sums over years, evaluated as one expression a (candidate, draw): years never become rows.
    """
    energy = config["mw"] * config["load"] * config["hours"] * config["pue"]
    e_it = config["mw"] * config["load"] * config["hours"]
    years = F.sequence(F.lit(0), F.lit(int(config["years"]) - 1))
    opening = int(config["opening"])
    growth = S.triangular("u_growth", F.lit(config["growth_low"]), F.lit(config["growth_mode"]), F.lit(config["growth_high"]))
    decline = S.triangular("u_decline", F.lit(config["decline_low"]), F.lit(config["decline_mode"]), F.lit(config["decline_high"]))
    both = candidates.crossJoin(F.broadcast(draws.select("draw", growth.alias("growth"), decline.alias("decline"))))  # draws are bounded by the configuration
    cost = F.aggregate(years, F.lit(0.0), lambda a, y: a + energy * F.col("price") * F.pow(1 + F.col("growth"), y + opening - int(config["price_year"])) / F.pow(F.lit(1 + config["discount"]), y + 1))
    co2e = F.aggregate(years, F.lit(0.0), lambda a, y: a + energy * F.col("carbon") / 1000.0 * F.pow(1 - F.col("decline"), y + opening - int(config["carbon_year"])))
    water = F.lit(e_it * config["wue"] * config["years"])
    return both.select("candidate_id", "draw", cost.alias("cost"), co2e.alias("co2e"), F.when(F.col("stress").isNotNull(), water * F.col("stress")).alias("water"))


def annual_trajectories(candidates: DataFrame, opening: int, years: int, growth: float, decline: float, price_year: int = 2025, carbon_year: int = 2023) -> DataFrame:
    out = candidates.withColumn("year", F.explode(F.sequence(F.lit(opening), F.lit(opening + years - 1))))
    return out.withColumn("price_year", S.compound("price", F.lit(growth), "year", price_year)).withColumn("carbon_year", S.compound("carbon", F.lit(-decline), "year", carbon_year))


def draw_frontiers(samples: DataFrame, objectives: Sequence[str], absolute: float = 1e-9, relative: float = 1e-9) -> DataFrame:
    """Membership in the minimisation frontier of each draw."""
    return decision.pareto(samples, [(o, "min") for o in objectives], ["draw"], absolute, relative, blocks=16)


def frontier_frequency(members: DataFrame) -> DataFrame:
    return members.groupBy("candidate_id").agg(F.avg(F.col("is_pareto_optimal").cast("double")).alias("frequency"), F.count_if("is_pareto_optimal").alias("n_draws_on_frontier"))


def expected_and_robust(samples: DataFrame, objectives: Sequence[str], alpha: float) -> DataFrame:
    """Frontiers of the means and of the tail means."""
    means = samples.groupBy("candidate_id").agg(*[F.avg(o).alias(o) for o in objectives])
    tails = means.select("candidate_id")
    for o in objectives:
        tails = tails.join(aggregates.cvar_upper(samples, ["candidate_id"], o, alpha, o), "candidate_id")
    front = lambda df, name: decision.pareto(df, [(o, "min") for o in objectives], [], 1e-9, 1e-9, blocks=16).select("candidate_id", F.col("is_pareto_optimal").alias(name))
    return front(means, "expected").join(front(tails, "robust"), "candidate_id")


def convergence(samples: DataFrame, sizes: Sequence[int], value: str) -> DataFrame:
    """Means over prefixes of the draws against the longest prefix, in one pass."""
    out = samples.groupBy("candidate_id").agg(*[F.avg(F.when(F.col("draw") < n, F.col(value))).alias(f"mean_{n}") for n in sizes])
    full = F.col(f"mean_{max(sizes)}")
    return out.select("candidate_id", *[f"mean_{n}" for n in sizes], *[((F.col(f"mean_{n}") - full) / full).alias(f"error_{n}") for n in sizes if n != max(sizes)])


def variants(base: Mapping[str, float], changes: Mapping[str, Mapping[str, float]]) -> dict[str, dict[str, float]]:
    return {"base": dict(base)} | {k: dict(base) | dict(v) for k, v in changes.items()}


def run_variants(candidates: DataFrame, draws: DataFrame, cases: Mapping[str, Mapping[str, float]]) -> DataFrame:
    parts = [lifetime_samples(candidates, draws, c).groupBy("candidate_id").agg(F.avg("cost").alias("cost"), F.avg("co2e").alias("co2e"), F.avg("water").alias("water")).withColumn("case_id", F.lit(k)) for k, c in cases.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
