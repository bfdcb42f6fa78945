"""Weights, scores, ranks and frontiers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalar as S

# ---------------------------------------------------------------- weights (driver: a handful of numbers)


def user_weights(weights: Mapping[str, float], metrics: Sequence[str]) -> dict[str, float]:
    if set(weights) != set(metrics):
        raise ValueError("weights must name exactly the metrics")
    if any(not math.isfinite(w) or w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("weights must be finite, not negative and not all zero")
    total = sum(weights[m] for m in metrics)
    return {m: weights[m] / total for m in metrics}


def equal_weights(groups: Mapping[str, Sequence[str]]) -> dict[str, float]:
    """Equal parents, and equal leaves of each parent."""
    return {m: 1 / len(groups) / len(ms) for ms in groups.values() for m in ms}


def hierarchical_weights(parents: Mapping[str, float], local: Mapping[str, Mapping[str, float]]) -> dict[str, float]:
    out = {m: parents[g] * w for g, ws in local.items() for m, w in ws.items()}
    if abs(sum(out.values()) - 1) > 1e-10:
        raise ValueError("weights must add up to 1")
    return out


def without_group(groups: Mapping[str, Sequence[str]], dropped: str) -> dict[str, float]:
    """Ablation: the other groups share equally."""
    return equal_weights({g: ms for g, ms in groups.items() if g != dropped})


#: Random consistency index by matrix size.
RANDOM_INDEX = {1: 0.0, 2: 0.0, 3: 0.58, 4: 0.90, 5: 1.12, 6: 1.24, 7: 1.32, 8: 1.41, 9: 1.45, 10: 1.49}


def ahp(matrix: Sequence[Sequence[float]], threshold: float = 0.1, accept_anyway: bool = False, tolerance: float = 1e-8) -> dict:
    """Principal-eigenvector weights and consistency of a pairwise-judgement matrix."""
    a = np.asarray(matrix, float)
    n = len(a)
    if a.shape != (n, n) or not np.isfinite(a).all() or (a <= 0).any() or np.abs(a * a.T - 1).max() > tolerance or n not in RANDOM_INDEX:
        raise ValueError("a positive reciprocal matrix of at most 10 rows is needed")
    values, vectors = np.linalg.eig(a)
    k = int(np.argmax(values.real))
    w = vectors[:, k]
    if abs(values[k].imag) > tolerance or np.abs(w.imag).max() > tolerance:
        raise ValueError("the principal eigenvector is complex")
    w = w.real / w.real.sum()
    if (w <= 0).any() or np.abs(a @ w - values[k].real * w).max() > 1e-6:
        raise ValueError("the principal eigenvector has no single sign or is badly resolved")
    largest = float(values[k].real)
    if n < 3:
        return {"weights": w.tolist(), "lambda_max": largest, "ci": 0.0, "cr": None, "status": "NOT_APPLICABLE"}
    ci = max(0.0, (largest - n) / (n - 1))
    cr = ci / RANDOM_INDEX[n]
    status = "ACCEPTED" if cr <= threshold else "PROVISIONAL" if accept_anyway else "REVIEW_REQUIRED"
    return {"weights": w.tolist(), "lambda_max": largest, "ci": ci, "cr": cr, "status": status}


# ---------------------------------------------------------------- scores


def score(df: DataFrame, weights: Mapping[str, float], weights_ok: bool = True) -> DataFrame:
    """Additive score (summed in metric order), contributions and the status ladder.

    A missing metric leaves the row without score; weights are never redistributed.
    """
    total = None
    for m, w in weights.items():
        part = F.col(m) * float(w)
        total = part if total is None else total + part
    ready = F.col("eligible") & total.isNotNull() & F.lit(weights_ok)
    entries = [x for m, w in weights.items() for x in (F.lit(m), F.col(m) * float(w))]
    out = df.withColumn("score", F.when(ready, total))
    out = out.withColumn("contributions", F.when(ready, F.create_map(*entries)).otherwise(F.create_map().cast("map<string,double>")))
    return out.withColumn("rank_status", S.rank_status("eligible", total, F.lit(weights_ok), "conditional"))


def rank(df: DataFrame, by: Sequence[str] = ("scenario_id",), order: Sequence[str] = ("grid_id", "design_id"), value: str = "score", name: str = "rank") -> DataFrame:
    """1..n in each group by falling value, then keys; rows without value have no rank."""
    w = W.partitionBy(*by, F.col(value).isNull()).orderBy(F.desc(value), *order)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), F.row_number().over(w)))


def prefix_sums(df: DataFrame, order: Sequence[Column | str], sums: Mapping[str, Column], by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """`df` with the sums over the rows before each one in order, in groups too large for one task.

    Rows are dealt to range partitions by group and order, written (range bounds are sampled anew by every run) and
    summed there; what the earlier partitions of a group hold is added from a table with one row a partition and group.
    Rows equal in `order` follow each other in any order.
    """
    from .relations import small, written

    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *[F.col(o) if isinstance(o, str) else o for o in order]]
    given = df.withColumns({f"__v_{k}": v for k, v in sums.items()})
    dealt = given.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    numbered = written(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    here = W.partitionBy("__part", *by).orderBy("__id").rowsBetween(W.unboundedPreceding, -1)
    none = {k: F.lit(0).cast(given.schema[f"__v_{k}"].dataType) for k in sums}
    local = numbered.withColumns({k: F.coalesce(F.sum(f"__v_{k}").over(here), none[k]) for k in sums})
    per = numbered.groupBy("__part", *by).agg(*[F.sum(f"__v_{k}").alias(f"__s_{k}") for k in sums])
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    base = per.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__g_{i}") for i, k in enumerate(by)], *[F.coalesce(F.sum(f"__s_{k}").over(before), none[k]).alias(f"__b_{k}") for k in sums])
    on = local["__part"] == base["__p"]
    for i, k in enumerate(by):
        on = on & local[k].eqNullSafe(base[f"__g_{i}"])
    out = local.join(small(base), on)
    return out.select(*df.columns, *[(F.col(k) + F.col(f"__b_{k}")).alias(k) for k in sums])


def positions(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """1..n in a total order, without gathering the rows: the order of an export."""
    return prefix_sums(df, order, {name: F.lit(1).cast("bigint")}).withColumn(name, F.col(name) + 1)


def rank_large(df: DataFrame, order: Sequence[str] = ("grid_id", "design_id"), value: str = "score", name: str = "rank", parts: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The rank in groups too large for one task; rows without value are left out."""
    ranked = df.where(F.col(value).isNotNull())
    return prefix_sums(ranked, [F.desc(value), *order], {name: F.lit(1).cast("bigint")}, by, parts).withColumn(name, F.col(name) + 1)


def rank_groups(df: DataFrame, by: Sequence[str] = ("scenario_id",), order: Sequence[str] = ("grid_id", "design_id"), value: str = "score", name: str = "rank") -> DataFrame:
    """:func:`rank` for few large groups: every group is spread over range partitions."""
    ranked = rank_large(df, order, value, name, by=by).withColumn(name, F.col(name).cast("int"))
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn(name, F.lit(None).cast("int")))


def tie_prefix(df: DataFrame, value: str, k: int) -> DataFrame:
    """The first k rows by falling value, and all that tie with the last of them."""
    least = df.where(F.col(value).isNotNull()).orderBy(F.desc(value)).limit(k).agg(F.min(value)).first()[0]
    return df.where(F.lit(False) if least is None else F.col(value) >= least)


def ablations(df: DataFrame, groups: Mapping[str, Sequence[str]], by: Sequence[str], value: str = "score") -> DataFrame:
    """Scores with each group of metrics left out and the others weighted equally: one row a case (`without`)."""
    cases = {g: without_group(groups, g) for g in groups}
    total = lambda w: sum((F.col(m) * x for m, x in list(w.items())[1:]), F.col(next(iter(w))) * next(iter(w.values())))
    rows = F.array(*[F.struct(F.lit(g).alias("without"), total(w).alias(value)) for g, w in cases.items()])
    return df.select(*by, F.explode(rows).alias("__r")).select(*by, "__r.*")


def retention(candidates: DataFrame, cases: DataFrame, key: str, km: float, top: int, case: str = "case_id") -> DataFrame:
    """How many cases keep a candidate: a case keeps it if one of its first `top` places is less than `km` away.

    candidates: (key, lat, lon); cases: (case, rank, lat, lon).
    """
    from . import spatial

    places = cases.where(F.col("rank") <= top).withColumn("__place", F.struct(case, "rank"))
    near = spatial.within_radius(candidates, places, km, key, "__place").where(F.col("km") < km)
    kept = near.groupBy(key).agg(F.count_distinct(F.col(f"__place.{case}")).alias("n_kept"))
    n = cases.select(case).distinct().count()
    return candidates.select(key).join(kept, key, "left").select(key, F.coalesce("n_kept", F.lit(0)).alias("n_kept"), F.lit(n).cast("bigint").alias("n_cases"))


def best_over(df: DataFrame, keys: Sequence[str], value: str, pick: str, tie: str) -> DataFrame:
    """The pick with the largest value; the smaller tie number wins."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col(tie)).alias("t"), F.col(pick).alias("p"))))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.v").alias(value), F.col("b.p").alias(pick))


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_fraction(df: DataFrame, by: Sequence[str], fraction: float, value: str, order: Sequence[str]) -> DataFrame:
    """The best ceil(n * fraction) rows of each group."""
    w = W.partitionBy(*by)
    n = F.count("*").over(w)
    ordered = w.orderBy(F.desc(value), *order)
    out = df.where(F.col(value).isNotNull()).withColumn("__n", n).withColumn("__rn", F.row_number().over(ordered))
    return out.where(F.col("__rn") <= F.ceil(F.col("__n") * F.lit(float(fraction)))).drop("__n", "__rn")


def tie_block(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Smallest and largest rank that a tied row could have."""
    w = W.partitionBy(*by)
    low = F.rank().over(w.orderBy(F.desc(value)))
    tied = F.count("*").over(W.partitionBy(*by, value))
    return df.withColumn("rank_min", low).withColumn("rank_max", low + tied - 1)


# ---------------------------------------------------------------- frontiers


def _dominates(a: str, b: str, objectives: Sequence[tuple[str, str]], tolerance: float | Sequence[float], relative: float) -> Column:
    tolerances = [tolerance] * len(objectives) if isinstance(tolerance, (int, float)) else list(tolerance)
    never, once = F.lit(True), F.lit(False)
    for (name, sense), t in zip(objectives, tolerances):
        x, y = F.col(f"{a}.{name}"), F.col(f"{b}.{name}")
        gain = x - y if sense == "max" else y - x
        slack = F.lit(float(t)) + relative * F.greatest(F.abs(x), F.abs(y)) if relative else F.lit(float(t))
        never, once = never & (gain >= -slack), once | (gain > slack)
    return never & once


def _undominated(x: np.ndarray) -> np.ndarray:
    """Places of rows (larger is better) that no other row is at least as good as in all columns and better than in one."""
    order = np.argsort(-x.sum(1), kind="stable")  # what dominates comes first
    kept = np.zeros(0, np.int64)
    for lo in range(0, len(order), 512):
        some = order[lo : lo + 512]
        for at in range(0, len(kept), 4096):
            y = x[kept[at : at + 4096]]
            some = some[~((y[None] >= x[some][:, None]).all(2) & (y[None] > x[some][:, None]).any(2)).any(1)]
        y = x[some]
        some = some[~((y[None] >= y[:, None]).all(2) & (y[None] > y[:, None]).any(2)).any(1)]
        kept = np.concatenate([kept, some])
    return kept


def _thinned(by: Sequence[str], objectives: Sequence[tuple[str, str]], hold: int = 50_000):
    sign = np.array([1.0 if sense == "max" else -1.0 for _, sense in objectives])

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = pdf.groupby(list(by), dropna=False, sort=False).indices.values() if by else [np.arange(len(pdf))]
        x = pdf[[n for n, _ in objectives]].to_numpy(float) * sign
        return pdf.iloc[np.concatenate([g[_undominated(x[g])] for g in groups])] if len(pdf) else pdf

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) > hold:
                held = [thin(pd.concat(held))]
                if len(held[0]) > hold // 2:  # thinning does not help here
                    yield held.pop()
        if held:
            yield thin(pd.concat(held))

    return run


def witnesses(vectors: DataFrame, objectives: Sequence[tuple[str, str]], by: Sequence[str], enough: int = 20_000) -> DataFrame:
    """A part of the vectors that holds every group's undominated ones.

    What dominates a vector without tolerance also dominates, with any tolerance (a relative one below 1), all that the
    vector does.  So partitions drop what they see dominated, in rounds over fewer and fewer partitions, until few are
    left or a round drops less than half.
    """
    from .relations import written

    left = written(vectors, "vectors")
    n, parts = left.count(), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while n:
        thin = written(left.mapInPandas(_thinned(by, objectives), left.schema), "witnesses")
        now = thin.count()
        left = thin
        if now <= enough and parts == 1 or now > n / 2 and parts < max(1, n // enough):
            break
        if parts == 1:
            break
        parts = max(1, min(parts // 4, -(-now // enough)))
        left, n = thin.repartition(parts), now
    return left


def pareto(df: DataFrame, objectives: Sequence[tuple[str, str]], by: Sequence[str], tolerance: float | Sequence[float] = 1e-9, relative: float = 0.0, blocks: int = 64, comparable: Column | None = None) -> DataFrame:
    """`is_pareto_optimal`: false if another comparable row of the group is at least as good within the tolerance
    in all objectives and better beyond it in one; null for rows that cannot be compared.

    Dominance with a tolerance is not transitive, so a dominated row can be the witness against another; but then the rows
    that dominate it without tolerance are witnesses too.  Every distinct vector is compared with :func:`witnesses` only.
    These lie in blocks by quantiles of the first objective; a block can only hold a witness for a row if its best
    values would dominate the row.
    """
    from .relations import small

    names = [n for n, _ in objectives]
    usable = F.lit(True) if comparable is None else F.coalesce(comparable, F.lit(False))
    for n in names:
        usable = usable & F.col(n).isNotNull()
    marked = df.withColumn("__ok", usable)
    vectors = marked.where("__ok").select(*by, *names).distinct()
    against = witnesses(vectors, objectives, by)
    edges = against.agg(F.percentile_approx(names[0], [i / blocks for i in range(1, blocks)], 10_000)).first()[0] or []
    block = F.lit(0)
    for e in sorted(set(edges)):
        block = block + (F.col(names[0]) > e).cast("int")
    placed = against.withColumn("__block", block)
    best = placed.groupBy(*by, "__block").agg(*[(F.max if sense == "max" else F.min)(n).alias(n) for n, sense in objectives])
    rows, tops = vectors.alias("r"), best.alias("t")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by]
    condition = _dominates("t", "r", objectives, tolerance, relative)
    for c in same:
        condition = condition & c
    todo = rows.join(small(tops, 1_000_000), condition).select(*[F.col(f"r.{c}").alias(c) for c in [*by, *names]], F.col("t.__block").alias("__block"))
    a, b = placed.alias("a"), todo.alias("b")
    condition = (F.col("a.__block") == F.col("b.__block")) & _dominates("a", "b", objectives, tolerance, relative)
    for k in by:
        condition = condition & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    beaten = b.join(a, condition, "left_semi").select(*by, *names).distinct().withColumn("__beaten", F.lit(True))
    on = F.lit(True)
    for k in [*by, *names]:
        on = on & F.col(f"m.{k}").eqNullSafe(F.col(f"x.{k}"))
    out = marked.alias("m").join(beaten.alias("x"), on, "left")
    return out.select("m.*", F.when(F.col("m.__ok"), F.col("x.__beaten").isNull()).alias("is_pareto_optimal")).drop("__ok")


def pareto_pairs(df: DataFrame, objectives: Sequence[tuple[str, str]], by: Sequence[str], tolerance: float = 1e-9, relative: float = 0.0) -> DataFrame:
    """The same by a plain anti join: the check for small inputs."""
    a, b = df.alias("a"), df.alias("b")
    condition = _dominates("a", "b", objectives, tolerance, relative)
    for k in by:
        condition = condition & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return b.join(a, condition, "left_anti")


def near_ties(df: DataFrame, key: str, objectives: Sequence[str], by: Sequence[str], relative: float) -> DataFrame:
    """Pairs that are within a relative tolerance in all given objectives.

    Rows meet by buckets of the logarithm of the first objective, so a row is compared with near values only.
    """
    width = math.log1p(relative) * 2
    bucket = F.floor(F.log(F.abs(F.col(objectives[0]))) / width)
    a = df.withColumn("__b", bucket).alias("a")
    b = df.withColumn("__b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("b")
    condition = (F.col("a.__b") == F.col("b.__b")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))
    for k in by:
        condition = condition & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    for o in objectives:
        x, y = F.col(f"a.{o}"), F.col(f"b.{o}")
        condition = condition & (F.abs(x - y) <= relative * F.greatest(F.abs(x), F.abs(y)))
    return a.join(b, condition).select(*[F.col(f"a.{k}").alias(k) for k in by], F.col(f"a.{key}").alias("left_id"), F.col(f"b.{key}").alias("right_id"))


# ---------------------------------------------------------------- comparison of cases


def compare_cases(base: DataFrame, case: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Case minus base of each value, null if either is; both sides must hold the same rows."""
    a, b = base.alias("a"), case.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "inner")
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], *[(F.col(f"b.{v}") - F.col(f"a.{v}")).alias(f"delta_{v}") for v in values])


def rank_ranges(cases: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cases.groupBy(*keys).agg(F.min("rank").alias("rank_min"), F.max("rank").alias("rank_max"), F.count("rank").alias("n_ranked"), F.count("*").alias("n_cases"))


def weight_cases(df: DataFrame, cases: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """The same normalised metrics under several weightings: one row a case, without a join."""
    scored = []
    for name, weights in cases.items():
        total = None
        for m, w in weights.items():
            total = F.col(m) * float(w) if total is None else total + F.col(m) * float(w)
        scored.append(F.struct(F.lit(name).alias("case_id"), total.alias("score")))
    return df.withColumn("__case", F.explode(F.array(*scored))).select(*df.columns, "__case.*")


def top_overlap(df: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Jaccard overlap of the first k by two ranks, and the correlation of the ranks."""
    in_a, in_b = F.coalesce(F.col(a) <= k, F.lit(False)), F.coalesce(F.col(b) <= k, F.lit(False))
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    r = F.corr(F.when(both == 1, F.col(a).cast("double")), F.when(both == 1, F.col(b).cast("double")))
    return df.agg(
        F.count_if(in_a & in_b).alias("n_both"),
        F.count_if(in_a | in_b).alias("n_either"),
        (F.count_if(in_a & in_b) / F.nullif(F.count_if(in_a | in_b), F.lit(0))).alias("jaccard"),
        F.when(F.count(both) >= 2, S.finite(r)).alias("rank_correlation"),
    )


# ---------------------------------------------------------------- compositions


def reevaluate(cached: DataFrame, mw: float, load: float, hours: float, weights: Mapping[str, float], carbon_high: float, water_high: float) -> DataFrame:
    """Scores of cached alternatives for a changed facility request: only the request's factors are computed anew."""
    physics = S.annual_physics(S.num(mw), S.num(load), S.num(hours), "pue", "carbon", "wue")
    out = cached.withColumn("carbon_t", physics["carbon_t"]).withColumn("water_m3", physics["water_m3"])
    out = out.withColumn("carbon", S.normalise("carbon_t", 0.0, carbon_high)).withColumn("water", S.normalise("water_m3", 0.0, water_high))
    return rank(score(out, weights))


def brief(ranked: DataFrame, scenario: str, key: str = "grid_id", alternatives: int = 2) -> DataFrame:
    """The best cell of a scenario and the next distinct ones, with the difference between their designs.

    A cell's design difference is best minus other score, null where one design has none.
    """
    chosen = ranked.where(F.col("scenario_id") == scenario)
    by_cell = chosen.groupBy(key).agg(
        F.max("score").alias("score"), F.min_by("design_id", F.struct(F.col("rank").isNull(), "rank", "design_id")).alias("design_id"),
        F.when(F.count("score") == F.count("*"), F.max("score") - F.min("score")).alias("design_delta"), F.min("rank").alias("rank"),
    )
    first = by_cell.where("rank IS NOT NULL").orderBy("rank", key).limit(1 + alternatives)
    place = F.row_number().over(W.orderBy("rank", key))  # at most 1 + alternatives rows
    return first.withColumn("place", place).withColumn("role", F.when(F.col("place") == 1, "selected").otherwise("alternative"))
