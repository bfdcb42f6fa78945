"""Run identity, manifests, freezes and data quality."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .relations import ConstraintError, tables_equal


def canonical_json(x: object) -> str:
    """Sorted keys, compact, no NaN."""
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fingerprint(x: object) -> str:
    return hashlib.sha256(canonical_json(x).encode()).hexdigest()


def table_fingerprint(df: DataFrame) -> str:
    """Order-insensitive: a commutative aggregate of row hashes, so nothing is sorted."""
    names = sorted(df.columns)
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*names).cast("decimal(20,0)")).alias("s"), F.expr(f"bit_xor(xxhash64({', '.join(f'`{n}`' for n in names)}, 1))").alias("x")).first()
    return fingerprint([names, [df.schema[n].dataType.simpleString() for n in names], r["n"], str(r["s"]), r["x"]])


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Through the cluster's file system: written beside, then renamed."""
    fs, p = _fs(spark, path)
    tmp = spark._jvm.org.apache.hadoop.fs.Path(path + ".part")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(p, False)
    if not fs.rename(tmp, p):
        raise OSError(f"cannot rename to {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def run_identity(config: Mapping, inputs: Mapping[str, DataFrame]) -> str:
    return "run_" + fingerprint({"config": dict(config), "inputs": {k: table_fingerprint(v) for k, v in sorted(inputs.items())}})[:16]


class Stages:
    """Stage outputs under one run folder; a stage is reused while its identity holds.

    The manifest is written last, so a stage that died half-way is not there.
    """

    def __init__(self, spark: SparkSession, folder: str, identity: str):
        self.spark, self.folder, self.identity = spark, folder.rstrip("/"), identity

    def run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path, note = f"{self.folder}/{name}", f"{self.folder}/{name}.json"
        found = read_text(self.spark, note)
        if found and json.loads(found)["identity"] == self.identity:
            return self.spark.read.parquet(path)
        df = make()
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.parquet(path)
        write_text(self.spark, note, canonical_json({"identity": self.identity, "rows": out.count(), "schema": df.schema.jsonValue(), "fingerprint": table_fingerprint(out)}))
        return out

    def require(self, name: str) -> DataFrame:
        found = read_text(self.spark, f"{self.folder}/{name}.json")
        if not found or json.loads(found)["identity"] != self.identity:
            raise ConstraintError(f"stage {name} is missing or stale")
        return self.spark.read.parquet(f"{self.folder}/{name}")


def freeze(tables: Mapping[str, DataFrame]) -> dict:
    body = {k: table_fingerprint(v) for k, v in sorted(tables.items())}
    return {"tables": body, "seal": fingerprint(body)}


def verify_freeze(tables: Mapping[str, DataFrame], frozen: Mapping) -> None:
    if fingerprint(frozen["tables"]) != frozen["seal"] or freeze(tables)["tables"] != dict(frozen["tables"]):
        raise ConstraintError("the tables are not the frozen ones")


def assert_recomputed(cached: DataFrame, fresh: DataFrame) -> None:
    if not tables_equal(cached, fresh):
        raise ConstraintError("a fresh computation gives another table")


def reveal_after(candidates: DataFrame, read_inventory: Callable[[], DataFrame]) -> tuple[str, DataFrame]:
    """The candidates are sealed before the inventory is read."""
    return table_fingerprint(candidates), read_inventory()


def data_quality(long: DataFrame) -> DataFrame:
    return long.groupBy("metric").agg(
        F.count("*").alias("n"), F.count("value").alias("n_known"), F.count_if(F.col("value").isNull()).alias("n_unknown"), F.min("coverage").alias("min_coverage"), F.count_distinct("source_id").alias("n_sources")
    )


def sensitivity(base: DataFrame, cases: Mapping[str, Callable[[DataFrame], DataFrame]], evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The evaluated base and cases in one table, told apart by case_id: one plan, evaluated together."""
    out = evaluate(base).withColumn("case_id", F.lit("base"))
    for name, change in cases.items():
        out = out.unionByName(evaluate(change(base)).withColumn("case_id", F.lit(name)))
    return out


def resolution_overlap(fine: DataFrame, coarse: DataFrame, factor: int) -> DataFrame:
    """Jaccard of the areas two resolutions select, on the finer lattice (grid_row, grid_col)."""
    from . import spatial

    wide = spatial.children(coarse.select(F.col("grid_row").alias("parent_row"), F.col("grid_col").alias("parent_col")), factor).select("grid_row", "grid_col")
    both = fine.select("grid_row", "grid_col").withColumn("f", F.lit(1)).join(wide.withColumn("c", F.lit(1)), ["grid_row", "grid_col"], "full_outer")
    return both.agg(F.count_if(F.col("f").isNotNull() & F.col("c").isNotNull()).alias("n_both"), F.count("*").alias("n_either"), (F.count_if(F.col("f").isNotNull() & F.col("c").isNotNull()) / F.count("*")).alias("jaccard"))


def holdout_distance(train: DataFrame, held: DataFrame) -> DataFrame:
    """Common cells, and the least lattice distance between the two sets; null if one is empty.

    Cells meet by tiles whose size is the distance that is tried, and that distance doubles until a pair is within it, so
    the join only ever sees neighbours.
    """
    cells = lambda df: df.select(F.col("grid_row").alias("r"), F.col("grid_col").alias("c")).distinct()
    a, b = cells(train), cells(held)
    n_common = a.intersect(b).count()
    ends = a.unionByName(b).agg(F.max("r") - F.min("r"), F.max("c") - F.min("c")).first()
    least, reach = 0.0 if n_common else None, 1
    span = math.hypot(*ends) if ends[0] is not None else -1.0
    while least is None and reach < 2 * span + 2:
        at = lambda df, p: df.select(F.col("r").alias(f"{p}r"), F.col("c").alias(f"{p}c"), F.floor(F.col("r") / reach).alias("tr"), F.floor(F.col("c") / reach).alias("tc"))
        near = at(a, "a")
        for t in ("tr", "tc"):
            near = near.withColumn(t, F.explode(F.array(F.col(t) - 1, F.col(t), F.col(t) + 1)))
        far = F.hypot((F.col("ar") - F.col("br")).cast("double"), (F.col("ac") - F.col("bc")).cast("double"))
        least = near.join(at(b, "b"), ["tr", "tc"]).where(far <= reach).agg(F.min(far)).first()[0]
        reach *= 2
    return train.sparkSession.createDataFrame([(n_common, least)], "n_common bigint, least_cells double")
