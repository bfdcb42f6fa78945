"""Joins, set operations and integrity constraints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table may be sent to every task.
SMALL_ROWS = 100_000


class ConstraintError(ValueError):
    """A table breaks a rule that the next step relies on."""


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint only for a table whose row count is checked; the optimizer decides otherwise."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a session without other machines may do without it: there a folder of our own is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ConstraintError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="meridia-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared checkpoint folder and read back, to cut the lineage of an iteration."""
    spark = df.sparkSession
    root = shared_folder(spark)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- constraints


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a whose keys b does not have."""
    return a.join(b.select(*keys), list(keys), "left_anti")


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = duplicates(df, keys).limit(1).collect()
    if bad:
        raise ConstraintError(f"duplicate key {bad[0].asDict()}")
    return df


def holds(check: Callable[[], object]) -> bool:
    """Whether a table keeps a rule."""
    try:
        check()
    except ConstraintError:
        return False
    return True


def expect_single_value(df: DataFrame, column: str) -> DataFrame:
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count_if(F.col(column).isNull()).alias("nulls")).first()
    if r["lo"] != r["hi"] or (r["nulls"] and r["lo"] is not None):
        raise ConstraintError(f"{column} has several values")
    return df


def expect_same_domain(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    for x, y in ((a, b), (b, a)):
        if orphans(x.select(*keys), y, keys).limit(1).collect():
            raise ConstraintError(f"the tables do not have the same {list(keys)}")


def expect_subset(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> None:
    if orphans(a.select(*keys), b, keys).limit(1).collect():
        raise ConstraintError(f"{list(keys)} without a parent")


def expect_all(df: DataFrame, rule: Column, text: str) -> DataFrame:
    if df.where(~F.coalesce(rule, F.lit(False))).limit(1).collect():
        raise ConstraintError(text)
    return df


def agrees(a: Column, b: Column, relative: float = 1e-10, absolute: float = 1e-12) -> Column:
    near = F.abs(a - b) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(a), F.abs(b)))
    return (a.isNull() & b.isNull()) | F.coalesce(near, F.lit(False))


def expect_complete_product(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every combination of the keys' values occurs exactly once."""
    r = df.agg(F.count("*").alias("n"), *[F.count_distinct(k).alias(k) for k in keys]).first()
    product = 1
    for k in keys:
        product *= r[k]
    if r["n"] != product:
        raise ConstraintError(f"{r['n']} rows, {product} combinations")
    return expect_unique(df, keys)


# ---------------------------------------------------------------- joins


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    expect_unique(a, keys)
    expect_unique(b, keys)
    return a.join(b, list(keys), "inner")


def lookup(a: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many-to-one left join; the dimension's key is checked."""
    expect_unique(dimension, keys)
    return a.join(dimension, list(keys), "left")


def fill_missing(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Mapping[str, object]) -> DataFrame:
    return a.join(b, list(keys), "left").fillna(dict(values))


def alternatives(cells: DataFrame, designs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """The product of cells with the few designs and scenarios."""
    return cells.crossJoin(small(designs)).crossJoin(small(scenarios))


def align(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of rows on both sides or on one."""
    x = a.select(*keys).withColumn("__a", F.lit(1))
    y = b.select(*keys).withColumn("__b", F.lit(1))
    both = x.join(y, list(keys), "full_outer")
    side = F.when(F.col("__a").isNull(), "right_only").when(F.col("__b").isNull(), "left_only").otherwise("both")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def list_match(a: DataFrame, a_list: str, b: DataFrame, b_key: str) -> DataFrame:
    """Rows of b whose key is in a's list, with a's columns: the list is exploded and equi-joined."""
    return a.withColumn("__k", F.explode(a_list)).join(b.withColumnRenamed(b_key, "__k"), "__k").withColumnRenamed("__k", b_key)


def match_names(a: DataFrame, name: str, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """The only match of a name, or null with the reason (no match, ambiguous)."""
    d = dictionary.groupBy(F.col(key).alias("__k")).agg(F.array_sort(F.collect_set(value)).alias("__v"))
    out = a.join(d, a[name] == d["__k"], "left")
    n = F.coalesce(F.size("__v"), F.lit(0))
    return out.withColumn("match", F.when(n == 1, F.get("__v", F.lit(0)))).withColumn("match_reason", F.when(n == 0, "no_match").when(n > 1, "ambiguous")).drop("__k", "__v")


def intersect_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def except_keys(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).exceptAll(b.select(*keys))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def tagged_union(layers: Mapping[str, DataFrame], tag: str = "source_layer") -> DataFrame:
    return union_all(*[df.withColumn(tag, F.lit(k)) for k, df in layers.items()])


def tables_equal(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets, whatever the column order: one commutative hash aggregate a side."""
    if sorted(a.columns) != sorted(b.columns):
        return False
    names = sorted(a.columns)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*names).cast("decimal(20,0)")), F.expr(f"bit_xor(xxhash64({', '.join(f'`{n}`' for n in names)}, 1))")).first()
    return tuple(mark(a)) == tuple(mark(b))


def wide_to_long(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], companions: Sequence[str] = ()) -> DataFrame:
    """One row a key and metric: value and the companion columns metric_<companion>."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), *[F.col(f"{m}_{c}").alias(c) for c in companions]) for m in metrics]
    return df.select(*keys, F.explode(F.array(*rows)).alias("__r")).select(*keys, "__r.*")


def long_to_wide(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).pivot("metric", list(metrics)).agg(F.first(value))
