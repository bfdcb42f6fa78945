"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same real number of copies (target / size of the source).  The
whole part is taken as it is; the fractional part is a probability that dependent rounding makes
0 or 1: two documents are paired and words are moved between them, at random and without bias, until
the probability of one is integral; the other goes on to the next pair.  A source's expected words never
change on the way, so what is taken misses the target by at most half a document (the last one of a
source, which has no partner, goes to the nearer integer).

So that this last document is small, the `LARGE` largest ones of a source at most (those of more than one `LARGE`-th of
its words) are decided first: each is paired with all smaller documents of its source as one unit, which together give or
take the words that it needs, and then share one new probability.  Where they cannot, they become integral and the large
document stays for the tree.

Documents are dealt to leaves of about `leaf` rows by a hash of their own columns; a leaf ends with
at most one undecided document a source, and those residuals are paired again up a tree of
`fan`-fold nodes.  Leaves, order and random numbers depend on the rows alone, not on partitions, so
reruns agree; a hot source is spread over all leaves.  Equal rows have random numbers of their own, by their place
in a leaf.

Defined results: a null text has size 0; a null source is a source of its own, last; documents of
size 0 take 0 words; repeated rows are rounded one by one; an empty table gives no rows; only `doc_id`, `source` and
`text` are read, and :func:`mix` gives back all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema

from . import blocks

WEIGHTS = (1, 2, 3)
CAP = 3
LARGE = 256
LEAF = 4096
FAN = 16


def size_of(text: str = "text"):
    """Words of a text, as a column."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): shares by weight, stopped at cap x size, the excess reshared.

    That fixed point is min(cap * size, weight * level) for the level at which all shares add up;
    sources in the order of cap * size / weight are capped up to the first that stays below.  One row
    a source goes through these windows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("at", F.col("most") / F.col("weight"))
    order = W.orderBy("at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("place", F.row_number().over(order)).withColumn("open", F.col("at") >= F.col("level"))
    first = F.min(F.when(F.col("open"), F.col("place"))).over(whole)
    level = F.max(F.when(F.col("place") == first, F.col("level"))).over(whole)
    target = F.when(F.col("place") < F.coalesce(first, F.lit(1 << 30)), F.col("most")).otherwise(F.col("weight") * level)
    return per.select("source", "source_size", F.least(target, F.col("most")).alias("target"), "n_docs")


def _schema(sizes: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in sizes.schema.fields}
    return f"node bigint, source {kind['source']}, doc_id {kind['doc_id']}, size bigint, source_size bigint, target double, copies bigint, p double, done boolean"


def _uniform(seed: int) -> float:
    """A uniform number in [0, 1) from a 64-bit number, mixed again."""
    x = seed & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return ((x ^ x >> 31) >> 11) * 2.0**-53


_STEP = 0x9E3779B97F4A7C15


def _large_first(schema: pa.Schema):
    """Rows of a source by falling size, then its smaller documents as one row without node: their words and probability.

    Each large document in turn becomes 0 or 1 against the pool; the rows come back with what they have become."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks.runs(batches, "key"):
            rows = table.to_pylist()
            pool, large = rows[0], rows[1:]  # sorted so
            words, held = float(pool["size"]), pool["size"] * pool["p"]
            for i, r in enumerate(large):
                a, x = float(r["size"]), r["p"]
                up, down = min(a * (1 - x), held), min(a * x, words - held)
                if up + down <= 0:
                    continue
                rise = _uniform(r["seed"] + i * _STEP) * (up + down) < down
                held += -up if rise else down
                r["p"] = x + (up if rise else -down) / a
                if (up >= a * (1 - x)) if rise else (down >= a * x):
                    r["copies"], r["p"], r["done"] = r["copies"] + int(rise), 0.0, True
            pool["p"] = min(max(held / words, 0.0), 1.0) if words else pool["p"]
            yield pa.RecordBatch.from_pylist([{k: r[k] for k in schema.names} for r in rows], schema=schema)

    return run


def _round(final: bool, schema: pa.Schema):
    """Rows come by (node, source).  Decided rows leave at once; one undecided row of a run is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None  # [node, source, doc_id, size, source_size, target, copies, p, seed]
        node, place = None, 0
        out: list[list] = []

        def decide(row: list, up: bool) -> None:
            out.append([*row[:6], row[6] + int(up), 0.0, True])

        def close(row: list) -> None:
            if final:  # nothing is left to pair it with: the nearer integer
                decide(row, row[7] >= 0.5)
            else:
                out.append([*row[:8], False])

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return made

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                row = list(row)
                place = place + 1 if row[0] == node else 0
                node = row[0]
                if not 0.0 < row[7] < 1.0 or not row[3]:
                    decide(row, row[3] > 0 and row[7] >= 1.0)
                    continue
                if held is None or held[:2] != row[:2]:
                    if held is not None:
                        close(held)
                    held = row
                    continue
                a, x, b, y = held[3], held[7], row[3], row[7]
                up, down = min(a * (1 - x), b * y), min(a * x, b * (1 - y))  # words that can move to, or from, the held row
                rise = _uniform(row[8] + place * _STEP) * (up + down) < down
                moved, decided = (up, a * (1 - x) <= b * y) if rise else (-down, a * x <= b * (1 - y))
                if decided:
                    decide(held, rise)
                    held = row
                    held[7] = min(max(y - moved / b, 0.0), 1.0)
                else:
                    decide(row, not rise)
                    held[7] = min(max(x + moved / a, 0.0), 1.0)
            if out:
                yield flush()
        if held is not None:
            close(held)
        if out:
            yield flush()

    return run


def _decide_large(rows: DataFrame, schema: str, arrow: pa.Schema, large: int) -> tuple[DataFrame, DataFrame]:
    """(the rows that go to the tree, with their new probabilities; the large rows that are decided)."""
    names = ["node", "source", "doc_id", "size", "source_size", "target", "copies", "p"]
    big = F.col("size") * large > F.col("source_size")
    open_row = (F.col("p") > 0) & (F.col("size") > 0)
    pools = rows.where(open_row & ~big).groupBy("source").agg(F.sum("size").alias("size"), F.max("p").alias("p"))
    head = pools.select(F.lit(None).cast("bigint").alias("node"), "source", F.lit(None).alias("doc_id"), "size", F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("copies"), "p")
    tall = rows.where(open_row & big).select(*names).join(pools.select(F.col("source").alias("__s")), F.col("source").eqNullSafe(F.col("__s")), "left_semi")
    both = head.unionByName(tall).withColumns({"seed": F.xxhash64("doc_id", "source", "size", F.lit(-1)), "done": F.lit(False), "key": F.xxhash64("source")})
    met = both.repartition("key").sortWithinPartitions("key", F.col("source").asc_nulls_last(), F.col("node").isNotNull(), F.col("size").desc(), "doc_id")
    made = blocks.materialize(met.mapInArrow(_large_first(arrow), schema), "mix-large")
    fresh = made.where("node IS NULL").select(F.col("source").alias("__s"), F.col("p").alias("__p"))
    left = rows.where(~(open_row & big)).join(F.broadcast(fresh), F.col("source").eqNullSafe(F.col("__s")), "left")  # one row a source
    left = left.withColumn("p", F.when(open_row, F.coalesce("__p", F.col("p"))).otherwise(F.col("p"))).select(*names)
    alone = rows.where(open_row & big).select(*names).join(pools.select(F.col("source").alias("__s")), F.col("source").eqNullSafe(F.col("__s")), "left_anti")
    undecided = made.where("node IS NOT NULL AND NOT done").select(*names)
    return left.unionByName(undecided).unionByName(alone), made.where("done").drop("node", "p", "done")


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, leaf: int = LEAF, fan: int = FAN, large: int = LARGE) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) of documents with doc_id, source and text."""
    spark = docs.sparkSession
    sizes = blocks.materialize(docs.select("doc_id", "source", size_of().alias("size")), "mix-sizes")
    targets = blocks.materialize(source_targets(sizes, weights, cap), "mix-targets")
    count = targets.agg(F.sum("n_docs")).first()[0] or 0
    nodes = max(1, -(-count // leaf))
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    rows = (
        sizes.join(targets.drop("n_docs"), sizes["source"].eqNullSafe(targets["source"]))
        .select(sizes["doc_id"], sizes["source"], "size", "source_size", "target", share.alias("share"))
        .withColumn("node", F.pmod(F.xxhash64("doc_id", "source", "size"), F.lit(nodes)).cast("bigint"))
        .withColumn("copies", F.floor("share").cast("bigint"))
        .withColumn("p", F.col("share") - F.col("copies"))
    )
    schema, level, out = _schema(sizes), 0, []
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    rows, decided = _decide_large(rows, schema, arrow, large)
    out.append(decided)
    while True:
        final = nodes == 1
        ordered = (
            rows.withColumn("seed", F.xxhash64("doc_id", "source", "size", F.lit(level)))
            .select("node", "source", "doc_id", "size", "source_size", "target", "copies", "p", "seed")
            .repartition(min(nodes, 4 * blocks.partitions(spark)), "node")
            .sortWithinPartitions("node", F.col("source").asc_nulls_last(), F.col("size").desc(), "doc_id")
        )
        made = blocks.materialize(ordered.mapInArrow(_round(final, arrow), schema), f"mix-{level}")
        out.append(made.where("done").drop("node", "p", "done"))
        if final:
            break
        rows = made.where("NOT done").drop("done").withColumn("node", F.floor(F.col("node") / fan).cast("bigint"))
        nodes, level = -(-nodes // fan), level + 1
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with their own columns."""
    names = docs.columns
    # rows of one id, source and size are told apart by number only, so the text itself is moved once: window and join share their key
    keyed = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.struct("doc_id", "source", size_of().alias("size")).alias("__key"), F.xxhash64("text").alias("__text"))
    keyed = keyed.withColumn("__nth", F.row_number().over(W.partitionBy("__key").orderBy("__text")))
    copies = mix_copies(docs.select("doc_id", "source", "text"), **options).select(F.struct("doc_id", "source", "size").alias("__key"), F.col("copies").alias("__k"))
    copies = copies.withColumn("__nth", F.row_number().over(W.partitionBy("__key").orderBy("__k")))
    taken = keyed.join(copies.hint("merge"), ["__key", "__nth"]).where("__k > 0")
    return taken.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__k").cast("int")))).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
