"""Join, aggregate, window and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import decision as D
from ..operators import relations as R
from ..operators import results as RS
from ..operators import screening as SC
from ..sources import readers
from .queries_scalar import _SCORED, scored
from .registry import query

# ---------------------------------------------------------------- scans


@query("src01_src04_predicate_scan", "", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_shipmode_day = 1".replace("l_shipmode_day = 1", "l_linenumber IN (1, 3)"))
def src01(d) -> DataFrame:
    where = (F.col("l_returnflag") == "R") & F.col("l_linenumber").isin(1, 3)
    return readers.table(d.spark, f"{d.sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], where)


@query("src06_row_count", "", "SELECT count(*) AS n FROM lineitem")
def src06(d) -> DataFrame:
    return d.spark.createDataFrame([(readers.row_count(d.spark, f"{d.sf_dir}/lineitem.parquet"),)], "n bigint")


@query("src18_html_titles", "", r"SELECT page_id, regexp_extract(html, '(?i)<title>\s*([^<]*?)\s*</title>', 1) AS title FROM pages WHERE html LIKE '%<title>%'")
def src18(d) -> DataFrame:
    return d["pages"].where(F.col("html").contains("<title>")).select("page_id", F.regexp_extract("html", r"(?i)<title>\s*([^<]*?)\s*</title>", 1).alias("title"))


@query("src18_html_items")
def src18b(d) -> DataFrame:
    items = readers.html_items(d["pages"], "page_id")
    return items.groupBy("page_id", "tag").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src23_tagged_layers", "", "SELECT 'customers' AS source_layer, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_nationkey FROM supplier")
def src23(d) -> DataFrame:
    return R.tagged_union({"customers": d["customer"].select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), "suppliers": d["supplier"].select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))}).select("source_layer", "id", "nation")


# ---------------------------------------------------------------- joins


@query("jn01_one_to_one", "features", "SELECT cell_key, land, p_name FROM features JOIN part ON cell_key = p_partkey")
def jn01(d) -> DataFrame:
    return R.one_to_one(d["features"].select("cell_key", "land"), d["part"].select(F.col("p_partkey").alias("cell_key"), "p_name"), ["cell_key"])


@query("jn02_two_cases", "features designs scenarios", _SCORED + "SELECT a.grid_id, a.design_id, a.score AS base_score, b.score AS high_score FROM r a JOIN r b ON a.grid_id = b.grid_id AND a.design_id = b.design_id WHERE a.scenario_id = 'base' AND b.scenario_id = 'high'")
def jn02(d) -> DataFrame:
    r = scored(d).select("grid_id", "design_id", "scenario_id", "score")
    wide = r.groupBy("grid_id", "design_id").pivot("scenario_id", ["base", "high"]).agg(F.first("score"))  # the two sides share their keys: no self join
    return wide.select("grid_id", "design_id", F.col("base").alias("base_score"), F.col("high").alias("high_score"))


@query("jn03_jn06_jn07_lookup", "", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn03(d) -> DataFrame:
    n = d["nation"].withColumnRenamed("n_nationkey", "c_nationkey")
    x = R.lookup(d["customer"].select("c_custkey", "c_nationkey"), n, ["c_nationkey"])
    return R.lookup(x, d["region"].withColumnRenamed("r_regionkey", "n_regionkey"), ["n_regionkey"]).select("c_custkey", "n_name", "r_name")


@query("jn04_fill", "", "SELECT c_custkey, coalesce(n, 0) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON c_custkey = o_custkey")
def jn04(d) -> DataFrame:
    n = d["orders"].where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return R.fill_missing(d["customer"].select("c_custkey"), n, ["c_custkey"], {"n_orders": 0})


@query("jn05_jn10_semi", "features", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT cell_key FROM features WHERE land > 9e-1)")
def jn05(d) -> DataFrame:
    keep = d["features"].where("land > 0.9").select(F.col("cell_key").alias("l_partkey"))
    return d["lineitem"].join(keep, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("jn08_align", "", "SELECT CASE WHEN o.k IS NULL THEN 'left_only' WHEN c.k IS NULL THEN 'right_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT c_custkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') o ON c.k = o.k GROUP BY 1")
def jn08(d) -> DataFrame:
    return R.align(d["customer"].select(F.col("c_custkey").alias("k")), d["orders"].where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).distinct(), ["k"])


@query("jn09_alternatives", "features designs scenarios", "SELECT grid_id, design_id, scenario_id FROM features, designs, scenarios")
def jn09(d) -> DataFrame:
    return R.alternatives(d["features"].select("grid_id"), d["designs"], d["scenarios"]).select("grid_id", "design_id", "scenario_id")


@query("jn11_anti", "", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def jn11(d) -> DataFrame:
    return d["customer"].select("c_custkey").join(d["orders"].where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("jn12_list_match", "", "SELECT c_mktsegment, count(*) AS n FROM (SELECT s_suppkey, unnest([s_nationkey, (s_nationkey + 1) % 25]) AS k FROM supplier) s JOIN customer ON k = c_nationkey GROUP BY 1")
def jn12(d) -> DataFrame:
    s = d["supplier"].select("s_suppkey", F.array(F.col("s_nationkey"), (F.col("s_nationkey") + 1) % 25).alias("codes"))
    return R.list_match(s, "codes", d["customer"].select("c_nationkey", "c_mktsegment"), "c_nationkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("jn13_ambiguous_names", "", """
SELECT s_suppkey, CASE WHEN n = 1 THEN v END AS match, CASE WHEN n IS NULL THEN 'no_match' WHEN n > 1 THEN 'ambiguous' END AS match_reason
FROM (SELECT s_suppkey, 'seg' || (s_suppkey % 12) AS name FROM supplier) s
LEFT JOIN (SELECT 'seg' || (c_nationkey % 9) AS k, count(DISTINCT CASE WHEN c_nationkey % 9 = 4 THEN 'one' ELSE c_mktsegment END) AS n, min(CASE WHEN c_nationkey % 9 = 4 THEN 'one' ELSE c_mktsegment END) AS v FROM customer GROUP BY 1) ON name = k""")
def jn13(d) -> DataFrame:
    names = d["supplier"].select("s_suppkey", F.concat(F.lit("seg"), F.col("s_suppkey") % 12).alias("name"))
    book = d["customer"].select(F.concat(F.lit("seg"), F.col("c_nationkey") % 9).alias("k"), F.when(F.col("c_nationkey") % 9 == 4, "one").otherwise(F.col("c_mktsegment")).alias("v"))
    return R.match_names(names, "name", book, "k", "v").select("s_suppkey", "match", "match_reason")


@query("jn14_agg29_first_row", "", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def jn14(d) -> DataFrame:
    return A.first_row(d["orders"].select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey")


# ---------------------------------------------------------------- aggregates


@query("agg01_agg02_agg03_counts", "", """
SELECT l_returnflag, l_linestatus, count(*) AS n, count_if(l_discount > 5e-2) AS n_cheap, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, min(l_quantity) AS lo, max(l_quantity) AS hi,
  round(avg(l_extendedprice), 4) AS mean FROM lineitem GROUP BY 1, 2""")
def agg01(d) -> DataFrame:
    return d["lineitem"].groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("n_cheap"), F.sum(F.col("l_quantity").cast("bigint")).alias("qty"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean"),
    )


@query("agg04_strict_sum", "items", "SELECT alt_id, CASE WHEN count(kg) = count(*) THEN sum(kg) END AS total FROM items GROUP BY 1")
def agg04(d) -> DataFrame:
    return d["items"].groupBy("alt_id").agg(A.strict_sum("kg").alias("total"))


@query("agg05_weighted_mean", "features", """
SELECT brand, round(sum(CASE WHEN land IS NOT NULL THEN land * size END) / sum(CASE WHEN land IS NOT NULL THEN size END), 9) AS mean,
  round(least(1e0, coalesce(sum(CASE WHEN land IS NOT NULL THEN coverage / 1000e0 END), 0e0)), 9) AS cov FROM features GROUP BY 1""")
def agg05(d) -> DataFrame:
    return d["features"].groupBy("brand").agg(F.round(A.weighted_mean("land", F.col("size").cast("double")), 9).alias("mean"), F.round(A.coverage("land", F.col("coverage") / 1000.0), 9).alias("cov"))


@query("agg06_complete_year", "prices", """
SELECT state, yr, CASE WHEN count(DISTINCT CASE WHEN sales % 7 <> 0 THEN mon END) = 12 AND count(CASE WHEN sales % 7 <> 0 THEN 1 END) = 12 THEN round(sum(CASE WHEN sales % 7 <> 0 THEN sales * n END) / sum(CASE WHEN sales % 7 <> 0 THEN CAST(n AS DOUBLE) END), 6) END AS mean
FROM prices GROUP BY 1, 2""")
def agg06(d) -> DataFrame:
    x = d["prices"].withColumn("price", F.when(F.col("sales") % 7 != 0, F.col("sales").cast("double")))
    return x.groupBy("state", "yr").agg(F.round(A.complete_year_mean("mon", "price", F.col("n").cast("double")), 6).alias("mean"))


@query("agg07_agg08_primary_code", "", """
SELECT o_custkey, arg_min(o_orderpriority, ROW(-a, o_orderpriority)) AS primary_code, string_agg(o_orderpriority, ';' ORDER BY o_orderpriority) AS all_codes, count(*) AS n_codes
FROM (SELECT o_custkey, o_orderpriority, CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS a FROM orders GROUP BY 1, 2) GROUP BY 1""")
def agg07(d) -> DataFrame:
    return A.primary_and_all(d["orders"].select("o_custkey", "o_orderpriority", F.round("o_totalprice").cast("bigint").alias("area")), ["o_custkey"], "o_orderpriority", "area")


@query("agg09_share_map", "", """
SELECT nation, '{' || string_agg('"' || seg || '":' || CAST(round(a / t, 6) AS VARCHAR), ',' ORDER BY seg) || '}' AS shares_json FROM (SELECT c_nationkey AS nation, c_mktsegment AS seg, CAST(count(*) AS DOUBLE) AS a, CAST(sum(count(*)) OVER (PARTITION BY c_nationkey) AS DOUBLE) AS t FROM customer GROUP BY 1, 2) GROUP BY 1""")
def agg09(d) -> DataFrame:
    return A.share_map(d["customer"].select(F.col("c_nationkey").alias("nation"), "c_mktsegment", F.lit(1.0).alias("a")), ["nation"], "c_mktsegment", "a")


@query("agg10_class_fractions", "", """
SELECT l_suppkey, count_if(l_returnflag = 'A') / nullif(CAST(count_if(l_linestatus = 'F') AS DOUBLE), 0e0) * 1e0 AS frac_A, count_if(l_returnflag = 'R') / nullif(CAST(count_if(l_linestatus = 'F') AS DOUBLE), 0e0) AS frac_R, count_if(l_linestatus = 'F') / CAST(count(*) AS DOUBLE) AS coverage_frac
FROM (SELECT l_suppkey, l_linestatus, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS l_returnflag FROM lineitem) GROUP BY 1""")
def agg10(d) -> DataFrame:
    x = d["lineitem"].select("l_suppkey", "l_returnflag", "l_linestatus", F.lit(1.0).alias("a"))
    return A.class_fractions(x, ["l_suppkey"], "l_returnflag", "a", ["A", "R"], F.col("l_linestatus") == "F")


@query("agg13_agg15_distribution", "", """
WITH p AS (SELECT l_returnflag, l_extendedprice AS v, count(*) OVER (PARTITION BY l_returnflag) * (1e0 - 95e-2) AS mass, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS rn FROM lineitem)
SELECT l_returnflag, round(avg(v), 3) AS mean, round(quantile_cont(v, 5e-1), 6) AS median, round(quantile_cont(v, 5e-2), 6) AS p05, round(quantile_cont(v, 95e-2), 6) AS p95,
  round(sum(least(1e0, greatest(0e0, mass - (rn - 1))) * v) / any_value(mass), 3) AS cvar FROM p GROUP BY 1""")
def agg13(d) -> DataFrame:
    out = A.distribution(d["lineitem"].select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 0.95)
    return out.select("l_returnflag", *[F.round(c, r).alias(c) for c, r in (("mean", 3), ("median", 6), ("p05", 6), ("p95", 6), ("cvar", 3))])


@query("agg16_wilson", "", """
SELECT source, round(greatest(0e0, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS wilson_low,
  round(least(1e0, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)), 9) AS wilson_high
FROM (SELECT source, count_if(quality = 1) / CAST(count(*) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n, 1959963984540054e-15 AS z FROM documents JOIN labels USING (doc_id) GROUP BY 1)""")
def agg16(d) -> DataFrame:
    x = d["documents"].select("doc_id", "source").join(d["labels"], "doc_id").groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n"))
    return x.select("source", *[F.round(c, 9).alias(k) for k, c in A.wilson("k", "n").items()])


@query("agg17_bootstrap", "", """
WITH s AS (SELECT c_nationkey AS cand, CAST(c_custkey % 25 AS BIGINT) AS draw, c_acctbal AS v FROM customer),
picks AS (SELECT CAST(floor(id / 25e0) AS INTEGER) AS round, CAST(floor(CAST(('0x' || substr(sha256('42:' || id), 1, 8)) AS BIGINT) / 4294967296e0 * 25) AS BIGINT) AS draw FROM range(1000) t(id)),
m AS (SELECT cand, round, avg(v) AS m FROM picks JOIN s USING (draw) GROUP BY 1, 2)
SELECT cand, round(stddev_samp(m), 3) AS se, round(quantile_cont(m, 25e-3), 3) AS low, round(quantile_cont(m, 975e-3), 3) AS high FROM m GROUP BY 1""")
def agg17(d) -> DataFrame:
    s = d["customer"].select(F.col("c_nationkey").alias("cand"), (F.col("c_custkey") % 25).cast("bigint").alias("draw"), F.col("c_acctbal").alias("v"))
    out = A.bootstrap_means(s, ["cand"], "draw", "v", 25, 40, 42)
    return out.select("cand", *[F.round(c, 3).alias(c) for c in ("se", "low", "high")])


@query("agg18_agg19_overlap", "vectors", """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 9 > 0 THEN rank() OVER (ORDER BY a DESC, vec_id) END AS x, CASE WHEN vec_id % 7 > 0 THEN rank() OVER (ORDER BY c DESC, vec_id) END AS y FROM vectors)
SELECT count_if(x <= 50 AND y <= 50) AS n_both, count_if(x <= 50 OR y <= 50) AS n_either, count_if(x <= 50 AND y <= 50) / CAST(count_if(x <= 50 OR y <= 50) AS DOUBLE) AS jaccard, round(corr(x, y), 9) AS rank_correlation FROM r""")
def agg18(d) -> DataFrame:
    v = d["vectors"].withColumn("one", F.lit(1))
    r = D.rank(D.rank(v, ["one"], ["vec_id"], "a", "x"), ["one"], ["vec_id"], "c", "y")
    r = r.withColumn("x", F.when(F.col("vec_id") % 9 > 0, F.col("x"))).withColumn("y", F.when(F.col("vec_id") % 7 > 0, F.col("y")))
    return D.top_overlap(r, "x", "y", 50).withColumn("rank_correlation", F.round("rank_correlation", 9))


@query("agg20_rank_ranges", "features designs scenarios", _SCORED + """, k AS (SELECT grid_id, design_id, scenario_id, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY scenario_id, score IS NULL ORDER BY score DESC, grid_id, design_id) END AS rank FROM r)
SELECT grid_id, design_id, CAST(min(rank) AS INTEGER) AS rank_min, CAST(max(rank) AS INTEGER) AS rank_max, count(rank) AS n_ranked, count(*) AS n_cases FROM k GROUP BY 1, 2""")
def agg20(d) -> DataFrame:
    return D.rank_ranges(D.rank(scored(d).select("grid_id", "design_id", "scenario_id", "score")), ["grid_id", "design_id"])


@query("agg21_auc", "scores", """
WITH p AS (SELECT valued, count(*) AS n, count_if(positive) AS k FROM scores WHERE valued IS NOT NULL GROUP BY 1),
q AS (SELECT *, coalesce(sum(n) OVER (ORDER BY valued ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM p)
SELECT round(CAST(sum(k * (below + 5e-1 * n)) AS DOUBLE) / CAST(sum(k) * sum(n) AS DOUBLE), 9) AS auc, CAST(sum(k) AS BIGINT) AS n_positive, CAST(sum(n) AS BIGINT) AS n_valued FROM q""")
def agg21(d) -> DataFrame:
    return A.auc(d["scores"], "valued", "positive").withColumn("auc", F.round(F.col("auc").cast("double"), 9))


@query("agg22_agg23_percentiles", "scores", """
SELECT doc_id, CASE WHEN valued IS NOT NULL THEN round((rank() OVER (PARTITION BY lang, valued IS NULL ORDER BY valued) - 1 + 5e-1 * count(*) OVER (PARTITION BY lang, valued)) / count(valued) OVER (PARTITION BY lang, valued IS NULL), 9) END AS of_score,
  CASE WHEN valued IS NOT NULL THEN round(CASE WHEN count(valued) OVER (PARTITION BY lang, valued IS NULL) = 1 THEN 50e0 ELSE (rank() OVER (PARTITION BY lang, valued IS NULL ORDER BY valued) + (count(*) OVER (PARTITION BY lang, valued) - 1e0) / 2e0 - 1e0) / (count(valued) OVER (PARTITION BY lang, valued IS NULL) - 1e0) * 100e0 END, 9) END AS midrank
FROM scores""")
def agg22(d) -> DataFrame:
    x = A.midrank_percentile(A.percentile_of_score(d["scores"], "valued", ["lang"], "of_score"), "valued", ["lang"], "midrank")
    return x.select("doc_id", F.round(F.col("of_score").cast("double"), 9).alias("of_score"), F.round("midrank", 9).alias("midrank"))


@query("agg24_hit_rates", "", """
WITH r AS (SELECT row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, CAST((p_partkey * 13) % 60 AS DOUBLE) AS km FROM part)
SELECT top_n, radius_km, avg(CAST(km <= radius_km AS INTEGER)) AS hit_rate FROM r, (VALUES (10), (50), (100)) AS n(top_n), (VALUES (10e0), (25e0)) AS k(radius_km) WHERE rank <= top_n GROUP BY 1, 2 HAVING count(*) = top_n""")
def agg24(d) -> DataFrame:
    p = d["part"].select(F.row_number().over(W.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"), ((F.col("p_partkey") * 13) % 60).cast("double").alias("km"))
    return A.hit_rates(p, "rank", "km", [10, 50, 100], [10.0, 25.0])


@query("agg25_empirical_p", "", """
SELECT c_nationkey, (1 + count_if(c_acctbal >= 4000e0 - 1e-12)) / CAST(1 + count(c_acctbal) AS DOUBLE) AS p_value, round(4000e0 / nullif(avg(c_acctbal), 0e0), 9) AS lift FROM customer GROUP BY 1""")
def agg25(d) -> DataFrame:
    return A.empirical_p(d["customer"].withColumn("obs", F.lit(4000.0)), ["c_nationkey"], "obs", "c_acctbal").withColumn("lift", F.round("lift", 9))


@query("agg26_completeness", "", "SELECT user_id, count_if(value > 10) / 30e0 AS temporal_coverage, count_if(value > 10) AS n_valid FROM events GROUP BY 1")
def agg26(d) -> DataFrame:
    return A.completeness(d["events"], ["user_id"], F.col("value") > 10, 30)


@query("agg27_agg28_conflicts", "", """
SELECT c_nationkey, CASE WHEN count(DISTINCT coalesce(c_mktsegment, chr(0))) = 1 THEN max(c_mktsegment) END AS c_mktsegment, CASE WHEN count(DISTINCT k) = 1 THEN max(k) END AS k,
  concat_ws(';', CASE WHEN count(DISTINCT c_mktsegment) > 1 THEN 'c_mktsegment' END, CASE WHEN count(DISTINCT k) > 1 THEN 'k' END) AS conflicts, count(*) AS n_rows
FROM (SELECT c_nationkey, c_mktsegment, c_nationkey * 2 AS k FROM customer) GROUP BY 1""")
def agg27(d) -> DataFrame:
    return A.conflicts(d["customer"].select("c_nationkey", "c_mktsegment", (F.col("c_nationkey") * 2).alias("k")), ["c_nationkey"], ["c_mktsegment", "k"])


@query("agg28_collected", "", "SELECT n_regionkey, string_agg(DISTINCT n_name, ';' ORDER BY n_name) AS names, count(*) AS n_rows FROM nation GROUP BY 1")
def agg28(d) -> DataFrame:
    return A.collected(d["nation"], ["n_regionkey"], "n_name", "names")


@query("agg30_agg35_by_count", "", """
WITH p AS (SELECT c_nationkey, CASE WHEN c_nationkey = 3 AND c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS seg, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_nationkey, CASE WHEN NOT bool_or(seg IS NULL) THEN string_agg(seg, ';' ORDER BY n DESC, seg) END AS segments FROM p GROUP BY 1""")
def agg30(d) -> DataFrame:
    x = d["customer"].select("c_nationkey", F.when(~((F.col("c_nationkey") == 3) & (F.col("c_custkey") % 5 == 0)), F.col("c_mktsegment")).alias("seg"))
    return A.codes_by_count(x, ["c_nationkey"], "seg", "segments")


@query("agg35_top3", "", "SELECT c_nationkey, c_mktsegment, n, place FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS INTEGER) AS place FROM customer GROUP BY 1, 2) WHERE place <= 3")
def agg35(d) -> DataFrame:
    return A.most_frequent(d["customer"], ["c_nationkey"], "c_mktsegment", 3)


@query("agg31_parent_summary", "features", """
SELECT brand, arg_max(grid_id, ROW(land, -grid_row, -grid_col)) AS best_grid_id, max(land) AS best_score, count(land) AS n_scored, round(quantile_cont(land, 9e-1), 9) AS p90 FROM features WHERE land IS NOT NULL GROUP BY 1""")
def agg31(d) -> DataFrame:
    return A.parent_summary(d["features"].where("land IS NOT NULL"), ["brand"], "land").withColumn("p90", F.round("p90", 9))


@query("agg32_coverage_ladder", "features", """
SELECT source_id, min(coverage) AS lo, max(coverage) AS hi, count(*) AS expected, count(land) AS ready, CASE WHEN count(land) = 0 THEN 'BLOCKED' WHEN count(land) < count(*) THEN 'PARTIAL' ELSE 'READY' END AS ladder FROM features GROUP BY 1""")
def agg32(d) -> DataFrame:
    return d["features"].groupBy("source_id").agg(F.min("coverage").alias("lo"), F.max("coverage").alias("hi"), F.count("*").alias("expected"), F.count("land").alias("ready"), A.status_ladder(F.count("*"), F.count("land")).alias("ladder"))


@query("agg34_centroid", "points", """
WITH m AS (SELECT nation, avg(cos(radians(lat)) * cos(radians(lon))) AS x, avg(cos(radians(lat)) * sin(radians(lon))) AS y, avg(sin(radians(lat))) AS z, count(*) AS n FROM points GROUP BY 1)
SELECT nation, round(degrees(asin(z / sqrt(x * x + y * y + z * z))), 6) AS lat, round(degrees(atan2(y, x)), 6) AS lon, n FROM m""")
def agg34(d) -> DataFrame:
    return A.sphere_centroid(d["points"], ["nation"], "lat", "lon").withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query("agg36_component_rollup", "items", """
SELECT alt_id, CASE WHEN count(kg) = count(*) AND count(DISTINCT module) = 3 THEN sum(kg) END AS total_kg, coalesce(sum(kg), 0e0) AS known_kg,
  concat_ws(';', CASE WHEN NOT bool_or(module = 'A1-A3') THEN 'A1-A3' END, CASE WHEN NOT bool_or(module = 'A4') THEN 'A4' END, CASE WHEN NOT bool_or(module = 'B1') THEN 'B1' END) AS missing_modules FROM items GROUP BY 1""")
def agg36(d) -> DataFrame:
    return A.component_rollup(d["items"], ["alt_id"], ["A1-A3", "A4", "B1"])


@query("agg37_cube", "features", "SELECT source_id, status, count(*) AS n, count(land) AS n_known, min(coverage) AS min_coverage FROM features GROUP BY CUBE (source_id, status)")
def agg37(d) -> DataFrame:
    from ..operators.adapters import coverage_report

    return coverage_report(d["features"].withColumnRenamed("land", "value"))


# ---------------------------------------------------------------- windows, sorts, sets


@query("win02_top_fraction", "features", "SELECT grid_id, brand, carbon FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY carbon DESC, grid_id) AS rn, count(*) OVER (PARTITION BY brand) AS n FROM features) WHERE rn <= ceil(n * 25e-2)")
def win02(d) -> DataFrame:
    return D.top_fraction(d["features"], ["brand"], 0.25, "carbon", ["grid_id"]).select("grid_id", "brand", "carbon")


@query("win03_tie_block", "features", "SELECT cell_key, rank() OVER (PARTITION BY brand ORDER BY size DESC) AS rank_min, rank() OVER (PARTITION BY brand ORDER BY size DESC) + count(*) OVER (PARTITION BY brand, size) - 1 AS rank_max FROM features")
def win03(d) -> DataFrame:
    out = D.tie_block(d["features"], ["brand"], "size")
    return out.select("cell_key", F.col("rank_min").cast("bigint").alias("rank_min"), "rank_max")


@query("win04_gaps", "", """
SELECT event_id, user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000e0 AS gap_hours FROM events""")
def win04(d) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return d["events"].select("event_id", "user_id", ((us - F.lag(us).over(W.partitionBy("user_id").orderBy("ts", "event_id"))) / 3.6e9).alias("gap_hours"))


@query("win05_cumulative", "", "SELECT s_suppkey, CAST(sum(s_suppkey % 17) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM supplier")
def win05(d) -> DataFrame:
    w = W.partitionBy("s_nationkey").orderBy("s_suppkey").rowsBetween(W.unboundedPreceding, 0)
    return d["supplier"].select("s_suppkey", F.sum(F.col("s_suppkey") % 17).over(w).alias("running"))


@query("win06_nulls_last", "features", "SELECT cell_key, CAST(row_number() OVER (PARTITION BY brand ORDER BY stress DESC NULLS LAST, cell_key) AS INTEGER) AS rank FROM features")
def win06(d) -> DataFrame:
    return d["features"].select("cell_key", F.row_number().over(W.partitionBy("brand").orderBy(F.desc_nulls_last("stress"), "cell_key")).alias("rank"))


@query("win07_best_design", "features designs scenarios", _SCORED + "SELECT grid_id, scenario_id, max(score) AS score, arg_max(design_id, ROW(score, CASE design_id WHEN 'air' THEN 0 ELSE -1 END)) FILTER (WHERE score IS NOT NULL) AS design_id FROM r GROUP BY 1, 2")
def win07(d) -> DataFrame:
    x = scored(d).withColumn("place", F.when(F.col("design_id") == "air", 0).otherwise(1))
    return D.best_over(x, ["grid_id", "scenario_id"], "score", "design_id", "place")


@query("win09_label_suffix", "", "SELECT c_custkey, CASE WHEN rn = 1 THEN seg ELSE seg || ' · area ' || rn END AS shown FROM (SELECT c_custkey, c_mktsegment || '/' || c_nationkey AS seg, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS rn FROM customer)")
def win09(d) -> DataFrame:
    x = d["customer"].select("c_custkey", F.concat("c_mktsegment", F.lit("/"), F.col("c_nationkey").cast("string")).alias("seg"))
    return RS.label_suffix(x, "seg", "c_custkey").select("c_custkey", "shown")


@query("top01_top_k", "", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top01(d) -> DataFrame:
    return D.top_k(d["orders"].select("o_orderkey", "o_totalprice"), 100, F.desc("o_totalprice"), "o_orderkey")


@query("top02_top03_groups", "features", "SELECT brand, grid_id, carbon FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY carbon DESC, size = 10 DESC, grid_id) AS rn FROM features) WHERE rn = 1 ORDER BY carbon DESC, brand LIMIT 10")
def top02(d) -> DataFrame:
    best = A.first_row(d["features"], ["brand"], F.desc("carbon"), F.desc(F.col("size") == 10), "grid_id")
    return D.top_k(best, 10, F.desc("carbon"), "brand").select("brand", "grid_id", "carbon")


@query("top06_preferred", "", "SELECT n_nationkey, n_name FROM nation ORDER BY CASE WHEN n_nationkey = 7 THEN 1 WHEN n_nationkey = 3 THEN 2 ELSE 3 END, n_name LIMIT 6")
def top06(d) -> DataFrame:
    x = d["nation"].withColumn("k", F.col("n_nationkey").cast("string"))
    return RS.preferred_then_fill(x, ["7", "3"], "k", 6, "n_name").select("n_nationkey", "n_name")


@query("rank_large_exact", "", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders")
def rank_large(d) -> DataFrame:
    return D.rank_large(d["orders"].select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice").select("o_orderkey", "rank")


@query("set01_set03_union_distinct", "", "SELECT DISTINCT nation FROM (SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def set01(d) -> DataFrame:
    return R.union_all(d["customer"].select(F.col("c_nationkey").alias("nation")), d["supplier"].select(F.col("s_nationkey").alias("nation"))).distinct()


@query("set02_intersect_except", "", """SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)
  UNION ALL SELECT 'only', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def set02(d) -> DataFrame:
    c, s = d["customer"].where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k")), d["supplier"].where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    return R.intersect_keys(c, s, ["k"]).withColumn("side", F.lit("both")).unionByName(R.except_keys(d["nation"].select(F.col("n_nationkey").alias("k")), s, ["k"]).withColumn("side", F.lit("only")))


@query("set04_table_equality", "", "SELECT TRUE AS same, FALSE AS changed")
def set04(d) -> DataFrame:
    n = d["nation"]
    return d.spark.createDataFrame([(R.tables_equal(n, n.select("n_name", "n_regionkey", "n_nationkey").orderBy("n_name")), R.tables_equal(n, n.limit(24)))], "same boolean, changed boolean")


@query("set05_unpivot", "features", "SELECT cell_key, 'land' AS metric, land AS value FROM features UNION ALL SELECT cell_key, 'stress', stress FROM features UNION ALL SELECT cell_key, 'carbon', carbon FROM features")
def set05(d) -> DataFrame:
    return R.wide_to_long(d["features"], ["cell_key"], ["land", "stress", "carbon"])


@query("set06_pivot", "", "SELECT user_id, count_if(event_type = 'click') AS click, count_if(event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def set06(d) -> DataFrame:
    long = d["events"].groupBy("user_id", F.col("event_type").alias("metric")).agg(F.count("*").alias("value"))
    return R.long_to_wide(long, ["user_id"], ["click", "purchase"]).fillna(0, ["click", "purchase"])


@query("srt01_srt02_export_order", "features", "SELECT grid_id, row_number() OVER (ORDER BY land DESC NULLS LAST, carbon, grid_id) AS position FROM features")
def srt01(d) -> DataFrame:
    return D.positions(d["features"], F.desc_nulls_last("land"), "carbon", "grid_id").select("grid_id", "position")


@query("con01_duplicates", "", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def con01(d) -> DataFrame:
    return R.duplicates(d["orders"], ["o_custkey", "o_orderpriority"])


@query("con02_orphans", "", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def con02(d) -> DataFrame:
    return R.orphans(d["customer"].select("c_custkey"), d["orders"].where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query("con03_rules", "features designs scenarios", """
SELECT 'unique' AS rule, count(*) = count(DISTINCT cell_key) AS holds FROM features UNION ALL SELECT 'unique_brand', count(*) = count(DISTINCT brand) FROM features
UNION ALL SELECT 'subset', bool_and(l_partkey IN (SELECT cell_key FROM features)) FROM lineitem UNION ALL SELECT 'subset_big', bool_and(l_partkey IN (SELECT cell_key FROM features WHERE size > 5)) FROM lineitem
UNION ALL SELECT 'product', count(*) = (SELECT count(DISTINCT brand) * count(DISTINCT size) FROM features) FROM (SELECT DISTINCT brand, size FROM features)
UNION ALL SELECT 'single', count(DISTINCT source_id) = 1 FROM features UNION ALL SELECT 'single_air', count(DISTINCT design_id) = 1 FROM designs WHERE wue = 0""")
def con03(d) -> DataFrame:
    """Each rule on a table that keeps it or breaks it."""
    f, parts = d["features"], d["lineitem"].select(F.col("l_partkey").alias("cell_key"))
    rules = {
        "unique": lambda: R.expect_unique(f, ["cell_key"]), "unique_brand": lambda: R.expect_unique(f, ["brand"]), "subset": lambda: R.expect_subset(parts, f, ["cell_key"]),
        "subset_big": lambda: R.expect_subset(parts, f.where("size > 5"), ["cell_key"]), "product": lambda: R.expect_complete_product(f.select("brand", "size").distinct(), ["brand", "size"]),
        "single": lambda: R.expect_single_value(f, "source_id"), "single_air": lambda: R.expect_single_value(d["designs"].where("wue = 0"), "design_id"),
    }
    return d.spark.createDataFrame([(name, R.holds(check)) for name, check in rules.items()], "rule string, holds boolean")


@query("top05_tie_prefix", "features", "SELECT grid_id, size FROM features WHERE size >= (SELECT min(size) FROM (SELECT size FROM features ORDER BY size DESC LIMIT 30))")
def top05(d) -> DataFrame:
    return D.tie_prefix(d["features"], "size", 30).select("grid_id", "size")


# ---------------------------------------------------------------- results


@query("api01_run_document", "", """
SELECT 'r' || n_regionkey AS region_id, count(*) AS n_members, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1""")
def api01(d) -> DataFrame:
    regions = d["region"].select(F.concat(F.lit("r"), "r_regionkey").alias("region_id"), "r_name")
    members = d["nation"].select(F.concat(F.lit("r"), "n_regionkey").alias("region_id"), F.col("n_name").alias("grid_id"), F.lit(1.0).alias("score"))
    checks = regions.select("region_id", F.lit("land").alias("requirement_id"), F.lit("PASS").alias("result"))
    doc = RS.run_document(regions, members, checks)
    parsed = F.from_json(F.get_json_object("document", "$.members"), "array<struct<grid_id:string,score:double>>")
    return doc.select("region_id", F.size(parsed).cast("bigint").alias("n_members"), F.array_join(F.transform(parsed, lambda m: m["grid_id"]), ",").alias("names"))


@query("api03_factor_groups", "features", "SELECT cell_key, 'site' AS factor, CASE WHEN land IS NOT NULL AND stress IS NOT NULL THEN land * 5e-1 + stress * 5e-1 END AS factor_score FROM features")
def api03(d) -> DataFrame:
    long = R.wide_to_long(d["features"], ["cell_key"], ["land", "stress"]).withColumn("factor", F.lit("site")).withColumn("local_weight", F.lit(0.5))
    return RS.factor_groups(long, ["cell_key"])


@query("api05_funnel", "features", "SELECT 'all' AS stage, count(*) AS n FROM features UNION ALL SELECT 'land', count_if(land > 3e-1) FROM features UNION ALL SELECT 'water', count_if(land > 3e-1 AND stress < 3) FROM features")
def api05(d) -> DataFrame:
    return RS.funnel(d["features"], {"all": F.lit(True), "land": F.col("land") > 0.3, "water": F.col("stress") < 3})


@query("api06_outline", "squares", """
SELECT square_id, CAST(k AS INTEGER) AS k, CASE k // 2 WHEN 0 THEN xmin + (k % 2) / 2e0 * (xmax - xmin) WHEN 1 THEN xmax WHEN 2 THEN xmax - (k % 2) / 2e0 * (xmax - xmin) ELSE xmin END AS x FROM squares, range(8) t(k)""")
def api06(d) -> DataFrame:
    return RS.outline(d["squares"], 2).select("square_id", "k", "x")


@query("cli01_same_place", "", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END NULLS LAST, p_partkey) = 1 AS is_first FROM part")
def cli01(d) -> DataFrame:
    x = d["part"].select(F.col("p_partkey").alias("region_id"), F.array("p_brand").alias("member_grid_ids"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("rank"))
    return RS.same_place(x).select(F.col("region_id").alias("p_partkey"), "is_first")


@query("lin06_data_quality", "features", """
SELECT 'land' AS metric, count(*) AS n, count(land) AS n_known, count(*) - count(land) AS n_unknown, min(coverage) AS min_coverage, count(DISTINCT source_id) AS n_sources FROM features
UNION ALL SELECT 'stress', count(*), count(stress), count(*) - count(stress), min(coverage), count(DISTINCT source_id) FROM features""")
def lin06(d) -> DataFrame:
    from ..operators.lineage import data_quality

    return data_quality(R.wide_to_long(d["features"], ["cell_key", "coverage", "source_id"], ["land", "stress"]))


@query("lin07_sensitivity", "features", """
SELECT cell_key, case_id, CASE case_id WHEN 'base' THEN carbon WHEN 'low' THEN carbon * 8e-1 ELSE carbon + 10e0 END AS value FROM features, (VALUES ('base'), ('low'), ('plus')) AS t(case_id)""")
def lin07(d) -> DataFrame:
    from ..operators.lineage import sensitivity

    cases = {"low": lambda x: x.withColumn("carbon", F.col("carbon") * 0.8), "plus": lambda x: x.withColumn("carbon", F.col("carbon") + 10.0)}
    return sensitivity(d["features"].select("cell_key", "carbon"), cases, lambda x: x.select("cell_key", F.col("carbon").alias("value")))


@query("lin10_temporal", "features", """
SELECT cell_key, CAST(y AS INTEGER) AS year, CASE WHEN y = 2030 THEN carbon END AS carbon_kg, CASE WHEN y = 2030 THEN 'scenario' ELSE 'unknown' END AS value_status FROM features, range(2030, 2035) t(y)""")
def lin10(d) -> DataFrame:
    from ..operators.lifecycle import annual_rows

    return annual_rows(d["features"].select("cell_key", F.col("carbon").alias("carbon_kg")), 2030, 5, False)
