"""Compositions: briefs, payloads, lineage results and the remaining adapters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adapters as AD
from ..operators import decision as D
from ..operators import lineage as LN
from ..operators import relations as R
from ..operators import results as RS
from ..operators import spatial as SP
from ..sources import sinks
from .queries_scalar import _SCORED, hav, scored
from .registry import query

_RANKED = _SCORED + """, k AS (SELECT grid_id, design_id, scenario_id, score, CASE WHEN score IS NOT NULL THEN row_number() OVER (PARTITION BY scenario_id, score IS NULL ORDER BY score DESC, grid_id, design_id) END AS rank FROM r)
"""


@query("dec20_brief", "features designs scenarios", _RANKED + """, c AS (SELECT grid_id, max(score) AS score, arg_min(design_id, rank) AS design_id, CASE WHEN count(score) = count(*) THEN max(score) - min(score) END AS design_delta, min(rank) AS rank FROM k WHERE scenario_id = 'base' GROUP BY 1)
SELECT grid_id, score, design_id, design_delta, CAST(rank AS INTEGER) AS rank, CASE WHEN row_number() OVER (ORDER BY rank, grid_id) = 1 THEN 'selected' ELSE 'alternative' END AS role FROM c WHERE rank IS NOT NULL ORDER BY rank, grid_id LIMIT 3""")
def dec20(d) -> DataFrame:
    return D.brief(D.rank(scored(d).select("grid_id", "design_id", "scenario_id", "score")), "base").drop("place")


@query("dec22_reevaluate", "features designs", """
WITH p AS (SELECT grid_id, design_id, 'now' AS scenario_id, 120e0 * 8e-1 * 8760e0 * pue * carbon / 1000e0 AS carbon_t, 120e0 * 8e-1 * 8760e0 * 1000e0 * wue / 1000e0 AS water_m3 FROM features, designs),
n AS (SELECT *, 100e0 - 100e0 * (least(greatest(carbon_t, 0e0), 1000000e0) - 0e0) / 1000000e0 AS c, 100e0 - 100e0 * (least(greatest(water_m3, 0e0), 1000000e0) - 0e0) / 1000000e0 AS w FROM p)
SELECT grid_id, design_id, c * 5e-1 + w * 5e-1 AS score, CAST(row_number() OVER (ORDER BY c * 5e-1 + w * 5e-1 DESC, grid_id, design_id) AS INTEGER) AS rank FROM n""")
def dec22(d) -> DataFrame:
    x = d["features"].select("grid_id", "carbon").crossJoin(R.small(d["designs"])).withColumns({"scenario_id": F.lit("now"), "eligible": F.lit(True), "conditional": F.lit(False)})
    return D.reevaluate(x, 120.0, 0.8, 8760.0, {"carbon": 0.5, "water": 0.5}, 1e6, 1e6).select("grid_id", "design_id", "score", "rank")


@query("dec14_global_rank", "features designs scenarios", _SCORED + "SELECT grid_id, design_id, scenario_id, row_number() OVER (ORDER BY score DESC, grid_id, design_id, scenario_id) AS rank FROM r WHERE score IS NOT NULL")
def dec14(d) -> DataFrame:
    return D.rank_large(scored(d).select("grid_id", "design_id", "scenario_id", "score"), ["grid_id", "design_id", "scenario_id"]).select("grid_id", "design_id", "scenario_id", "rank")


@query("api02_indicator_layer", "features", """
SELECT f.grid_id, v.value, v.statuses, v.n_alternatives FROM features f LEFT JOIN (SELECT grid_id, any_value(land) AS value, string_agg(DISTINCT s, ',' ORDER BY s) AS statuses, count(*) AS n_alternatives
FROM (SELECT grid_id, land, CASE WHEN d = 0 THEN status ELSE 'scenario' END AS s FROM features, range(2) t(d) WHERE size > 10) GROUP BY 1) v USING (grid_id)""")
def api02(d) -> DataFrame:
    f = d["features"]
    m = f.where("size > 10").withColumn("status", F.explode(F.array(F.col("status"), F.lit("scenario")))).select("grid_id", F.col("land").alias("value"), "status")
    out = RS.indicator_layer(f.select("grid_id"), m, ["grid_id"])
    return out.select("grid_id", "value", F.array_join("statuses", ",").alias("statuses"), "n_alternatives")


@query("api07_payload", "features", """
SELECT brand, '[' || string_agg('{"grid_id":"' || grid_id || '","size":' || size || '}', ',' ORDER BY grid_id) || ']' AS payload FROM (SELECT brand, grid_id, size, row_number() OVER (PARTITION BY brand ORDER BY size DESC, grid_id) AS rn FROM features) WHERE rn <= 3 GROUP BY 1""")
def api07(d) -> DataFrame:
    top = D.rank(d["features"].select("brand", "grid_id", "size"), ["brand"], ["grid_id"], "size").where("rank <= 3")
    return top.groupBy("brand").agg(F.to_json(F.array_sort(F.collect_list(F.struct("grid_id", "size")))).alias("payload"))


@query("cli03_overlap_regions", "", "SELECT p_partkey AS region_id FROM part WHERE p_size > 40 AND (p_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 5 = 0) OR p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 5 = 0 AND p_size < 4))")
def cli03(d) -> DataFrame:
    p = d["part"].select(F.col("p_partkey").alias("region_id"), F.array("p_brand").alias("member_grid_ids"), "p_size")
    b = p.where("region_id % 5 = 0")
    named = b.where("p_size < 4").unionByName(b.withColumn("member_grid_ids", F.array(F.lit("-"))))
    return RS.overlap_regions(p.where("p_size > 40"), named).select("region_id")


@query("cli02_cli04_presentation", "vectors", """
SELECT vec_id, brand FROM (SELECT vec_id, brand, row_number() OVER (ORDER BY CASE WHEN vec_id % 4 = 0 THEN NULL ELSE b END NULLS LAST, vec_id) AS rn FROM vectors WHERE brand = 'Brand#11' OR brand LIKE '%1') WHERE rn <= 20""")
def cli02(d) -> DataFrame:
    v = d["vectors"].where("brand = 'Brand#11' OR brand LIKE '%1'").withColumn("rank", F.when(F.col("vec_id") % 4 != 0, F.col("b")))
    return D.top_k(v, 20, F.asc_nulls_last("rank"), "vec_id").select("vec_id", "brand")


@query("grf10_window_cells", "", "SELECT DISTINCT CAST(n_nationkey * 2 + i AS INTEGER) AS grid_row, CAST(n_regionkey + j AS INTEGER) AS grid_col FROM nation, range(3) a(i), range(4) b(j)")
def grf10(d) -> DataFrame:
    n = d["nation"].select((F.col("n_nationkey") * 2).alias("row0"), (F.col("n_nationkey") * 2 + 3).alias("row1"), F.col("n_regionkey").alias("col0"), (F.col("n_regionkey") + 4).alias("col1"))
    return SP.window_cells(n)


@query("grf11_study_area", "squares", "SELECT square_id FROM squares WHERE xmin <= 200 AND xmax >= 100 AND ymin <= 90 AND ymax >= 20")
def grf11(d) -> DataFrame:
    return SP.study_area(d["squares"], 100.0, 200.0, 20.0, 90.0).select("square_id")


@query("adp10_reliability", "", """
SELECT s_nationkey AS cell, round(sum(CASE WHEN s_suppkey % 8 <> 0 THEN s_acctbal * (1 + s_suppkey % 3) END) / sum(CASE WHEN s_suppkey % 8 <> 0 THEN CAST(1 + s_suppkey % 3 AS DOUBLE) END), 6) AS saidi,
  round(least(1e0, coalesce(sum(CASE WHEN s_suppkey % 8 <> 0 THEN (1 + s_suppkey % 3) / 20e0 END), 0e0)), 9) AS coverage_frac FROM supplier GROUP BY 1""")
def adp10(d) -> DataFrame:
    s = d["supplier"]
    utilities = s.select(F.col("s_suppkey").alias("utility"), F.when(F.col("s_suppkey") % 8 != 0, F.col("s_acctbal")).alias("saidi"))
    links = s.select(F.col("s_nationkey").alias("cell"), F.col("s_suppkey").alias("utility"), (1 + F.col("s_suppkey") % 3).cast("double").alias("area"), F.lit(20.0).alias("cell_area"))
    out = AD.reliability(utilities, links, "cell", "utility", ["saidi"])
    return out.select("cell", F.round("saidi", 6).alias("saidi"), F.round("coverage_frac", 9).alias("coverage_frac"))


_KM = hav("p.lat", "p.lon", "s.lat", "s.lon")


@query("adp13_storm_counts", "points sites", f"SELECT site_id, count(DISTINCT CASE WHEN km <= 200 THEN nation END) AS n_within FROM (SELECT s.site_id, p.nation, {_KM} AS km FROM points p, sites s) GROUP BY 1")
def adp13(d) -> DataFrame:
    """Distinct storms with a track point within a radius: the storm is the counted key."""
    near = SP.within_radius(d["sites"], d["points"], 200.0, "site_id", "point_id").join(d["points"].select("point_id", "nation"), "point_id")
    n = near.groupBy("site_id").agg(F.count_distinct("nation").alias("n_within"))
    return d["sites"].select("site_id").join(n, "site_id", "left").fillna(0, ["n_within"])


@query("adp14_rail_distance", "squares boxes", """
WITH k AS (SELECT square_id, min(sqrt(pow(s.xmin + 5 - b.xmin, 2) + pow(s.ymin + 5 - b.ymin, 2))) / 1000e0 AS km FROM squares s, boxes b GROUP BY 1)
SELECT k.square_id, CASE WHEN km <= 5e-2 AND km < least(xmin + 5, 500 - xmin - 5) / 1000e0 THEN round(km, 9) END AS km FROM k JOIN squares USING (square_id)""")
def adp14(d) -> DataFrame:
    cells = d["squares"].select("square_id", (F.col("xmin") + 5).alias("x"), (F.col("ymin") + 5).alias("y"))
    rails = d["boxes"].select(F.col("xmin").alias("x1"), F.col("ymin").alias("y1"), F.col("xmin").alias("x2"), F.col("ymin").alias("y2"))
    out = SP.network_distance(cells, rails, "square_id", 50.0).join(cells, "square_id").withColumn("edge", F.least("x", F.lit(500.0) - F.col("x")) / 1000.0)
    return out.select("square_id", F.round(SP.bounded_proximity(out, "km", "edge"), 9).alias("km"))


_VARIANTS = {  # the orders, dealt anew or changed
    "shuffled": "SELECT * FROM orders",
    "without_urgent": "SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "cheaper": "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN 0e0 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders",
    "filled": "SELECT o_orderkey, o_custkey, coalesce(o_orderstatus, '?') AS o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "twice": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'P'",
}


def _changed(d):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    base = d["orders"].select(*cols)
    for name, text in _VARIANTS.items():
        yield name, base, d.spark.sql(re.sub(r"\borders\b", "{orders}", text), orders=base).repartition(3)


@query("lin01_lin05_integrity", "", "WITH " + ", ".join(f"v_{k} AS ({v.replace('SELECT * FROM', 'SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM')})" for k, v in _VARIANTS.items()) + """, base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders)
""" + " UNION ALL ".join(f"SELECT '{k}' AS variant, s AS same_identity, s AS frozen, s AS recomputed, n AS n_revealed FROM (SELECT NOT EXISTS (FROM base EXCEPT ALL FROM v_{k}) AND NOT EXISTS (FROM v_{k} EXCEPT ALL FROM base) AS s, (SELECT count(*) FROM supplier) AS n)" for k in _VARIANTS))
def lin01(d) -> DataFrame:
    """Identity, freeze and fresh recomputation of the orders against variants of them; the suppliers are read once the variant is sealed."""
    rows = []
    for name, base, other in _changed(d):
        same = LN.run_identity({"mw": 100}, {"orders": base}) == LN.run_identity({"mw": 100}, {"orders": other})
        frozen = LN.freeze({"orders": base})
        seal, inventory = LN.reveal_after(other, lambda: d["supplier"])
        kept = R.holds(lambda: LN.verify_freeze({"orders": other}, frozen))
        if (seal == frozen["tables"]["orders"]) != kept:
            raise R.ConstraintError("the seal and the freeze disagree")
        rows.append((name, same, kept, R.holds(lambda: LN.assert_recomputed(base, other)), inventory.count()))
    return d.spark.createDataFrame(rows, "variant string, same_identity boolean, frozen boolean, recomputed boolean, n_revealed bigint")


@query("snk05_geojson_features", "squares", """
SELECT '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[' || xmin || ',' || ymin || '],[' || xmax || ',' || ymin || '],[' || xmax || ',' || ymax || '],[' || xmin || ',' || ymin || ']]]},"properties":{"square_id":' || square_id || '}}' AS feature FROM squares""")
def snk05(d) -> DataFrame:
    at = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(F.array(at("xmin", "ymin"), at("xmax", "ymin"), at("xmax", "ymax"), at("xmin", "ymin")))
    return sinks.geojson_features(d["squares"].withColumn("rings", ring), "rings", ["square_id"])


@query("snk12_data_dictionary", "", "SELECT * FROM (VALUES ('n_name', 'string'), ('n_nationkey', 'int'), ('n_regionkey', 'int')) AS t(column_name, kind)")
def snk12(d) -> DataFrame:
    return d.spark.createDataFrame(sorted(sinks.data_dictionary(d["nation"]).items()), "column_name string, kind string")
