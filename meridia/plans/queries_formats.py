"""Queries that write the tables in a source or sink format and read them back through the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decision as D
from ..operators import lineage as LN
from ..operators import relations as R
from ..sources import readers, sinks
from .registry import query


def _place(d, name: str) -> str:
    return f"{R.shared_folder(d.spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _rings(xmin="xmin", ymin="ymin", xmax="xmax", ymax="ymax"):
    corners = ((xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin))
    return F.array(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]))


# ---------------------------------------------------------------- tables


@query("src03_src05_projected_scan", "", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src03(d) -> DataFrame:
    return readers.table(d.spark, f"{d.sf_dir}/orders.parquet", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("src07_snk01_snk03_manifest", "", "SELECT 'customers' AS kind, '1.2' AS version, 'real' AS mode, (SELECT count(*) FROM customer) AS n_rows, 3 AS n_columns, (SELECT sum(c_custkey) FROM customer)::BIGINT AS key_sum")
def src07(d) -> DataFrame:
    path = _place(d, "customers")
    sinks.write_table(d["customer"].select("c_custkey", "c_nationkey", "c_mktsegment"), path, "customers", "1.2")
    note = readers.manifest(d.spark, path, "customers", (1, 1))
    told = [F.lit(note[k]).alias(n) for k, n in (("schema", "kind"), ("schema_version", "version"), ("data_mode", "mode"))]
    counts = F.lit(note["rows"]).cast("bigint").alias("n_rows"), F.lit(len(note["columns"])).alias("n_columns")
    return readers.table(d.spark, path, ["c_custkey"]).agg(F.sum("c_custkey").cast("bigint").alias("key_sum")).select(*told, *counts, "key_sum")


@query("src22_any_table", "", """
SELECT f AS format, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS key_sum, CAST(sum(length(n_name)) AS BIGINT) AS chars
FROM nation CROSS JOIN (VALUES ('csv'), ('json'), ('parquet')) AS t(f) GROUP BY f""")
def src22(d) -> DataFrame:
    nations, out = d["nation"].select("n_nationkey", "n_name"), {}
    for kind in ("csv", "json", "parquet"):
        path = f"{_place(d, 'nations')}.{kind}"
        nations.write.format(kind).option("header", True).save(path)
        out[kind] = readers.any_table(d.spark, path, ["n_nationkey", "n_name"]).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name")
    every = R.tagged_union(out).groupBy(F.col("source_layer").alias("format"))
    return every.agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("key_sum"), F.sum(F.length("n_name")).cast("bigint").alias("chars"))


@query("snk04_src10_ranking_csv", "", """
WITH n AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' GROUP BY 1)
SELECT n_nationkey AS nation, CAST(CASE WHEN n.n IS NULL THEN NULL ELSE rank() OVER (ORDER BY n.n DESC NULLS LAST, n_nationkey) END AS INTEGER) AS place, n.n
FROM nation LEFT JOIN n ON n_nationkey = n.nation""")
def snk04(d) -> DataFrame:
    """Nations by their customers; those of one region have no rank and come last."""
    ranked_nations = d["nation"].join(d["region"].where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"))
    counted = d["customer"].join(ranked_nations, "c_nationkey").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    ranked = D.positions(counted, F.desc("n"), "nation", name="place")
    path = _place(d, "ranking")
    sinks.write_ranking(d["nation"].select(F.col("n_nationkey").alias("nation")).join(ranked, "nation", "left").select("nation", "place", "n"), path, "place", "nation")
    return readers.delimited(d.spark, path, f"nation {d['nation'].schema['n_nationkey'].dataType.simpleString()}, place int, n bigint")


@query("src11_unit_rows", "prices", "SELECT CAST(state AS INTEGER) AS state, yr, mon, n FROM prices")
def src11(d) -> DataFrame:
    """A file a state (at most a line a month), each with a header and a row of units."""
    heads = F.array(F.lit("state,yr,mon,n"), F.lit("id,a,month,orders"))
    line = F.concat_ws(",", "state", "yr", "mon", "n")
    files = d["prices"].groupBy("state").agg(F.array_join(F.concat(heads, F.sort_array(F.collect_list(line))), "\n").alias("value"))
    path = _place(d, "states")
    files.repartition("state").write.partitionBy("state").text(path)
    return readers.delimited(d.spark, path, "state int, yr int, mon int, n bigint", skip_after_header=1)


@query("src12_fixed_width", "", "SELECT lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS id, c_mktsegment AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def src12(d) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    line = F.concat(F.lpad(text("c_custkey"), 12, "0"), F.rpad("c_mktsegment", 14, " "), F.lpad(text("c_nationkey"), 4, " "))
    path = _place(d, "fixed")
    d["customer"].select(line.alias("value")).write.text(path)
    return readers.fixed_width(d.spark, path, {"id": (1, 12), "segment": (13, 26), "nation": (27, 30)}, 30)


# ---------------------------------------------------------------- JSON of map services


def _pages(d, feature) -> str:
    """One document a page of at most 1000 points: a file each, under the page's folder."""
    page = F.floor(F.col("point_id") / 1000).alias("page")
    made = d["points"].groupBy(page, "nation").agg(F.sort_array(F.collect_list(F.struct("point_id", "lon", "lat"))).alias("points"))
    pages = made.groupBy("page").agg(F.to_json(F.struct(F.flatten(F.collect_list(feature)).alias("features"))).alias("value"))
    path = _place(d, "pages")
    pages.repartition("page").write.partitionBy("page").text(path)
    return path


@query("src13_paged_json", "points", "SELECT point_id AS id, lat FROM points")
def src13(d) -> DataFrame:
    path = _pages(d, F.transform("points", lambda p: F.struct(F.struct(p["point_id"].alias("id"), p["lat"].alias("lat")).alias("attributes"))))
    return readers.paged_json(d.spark, f"{path}/*/", "id:bigint,lat:double", d["points"].count())


@query("src14_polylines", "points", """
WITH s AS (SELECT CAST(floor(point_id / 1000) AS BIGINT) * 100 + nation AS track, CAST(0 AS INTEGER) AS part, lon AS x1, lat AS y1,
  lead(lon) OVER w AS x2, lead(lat) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY floor(point_id / 1000), nation ORDER BY point_id))
SELECT CAST(track AS BIGINT) AS track, part, x1, y1, x2, y2 FROM s WHERE x2 IS NOT NULL""")
def src14(d) -> DataFrame:
    track = (F.floor(F.get("points", F.lit(0))["point_id"] / 1000) * 100 + F.col("nation")).alias("track")
    line = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    path = _pages(d, F.array(F.struct(F.struct(track).alias("attributes"), F.struct(F.array(line).alias("paths")).alias("geometry"))))
    return readers.json_polylines(d.spark, f"{path}/*/", "track")


# ---------------------------------------------------------------- geometry, rasters, cubes


@query("src02_snk02_geometry", "boxes", "SELECT box_id, CAST(1 AS INTEGER) AS n_rings, CAST(5 AS INTEGER) AS n_corners, xmin, ymin, xmax, ymax FROM boxes")
def src02(d) -> DataFrame:
    """Boxes written as WKB with their bounds and read back; the corners are those of the decoded rings."""
    path = _place(d, "boxes")
    sinks.write_layer(d["boxes"].select("box_id", _rings().alias("geometry")), path, "boxes", "geometry", "local")
    corners = F.flatten("geometry")
    side = lambda pick, axis: pick(F.transform(corners, lambda p: p[axis]))
    bounds = [side(F.array_min, "x").alias("xmin"), side(F.array_min, "y").alias("ymin"), side(F.array_max, "x").alias("xmax"), side(F.array_max, "y").alias("ymax")]
    return readers.vector_layer(d.spark, path, crs="local").select("box_id", F.size("geometry").alias("n_rings"), F.size(corners).alias("n_corners"), *bounds)


@query("src15_vector_box", "boxes", "SELECT box_id, code, value, xmin AS west, ymax AS north FROM boxes WHERE xmin <= 300 AND xmax >= 90 AND ymin <= 310 AND ymax >= 40 AND value > 0")
def src15(d) -> DataFrame:
    path = _place(d, "layer")
    sinks.write_layer(d["boxes"].select("box_id", "code", "value", _rings().alias("geometry")), path, "boxes", "geometry", "local")
    found = readers.vector_layer(d.spark, path, (90.0, 40.0, 300.0, 310.0), F.col("value") > 0)
    corner = F.element_at(F.element_at("geometry", 1), 4)
    return found.select("box_id", "code", "value", corner["x"].alias("west"), corner["y"].alias("north"))


@query("src16_raster_window", "features", "SELECT grid_row AS i, grid_col AS j, CASE WHEN transmission <> 7 THEN transmission END AS value FROM features WHERE grid_row BETWEEN 1 AND 24 AND grid_col BETWEEN 5 AND 39")
def src16(d) -> DataFrame:
    path = _place(d, "raster")
    cells = d["features"].select(F.col("grid_row").alias("i"), F.col("grid_col").alias("j"), F.col("transmission").alias("value"))
    readers.pixels(cells, 16).sortWithinPartitions("tile_i", "tile_j").write.parquet(path)
    return readers.window(readers.table(d.spark, path), 1, 25, 5, 40, 16, nodata=7.0).select("i", "j", "value")


@query("src17_climate_cube", "prices", "SELECT CAST(state AS INTEGER) AS cell, CAST(min(n) AS BIGINT) AS low, CAST(max(n) AS BIGINT) AS high, count(*) AS months FROM prices GROUP BY 1")
def src17(d) -> DataFrame:
    identity = {"model": "m1", "scenario": "ssp245", "member": "r1", "calendar": "noleap"}
    cube = d["prices"].select(F.col("state").cast("int").alias("cell"), "yr", "mon", "n", *[F.lit(v).alias(k) for k, v in identity.items()])
    return readers.climate_cube(R.written(cube, "cube"), identity).groupBy("cell").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("months"))


@query("snk07_sample_cube", "prices", "SELECT 'y' || CAST(yr AS VARCHAR) AS scenario_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS samples FROM prices GROUP BY 1")
def snk07(d) -> DataFrame:
    path = _place(d, "samples")
    sinks.sample_cube(d["prices"].select(F.concat(F.lit("y"), F.col("yr").cast("string")).alias("scenario_id"), "state", "mon", "n"), path)
    return d.spark.read.parquet(path).groupBy("scenario_id").agg(F.sum("n").alias("total"), F.count("*").alias("samples"))


# ---------------------------------------------------------------- documents


@query("snk06_canonical_json", "", """SELECT '{"nations":' || (SELECT count(*) FROM nation) || ',"regions":["' || (SELECT string_agg(r_name, '","' ORDER BY r_name) FROM region) || '"]}' AS body""")
def snk06(d) -> DataFrame:
    path = f"{_place(d, 'summary')}.json"
    names = [r[0] for r in d["region"].select("r_name").orderBy("r_name").collect()]  # a fixed handful
    LN.write_text(d.spark, path, LN.canonical_json({"regions": names, "nations": d["nation"].count()}))
    return d.spark.createDataFrame([(LN.read_text(d.spark, path).strip(),)], "body string")


@query("snk08_report_lines", "", """
WITH n AS (SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY k, line) AS INTEGER) AS position, line FROM (
  SELECT 0 AS k, '# Regions' AS line UNION ALL SELECT 1, '## Nations' UNION ALL SELECT 2, '| region | nations |' UNION ALL SELECT 3, '|---|---|'
  UNION ALL SELECT 4, '| ' || r_name || ' | ' || CAST(n AS VARCHAR) || ' |' FROM n)""")
def snk08(d) -> DataFrame:
    nations = d["nation"].join(d["region"], F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations"))
    lines = [x for x in sinks.report("Regions", [("Nations", nations.orderBy("region"))]).split("\n") if x]
    return d.spark.createDataFrame(list(enumerate(lines, 1)), "position int, line string")


# ---------------------------------------------------------------- stages, weights


@query("snk11_lin03_stages", "", "SELECT o_orderpriority AS priority, count(*) AS n, TRUE AS same, TRUE AS stale_refused FROM orders GROUP BY 1")
def snk11(d) -> DataFrame:
    """A stage is made once, reused while its run identity holds, and refused under another identity."""
    made, folder = [], _place(d, "run")

    def make() -> DataFrame:
        made.append(1)
        return d["orders"].groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))

    stages = LN.Stages(d.spark, folder, LN.run_identity({"stage": 1}, {"nation": d["nation"]}))
    first, again = stages.run("counts", make), stages.run("counts", make)
    same = len(made) == 1 and R.tables_equal(first, again)
    stale = not R.holds(lambda: LN.Stages(d.spark, folder, LN.run_identity({"stage": 2}, {"nation": d["nation"]})).require("counts"))
    return stages.require("counts").select("priority", "n", F.lit(same).alias("same"), F.lit(stale).alias("stale_refused"))


@query("dec01_dec02_weights", "", """
SELECT * FROM (VALUES ('user', 'a', 0.5e0), ('user', 'b', 0.25e0), ('user', 'c', 0.25e0), ('equal', 'a', 0.25e0), ('equal', 'b', 0.25e0), ('equal', 'c', 0.5e0),
  ('hierarchical', 'a', 0.375e0), ('hierarchical', 'b', 0.375e0), ('hierarchical', 'c', 0.25e0)) AS t(method, metric, weight)""")
def dec01(d) -> DataFrame:
    made = {
        "user": D.user_weights({"a": 4, "b": 2, "c": 2}, ["a", "b", "c"]),
        "equal": D.equal_weights({"p": ["a", "b"], "q": ["c"]}),
        "hierarchical": D.hierarchical_weights({"p": 0.75, "q": 0.25}, {"p": {"a": 0.5, "b": 0.5}, "q": {"c": 1.0}}),
    }
    return d.spark.createDataFrame([(m, k, w) for m, ws in made.items() for k, w in ws.items()], "method string, metric string, weight double")


@query("flt10_top_buckets", "points", """
WITH r AS (SELECT point_id, row_number() OVER (ORDER BY weight DESC, point_id) AS place FROM points)
SELECT b AS bucket, point_id, CAST(place AS BIGINT) AS place FROM r JOIN (VALUES (5), (10), (25)) AS t(b) ON place <= b""")
def flt10(d) -> DataFrame:
    best = D.top_k(d["points"].select("point_id", "weight"), 25, F.desc("weight"), "point_id")  # the largest bucket, once
    placed = D.positions(best, F.desc("weight"), "point_id", name="place")
    return placed.select(F.explode(F.array(*map(F.lit, (5, 10, 25)))).alias("bucket"), "point_id", F.col("place").cast("bigint").alias("place")).where("place <= bucket")
