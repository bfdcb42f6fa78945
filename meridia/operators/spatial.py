"""Spatial joins as bucketed equi-joins: rows meet by tile, then an exact predicate decides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, polygons
from .relations import written

KM_PER_DEGREE = geo.EARTH_KM * math.pi / 180


def _range(a: Column, b: Column) -> Column:
    return F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int"))


def rectangle_overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, tile: float, least: float = 0.0) -> DataFrame:
    """(a_key, b_key, area) of rectangles (xmin, xmax, ymin, ymax) that overlap by more than `least`.

    Both sides are listed once in every tile they touch; a pair is kept in the tile of its overlap's lower corner.
    """

    def tiled(df: DataFrame) -> DataFrame:
        x = df.withColumn("__tx", F.explode(_range(F.col("xmin") / tile, F.col("xmax") / tile)))
        return x.withColumn("__ty", F.explode(_range(F.col("ymin") / tile, F.col("ymax") / tile)))

    p, q = tiled(a).alias("p"), tiled(b).alias("q")
    joined = p.join(q, (F.col("p.__tx") == F.col("q.__tx")) & (F.col("p.__ty") == F.col("q.__ty")))
    own = (F.floor(F.greatest("p.xmin", "q.xmin") / tile) == F.col("p.__tx")) & (F.floor(F.greatest("p.ymin", "q.ymin") / tile) == F.col("p.__ty"))
    area = geo.overlap_area("p", "q")
    return joined.where(own & (area > least)).select(F.col(f"p.{a_key}").alias(a_key), F.col(f"q.{b_key}").alias(b_key), area.alias("area"))


MEMBERS = 4096  # keys of equal intervals in one row


def interval_overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, bucket: float) -> DataFrame:
    """(a_key, b_key, length) of one-dimensional intervals (lo, hi).

    Distinct intervals meet by bucket, each pair once.  The pairs then get the keys of both sides as arrays of at most
    `MEMBERS`, which are dealt over all tasks and unfolded there: no row is compared with the rows of a whole bucket, and
    neither a bucket nor an interval of many rows is the work of one task.
    """

    def grouped(df: DataFrame, key: str) -> DataFrame:
        x = df.where(F.col("lo").isNotNull() & F.col("hi").isNotNull()).select(F.col(key).alias("__i"), "lo", "hi")
        parts = x.groupBy("lo", "hi").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("__n"))
        dealt = x.join(parts, ["lo", "hi"]).withColumn("__s", F.pmod(F.xxhash64("__i"), F.col("__n")).cast("int"))
        return dealt.groupBy("lo", "hi", "__s").agg(F.collect_list(F.struct("__i")).alias("__m")).drop("__s")  # a struct, else null keys would go

    def tiled(df: DataFrame) -> DataFrame:
        return df.withColumn("__k", F.explode(_range(F.col("lo") / bucket, F.col("hi") / bucket)))

    left, right = grouped(a, a_key), grouped(b, b_key)
    p, q = tiled(left.select("lo", "hi").distinct()).alias("p"), tiled(right.select("lo", "hi").distinct()).alias("q")
    length = geo.overlap_1d(F.col("p.lo"), F.col("p.hi"), F.col("q.lo"), F.col("q.hi"))
    own = F.floor(F.greatest("p.lo", "q.lo") / bucket) == F.col("p.__k")
    met = p.join(q, F.col("p.__k") == F.col("q.__k")).where(own & (length > 0))
    met = met.select(F.col("p.lo").alias("lo"), F.col("p.hi").alias("hi"), F.col("q.lo").alias("__lo"), F.col("q.hi").alias("__hi"), length.alias("length"))
    both = met.join(left, ["lo", "hi"]).withColumnRenamed("__m", "__a").join(right.select(F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), F.col("__m").alias("__b")), ["__lo", "__hi"])
    dealt = both.select("__a", "__b", "length").repartition(_tasks(a))
    pairs = dealt.select(F.explode("__a").alias("__a"), "__b", "length").select("__a", F.explode("__b").alias("__b"), "length")
    return pairs.select(F.col("__a.__i").alias(a_key), F.col("__b.__i").alias(b_key), "length")


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def separable_shares(pixels: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Area by (cell_row, cell_col, class) of pixels (i, j, class): weights by row, then by column.

    rows: (i, cell_row, w); columns: (j, cell_col, w).  The sum over columns is pre-aggregated before rows join.
    """
    by_column = pixels.join(columns.withColumnRenamed("w", "wx"), "j").groupBy("i", "cell_col", "class").agg(F.sum("wx").alias("wx"))
    return by_column.join(rows.withColumnRenamed("w", "wy"), "i").groupBy("cell_row", "cell_col", "class").agg(F.sum(F.col("wx") * F.col("wy")).alias("area"))


def points_in_rectangles(points: DataFrame, rectangles: DataFrame, point_key: str, rectangle_key: str, tile: float) -> DataFrame:
    """Every match, borders included."""
    r = rectangles.withColumn("__tx", F.explode(_range(F.col("xmin") / tile, F.col("xmax") / tile))).withColumn("__ty", F.explode(_range(F.col("ymin") / tile, F.col("ymax") / tile)))
    p = points.withColumn("__tx", F.floor(F.col("x") / tile).cast("int")).withColumn("__ty", F.floor(F.col("y") / tile).cast("int"))
    inside = (F.col("x") >= F.col("xmin")) & (F.col("x") <= F.col("xmax")) & (F.col("y") >= F.col("ymin")) & (F.col("y") <= F.col("ymax"))
    return p.join(r, ["__tx", "__ty"]).where(inside).select(point_key, rectangle_key)


def in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule on a closed ring array<struct<x,y>>, as a JVM-side expression."""
    n = F.size(ring) - 1
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, i + 1).alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def near_ring(x: Column, y: Column, ring: Column, margin: float) -> Column:
    """At most `margin` from an edge of a closed ring."""
    at = lambda i: F.get(ring, i)
    apart = lambda a, b: segment_distance_km(x, y, a["x"], a["y"], b["x"], b["y"]) * 1000.0
    return F.exists(F.sequence(F.lit(0), F.size(ring) - 2), lambda i: apart(at(i), at(i + 1)) <= margin)


def points_in_polygons(points: DataFrame, polygons: DataFrame, point_key: str, polygon_key: str, tile: float, ring: str = "ring", margin: float = 0.0, where: Column | None = None) -> DataFrame:
    """Polygons carry their ring and bounding box; the box finds candidates by tile, the ring decides.

    The even-odd rule leaves points on the border to rounding.  With a `margin`, points so near to the ring count too, and
    `where`, a condition on columns of both sides, says which of the matches stay.
    """
    r = polygons.withColumn("__tx", F.explode(_range((F.col("xmin") - margin) / tile, (F.col("xmax") + margin) / tile)))
    r = r.withColumn("__ty", F.explode(_range((F.col("ymin") - margin) / tile, (F.col("ymax") + margin) / tile)))
    p = points.withColumn("__tx", F.floor(F.col("x") / tile).cast("int")).withColumn("__ty", F.floor(F.col("y") / tile).cast("int"))
    inside = in_polygon(F.col("x"), F.col("y"), F.col(ring))
    if margin:
        inside = inside | near_ring(F.col("x"), F.col("y"), F.col(ring), margin)
    return p.join(r, ["__tx", "__ty"]).where(inside if where is None else where & inside).select(point_key, polygon_key)


def clipped_area(df: DataFrame, ring: Column, xmin: str, xmax: str, ymin: str, ymax: str, name: str = "area") -> DataFrame:
    """`df` with the area of a simple polygon inside a rectangle: clipped edge by edge, then the shoelace sum.

    Each clip is a column of its own, so that its points are computed once and not in every place that reads them.
    """

    def at_x(v: str):
        return lambda a, b: F.struct(F.col(v).alias("x"), (a["y"] + (b["y"] - a["y"]) * (F.col(v) - a["x"]) / (b["x"] - a["x"])).alias("y"))

    def at_y(v: str):
        return lambda a, b: F.struct((a["x"] + (b["x"] - a["x"]) * (F.col(v) - a["y"]) / (b["y"] - a["y"])).alias("x"), F.col(v).alias("y"))

    none = F.array().cast("array<struct<x:double,y:double>>")
    sides = [
        (lambda p: p["x"] >= F.col(xmin), at_x(xmin)), (lambda p: p["x"] <= F.col(xmax), at_x(xmax)),
        (lambda p: p["y"] >= F.col(ymin), at_y(ymin)), (lambda p: p["y"] <= F.col(ymax), at_y(ymax)),
    ]
    def kept(inside, cut):
        def step(e: Column) -> Column:
            a, b = e["a"], e["b"]
            return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(cut(a, b))).when(inside(b), F.array(cut(a, b), b)).otherwise(none)

        return step

    out = df.withColumn("__p", ring)
    for inside, cut in sides:
        # edges: each point with the next one, the last with the first
        turned = F.concat(F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))), F.slice("__p", 1, 1))
        out = out.withColumn("__e", F.arrays_zip(F.col("__p").alias("a"), turned.alias("b")))
        out = out.withColumn("__p", F.flatten(F.transform("__e", kept(inside, cut))))
    turned = F.concat(F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))), F.slice("__p", 1, 1))
    out = out.withColumn("__e", F.arrays_zip(F.col("__p").alias("a"), turned.alias("b")))
    total = F.aggregate("__e", F.lit(0.0), lambda t, e: t + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return out.withColumn(name, F.when(F.size("__p") >= 3, F.abs(total) / 2.0).otherwise(F.lit(0.0))).drop("__p", "__e")


def _tiles(df: DataFrame, lat: str, lon: str, km: float, reach: bool = False) -> DataFrame:
    """Tiles of `km` in latitude; with `reach`, all tiles that points within `km` can lie in.

    Columns of tiles go round the globe, so the last one's neighbour is the first; a circle that holds a pole reaches all.
    """
    degrees = max(km / KM_PER_DEGREE, 1e-6)
    columns = max(1, int(360 / degrees))
    width, turn = 360 / columns, min(km / geo.EARTH_KM, math.pi / 2)
    ty = F.floor(F.col(lat) / degrees).cast("int")
    tx = F.pmod(F.floor(F.pmod(F.col(lon), F.lit(360.0)) / width).cast("int"), F.lit(columns))
    if not reach:
        return df.withColumn("__ty", ty).withColumn("__tx", tx)
    angle = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(turn)) / F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-9)))))
    wide = F.ceil(angle / width).cast("int")
    whole = (F.abs(F.col(lat)) + degrees >= 90.0) | (2 * wide + 1 >= columns)
    near = F.transform(F.sequence(-wide, wide), lambda k: F.pmod(tx + k, F.lit(columns)))
    out = df.withColumn("__ty", F.explode(F.sequence(ty - 1, ty + 1)))
    return out.withColumn("__tx", F.explode(F.when(whole, F.sequence(F.lit(0), F.lit(columns - 1))).otherwise(near)))


def within_radius(a: DataFrame, b: DataFrame, km: float, a_key: str, b_key: str) -> DataFrame:
    """(a_key, b_key, km) of points (lat, lon) at most `km` apart (inclusive), over the date line and the poles too."""
    p = _tiles(a.select(a_key, F.col("lat").alias("__alat"), F.col("lon").alias("__alon")), "__alat", "__alon", km, True)
    q = _tiles(b.select(b_key, F.col("lat").alias("__blat"), F.col("lon").alias("__blon")), "__blat", "__blon", km)
    d = geo.haversine_km("__alat", "__alon", "__blat", "__blon")
    return p.join(q, ["__ty", "__tx"]).withColumn("km", d).where(F.col("km") <= km).select(a_key, b_key, "km")


def count_within(a: DataFrame, b: DataFrame, km: float, a_key: str, b_key: str) -> DataFrame:
    near = within_radius(a, b, km, a_key, b_key).groupBy(a_key).agg(F.count_distinct(b_key).alias("n_within"))
    return a.select(a_key).join(near, a_key, "left").fillna(0, ["n_within"])


def nearest(a: DataFrame, b: DataFrame, a_key: str, b_key: str, start_km: float = 50.0) -> DataFrame:
    """(a_key, b_key, km) of the nearest b for every a; ties go to the smaller key.

    The search radius doubles for the points that found nothing yet; what is found within the radius is final,
    since every point of the radius was seen.  The points left are written down between rounds.
    """
    left, found, radius = a.select(a_key, "lat", "lon"), None, start_km
    while True:
        everything = radius >= geo.EARTH_KM * math.pi
        near = within_radius(left, b, radius, a_key, b_key)
        best = near.groupBy(a_key).agg(F.min(F.struct("km", b_key)).alias("m")).select(a_key, F.col(f"m.{b_key}").alias(b_key), F.col("m.km").alias("km"))
        best = written(best, "nearest")
        found = best if found is None else found.unionByName(best)
        if everything:
            return found
        left = written(left.join(best.select(a_key), a_key, "left_anti"), "left")
        if left.isEmpty():
            return found
        radius *= 2


def nearest_valid(a: DataFrame, stations: DataFrame, a_key: str, station_key: str, valid: str, km: float) -> DataFrame:
    """The nearest station that is valid, within a distance."""
    near = within_radius(a, stations.where(F.col(valid)), km, a_key, station_key)
    return near.groupBy(a_key).agg(F.min(F.struct("km", station_key)).alias("m")).select(a_key, F.col(f"m.{station_key}").alias(station_key), F.col("m.km").alias("km"))


def segment_distance_km(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar distance of a point to a segment, metres to km."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - x1) * dx + (y - y1) * dy) / n))).otherwise(F.lit(0.0))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy)) / 1000.0


def segment_rectangle_km(x1: Column, y1: Column, x2: Column, y2: Column, xmin: Column, xmax: Column, ymin: Column, ymax: Column) -> Column:
    """Planar distance of a segment to a rectangle, metres to km; 0 where they meet."""
    enter, leave, beside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, q, lo, hi in ((x1, x2, xmin, xmax), (y1, y2, ymin, ymax)):
        d = q - p
        s, t = (lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))
        enter, leave = F.greatest(enter, F.least(s, t)), F.least(leave, F.greatest(s, t))  # a null, where d is 0, is skipped
        beside = beside | ((d == 0) & ((p < lo) | (p > hi)))
    gap = lambda v, lo, hi: F.greatest(F.lit(0.0), lo - v, v - hi)
    ends = [F.hypot(gap(x, xmin, xmax), gap(y, ymin, ymax)) / 1000.0 for x, y in ((x1, y1), (x2, y2))]
    corners = [segment_distance_km(x, y, x1, y1, x2, y2) for x in (xmin, xmax) for y in (ymin, ymax)]
    return F.when(~beside & (enter <= leave), 0.0).otherwise(F.least(*ends, *corners))


def network_distance(cells: DataFrame, segments: DataFrame, key: str, reach_m: float) -> DataFrame:
    """Least distance of cells to segments, up to a reach; null beyond it.

    Cells are points (x, y) or, with columns xmin, xmax, ymin and ymax, rectangles.  Both sides are listed in the
    tiles that they touch, segments with the reach around them.
    """
    solid = "xmin" in cells.columns
    span = lambda lo, hi: F.explode(_range(lo / reach_m, hi / reach_m))
    s = segments.withColumn("__tx", span(F.least("x1", "x2") - reach_m, F.greatest("x1", "x2") + reach_m))
    s = s.withColumn("__ty", span(F.least("y1", "y2") - reach_m, F.greatest("y1", "y2") + reach_m))
    box = ("xmin", "xmax", "ymin", "ymax") if solid else ("x", "x", "y", "y")
    c = cells.select(key, *dict.fromkeys(box)).withColumn("__tx", span(F.col(box[0]), F.col(box[1]))).withColumn("__ty", span(F.col(box[2]), F.col(box[3])))
    ends = [F.col(n) for n in ("x1", "y1", "x2", "y2")]
    d = segment_rectangle_km(*ends, *map(F.col, box)) if solid else segment_distance_km(F.col("x"), F.col("y"), *ends)
    best = c.join(s.select("__tx", "__ty", "x1", "y1", "x2", "y2"), ["__tx", "__ty"]).groupBy(key).agg(F.min(d).alias("km")).where(F.col("km") <= reach_m / 1000.0)
    return cells.select(key).join(best, key, "left")


def bounded_proximity(df: DataFrame, km: str, boundary_km: str) -> Column:
    """A distance is only known if it is smaller than the way to the edge of what was queried."""
    return F.when(F.col(km) < F.col(boundary_km), F.col(km))


def union_area(df: DataFrame, keys: Sequence[str], tile: float) -> DataFrame:
    """Area covered by at least one of a key's rectangles (xmin, xmax, ymin, ymax).

    Rectangles are cut at tile borders.  In a tile, the distinct borders make vertical slabs; in a slab, what a rectangle adds
    lies above the highest end before it.  Exact for any rectangles, and a key's tiles lie in many tasks.
    """
    x = df.withColumn("__tx", F.explode(_range(F.col("xmin") / tile, F.col("xmax") / tile))).withColumn("__ty", F.explode(_range(F.col("ymin") / tile, F.col("ymax") / tile)))
    at = [*keys, "__tx", "__ty"]
    cut = x.select(
        *at, F.greatest(F.col("xmin"), F.col("__tx") * tile).alias("x0"), F.least(F.col("xmax"), (F.col("__tx") + 1) * tile).alias("x1"),
        F.greatest(F.col("ymin"), F.col("__ty") * tile).alias("y0"), F.least(F.col("ymax"), (F.col("__ty") + 1) * tile).alias("y1"),
    ).where("x0 < x1 AND y0 < y1").distinct()
    edges = cut.select(*at, F.explode(F.array("x0", "x1")).alias("a")).distinct()
    slabs = edges.withColumn("b", F.lead("a").over(W.partitionBy(*at).orderBy("a"))).where("b IS NOT NULL")
    parts = cut.join(slabs, at).where("x0 <= a AND b <= x1")
    before = F.max("y1").over(W.partitionBy(*at, "a").orderBy("y0", "y1").rowsBetween(W.unboundedPreceding, -1))
    added = parts.withColumn("__low", F.greatest(F.col("y0"), F.coalesce(before, F.col("y0")))).withColumn("__high", F.greatest("y1", "__low"))
    return added.groupBy(*keys).agg(F.sum((F.col("b") - F.col("a")) * (F.col("__high") - F.col("__low"))).alias("area"))


def polygon_overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, tile: float, least: float = 1e-8) -> DataFrame:
    """(a_key, b_key, area) of polygons (rings: array<array<struct<x,y>>>, and their bounding boxes) that overlap by more than `least`.

    Boxes find the pairs by tile; each pair's area is exact, holes and concave rings included.
    """
    pairs = rectangle_overlaps(a, b, a_key, b_key, tile).select(a_key, b_key)
    both = pairs.join(a.select(a_key, F.col("rings").alias("__a")), a_key).join(b.select(b_key, F.col("rings").alias("__b")), b_key)
    return both.select(a_key, b_key, polygons.common_area(F.array("__a", "__b")).alias("area")).where(F.col("area") > least)


def dissolve(df: DataFrame, keys: Sequence[str], tile: float) -> DataFrame:
    """(keys, rings, area): what a key's polygons cover together, as trapezoids that touch and do not overlap.

    Polygons are brought together tile by tile, so a key with many polygons is not gathered in one task; within a tile
    they are cut at its borders.
    """
    x = df.withColumn("__tx", F.explode(_range(F.col("xmin") / tile, F.col("xmax") / tile))).withColumn("__ty", F.explode(_range(F.col("ymin") / tile, F.col("ymax") / tile)))
    grouped = x.groupBy(*keys, "__tx", "__ty").agg(F.collect_list("rings").alias("__p"))
    pieces = grouped.withColumn("__r", polygons.union_pieces("__p", F.col("__tx") * F.lit(float(tile)), F.col("__ty") * F.lit(float(tile)), F.lit(float(tile))))
    out = pieces.select(*keys, F.explode("__r").alias("r"))
    return out.groupBy(*keys).agg(F.collect_list("r.ring").alias("rings"), F.sum("r.area").alias("area"))


def lattice(spark, rows: int, columns: int, size_m: int, ox: float, oy: float) -> DataFrame:
    from ..functions import scalar as S

    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("grid_row"), (F.col("id") % columns).cast("int").alias("grid_col"))
    return cells.withColumn("grid_id", S.grid_id("grid_row", "grid_col", size_m)).withColumns(S.cell_bounds("grid_row", "grid_col", ox, oy, float(size_m)))


def children(parents: DataFrame, factor: int) -> DataFrame:
    """All fine cells of coarse parents (parent_row, parent_col)."""
    out = parents.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return out.withColumn("grid_row", (F.col("parent_row") * factor + F.col("__i")).cast("int")).withColumn("grid_col", (F.col("parent_col") * factor + F.col("__j")).cast("int")).drop("__i", "__j")


def track_segments(points: DataFrame, track: str, time: str, max_hours: float = 6.0) -> DataFrame:
    """Consecutive points of a track, 0 < gap <= max_hours and no jump over the date line."""
    w = W.partitionBy(track).orderBy(time)
    out = points.withColumn("lat1", F.lag("lat").over(w)).withColumn("lon1", F.lag("lon").over(w)).withColumn("__t", F.lag(time).over(w))
    hours = (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("__t").cast("timestamp"))) / 3.6e9
    ok = F.col("lat1").isNotNull() & F.col("lat").isNotNull() & (hours > 0) & (hours <= max_hours) & (F.abs(F.col("lon") - F.col("lon1")) <= 180)
    return out.withColumn("gap_hours", hours).where(ok).drop("__t")


def window_cells(windows: DataFrame) -> DataFrame:
    """Distinct cells (grid_row, grid_col) of windows (row0, row1, col0, col1; ends excluded)."""
    out = windows.withColumn("grid_row", F.explode(F.sequence(F.col("row0"), F.col("row1") - 1))).withColumn("grid_col", F.explode(F.sequence(F.col("col0"), F.col("col1") - 1)))
    return out.select("grid_row", "grid_col").distinct()


def study_area(cells: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Cells that touch a box."""
    return cells.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))
