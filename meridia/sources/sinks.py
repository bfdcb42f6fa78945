"""Sinks: tables with identity, ordered exports, documents and images."""

from __future__ import annotations

import html
import struct
import zlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, wkb
from ..operators.lineage import canonical_json, table_fingerprint, write_text
from ..operators.relations import ConstraintError


def write_table(df: DataFrame, path: str, kind: str, version: str = "1.0", data_mode: str = "real", processed: str | None = None, partition_by: Sequence[str] = (), **notes) -> dict:
    """Parquet (zstd) and, last, a manifest with schema, identity and fingerprint.

    Synthetic data may not go under the processed folder.
    """
    if data_mode not in ("real", "synthetic"):
        raise ConstraintError("data_mode is real or synthetic")
    if data_mode == "synthetic" and processed and path.startswith(processed.rstrip("/") + "/"):
        raise ConstraintError("synthetic data may not be written under the processed folder")
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.parquet(path)
    body = {"schema": kind, "schema_version": version, "data_mode": data_mode, "rows": out.count(), "columns": data_dictionary(df), "fingerprint": table_fingerprint(out), **notes}
    write_text(df.sparkSession, f"{path.rstrip('/')}.manifest.json", canonical_json(body))
    return body


def write_layer(df: DataFrame, path: str, kind: str, geometry: str, crs: str, **notes) -> dict:
    """A table with a geometry (rings) as WKB, its bounds as columns that readers prune by, and its CRS in the manifest.

    Rows are sorted by their bounds within a file, without a shuffle, so that row groups cover small areas.
    """
    corners = F.flatten(geometry)
    x, y = F.transform(corners, lambda p: p["x"]), F.transform(corners, lambda p: p["y"])
    bounds = {"xmin": F.array_min(x), "ymin": F.array_min(y), "xmax": F.array_max(x), "ymax": F.array_max(y)}
    out = df.withColumns({**bounds, geometry: wkb.polygon(F.col(geometry))}).sortWithinPartitions("xmin", "ymin")
    return write_table(out, path, kind, geo={"primary_column": geometry, "encoding": "WKB", "crs": crs}, **notes)


def data_dictionary(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def write_ranking(df: DataFrame, path: str, rank: str = "rank", *keys: str) -> None:
    """CSV in rank order, unranked rows last; sorted across files, not gathered in one task."""
    df.orderBy(F.asc_nulls_last(rank), *keys).write.mode("overwrite").csv(path, header=True)


def geojson_features(df: DataFrame, rings: str, properties: Sequence[str]) -> DataFrame:
    """One feature text a row (rings: array<array<struct<x,y>>> in longitude and latitude)."""
    coordinates = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def write_geojson(df: DataFrame, path: str, rings: str, properties: Sequence[str], most: int = 100_000) -> None:
    """A feature collection; a display file, so its number of features is checked."""
    features = geojson_features(df, rings, properties).limit(most + 1).collect()
    if len(features) > most:
        raise ConstraintError(f"more than {most} features")
    write_text(df.sparkSession, path, '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in features) + "]}")


def surface_pixels(df: DataFrame, lat: str, lon: str, score: str, width: int, height: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Mean score of each Mercator pixel (box: west, south, east, north) and its alpha."""
    west, south, east, north = box
    top, bottom = geo.mercator_y(F.lit(float(north))), geo.mercator_y(F.lit(float(south)))
    px = F.floor((F.col(lon) - west) / (east - west) * width).cast("int")
    py = F.floor((top - geo.mercator_y(lat)) / (top - bottom) * height).cast("int")
    out = df.where(F.col(score).isNotNull()).groupBy(px.alias("px"), py.alias("py")).agg(F.avg(score).alias("score"))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score") / 100.0))
    return out.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).withColumn("alpha", alpha_ramp(share))


def alpha_ramp(share: Column) -> Column:
    return 0.04 + 0.78 * F.pow(share, F.lit(1.4))


def png(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA picture."""
    height, width, _ = rgba.shape
    raw = np.zeros((height, 1 + 4 * width), np.uint8)
    raw[:, 1:] = rgba.reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 9)) + chunk(b"IEND", b"")


def surface_png(pixels: DataFrame, width: int, height: int, colour: tuple[int, int, int] = (20, 110, 80)) -> bytes:
    """At most width x height rows come to the driver."""
    rgba = np.zeros((height, width, 4), np.uint8)
    for r in pixels.select("px", "py", "alpha").collect():
        rgba[r["py"], r["px"]] = (*colour, round(255 * r["alpha"]))
    return png(rgba)


def sample_cube(df: DataFrame, path: str) -> None:
    """Monte Carlo samples in long form, by scenario."""
    df.write.mode("overwrite").option("compression", "zstd").partitionBy("scenario_id").parquet(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report table of a short result."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ConstraintError(f"more than {most} rows")
    show = lambda x: "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(show, r)) + " |" for r in rows]]) + "\n"


def html_report(title: str, sections: Sequence[tuple[str, str | DataFrame]], most: int = 200) -> str:
    """The same as one HTML page; everything is escaped."""
    body = []
    for name, content in sections:
        body.append(f"<h2>{html.escape(name)}</h2>")
        if isinstance(content, str):
            body.append(f"<p>{html.escape(content)}</p>")
            continue
        rows = content.limit(most + 1).collect()
        if len(rows) > most:
            raise ConstraintError(f"more than {most} rows")
        cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
        body.append("<table>" + cells("th", content.columns) + "".join(cells("td", r) for r in rows) + "</table>")
    return f"<!doctype html><meta charset=\"utf-8\"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>" + "".join(body)


def report(title: str, sections: Sequence[tuple[str, str | DataFrame]]) -> str:
    body = [f"# {title}\n"]
    for name, content in sections:
        body.append(f"## {name}\n\n{content if isinstance(content, str) else markdown_table(content)}")
    return "\n".join(body)
