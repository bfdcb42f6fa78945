"""Readers: typed scans and the odd source formats, as DataFrames with explicit schemas."""

from __future__ import annotations

import functools
import html.parser
import json
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import wkb
from ..operators.lineage import read_text
from ..operators.relations import ConstraintError, small, tagged_union


def table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A Parquet scan; the projection and the filter reach the file reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def table_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_count(spark: SparkSession, path: str, most: int | None = None) -> int:
    """Rows from the files' metadata; too many is an error before anything is read."""
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown", "false")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        n = spark.read.parquet(path).count()
    finally:
        spark.conf.set("spark.sql.parquet.aggregatePushdown", before)
    if most is not None and n > most:
        raise ConstraintError(f"{path} has {n} rows; at most {most} are accepted")
    return n


def manifest(spark: SparkSession, path: str, kind: str | None = None, minimum: tuple[int, int] | None = None) -> dict:
    """The dataset manifest beside a table; same major version and at least the minimum are demanded."""
    text = read_text(spark, f"{path.rstrip('/')}.manifest.json")
    if text is None:
        raise ConstraintError(f"{path} has no manifest")
    out = json.loads(text)
    if kind and out["schema"] != kind:
        raise ConstraintError(f"{path} is {out['schema']}, not {kind}")
    if minimum:
        version = tuple(int(x) for x in out["schema_version"].split(".")[:2])
        if version[0] != minimum[0] or version < minimum:
            raise ConstraintError(f"{path} has version {out['schema_version']}")
    return out


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",", skip_after_header: int = 0, header_rows: int = 1) -> DataFrame:
    """CSV or other separated text.  Extra header rows (units, metadata) are known by their line number in the file."""
    if header_rows == 1 and not skip_after_header:
        return spark.read.csv(path, schema=schema, sep=sep, header=True, mode="FAILFAST")
    source = "_metadata.file_path", "_metadata.file_block_start"
    lines = spark.read.text(path).select("value", *[F.col(c).alias(n) for c, n in zip(source, ("__file", "__at"))], F.monotonically_increasing_id().alias("__n"))
    # a partition may hold many small files, so lines are counted from the first one of their file
    opening = lines.where("__at = 0").groupBy("__file").agg(F.min("__n").alias("__first"))
    body = lines.join(small(opening), "__file").where((F.col("__at") > 0) | (F.col("__n") - F.col("__first") >= header_rows + skip_after_header))
    return body.select(F.from_csv("value", schema, {"sep": sep, "mode": "FAILFAST"}).alias("r")).select("r.*")


def fixed_width(spark: SparkSession, path: str, fields: Mapping[str, tuple[int, int]], width: int | None = None) -> DataFrame:
    """Text columns at 1-based inclusive positions; a line of another width is an error."""
    lines = spark.read.text(path)
    if width:
        value = F.when(F.length("value") == width, F.col("value")).otherwise(F.raise_error(F.lit("line width")).cast("string"))
        lines = lines.select(value.alias("value"))
    return lines.select(*[F.trim(F.substring("value", a, b - a + 1)).alias(n) for n, (a, b) in fields.items()])


def paged_json(spark: SparkSession, pages: str, schema: str, count: int | None = None) -> DataFrame:
    """Pages with a `features` array; the total is checked against the separately given count."""
    out = spark.read.json(pages, schema=f"features array<struct<attributes:struct<{schema}>>>", multiLine=True).select(F.explode("features").alias("f")).select("f.attributes.*")
    if count is not None and out.count() != count:
        raise ConstraintError("the pages do not add up to the count")
    return out


def json_polylines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, part, x1, y1, x2, y2): segments of polyline features."""
    raw = spark.read.json(path, schema=f"features array<struct<attributes:struct<{key}:bigint>,geometry:struct<paths:array<array<array<double>>>>>>", multiLine=True)
    parts = raw.select(F.explode("features").alias("f")).select(F.col(f"f.attributes.{key}").alias(key), F.posexplode("f.geometry.paths").alias("part", "p"))
    steps = F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i)[0].alias("x1"), F.get("p", i)[1].alias("y1"), F.get("p", i + 1)[0].alias("x2"), F.get("p", i + 1)[1].alias("y2")))
    return parts.where(F.size("p") >= 2).select(key, "part", F.inline(steps))


def wkb_points(df: DataFrame, geometry: str) -> dict[str, Column]:
    """x and y of WKB points of either byte order, by column functions alone; an empty point gives NaN."""
    little = F.hex(F.substring(F.col(geometry), 1, 1)) == "01"

    def number(offset: int) -> Column:
        bits = F.hex(F.substring(F.col(geometry), offset, 8))
        swapped = F.concat(*[F.substring(bits, 15 - 2 * i, 2) for i in range(8)])
        word = F.conv(F.when(little, swapped).otherwise(bits), 16, 10).cast("decimal(20,0)")
        sign = F.when(word >= F.lit(str(1 << 63)).cast("decimal(20,0)"), -1.0).otherwise(1.0)
        rest = (word % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("bigint")
        exponent = F.shiftright(rest, 52).cast("int")
        part = rest.bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
        power = F.pow(F.lit(2.0), F.greatest(exponent, F.lit(1)) - 1023)
        return F.when(exponent == 2047, F.lit(float("nan"))).otherwise(sign * (F.when(exponent == 0, 0.0).otherwise(1.0) + part) * power)

    return {"x": number(6), "y": number(14)}


def vector_layer(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, where: Column | None = None, columns: Sequence[str] | None = None, crs: str | None = None) -> DataFrame:
    """A layer that :func:`sinks.write_layer` wrote, its geometry as rings.

    The box (xmin, ymin, xmax, ymax in the layer's own CRS) and the attribute filter reach the file reader, which skips row
    groups by the bounds; a geometry is kept when its bounds touch the box.  Only kept rows are decoded.
    """
    note = manifest(spark, path)["geo"]
    if crs is not None and note["crs"] != crs:
        raise ConstraintError(f"{path} is in {note['crs']}, not {crs}")
    df = spark.read.parquet(path)
    if box is not None:
        df = df.where((F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1]))
    if where is not None:
        df = df.where(where)
    geometry = note["primary_column"]
    kept = list(columns) if columns is not None else [c for c in df.columns if c not in (geometry, "xmin", "ymin", "xmax", "ymax")]
    return df.select(*kept, wkb.rings(F.col(geometry)).alias(geometry))


def pixels(df: DataFrame, tile: int) -> DataFrame:
    """A raster as rows (i, j, value) with its tile, so that windows prune by tile."""
    return df.withColumn("tile_i", F.floor(F.col("i") / tile).cast("int")).withColumn("tile_j", F.floor(F.col("j") / tile).cast("int"))


def window(df: DataFrame, i0: int, i1: int, j0: int, j1: int, tile: int, nodata: float | None = None) -> DataFrame:
    """The pixels i0 <= i < i1, j0 <= j < j1; those that hold `nodata` are masked (null)."""
    if nodata is not None:
        df = df.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))
    near = F.col("tile_i").between(i0 // tile, (i1 - 1) // tile) & F.col("tile_j").between(j0 // tile, (j1 - 1) // tile)
    return df.where(near & F.col("i").between(i0, i1 - 1) & F.col("j").between(j0, j1 - 1))


def climate_cube(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """A long cube (time, lat, lon, value, model, scenario, member, calendar) of exactly one identity."""
    for k, v in expected.items():
        found = df.select(k).distinct().limit(2).collect()
        if [r[0] for r in found] != [v]:
            raise ConstraintError(f"{k} is {[r[0] for r in found]}, not {v}")
    return df


def sheet_rows(path: str, sheet: str) -> pd.DataFrame:
    """All cells of a worksheet of an .xlsx workbook by row and column; empty cells are None.

    The format is a zip of XML parts; numbers, texts (shared and inline) and booleans are read, formulas by their stored value.
    """
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(path) as z:
        parts = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        found = [parts[s.get(link)] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet") if s.get("name") == sheet]
        if not found:
            raise ConstraintError(f"no sheet {sheet}")
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{main}t"))
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")] if "xl/sharedStrings.xml" in z.namelist() else []
        target = found[0].lstrip("/")
        cells = {}
        for cell in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{main}c"):
            letters, row = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
            column = functools.reduce(lambda n, c: 26 * n + ord(c) - 64, letters, 0) - 1
            kind, stored = cell.get("t", "n"), cell.findtext(f"{main}v")
            if kind == "inlineStr":
                value = text(cell)
            elif stored is None:
                continue
            else:
                value = shared[int(stored)] if kind == "s" else stored == "1" if kind == "b" else float(stored) if kind == "n" else stored
            cells[int(row) - 1, column] = int(value) if isinstance(value, float) and value.is_integer() else value
    height, width = (1 + max((at[k] for at in cells), default=-1) for k in (0, 1))
    return pd.DataFrame([[cells.get((i, j)) for j in range(width)] for i in range(height)], dtype=object)


def workbook(spark: SparkSession, path: str, sheet: str, header: Sequence[Sequence[str]], columns: Sequence[str], schema: str) -> DataFrame:
    """A spreadsheet whose header rows are verified and whose columns are then taken by position.

    Workbooks are small by their format (at most 1,048,576 rows a sheet), so the driver reads them.
    """
    raw = sheet_rows(path, sheet)
    for i, row in enumerate(header):
        got = ["" if x is None else str(x).strip() for x in raw.iloc[i, : len(row)]]
        if got != list(row):
            raise ConstraintError(f"header row {i} is {got}")
    return spark.createDataFrame([tuple(r) for r in raw.iloc[len(header) :, : len(columns)].itertuples(index=False)], schema).toDF(*columns)


def header_row(rows: pd.DataFrame, names: Sequence[str], within: int = 12) -> int:
    """The only row among the first ones that holds all names."""
    hits = [i for i in range(min(within, len(rows))) if set(names) <= {str(x).strip() for x in rows.iloc[i]}]
    if len(hits) != 1:
        raise ConstraintError(f"{len(hits)} header rows")
    return hits[0]


def layers(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    return tagged_union({k: spark.read.parquet(v) for k, v in paths.items()})


def any_table(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """CSV, Parquet or JSON by its ending, with a contract on its columns."""
    kind = path.rsplit(".", 1)[-1]
    df = spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.json(path) if kind in ("json", "jsonl") else spark.read.parquet(path)
    if missing := [c for c in required if c not in df.columns]:
        raise ConstraintError(f"missing columns {missing}")
    return df


def archive_member(archive: str, member: str, target: str, sha256: str, most_bytes: int = 1 << 30) -> str:
    """Extract one checked member (driver side); paths that leave the target and members beyond a size are refused."""
    import hashlib

    root = Path(target).resolve()
    out = (root / member).resolve()
    if not out.is_relative_to(root):
        raise ConstraintError("the member leaves the target folder")
    with zipfile.ZipFile(archive) as z:
        if z.getinfo(member).file_size > most_bytes:
            raise ConstraintError(f"the member is larger than {most_bytes} bytes")
        data = z.read(member)
    if hashlib.sha256(data).hexdigest() != sha256:
        raise ConstraintError("checksum")
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_bytes(data)
    return str(out)


def strict_config(text: str, fields: Mapping[str, type]) -> dict:
    """JSON or, where its parser is installed, YAML configuration: exactly the known fields, of their types."""
    try:
        out = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ConstraintError("a configuration is a table of fields")
    if extra := set(out) - set(fields):
        raise ConstraintError(f"unknown fields {sorted(extra)}")
    if missing := set(fields) - set(out):
        raise ConstraintError(f"missing fields {sorted(missing)}")
    for k, t in fields.items():
        if not isinstance(out[k], t) or isinstance(out[k], bool) != (t is bool):
            raise ConstraintError(f"{k} is not {t.__name__}")
    return out


class _Cards(html.parser.HTMLParser):
    """Headings, links, paragraphs and list items in document order."""

    KEEP = ("title", "h1", "h2", "h3", "h4", "p", "li", "a", "td", "th", "div", "span")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[list] = []
        self.items: list[tuple[str, str]] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        elif tag in self.KEEP:
            self.open.append([tag, ""])

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        while tag in self.KEEP and self.open:
            kind, text = self.open.pop()
            text = re.sub(r"\s+", " ", text).strip()
            if text:
                self.items.append((kind, text))
            if kind == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open and not self.skip:
            self.open[-1][1] += data


def html_items(pages: DataFrame, key: str, column: str = "html") -> DataFrame:
    """(key, position, tag, text) of a page's text elements, parsed in Arrow batches."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, text in zip(pdf[key], pdf[column]):
                parser = _Cards()
                parser.feed(text or "")
                parser.close()
                rows += [(k, i, tag, t) for i, (tag, t) in enumerate(parser.items)]
            yield pd.DataFrame(rows, columns=[key, "position", "tag", "text"])

    return pages.select(key, column).mapInPandas(run, f"`{key}` {kind}, position int, tag string, text string")


def labelled_values(items: DataFrame, key: str) -> DataFrame:
    """'label: value' elements as columns label and value."""
    return items.where(F.col("text").contains(":")).withColumn("lv", S.label_value("text")).select(key, "position", "lv.*")
