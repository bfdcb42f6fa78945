"""Well-known binary geometries to and from rings (array<array<struct<x,y>>>, even-odd rule), in Arrow batches.

Spark has no way from doubles to their bytes, so writing needs Python.  Null stays null; bytes that are no geometry are an error.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, StructType

_RINGS = ArrayType(ArrayType(StructType().add("x", DoubleType()).add("y", DoubleType())))


def _polygon(rings: list) -> bytes:
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        out += [struct.pack("<I", len(ring)), np.array([(p["x"], p["y"]) for p in ring], "<f8").tobytes()]
    return b"".join(out)


def _read(data: bytes, at: int, out: list) -> int:
    """Append the rings, lines or points of the geometry at a place; give the place behind it."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 9 if code & 0x20000000 else 5  # an SRID may follow
    flags, code = code >> 30, code & 0x1FFFFFFF
    width = 2 + (flags >> 1) + (flags & 1) + (0, 1, 1, 2)[code // 1000]
    kind = code % 1000

    def count() -> int:
        nonlocal at
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at += 4
        return n

    def line(n: int) -> list[dict]:
        nonlocal at
        values = np.frombuffer(data, f"{order}f8", n * width, at).reshape(n, width)
        at += 8 * n * width
        return [{"x": x, "y": y} for x, y in values[:, :2].tolist()]

    if kind == 1:
        out.append(line(1))
    elif kind == 2:
        out.append(line(count()))
    elif kind == 3:
        for _ in range(count()):
            out.append(line(count()))
    elif kind in (4, 5, 6, 7):
        for _ in range(count()):
            at = _read(data, at, out)
    else:
        raise ValueError(f"geometry type {kind}")
    return at


def _parse(data: bytes) -> list:
    out: list = []
    _read(data, 0, out)
    return out


@F.arrow_udf(BinaryType())
def polygon(rings: pa.Array) -> pa.Array:
    """WKB (little-endian polygon) of rings."""
    return pa.array([None if r is None else _polygon(r) for r in rings.to_pylist()], pa.binary())


@F.arrow_udf(_RINGS)
def rings(data: pa.Array) -> pa.Array:
    """Rings of any WKB geometry of either byte order, with or without SRID, heights and measures; parts one after the other."""
    return pa.array([None if d is None else _parse(d) for d in data.to_pylist()], to_arrow_type(_RINGS))
