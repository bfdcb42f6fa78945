"""Areas and unions of polygons with any rings, by vertical slabs.

A polygon is an array of rings (array<struct<x:double,y:double>>, closed or not); a point is inside by the even-odd rule, so
inner rings are holes.  All corners and edge crossings cut the plane into slabs; inside a slab no two edges
cross, so what is covered is a stack of trapezoids.  Spark has no geometry type: this runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, StructType

_POINT = StructType().add("x", DoubleType()).add("y", DoubleType())
_PIECES = ArrayType(StructType().add("ring", ArrayType(_POINT)).add("area", DoubleType()))

Trapezoid = tuple[float, float, float, float, float, float]  # x0, x1, low at x0, low at x1, high at x0, high at x1


def _edges(polygons: Sequence) -> np.ndarray:
    """Edges (x1, y1, x2, y2, polygon) from left to right; upright ones cover nothing."""
    out = []
    for k, rings in enumerate(polygons):
        for ring in rings if rings is not None else ():
            p = np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)
            q = np.roll(p, -1, 0)
            keep = p[:, 0] != q[:, 0]
            p, q = p[keep], q[keep]
            swap = (p[:, 0] > q[:, 0])[:, None]
            a, b = np.where(swap, q, p), np.where(swap, p, q)
            out.append(np.column_stack([a, b, np.full(len(a), k)]))
    return np.concatenate(out) if out else np.zeros((0, 5))


def trapezoids(polygons: Sequence, covered: Callable[[np.ndarray], bool]) -> Iterator[Trapezoid]:
    """The plane where `covered` holds of the flags that tell which polygons a point is inside."""
    e = _edges(polygons)
    if not len(e):
        return
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    base = e[:, 1] - slope * e[:, 0]
    cuts = [e[:, 0], e[:, 2]]
    for i in range(len(e) - 1):  # crossings of one edge with all later ones
        d = slope[i] - slope[i + 1 :]
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (base[i + 1 :] - base[i]) / d
        cuts.append(x[np.isfinite(x) & (x > np.maximum(e[i, 0], e[i + 1 :, 0])) & (x < np.minimum(e[i, 2], e[i + 1 :, 2]))])
    xs = np.unique(np.concatenate(cuts))
    inside = np.zeros(len(polygons), bool)
    for a, b in zip(xs, xs[1:]):
        mid = (a + b) / 2
        on = np.flatnonzero((e[:, 0] < mid) & (e[:, 2] > mid))
        on = on[np.argsort(slope[on] * mid + base[on], kind="stable")]
        inside[:] = False
        low = -1
        for i in on:
            before = covered(inside)
            inside[int(e[i, 4])] ^= True
            now = covered(inside)
            if now and not before:
                low = i
            elif before and not now:
                yield (a, b, *(slope[k] * x + base[k] for k in (low, i) for x in (a, b)))


def area(pieces: Iterator[Trapezoid]) -> float:
    return float(sum((b - a) * (h0 + h1 - l0 - l1) / 2 for a, b, l0, l1, h0, h1 in pieces))


@F.arrow_udf(DoubleType())
def common_area(polygons: pa.Array) -> pa.Array:
    """Area inside all polygons of an array."""
    return pa.array([None if ps is None else area(trapezoids(ps, np.all)) for ps in polygons.to_pylist()], pa.float64())


@F.arrow_udf(_PIECES)
def union_pieces(polygons: pa.Array, x: pa.Array, y: pa.Array, size: pa.Array) -> pa.Array:
    """What is inside any polygon of an array and inside a square, as trapezoids."""

    def one(ps, x0, y0, s):
        square = [[{"x": x0 + s * i, "y": y0 + s * j} for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]]
        return [
            {"ring": [{"x": u, "y": v} for u, v in ((a, l0), (b, l1), (b, h1), (a, h0), (a, l0))], "area": area(iter([(a, b, l0, l1, h0, h1)]))}
            for a, b, l0, l1, h0, h1 in trapezoids([*ps, square], lambda flags: flags[-1] and flags[:-1].any())
        ]

    return pa.array([one(*r) for r in zip(*(c.to_pylist() for c in (polygons, x, y, size)))], to_arrow_type(_PIECES))
