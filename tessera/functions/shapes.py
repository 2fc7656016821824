"""Polygons, meshes and polyhedra as Column expressions over arrays of points; lengths written as expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

_CUTOFF = re.compile(r"\s*(?:([0-9]*\.?[0-9]+)\s*\*?\s*)?(d_nn)\s*|\s*([0-9]*\.?[0-9]+)\s*")


def cutoff(text: str | float, nearest: float) -> float:
    """A length in plain numbers, or as a multiple of the nearest distance of the crystal, as 0.85*d_nn."""
    if isinstance(text, int | float):
        value = float(text)
    else:
        m = _CUTOFF.fullmatch(text)
        if m is None:
            raise ValueError(f"not a length: {text!r}")
        value = float(m[3]) if m[3] else float(m[1] or 1) * nearest
    if not value > 0 or not math.isfinite(value):
        raise ValueError("a cutoff is a positive length")
    return value


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    at = lambda v, k: F.get(v, F.lit(k))
    return F.array(*[at(a, (k + 1) % 3) * at(b, (k + 2) % 3) - at(a, (k + 2) % 3) * at(b, (k + 1) % 3) for k in range(3)])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _fan(points: Column) -> Column:
    """(area, middle) of the triangles between the first point and each further edge."""
    def one(k: Column) -> Column:
        o, p, q = F.get(points, F.lit(0)), F.get(points, k), F.get(points, k + 1)
        middle = F.zip_with(F.zip_with(o, p, lambda x, y: x + y), q, lambda x, y: (x + y) / 3)
        return F.struct((norm(cross(_minus(p, o), _minus(q, o))) / 2).alias("area"), middle.alias("middle"))

    return F.when(F.size(points) >= 3, F.transform(F.sequence(F.lit(1), F.size(points) - 2), one))


def polygon_area(points: Column) -> Column:
    """Area of a flat convex polygon, its points in cyclic order; 0 with fewer than three."""
    return F.coalesce(F.aggregate(_fan(points), F.lit(0.0), lambda s, t: s + t.area), F.lit(0.0))


def polygon_centroid(points: Column) -> Column:
    """Centroid by area; null without one."""
    def of(fan: Column) -> Column:
        size = F.aggregate(fan, F.lit(0.0), lambda s, t: s + t.area)
        part = lambda k: F.aggregate(fan, F.lit(0.0), lambda s, t: s + t.area * F.get(t.middle, F.lit(k)))
        return F.array(*[F.try_divide(part(k), size) for k in range(3)])

    return let(_fan(points), of)


def polygon_order(points: Column, normal: Column) -> Column:
    """Points in cyclic order about a normal, by their angle round their mean."""
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(k)))
    mean = F.array(*[total(k) / F.size(points) for k in range(3)])

    def by(center: Column) -> Column:
        first = _minus(F.get(points, F.lit(0)), center)
        side = let(first, lambda u: cross(normal, u))
        return F.transform(F.array_sort(F.transform(points, lambda p: F.struct(F.atan2(dot(_minus(p, center), side), dot(_minus(p, center), first)).alias("t"), p.alias("p")))), lambda s: s.p)

    return let(mean, by)


def polyhedron_volume(area: Column, offset: Column) -> Column:
    """Aggregate over the faces of a cell: area times the distance of the plane from a point inside, a third of the sum."""
    return F.sum(area * offset) / 3


def mesh_area(a: Column, b: Column, c: Column) -> Column:
    """Aggregate over the triangles of a mesh."""
    return F.sum(norm(cross(_minus(b, a), _minus(c, a))) / 2)
