"""Crystals: filling of cells with rotated lattices, triclinic boxes, random orientations and textures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import assign as A
from . import pairs

Matrix = tuple[tuple[float, float, float], ...]


def cell_matrix(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> Matrix:
    """Lattice vectors as columns: a along x, b in the plane of x and y. Angles in degrees."""
    ca, cb, cg = (math.cos(math.radians(t)) for t in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    y = (ca - cb * cg) / sg
    if (square := 1 - cb * cb - y * y) <= 0:
        raise ValueError("no cell has these angles")
    return ((a, b * cg, c * cb), (0.0, b * sg, c * y), (0.0, 0.0, c * math.sqrt(square)))


def reduce_tilts(h: Matrix) -> Matrix:
    """The same lattice with xy, xz and yz at most half of the length they are measured against."""
    (ax, bx, cx), (_, by, cy), (_, _, cz) = h
    k = round(cy / by)
    cx, cy = cx - k * bx, cy - k * by
    return ((ax, bx - round(bx / ax) * ax, cx - round(cx / ax) * ax), (0.0, by, cy), (0.0, 0.0, cz))


def _fractions(h: Matrix, d: list[Column]) -> list[Column]:
    (ax, bx, cx), (_, by, cy), (_, _, cz) = h
    w = d[2] / F.lit(cz)
    v = (d[1] - w * F.lit(cy)) / F.lit(by)
    return [(d[0] - v * F.lit(bx) - w * F.lit(cx)) / F.lit(ax), v, w]


def _cartesian(h: Matrix, f: list[Column]) -> list[Column]:
    return [f[0] * F.lit(h[0][0]) + f[1] * F.lit(h[0][1]) + f[2] * F.lit(h[0][2]), f[1] * F.lit(h[1][1]) + f[2] * F.lit(h[1][2]), f[2] * F.lit(h[2][2])]


def wrap(h: Matrix, d: list[Column]) -> list[Column]:
    """Into the box of lattice vectors `h` (upper triangular)."""
    return _cartesian(h, [F.pmod(f, F.lit(1.0)) for f in _fractions(h, d)])


def images(h: Matrix, reach: float) -> list[tuple[int, int, int]]:
    """Steps over lattice vectors that may bring a difference, rounded to the nearest cell, to `reach` or less."""
    (ax, bx, cx), (_, by, cy), (_, _, cz) = h
    rows = [(1 / ax, -bx / (ax * by), (bx * cy - cx * by) / (ax * by * cz)), (0, 1 / by, -cy / (by * cz)), (0, 0, 1 / cz)]
    n = [math.ceil(0.5 + reach * math.sqrt(sum(c * c for c in r))) for r in rows]
    return [(i, j, k) for i in range(-n[0], n[0] + 1) for j in range(-n[1], n[1] + 1) for k in range(-n[2], n[2] + 1)]


def square_distance(h: Matrix, d: list[Column], reach: float) -> Column:
    """Smallest square of a difference over all periodic images, exact where it is at most reach squared."""
    f = [x - F.rint(x) for x in _fractions(h, d)]
    steps = F.array(*[F.struct(*[F.lit(float(c)).alias(n) for c, n in zip(s, "xyz", strict=True)]) for s in images(h, reach)])

    def over(base: Column) -> Column:
        def one(s: Column) -> Column:
            x = _cartesian(h, [base.x + s.x, base.y + s.y, base.z + s.z])
            return G.square_distance(*x)

        return F.array_min(F.transform(steps, one))

    return G.let(F.struct(*[x.alias(n) for x, n in zip(f, "xyz", strict=True)]), over)


def triclinic_pairs(points: DataFrame, cutoff: float, h: Matrix) -> DataFrame:
    """(i, j, d2) of pairs i < j within `cutoff` (inclusive) in a triclinic periodic box, by buckets of fractions."""
    (ax, bx, cx), (_, by, cy), (_, _, cz) = h
    rows = [(1 / ax, -bx / (ax * by), (bx * cy - cx * by) / (ax * by * cz)), (0, 1 / by, -cy / (by * cz)), (0, 0, 1 / cz)]
    n = [max(1, math.floor(1 / (cutoff * math.sqrt(sum(c * c for c in r))))) for r in rows]
    frac = [F.pmod(f, F.lit(1.0)) for f in _fractions(h, [F.col(c) for c in "xyz"])]
    cell = [F.least(F.floor(f * k).cast("int"), F.lit(k - 1)) for f, k in zip(frac, n, strict=True)]
    # Points of neighbouring cells differ by two cells at most, so with four cells along an axis only the nearest image counts.
    steps = [s for s in images(h, cutoff) if not any(s[a] and n[a] >= 4 for a in range(3))]

    def square(*d: np.ndarray) -> np.ndarray:
        w = d[2] / cz
        v = (d[1] - w * cy) / by
        f = [x - np.rint(x) for x in ((d[0] - v * bx - w * cx) / ax, v, w)]
        least = np.full(len(w), np.inf)
        for s in steps:
            p, q, r = (x + float(k) for x, k in zip(f, s, strict=True))
            x, y, z = p * ax + q * bx + r * cx, q * by + r * cy, r * cz
            least = np.minimum(least, x * x + y * y + z * z)
        return least

    return pairs.near_pairs(points, cell, tuple(n), square, cutoff)


def fill(cells: DataFrame, quats: DataFrame, basis: list[tuple[float, float, float]], edge: float, box: float, reach: float) -> DataFrame:
    """(grain, ord, x, y, z): sites of the lattice of each grain, turned by its orientation about its seed, that the grain owns.

    `reach` is at least the largest distance of a point to the seed that owns it. Rows are spread by (grain, layer) before
    they explode, so one large grain does not make one task.
    """
    n = math.ceil(reach / edge) + 1
    layers = cells.join(quats, "grain").select("*", F.explode(F.sequence(F.lit(-n), F.lit(n))).alias("a")).repartition(F.col("grain"), F.col("a"))
    span = F.sequence(F.lit(-n), F.lit(n))
    spots = F.array(*[F.struct(F.lit(m).alias("m"), *[F.lit(float(c)).alias(f"f{x}") for c, x in zip(f, "xyz", strict=True)]) for m, f in enumerate(basis)])
    sites = layers.withColumn("b", F.explode(span)).withColumn("c", F.explode(span)).withColumn("s", F.explode(spots))
    offset = [(F.col(k) + F.col(f"s.f{x}")) * F.lit(edge) for k, x in zip("abc", "xyz", strict=True)]
    sites = sites.withColumn("v", F.struct(*[o.alias(x) for o, x in zip(offset, "xyz", strict=True)])).where(F.col("v.x") * F.col("v.x") + F.col("v.y") * F.col("v.y") + F.col("v.z") * F.col("v.z") <= F.lit(reach * reach))
    turned = G.rotate(F.col("q"), F.col("v.x"), F.col("v.y"), F.col("v.z"))
    # Only the copy of a site that is its seed's nearest image counts, so no site comes twice from two images.
    side = 2 * n + 1
    number = (((F.col("a") + n) * side + F.col("b") + n) * side + F.col("c") + n) * len(basis) + F.col("s.m")
    moved = sites.select(F.col("grain").alias("home"), number.cast("long").alias("ord"), *[t.alias(f"t{x}") for t, x in zip(turned, "xyz", strict=True)], "sx", "sy", "sz")
    half = F.lit(box / 2)
    moved = moved.where((F.col("tx") >= -half) & (F.col("tx") < half) & (F.col("ty") >= -half) & (F.col("ty") < half) & (F.col("tz") >= -half) & (F.col("tz") < half))
    placed = moved.select("home", "ord", *[G.wrap(F.col(f"s{x}") + F.col(f"t{x}"), box).alias(x) for x in "xyz"])
    owned = A.assign(placed, cells.select("grain", "sx", "sy", "sz"), box).where("home = grain")
    return owned.select("grain", "ord", "x", "y", "z")


def haar(u1: Column, u2: Column, u3: Column) -> Column:
    """Uniform orientation from three uniform numbers."""
    turn = F.lit(2 * math.pi)
    a, b = F.sqrt(1 - u1), F.sqrt(u1)
    return G.let(G.quat(b * F.cos(turn * u3), a * F.sin(turn * u2), a * F.cos(turn * u2), b * F.sin(turn * u3)), G.quat_canonical)


def fibre(axis: tuple[float, float, float], sample: tuple[float, float, float], spin: Column) -> Column:
    """Orientation that takes the crystal's `axis` to the direction `sample`, turned by `spin` (0 to 1) about it."""
    unit = lambda v: [c / math.sqrt(sum(x * x for x in v)) for c in v]
    p, s = unit(axis), unit(sample)
    cross = [p[1] * s[2] - p[2] * s[1], p[2] * s[0] - p[0] * s[2], p[0] * s[1] - p[1] * s[0]]
    w = 1 + sum(x * y for x, y in zip(p, s, strict=True))
    if w < 1e-12:  # opposite: half a turn about any normal
        k = min(range(3), key=lambda i: abs(p[i]))
        e = [float(i == k) for i in range(3)]
        w, cross = 0.0, [p[1] * e[2] - p[2] * e[1], p[2] * e[0] - p[0] * e[2], p[0] * e[1] - p[1] * e[0]]
    size = math.sqrt(w * w + sum(c * c for c in cross))
    first = G.quat(*[F.lit(c / size) for c in (w, *cross)])
    about = G.from_axis_angle(*[F.lit(c) for c in s], spin * 360)
    return G.let(G.quat_mul(about, first), G.quat_canonical)
