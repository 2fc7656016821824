"""Fields on periodic grids: interpolation at points, warped and perturbed assignment, shells, lookup of labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import assign as A

MAX_NODES = 300_000


def _flat(field: DataFrame, n: int, names: list[str]) -> DataFrame:
    """One row holding the values of `field` (i, j, k, names) as arrays in grid order; the number of nodes is checked first."""
    if n**3 > MAX_NODES:
        raise ValueError(f"more than {MAX_NODES} nodes: join the corners by (i, j, k) instead")
    number = (F.col("i") * n + F.col("j")) * n + F.col("k")
    rows = field.agg(F.array_sort(F.collect_list(F.struct(number.alias("node"), *[F.col(c).cast("double").alias(c) for c in names]))).alias("_rows"))
    return rows.select(*[F.col("_rows").getField(c).alias(f"_f_{c}") for c in names])


def interpolate(points: DataFrame, field: DataFrame, n: int, box: float, names: list[str]) -> DataFrame:
    """`points` (x, y, z) with the columns `names` of `field`, linear between the eight nodes round each point, periodic."""
    h, out = box / n, points.crossJoin(F.broadcast(_flat(field, n, names)))  # one row
    for c in "xyz":
        out = out.withColumn(f"_g{c}", F.pmod(F.col(c), F.lit(box)) / F.lit(h))
        out = out.withColumn(f"_b{c}", F.floor(f"_g{c}").cast("int")).withColumn(f"_t{c}", F.col(f"_g{c}") - F.col(f"_b{c}"))

    def corner(a: int, b: int, c: int) -> tuple[Column, Column]:
        at = [F.pmod(F.col(f"_b{x}") + o, F.lit(n)) for x, o in zip("xyz", (a, b, c), strict=True)]
        share = [F.col(f"_t{x}") if o else 1 - F.col(f"_t{x}") for x, o in zip("xyz", (a, b, c), strict=True)]
        return (at[0] * n + at[1]) * n + at[2], share[0] * share[1] * share[2]

    corners = [corner(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    for name in names:
        terms = [F.get(F.col(f"_f_{name}"), at) * share for at, share in corners]
        out = out.withColumn(name, sum(terms[1:], terms[0]))
    return out.select(*points.columns, *names)


def warped(points: DataFrame, cells: DataFrame, field: DataFrame, n: int, box: float) -> DataFrame:
    """Euclidean assignment of x + u(x), with u from `field` (i, j, k, ux, uy, uz)."""
    moved = interpolate(points, field, n, box, ["ux", "uy", "uz"])
    moved = moved.select(*[c for c in points.columns if c not in "xyz"], *[(F.col(c) + F.col(f"u{c}")).alias(c) for c in "xyz"])
    return A.assign(moved, cells, box)


def perturbed(points: DataFrame, cells: DataFrame, field: DataFrame, n: int, box: float, amplitude: float, colors: int) -> DataFrame:
    """Assignment by distance less amplitude times the field of the cell's color (`field`: e0, e1, ...; `cells`: color)."""
    names = [f"e{k}" for k in range(colors)]
    at = interpolate(points, field, n, box, names)

    def less(dx, dy, dz, s, p):  # noqa: ANN001, ANN202
        noise = np.concatenate([p[c] for c in names], axis=1)
        return np.sqrt(dx * dx + dy * dy + dz * dz) - amplitude * noise[:, s["color"].astype(int)]

    return A.assign(at, cells, box, less, tuple(names)).drop(*names)


def shell(points: DataFrame, cells: DataFrame, box: float, width: float) -> DataFrame:
    """Points whose margin to the runner-up is at most `width` (inclusive)."""
    return A.margin(points, cells, box, A.distance).where(F.col("margin") <= F.lit(width))


def lookup(points: DataFrame, voxels: DataFrame, n: int, box: float) -> DataFrame:
    """`points` with the label of the voxel they lie in, by an equi-join."""
    at = [F.least(F.floor(F.pmod(F.col(c), F.lit(box)) / F.lit(box / n)), F.lit(n - 1)).cast("int").alias(a) for a, c in zip("ijk", "xyz", strict=True)]
    return points.select("*", *at).join(voxels.select("i", "j", "k", "grain"), ["i", "j", "k"]).select(*points.columns, "grain")


def override(voxels: DataFrame, repaired: DataFrame) -> DataFrame:
    """(i, j, k, grain) where `repaired` differs from `voxels`."""
    return repaired.select("i", "j", "k", "grain").exceptAll(voxels.select("i", "j", "k", "grain"))


def relax(grid_points: DataFrame, cells: DataFrame, box: float, steps: int) -> DataFrame:
    """Lloyd steps: each cell moves by the mean offset of its grid points, wrapped; cells without points stay."""
    for _ in range(steps):
        found = A.assign(grid_points, cells.select("grain", "sx", "sy", "sz"), box)
        both = found.join(F.broadcast(cells), "grain")
        mean = both.groupBy("grain").agg(*[F.avg(G.min_image(F.col(c) - F.col(f"s{c}"), box)).alias(f"d{c}") for c in "xyz"])
        moved = cells.join(mean, "grain", "left")
        cells = moved.select("grain", *[G.wrap(F.col(f"s{c}") + F.coalesce(f"d{c}", F.lit(0.0)), box).alias(f"s{c}") for c in "xyz"]).checkpoint()
    return cells


def box_counts(mask: DataFrame, sizes: list[int]) -> DataFrame:
    """(eps, n) of boxes of each size that hold a pixel of `mask` (u, v)."""
    eps = F.explode(F.array(*[F.lit(s) for s in sizes])).alias("eps")
    at = mask.select(eps, "u", "v").select("eps", F.floor(F.col("u") / F.col("eps")).alias("a"), F.floor(F.col("v") / F.col("eps")).alias("b"))
    return at.distinct().groupBy("eps").agg(F.count("*").alias("n"))


def perimeter(section: DataFrame) -> DataFrame:
    """Pixels (u, v) next to another label among the four neighbours, without periodicity; `section`: u, v, grain."""
    near = F.explode(F.array(*[F.struct((F.col("u") + a).alias("u"), (F.col("v") + b).alias("v")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]))
    other = section.select(F.col("grain").alias("other"), near.alias("t")).select("t.u", "t.v", "other")
    return section.join(other, ["u", "v"]).where("grain <> other").select("u", "v").distinct()
