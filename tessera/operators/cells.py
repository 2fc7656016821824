"""Polyhedral cells of point seeds, plain or weighted: faces, volumes, surfaces, edges, vertices, margins, fits of weights.

A cell is the box round its seed, cut by the half-space of each replica of the other seeds, nearest planes first, until no
plane can reach the farthest vertex left. Every cell is a row of work of its own (`mapInPandas`); what follows from the
faces (volumes, graphs, triple lines, centroids, the Euler number) is plain aggregation over the table of faces.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .assign import collected

#: Walls of the box along axes that are not periodic, as neighbours.
WALLS = {(0, -1): -1, (0, 1): -2, (1, -1): -3, (1, 1): -4, (2, -1): -5, (2, 1): -6}
FACES = (
    "grain int, neighbor int, ix int, iy int, iz int, area double, nx double, ny double, nz double, offset double,"
    " cx double, cy double, cz double, vertices array<array<double>>"
)
QUANTUM = 1e-6


def _cut(polygon: np.ndarray, normal: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The part of a polygon with normal . x <= reach, and the points where its edges cross."""
    d = polygon @ normal - reach
    inside = d <= 0
    if inside.all():
        return polygon, []
    out, crossed = [], []
    for k in range(len(polygon)):
        j = (k + 1) % len(polygon)
        if inside[k]:
            out.append(polygon[k])
        if inside[k] != inside[j]:
            at = polygon[k] + (polygon[j] - polygon[k]) * (d[k] / (d[k] - d[j]))
            out.append(at)
            crossed.append(at)
    return np.array(out).reshape(-1, 3), crossed


def around(points: np.ndarray, normal: np.ndarray) -> np.ndarray:
    """Points of a convex polygon in cyclic order about its normal, those nearer than a quantum taken once."""
    center = points.mean(axis=0)
    one = np.cross(normal, np.eye(3)[np.argmin(np.abs(normal))])
    one /= np.linalg.norm(one)
    rel = points - center
    order = np.argsort(np.arctan2(rel @ np.cross(normal, one), rel @ one), kind="stable")
    points = points[order]
    apart = np.linalg.norm(points - np.roll(points, 1, axis=0), axis=1) > QUANTUM * 1e-2
    return points[apart] if apart.sum() >= 3 else points


def polygon_measure(points: np.ndarray) -> tuple[float, np.ndarray]:
    """Area and centroid of a polygon, by the triangles of a fan."""
    a, b = points[1:-1] - points[0], points[2:] - points[0]
    size = np.linalg.norm(np.cross(a, b), axis=1) / 2
    total = size.sum()
    middle = (points[0] + points[1:-1] + points[2:]) / 3
    return float(total), (middle * size[:, None]).sum(axis=0) / total if total > 0 else points.mean(axis=0)


def cell_faces(seed: np.ndarray, weight: float, planes: list[tuple[float, np.ndarray, tuple]], box: tuple[float | None, ...], length: tuple[float, ...]) -> list[tuple]:
    """(key, normal, offset, polygon) of a cell, relative to its seed; `planes`: (offset, normal, key) in ascending order."""
    low = [-length[k] if box[k] is not None else -seed[k] for k in range(3)]
    high = [length[k] if box[k] is not None else length[k] - seed[k] for k in range(3)]
    faces = []
    for axis in range(3):
        others = [k for k in range(3) if k != axis]
        for side, at in ((-1, low[axis]), (1, high[axis])):
            normal = np.zeros(3)
            normal[axis] = side
            points = np.zeros((4, 3))
            points[:, axis] = at
            points[:, others] = list(itertools.product((low[others[0]], high[others[0]]), (low[others[1]], high[others[1]])))
            faces.append(((WALLS[axis, side], 0, 0, 0), normal, side * at, around(points, normal)))
    for reach, normal, key in planes:
        corner = max(float(np.einsum("ij,ij->i", f[3], f[3]).max()) for f in faces) if faces else 0.0
        if reach > 0 and reach * reach > corner:
            break
        kept, crossed = [], []
        for k, n, o, polygon in faces:
            part, points = _cut(polygon, normal, reach)
            crossed += points
            if len(part) >= 3:
                kept.append((k, n, o, part))
        if len(crossed) >= 3:
            kept.append((key, normal, reach, around(np.array(crossed), normal)))
        faces = kept
        if not faces:
            break
    return faces


def faces(cells: DataFrame, length: tuple[float, float, float], periodic: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """Faces of every cell of `cells` (grain, sx, sy, sz, and w for weights): neighbour (a wall where negative) and its image,
    area, outward normal, offset of the plane from the seed, centroid and vertices relative to the seed."""
    s = collected(cells)
    at = np.stack([s[f"s{c}"].astype(float) for c in "xyz"], axis=1)
    weight = s["w"].astype(float) if "w" in s else np.zeros(len(at))
    box = tuple(v if p else None for v, p in zip(length, periodic, strict=True))
    images = np.array(list(itertools.product(*[(-1, 0, 1) if p else (0,) for p in periodic])))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for grain in frame["grain"]:
                i = int(np.flatnonzero(s["grain"] == grain)[0])
                d = (at[:, None] + images[None] * np.array(length) - at[i]).reshape(-1, 3)
                size = np.linalg.norm(d, axis=1)
                other = np.repeat(np.arange(len(at)), len(images))
                real = np.flatnonzero(size > 0)
                reach = (size[real] ** 2 + weight[i] - weight[other[real]]) / (2 * size[real])
                order = real[np.argsort(reach, kind="stable")]
                reach = np.sort(reach, kind="stable")
                shift = np.tile(images, (len(at), 1))
                planes = [(float(o), d[k] / size[k], (int(s["grain"][other[k]]), *map(int, shift[k]))) for o, k in zip(reach, order, strict=True)]
                for key, normal, offset, polygon in cell_faces(at[i], weight[i], planes, box, length):
                    area, center = polygon_measure(polygon)
                    if area > 1e-12:
                        rows.append((grain, *key, area, *normal, offset, *center, polygon.tolist()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FACES.replace("array<array<double>>", "x").split(",")])

    return cells.select("grain").repartition("grain").mapInPandas(run, FACES)


def volumes(found: DataFrame) -> DataFrame:
    """(grain, volume, surface, n_faces, gx, gy, gz): pyramids from the seed to each face; g: centroid relative to the seed."""
    v = F.col("area") * F.col("offset") / 3
    middle = [F.try_divide(F.sum(v * 0.75 * F.col(f"c{c}")), F.sum(v)).alias(f"g{c}") for c in "xyz"]
    return found.groupBy("grain").agg(F.sum(v).alias("volume"), F.sum("area").alias("surface"), F.count("*").alias("n_faces"), *middle)


def graph(found: DataFrame) -> DataFrame:
    """(grain_i, grain_j, area) of neighbouring cells, walls and own images left out; each face is there from both sides."""
    both = found.where("neighbor >= 0 and neighbor <> grain")
    return both.groupBy(F.least("grain", "neighbor").alias("grain_i"), F.greatest("grain", "neighbor").alias("grain_j")).agg((F.sum("area") / 2).alias("area"))


def _place(cells: DataFrame, found: DataFrame, length: tuple[float, float, float]) -> DataFrame:
    """Vertices of the faces in quanta, wrapped into the box: (grain, face, pos, a) with a: the place as whole numbers."""
    both = found.join(F.broadcast(cells.select("grain", "sx", "sy", "sz")), "grain")
    rows = both.select("grain", "neighbor", "ix", "iy", "iz", "sx", "sy", "sz", F.size("vertices").alias("n"), F.posexplode("vertices").alias("pos", "v"))
    turn = [F.pmod(F.rint((F.col(f"s{c}") + F.get("v", F.lit(k))) / QUANTUM / 10), F.lit(round(length[k] / QUANTUM / 10))).cast("long") for k, c in enumerate("xyz")]
    own = [F.rint(F.get("v", F.lit(k)) / QUANTUM / 10).cast("long") for k in range(3)]
    return rows.select("grain", "neighbor", "ix", "iy", "iz", "n", "pos", F.array(*own).alias("own"), F.array(*turn).alias("a"), F.col("v"))


def vertices(cells: DataFrame, found: DataFrame, length: tuple[float, float, float]) -> DataFrame:
    """(grain, v_index, x, y, z, adjacent_grains) of each cell's distinct vertices; adjacent grains sorted, joined by ;"""
    from pyspark.sql import Window

    one = _place(cells, found, length).groupBy("grain", "own").agg(
        F.first("v").alias("v"), F.array_join(F.array_sort(F.array_distinct(F.concat(F.collect_set(F.when(F.col("neighbor") >= 0, F.col("neighbor"))), F.array("grain")))).cast("array<string>"), ";").alias("adjacent_grains")
    )
    number = (F.row_number().over(Window.partitionBy("grain").orderBy("own")) - 1).alias("v_index")
    spot = one.join(F.broadcast(cells.select("grain", "sx", "sy", "sz")), "grain")
    return spot.select("grain", number, *[(F.col(f"s{c}") + F.get("v", F.lit(k))).alias(c) for k, c in enumerate("xyz")], "adjacent_grains")


def _edges(cells: DataFrame, found: DataFrame, length: tuple[float, float, float]) -> DataFrame:
    p = _place(cells, found, length)
    nxt = p.select("grain", "neighbor", "ix", "iy", "iz", F.pmod(F.col("pos") - 1, F.col("n")).alias("pos"), F.col("own").alias("own2"), F.col("a").alias("a2"), F.col("v").alias("v2"))
    both = p.join(nxt, ["grain", "neighbor", "ix", "iy", "iz", "pos"])
    size = F.sqrt(sum(((F.get("v", F.lit(k)) - F.get("v2", F.lit(k))) ** 2 for k in range(1, 3)), (F.get("v", F.lit(0)) - F.get("v2", F.lit(0))) ** 2))
    return both.withColumn("size", size).where("own <> own2")


def euler(cells: DataFrame, found: DataFrame, length: tuple[float, float, float]) -> DataFrame:
    """(grain, v, e, f, euler) of each cell, vertices and edges taken once by their quantised places."""
    v = _place(cells, found, length).groupBy("grain").agg(F.countDistinct("own").alias("v"))
    key = F.struct(F.least("own", "own2"), F.greatest("own", "own2"))
    e = _edges(cells, found, length).groupBy("grain").agg(F.countDistinct(key).alias("e"))
    f = found.groupBy("grain").agg(F.count("*").alias("f"))
    return v.join(e, "grain").join(f, "grain").select("grain", "v", "e", "f", (F.col("v") - F.col("e") + F.col("f")).alias("euler"))


def triple_line_length(cells: DataFrame, found: DataFrame, length: tuple[float, float, float]) -> DataFrame:
    """One row: total length of edges at which three or more grains meet; each edge once, by its quantised ends."""
    key = F.struct(F.least("a", "a2").alias("p"), F.greatest("a", "a2").alias("q"))
    one = _edges(cells, found, length).groupBy(key.alias("k")).agg(F.max("size").alias("size"), F.countDistinct("grain").alias("n"))
    return one.where("n >= 3").agg(F.coalesce(F.sum("size"), F.lit(0.0)).alias("length"))


def face_margin(points: DataFrame, cells: DataFrame, found: DataFrame, length: tuple[float, float, float], periodic: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """`points` (with `grain`) with `margin`: distance to the nearest plane of the cell's faces, walls left out (null without)."""
    s, rows = collected(cells), found.where("neighbor >= 0").select("grain", "nx", "ny", "nz", "offset").toPandas()
    planes = {g: f[["nx", "ny", "nz", "offset"]].to_numpy() for g, f in rows.groupby("grain")}
    seed = {g: np.array([s[f"s{c}"][k] for c in "xyz"], dtype=float) for k, g in enumerate(s["grain"])}
    size = np.array([v if p else np.inf for v, p in zip(length, periodic, strict=True)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = np.full(len(frame), np.nan)
            x = frame[["x", "y", "z"]].to_numpy(dtype=float)
            for g, at in frame.groupby("grain").indices.items():
                if g in planes:
                    d = x[at] - seed[g]
                    with np.errstate(invalid="ignore"):
                        d = np.where(np.isfinite(size), d - np.rint(d / size) * np.where(np.isfinite(size), size, 0), d)
                    out[at] = (planes[g][:, 3] - d @ planes[g][:, :3].T).min(axis=1)
            yield frame.assign(margin=out)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInPandas(run, f"{kind}, margin double").withColumn("margin", F.nanvl("margin", F.lit(None).cast("double")))


def laplacian(cells: DataFrame, found: DataFrame) -> DataFrame:
    """(grain_i, grain_j, value) of the derivative of volumes by weights: area over twice the distance, walls and own images out."""
    out = found.where("neighbor >= 0 and neighbor <> grain").join(F.broadcast(cells.select("grain", "w")), "grain")
    other = F.broadcast(cells.select(F.col("grain").alias("neighbor"), F.col("w").alias("v")))
    # offset = (d^2 + w - v) / 2d, so d is the larger root.
    d = F.col("offset") + F.sqrt(F.greatest(F.col("offset") * F.col("offset") - (F.col("w") - F.col("v")), F.lit(0.0)))
    part = out.join(other, "neighbor").select("grain", "neighbor", (F.col("area") / (2 * d)).alias("c"))
    off = part.groupBy(F.col("grain").alias("grain_i"), F.col("neighbor").alias("grain_j")).agg((-F.sum("c")).alias("value"))
    return off.union(part.groupBy(F.col("grain").alias("grain_i"), F.col("grain").alias("grain_j")).agg(F.sum("c").alias("value")))


def fit_weights(cells: DataFrame, targets: dict[int, float], length: tuple[float, float, float], tolerance: float = 1e-3, steps: int = 40) -> dict[int, float]:
    """Weights for which the cells have the target volumes: damped Newton steps on the volumes, with the Laplacian of the
    faces; a step that would empty a cell or not lessen the error is halved. The first weight stays 0."""
    spark, ids = cells.sparkSession, sorted(targets)
    rows = {r.grain: (r.sx, r.sy, r.sz) for r in cells.select("grain", "sx", "sy", "sz").collect()}
    goal = np.array([targets[g] for g in ids])

    def measured(w: np.ndarray) -> tuple[np.ndarray, DataFrame, DataFrame]:
        now = spark.createDataFrame([(g, *rows[g], float(v)) for g, v in zip(ids, w, strict=True)], "grain int, sx double, sy double, sz double, w double")
        found = faces(now, length).cache()
        got = {r.grain: r.volume for r in volumes(found).collect()}
        return np.array([got.get(g, 0.0) for g in ids]), now, found

    w = np.zeros(len(ids))
    v, now, found = measured(w)
    for _ in range(steps):
        if np.abs(v - goal).max() <= tolerance * goal.min():
            break
        j = np.zeros((len(ids), len(ids)))
        at = {g: k for k, g in enumerate(ids)}
        for r in laplacian(now, found).collect():
            j[at[r.grain_i], at[r.grain_j]] = r.value
        step = np.r_[0.0, np.linalg.lstsq(j[1:, 1:], (goal - v)[1:], rcond=None)[0]]
        scale, error = 1.0, np.abs(v - goal).sum()
        while True:
            found.unpersist()
            u, now, found = measured(w + scale * step)
            if (u.min() > 0 and np.abs(u - goal).sum() < error) or scale < 1e-3:
                break
            scale /= 2
        w, v = w + scale * step, u
    found.unpersist()
    return dict(zip(ids, w.tolist(), strict=True))
