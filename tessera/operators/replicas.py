"""Images of points over periodic and free axes, ownership, single crystals, imported label fields, conflict graphs, seeds."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

Axes = tuple[bool, bool, bool]


def replicated(seeds: DataFrame, length: tuple[float, float, float], periodic: Axes, mirror: bool = True) -> DataFrame:
    """`seeds` (sx, sy, sz, ...) with (ix, iy, iz, mirrored): all images by one period, and on free axes, if wished, mirror images
    in both walls; the image (0, 0, 0) is the seed itself. A literal list of at most 27 steps, so nothing is shuffled."""
    steps = list(itertools.product(*[(-1, 0, 1) if p or mirror else (0,) for p in periodic]))
    step = F.explode(F.array(*[F.struct(*[F.lit(v).alias(f"i{c}") for c, v in zip("xyz", s, strict=True)]) for s in steps])).alias("_i")
    out = seeds.select("*", step)

    def at(c: str, size: float, p: bool) -> Column:
        i, x = F.col(f"_i.i{c}"), F.col(f"s{c}")
        return (x + i * F.lit(size) if p else F.when(i < 0, -x).when(i > 0, 2 * F.lit(size) - x).otherwise(x)).alias(f"s{c}")

    flipped = [F.col(f"_i.i{c}") != 0 for c, p in zip("xyz", periodic, strict=True) if not p]
    mirrored = flipped[0] if flipped else F.lit(False)
    for f in flipped[1:]:
        mirrored = mirrored | f
    moved = {f"s{c}": at(c, v, p) for c, v, p in zip("xyz", length, periodic, strict=True)}
    return out.select(*[moved.get(c, F.col(c)) for c in seeds.columns], *[F.col(f"_i.i{c}").alias(f"i{c}") for c in "xyz"], mirrored.alias("mirrored"))


def ghosts(points: DataFrame, reach: float, length: tuple[float, float, float], periodic: Axes) -> DataFrame:
    """`points` (x, y, z, ...) with `ghost`, and their images within `reach` outside the box along periodic axes, axis by axis."""
    out = points.withColumn("ghost", F.lit(False))
    for c, size, p in zip("xyz", length, periodic, strict=True):
        if p:
            low = out.where(F.col(c) < F.lit(reach)).withColumn(c, F.col(c) + F.lit(size)).withColumn("ghost", F.lit(True))
            high = out.where(F.col(c) >= F.lit(size - reach)).withColumn(c, F.col(c) - F.lit(size)).withColumn("ghost", F.lit(True))
            out = out.unionByName(low).unionByName(high)
    return out


def inside(length: tuple[float, float, float], periodic: Axes) -> Column:
    """Whether (x, y, z) is in the box along the axes that are free; the others wrap."""
    out = F.lit(True)
    for c, size, p in zip("xyz", length, periodic, strict=True):
        if not p:
            out = out & F.col(c).between(0.0, size)
    return out


def owns(points: DataFrame, images: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """`points` (id, grain, x, y, z, absolute and not wrapped) that their grain's own image owns: no image of `images` is nearer by
    more than a tolerance. Images of a cell number some thousand at most and travel as one row."""
    rows = images.agg(F.collect_list(F.struct("grain", "sx", "sy", "sz", ((F.col("ix") == 0) & (F.col("iy") == 0) & (F.col("iz") == 0)).alias("home"))).alias("_s"))
    d = lambda s: (F.col("x") - s.sx) * (F.col("x") - s.sx) + (F.col("y") - s.sy) * (F.col("y") - s.sy) + (F.col("z") - s.sz) * (F.col("z") - s.sz)
    both = points.crossJoin(F.broadcast(rows))
    least = F.array_min(F.transform("_s", d))
    own = F.array_min(F.transform(F.filter("_s", lambda s: s.home & (s.grain == F.col("grain"))), d))
    return both.where(own <= least + F.lit(tolerance)).drop("_s")


def distances(seeds: DataFrame, box: float) -> DataFrame:
    """(grain_i, grain_j, d): shortest distance over images of every pair of cells."""
    a = seeds.select(F.col("grain").alias("grain_i"), *[F.col(f"s{c}").alias(f"a{c}") for c in "xyz"])
    b = seeds.select(F.col("grain").alias("grain_j"), *[F.col(f"s{c}").alias(f"b{c}") for c in "xyz"])
    d2 = G.square_distance(*[G.min_image(F.col(f"a{c}") - F.col(f"b{c}"), box) for c in "xyz"])
    return a.join(b, F.expr("grain_i < grain_j")).select("grain_i", "grain_j", F.sqrt(d2).alias("d"))


def conflicts(seeds: DataFrame, radii: DataFrame, edges: DataFrame, slack: float, box: float) -> DataFrame:
    """(grain_i, grain_j) of cells that may meet: no farther apart than their radii and a slack, or neighbours already."""
    r = lambda k: radii.select(F.col("grain").alias(f"grain_{k}"), F.col("radius").alias(f"r{k}"))
    near = distances(seeds, box).join(r("i"), "grain_i").join(r("j"), "grain_j").where(F.col("d") <= F.col("ri") + F.col("rj") + F.lit(slack))
    return near.select("grain_i", "grain_j").union(edges.select("grain_i", "grain_j")).distinct()


def colored(edges: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    """Greedy colours, nodes of most neighbours first (of equal ones the lower): no edge joins two of one colour."""
    near: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    color: dict[int, int] = {}
    for n in sorted(nodes, key=lambda k: (-len(near[k]), k)):
        used = {color[m] for m in near[n] if m in color}
        color[n] = next(c for c in itertools.count() if c not in used)
    return color


def single_margin(fraction: list[Column], heights: tuple[float, float, float], periodic: Axes) -> Column:
    """Distance to the nearest face of a single crystal's box along its free axes; null if all are periodic."""
    found = [F.least(f, 1 - f) * F.lit(h) for f, h, p in zip(fraction, heights, periodic, strict=True) if not p]
    return F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("double")


def window(fraction: list[Column], tolerance: float = 1e-9) -> Column:
    """Whether fractions lie in the half-open box, with a tolerance below both ends."""
    out = F.lit(True)
    for f in fraction:
        out = out & (f >= F.lit(-tolerance)) & (f < F.lit(1 - tolerance))
    return out


def misfit(box: np.ndarray, cell: np.ndarray) -> float:
    """Largest distance of the box's vectors (columns) from whole sums of the cell's vectors."""
    n = np.linalg.solve(cell, box)
    return float(np.abs(cell @ (n - np.rint(n))).max())


def circular_centroids(voxels: DataFrame, box: tuple[float, float, float], periodic: Axes) -> DataFrame:
    """(grain, cx, cy, cz) of voxels (x, y, z): along periodic axes the mean direction, the plain mean where it has none."""
    def one(c: str, size: float, p: bool) -> Column:
        turn = F.col(c) * F.lit(2 * math.pi / size)
        s, k = F.avg(F.sin(turn)), F.avg(F.cos(turn))
        round_ = F.pmod(F.atan2(s, k) * F.lit(size / (2 * math.pi)), F.lit(size))
        return (F.when(F.sqrt(s * s + k * k) > F.lit(1e-9), round_).otherwise(F.avg(c)) if p else F.avg(c)).alias(f"c{c}")

    return voxels.groupBy("grain").agg(*[one(c, v, p) for c, v, p in zip("xyz", box, periodic, strict=True)])


def farthest(voxels: DataFrame, centers: DataFrame, box: float) -> DataFrame:
    """(grain, reach): largest distance of a grain's voxels from its centroid."""
    both = voxels.join(centers, "grain")
    d2 = G.square_distance(*[G.min_image(F.col(c) - F.col(f"c{c}"), box) for c in "xyz"])
    return both.groupBy("grain").agg(F.sqrt(F.max(d2)).alias("reach"))


def hard_seeds(n: int, length: tuple[float, float, float], apart: float, seed: int, periodic: Axes = (True, True, True), tries: int = 10_000) -> np.ndarray:
    """n points at least `apart` from each other, drawn one by one; neighbours are looked up in a hash of cells of that edge."""
    rng = np.random.default_rng(seed)
    count = [max(1, int(v // apart)) if apart > 0 else 1 for v in length]
    held: dict[tuple[int, ...], list[int]] = {}
    out: list[np.ndarray] = []
    for _ in range(tries * max(1, n)):
        if len(out) == n:
            return np.array(out)
        p = rng.random(3) * length
        at = tuple(min(int(p[k] / length[k] * count[k]), count[k] - 1) for k in range(3))
        cells = {tuple((at[k] + d[k]) % count[k] if periodic[k] else at[k] + d[k] for k in range(3)) for d in itertools.product((-1, 0, 1), repeat=3)}
        ok = True
        for i in (i for c in cells for i in held.get(c, [])):
            d = p - out[i]
            d = [v - round(v / s) * s if per else v for v, s, per in zip(d, length, periodic, strict=True)]
            if sum(v * v for v in d) < apart * apart:
                ok = False
                break
        if ok:
            held.setdefault(at, []).append(len(out))
            out.append(p)
    if len(out) == n:
        return np.array(out)
    raise RuntimeError(f"only {len(out)} of {n} points fit at distance {apart}")


def wigner_seitz(volume: float, n: int) -> float:
    """Radius of the ball that is each point's share of a volume."""
    return (3 * volume / (4 * math.pi * n)) ** (1 / 3)


def target_volumes(n: int, total: float, kind: str, spread: float = 0.35, seed: int = 1, given: list[float] | None = None) -> np.ndarray:
    """Volumes that sum to `total`: equal, in given proportions, or of log-normal diameters."""
    if kind == "list":
        v = np.array(given, dtype=float)
        if len(v) != n or (v <= 0).any():
            raise ValueError("one positive volume for each cell")
    else:
        v = np.ones(n) if kind == "equal" else np.exp(3 * spread * np.random.default_rng(seed).standard_normal(n))
    return v * total / v.sum()


def occupant(u: Column, shares: dict[str, float]) -> Column:
    """Species of a site from a uniform number, by the running sums of the occupancies in order of name; null for a vacancy."""
    out, upto = None, 0.0
    for name in sorted(shares):
        upto += shares[name]
        out = F.when(u < F.lit(upto), name) if out is None else out.when(u < F.lit(upto), name)
    return out


def random_field(n: int, length: float, seed: int, spectrum: str = "gaussian", wave: float = 1.0, hurst: float = 0.5, low: float | None = None, high: float | None = None) -> np.ndarray:
    """An n x n x n periodic random field of mean 0 and deviation 1: white noise filtered by a Gaussian of correlation length
    `wave`, or by a power law k^-(2 hurst + 3) between the wavelengths low and high. At most 384 nodes an axis, on the driver."""
    if n > 384:
        raise ValueError("at most 384 nodes along an axis")
    k = 2 * np.pi * np.fft.fftfreq(n, d=length / n)
    size = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2)
    if spectrum == "gaussian":
        power = np.exp(-((size * wave) ** 2) / 4)
    else:
        with np.errstate(divide="ignore"):
            power = np.where(size > 0, size ** -(2 * hurst + 3), 0.0)
        power[(size < 2 * np.pi / (high or length)) | (size > 2 * np.pi / (low or 2 * length / n))] = 0
    power[0, 0, 0] = 0
    field = np.fft.ifftn(np.fft.fftn(np.random.default_rng(seed).standard_normal((n, n, n))) * np.sqrt(power)).real
    return (field - field.mean()) / field.std()


def hurst(field: np.ndarray, length: float, shells: int = 16) -> float | None:
    """Exponent from the slope of log mean power over log mean wave number in geometric shells; None with fewer than 3."""
    n = len(field)
    power = np.abs(np.fft.fftn(field)).ravel() ** 2
    k = 2 * np.pi * np.fft.fftfreq(n, d=length / n)
    size = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2).ravel()
    edges = np.geomspace(2 * np.pi / length * 0.999, np.pi * n / length, shells + 1)
    at = np.digitize(size, edges) - 1
    found = [(size[at == s].mean(), power[at == s].mean()) for s in range(shells) if (at == s).any() and power[at == s].mean() > 1e-12 * power.max()]
    if len(found) < 3:
        return None
    x, y = np.log(np.array(found)).T
    return float(-(np.polyfit(x, y, 1)[0] + 3) / 2)
