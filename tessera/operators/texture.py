"""Orientation sets: exact classes, samplers, components, reference distributions, targets, and assignment by annealing."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from .crystal import haar
from .doping import uniform

#: Grains that annealing takes on the driver at most.
MAX_ANNEALED = 5000


def exact_classes(q: DataFrame, digits: int = 12) -> DataFrame:
    """(grain, class): equal orientations (q and -q being one) have one number, dense, in order of the canonical parts."""
    from pyspark.sql import Window

    parts = [F.round(F.col(f"c.{k}"), digits).alias(k) for k in "wxyz"]
    one = q.select("grain", G.quat_canonical(F.col("q")).alias("c")).select("grain", F.struct(*parts).alias("key"))
    rank = one.select("key").distinct().select("key", (F.dense_rank().over(Window.orderBy("key")) - 1).alias("class"))
    return one.join(rank, "key").select("grain", "class")


def dedupe(quats: np.ndarray, tolerance: float = 1e-6) -> np.ndarray:
    """Of quaternions that are equal up to sign within a tolerance, the first; for symmetry groups of some dozen rows."""
    kept: list[np.ndarray] = []
    for q in quats:
        if all(1 - abs(float(q @ k)) > tolerance for k in kept):
            kept.append(q)
    return np.array(kept)


def proper_quats(matrices: np.ndarray) -> np.ndarray:
    """Quaternions of the proper ones among nearly orthogonal 3 x 3 matrices, each once."""
    out = []
    for m in matrices:
        u, _, v = np.linalg.svd(m)
        r = u @ v
        if np.linalg.det(r) > 0:
            square = np.array([1 + r[0, 0] + r[1, 1] + r[2, 2], 1 + r[0, 0] - r[1, 1] - r[2, 2], 1 - r[0, 0] + r[1, 1] - r[2, 2], 1 - r[0, 0] - r[1, 1] + r[2, 2]])
            k = int(square.argmax())
            table = np.array([
                [square[0], r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]], [r[2, 1] - r[1, 2], square[1], r[0, 1] + r[1, 0], r[0, 2] + r[2, 0]],
                [r[0, 2] - r[2, 0], r[0, 1] + r[1, 0], square[2], r[1, 2] + r[2, 1]], [r[1, 0] - r[0, 1], r[0, 2] + r[2, 0], r[1, 2] + r[2, 1], square[3]]])
            q = table[k] / (2 * math.sqrt(square[k]))
            out.append(q if next(c for c in q if abs(c) > 1e-12) > 0 else -q)
    return dedupe(np.array(out))


def group(family: str) -> list[tuple[float, float, float, float]]:
    """Proper rotations of a crystal family's full symmetry: turns about z, and half turns about axes in the plane."""
    if family == "cubic":
        from ..plans.tables import cubic_group

        return cubic_group()
    fold, flips = {"hexagonal": (6, True), "trigonal": (3, True), "tetragonal": (4, True), "orthorhombic": (2, True), "monoclinic": (2, False), "triclinic": (1, False)}[family]
    turns = [(math.cos(math.pi * k / fold), 0.0, 0.0, math.sin(math.pi * k / fold)) for k in range(fold)]
    half = [(0.0, math.cos(math.pi * k / fold), math.sin(math.pi * k / fold), 0.0) for k in range(fold)] if flips else []
    return [tuple(c + 0.0 for c in q) for q in turns + half]


def group_column(family: str) -> Column:
    return F.array(*[F.struct(*[F.lit(float(c)).alias(n) for c, n in zip(q, "wxyz", strict=True)]) for q in group(family)])


def between(a: tuple[float, float, float], b: tuple[float, float, float]) -> tuple[float, float, float, float]:
    """The smallest rotation that takes direction a to direction b; for opposite ones half a turn about a normal."""
    p, s = (np.array(v, dtype=float) / np.linalg.norm(v) for v in (a, b))
    w = 1 + p @ s
    if w < 1e-12:
        n = np.cross(p, np.eye(3)[np.argmin(np.abs(p))])
        return (0.0, *(n / np.linalg.norm(n)))
    q = np.array([w, *np.cross(p, s)])
    return tuple(q / np.linalg.norm(q))


def of_plane_and_direction(hkl: tuple[int, int, int], uvw: tuple[int, int, int], cell: np.ndarray) -> np.ndarray:
    """Orientation with the plane's normal along z and the direction along x of the sample, as a quaternion."""
    n = np.linalg.inv(cell).T @ np.array(hkl, dtype=float)
    d = cell @ np.array(uvw, dtype=float)
    n, d = n / np.linalg.norm(n), d / np.linalg.norm(d)
    if abs(n @ d) > 1e-6:
        raise ValueError("the direction does not lie in the plane")
    r = np.array([d, np.cross(n, d), n])  # rows: sample axes in the crystal's frame
    return proper_quats(r[None])[0]


def corrected_angle(u: Column, spread: float, rounds: int = 8) -> Column:
    """Rotation angle in radians with density exp(-a^2 / 2s^2) sin^2(a / 2) on [0, pi], by rejection from a half-normal times its
    square's bound: draws come from hashes of `u`, so a row's angle depends on its key alone."""
    def draw(k: int) -> Column:
        def judged(a: Column) -> Column:
            keep = F.when(a > 1e-12, F.pow(F.sin(a / 2), F.lit(2.0)) / (a / 2 * F.lit(min(1.0, math.pi / 2)))).otherwise(0.0)
            return F.struct((a <= F.lit(math.pi)).alias("in"), (uniform(101 + 2 * k, u) < keep).alias("ok"), a.alias("a"))

        return G.let(F.sqrt(-2 * F.log(1 - uniform(100 + 2 * k, u))) * F.lit(spread), judged)  # of density a exp(-a^2 / 2s^2)

    tried = F.filter(F.array(*[draw(k) for k in range(rounds)]), lambda s: s["in"] & s.ok)
    return F.coalesce(F.get(tried, F.lit(0)).a, F.lit(spread))


def about(center: Column, key: Column, spread: float) -> Column:
    """Orientation near `center`, turned by a corrected Gaussian angle about a uniform axis."""
    z, turn = 2 * uniform(7, key) - 1, 2 * math.pi * uniform(8, key)
    r = F.sqrt(F.greatest(F.lit(0.0), 1 - z * z))

    def turned(half: Column) -> Column:
        return G.quat(F.cos(half), F.sin(half) * r * F.cos(turn), F.sin(half) * r * F.sin(turn), F.sin(half) * z)

    step = G.let(corrected_angle(key, spread) / 2, turned)
    return G.let(step, lambda t: G.let(G.quat_mul(t, center), G.quat_canonical))


def components(grains: DataFrame, parts: list[tuple[str, float, Column | None, float]], basis: str = "count") -> DataFrame:
    """`grains` (grain, volume) with `component` and `q`: components (name, share, centre or None for uniform, spread) get their
    shares of the number of grains, or of their volume: largest grains first to the component of largest deficit."""
    from .doping import partition

    weight = F.col("volume") if basis == "volume" else F.lit(1.0)
    dealt = partition(grains.select("grain", weight.cast("double").alias("volume")), [p[1] for p in parts]).withColumnRenamed("part", "component")
    q = None
    for k, (_, _, center, spread) in enumerate(parts):
        one = haar(*[uniform(k * 10 + n, F.col("grain")) for n in range(3)]) if center is None else about(center, F.col("grain"), spread)
        q = F.when(F.col("component") == k, one) if q is None else q.when(F.col("component") == k, one)
    return grains.join(dealt.select("grain", "component"), "grain").withColumn("q", q)


def class_masses(volumes: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, mass): shares of volume."""
    both = volumes.join(classes, "grain")
    total = F.broadcast(both.agg(F.sum("volume").alias("t")))
    return both.groupBy("class").agg(F.sum("volume").alias("v")).crossJoin(total).select("class", F.try_divide("v", "t").alias("mass"))


def permuted(weights: DataFrame, order: DataFrame) -> DataFrame:
    """(grain, weight) after grains took each other's weights: `order` (grain, source)."""
    return order.join(weights.withColumnRenamed("grain", "source"), "source").select("grain", "weight")


def hashed_quats(spark: SparkSession, n: int) -> DataFrame:
    """n quaternions spread over all orientations by a lattice of irrational steps, three numbers to an orientation."""
    # Powers of the inverse of the root of x^4 = x + 1.
    steps = (0.8191725133961645, 0.6710436067037893, 0.5497004779019703)
    u = [F.col("id") * F.lit(s) - F.floor(F.col("id") * F.lit(s)) for s in steps]
    return spark.range(n).select("id", haar(*u).alias("q"))


def reference_angles(spark: SparkSession, symmetry: Column, n: int) -> DataFrame:
    """Disorientation angles of uniformly distributed pairs: those of uniform orientations to the identity."""
    one = G.quat(*[F.lit(float(c)) for c in (1, 0, 0, 0)])
    return hashed_quats(spark, n).select("id", G.disorientation_angle(one, F.col("q"), symmetry).alias("angle"))


def rounded_up(angle: float, step: float = 0.5) -> float:
    """The largest angle of a distribution, up to a whole step."""
    return math.ceil(angle / step) * step


def enriched(reference: DataFrame, share: float, width: float, top: float, center: float = 60.0) -> DataFrame:
    """(bin, mass): 1 - share of a reference and `share` in the window of 15 / sqrt(3) degrees round `center`, by overlap with bins."""
    low, high = center - 15 / math.sqrt(3), min(center + 15 / math.sqrt(3), top)
    over = F.greatest(F.lit(0.0), F.least((F.col("bin") + 1) * F.lit(width), F.lit(high)) - F.greatest(F.col("bin") * F.lit(width), F.lit(low)))
    return reference.select("bin", (F.lit(1 - share) * F.col("mass") + F.lit(share / (high - low)) * over).alias("mass"))


def anneal(edges: DataFrame, quats: DataFrame, symmetry: np.ndarray, target: np.ndarray, width: float, steps: int = 2000, start: float = 0.01, cooling: float = 0.998, seed: int = 1) -> tuple[dict[int, int], float, float]:
    """Which grain's orientation each grain takes so that the area-weighted histogram of disorientations nears a target:
    swaps of two grains, each step accepted if it lessens chi-square, or by chance as the temperature falls. Sequential by
    nature, over at most `MAX_ANNEALED` grains on the driver; returns the order, and the distance before and after."""
    q = quats.select("grain", "q.*").orderBy("grain").toPandas()
    if len(q) > MAX_ANNEALED:
        raise ValueError(f"more than {MAX_ANNEALED} grains")
    e = edges.select("grain_i", "grain_j", "area").toPandas()
    at = {g: k for k, g in enumerate(q["grain"])}
    i, j, area = e["grain_i"].map(at).to_numpy(), e["grain_j"].map(at).to_numpy(), e["area"].to_numpy(dtype=float)
    x, bins, rng = q[list("wxyz")].to_numpy(dtype=float), len(target), np.random.default_rng(seed)
    touching = [np.flatnonzero((i == k) | (j == k)) for k in range(len(x))]

    def bin_of(k: np.ndarray, order: np.ndarray) -> np.ndarray:
        p, r = x[order[i[k]]], x[order[j[k]]]
        w = np.einsum("ij,ij->i", p, r)
        v = p[:, :1] * r[:, 1:] - r[:, :1] * p[:, 1:] - np.cross(p[:, 1:], r[:, 1:])
        best = np.abs(w[:, None] * symmetry[None, :, 0] - v @ symmetry[:, 1:].T).max(axis=1)
        return np.clip((np.degrees(2 * np.arccos(np.minimum(1, best))) / width).astype(int), 0, bins - 1)

    def far(h: np.ndarray) -> float:
        p, s = h / max(h.sum(), 1e-300), h / max(h.sum(), 1e-300) + target
        return float((((p - target) ** 2)[s > 0] / s[s > 0]).sum())

    order = np.arange(len(x))
    bins_now = bin_of(np.arange(len(i)), order)
    hist = np.bincount(bins_now, weights=area, minlength=bins)
    now = first = best = far(hist)
    best_order = order.copy()
    for k in range(steps):
        a, b = rng.integers(0, len(x), 2)
        u = rng.random()
        if a == b:
            continue
        some = np.union1d(touching[a], touching[b])
        order[[a, b]] = order[[b, a]]
        new = bin_of(some, order)
        trial = hist + np.bincount(new, weights=area[some], minlength=bins) - np.bincount(bins_now[some], weights=area[some], minlength=bins)
        value = far(trial)
        if value <= now or u < math.exp(-(value - now) / max(start * cooling**k, 1e-300)):
            hist, now = trial, value
            bins_now[some] = new
            if now < best:
                best, best_order = now, order.copy()
        else:
            order[[a, b]] = order[[b, a]]
    return {int(q["grain"][k]): int(q["grain"][best_order[k]]) for k in range(len(x))}, first, best


class Drift:
    """Half the sum of changes of class masses while grains swap their classes, each swap in constant time."""

    def __init__(self, weight: np.ndarray, of: np.ndarray) -> None:
        self.weight, self.of = np.asarray(weight, dtype=float) / np.sum(weight), np.asarray(of).copy()
        self.first = np.bincount(self.of, weights=self.weight)
        self.now = self.first.copy()
        self.value = 0.0

    def swap(self, a: int, b: int) -> float:
        p, r = self.of[a], self.of[b]
        if p != r:
            self.value -= (abs(self.now[p] - self.first[p]) + abs(self.now[r] - self.first[r])) / 2
            d = self.weight[b] - self.weight[a]
            self.now[p] += d
            self.now[r] -= d
            self.value += (abs(self.now[p] - self.first[p]) + abs(self.now[r] - self.first[r])) / 2
            self.of[a], self.of[b] = r, p
        return self.value
