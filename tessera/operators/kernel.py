"""Kernels between orientations: the symmetrised Gram table, discrepancies of weights, and their null distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


def degree(halfwidth: float) -> int:
    """Whole degree of the de la Vallee Poussin kernel nearest to a half width in degrees (0 to 180, open)."""
    if not 0 < halfwidth < 180:
        raise ValueError("the half width must lie between 0 and 180 degrees")
    return max(1, round(-math.log(2) / (2 * math.log(math.cos(math.radians(halfwidth) / 2)))))


def norm(k: int) -> float:
    """Factor that makes the kernel integrate to 1: pi / (2 B(3/2, k + 1/2))."""
    return math.pi / 2 * math.exp(math.lgamma(k + 2) - math.lgamma(1.5) - math.lgamma(k + 0.5))


def gram(quats: DataFrame, symmetry: Column, halfwidth: float) -> DataFrame:
    """(grain_i, grain_j, k) over all pairs of a table of orientations (grains, a few thousand at most, not points)."""
    k = degree(halfwidth)
    p, q = quats.select(F.col("grain").alias("grain_i"), F.col("q").alias("p")), quats.select(F.col("grain").alias("grain_j"), "q")
    one = lambda m: F.aggregate(symmetry, F.lit(0.0), lambda a, s: a + F.pow(F.abs(m.w * s.w - m.x * s.x - m.y * s.y - m.z * s.z), F.lit(2.0 * k)))
    total = G.let(G.quat_mul(G.quat_conj(F.col("p")), F.col("q")), one)
    return p.crossJoin(q).select("grain_i", "grain_j", (total / F.size(symmetry) * F.lit(norm(k))).alias("k"))


def discrepancy(d: DataFrame, gram: DataFrame) -> DataFrame:
    """sqrt(d' K d) of differences of weights (grain, d)."""
    i, j = d.select(F.col("grain").alias("grain_i"), F.col("d").alias("di")), d.select(F.col("grain").alias("grain_j"), F.col("d").alias("dj"))
    both = gram.join(i, "grain_i").join(j, "grain_j")
    return both.agg(F.sqrt(F.greatest(F.sum(F.col("di") * F.col("k") * F.col("dj")), F.lit(0.0))).alias("mmd"))


def null_discrepancy(weights: DataFrame, gram: DataFrame, draws: int) -> DataFrame:
    """(low, median, high): 2.5, 50 and 97.5 per cent of the discrepancy from equal weights over random deals of `weights` (grain, v)."""
    total = F.broadcast(weights.agg(F.sum("v").alias("t"), F.count("*").alias("n")))
    base = weights.crossJoin(total).select("grain", (F.col("v") / F.col("t") - 1 / F.col("n")).alias("d"))
    draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    slot = F.row_number().over(Window.partitionBy("draw").orderBy("grain")).alias("slot")
    hand = F.row_number().over(Window.partitionBy("draw").orderBy(F.xxhash64("draw", "grain"), "grain")).alias("slot")
    many = base.select("grain", "d", draw)
    dealt = many.select("draw", "grain", slot).join(many.select("draw", "d", hand), ["draw", "slot"])
    i, j = dealt.select("draw", F.col("grain").alias("grain_i"), F.col("d").alias("di")), dealt.select("draw", F.col("grain").alias("grain_j"), F.col("d").alias("dj"))
    both = i.join(gram, "grain_i").join(j, ["draw", "grain_j"])
    found = both.groupBy("draw").agg(F.sqrt(F.greatest(F.sum(F.col("di") * F.col("k") * F.col("dj")), F.lit(0.0))).alias("m"))
    return found.agg(*[F.round(F.percentile("m", F.lit(p)), 6).alias(n) for n, p in (("low", 0.025), ("median", 0.5), ("high", 0.975))])
