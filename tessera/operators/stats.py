"""Distributions over cells and boundaries: histograms, distances, weighted moments, size fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clipped_bin(x: Column, low: float, width: float, bins: int) -> Column:
    """Bin of x; what lies outside goes to the end bins; null where x is no number."""
    return F.when(~F.isnan(x), F.least(F.greatest(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(0)), F.lit(bins - 1))).cast("int")


def closed_bin(x: Column, low: float, width: float, bins: int) -> Column:
    """Bin of x with the last bin closed on the right; null outside."""
    b = F.floor((x - F.lit(low)) / F.lit(width))
    return F.when((x >= low) & (x <= low + width * bins), F.least(b, F.lit(bins - 1))).cast("int")


def masses(df: DataFrame, bin_: Column, weight: Column, bins: int) -> DataFrame:
    """(bin, mass), masses summing to 1, empty bins included; null masses where the total weight is 0 or there are no rows."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    got = df.where(bin_.isNotNull()).groupBy(bin_.alias("bin")).agg(F.sum(weight).alias("w"))
    total = got.agg(F.sum("w").alias("t"))
    return spine.join(got, "bin", "left").crossJoin(F.broadcast(total)).select("bin", F.try_divide(F.coalesce("w", F.lit(0.0)), F.col("t")).alias("mass"))


def chi_square_distance(p: DataFrame, q: DataFrame) -> DataFrame:
    """Sum of (p - q)^2 / (p + q) where p + q > 0, over (bin, mass) tables."""
    both = p.join(q.withColumnRenamed("mass", "other"), "bin", "full").fillna(0.0, ["mass", "other"]).where("mass + other > 0")
    return both.agg(F.sum(F.pow(F.col("mass") - F.col("other"), F.lit(2.0)) / (F.col("mass") + F.col("other"))).alias("chi2"))


def total_variation(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    both = p.join(q.withColumnRenamed("mass", "other"), key, "full").fillna(0.0, ["mass", "other"])
    return both.agg((F.sum(F.abs(F.col("mass") - F.col("other"))) / 2).alias("tv"))


def size_summary(x: Column, lognormal: bool = True) -> list[Column]:
    out = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("low"), F.max(x).alias("high")]
    return out + ([F.avg(F.log(x)).alias("mu"), F.stddev_samp(F.log(x)).alias("sigma")] if lognormal else [])


def weighted_mean(v: Column, w: Column) -> Column:
    """Null where the weights sum to 0."""
    return F.try_divide(F.sum(v * w), F.sum(w))


def effective_size(w: Column) -> Column:
    """Kish's effective sample size; null where all weights are 0."""
    return F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(w * w))


def normal_cdf(z: Column) -> Column:
    """Normal distribution by the rational approximation of the error function with five terms (error below 2e-7)."""
    u = z / F.sqrt(F.lit(2.0))
    t = 1 / (1 + F.lit(0.3275911) * F.abs(u))
    # Coefficients of the approximation.
    terms = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    poly = F.lit(terms[4])
    for c in terms[3::-1]:
        poly = F.lit(c) + t * poly
    return 0.5 * (1 + F.signum(u) * (1 - t * poly * F.exp(-u * u)))


def lognormal_distance(logs: DataFrame) -> DataFrame:
    """(mu, sigma, ks) of logarithms x: fit and Kolmogorov-Smirnov distance; ks is null where sigma is not above 1e-9.

    Ranks come from counts of distinct values, so only those, not rows, pass one sorted window; x is per cell.
    """
    from pyspark.sql import Window

    fit = logs.agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sigma"), F.count("*").alias("n"))
    values = logs.groupBy("x").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = values.withColumn("top", upto).crossJoin(F.broadcast(fit))
    cdf = F.when(F.col("sigma") > F.lit(1e-9), normal_cdf((F.col("x") - F.col("mu")) / F.col("sigma")))
    gap = F.greatest(F.col("top") / F.col("n") - cdf, cdf - (F.col("top") - F.col("m")) / F.col("n"))
    return ranked.groupBy("mu", "sigma").agg(F.max(gap).alias("ks"))
