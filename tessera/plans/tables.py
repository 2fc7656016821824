"""Stand-in tables for points, cells and orientations, derived from the driver's tables by exact integer hashing."""

from __future__ import annotations

import itertools
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = 20.0


def shared(spark: SparkSession) -> None:
    """The folder for checkpoints that the cluster names; a temporary one only where a local session names none."""
    if spark.sparkContext.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(path or tempfile.mkdtemp())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _xyz(h: Column) -> list[Column]:
    spread = ((7919, 99991, 4999.55), (104729, 99989, 4999.45), (1299709, 99971, 4998.55))
    return [((h * p % q) / F.lit(r)).alias(c) for c, (p, q, r) in zip("xyz", spread, strict=True)]


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("id")
    return read(spark, sf_dir, "lineitem").select(h).distinct().select("id", *_xyz(F.col("id")))


def few_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id")).distinct().select("id", *_xyz(F.col("id")))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    return read(spark, sf_dir, "nation").select(
        k.cast("int").alias("grain"),
        ((k * 37 + 11) % 101 / F.lit(5.05)).alias("sx"),
        ((k * 59 + 23) % 103 / F.lit(5.15)).alias("sy"),
        ((k * 83 + 41) % 107 / F.lit(5.35)).alias("sz"),
        ((k * 29 + 7) % 31 / F.lit(31.0)).alias("w"),
        (1 + (k * 13) % 17 / F.lit(17.0)).alias("m11"),
        (1 + (k * 19) % 23 / F.lit(23.0)).alias("m22"),
        (1 + (k * 7) % 29 / F.lit(29.0)).alias("m33"),
        F.col("n_regionkey").cast("int").alias("phase"),
    )


def quats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    raw = read(spark, sf_dir, "nation").select(
        k.cast("int").alias("grain"), *[((k * p + r) % q - F.lit(s)).cast("double").alias(c) for c, p, r, q, s in QUAT]
    )
    norm = F.sqrt(F.col("w") * F.col("w") + F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return raw.select("grain", F.struct(*[(F.col(c) / norm).alias(c) for c in "wxyz"]).alias("q"))


QUAT = (("w", 31, 17, 97, 40.5), ("x", 53, 5, 89, 44.5), ("y", 71, 29, 83, 41.5), ("z", 43, 61, 79, 39.5))


def cubic_group() -> list[tuple[float, float, float, float]]:
    """The 24 rotations of the cube: unit vectors, half sums of two, and all of halves, up to sign."""
    out = []
    for v in itertools.product((-1, 0, 1), repeat=4):
        if (n := sum(map(abs, v))) in (1, 2, 4) and next(c for c in v if c) > 0:
            out.append(tuple(c / n**0.5 for c in v))
    return sorted(out, reverse=True)


def cubic_symmetry() -> Column:
    return F.array(*[F.struct(*[F.lit(float(c)).alias(n) for c, n in zip(q, "wxyz", strict=True)]) for q in cubic_group()])
