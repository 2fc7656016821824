"""Label grids in long form (i, j, k, grain): volumes, adjacency, interface areas, boundary voxels, triple lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def centers(spark: SparkSession, n: int, box: float) -> DataFrame:
    """(i, j, k, x, y, z) of the centres of an n x n x n grid."""
    h = box / n
    ids = spark.range(n**3).select(
        F.expr(f"cast(id div {n * n} as int)").alias("i"), F.expr(f"cast(id div {n} % {n} as int)").alias("j"), F.expr(f"cast(id % {n} as int)").alias("k")
    )
    return ids.select("i", "j", "k", *[((F.col(a) + 0.5) * F.lit(h)).alias(c) for a, c in zip("ijk", "xyz", strict=True)])


def volumes(voxels: DataFrame, cell: float, grains: DataFrame) -> DataFrame:
    """Volume of each of `grains`, 0 for those without a voxel."""
    count = voxels.groupBy("grain").agg(F.count("*").alias("n"))
    return grains.select("grain").join(count, "grain", "left").select("grain", (F.coalesce("n", F.lit(0)) * F.lit(cell)).alias("volume"))


def faces(voxels: DataFrame, n: int) -> DataFrame:
    """(axis, i, j, k, grain_i, grain_j) of label changes between a voxel and the next one along each axis, periodic."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), *[F.pmod(F.col(c) + (1 if c == a else 0), F.lit(n)).alias(f"n{c}") for c in "ijk"]) for a in "ijk"]))
    own = voxels.withColumn("s", step).select("i", "j", "k", "grain", "s.*")
    other = voxels.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("k").alias("nk"), F.col("grain").alias("other"))
    both = own.join(other, ["ni", "nj", "nk"]).where("grain <> other")
    sign = F.when(F.col("grain") < F.col("other"), 1).otherwise(-1).alias("sign")
    return both.select("axis", "i", "j", "k", F.least("grain", "other").alias("grain_i"), F.greatest("grain", "other").alias("grain_j"), sign)


def normals(voxels: DataFrame, n: int, face: float) -> DataFrame:
    """(grain_i, grain_j, area, nx, ny, nz, spread) per interface: mean normal from grain_i to grain_j, and the root of the
    mean square angle of faces to it in degrees. Without a direction (mean shorter than 1e-6) the normal is null and the spread 90."""
    counts = [F.count_if((F.col("axis") == a) & (F.col("sign") == s)).alias(f"{a}{t}") for a in "ijk" for s, t in ((1, "p"), (-1, "m"))]
    c = faces(voxels, n).groupBy("grain_i", "grain_j").agg(F.count("*").alias("n"), *counts)
    net = [(F.col(f"{a}p") - F.col(f"{a}m")).cast("double") for a in "ijk"]
    size = F.sqrt(net[0] * net[0] + net[1] * net[1] + net[2] * net[2])
    c = c.withColumn("size", F.when(size / F.col("n") >= F.lit(1e-6), size))
    for a, name in zip("ijk", ("nx", "ny", "nz"), strict=True):
        c = c.withColumn(name, (F.col(f"{a}p") - F.col(f"{a}m")) / F.col("size"))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x))
    miss = [F.col(f"{a}{t}") * F.pow(F.degrees(F.acos(clip(s * F.col(m)))), F.lit(2.0)) for a, m in zip("ijk", ("nx", "ny", "nz"), strict=True) for t, s in (("p", 1), ("m", -1))]
    spread = F.sqrt(sum(miss[1:], miss[0]) / F.col("n"))
    return c.select("grain_i", "grain_j", (F.col("n") * F.lit(face)).alias("area"), "nx", "ny", "nz", F.coalesce(spread, F.lit(90.0)).alias("spread"))


def surface(voxels: DataFrame, n: int, face: float) -> DataFrame:
    """Surface of each grain: both sides of every label change."""
    return faces(voxels, n).select(F.explode(F.array("grain_i", "grain_j")).alias("grain")).groupBy("grain").agg((F.count("*") * F.lit(face)).alias("surface"))


def areas(voxels: DataFrame, n: int, face: float) -> DataFrame:
    return faces(voxels, n).groupBy("grain_i", "grain_j").agg((F.count("*") * F.lit(face)).alias("area"))


def boundary(voxels: DataFrame, n: int) -> DataFrame:
    """Voxels next to another label along an axis, in either direction."""
    along = faces(voxels, n)
    ends = along.select(F.explode(F.array(F.struct("i", "j", "k"), F.struct(*[F.when(F.col("axis") == c, F.pmod(F.col(c) + 1, F.lit(n))).otherwise(F.col(c)).alias(c) for c in "ijk"]))).alias("v"))
    return ends.select("v.*").distinct()


def triple_lines(voxels: DataFrame, n: int) -> DataFrame:
    """(axis, n_edges): grid edges along each axis round which three or more labels meet."""
    out = None
    for axis, (a, b) in {"i": "jk", "j": "ik", "k": "ij"}.items():
        corner = F.explode(F.array(*[F.struct(F.pmod(F.col(a) - da, F.lit(n)).alias(a), F.pmod(F.col(b) - db, F.lit(n)).alias(b)) for da in (0, 1) for db in (0, 1)]))
        around = voxels.select(axis, "grain", corner.alias("c")).groupBy(axis, F.col(f"c.{a}"), F.col(f"c.{b}")).agg(F.size(F.collect_set("grain")).alias("m"))
        one = around.where("m >= 3").agg(F.count("*").alias("n_edges")).select(F.lit(axis).alias("axis"), "n_edges")
        out = one if out is None else out.union(one)
    return out
