"""Writers: atom files, reports as CSV, JSON, manifests with digests and their verification.

Text files are folders of part files in order, as Spark writes them: rows are range-partitioned, never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructType


def numbered(atoms: DataFrame) -> DataFrame:
    """`atoms` with `id`, 1 to n by (grain, ord): ranks within a grain plus the counts of the grains before."""
    per = atoms.groupBy("grain").agg(F.count("*").alias("n"))
    before = per.select("grain", (F.coalesce(F.sum("n").over(Window.orderBy("grain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    rank = F.row_number().over(Window.partitionBy("grain").orderBy("ord"))
    return atoms.withColumn("rank", rank).join(before, "grain").withColumn("id", F.col("before") + F.col("rank")).drop("before", "rank")


def types(atoms: DataFrame) -> DataFrame:
    """(species, type): 1 to n in order of name."""
    return atoms.select("species").distinct().select("species", F.dense_rank().over(Window.orderBy("species")).cast("int").alias("type"))


def write_atoms(atoms: DataFrame, path: str, box: tuple[float, float, float], masses: dict[str, float], molecular: bool = True, tilt: tuple[float, float, float] | None = None) -> None:
    """Header lines in path/header, atom rows (id [grain + 1] type x y z) in path/atoms."""
    spark, kinds = atoms.sparkSession, types(atoms)
    if tilt and any(abs(t) > box[k] / 2 + 1e-9 for t, k in zip(tilt, (0, 0, 1), strict=True)):
        raise ValueError("tilts must be at most half of the length")
    rows = numbered(atoms).join(F.broadcast(kinds), "species")
    parts = ["id", *([F.col("grain") + 1] if molecular else []), "type", "x", "y", "z"]
    line = F.concat_ws(" ", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    # Files are in order of id: ranges of it are sorted within their tasks.
    rows.select("id", line.alias("value")).repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode("error").text(f"{path}/atoms")
    found = {r.species: r.type for r in kinds.collect()}  # species of the periodic table at most
    if gone := sorted(set(found) - set(masses)):
        raise ValueError(f"no mass of {gone}")
    head = [f"{rows.count()} atoms", f"{len(found)} atom types"] + [f"0.0 {float(b)!r} {c}lo {c}hi" for b, c in zip(box, "xyz", strict=True)]
    head += [" ".join(repr(float(t)) for t in tilt) + " xy xz yz"] if tilt else []
    head += ["", "Masses", ""] + [f"{t} {float(masses[s])!r}" for s, t in found.items()] + ["", f"Atoms  # {'molecular' if molecular else 'atomic'}"]
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("error").text(f"{path}/header")


def write_xyz(atoms: DataFrame, path: str, box: tuple[float, float, float]) -> None:
    head = f'Lattice="{box[0]!r} 0.0 0.0 0.0 {box[1]!r} 0.0 0.0 0.0 {box[2]!r}" Properties=species:S:1:pos:R:3:grain:I:1 pbc="T T T"'
    rows = atoms.select("grain", "ord", F.concat_ws(" ", "species", *[F.col(c).cast("string") for c in ("x", "y", "z", "grain")]).alias("value"))
    rows.repartitionByRange("grain", "ord").sortWithinPartitions("grain", "ord").select("value").write.mode("error").text(f"{path}/atoms")
    atoms.sparkSession.createDataFrame([(str(atoms.count()),), (head,)], "value string").coalesce(1).write.mode("error").text(f"{path}/header")


def write_report(report: DataFrame, path: str, keys: list[str]) -> None:
    """CSV with a header, in order of keys (grains and interfaces, not points); not-a-number is written as nan, null as nothing."""
    shown = [F.when(F.isnan(c.name), F.lit("nan")).otherwise(F.col(c.name).cast("string")).alias(c.name) if isinstance(c.dataType, (DoubleType, FloatType)) else F.col(c.name) for c in report.schema]
    report.orderBy(*keys).select(*shown).coalesce(1).write.mode("error").csv(path, header=True)


def strict(c: Column) -> Column:
    """Null for numbers that JSON cannot hold."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def json_rows(df: DataFrame) -> DataFrame:
    """(value): one strict JSON object per row."""
    cols = [strict(F.col(c.name)).alias(c.name) if isinstance(c.dataType, (DoubleType, FloatType)) else F.col(c.name) for c in df.schema]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def flatten(df: DataFrame, section: str) -> DataFrame:
    """(section, key, value) of one row of nested columns: keys joined by dots, array items as key[i] (arrays of plain items)."""
    plain, lists = [], []

    def walk(kind: StructType, prefix: str) -> None:
        for f in kind:
            name = f"{prefix}{f.name}"
            if isinstance(f.dataType, StructType):
                walk(f.dataType, f"{name}.")
            else:
                (lists if isinstance(f.dataType, ArrayType) else plain).append(name)

    walk(df.schema, "")
    cell = lambda key, c: F.struct(key.alias("key"), c.cast("string").alias("value"))
    groups = [F.array(*[cell(F.lit(n), F.col(n)) for n in plain])] if plain else []
    for n in lists:
        groups.append(_items(n, cell))
    return df.select(F.explode(F.concat(*groups)).alias("e")).select(F.lit(section).alias("section"), "e.key", "e.value")


def _items(name: str, cell) -> Column:  # noqa: ANN001
    def one(v: Column, k: Column) -> Column:
        return cell(F.concat(F.lit(f"{name}["), k.cast("string"), F.lit("]")), v)

    return F.transform(F.col(name), one)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, size, path) of all data files under a folder, paths relative to it. Files are read in parts of 16 MB by the
    task that has them, so their size does not matter; the folder is one that driver and executors share."""
    import hashlib
    import os
    from collections.abc import Iterator

    import pandas as pd

    root = folder.removeprefix("file://").rstrip("/")
    names = sorted(os.path.relpath(os.path.join(at, f), root) for at, _, files in os.walk(root) for f in files if not f.startswith((".", "_")))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["path"]:
                digest, size = hashlib.sha256(), 0
                with open(os.path.join(root, name), "rb") as f:
                    while part := f.read(1 << 24):
                        digest.update(part)
                        size += len(part)
                rows.append((digest.hexdigest(), size, name))
            yield pd.DataFrame(rows, columns=["sha256", "size", "path"])

    paths = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, min(len(names), 200)))
    return paths.mapInPandas(hashed, "sha256 string, size long, path string")


def verify(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path, status): OK, FAIL (digest or size differs), MISSING (listed only) or EXTRA (found only)."""
    a, b = listed.select("path", F.struct("sha256", "size").alias("a")), found.select("path", F.struct("sha256", "size").alias("b"))
    status = F.when(F.col("b").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").when(F.col("a") == F.col("b"), "OK").otherwise("FAIL")
    return a.join(b, "path", "full").select("path", status.alias("status"))
