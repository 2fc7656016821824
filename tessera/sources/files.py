"""Readers of atom files (data files of a molecular dynamics code, extended XYZ), label fields, and manifests."""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = "path string, i int, j int, k int, label long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_atom_rows(spark: SparkSession, path: str, molecular: bool = True) -> DataFrame:
    """(id, mol, type, x, y, z) of the rows of the atom section; `mol` is null in atomic files; image flags may follow.

    Sections are told by the line before them: a file's lines are numbered by their places, and each row belongs to the last
    heading before it, found from the few headings of the file.
    """
    lines = _lines(spark, path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    heads = lines.where(F.col("v").rlike(r"^[A-Z][A-Za-z]+(\s+[A-Za-z]+)*$")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "v"))).alias("heads"))
    rows = lines.where(F.col("v").rlike(r"^\d+\s")).join(F.broadcast(heads), "file")  # headings: a dozen a file
    last = F.element_at(F.filter("heads", lambda h: h.n < F.col("n")), -1)
    rows = rows.where(F.size(F.filter("heads", lambda h: h.n < F.col("n"))) > 0).where(last.v.startswith("Atoms"))
    f = F.split("v", r"\s+")
    at = 2 if molecular else 1
    rows = rows.where(F.size(f) >= at + 4)
    mol = f[1].cast("long") if molecular else F.lit(None).cast("long")
    return rows.select(f[0].cast("long").alias("id"), mol.alias("mol"), f[at].cast("int").alias("type"), *[f[at + 1 + n].cast("double").alias(c) for n, c in enumerate("xyz")])


def ends(rows: DataFrame, key: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The first and the last k rows in order of a key."""
    return rows.orderBy(key).limit(k), rows.orderBy(F.desc(key)).limit(k).orderBy(key)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(key, a, b, c): counts, bounds, tilts and masses of the header, one row per line."""
    v = F.trim(F.regexp_replace("value", "#.*$", ""))
    rows = _lines(spark, path).select(v.alias("v")).select("v", F.split("v", r"\s+").alias("f"))
    num = lambda n: F.get("f", F.lit(n)).try_cast("double")
    key = (
        F.when(F.col("v").rlike(r"^\d+ atoms$"), "atoms").when(F.col("v").rlike(r"^\d+ atom types$"), "types")
        .when(F.col("v").rlike(r"^\S+ \S+ [xyz]lo [xyz]hi$"), F.substring(F.get("f", F.lit(2)), 1, 1))
        .when(F.col("v").rlike(r"^\S+ \S+ \S+ xy xz yz$"), "tilt").when(F.col("v").rlike(r"^\d+ \d+(\.\d+)?$"), "mass")
    )
    return rows.select(key.alias("key"), num(0).alias("a"), num(1).alias("b"), num(2).alias("c")).where("key is not null")


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(species, x, y, z, grain) of extended XYZ rows."""
    f = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.col("value").rlike(r"^\s*[A-Za-z]+(\s+[-+0-9.eE]+){3}\s+\d+\s*$"))
    return rows.select(f[0].alias("species"), *[f[n + 1].cast("double").alias(c) for n, c in enumerate("xyz")], f[4].cast("int").alias("grain"))


def read_label_fields(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, j, k, label) of .npy arrays of three axes; one file is one row of bytes and is unpacked in its task."""

    def unpack(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                labels = np.load(io.BytesIO(content), allow_pickle=False)
                if labels.ndim != 3 or labels.dtype.kind not in "iu":
                    raise ValueError(f"{name}: not a whole-number array of three axes")
                for i, plane in enumerate(labels):
                    j, k = (a.ravel() for a in np.indices(plane.shape))
                    yield pd.DataFrame({"path": name, "i": np.int32(i), "j": j.astype("int32"), "k": k.astype("int32"), "label": plane.ravel().astype("int64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, LABELS)


def dense(labels: DataFrame) -> DataFrame:
    """`labels` with `grain`, 0 to n - 1 in order of label; only distinct labels are ranked."""
    from pyspark.sql import Window

    rank = labels.select("label").distinct().select("label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int").alias("grain"))
    return labels.join(rank, "label")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, size, path) of manifest lines. Comments and blank lines are left out; any other line that is no entry, a path
    that leaves the folder, or one listed twice raises an error."""
    p = r"^([0-9a-f]{64})\s+(\d+)\s+(.+)$"
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    ok = F.col("value").rlike(p)
    name = F.regexp_extract("value", p, 3)
    outside = name.startswith("/") | name.rlike(r"(^|/)\.\.(/|$)")
    value = F.when(ok & ~outside, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a manifest entry: "), "value")))
    found = rows.select(value.alias("value")).select(F.regexp_extract("value", p, 1).alias("sha256"), F.regexp_extract("value", p, 2).cast("long").alias("size"), name.alias("path"))
    if twice := [r.path for r in found.groupBy("path").count().where("count > 1").limit(3).collect()]:
        raise ValueError(f"listed twice: {', '.join(twice)}")
    return found


def versions_agree(stated: DataFrame) -> DataFrame:
    """(passed, versions) of a table (file, version): all files state one version."""
    return stated.agg((F.countDistinct("version") + F.count_if(F.col("version").isNull()) == 1).alias("passed"), F.array_sort(F.collect_set("version")).alias("versions"))
