"""Shared pieces: table access, checkpointed tables, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on the rounds of the component search; it halves path lengths, so 64 rounds never bind.
MAX_ROUNDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only where none is set and the session is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        current = spark.sparkContext.getCheckpointDir()
    return str(current).rstrip("/")


RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs in here go when it ends, as its result is written or small."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


class Written:
    """A table written once to the shared folder; reading it again never recomputes its inputs."""

    def __init__(self, df: DataFrame, tag: str) -> None:
        self.spark = df.sparkSession
        self.path = f"{checkpoint_dir(self.spark)}/{tag}-{uuid.uuid4().hex}"
        with released(self.spark):
            df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files, once what was read from them is itself written."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_arrow(
    df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str | object, setup: Callable[[], object] | None = None
) -> DataFrame:
    """mapInArrow with `fn(batch[, state])` returning column lists; `setup()` runs once per task."""
    out_schema = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup() if setup else None
        for batch in batches:
            cols = fn(batch, state) if setup else fn(batch)
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, out_schema, strict=True)],
                schema=out_schema,
            )

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str | object) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (u, v longs), component = smallest node reachable.

    Alternating large-star and small-star rounds: each is a partial-aggregated minimum and a join on the
    node, so no group is ever gathered; each round is a written table. Null ends are ignored.
    """
    both = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null and u <> v")
    now = Written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(MAX_ROUNDS):
        e = now.df
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u points at u's minimum.
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours point at the smallest of them.
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(mins, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        after = Written(small, "cc")
        now.drop()
        now = after
        # Done when every edge leads to a root: no node has two edges, or is at both ends of edges.
        e = now.df
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(e.select("v", F.lit(0), F.lit(1)))
        open_ = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out > 0 and in > 0)")
        with released(e.sparkSession):
            settled = open_.isEmpty()
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    # Star graphs remain: each node points at its component's smallest node.
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
