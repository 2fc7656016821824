"""Connected components of edge tables, and repair of label grids whose labels fall apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable. `nodes`: id; `edges`: a, b, in either direction or both.

    Each round hooks the root of every tree to the smallest root next to it and follows parents once more, so rounds grow
    with the logarithm of the longest path. State is checkpointed in the shared folder once a round.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    parent = nodes.select("id", F.col("id").alias("root"))
    for _ in range(rounds):
        label = parent.select(F.col("id").alias("b"), F.col("root").alias("other"))
        own = parent.select(F.col("id").alias("a"), F.col("root").alias("mine"))
        cross = both.join(label, "b").join(own, "a").where("other < mine")
        hook = cross.groupBy(F.col("mine").alias("root")).agg(F.min("other").alias("new"))
        onward = hook.select(F.col("root").alias("new"), F.col("new").alias("further"))
        moved = parent.join(hook.join(onward, "new", "left"), "root", "left")
        found = moved.select("id", F.coalesce("further", "new", "root").alias("root"), F.col("new").isNotNull().alias("moved")).checkpoint()
        if found.where("moved").isEmpty():
            return found.select("id", F.col("root").alias("component"))
        # A root is a node too: its own root is nearer still, which doubles the steps along a chain.
        up = found.select(F.col("id").alias("root"), F.col("root").alias("up"))
        parent = found.join(up, "root").select("id", F.col("up").alias("root"))
    raise RuntimeError("components did not settle")


def _around(voxels: DataFrame, n: int, label: str) -> DataFrame:
    """Each voxel as a neighbour of the six round it: (i, j, k) of the receiver and the sender's label."""
    steps = [(d if a == "i" else 0, d if a == "j" else 0, d if a == "k" else 0) for a in "ijk" for d in (-1, 1)]
    to = F.explode(F.array(*[F.struct(*[F.pmod(F.col(c) + s, F.lit(n)).alias(c) for c, s in zip("ijk", step, strict=True)]) for step in steps])).alias("to")
    return voxels.select(to, F.col(label).alias(f"near_{label}")).select("to.*", f"near_{label}")


def grid_components(voxels: DataFrame, n: int) -> DataFrame:
    """`voxels` (i, j, k, grain) with `component`, the smallest voxel number connected through faces within the label."""
    own = voxels.withColumn("id", (F.col("i") * n + F.col("j")) * n + F.col("k"))
    ahead = F.explode(F.array(*[F.struct(*[F.pmod(F.col(c) + (1 if c == axis else 0), F.lit(n)).alias(c) for c in "ijk"]) for axis in "ijk"])).alias("t")
    sent = own.select(F.col("id").alias("a"), "grain", ahead).select("a", "grain", "t.*")
    edges = sent.join(own.select("i", "j", "k", "grain", F.col("id").alias("b")), ["i", "j", "k", "grain"]).select("a", "b")
    return own.join(components(own.select("id"), edges), "id").select("i", "j", "k", "grain", "component")


def fragments(labelled: DataFrame) -> DataFrame:
    """`labelled` with `fragment`: not in the largest component of its label (of equal ones, the lowest number stays)."""
    sizes = labelled.groupBy("grain", "component").agg(F.count("*").alias("size"))
    first = F.row_number().over(Window.partitionBy("grain").orderBy(F.desc("size"), "component"))
    rank = sizes.withColumn("rank", first).select("grain", "component", (F.col("rank") > 1).alias("fragment"))
    return labelled.join(rank, ["grain", "component"])


def repair(voxels: DataFrame, n: int, passes: int = 25) -> DataFrame:
    """(i, j, k, grain) in which every label is connected: a fragment's voxels take the label most frequent among their
    neighbours outside fragments (ties: the lowest), all at once, until no fragment is left."""
    now = voxels.select("i", "j", "k", "grain").checkpoint()
    for _ in range(passes):
        marked = fragments(grid_components(now, n)).checkpoint()
        lost = marked.where("fragment").select("i", "j", "k", "grain")
        if lost.isEmpty():
            return now
        votes = _around(marked.where("not fragment"), n, "grain").join(lost.select("i", "j", "k"), ["i", "j", "k"], "left_semi")
        counted = votes.groupBy("i", "j", "k", "near_grain").agg(F.count("*").alias("c"))
        winner = counted.groupBy("i", "j", "k").agg(F.min(F.struct((-F.col("c")).alias("c"), "near_grain")).alias("best")).checkpoint()
        if winner.isEmpty():
            raise RuntimeError("fragments without a neighbour outside fragments")
        best = winner.select("i", "j", "k", F.col("best.near_grain").alias("voted"))
        now = now.join(best, ["i", "j", "k"], "left").select("i", "j", "k", F.coalesce("voted", "grain").alias("grain")).checkpoint()
    raise RuntimeError("fragments are left after all passes")
