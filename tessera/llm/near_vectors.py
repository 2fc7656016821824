"""Embedding near-dedup: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

Equal vectors of a label are one class first (a partial aggregation, so a hot vector is a row per task). Every
class is put into `probes` buckets of each of `tables` tables: `hashes` pseudo-rotations (three rounds of random
signs and a fast Walsh-Hadamard transform) each give the nearest cross-polytope vertex, and the probes take second
vertices where they are almost as near. Pairs of a bucket are verified by cosine in double precision; a pair
that meets in several buckets counts in the first of them only, so link counts need no list of pairs. Buckets over
`BLOCK` rows are split into chunks whose pairs are tasks of their own. A task emits one row per member: its
links there, and the smallest id it reaches there; components follow from those rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite values, and rows without a label,
link with nothing (their own component, kept; a null vec_id has no component and is not kept); vectors of different
dimension never link; rows that repeat id, label and vector are one vector, in links as in components, each with its
row in the result; ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, connected_components, map_arrow, table, to_arrow

COSINE = 0.98
TABLES, PROBES = 5, 3
#: Classes per bucket that the number of hashes in a row aims at.
PER_BUCKET = 8
BLOCK = 2048
#: Large buckets whose sizes are broadcast at most.
HOT_ROWS = 100_000
SEED = 20240607


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(x: np.ndarray, tables: int, hashes: int, probes: int) -> np.ndarray:
    """Bucket numbers (rows, tables, probes) of unit vectors, distinct within a table."""
    d = max(2, 1 << (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    rng = np.random.default_rng([SEED, d])
    signs = rng.choice([-1.0, 1.0], size=(tables, hashes, 3, d))
    out = np.zeros((len(x), tables, probes), dtype=np.int64)
    for t in range(tables):
        vertex = np.zeros((len(x), hashes, 2), dtype=np.int64)
        gap = np.zeros((len(x), hashes))
        for k in range(hashes):
            y = padded
            for s in signs[t, k]:
                y = hadamard(y * s)
            size = np.abs(y)
            order = np.argpartition(-size, 1, axis=1)[:, :2]
            pair = np.take_along_axis(size, order, axis=1)
            order = np.where(pair[:, :1] >= pair[:, 1:], order, order[:, ::-1])
            gap[:, k] = np.abs(pair[:, 0] - pair[:, 1])
            vertex[:, k] = 2 * order + (np.take_along_axis(y, order, axis=1) < 0)
        # Choices of first or second vertex per hash, the cheapest first.
        choice = np.array([[c >> k & 1 for k in range(hashes)] for c in range(1 << hashes)])
        cheap = np.argsort(gap @ choice.T, axis=1, kind="stable")[:, :probes]
        picked = choice[cheap]
        got = np.take_along_axis(vertex[:, None], picked[..., None], axis=3)[..., 0]
        number = np.zeros(got.shape[:2], dtype=np.int64)
        for k in range(hashes):
            number = number * (2 * d) + got[:, :, k]
        out[:, t, : number.shape[1]] = number
        out[:, t, number.shape[1] :] = number[:, :1]
    return out


def _valid() -> str:
    return (
        "label is not null and vec_id is not null and embedding is not null and size(embedding) > 0"
        " and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(embedding, x -> x <> 0)"
    )


def classes(rows: DataFrame) -> DataFrame:
    """One row per distinct (label, embedding): its smallest id and number of rows."""
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def bucketed(found: DataFrame, tables: int, hashes: int, probes: int) -> DataFrame:
    """Rows (label, d, bucket, rep, w, v, codes), one per class, table and distinct probe."""

    def run(batch: pa.RecordBatch) -> list:
        label, emb, rep, w = (batch.column(batch.schema.names.index(c)) for c in ("label", "embedding", "rep", "w"))
        size = np.asarray(pa.compute.list_value_length(emb))
        parts: list[list] = [[] for _ in range(7)]
        for d in np.unique(size):
            at = pa.array(np.flatnonzero(size == d))
            x = _matrix(emb.take(at))
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            c = codes(x, tables, hashes, probes)
            labels, reps, ws = label.take(at), rep.take(at), w.take(at)
            flat = c.reshape(len(c), -1)
            for t in range(tables):
                for p in range(probes):
                    new = np.flatnonzero((c[:, t, :p] != c[:, t, p : p + 1]).all(axis=1))
                    to = pa.array(new)
                    cols = [labels.take(to), pa.array(np.full(len(new), d, dtype=np.int32)), pa.array(c[new, t, p] * tables + t)]
                    cols += [reps.take(to), ws.take(to)]
                    cols.append(pa.FixedSizeListArray.from_arrays(pa.array(x[new].ravel()), int(d)).cast(pa.list_(pa.float64())))
                    cols.append(pa.FixedSizeListArray.from_arrays(pa.array(flat[new].ravel()), tables * probes).cast(pa.list_(pa.int64())))
                    for part, col in zip(parts, cols, strict=True):
                        part.append(col)
        return [pa.concat_arrays(p) for p in parts] if parts[0] else [[]] * 7

    kind = found.schema["label"].dataType.simpleString()
    return map_arrow(found, run, f"label {kind}, d int, bucket long, rep long, w long, v array<double>, codes array<long>")


class _Group:
    """Members of one bucket block."""

    def __init__(self, tables: int, probes: int, cosine: float) -> None:
        self.tables, self.probes, self.cosine = tables, probes, cosine

    def links(self, bucket: int, rep: np.ndarray, w: np.ndarray, x: np.ndarray, codes: np.ndarray, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Per member: weight of the links that count here, and the smallest id reached here."""
        n = len(rep)
        links, low = np.zeros(n, dtype=np.int64), np.arange(n)
        order = np.argsort(rep, kind="stable")
        rep, w, x, codes, side = rep[order], w[order], x[order], codes[order], None if side is None else side[order]
        t = bucket % self.tables
        pairs = []
        for a in range(0, n, 512):
            cos = x[a : a + 512] @ x.T
            # Dot products within rounding of the bound are taken again below; members of one chunk meet in their own block.
            i, j = np.nonzero(cos >= self.cosine - 1e-9)
            i += a
            keep = (i < j) & (rep[i] != rep[j])
            if side is not None:
                keep &= side[i] != side[j]
            pairs.append((i[keep], j[keep]))
        i, j = (np.concatenate(p) for p in zip(*pairs, strict=True))
        for a in range(0, len(i), 65536):
            p, q = i[a : a + 65536], j[a : a + 65536]
            exact = np.einsum("ij,ij->i", x[p], x[q]) >= self.cosine
            p, q = p[exact], q[exact]
            np.minimum.at(low, q, p)
            one, two = codes[p].reshape(-1, self.tables, self.probes, 1), codes[q].reshape(-1, self.tables, 1, self.probes)
            same = (one == two).any(axis=3)
            first = same.any(axis=2).argmax(axis=1) == t
            least = np.where(same[:, t], codes[p].reshape(-1, self.tables, self.probes)[:, t], np.iinfo(np.int64).max).min(axis=1)
            here = first & (least * self.tables + t == bucket)
            np.add.at(links, p[here], w[q[here]])
            np.add.at(links, q[here], w[p[here]])
        # Smallest member reached within the block.
        while True:
            new = low.copy()
            np.minimum.at(new, i, low[j]) if len(i) else None
            np.minimum.at(new, j, low[i]) if len(i) else None
            new = new[new]
            if (new == low).all():
                break
            low = new
        out_links, out_low = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        out_links[order], out_low[order] = links, rep[low]
        return out_links, out_low


def linked(rows: DataFrame, tables: int, probes: int, cosine: float) -> DataFrame:
    """(rep, links, low) for members with a link; `rows` sorted so that blocks come together."""
    schema = "rep long, links long, low long"
    out = to_arrow(rows.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = _Group(tables, probes, cosine)
        held: pa.Table | None = None

        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """All blocks of a table that hold two members or more."""
            if not t.num_rows:
                return
            key = block_key(t)
            start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            size = np.diff(np.r_[start, t.num_rows])
            res: list[tuple] = []
            for s, n in zip(start[size > 1], size[size > 1], strict=True):
                part = t.slice(s, n).combine_chunks()
                if part["bucket"][0].as_py() is None:
                    continue
                x = np.asarray(part["v"].combine_chunks().flatten()).reshape(n, -1)
                c = np.asarray(part["codes"].combine_chunks().flatten()).reshape(n, -1)
                rep = part["rep"].to_numpy()
                one = part["first"][0].as_py() == part["other"][0].as_py()
                side = None if one else part["chunk"].to_numpy() == part["other"].to_numpy()
                links, low = group.links(part["bucket"][0].as_py(), rep, part["w"].to_numpy(), x, c, side)
                hit = (links > 0) | (low != rep)
                if hit.any():
                    res.append((rep[hit], links[hit], low[hit]))
            if res:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*res, strict=True)], schema=out)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            key = block_key(t.select(["label", "d", "bucket", "first", "other"]))
            cut = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])[-1])
            yield from done(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None:
            yield from done(held)

    return rows.mapInArrow(run, schema)


def block_key(t: pa.Table) -> np.ndarray:
    label = t["label"].combine_chunks() if t["label"].num_chunks != 1 else t["label"].chunk(0)
    if not pa.types.is_integer(label.type):
        label = label.dictionary_encode().indices
    return np.stack([np.asarray(label).astype(np.int64), *[t[c].to_numpy().astype(np.int64) for c in ("d", "bucket", "first", "other")]], axis=1)


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deals bucket rows to blocks: large buckets become pairs of chunks, each a block."""
    key = ["label", "d", "bucket"]
    hot = rows.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > block).select(*key, F.ceil(F.col("m") / block).cast("int").alias("parts"))
    hot = Written(hot, "vector-hot").df
    dealt = rows.join(F.broadcast(hot) if hot.count() <= HOT_ROWS else hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # Chunk c is in the blocks (c, j >= c) and (i < c, c).
    dealt = dealt.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.select(
        *key, F.least("chunk", "mate").alias("first"), F.greatest("chunk", "mate").alias("other"), "chunk", "rep", "w", "v", "codes"
    )


def near_vectors(rows: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `rows` (vec_id, label, embedding)."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", "label", "embedding")
    good = rows.where(_valid())
    if not good.groupBy("vec_id").count().where("count > 1").isEmpty():
        good = good.dropDuplicates(["vec_id", "label", "embedding"])
    found = Written(classes(good), "vectors").df
    most = found.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    d = 2 * (found.agg(F.max(F.size("embedding"))).first()[0] or 2)
    hashes = max(2, int(np.ceil(np.log(max(1, most / PER_BUCKET)) / np.log(d) - 0.5)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks(bucketed(found, tables, hashes, probes)).repartition(n, "label", "d", "bucket", "first", "other")
    dealt = dealt.sortWithinPartitions("label", "d", "bucket", "first", "other")
    hits = Written(linked(dealt, tables, probes, cosine), "vector-links").df
    counts = hits.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(hits.where("rep <> low").select(F.col("rep").alias("u"), F.col("low").alias("v")))
    keys = ["label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")]
    of = found.select(*keys, "rep", "w").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    ids = rows.select("vec_id", F.when(F.expr(_valid()), F.col("label")).alias("label"), *keys[1:])
    out = ids.join(of, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
