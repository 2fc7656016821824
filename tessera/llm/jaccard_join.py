"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters, verified once per pair.

Texts of the same shingle set are one class (signature: two independent sums over the set's hashes). A sketch of
shingle frequencies (a fixed number of counters, summed over all rows) orders shingles rare-first; any order is
right, a rare-first one keeps posting lists short. Each class posts its prefix, once per task. A posting list is
read in order of size: a member may pair with a shorter one that posts the shingle in its index prefix (length
filter), if enough could still follow both positions (positional filter). Lists with up to `DIRECT` partners a
member emit all those pairs. Longer lists first emit a linear number, each member with the `HEADS` members of least hash;
after verification, only their pairs between different components are emitted and verified, in rounds: with four times
as many members on one side each time, while such pairs are many, and at last all of them. Components thus lose no
link, while a large group of near copies costs a number of pairs in proportion to its size.

Before sets are fetched, pairs pass the suffix filter: the sets' counts over a fixed partition of the shingles
bound how far they differ. Sets are made again only for classes that a bounded Bloom filter says are needed.

Defined cases: empty or null texts have no shingles and link with nothing; repeated rows and copies are one class;
rows of a null id are in classes too, and a class's smallest id is taken over its ids; extra columns are ignored.
A signature is 64 bits: that two of n classes share one has a chance of n^2 / 2^65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, connected_components, map_arrow, table, to_arrow
from .hashing import Bloom, mix, shingle_sets

WORDS, PERCENT = 4, 85
#: Counters of the frequency sketch, and the blocks in which it is summed.
COUNTERS, BLOCKS = 1 << 20, 64
#: Partners a member has in a list before the list is treated as a large one.
DIRECT = 12
#: Members of a large list that all others are compared with first.
HEADS = 32
#: Pairs that are verified without a further round of that kind.
FEW = 150_000
#: Parts of the suffix filter.
PARTS = 64
ROWS = 512


def signature(s: np.ndarray) -> int:
    return int(np.sum(mix(s + np.uint64(0xA0761D6478BD642F)), dtype=np.uint64).astype(np.int64)) if len(s) else 0


def sizes(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, n_shingles, sig, data) per row; data: the set's counts over `PARTS` parts, for the suffix filter."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> list:
        n: list[int] = []
        sig: list[int] = []
        data: list[bytes] = []
        for i in range(0, batch.num_rows, ROWS):
            for s in shingle_sets(batch.column(1).slice(i, ROWS), words):
                n.append(len(s))
                sig.append(signature(s))
                counts = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=PARTS)
                data.append(counts.astype(np.uint16 if len(s) < 60000 else np.uint32).tobytes())
        return [batch.column(0), n, sig, data]

    return map_arrow(docs.select(F.col(key), F.col(text)), run, f"{key} {kind}, n_shingles long, sig long, data binary")


def frequencies(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """The sketch: how often shingles of each counter occur in all rows, a text's shingles once."""
    spark = docs.sparkSession
    schema = "block int, counts binary"
    out = to_arrow(spark, schema)
    width = COUNTERS // BLOCKS

    def rows(total: np.ndarray) -> pa.RecordBatch:
        packed = [zlib.compress(total[b * width : (b + 1) * width].tobytes(), 1) for b in range(BLOCKS)]
        return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(packed, pa.binary())], schema=out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(COUNTERS, dtype=np.int64), False
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                sets = [s for s in shingle_sets(batch.column(0).slice(i, ROWS), words) if len(s)]
                if sets:
                    total += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
                    some = True
        if some:
            yield rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                part = np.frombuffer(zlib.decompress(c), dtype=np.int64)
                sums[b] = sums[b] + part if b in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([zlib.compress(s.tobytes(), 1) for s in sums.values()], pa.binary())], schema=out
            )

    summed = docs.select(F.col(text)).mapInArrow(count, schema).repartition(BLOCKS, "block").mapInArrow(add, schema)
    total = np.zeros(COUNTERS, dtype=np.int64)
    for b, c in summed.collect():  # BLOCKS rows, at most 8 * COUNTERS bytes
        total[b * width : (b + 1) * width] = np.frombuffer(zlib.decompress(bytes(c)), dtype=np.int64)
    return np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)


def postings(docs: DataFrame, text: str, words: int, percent: int, sketch: object) -> DataFrame:
    """(token, sig, size, pos) of each class's prefix; a task posts a class once."""
    schema = "token long, sig long, size int, pos int"
    out = to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        counts = np.frombuffer(zlib.decompress(sketch.value), dtype=np.uint32)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                cols: list[list[np.ndarray]] = [[], [], [], []]
                for s in shingle_sets(batch.column(0).slice(i, ROWS), words):
                    n = len(s)
                    if not n or (sig := signature(s)) in seen:
                        continue
                    seen.add(sig)
                    prefix = n + (-percent * n // 100) + 1
                    freq = counts[(s % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64)
                    order = np.lexsort((mix(s), freq))[:prefix]
                    for c, v in zip(cols, (s[order].astype(np.int64), np.full(len(order), sig), np.full(len(order), n), np.arange(len(order))), strict=True):
                        c.append(v)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return docs.select(F.col(text)).mapInArrow(run, schema)


PAIR = "kind int, a long, b long, size_a int, size_b int, pos int"


def _lists(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, a table at a time, lists (equal first column) whole."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
        cut = int(np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])[-1])
        if cut:
            yield [c[:cut] for c in cols]
        held = [c[cut:] for c in cols]
    if held is not None:
        yield held


class _Filters:
    """Length and positional filters for pairs of list members i < j (by size)."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    def index_prefix(self, n: np.ndarray) -> np.ndarray:
        p = self.percent
        return n - -(-2 * p * n // (100 + p)) + 1

    def shortest(self, n: np.ndarray) -> np.ndarray:
        return -(-self.percent * n // 100)

    def may(self, si: np.ndarray, pi: np.ndarray, sj: np.ndarray, pj: np.ndarray) -> np.ndarray:
        p = self.percent
        need = -(-p * (si + sj) // (100 + p))
        return 1 + np.minimum(si - pi - 1, sj - pj - 1) >= need


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) over all start[k] .. start[k] + count[k] - 1."""
    owner = np.repeat(np.arange(len(start)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + start[owner]


def first_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs to verify (kind 0), and the postings of large lists (kind 1: a = token, b = sig)."""
    out = to_arrow(posted.sparkSession, PAIR)
    rule = _Filters(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, sig, size, pos in _lists(batches, 4):
            new = np.r_[True, (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])]  # a class posted by several tasks is one
            token, sig, size, pos = token[new], sig[new], size[new].astype(np.int64), pos[new].astype(np.int64)
            run_of = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
            small = np.flatnonzero(pos < rule.index_prefix(size))  # members that others may pair with
            key = run_of[small] << 32 | size[small]
            me = np.arange(len(token))
            lo = np.searchsorted(key, run_of << 32 | rule.shortest(size))
            hi = np.searchsorted(small, me)
            count = np.maximum(hi - lo, 0)
            large = np.zeros(run_of[-1] + 1, dtype=bool)
            large[run_of[count > DIRECT]] = True
            direct = np.where(large[run_of], 0, count)
            j, k = _ranges(lo, direct)
            # In a large list all turn to a few members of least hash, mostly the same ones in all lists of a group of
            # copies; those that one is too short or too long for take their first partner.
            far = np.flatnonzero(large[run_of] & (count > 0))
            left, right = [small[k]], [j]
            for seed in range(HEADS if len(far) else 0):
                head = small[np.lexsort((mix(sig.astype(np.uint64) + np.uint64(seed))[small], run_of[small]))]
                head = head[np.searchsorted(run_of[head], run_of[far])]
                p, q = np.minimum(head, far), np.maximum(head, far)
                fits = (p != q) & (pos[p] < rule.index_prefix(size[p])) & (size[p] >= rule.shortest(size[q]))
                left.append(np.where(fits, p, small[np.minimum(lo[far], len(small) - 1)]))
                right.append(np.where(fits, q, far))
            i, j = np.concatenate(left), np.concatenate(right)
            ok = rule.may(size[i], pos[i], size[j], pos[j])
            i, j = i[ok], j[ok]
            a, b = np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])
            _, once = np.unique(mix(a.astype(np.uint64)) ^ mix(b.astype(np.uint64) + np.uint64(1)), return_index=True)
            rows = [[np.zeros(len(once), np.int32), a[once], b[once], size[i][once], size[j][once], np.zeros(len(once))]]
            r = np.flatnonzero(large[run_of])
            rows.append([np.ones(len(r), np.int32), token[r], sig[r], size[r], np.zeros(len(r)), pos[r]])
            for part in rows:
                if len(part[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(part, out, strict=True)], schema=out)

    return posted.mapInArrow(run, PAIR)


def cross_pairs(posted: DataFrame, percent: int, heads: int | None) -> DataFrame:
    """Pairs of large lists between different components, with `heads` members of a list at most on one side; without
    `heads`, one row per block, whose `a` is the number of all such pairs. `posted`: token, size, sig, pos, component."""
    schema = "a long, b long"
    out = to_arrow(posted.sparkSession, schema)
    rule = _Filters(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, size, sig, pos, comp in _lists(batches, 5):
            new = np.r_[True, (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])]
            token, sig, size, pos, comp = token[new], sig[new], size[new].astype(np.int64), pos[new].astype(np.int64), comp[new]
            edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
            for s, e in zip(edge[:-1], edge[1:], strict=True):
                if (comp[s:e] == comp[s]).all():
                    continue
                all_of = np.arange(s, e)
                few = all_of
                if heads is not None and heads < e - s:
                    few = s + np.argpartition(mix(sig[s:e].astype(np.uint64) + np.uint64(heads)), heads)[:heads]
                step = max(1, (1 << 20) // len(all_of))
                for block in range(0, len(few), step):
                    p, q = (x.ravel() for x in np.meshgrid(few[block : block + step], all_of, indexing="ij"))
                    i, j = np.minimum(p, q), np.maximum(p, q)
                    ok = (comp[i] != comp[j]) & (pos[i] < rule.index_prefix(size[i])) & (size[i] >= rule.shortest(size[j]))
                    ok &= rule.may(size[i], pos[i], size[j], pos[j])
                    if heads is None:
                        yield pa.RecordBatch.from_arrays([pa.array([int(ok.sum()) // 2]), pa.array([0])], schema=out)
                    elif ok.any():
                        a, b = np.minimum(sig[i[ok]], sig[j[ok]]), np.maximum(sig[i[ok]], sig[j[ok]])
                        _, once = np.unique(mix(a.astype(np.uint64)) ^ mix(b.astype(np.uint64) + np.uint64(1)), return_index=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once])], schema=out)

    return posted.mapInArrow(run, schema)


def sets_of(docs: DataFrame, text: str, words: int, needed: object) -> DataFrame:
    """(sig, data) of needed classes, once per task; data: the set."""
    schema = "sig long, data binary"
    out = to_arrow(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bloom: Bloom = needed.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                sets = [s for s in shingle_sets(batch.column(0).slice(i, ROWS), words) if len(s)]
                sigs = np.array([signature(s) for s in sets], dtype=np.int64)
                rows: list[tuple[int, bytes]] = []
                for k in np.flatnonzero(bloom.has(sigs)):
                    if (sig := int(sigs[k])) not in seen:
                        seen.add(sig)
                        rows.append((sig, sets[k].tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return docs.select(F.col(text)).mapInArrow(run, schema)


def needed_filter(pairs: DataFrame) -> Bloom:
    """A Bloom filter of fixed size over both ends of all pairs, united from one per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom()
        some = False
        for batch in batches:
            for c in batch.columns:
                bloom.add(c.to_numpy())
                some = some or batch.num_rows > 0
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bloom.data.tobytes(), 1)], pa.binary())], names=["data"])

    total = Bloom()
    for (data,) in pairs.select("a", "b").coalesce(8).mapInArrow(run, "data binary").toLocalIterator():
        total.data |= np.frombuffer(zlib.decompress(bytes(data)), dtype=np.uint8)
    return total


def _decoded(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint16 if len(data) == 2 * PARTS else np.uint32).astype(np.int64)


def distinct_sides(sides: DataFrame) -> DataFrame:
    return sides.groupBy("sig").agg(F.max("data").alias("data"))


def with_sides(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    one = sides
    left = pairs.join(one.select(F.col("sig").alias("a"), F.col("data").alias("data_a")), "a")
    return left.join(one.select(F.col("sig").alias("b"), F.col("data").alias("data_b")), "b")


def near_enough(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that pass the suffix filter."""

    def near(batch: pa.RecordBatch) -> list:
        a, b, x, y = (batch.column(batch.schema.names.index(c)) for c in ("a", "b", "data_a", "data_b"))
        keep = []
        for p, q in zip(x, y, strict=True):
            p, q = _decoded(p.as_buffer()), _decoded(q.as_buffer())
            n = int(p.sum() + q.sum())
            keep.append((100 + percent) * (n - int(np.abs(p - q).sum())) >= 2 * percent * n)
        mask = pa.array(keep, pa.bool_())
        return [a.filter(mask), b.filter(mask)]

    return map_arrow(with_sides(pairs, parts), near, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sets are as similar as asked."""

    def same(batch: pa.RecordBatch) -> list:
        a, b, x, y = (batch.column(batch.schema.names.index(c)) for c in ("a", "b", "data_a", "data_b"))
        keep = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p.as_buffer(), dtype=np.uint64), np.frombuffer(q.as_buffer(), dtype=np.uint64)
            both = np.concatenate([p, q])
            both.sort(kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(both) - common))
        mask = pa.array(keep, pa.bool_())
        return [a.filter(mask), b.filter(mask)]

    return map_arrow(with_sides(pairs, sets), same, "u long, v long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id) for every row."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    of = Written(sizes(docs, key, text, words), "sizes").df
    sketch = spark.sparkContext.broadcast(zlib.compress(frequencies(docs, text, words).tobytes(), 1))
    posted = postings(docs, text, words, percent, sketch).repartition(n, "token").sortWithinPartitions("token", "size", "sig")
    first = Written(first_pairs(posted, percent), "pairs")
    pairs = Written(first.df.where("kind = 0").select("a", "b").distinct(), "pairs")
    held = [first, pairs]  # tables of which the result does not depend

    def keep(df: DataFrame, tag: str) -> DataFrame:
        held.append(Written(df, tag))
        return held[-1].df

    counts = keep(distinct_sides(of.where("n_shingles > 0").select("sig", "data")), "counts")
    passed = keep(near_enough(pairs.df, counts, percent), "passed")
    # Members of large lists may be compared in later rounds, so their sets are made now as well.
    listed = first.df.where("kind = 1").select(F.col("b").alias("a"), "b")
    bloom = spark.sparkContext.broadcast(needed_filter(passed.union(listed)))
    sets = keep(distinct_sides(sets_of(docs, text, words, bloom)), "sets")
    links = keep(linked(passed, sets, percent), "links")
    parts = keep(connected_components(links), "parts")
    # Large lists again, by what is connected now, with ever more members that others are compared with, until the pairs
    # between components are few, or all members are; these are all verified.
    rest = first.df.where("kind = 1").select(F.col("a").alias("token"), F.col("size_a").alias("size"), F.col("b").alias("sig"), "pos")
    heads, longest, known = HEADS, rest.groupBy("token").count().agg(F.max("count")).first()[0] or 0, pairs.df
    rows = rest.count()
    while longest:
        now = rest.join(parts.withColumnRenamed("node", "sig"), "sig", "left").select("token", "size", "sig", "pos", F.coalesce("component", "sig").alias("component"))
        now = now.repartition(n, "token").sortWithinPartitions("token", "size", "sig")
        heads = 4 * heads
        left = cross_pairs(now, percent, None).agg(F.sum("a")).first()[0] or 0
        last = left <= max(FEW, 2 * rows) or heads >= longest
        if not left:
            break
        more = keep(cross_pairs(now, percent, longest if last else heads).distinct().join(known, ["a", "b"], "left_anti"), "pairs")
        links = keep(links.union(linked(near_enough(more, counts, percent), sets, percent)), "links")
        parts = keep(connected_components(links), "parts")
        known = known.union(more)
        if last:
            break
    # Smallest id of each component; a class that links with no other is a component of its own.
    low = of.where("n_shingles > 0").groupBy("sig").agg(F.min(key).alias("low")).join(parts.withColumnRenamed("node", "sig"), "sig", "left")
    low = low.withColumn("component", F.coalesce("component", "sig"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    label = Written(low.join(least, "component").select("sig", "component_id"), "labels").df
    for done in held:
        done.drop()
    empty = of.where("n_shingles = 0").select(key, "n_shingles", F.col(key).alias("component_id"))
    return of.where("n_shingles > 0").join(label, "sig", "left").select(key, "n_shingles", "component_id").union(empty)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, the one of smallest (doc_id, row), a null doc_id last: five-word shingles, a similarity of 0.8
    or more. Rows are numbered in a table of their own, so that a number means the same row in every pass."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    at = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("no"))
    numbered = Written(docs.select(row.alias("_row"), at.alias("_at")), "numbered").df
    found = jaccard_components(numbered.select("_at", F.col("_row.text").alias("_text")), key="_at", text="_text", words=5, percent=80)
    gone = found.where("not (component_id <=> _at)").select(F.col("_at.no").alias("_no"))
    return numbered.join(gone, F.col("_at.no") == F.col("_no"), "left_anti").select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
