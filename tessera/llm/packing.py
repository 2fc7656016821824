"""Best-fit packing of token pieces into sequences, planned by linear grouping over the length histogram.

Texts are encoded once; pieces (a long document is cut, the first piece taking the odd rest) have lengths of 1 to
`size` tokens, so the corpus enters the plan only as a histogram of at most `size` counts, whatever its size.
The plan follows the linear grouping scheme: large lengths are dealt, in descending order, into groups of equal
cardinality and rounded up to the largest of their group; a column-generation linear program finds the
configurations of those few sizes, each used as often as the program says, rounded down; actual lengths then take the
places of the rounded ones; the few pieces that rounding down leaves, and all small pieces, go best-fit (descending)
into the room that is left. What counts as large is tried in a few ways, and the plan of fewest sequences taken. The plan is a list of
runs "pieces of length L with ranks r0.. go one by one into sequences s0.., at offset o"; pieces get their rank
within their length by salted counts, so that one common length is no single task.

Defined cases: a null or empty text is the lone end token; repeated rows are packed each; an empty table gives no
rows. Sequence ids are dense from 0; no sequence exceeds `size`, and places in it are gapless from 0.
"""

from __future__ import annotations

import base64
import bisect
import functools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, map_arrow, table

SIZE = 2048
#: Lengths over size / part are large; the plan is made for each part, and the one of fewest sequences taken.
PARTS = (2.5, 3.0, 4.0)
GROUPS = 96
#: Salts, at least, by which pieces of one length are ranked in parallel.
SALTS = 64
#: Counts by length and salt that are broadcast at most.
BROADCAST_ROWS = SIZE * SALTS
DEFAULT = "byte_bpe_50k.tiktoken"
END, END_MARK = 50256, "<|endoftext|>"


@functools.lru_cache(maxsize=2)
def encoder(path: str):  # noqa: ANN201
    """The vocabulary as ranks; its end mark inside a text is the end token, as by default in the json form."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_MARK: END})


def encode(enc, text: str) -> np.ndarray:  # noqa: ANN001
    return enc.encode_to_numpy(text, allowed_special={END_MARK}) if END_MARK in text else np.asarray(enc.encode_ordinary(text), dtype=np.uint32)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than `size`."""
    first = n % size or size if n > size else n
    return [(0, first)] + [(s, size) for s in range(first, n, size)] if n else []


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch, enc) -> list:  # noqa: ANN001
        out: list[list] = [[], [], [], [], []]
        keys = batch.column(0)
        at: list[int] = []
        for i in range(0, batch.num_rows, 256):
            for j, t in enumerate(batch.column(1).slice(i, 256).to_pylist(), i):
                ids = np.append(encode(enc, t or ""), np.uint32(0)).astype("<u4", copy=False)
                for p, (s, n) in enumerate(cut(len(ids), size)):
                    at.append(j)
                    for c, v in zip(out, (p, s, n, zlib.crc32(ids[s : s + n].tobytes())), strict=False):
                        c.append(v)
        return [keys.take(pa.array(at, type=pa.int64())), *out[:4]]

    return map_arrow(
        docs.select(F.col(key), F.col(text)),
        run,
        f"{key} {kind}, piece int, start long, length long, ids_crc32 long",
        lambda: encoder(tokenizer or public_tokenizers.path(DEFAULT)),
    )


# --- the plan, over a histogram of lengths -----------------------------------------------------------------


def _knapsack(sizes: np.ndarray, values: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The configuration of most value that fits `size`."""
    best = np.zeros(size + 1)
    took = np.full(size + 1, -1)
    for i in np.flatnonzero(values > 1e-9):
        s, v = int(sizes[i]), values[i]
        for a in range(s, size + 1, s):  # block by block, so that an item may be taken again
            b = min(a + s, size + 1)
            with_it = best[a - s : b - s] + v
            better = with_it > best[a:b] + 1e-12
            best[a:b][better] = with_it[better]
            took[a:b][better] = i
    use = np.zeros(len(sizes))
    c = size
    total = 0.0
    # `best` need not be monotone in what was stored per block: walk down from the best capacity.
    c = int(np.argmax(best))
    while c > 0 and took[c] >= 0:
        use[took[c]] += 1
        total += values[took[c]]
        c -= int(sizes[took[c]])
    return total, use


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Column generation for min sum x, sum x a >= demand: (configuration, how often, as a real number)."""
    k = len(sizes)
    basis = np.diag((size // sizes).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        duals = inverse.T @ np.ones(k)
        value, column = _knapsack(sizes, duals, size)
        if value <= 1 + 1e-7:
            break
        x, d = inverse @ demand, inverse @ column
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    x = np.linalg.solve(basis, demand)
    return [(basis[:, j].copy(), float(x[j])) for j in range(k) if x[j] > 1e-9]


class Plan:
    """Runs (length, r0, count, per sequence, first sequence, offset) for a histogram {length: count}."""

    def __init__(self, histogram: dict[int, int], size: int = SIZE, groups: int = GROUPS, part: float = PARTS[-1]) -> None:
        self.size = size
        self.by_configuration = self.by_best_fit = 0  # large pieces
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.next_rank: dict[int, int] = defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.n = 0
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room left: (first sequence, sequences)
        self.rooms: list[int] = []
        if full := self.left.pop(size, 0):
            self.place(size, full, 1, self.open(full), 0)
        large = sorted((n for n in self.left if n > size / part), reverse=True)
        if large:
            total = sum(self.left[n] for n in large)
            self.grouped(large, groups)
            self.by_best_fit = sum(self.left[n] for n in large)
            self.by_configuration = total - self.by_best_fit
        for n in sorted(self.left, reverse=True):
            self.best_fit(n, self.left[n])
        self.left = {}

    def open(self, n: int) -> int:
        self.n += n
        return self.n - n

    def place(self, length: int, count: int, per: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.next_rank[length], count, per, sequence, offset))
        self.next_rank[length] += count

    def add_room(self, room: int, sequence: int, n: int) -> None:
        if room > 0 and n > 0:
            if not self.room[room]:
                bisect.insort(self.rooms, room)
            self.room[room].append((sequence, n))

    def grouped(self, large: list[int], groups: int) -> None:
        total = sum(self.left[n] for n in large)
        k = max(1, min(groups, total))
        bounds = [total * (g + 1) // k for g in range(k)]
        # Runs (length, count) of each group, in descending order of length.
        members: list[list[list[int]]] = [[] for _ in range(k)]
        g, before = 0, 0
        for n in large:
            c = self.left[n]
            while c:
                while before >= bounds[g]:
                    g += 1
                m = min(c, bounds[g] - before)
                members[g].append([n, m])
                before += m
                c -= m
        by_size: dict[int, list[list[int]]] = {}
        for runs in members:  # groups of one rounded length are one size
            if runs:
                by_size.setdefault(runs[0][0], []).extend(runs)
        sizes = np.array(list(by_size), dtype=np.int64)
        queues = [[r for r in runs] for runs in by_size.values()]
        demand = np.array([sum(c for _, c in q) for q in queues], dtype=float)
        for q in queues:
            q.reverse()  # pop() takes the longest first
        have = demand.astype(np.int64)
        for use, x in sorted(configurations(sizes, demand, self.size), key=lambda p: -p[1]):
            use = use.astype(np.int64)
            held = np.flatnonzero(use)
            m = min([int(x + 1e-6), *(int(have[i] // use[i]) for i in held)])
            if m > 0:
                have[held] -= m * use[held]
                self.substitute([i for i in held for _ in range(use[i])], queues, m)

    def substitute(self, slots: list[int], queues: list[list[list[int]]], m: int) -> None:
        """m sequences of one configuration, each slot filled by the next actual pieces of its group."""
        first = self.open(m)
        columns = []
        for i in slots:
            need, got = m, []
            while need:
                run = queues[i][-1]
                c = min(need, run[1])
                got.append([run[0], c])
                run[1] -= c
                need -= c
                if not run[1]:
                    queues[i].pop()
            columns.append(got)
        at = [0] * len(slots)
        done = 0
        while done < m:
            c = min(col[at[j]][1] for j, col in enumerate(columns))
            offset = 0
            for j, col in enumerate(columns):
                n = col[at[j]][0]
                self.place(n, c, 1, first + done, offset)
                self.left[n] -= c
                offset += n
                col[at[j]][1] -= c
                at[j] += col[at[j]][1] == 0
            self.add_room(self.size - offset, first + done, c)
            done += c

    def best_fit(self, n: int, count: int) -> None:
        while count:
            i = bisect.bisect_left(self.rooms, n)
            if i == len(self.rooms):
                per = self.size // n
                self.add_room(self.size, self.open(m := -(-count // per)), m)
                continue
            room = self.rooms[i]
            sequence, bins = self.room[room].pop()
            if not self.room[room]:
                self.rooms.pop(i)
            per = min(room // n, count)
            m = min(bins, count // per)
            self.place(n, m * per, per, sequence, self.size - room)
            count -= m * per
            self.add_room(room - per * n, sequence, m)
            self.add_room(room, sequence + m, bins - m)

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = np.array(sorted((r[0], r[1], *r[2:]) for r in self.runs), dtype=np.int64).reshape(-1, 6)
        return tuple(runs.T)


def plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    return min((Plan(dict(histogram), size, part=part) for part in PARTS), key=lambda p: p.n)


def pack(found: DataFrame, size: int = SIZE, salts: int | None = None) -> DataFrame:
    """`found` (with `length`, and columns that tell pieces apart) with sequence_id and offset."""
    cols = found.columns
    salts = salts or max(SALTS, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt, rank, base, n = (next(c for k in range(len(cols) + 1) if (c := f"_{name}{k}") not in cols) for name in ("salt", "rank", "base", "n"))
    salted = found.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cols]), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    before = F.sum(n).over(Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", salt, F.coalesce(before, F.lit(0)).alias(base))
    if size * salts <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    histogram = {r[0]: r[1] for r in found.groupBy("length").agg(F.count("*")).collect()}  # at most `size` rows
    runs = plan(histogram, size).arrays()
    within = F.row_number().over(Window.partitionBy("length", salt).orderBy(*[F.col(f"`{c}`") for c in cols if c != "length"])) - 1
    ranked = salted.withColumn(rank, within).join(bases, ["length", salt])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in cols], (F.col(base) + F.col(rank)).alias(rank))

    def run(batch: pa.RecordBatch) -> list:
        length, r0, _, per, first, offset = runs
        key = length << 42 | r0
        n = batch.column(batch.schema.names.index("length")).to_numpy()
        place = batch.column(batch.num_columns - 1).to_numpy()
        at = np.searchsorted(key, n << 42 | place, side="right") - 1
        k = place - r0[at]
        return [*batch.columns[:-1], first[at] + k // per[at], offset[at] + k % per[at] * n]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return map_arrow(ranked, run, f"{fields}, sequence_id long, offset long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(Written(pieces(table(spark, sf_dir, "documents")), "pieces").df)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(Written(pieces(docs), "pieces").df)
