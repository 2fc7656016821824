"""SentencePiece encoding and decoding by a max-plus scan over the lattice of pieces.

A path through the lattice of pieces is the library's encoding if and only if each two pieces next to each other
are what their joined text encodes to; other steps weigh minus infinity, all that are left weigh nothing. So a place
has one live state at most: the piece that ends there. No piece reaches across some places (before a space mark that
follows another character, around line ends, before some marks after a letter); parts between them are independent,
and equal parts are encoded once as long as they are remembered, all new ones of a batch together, place by place, as
arrays.

Texts over `CHUNK` characters are cut at fixed places, whatever stands there, and dealt to other tasks. The states of
a cut are the pieces that may be the first to end there or after it. A task gives each chunk's matrix of weights from
the states of its left cut to those of its right cut; matrices are combined associatively in a tree, which gives each
chunk the one state it begins and ends with; then each chunk is backtraced by itself. Within a task, parts over
`SEGMENT` characters are scanned in the same way, all segments at once.

Defined cases: a null or empty text has no pieces and decodes to an empty text; a character outside the vocabulary is
its bytes; a space mark in a text decodes to a space, as in the library; repeated rows are encoded each. Parts are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, map_arrow, table, to_arrow
from .hashing import Prefix, mix

DEFAULT = "piece_bpe_32k.model"
MARK = "▁"
SEGMENT = 512
#: Characters of texts that are coded together.
TOGETHER = 1 << 20
#: Bits of the number of slots that remember which pieces may be neighbours, and of those that remember parts.
SLOTS, PART_SLOTS = 22, 19
#: Pieces of remembered parts; once they are full, all is forgotten.
ARENA = 1 << 22
CHUNK = 1 << 16


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... of `size[k]` numbers each, end to end."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Pieces:
    """The vocabulary of a model with byte fallback, and which pieces may stand next to each other."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.text = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.longest = max(map(len, self.id))
        self.none = len(self.text)  # ids from here: characters outside the vocabulary, by code point
        whole = [p for p in self.id if self.plain(p) == [p]]  # pieces that their own text encodes to
        joined = np.frombuffer("".join(whole).encode("utf-32-le"), dtype=np.uint32)
        size = np.fromiter(map(len, whole), dtype=np.int64, count=len(whole))
        start = np.cumsum(size) - size
        key = Prefix(joined).part(start, start + size)
        order = np.argsort(key)
        self.key, self.number = key[order], np.array([self.id[p] for p in whole], dtype=np.int64)[order]
        # Where in the sorted keys each value of the top bits begins: a lookup is a few steps from there.
        top = (self.key >> np.uint64(46)).astype(np.int64)
        self.begin = np.searchsorted(top, np.arange(1 << 18))
        self.steps = int(np.bincount(top).max())
        self.key = np.append(self.key, np.full(self.steps, np.uint64(2**64 - 1)))
        self.number = np.append(self.number, np.full(self.steps, -1))
        # Marks that follow a letter in no piece: a cut before them is safe as well.
        self.letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])
        after = {c for x in self.id for a, c in zip(x, x[1:], strict=False) if self.letter[ord(a)]}
        self.mark = np.zeros(0x110000, dtype=bool)
        self.mark[[ord(c) for c in ".,;:!?\"')(" if c not in after]] = True
        self.table = np.full(1 << SLOTS, -2, dtype=np.int64)
        self.answer: dict[int, int] = {}
        # Remembered parts: hash, and where in the arena their pieces are.
        self.part, self.at = np.zeros(1 << PART_SLOTS, dtype=np.uint64), np.zeros(1 << PART_SLOTS, dtype=np.int32)
        self.length = np.zeros(1 << PART_SLOTS, dtype=np.int32)
        self.arena, self.used = np.zeros(ARENA, dtype=np.int32), 0
        # Code points of each piece.
        self.text_size = np.fromiter(map(len, self.text), dtype=np.int64, count=len(self.text))
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.text_points = points_of("".join(self.text))

    def plain(self, s: str) -> list[str]:
        """Merges of the best scored neighbours, leftmost first: for a text of two pieces at most."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                v = self.score.get(parts[i] + parts[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def string(self, number: int) -> str:
        return self.text[number] if number < self.none else chr(number - self.none)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By a direct-mapped table: a slot holds the pair last looked up there, with its answer as the lowest bit."""
        pair = (a << 32 | b) << 1
        slot = (mix(pair.astype(np.uint64)) >> np.uint64(64 - SLOTS)).astype(np.int64)
        held = self.table[slot]
        miss = np.flatnonzero(held >> 1 << 1 != pair)
        if len(miss):
            for p in np.unique(pair[miss]).tolist():
                x, y = self.string(p >> 33), self.string(p >> 1 & 0xFFFFFFFF)
                self.answer[p] = p | (self.plain(x + y) == [x, y])
            got = np.fromiter(map(self.answer.__getitem__, pair[miss].tolist()), dtype=np.int64, count=len(miss))
            self.answer.clear()
            self.table[slot[miss]] = got
            held[miss] = got
        return (held & 1).astype(bool)

    def lattice(self, points: np.ndarray, size: np.ndarray, forced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For rows laid end to end: row starts, and per place (one more than characters a row) the piece that ends there
        and its length, -1 where none may. A row with a forced length begins with the piece of that length."""
        start = np.cumsum(size) - size
        prefix = Prefix(points)
        row_end = np.repeat(start + size, size)
        ids = np.full((self.longest + 1, len(points)), -1, dtype=np.int64)
        for n in range(1, self.longest + 1):
            at = np.flatnonzero(np.arange(len(points)) + n <= row_end)
            want = prefix.part(at, at + n)
            k = self.begin[(want >> np.uint64(46)).astype(np.int64)]
            for step in range(self.steps):
                hit = np.flatnonzero(self.key[k + step] == want)
                ids[n, at[hit]] = self.number[k[hit] + step]
        ids[1] = np.where(ids[1] < 0, self.none + points.astype(np.int64), ids[1])
        place = start + np.arange(len(size))
        last, length = np.full(len(points) + len(size), -1, dtype=np.int64), np.zeros(len(points) + len(size), dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        sorted_size = -size[order]
        for j in range(1, int(size.max(initial=0)) + 1):
            live = order[: np.searchsorted(sorted_size, -j, side="right")]
            for n in range(min(j, self.longest), 0, -1):
                rows_n = live[(last[place[live] + j] < 0) & (ids[n, start[live] + j - n] >= 0)]
                if not len(rows_n):
                    continue
                number = ids[n, start[rows_n] + j - n]
                first = (j == n) & ((forced[rows_n] == 0) | (forced[rows_n] == n))
                before = last[place[rows_n] + j - n] if n < j else np.full(len(rows_n), -1)
                inner = (before >= 0) & (j - n >= forced[rows_n])
                ok = (number >= 0) & (first | inner)
                rows_n, number, before, inner = rows_n[ok], number[ok], before[ok], inner[ok]
                if not len(rows_n):
                    continue
                good = np.ones(len(rows_n), dtype=bool)
                if inner.any():
                    good[inner] = self.may_follow(before[inner], number[inner])
                at = place[rows_n[good]] + j
                last[at], length[at] = number[good], n
        return place, last, length

    def back(self, last: np.ndarray, length: np.ndarray, place: np.ndarray, till: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each row from its place `till` back to `stop`, in order and end to end, and how many a row has."""
        cur, live = till.copy(), np.flatnonzero(till > stop)
        rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(live):
            at = place[live] + cur[live]
            rows.append(live)
            numbers.append(last[at])
            cur[live] -= length[at]
            live = live[cur[live] > stop[live]]
        row, number = np.concatenate(rows[::-1]), np.concatenate(numbers[::-1])
        order = np.argsort(row, kind="stable")
        return self.spelled(number[order], row[order], len(place))

    def spelled(self, numbers: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as their bytes."""
        odd = np.flatnonzero(numbers >= self.none)
        if len(odd):
            cp = numbers[odd] - self.none
            times = np.ones(len(numbers), dtype=np.int64)
            times[odd] = 1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000)
            at = (np.cumsum(times) - times)[odd]
            numbers, row = np.repeat(numbers, times), np.repeat(row, times)
            for c in np.unique(cp).tolist():
                for k, byte in enumerate(chr(c).encode("utf-8", "surrogatepass")):
                    numbers[at[cp == c] + k] = self.byte[byte]
        return numbers, np.bincount(row, minlength=rows)

    # --- parts without a safe cut: matrices between cut states -------------------------------------------------

    def states(self, s: str, cut: int) -> list[tuple[int, int]]:
        """(start, end) of the pieces that may be the first to end at `cut` or after it."""
        return [
            (a, b)
            for a in range(max(0, cut - self.longest), cut)
            for b in range(cut, min(len(s), a + self.longest) + 1)
            if b == a + 1 or s[a:b] in self.id
        ]

    def segments(self, s: str, cuts: list[int], entries: list[tuple[int, int]]) -> Segments:
        """The lattices of the segments between `cuts`, from each state of each one's left cut; `entries`: of the first."""
        return Segments(self, s, cuts, [entries, *[self.states(s, c) for c in cuts[1:-1]]])

    def scan(self, s: str) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of a part, and their number."""
        seg = self.segments(s, [0, *range(SEGMENT, len(s) - SEGMENT // 2, SEGMENT), len(s)], [(0, 0)])
        return seg.back((0, 0), max(scan(seg.matrices)[-1][0, 0]))

    # --- whole texts -------------------------------------------------------------------------------------------

    def safe(self, points: np.ndarray) -> np.ndarray:
        """At which places (but 0) no piece reaches across."""
        before, now = points[:-1], points[1:]
        space, end = ord(MARK), 10
        cut = ((now == space) & (before != space)) | ((now == end) != (before == end)) | (self.mark[now] & self.letter[before])
        return np.r_[False, cut] if len(points) else np.zeros(0, dtype=bool)

    def pieces(self, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of normalized texts laid end to end, and how many each has."""
        filled = size > 0
        cut = self.safe(points)
        cut[(np.cumsum(size) - size)[filled]] = True
        start = np.flatnonzero(cut)
        length = np.diff(np.r_[start, len(points)])
        key, first, of = np.unique(Prefix(points).part(start, start + length), return_index=True, return_inverse=True)
        slot = (key >> np.uint64(64 - PART_SLOTS)).astype(np.int64)
        hit = self.part[slot] == key
        new = np.flatnonzero(~hit)
        fresh, count = self.parts(points, start[first[new]], length[first[new]])
        begin, n = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=np.int64)
        begin[hit], n[hit] = self.at[slot[hit]], self.length[slot[hit]]
        begin[new], n[new] = ARENA + np.cumsum(count) - count, count
        source = np.concatenate([self.arena, fresh.astype(np.int32)])
        out = source[ragged(begin[of], n[of])]
        if self.used + len(fresh) > ARENA:
            self.part[:], self.used = 0, 0
        if len(fresh) <= ARENA:
            self.arena[self.used : self.used + len(fresh)] = fresh
            self.part[slot[new]], self.at[slot[new]], self.length[slot[new]] = key[new], begin[new] - ARENA + self.used, count
            self.used += len(fresh)
        text = np.searchsorted(np.cumsum(size)[filled], start, side="right")
        total = np.zeros(len(size), dtype=np.int64)
        total[filled] = np.bincount(text, weights=n[of], minlength=int(filled.sum())).astype(np.int64)
        return out, total

    def parts(self, points: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of parts, and how many each has."""
        order = np.argsort(size, kind="stable")
        short = order[: np.searchsorted(size[order], SEGMENT, side="right")]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edge = np.cumsum(size[short]) // (1 << 18)
        for k in np.unique(edge).tolist():
            some = short[edge == k]
            place, last, length = self.lattice(points[ragged(start[some], size[some])], size[some], np.zeros(len(some), np.int64))
            found.append((some, *self.back(last, length, place, size[some], np.zeros(len(some), np.int64))))
        for k in order[len(short) :].tolist():
            found.append((np.array([k]), *self.scan(string(points[start[k] : start[k] + size[k]]))))
        count = np.zeros(len(size), dtype=np.int64)
        for some, _, n in found:
            count[some] = n
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype=np.int64)
        for some, numbers, n in found:
            out[ragged(begin[some], n)] = numbers
        return out, count

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of normalized texts (space marks for spaces)."""
        out: list[list[int]] = []
        for part in batches(texts):
            ids, n = self.pieces(points_of("".join(part)), np.fromiter(map(len, part), dtype=np.int64, count=len(part)))
            edge = np.r_[0, np.cumsum(n)].tolist()
            flat = ids.tolist()
            out += [flat[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return out

    def spells(self, ids: np.ndarray, n: np.ndarray, points: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the texts of the pieces, put together, are the normalized texts; bytes are decoded one by one."""
        text = np.repeat(np.arange(len(n)), n)
        byte = np.zeros(len(n), dtype=bool)
        byte[text[(ids >= min(self.value)) & (ids <= max(self.value))]] = True
        width = self.text_size[ids]
        total = np.bincount(text, weights=width, minlength=len(n)).astype(np.int64)
        same = (total == size) & ~byte
        made = self.text_points[ragged(self.text_start[ids], np.where(same[text], width, 0))]
        differ = made != points[np.repeat(same, size)]
        same[np.flatnonzero(same)[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(differ), side="right")]] = False
        edge, begin = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(size)]
        for k in np.flatnonzero(byte).tolist():
            same[k] = self.decode(ids[edge[k] : edge[k + 1]].tolist(), False) == string(points[begin[k] : begin[k + 1]]).replace(MARK, " ")
        return same

    def decode(self, numbers: list[int], first: bool = True) -> str:
        out, pending = [], bytearray()
        if numbers and min(numbers) > max(self.value):  # no byte among them
            out, numbers = [self.text[x] for x in numbers], []
        for x in numbers:
            if x in self.value:
                pending.append(self.value[x])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.text[x])
        out.append(pending.decode("utf-8", "replace"))
        s = "".join(out).replace(MARK, " ")
        return s[1:] if first and s.startswith(" ") else s


class Segments:
    """Lattices of the segments of a text, a row for each state of each segment's left cut, all computed together."""

    def __init__(self, p: Pieces, s: str, cuts: list[int], entries: list[list[tuple[int, int]]]) -> None:
        self.p, self.entries, self.cuts = p, entries, cuts
        ends = [min(len(s), c + p.longest) for c in cuts[1:]]
        rows = [(k, a, b) for k, es in enumerate(entries) for a, b in es]
        self.row = {(k, (a, b)): i for i, (k, a, b) in enumerate(rows)}
        size = np.array([ends[k] - a for k, a, _ in rows], dtype=np.int64)
        points = points_of(s)[ragged(np.array([a for _, a, _ in rows], dtype=np.int64), size)]
        self.place, self.last, self.length = p.lattice(points, size, np.array([b - a for _, a, b in rows], dtype=np.int64))
        self.matrices: list[dict] = [{} for _ in entries]
        for i, (k, a, b) in enumerate(rows):
            cut = cuts[k + 1]
            for end in range(max(cut, b, a + 1), (ends[k] if cut < len(s) else cut) + 1):
                at = int(self.place[i]) + end - a
                if self.last[at] >= 0 and (start := end - int(self.length[at])) < cut:
                    self.matrices[k].setdefault((a, b), {})[start, end] = 0.0

    def back(self, entry: tuple[int, int], leave: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces after the state `entry` of the first cut, up to and with the state `leave` of the last; and their number."""
        prefixes = scan([{entry: self.matrices[0].get(entry, {})}, *self.matrices[1:]])
        states = [leave]  # of each cut, the one state on the way
        for k in range(len(self.matrices) - 1, 0, -1):
            reach = prefixes[k - 1][entry]
            states.append(next(e for e, to in self.matrices[k].items() if e in reach and states[-1] in to))
        states = [entry, *reversed(states)]
        rows = np.array([self.row[k, e] for k, e in enumerate(states[:-1])])
        till = np.array([b[1] - a[0] for a, b in zip(states, states[1:], strict=False)])
        stop = np.array([a[1] - a[0] for a in states[:-1]])
        numbers, n = self.p.back(self.last, self.length, self.place[rows], till, stop)
        return numbers, np.array([n.sum()])


def product(a: dict, b: dict) -> dict:
    """(max, +) product of sparse matrices."""
    out: dict = {}
    for i, row in a.items():
        new: dict = {}
        for k, v in row.items():
            for j, w in b.get(k, {}).items():
                new[j] = max(new.get(j, float("-inf")), v + w)
        out[i] = new
    return out


def scan(matrices: list[dict]) -> list[dict]:
    """All prefix products, by halves: pairs are combined, scanned, and give the places between."""
    if len(matrices) == 1:
        return matrices
    halves = scan([product(matrices[i], matrices[i + 1]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)])
    return [
        halves[i // 2] if i % 2 else matrices[0] if i == 0 else product(halves[i // 2 - 1], matrices[i]) for i in range(len(matrices))
    ]


class Chunk:
    """A chunk of a text between two cuts, with what stands round it: places count from `base` in the whole text."""

    def __init__(self, p: Pieces, left: str, body: str, right: str, first: bool, last: bool, base: int) -> None:
        self.p, self.s, self.base = p, left + body + right, base
        self.l, self.r = len(left), len(left) + len(body)
        entries = [(0, 0)] if first else p.states(self.s, self.l)
        points = points_of(self.s)
        safe = [c for c in np.flatnonzero(p.safe(points)).tolist() if self.l < c < self.r]
        self.last = last
        if safe:  # only what is before the first safe place and after the last one needs states
            self.a, self.b = safe[0], safe[-1]
            self.head = Segments(p, self.s[: self.a], [self.l, self.a], [entries])
            tail = self.s[self.b :]
            self.tail = Segments(p, tail, [0, self.r - self.b], [[(0, 0)]])
            to = {(x + self.b, y + self.b): 0.0 for x, y in self.tail.matrices[0].get((0, 0), {})}
            self.matrix = {e: to for e in self.head.matrices[0]}
        else:
            self.a = self.b = 0
            cuts = [self.l, *range(self.l + SEGMENT, self.r - SEGMENT // 2, SEGMENT), self.r]
            self.head = p.segments(self.s, cuts, entries)
            self.matrix = functools.reduce(product, self.head.matrices)

    def whole(self) -> dict:
        """The matrix, by places in the whole text; all states of a text's end are one."""
        move = lambda e: (e[0] + self.base, e[1] + self.base)
        return {move(e): {move(x): w for x, w in to.items()} for e, to in self.matrix.items()}

    def ids(self, entry: tuple[int, int], leave: tuple[int, int]) -> tuple[np.ndarray, str]:
        """Pieces between two states, and the text they are."""
        entry, leave = ((e[0] - self.base, e[1] - self.base) for e in (entry, leave))
        said = self.s[entry[1] : leave[1]]
        if not self.b:
            return self.head.back(entry, leave)[0], said
        middle = points_of(self.s[self.a : self.b])
        return np.concatenate([
            self.head.back(entry, max(self.head.matrices[0][entry]))[0],
            self.p.pieces(middle, np.array([len(middle)]))[0],
            self.tail.back((0, 0), (leave[0] - self.b, leave[1] - self.b))[0],
        ]), said


def points_of(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def string(points: np.ndarray) -> str:
    return points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def batches(texts: list[str]) -> list[list[str]]:
    """Texts in turn, some `TOGETHER` characters each."""
    out: list[list[str]] = []
    n = TOGETHER
    for t in texts:
        if n >= TOGETHER:
            out.append([])
            n = 0
        out[-1].append(t)
        n += len(t)
    return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def normal(text: str, first: bool = True) -> str:
    return (MARK if first else "") + text.replace(" ", MARK) if text else ""


def chunks(docs: DataFrame, key: str, text: str, chunk: int) -> tuple[DataFrame, DataFrame]:
    """(key, row, source) of the texts of one chunk, which stay where they are; and (key, row, chunk, n_chunks, left, source,
    right) of the chunks of longer ones, normalized, with `AROUND` characters on both sides, in a table of their own, so that a
    row's number means the same in every pass."""
    kind = docs.schema[key].dataType.simpleString()

    def cut(batch: pa.RecordBatch) -> list:
        at: list[int] = []
        cols: list[list] = [[], [], [], [], []]
        for i, t in enumerate(batch.column(2).to_pylist()):
            s = normal(t)
            starts = range(0, len(s), chunk)
            at += [i] * len(starts)
            for k, a in enumerate(starts):
                for c, v in zip(cols, (k, len(starts), s[max(0, a - AROUND) : a], s[a : a + chunk], s[a + chunk : a + chunk + AROUND]), strict=True):
                    c.append(v)
        rows = pa.array(at, pa.int64())
        return [batch.column(0).take(rows), batch.column(1).take(rows), *cols]

    fields = f"{key} {kind}, row long, chunk int, n_chunks int, left string, source string, right string"
    source = F.coalesce(F.col(text), F.lit(""))
    numbered = docs.select(F.col(key), F.monotonically_increasing_id().alias("row"), source.alias("source"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = map_arrow(numbered.where(F.length("source") > chunk), cut, fields)
    return numbered.where(F.length("source") <= chunk), Written(long.repartition(n, "row", "chunk"), "chunks").df


#: Characters that a chunk sees of its neighbours: more than any piece has.
AROUND = 64


def _chunk(p: Pieces, r: dict, chunk: int) -> Chunk:
    return Chunk(p, r["left"], r["source"], r["right"], r["chunk"] == 0, r["chunk"] == r["n_chunks"] - 1, r["chunk"] * chunk - len(r["left"]))


def routed(dealt: DataFrame, chunk: int, load) -> DataFrame:  # noqa: ANN001
    """`dealt` with the states that each chunk begins and ends with."""

    def matrix(batch: pa.RecordBatch, p: Pieces) -> list:
        found = [_chunk(p, r, chunk).whole() for r in batch.to_pylist()]
        return [batch.column(1), batch.column(2), [json.dumps([[e, list(to)] for e, to in m.items()]) for m in found]]

    def route(batch: pa.RecordBatch) -> list:
        out: list[list] = [[], [], [], []]
        for row, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ms = [{tuple(e): {tuple(x): 0.0 for x in to} for e, to in json.loads(m["matrix"])} for m in parts]
            prefixes = scan(ms)
            states = [max(prefixes[-1][0, 0])]
            for k in range(len(ms) - 1, 0, -1):
                reach = prefixes[k - 1][0, 0]
                states.append(next(e for e, to in ms[k].items() if e in reach and states[-1] in to))
            states = [(0, 0), *reversed(states)]
            for c, v in zip(out, ([row] * len(ms), range(len(ms)), map(list, states[:-1]), map(list, states[1:])), strict=True):
                c += v
        return out

    # A group is one text's matrices, a few hundred numbers for each 65536 characters.
    found = map_arrow(dealt, matrix, "row long, chunk int, matrix string", load)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("parts"))
    ways = map_arrow(found, route, "row long, chunk int, entry array<long>, leave array<long>")
    return dealt.join(ways, ["row", "chunk"])


def _binary(ids: np.ndarray, edge: np.ndarray) -> pa.Array:
    """Ids of each row as little-endian unsigned 32 bits."""
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer((4 * edge).astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])


def coded(docs: DataFrame, key: str, text: str, model: str | None, chunk: int, digest: bool) -> tuple[DataFrame, DataFrame]:
    """(key, row, chunk, n_chunks) of texts of one chunk, and of the chunks of others, and for digests (n_tokens, ids as
    binary, same), else (source, ids): `source` is the text that the ids are, `same` whether they decode to it."""
    kind = docs.schema[key].dataType.simpleString()
    fields = f"{key} {kind}, row long, chunk int, n_chunks int, " + ("n_tokens long, ids binary, same boolean" if digest else "source string, ids array<int>")
    out = to_arrow(docs.sparkSession, fields)

    def load() -> Pieces:
        return pieces(model or public_tokenizers.path(DEFAULT))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = load()
        for batch in stream:
            at = 0
            for part in batches(batch.column(2).to_pylist()):
                rows = batch.slice(at, len(part))
                at += len(part)
                said = [normal(t) for t in part]
                size = np.fromiter(map(len, said), dtype=np.int64, count=len(said))
                points = points_of("".join(said))
                ids, n = p.pieces(points, size)
                edge = np.r_[0, np.cumsum(n)]
                cols = [rows.column(0), rows.column(1), pa.array(np.zeros(len(part), np.int32)), pa.array(np.ones(len(part), np.int32))]
                if digest:
                    same = p.spells(ids, n, points, size) & np.array([MARK not in t for t in part], dtype=bool)
                    cols += [pa.array(n), _binary(ids, edge), pa.array(same)]
                else:
                    cols += [rows.column(2), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    def trace(batch: pa.RecordBatch, p: Pieces) -> list:
        cols: list[list] = [[], [], []] if digest else [[], []]
        for r in batch.to_pylist():
            got, said = _chunk(p, r, chunk).ids(tuple(r["entry"]), tuple(r["leave"]))
            ids, plain = got.tolist(), said.replace(MARK, " ")
            plain = plain[1:] if r["chunk"] == 0 else plain
            same = digest and p.decode(ids, r["chunk"] == 0) == plain
            for c, v in zip(cols, (len(ids), got.astype("<u4").tobytes(), same) if digest else (plain, ids), strict=True):
                c.append(v)
        at = batch.schema.names.index
        return [batch.column(at(key)), batch.column(at("row")), batch.column(at("chunk")), batch.column(at("n_chunks")), *cols]

    whole, dealt = chunks(docs, key, text, chunk)
    return whole.mapInArrow(run, fields), map_arrow(routed(dealt, chunk, load), trace, fields, load)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(key, row, chunk, n_chunks, source, ids): one row per chunk, `source` being the text that its ids are."""
    whole, dealt = coded(docs, key, text, model, chunk, False)
    return whole.unionByName(dealt)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """`encoded` with `decoded`, chunk by chunk."""

    def run(batch: pa.RecordBatch, p: Pieces) -> list:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        pairs = zip(batch.column(at["ids"]).to_pylist(), batch.column(at["chunk"]).to_pylist(), strict=True)
        return [*batch.columns, [p.decode(x, c == 0) for x, c in pairs]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_arrow(encoded, run, f"{fields}, decoded string", lambda: pieces(model or public_tokenizers.path(DEFAULT)))


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(key, n_tokens, ids_crc32, round_trip) per row; the chunks of a giant text are coded apart and put together."""
    whole, dealt = coded(docs, key, text, model, chunk, True)
    small = whole.select(key, "n_tokens", F.crc32("ids").alias("ids_crc32"), F.col("same").alias("round_trip"))
    # A group is the chunks of one text, no larger than the text itself.
    parts = dealt.groupBy("row", key).agg(
        F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk", "ids"))).alias("parts"), F.every("same").alias("round_trip")
    )
    joined = F.expr("crc32(aggregate(transform(parts, p -> p.ids), X'', (a, b) -> concat(a, b)))")
    return small.unionByName(parts.select(key, "n_tokens", joined.alias("ids_crc32"), "round_trip"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, CRC-32 of its ids (little-endian unsigned 32 bits), and whether it decodes to itself."""
    docs = table(spark, sf_dir, "documents")
    return digests(docs)
