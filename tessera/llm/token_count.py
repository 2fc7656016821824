"""Token counts: rank-synchronous merging of batched pre-tokens held as ragged numpy arrays.

A batch's distinct pre-tokens are laid end to end as one array of symbol ids. In each step every sequence merges
its lowest-rank pair (all its occurrences, left to right) at the same time; sequences without a known pair leave
the array. What is left of each sequence is its count, and a document's count is the sum over its pre-tokens.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a pre-token of any length is merged whole; repeated
rows are counted each; strings of special tokens inside a text are one token each, as the library's default.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

DEFAULT = "word_bpe_49k.json"
LIMIT = 2048
#: Pre-tokens whose counts a task remembers; older ones are counted again, so memory is bounded.
MEMORY = 400_000
NONE = np.int64(1) << 40


def _byte_chars() -> list[str]:
    """The printable stand-in for each byte used by byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    stand = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [stand[b] for b in range(256)]


class Counter:
    """Counts as the library does for a file with a byte-level split and word-end symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        self.steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, specials)))
        self.marks = [s for s in specials]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + self.suffix] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.size = len(vocab) + 1
        order = np.argsort(key := left * self.size + right, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.known: dict[str, int] = {}

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            # The library lower-cases character by character: no final form of sigma.
            return text.replace("Σ", "σ").lower()
        return text.lower()

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and its number of special tokens."""
        n, parts = 0, [text]
        if any(m in text for m in self.marks):
            n, parts = len(self.special.findall(text)), self.special.split(text)
        return [w for p in parts for w in self.split.findall(self.normal(p))], n

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * self.size + b
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], NONE)

    def merged(self, words: list[str]) -> np.ndarray:
        """Symbols left of each word after all merges."""
        data = [w.encode("utf-8") for w in words]
        length = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        ids, seq = self.inner[raw], np.repeat(np.arange(len(data)), length)
        last = np.cumsum(length) - 1
        ids[last[length > 0]] = self.final[raw[last[length > 0]]]
        out = np.zeros(len(data), dtype=np.int64)
        # A pair's rank stays until a merge touches it.
        rank = np.full(len(ids), NONE)
        if len(ids) > 1:
            same = seq[:-1] == seq[1:]
            rank[:-1] = np.where(same, self.ranks(ids[:-1], ids[1:]), NONE)
        while len(ids):
            start = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, start)
            count = np.diff(np.r_[start, len(ids)])
            done = low == NONE
            if done.any():
                out[seq[start[done]]] = count[done]
                stay = np.repeat(~done, count)
                ids, seq, rank = ids[stay], seq[stay], rank[stay]
                if not len(ids):
                    break
                low, count = low[~done], count[~done]
            hit = np.flatnonzero(rank == np.repeat(low, count))
            # Of overlapping occurrences (aaa), every second one of an unbroken run is merged, from the left.
            if len(hit) > 1 and (close := np.diff(hit) == 1).any():
                first = np.r_[True, ~close | (seq[hit[1:]] != seq[hit[:-1]])]
                run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            spot = (np.cumsum(keep) - 1)[hit]
            ids, seq, rank = ids[keep], seq[keep], rank[keep]
            rank[spot] = NONE
            for at in (spot, spot[spot > 0] - 1):  # new right and left neighbours
                at = at[at + 1 < len(ids)]
                pair = seq[at] == seq[at + 1]
                rank[at] = np.where(pair, self.ranks(ids[at], ids[at + 1]), NONE)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        fresh = list({w for ws, _ in split for w in ws if w not in known})
        step = 20_000
        for i in range(0, len(fresh), step):
            part = fresh[i : i + step]
            known.update(zip(part, self.merged(part).tolist(), strict=True))
        return [sum(map(known.__getitem__, ws)) + n for ws, n in split]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit for every row; `tokenizer` is a path, the default file's if None."""
    kind = docs.schema[key].dataType.simpleString()

    def setup() -> Counter:
        return counter(tokenizer or public_tokenizers.path(DEFAULT))

    def run(batch: pa.RecordBatch, c: Counter) -> list:
        n: list[int] = []
        size: list[int] = []
        for i in range(0, batch.num_rows, 256):
            texts = [t or "" for t in batch.column(1).slice(i, 256).to_pylist()]
            n += c.counts(texts)
            size += [len(t.encode("utf-8")) for t in texts]
        return [batch.column(0), size, n, [x > limit for x in n]]

    return map_arrow(docs.select(F.col(key), F.col(text)), run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean", setup)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
