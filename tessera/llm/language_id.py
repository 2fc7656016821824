"""Language ID by error-correcting output codes over byte n-grams.

Each language has a codeword; for each bit a binary classifier over hashed byte 2- and 3-grams of the whole text
learns which side a text is on. Decoding weighs each bit's logistic loss by how reliable the bit was in training
and takes the codeword of least loss; texts whose two nearest codewords are close are flagged as ambiguous.

The classifiers are fitted on a bounded sample: `SAMPLE` labelled rows in all, shared evenly by the languages
(those of smallest hash of their id, among rows whose crc32(id) mod 3 is not 1). Everything else runs over all rows.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text if nothing could be
learned; with one learned language every other text is of it; rows without an id are never learned from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table

DIMS = 4096
SAMPLE = 2400
STEPS, RATE, DECAY = 150, 8.0, 1e-5
AMBIGUOUS = 0.9
LETTER = regex.compile(r"\p{L}")
#: Bytes that are no letters of ASCII and no part of a longer character are one gap.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], dtype=np.uint32)


def features(texts: list[str]) -> np.ndarray:
    """Rows of square roots of hashed n-gram counts, of length 1."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    out = np.zeros((len(data), DIMS), dtype=np.float32)
    for i, d in enumerate(data):
        b = FOLD[np.frombuffer(b" " + d + b" ", dtype=np.uint8)]
        two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(20)
        three = (b[:-2] * np.uint32(0xC2B2AE35) + b[1:-1] * np.uint32(0x27D4EB2F) + b[2:] * np.uint32(0x165667B1)) >> np.uint32(20)
        out[i] = np.bincount(two, minlength=DIMS)
        out[i] += np.bincount(three, minlength=DIMS)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(m: int) -> np.ndarray:
    """m codewords of +1 and -1: exhaustive up to 6 languages, else seeded random ones of 15 log2 m bits."""
    if m <= 1:
        return np.ones((m, 0))
    if m <= 6:
        bits = np.arange(1, 2 ** (m - 1))
        return np.vstack([np.ones(len(bits)), *[np.where(bits >> r & 1, -1.0, 1.0) for r in range(m - 1)]])
    rng = np.random.default_rng(m)
    n = int(np.ceil(15 * np.log2(m)))
    code = rng.choice([-1.0, 1.0], size=(m, n))
    return code[:, np.abs(code.sum(axis=0)) < m]


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray) -> None:
        self.langs, self.code, self.weights, self.bias, self.trust = langs, code, weights, bias, trust

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        at = [i for i, t in enumerate(texts) if t and self.langs and LETTER.search(t)]
        for k in range(0, len(at), 64):
            part = at[k : k + 64]
            side = features([texts[i] for i in part]) @ self.weights + self.bias
            loss = (np.logaddexp(0, -side[:, None, :] * self.code[None]) * self.trust).sum(axis=2)
            like = np.exp(loss.min(axis=1, keepdims=True) - loss)
            like /= like.sum(axis=1, keepdims=True)
            for i, row in zip(part, like, strict=True):
                best = int(row.argmax())
                lang[i], score[i], unsure[i] = self.langs[best], float(min(1.0, row[best])), bool(row[best] < AMBIGUOUS)
        return lang, score, unsure


def fit(x: np.ndarray, y: list[str]) -> Model:
    langs = sorted(set(y))
    code = codewords(len(langs))
    want = code[[langs.index(v) for v in y]] if y else np.zeros((0, 0))
    w, b = np.zeros((DIMS, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    if not code.shape[1]:
        return Model(langs, code, w, b, np.ones(0))
    # Either side of a bit counts the same.
    share = np.where(want > 0, 1 / np.maximum((want > 0).sum(axis=0), 1), 1 / np.maximum((want < 0).sum(axis=0), 1)) / 2
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        pull = (share * want / (1 + np.exp(np.clip(want * (x @ w + b), -30, 30)))).astype(np.float32)
        vw = 0.9 * vw + x.T @ pull - DECAY * w
        vb = 0.9 * vb + pull.sum(axis=0)
        w, b = w + RATE * vw, b + RATE * 0.1 * vb
    loss = (share * np.logaddexp(0, -want * (x @ w + b))).sum(axis=0)
    trust = 1 / (0.01 + loss)
    return Model(langs, code, w, b, (trust / trust.mean()).astype(np.float32))


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    learn = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(
        "l is not null and t is not null and k is not null and crc32(cast(k as string)) % 3 <> 1"
    )
    counts = learn.groupBy("l").agg(F.count("*").alias("n"))
    each = max(1, sample // max(1, counts.count()))
    # Ids below a bound on their hash that some four times as many pass, so that no task reads more than those.
    place = F.pmod(F.xxhash64("k"), F.lit(1 << 40))
    near = learn.select("k", "l", place.alias("h")).join(counts, "l").where(F.col("h") < F.lit(4.0 * each * (1 << 40)) / F.col("n")).select("k", "l", "h").distinct()
    order = Window.partitionBy("l").orderBy("h", "k")
    ids = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= each).select("k", "l")

    def run(batch: pa.RecordBatch) -> list:
        texts = batch.column(0).to_pylist()
        rows = [features([t])[0] for t in texts]
        return [batch.column(1), [np.flatnonzero(r).tolist() for r in rows], [r[r != 0].tolist() for r in rows]]

    # Of rows that share id and language, the one of least text: at most `sample` rows are broadcast, or come back.
    chosen = learn.join(F.broadcast(ids), ["k", "l"], "left_semi").groupBy("k", "l").agg(F.min("t").alias("t")).orderBy("l", "k")
    rows = map_arrow(chosen.select("t", "l"), run, "l string, i array<int>, v array<float>").collect()
    x = np.zeros((len(rows), DIMS), dtype=np.float32)
    for j, r in enumerate(rows):
        x[j, r.i] = r.v
    return fit(x, [r.l for r in rows])


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> list:
        out: tuple[list, list, list] = ([], [], [])
        for i in range(0, batch.num_rows, 256):
            for c, v in zip(out, model.predict(batch.column(1).slice(i, 256).to_pylist()), strict=True):
                c += v
        return [batch.column(0), batch.column(2), *out]

    held = F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
    return map_arrow(
        docs.select(F.col(key), F.col(text), held.alias("held_out")),
        run,
        f"{key} {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean",
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
