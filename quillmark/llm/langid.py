"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import bounded_sample, fold, small, texts, Batches

BUCKET_BITS = 16
GRAMS = (2, 3, 4)


def grams(text: str) -> np.ndarray:
    """Buckets of all character n-grams (as bytes) of the lower-cased text, white space as one blank."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), dtype=np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(b) >= n:
            h = np.full(len(b) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= b[k : k + len(h)]
            h *= np.uint32(0x9E3779B1)
            out.append(h >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model(NamedTuple):
    """table[bucket] is its embedding times the softmax weights: the averaged embedding's logits are
    the average of these rows."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def __call__(self, text: str) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        z = (self.table[grams(text)].mean(0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 4, rate: float = 1.0, precision: float = 0.99, seed: int = 0) -> Model:
    """SGD over (lang, buckets, shares of the text's n-grams). Every fifth row is held back to fit
    the temperature (least log loss) and the rejection bound: the lowest confidence from which the
    answers above it reach the given precision."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 1, (1 << BUCKET_BITS, dim)).astype(np.float32) / dim
    w, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    y = np.array([langs.index(r[0]) for r in rows])
    held = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~held)
    steps, step = max(1, epochs * len(train)), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            _, at, share = rows[i]
            x = share @ e[at]
            g = softmax(x @ w + bias)
            g[y[i]] -= 1
            now = np.float32(rate * (1 - step / steps))
            back = w @ g
            w -= now * np.outer(x, g)
            bias -= now * np.float32(0.1) * g
            e[at] -= (now * share)[:, None] * back[None, :]
            step += 1
    table = (e @ w).astype(np.float32)
    test = np.flatnonzero(held) if held.any() else train
    z = np.array([rows[i][2] @ table[rows[i][1]] for i in test]) + bias
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(test)), y[test]] + 1e-12).mean()
    best = min((float(t) for t in np.geomspace(0.05, 20, 49)), key=loss)
    p = softmax(z / best)
    top, right = p.max(1), p.argmax(1) == y[test]
    order = np.argsort(-top, kind="stable")
    share_right = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share_right >= precision)
    return Model(langs, table, bias, best, float(top[order][good[-1]]) if len(good) else 1.0)


def train(docs: DataFrame, sample_rows: int = 6000) -> Model:
    """Fit on at most sample_rows rows with text, lang and a fold (crc32 of the id, mod 3) other than 1.

    Tasks turn texts into bucket shares (at most 2^16 pairs a row); the driver runs the SGD."""
    rows = docs.select("doc_id", "text", "lang").where((fold("doc_id", 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Batches) -> Batches:
        for batch in small(batches):
            out = []
            for lang, t in zip(batch.column(2).to_pylist(), texts(batch)):
                if has_letter(t):
                    at, n = np.unique(grams(t), return_counts=True)
                    out.append((lang, at.astype("<u4").tobytes(), (n / n.sum()).astype("<f4").tobytes()))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["lang", "at", "share"])

    found = bounded_sample(rows, "doc_id", sample_rows).mapInArrow(run, "lang string, at binary, share binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.share)))
    mixed = np.random.default_rng(1).permutation(len(found))
    return fit([(found[i].lang, np.frombuffer(found[i].at, "<u4"), np.frombuffer(found[i].share, "<f4")) for i in mixed])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted (the calibrated score reaches the rejection bound).

    Null, empty and letterless texts are `und` with score 0, as is everything where no row could
    be learned from. Whole texts are read. Repeated rows are predicted alike, one result a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 rows of one float a language

    def run(batches: Batches) -> Batches:
        for batch in small(batches):
            got = [shared.value(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[1] >= shared.value.reject_below and g[0] != "und" for g in got], pa.bool_())],
                ["doc_id", "lang_pred", "score", "accepted"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
