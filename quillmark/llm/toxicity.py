"""Toxicity of texts that hide their words: noisy-channel restoration, then a word score."""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import bounded_sample, fold, small, texts, Batches

#: What a written sign may stand for.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Signs that writers put between letters.
FILL = ".-_*~'"
SIGN_COST, FILL_COST, REPEAT_COST, KEEP_COST = 0.7, 0.5, 0.3, 5.0
#: Letters a-z are 1 to 26, other letters 27, a word's edge 0.
N = 28
REMEMBERED = 300_000
FEATURE_BITS = 18

_EDGE = re.compile(r"^[^\w@$!|+€]+|(?:([^\w\s])\1{2,}|[.,;:!?)\]}\"'»”…]+)+$")
_SINGLES = re.compile(r"(?<!\S)[a-z0-9@$!|+€](?:[ ._\-*][a-z0-9@$!|+€]){2,}(?!\S)")
_RUN = re.compile(r"([^\W\d_])\1\1")


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27


def lm_counts(docs: DataFrame) -> DataFrame:
    """gram long, n long: character 4-grams of all words, as base-28 numbers, over all given rows."""

    def run(batches: Batches) -> Batches:
        sums = np.zeros(N**4, dtype=np.int64)
        kind = np.full(256, 27, dtype=np.int64)
        kind[ord("a") : ord("z") + 1] = np.arange(1, 27)
        kind[[*b" \t\n\r\x0b\x0c!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", *b"0123456789"]] = 0
        for batch in small(batches):
            for t in texts(batch, 0):
                # letters beyond a-z become one byte each
                b = kind[np.frombuffer(b" " + t.lower().encode("latin-1", "replace").replace(b"?", b" ") + b" ", dtype=np.uint8)]
                b = b[np.concatenate([[True], (b[1:] != 0) | (b[:-1] != 0)])]
                if len(b) > 3:
                    b = np.concatenate([[0, 0], b])
                    sums += np.bincount(((b[:-3] * N + b[1:-2]) * N + b[2:-1]) * N + b[3:], minlength=N**4)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], ["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def log_lm(counts: dict[int, int]) -> np.ndarray:
    """log P(fourth | three before), each order smoothed with the next lower one."""
    c4 = np.zeros(N**4)
    for g, n in counts.items():
        c4[g] = n
    c4 = c4.reshape(N, N, N, N)
    p = (c4.sum((0, 1, 2)) + 1) / (c4.sum() + N)
    for axes in ((0, 1), (0,), ()):
        c = c4.sum(axes) if axes else c4
        p = (c + 5 * p) / (c.sum(-1, keepdims=True) + 5)
    return np.log(p).astype(np.float32)


class Restorer:
    def __init__(self, lm: np.ndarray):
        self.lm, self.known = lm, {}

    def lattice(self, written: str, spaced: bool) -> list[list[tuple[str, float]]]:
        """For each sign or run of one letter, the strings it may stand for and what each costs."""
        out: list[list[tuple[str, float]]] = []
        for m in re.finditer(r"(.)\1*", written, re.S):
            c, n = m[1], len(m[0])
            if c.isalpha():
                if n < 3:
                    out.append([(m[0], 0.0)])
                else:
                    out.append([(c, REPEAT_COST * (n - 1)), (c * 2, REPEAT_COST * (n - 2))])
            elif c in SIGNS:
                out += [[(s, SIGN_COST) for s in SIGNS[c]] + [("", KEEP_COST)]] * n
            elif c == " " and spaced:
                out.append([("", 0.0), (" ", 0.0)])
            elif c in FILL:
                out.append([("", FILL_COST), (" ", FILL_COST)])
            else:
                out.append([(" ", 0.0)])
        return out

    def decode(self, written: str, spaced: bool = False) -> str:
        """The likeliest reading: Viterbi over the lattice, a state being the last three symbols."""
        lm = self.lm
        best: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        for options in [*self.lattice(written, spaced), [(" ", 0.0)]]:
            after: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for (a, b, c), (lost, path) in best.items():
                for s, cost in options:
                    x, y, z, total = a, b, c, lost + cost
                    for ch in s:
                        k = 0 if ch == " " else symbol(ch)
                        if k or z:
                            total -= float(lm[x, y, z, k])
                            x, y, z = (y, z, k) if k else (0, 0, 0)
                    if (x, y, z) not in after or total < after[x, y, z][0]:
                        after[x, y, z] = (total, (path, s))
            best = after
        path, out = min(best.values(), key=lambda v: v[0])[1], []
        while path:
            path, s = path
            out.append(s)
        return "".join(reversed(out))

    def word(self, token: str) -> tuple[str, ...]:
        """Restored words of one lower-cased token. Plain words have one reading and skip the lattice."""
        core = _EDGE.sub("", token)
        if core.isalpha() and not _RUN.search(core):
            return (core,)
        got = self.known.get(core)
        if got is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if any(map(str.isalpha, core)) or (len(core) > 2 and any(c in SIGNS for c in core) and not core.isdigit() and not re.fullmatch(r"[\d.,:/+()-]+", core)):
                got = tuple(w for w in self.decode(core).split() if w)
            else:
                got = ()
            self.known[core] = got
        return got

    def words(self, text: str) -> set[str]:
        """Distinct restored words of a text; runs of single letters are read as one stretch."""
        low = text.lower()
        out: set[str] = set()
        for m in _SINGLES.finditer(low):
            stretch = re.sub(r"[ ._\-*]", " ", m[0])
            out.update(self.decode(stretch, spaced=True).split())
        for token in set(low.split()):
            out.update(self.word(token))
        return out

    def text(self, text: str) -> str:
        """The restored text, words joined by blanks."""
        low = _SINGLES.sub(lambda m: self.decode(re.sub(r"[ ._\-*]", " ", m[0]), spaced=True), text.lower())
        return " ".join(w for token in low.split() for w in self.word(token))


def features(word: str) -> tuple[int, ...]:
    """Hashed buckets of the word and of its first four and five letters."""
    out = []
    for kind, part in enumerate((word, word[:4], word[:5])):
        if kind == 0 or len(word) > 3 + kind:
            h = 2166136261 + kind
            for b in part.encode():
                h = (h ^ b) * 16777619 & 0xFFFFFFFF
            out.append((h * 2654435761 & 0xFFFFFFFF) >> (32 - FEATURE_BITS))
    return tuple(out)


class Model(NamedTuple):
    lm: np.ndarray
    weight: np.ndarray
    coef: np.ndarray


#: A text's figures: its three heaviest words, the mean of the ten heaviest, how many weigh much.
FIGURES, MUCH = 5, 1.2


class Scorer:
    """Evidence of a text, weighed by logistic regression: the weights of its most telling words."""

    def __init__(self, model: Model):
        self.model, self.restore, self.known = model, Restorer(model.lm), {}

    def evidence(self, text: str) -> list[float]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = []
        words = self.restore.words(text)
        for w in words:
            x = self.known.get(w)
            if x is None:
                x = self.known[w] = max(float(self.model.weight[f]) for f in features(w))
            if x > 0:
                found.append(x)
        top = [*sorted(found, reverse=True)[:10], *[0.0] * 10][:10]
        much = sum(1 for x in found if x > MUCH)
        return [*top[:3], sum(top) / 10, float(np.sqrt(much / np.sqrt(len(words) + 20)))]

    def __call__(self, text: str) -> float:
        z = self.model.coef[0] + float(np.dot(self.model.coef[1:], self.evidence(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 100) -> np.ndarray:
    """Newton steps for a ridge-penalized logistic regression with intercept."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * len(a) * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * len(a) * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, prior: float = 25.0) -> Model:
    """Learn from rows whose fold (crc32 of the id, mod 3) isn't 1, and from nothing else.

    The character model counts all of these texts. Word weights and their calibration come from at
    most sample_rows labelled rows: weights from three fifths of them, calibration from the rest.
    What reaches the driver is bounded by 28^4 grams, 2^18 buckets and sample_rows figures. Null ids and
    labels other than 0 and 1 take no part, nor do ids that bear both labels; a label said again counts
    once, and of rows that repeat an id each is learned from."""
    spark = docs.sparkSession
    lm = log_lm({r.gram: r.n for r in lm_counts(docs.where(fold("doc_id", 3) != 1)).collect()})
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
    agreed = marked.where(fold("id", 3) != 1).groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other")
    picked = bounded_sample(agreed.select("id", "toxic"), "id", sample_rows)
    seen = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) < 3).alias("first"))
    shared = spark.sparkContext.broadcast(lm)

    def count(batches: Batches) -> Batches:
        restore, sums = Restorer(shared.value), np.zeros((2, 1 << FEATURE_BITS), dtype=np.int64)
        rows = np.zeros(2, dtype=np.int64)
        for batch in small(batches):
            for t, y in zip(texts(batch, 0), batch.column(1).to_pylist()):
                sums[y, list({f for w in restore.words(t) for f in features(w)})] += 1
                rows[y] += 1
        for y in (0, 1):
            at = np.flatnonzero(sums[y])
            yield pa.RecordBatch.from_arrays([pa.array([y] * (len(at) + 1), pa.int32()), pa.array([-1, *at], pa.int64()), pa.array([rows[y], *sums[y][at]], pa.int64())], ["toxic", "feature", "n"])

    n = np.zeros((2, (1 << FEATURE_BITS) + 1))
    for r in seen.where("first").select("text", "toxic").mapInArrow(count, "toxic int, feature long, n long").groupBy("toxic", "feature").agg(F.sum("n").alias("n")).collect():
        n[r.toxic, r.feature] = r.n  # -1, the last, counts rows
    share = (n[:, -1] + 1) / (n[:, -1].sum() + 2)
    weight = np.log((n[1, :-1] + prior * share[1]) / (n[1, -1] + 1)) - np.log((n[0, :-1] + prior * share[0]) / (n[0, -1] + 1)) - np.log(share[1] / (n[1, -1] + 1)) + np.log(share[0] / (n[0, -1] + 1))
    part = spark.sparkContext.broadcast(Model(lm, weight.astype(np.float32), np.zeros(1 + FIGURES)))

    def measure(batches: Batches) -> Batches:
        scorer = Scorer(part.value)
        for batch in small(batches):
            x = np.array([scorer.evidence(t) for t in texts(batch, 0)], dtype=np.float64).reshape(-1, FIGURES)
            yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    got = seen.where("not first").select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int").collect()
    rows = np.array(sorted((*r.x, r.toxic) for r in got), dtype=float).reshape(-1, FIGURES + 1)
    return Model(lm, weight.astype(np.float32), logistic(rows[:, :FIGURES], rows[:, FIGURES]) if len(rows) else np.array([-2.0, 0.5, *[0.0] * (FIGURES - 1)]))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every row, whole texts read.

    A null or empty text has no evidence and gets the score of a text without telling words.
    Repeated rows score alike, one result a row. Where no label can be learned from, scores stay
    below the threshold for texts without evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        scorer = Scorer(shared.value)
        for batch in small(batches):
            s = [scorer(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")
