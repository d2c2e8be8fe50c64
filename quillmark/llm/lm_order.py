"""The part of language-model scores that follows reading order: is a token the one that stood there the last
time the same two words, or the same word, came before in its text?

Each such question is a bit. Predictors under hashed contexts (how well the context has foretold so far, the
words about it) are mixed by gated weights and refined, as the bits of spelled words are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillmark.llm.common import Batches

CLIP, BINS = 12.0, 33
SMALL = 10  # bits of the contexts made of counters
#: Contexts that hold words grow with the vocabulary up to so many bits; beyond, words share slots.
MOST_BITS = 18
COUNTED, WORDED = 3, 3
PREDICTORS = COUNTED + WORDED
GATES = 8
#: Tokens that are looked at together; a longer text is looked at alone.
TOGETHER = 20_000
#: Questions after which weights and counts move.
STEP = 4096


class Read(NamedTuple):
    """Texts as numbers: every token's word, its text, and each distinct word's length and mark."""

    words: list[bytes]
    column: pa.Array  # the words once more
    token: np.ndarray
    text: np.ndarray
    size: np.ndarray
    mark: np.ndarray


def read_texts(given: pa.Array, end: bytes) -> Read:
    """Of texts, null as the empty one: their words, A-Z in lower case, as UTF-8, each text closed by `end`."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(given, "")))
    every = split.flatten()
    some = pc.greater(pc.binary_length(every), 0)  # blanks at an edge leave an empty word beside them
    text = np.repeat(np.arange(len(given)), np.diff(split.offsets.to_numpy()))[some.to_numpy(zero_copy_only=False)]
    told = every.filter(some).dictionary_encode()
    column = pa.concat_arrays([told.dictionary.cast(pa.binary()), pa.array([end], pa.binary())])
    words = column.to_numpy(zero_copy_only=False).tolist()
    token = np.full(len(text) + len(given), len(words) - 1)
    token[np.arange(len(text)) + text] = told.indices.to_numpy()
    every_text = np.repeat(np.arange(len(given)), np.bincount(text, minlength=len(given)) + 1)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    return Read(words, column, token, every_text, size, np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)))


def read(split: list[list[bytes]], end: bytes) -> Read:
    """Of tokenized texts."""
    return read_texts(pa.array([b" ".join(words).decode() for words in split], pa.string()), end)


class Before(NamedTuple):
    """What a context of each token has been followed by so far."""

    group: np.ndarray  # a number for each distinct context
    foretold: np.ndarray  # the word it was last followed by, -1 if it is new
    hit: np.ndarray
    seen: np.ndarray  # how often it has come
    good: np.ndarray  # how often it foretold rightly
    run: np.ndarray  # tokens in a row, up to the one before, that this kind of context foretold rightly


def looked_back(context: np.ndarray, token: np.ndarray) -> Before:
    n = len(token)
    if n < 1 << 20 and int(context.max()) < 1 << 43:
        keys = np.sort((context << 20) | np.arange(n))
        order, context = keys & ((1 << 20) - 1), keys >> 20
    else:
        order = np.argsort(context, kind="stable")
        context = context[order]
    head = np.concatenate([[True], context[1:] != context[:-1]])
    first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    said = token[order]
    foretold = np.where(head, -1, np.concatenate([[-1], said[:-1]]))
    hit = foretold == said
    hits = np.cumsum(hit) - hit
    out = [np.empty(n, dtype=np.int64) for _ in range(4)]
    for x, y in zip(out, (np.cumsum(head) - 1, foretold, np.arange(n) - first, hits - hits[first])):
        x[order] = y
    group, foretold, seen, good = out
    hit = foretold == token
    missed = np.maximum.accumulate(np.where(hit, -1, np.arange(n)))  # a text's first token always misses
    run = np.concatenate([[0], np.arange(n - 1) - missed[:-1]])
    return Before(group, foretold, hit, seen, good, run)


class Bits(NamedTuple):
    """The questions asked about some tokens, those by two words first."""

    token: np.ndarray
    bit: np.ndarray
    gate: np.ndarray
    slots: np.ndarray  # [predictor, question]


def questions(r: Read, bits: int) -> Bits:
    new = np.concatenate([[True], r.text[1:] != r.text[:-1]])
    start = len(r.words)  # what stands before a text
    one = np.where(new, start, np.concatenate([[start], r.token[:-1]]))
    two = np.where(new, start, np.concatenate([[start], one[:-1]]))
    by_one = looked_back(r.text * (start + 1) + one, r.token)
    by_two = looked_back(by_one.group * (start + 1) + two, r.token)
    ask_two = np.flatnonzero(by_two.foretold >= 0)
    ask_one = np.flatnonzero((by_one.foretold >= 0) & ~by_two.hit & (by_one.foretold != by_two.foretold))
    mark = np.append(r.mark, np.uint64(0))
    parts = []
    for k, (at, own, other) in enumerate(((ask_two, by_two, by_one), (ask_one, by_one, by_two))):
        run, far = np.minimum(own.run[at], 15), np.minimum(other.run[at], 15)
        seen, good = np.minimum(own.seen[at], 15), np.minimum(own.good[at], 15)
        said = own.foretold[at]
        size = np.minimum(r.size[said], 15)
        counters = [run * 16 + seen, seen * 16 + good, size * 16 + far]
        words = [mark[said], mark[one[at]] + np.uint64(1 << 32), mark[said] * np.uint64(0x9E3779B97F4A7C15) + mark[one[at]]]
        slots = [i * (1 << SMALL) + k * 512 + x for i, x in enumerate(counters)]
        for i, x in enumerate(words):
            h = (x * np.uint64(2) + np.uint64(k)) * np.uint64(0xC2B2AE3D27D4EB4F)
            slots.append(COUNTED * (1 << SMALL) + (i << bits) + (h >> np.uint64(64 - bits)).astype(np.int64))
        parts.append((at, own.hit[at].astype(np.int64), k * 4 + np.minimum(run, 3), np.array(slots, dtype=np.int64).reshape(PREDICTORS, -1)))
    a, b = parts
    return Bits(*(np.concatenate([x, y], axis=-1) for x, y in zip(a, b)))


class Order(NamedTuple):
    bits: int
    counts: np.ndarray  # [bit, slot]
    weights: np.ndarray  # [gate, predictor, and one for every gate itself]
    refine: np.ndarray  # [bit, gate, bin]: what came of the mixer's outputs


def start(bits: int) -> Order:
    weights = np.full((GATES, PREDICTORS + 1), 0.25)
    weights[:, -1] = 0
    return Order(bits, np.zeros((2, COUNTED * (1 << SMALL) + (WORDED << bits))), weights, np.zeros((2, GATES, BINS)))


def stretched(counts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Each predictor's log odds of a hit; an unseen context expects one in five."""
    return np.concatenate([np.log((counts[1][slots] + 0.1) / (counts[0][slots] + 0.4)), np.ones((1, slots.shape[1]))])


def mixed(m: Order, q: Bits) -> tuple[np.ndarray, np.ndarray]:
    """Inputs, and the gated mixer's log odds."""
    st = stretched(m.counts, q.slots)
    return st, np.clip((m.weights[q.gate].T * st).sum(0), -CLIP, CLIP)


def bins(z: np.ndarray) -> np.ndarray:
    return np.rint((z + CLIP) * ((BINS - 1) / (2 * CLIP))).astype(np.int64)


def probabilities(m: Order, q: Bits) -> np.ndarray:
    """Of a hit: the average of the mixer's and what came of such outputs in training."""
    z = mixed(m, q)[1]
    p, at = 1 / (1 + np.exp(-z)), bins(z)
    n0, n1 = m.refine[0, q.gate, at], m.refine[1, q.gate, at]
    return np.clip((p + (n1 + 4 * p) / (n0 + n1 + 4)) / 2, 1e-6, 1 - 1e-6)


def learned(m: Order, q: Bits, curve: np.ndarray, rate: float = 0.3) -> None:
    """One step: the mixer answers, its weights move by its errors, then the contexts count what came."""
    st, z = mixed(m, q)
    p, n = 1 / (1 + np.exp(-z)), GATES * (PREDICTORS + 1)
    m.refine.reshape(-1)[:] += np.bincount((q.bit * GATES + q.gate) * BINS + bins(z), minlength=m.refine.size)
    error, bend = q.bit - p, p * (1 - p) * np.abs(st).sum(0)
    keys = q.gate * (PREDICTORS + 1) + np.arange(PREDICTORS + 1)[:, None]
    curve *= 0.995
    curve += np.bincount(keys.ravel(), (np.abs(st) * bend).ravel(), n)
    m.weights.reshape(-1)[:] += rate * np.bincount(keys.ravel(), (st * error).ravel(), n) / (curve + 50)
    np.add.at(m.counts.reshape(-1), (q.bit * m.counts.shape[1] + q.slots).ravel(), 1.0)


def together(r: Read) -> Iterator[Read]:
    """Texts in groups of some TOGETHER tokens, longer ones alone. A text's result doesn't depend on its group."""
    ends = np.cumsum(np.bincount(r.text)).tolist()
    first = begin = 0
    for k, end in enumerate(ends):
        if k > first and end - 1 - begin > TOGETHER:
            yield r._replace(token=r.token[begin : ends[k - 1]], text=r.text[begin : ends[k - 1]] - first)
            first, begin = k, ends[k - 1]
    yield r._replace(token=r.token[begin:], text=r.text[begin:] - first)


#: Sums that travel together.
BLOCK = 1024


def added_up(batches: Batches) -> Batches:
    """Blocks of sums, each number's rows added up."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[k] = sums.get(k, 0) + np.frombuffer(x)
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "x"])


def train(docs: DataFrame, distinct: int, end: bytes) -> Order:
    """One online pass of every task over the texts it reads, in order. The tasks' counts are summed up by blocks,
    their weights averaged by how many questions they met. The driver gets the sums, some 2 * 3 * 2^MOST_BITS
    numbers at most. An empty table leaves the model as it starts."""
    bits = min(MOST_BITS, max(12, distinct.bit_length()))

    def run(batches: Batches) -> Batches:
        m, curve, asked = start(bits), np.full(GATES * (PREDICTORS + 1), 50.0), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                for group in together(read_texts(batch.column(0).slice(at, 500), end)):
                    q = questions(group, bits)
                    asked += len(q.bit)
                    for k in range(0, len(q.bit), STEP):
                        learned(m, Bits(*(x[..., k : k + STEP] for x in q)), curve)
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no buffers
        flat = np.concatenate([m.counts.reshape(-1), m.refine.reshape(-1), m.weights.reshape(-1) * asked, [asked]])
        blocks = {k: flat[k * BLOCK : (k + 1) * BLOCK] for k in range(-(-len(flat) // BLOCK))}
        some = {k: x.tobytes() for k, x in blocks.items() if x.any()}
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(some.values(), pa.binary())], ["block", "x"])

    found = docs.select("text").mapInArrow(run, "block int, x binary").repartition(docs.sparkSession.sparkContext.defaultParallelism, "block").mapInArrow(added_up, "block int, x binary").toArrow()
    m = start(bits)
    flat = np.zeros(m.counts.size + m.refine.size + m.weights.size + 1)
    for k, x in zip(found["block"].to_pylist(), found["x"].to_pylist()):
        flat[k * BLOCK : (k + 1) * BLOCK] = np.frombuffer(x)
    counts, refine, weights, asked = np.split(flat, np.cumsum([m.counts.size, m.refine.size, m.weights.size]))
    m = m._replace(counts=counts.reshape(m.counts.shape).astype(np.float32), refine=refine.reshape(m.refine.shape))
    return m._replace(weights=weights.reshape(m.weights.shape) / asked) if asked[0] else m


class Heard(NamedTuple):
    """Of each token: log10 of its questions' answers, and whether one of them named it, so that it isn't spelled."""

    log10: np.ndarray
    named: np.ndarray


def heard(m: Order, r: Read) -> Heard:
    q = questions(r, m.bits)
    p = probabilities(m, q)
    total, named = np.bincount(q.token, np.log10(np.where(q.bit == 1, p, 1 - p)), minlength=len(r.token)), np.zeros(len(r.token), dtype=bool)
    named[q.token[q.bit == 1]] = True
    return Heard(total, named)
