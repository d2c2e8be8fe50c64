"""Language-model scores by online logistic context mixing.

A text is told token by token, in order. First come the questions of `lm_order`: is it the token that followed
the same two words, or the same word, before. If not, its word is spelled, bit by bit, under contexts inside the
word and the text's class. So what earlier words say enters by the questions; the spelling of a word looks back
no further than its own start, which lets each distinct word be spelled once whatever the number of texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import lm_order
from quillmark.llm.common import Batches, fold, spread_join, written

#: Predictors: so many bytes before (inside the word), 0 for the whole word so far; with the text's class or without.
ORDERS = ((1, True), (2, True), (3, True), (4, False), (0, False), (0, True))
#: Texts fall into classes by their short words, which carry a text's language.
CLASSES, SHORT, CELLS = 6, 4, 512
LEVELS = 10  # how often a context was seen, as a power of two
END = b""  # the text's end: a word of no bytes
CLIP, BINS = 12.0, 33
OWN_SHARE = 0.2  # weight of a word's plain share of the training tokens beside the mixer


class ShortWords(NamedTuple):
    """Of some texts: the cells that their short words fall into, how often, and the text of each."""

    cell: np.ndarray
    n: np.ndarray
    text: np.ndarray


def short_words(r: lm_order.Read) -> ShortWords:
    """By text, in the order in which cells are first met."""
    short = (r.size > 0) & (r.size <= SHORT)
    at = np.flatnonzero(short[r.token])
    cell = (r.mark % np.uint64(CELLS)).astype(np.int64)[r.token[at]]
    each, first, n = np.unique(r.text[at] * CELLS + cell, return_index=True, return_counts=True)
    order = np.argsort(first)
    return ShortWords(each[order] % CELLS, n[order], each[order] // CELLS)


class Classes(NamedTuple):
    """A mixture of CLASSES word distributions. A text's score pays for naming its class, so it stays
    a probability: P(text) >= P(class) P(text | class)."""

    log_share: np.ndarray
    log_cell: np.ndarray  # [class, cell]

    def of_each(self, s: ShortWords, n_texts: int) -> np.ndarray:
        """The class of each of some texts."""
        return np.stack([share + np.bincount(s.text, row[s.cell] * s.n, n_texts) for share, row in zip(self.log_share, self.log_cell)]).argmax(0)


def classes(docs: DataFrame, rounds: int = 8) -> Classes:
    """Expectation maximization (hard assignments) over all given rows, each round one pass over the
    written counts of short words; a round gives the driver CLASSES x CELLS sums. It starts from up to 256
    rows of more than ten cells, chosen by hash; where there are none, classes start alike."""

    def cells_of(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                given = batch.column(0).slice(at, 500)
                s = short_words(lm_order.read_texts(given, END))
                ends = np.cumsum(np.bincount(s.text, minlength=len(given)))[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in np.split(column, ends)], pa.binary()) for column in (s.cell.astype("<u2"), s.n.astype("<u4"))], ["cells", "n"])

    def read(cells: list[bytes], n: list[bytes]) -> ShortWords:
        cell = np.frombuffer(b"".join(cells), "<u2").astype(np.int64)
        return ShortWords(cell, np.frombuffer(b"".join(n), "<u4").astype(np.float64), np.repeat(np.arange(len(cells)), [len(x) // 2 for x in cells]))

    rows = written(docs.select("text").mapInArrow(cells_of, "cells binary, n binary"), "short-words")
    seeds = np.zeros((256, CELLS))
    for k, r in enumerate(rows.where(F.length("cells") > 20).orderBy(F.xxhash64("cells", "n"), "cells", "n").limit(len(seeds)).collect()):
        s = read([r.cells], [r.n])
        seeds[k, s.cell] = np.sqrt(s.n / s.n.sum())
    picked = [0]  # each further seed is the one least like those before
    while len(picked) < CLASSES:
        picked.append(int((seeds @ seeds[picked].T).max(1).argmin()))
    start = np.square(seeds[picked]) * 100 + np.square(seeds).mean(0) * 20 + 0.05
    found = Classes(np.full(CLASSES, -np.log(CLASSES)), np.log(start / start.sum(1, keepdims=True)))
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def assign(batches: Batches) -> Batches:
            sums = np.zeros((CLASSES, CELLS + 1))
            for batch in batches:
                s = read(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                k = shared.value.of_each(s, batch.num_rows)
                sums += np.bincount(k[s.text] * (CELLS + 1) + s.cell, s.n, sums.size).reshape(sums.shape)
                sums[:, CELLS] += np.bincount(k, minlength=CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.reshape(-1))], ["k", "x"])

        sums = np.zeros(CLASSES * (CELLS + 1))
        for r in rows.mapInArrow(assign, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
            sums[r.k] = r.x
        sums = sums.reshape(CLASSES, -1) + 0.5
        found = Classes(np.log(sums[:, -1] / sums[:, -1].sum()), np.log(sums[:, :-1] / sums[:, :-1].sum(1, keepdims=True)))
    return found


def word_counts(docs: DataFrame, kinds: Classes, held: int = 400_000) -> DataFrame:
    """word binary, class int, n long: tokens of all given rows, each row's end counted as the empty word.

    Tasks add up what they have met before anything is shuffled, at most some `held` words at a time."""

    def run(batches: Batches) -> Batches:
        waiting: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(waiting).group_by(["word", "class"], use_threads=False).aggregate([("n", "sum")]).select(["word", "class", "n_sum"]).rename_columns(["word", "class", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                r = lm_order.read_texts(batch.column(0).slice(at, 500), END)
                kind = kinds.of_each(short_words(r), min(500, batch.num_rows - at))
                each, n = np.unique(r.token * CLASSES + kind[r.text], return_counts=True)
                waiting.append(pa.table({"word": r.column.take(pa.array(each // CLASSES)), "class": pa.array((each % CLASSES).astype(np.int32)), "n": pa.array(n)}))
                if sum(x.num_rows for x in waiting) > 2 * held:
                    waiting = [summed()]
                    if waiting[0].num_rows > held:
                        yield from waiting.pop().to_batches(100_000)
        if waiting:
            yield from summed().to_batches(100_000)
            waiting.clear()
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no buffers

    return docs.select("text").mapInArrow(run, "word binary, class int, n long").groupBy("word", "class").agg(F.sum("n").alias("n"))


class Code(NamedTuple):
    """How a byte is told bit by bit: the more frequent, the fewer."""

    size: np.ndarray  # bits of each byte
    node: np.ndarray  # [byte, step]: which of the tree's 255 forks is asked
    bit: np.ndarray  # [byte, step]
    rank: np.ndarray  # place of each byte from left to right in the tree


def code_of(counts: np.ndarray) -> Code:
    """The code of least length for bytes met that often, each once more so that all have one."""
    heap = [(int(n) + 1, b) for b, n in enumerate(counts)]
    heapq.heapify(heap)
    forks: list[tuple[int, int]] = []
    while len(heap) > 1:
        (n, x), (m, y) = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (n + m, 256 + len(forks)))
        forks.append((x, y))
    paths: dict[int, list[tuple[int, int]]] = {}
    todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][1], [])]
    while todo:
        at, path = todo.pop()
        if at < 256:
            paths[at] = path
        else:
            todo += [(forks[at - 256][k], [*path, (at - 256, k)]) for k in (1, 0)]
    wide = max(map(len, paths.values()))
    code = Code(np.zeros(256, dtype=np.int64), np.zeros((256, wide), dtype=np.int64), np.zeros((256, wide), dtype=np.int64), np.zeros(256, dtype=np.int64))
    for rank, (b, path) in enumerate(paths.items()):
        code.size[b], code.rank[b] = len(path), rank
        code.node[b, : len(path)], code.bit[b, : len(path)] = zip(*path)
    return code


#: All bytes in eight bits.
EVEN = code_of(np.zeros(256))


def byte_code(by_class: DataFrame) -> Code:
    """By how often the words counted hold each byte; a blank closes every word."""

    def run(batches: Batches) -> Batches:
        sums = np.zeros(256)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
            sums += np.bincount(np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8), np.repeat(n, size), 256)[:256] if words else 0
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(sums)], ["byte", "n"])

    counts = np.zeros(256)
    for r in by_class.select("word", "n").mapInArrow(run, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[r.byte] = r.n
    return code_of(counts)


#: What a fork of the code does to a context's key.
NODE = np.random.default_rng(11).integers(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64)
#: The word so far is looked up by key while it has so few bytes; from there on among the words that start alike.
SHALLOW = 4


class Bits(NamedTuple):
    """All bits of some words, each word closed by a blank: steps over every byte that has that many bits."""

    owner: np.ndarray  # the word of each byte
    byte: np.ndarray
    deep: np.ndarray  # the bytes that stand behind SHALLOW others or more
    keys: list[np.ndarray]  # by predictor: each byte's context before a bit is known, in 64 bits
    code: Code

    def steps(self, first: int = 0, last: int | None = None) -> Iterator[tuple[np.ndarray, list[np.ndarray], np.ndarray]]:
        """For each step: the bytes (of those from `first` to `last`) that take it, the predictors' contexts, and the bit."""
        at = np.arange(first, len(self.byte) if last is None else last)
        for k in range(self.code.node.shape[1]):
            at = at[self.code.size[self.byte[at]] > k]
            if not len(at):
                return
            b = self.byte[at]
            turn = NODE[self.code.node[b, k]]
            yield at, [s[at] ^ turn for s in self.keys], self.code.bit[b, k]


class Spelled(NamedTuple):
    """All bytes of some words, each word closed by a blank."""

    byte: np.ndarray
    owner: np.ndarray  # the word of each byte
    start: np.ndarray  # where that word starts
    at: np.ndarray  # the byte's place in it


def spelled_out(words: list[bytes]) -> Spelled:
    b = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    start = np.repeat(np.cumsum(size) - size, size)
    return Spelled(b, np.repeat(np.arange(len(words)), size), start, np.arange(len(b)) - start)


def bits_of(words: list[bytes], kinds: list[int], code: Code = EVEN, only: np.ndarray | None = None) -> Bits:
    """Of all bytes, or of those at the places `only`."""
    b, owner, start, at = spelled_out(words)
    b = b.astype(np.uint64)
    # the word so far: a sum of its bytes, each by its place's factor, is the difference of two running sums
    place = np.random.default_rng(7).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    term = (b + np.uint64(1)) * place[at & 63] * (np.uint64(2) * (at >> 6).astype(np.uint64) + np.uint64(1))
    run = np.cumsum(term) - term
    every, whole = b, np.arange(len(b)) if only is None else only
    b, owner, start, at = b[whole], owner[whole], start[whole], at[whole]
    # the k-th byte before, 256 where the word hasn't begun
    before = [np.where(at < k, np.uint64(256), every[np.maximum(whole - k, 0)]) for k in range(1, 5)]
    contexts, h = {}, np.zeros(len(b), dtype=np.uint64)
    for k in range(1, 5):
        h = (h + before[k - 1] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        contexts[k] = h * np.uint64(2 * k + 1)
    contexts[0] = (run[whole] - run[start]) ^ np.uint64(0xA5A5A5A5)
    kind = (np.array(kinds, dtype=np.uint64)[owner] + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    keys = []
    for order, by_class in ORDERS:
        x = (contexts[order] + kind if by_class else contexts[order]) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys.append(x ^ (x >> np.uint64(32)))
    return Bits(owner, b.astype(np.int64), at >= SHALLOW, keys, code)


class Starts(NamedTuple):
    """What some words spell, with what words of one class start alike in told once."""

    bits: Bits  # of each distinct start, its last byte
    start: np.ndarray  # of each byte of the words, place among the starts
    owner: np.ndarray  # of each byte of the words


def starts_of(words: list[bytes], kinds: list[int], code: Code = EVEN, asked: int | None = None) -> Starts:
    """All that is asked about a byte depends on its class and the word up to it: words that stand beside each other
    when sorted share the starts that they have in common. The starts of the first `asked` words come first."""
    order = pc.sort_indices(pa.array(words, pa.binary())).to_numpy()
    order = order[np.argsort(np.array(kinds)[order], kind="stable")].tolist()
    words, kinds = [words[i] for i in order], [kinds[i] for i in order]
    b, owner, start, at = spelled_out(words)
    first = np.flatnonzero(at == 0)
    size, kind, above = np.diff(np.append(first, len(b))), np.array(kinds), np.concatenate([[0], first[:-1]])
    over = np.concatenate([[0], np.where(kind[1:] == kind[:-1], size[:-1], 0)])  # bytes of the word before, if of that class
    same = (at < over[owner]) & (b == b[np.minimum(above[owner] + at, len(b) - 1)])
    shared = np.minimum.reduceat(np.where(same, len(b), at), first)
    new = at >= shared[owner]
    # a shared start is the last new one at its place
    turn = np.argsort(at.astype(np.uint16) if size.max() <= 1 << 16 else at, kind="stable")
    last = np.empty(len(b), dtype=np.int64)
    last[turn] = turn[np.maximum.accumulate(np.where(new[turn], np.arange(len(b)), 0))]
    number = np.cumsum(new) - 1
    own, only, of = number[last], np.flatnonzero(new), np.array(order)[owner]
    if asked is not None:
        used = np.zeros(len(only), dtype=bool)
        used[own[of < asked]] = True
        by = np.argsort(~used, kind="stable")
        only, place = only[by], np.empty_like(by)
        place[by] = np.arange(len(by))
        own = place[own]
    return Starts(bits_of(words, kinds, code, only), own, of)


#: Starts of words that are told together.
TOGETHER = 20_000
#: Words of a bucket, on average; those that start with the same SHALLOW bytes share one.
BUCKET = 20_000


def parts_for(df: DataFrame, buckets: int) -> int:
    return min(buckets, max(buckets // 4, 4 * df.sparkSession.sparkContext.defaultParallelism))


def gathered(words: DataFrame, buckets: int, name: str, columns: list[str]) -> DataFrame:
    """bucket int, and the list of the bucket's rows: all words that start alike stand in one row."""
    placed = words.select(F.pmod(F.xxhash64(F.substring("word", 1, SHALLOW)), F.lit(buckets)).cast("int").alias("bucket"), *columns)
    return placed.repartition(parts_for(words, buckets), "bucket").groupBy("bucket").agg(F.collect_list(F.struct(*columns)).alias(name))


def members(column: pa.Array, k: int) -> list[list]:
    """By column, what the k-th bucket's list holds."""
    return [x.to_numpy(zero_copy_only=False).tolist() for x in column[k].values.flatten()] if column[k].is_valid else []


def parted(words: list[bytes]) -> Iterator[list[int]]:
    """Places of the words, by parts of a bucket or more that share no start with one another."""
    column, at = pa.array(words, pa.binary()), 0
    order = pc.sort_indices(column)
    begin = pc.binary_slice(column.take(order), 0, SHALLOW)
    cuts = np.append(np.flatnonzero(pc.not_equal(begin[1:], begin[:-1]).to_numpy(zero_copy_only=False)) + 1, len(words))
    order = order.to_pylist()
    while at < len(words):
        end = int(cuts[min(np.searchsorted(cuts, at + BUCKET), len(cuts) - 1)])
        yield order[at:end]
        at = end


class Pairs(NamedTuple):
    """Contexts of a predictor with the bytes that followed them: each once, sorted by context and the byte's rank."""

    sort: np.ndarray  # the context without its last 8 bits, and there the rank
    key: np.ndarray  # the context
    byte: np.ndarray
    n: np.ndarray


def paired(found: list[Pairs]) -> Pairs:
    """All given pairs, equal ones added up."""
    sort, key, byte, n = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(sort)
    sort = sort[order]
    first = np.flatnonzero(np.concatenate([[True], sort[1:] != sort[:-1]])) if len(sort) else order
    own = order[first]
    return Pairs(sort[first], key[own], byte[own], np.add.reduceat(n[order], first) if len(first) else n)


def bits_of_pairs(x: Pairs, code: Code) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each step: contexts with the bits so far, and how often they saw 0 and 1. Bytes that begin with the
    same bits are neighbours in rank, so equal ones stand together."""
    at = np.arange(len(x.key))
    for k in range(code.node.shape[1]):
        at = at[code.size[x.byte[at]] > k]
        if not len(at):
            return
        b, n, context = x.byte[at], x.n[at], x.sort[at] >> np.uint64(8)
        node = code.node[b, k]
        first = np.flatnonzero(np.concatenate([[True], (context[1:] != context[:-1]) | (node[1:] != node[:-1])]))
        n1 = np.add.reduceat(n * code.bit[b, k], first)
        yield x.key[at[first]] ^ NODE[node[first]], np.add.reduceat(n, first) - n1, n1


def context_counts(buckets: DataFrame, code: Code = EVEN, held: int = 1_000_000) -> DataFrame:
    """predictor int, key long, n0 double, n1 double: how often each context that is looked up by key saw
    each bit, over all words. Tasks add up contexts and bytes, some `held` pairs at most, before they
    tell them bit by bit and hand them on."""

    def run(batches: Batches) -> Batches:
        waiting: list[list[Pairs]] = [[] for _ in ORDERS]

        def out() -> Batches:
            for i, own in enumerate(waiting):
                for key, n0, n1 in bits_of_pairs(own[0], code) if own else ():
                    for k in range(0, len(key), 100_000):
                        part = slice(k, k + 100_000)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), i, dtype=np.int32)), pa.array(key[part].view(np.int64)), pa.array(n0[part]), pa.array(n1[part])], ["predictor", "key", "n0", "n1"])
                own.clear()

        for batch in batches:
            for row in range(batch.num_rows):
                words, kinds, n = members(batch.column(0), row)
                for at in range(0, len(words), BUCKET):
                    some, start, owner = starts_of(words[at : at + BUCKET], kinds[at : at + BUCKET], code)
                    weight, rank = np.bincount(start, np.array(n[at : at + BUCKET], dtype=np.float64)[owner]), code.rank[some.byte].astype(np.uint64)
                    for i, (order, _) in enumerate(ORDERS):
                        near = slice(None) if order else ~some.deep
                        key = some.keys[i][near]
                        fresh = paired([Pairs((key & ~np.uint64(255)) | rank[near], key, some.byte[near], weight[near])])
                        waiting[i] = [paired([*waiting[i], fresh]) if waiting[i] else fresh]
                    if sum(len(x[0].key) for x in waiting) > held:
                        yield from out()
        yield from out()

    found = buckets.select("words").mapInArrow(run, "predictor int, key long, n0 double, n1 double")
    return found.groupBy("predictor", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


class Model(NamedTuple):
    """What is small of the model; the bit counts are broadcast once beside it."""

    table_bits: tuple[int, ...]  # by predictor: its part of the table has 2^bits slots
    code: Code
    weights: np.ndarray  # [gate, predictor, level]
    refine: np.ndarray  # [gate, bin]: probability of a 1 where the mixer said about this


def start_model(table_bits: int | tuple[int, ...], code: Code = EVEN) -> Model:
    weights = np.zeros((LEVELS, len(ORDERS), LEVELS))
    weights += 0.3
    centers = 1 / (1 + np.exp(-np.linspace(-CLIP, CLIP, BINS)))
    return Model((table_bits,) * len(ORDERS) if isinstance(table_bits, int) else table_bits, code, weights, np.tile(centers, (LEVELS, 1)))


#: A context's stretched prediction and level in one number: the level in the lowest bits.
LEVEL_BITS, FINE = 4, 4096


def encoded(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    stretch = np.clip(np.log((n1 + 0.02) / (n0 + 0.02)), -CLIP, CLIP)
    level = np.minimum(np.log2(n0 + n1 + 1).astype(np.int32), LEVELS - 1)
    return (np.rint(stretch * FINE).astype(np.int32) << LEVEL_BITS) | level


class Table(NamedTuple):
    """The contexts that are looked up by key: slots in order, counts and checks of those seen."""

    slot: np.ndarray
    counts: np.ndarray  # [bit, context]
    check: np.ndarray
    size: int


class Lookup(NamedTuple):
    """Predictions and levels, as they are broadcast. `value`: by context, 0 first for none; with `unmet` by bit
    and context, one sighting of that bit taken out of the counts, as for a word that the counts have not met.
    `check`: whose it is, so that a context that found its slot taken counts as unseen. `taken`: a bit for each
    slot, `before`: how many slots are taken before those of each 64. Without them each slot is a context."""

    value: np.ndarray
    check: np.ndarray | None = None
    taken: np.ndarray | None = None
    before: np.ndarray | None = None

    def places(self, slot: np.ndarray) -> np.ndarray:
        if self.taken is None:
            return slot
        word, bit = slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64)
        taken = self.taken.take(word)
        return (self.before.take(word) + np.bitwise_count(taken & (bit - np.uint64(1))) + 1) * ((taken & bit) != 0)


def looked_up(counts: np.ndarray, unmet: bool = False) -> Lookup:
    out = np.zeros((2, counts.shape[1]) if unmet else counts.shape[1], dtype=np.int32)
    for at in range(0, counts.shape[1], 100_000):
        part = slice(at, at + 100_000)
        n0, n1 = counts[:, part]
        if unmet:
            out[0, part], out[1, part] = encoded(np.maximum(n0 - 1, 0), n1), encoded(n0, np.maximum(n1 - 1, 0))
        else:
            out[part] = encoded(n0, n1)
    return Lookup(out)


def opened(table: Table, unmet: bool = False) -> Lookup:
    taken = np.zeros(-(-table.size // 64), dtype=np.uint64)
    np.bitwise_or.at(taken, table.slot >> 6, np.uint64(1) << (table.slot & 63).astype(np.uint64))
    n = np.bitwise_count(taken).astype(np.int32)
    known = looked_up(np.pad(table.counts, ((0, 0), (1, 0))), unmet)
    return known._replace(check=np.pad(table.check, (1, 0)), taken=taken, before=np.cumsum(n, dtype=np.int32) - n)


def slots_of(keys: np.ndarray, predictor: int, table_bits: tuple[int, ...]) -> np.ndarray:
    return (keys & np.uint64((1 << table_bits[predictor]) - 1)).astype(np.int64) + sum(1 << b for b in table_bits[:predictor])


def checks_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(32)).astype(np.uint32)


def sized(counts: DataFrame) -> tuple[tuple[int, ...], Table]:
    """Of `context_counts`: bits by predictor, and the table. There are two slots or more for each context
    counted; of those that share a slot the one seen more often has it."""
    counts = written(counts, "contexts")
    n = {r.predictor: r["count"] for r in counts.groupBy("predictor").count().collect()}
    table_bits = tuple(max(8, (2 * n.get(i, 0) - 1).bit_length()) for i in range(len(ORDERS)))
    slots, tables, checks = [], [], []
    for i in range(len(ORDERS)):
        got = counts.where(F.col("predictor") == i).select("key", "n0", "n1").toArrow()
        key, n0, n1 = got["key"].to_numpy().view(np.uint64), got["n0"].to_numpy(), got["n1"].to_numpy()
        order = np.lexsort((key, -(n0 + n1)))
        at, first = np.unique(slots_of(key[order], i, table_bits), return_index=True)
        own = order[first]
        slots.append(at)
        tables.append(np.stack([n0[own], n1[own]]).astype(np.float32))
        checks.append(checks_of(key[own]))
    return table_bits, Table(np.concatenate(slots).astype(np.uint32), np.concatenate(tables, axis=1), np.concatenate(checks), sum(1 << b for b in table_bits))


def counts_among(context: np.ndarray, byte: np.ndarray, weight: np.ndarray, code: Code, unmet: bool) -> np.ndarray:
    """All bits of the first byte, then those of the next: what is known of the byte's context and bits so far, as
    `encoded`, from how often (by weight) 0 and 1 followed among all given bytes. Exact: equal ones stand
    together when sorted."""
    _, at = np.unique(context, return_inverse=True)
    order = np.argsort(at * 256 + code.rank[byte], kind="stable")
    size = code.size[byte]
    first, out = np.cumsum(size) - size, np.empty(size.sum(), dtype=np.int32)
    turn = order
    for k in range(code.node.shape[1]):
        turn = turn[size[turn] > k]
        if not len(turn):
            break
        b, c, w = byte[turn], at[turn], weight[turn]
        node, bit = code.node[b, k], code.bit[b, k]
        run = np.cumsum(np.concatenate([[True], (c[1:] != c[:-1]) | (node[1:] != node[:-1])])) - 1
        ones = np.bincount(run, w * bit)
        zeros = np.bincount(run, w) - ones
        n0, n1 = zeros[run], ones[run]
        out[first[turn] + k] = encoded(np.maximum(n0 - (1 - bit), 0), np.maximum(n1 - bit, 0)) if unmet else encoded(n0, n1)
    return out


def steps_with(known: Lookup, table_bits: tuple[int, ...], some: Bits, weight: np.ndarray, unmet: bool, edges: np.ndarray | None = None) -> Iterator[tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """For each step: what each predictor has of it, as `encoded`, and the bit with the bytes it is of. `weight`:
    how often the counts have met each byte's word. `unmet`: with one sighting of the bit taken out. `edges`:
    one stretch of bytes after the other, each with all its steps; bytes beyond the last are only counted."""
    deep = np.flatnonzero(some.deep)
    among = {i: counts_among(some.keys[i][deep], some.byte[deep], weight[deep], some.code, unmet) for i, (order, _) in enumerate(ORDERS) if not order and len(deep)}
    size = np.where(some.deep, some.code.size[some.byte], 0)
    begin = np.cumsum(size) - size
    edges = np.array([0, len(some.byte)]) if edges is None else edges
    for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
        for step, (byte, keys, bit) in enumerate(some.steps(first, last)):
            got, far = [], some.deep[byte]
            near = np.flatnonzero(~far)
            far = np.flatnonzero(far)
            for i, (order, _) in enumerate(ORDERS):
                key, b = (keys[i], bit) if order else (keys[i][near], bit[near])
                at = known.places(slots_of(key, i, table_bits))
                x = known.value.reshape(-1).take(at + b * known.value.shape[1] if unmet else at)
                if known.check is not None:
                    x *= known.check.take(at) == checks_of(key)
                if not order:
                    whole = np.zeros(len(bit), dtype=np.int32)
                    whole[near] = x
                    if len(far):
                        whole[far] = among[i][begin[byte[far]] + step]
                    x = whole
                got.append(x)
            yield got, (bit, byte)


def inputs(got: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each predictor's stretched predictions and levels."""
    return [(x >> LEVEL_BITS) * (1 / FINE) for x in got], [x & ((1 << LEVEL_BITS) - 1) for x in got]


def weight_keys(level: list[np.ndarray]) -> list[np.ndarray]:
    """Places of the predictors' weights. The gate: how often the word so far was seen."""
    gate = level[-1] * (len(ORDERS) * LEVELS)
    return [gate + (i * LEVELS) + x for i, x in enumerate(level)]


def mixed(weights: np.ndarray, st: list[np.ndarray], keys: list[np.ndarray]) -> np.ndarray:
    """The gated mixer's stretched probability of a 1."""
    z = weights[keys[0]] * st[0]
    for k, x in zip(keys[1:], st[1:]):
        z += weights[k] * x
    return np.clip(z, -CLIP, CLIP)


#: Steps of the mixer's output for which final probabilities are laid down.
STEPS = 64


def final_logs(model: Model) -> np.ndarray:
    """[bit, gate, step] log10 probability: the average of the mixer's and its adaptive refinement,
    which lies between those of the two nearest bins."""
    z = np.linspace(-CLIP, CLIP, int(2 * CLIP * STEPS) + 1)
    x = (z + CLIP) * ((BINS - 1) / (2 * CLIP))
    k = np.minimum(x.astype(np.int64), BINS - 2)
    r = model.refine[:, k] * (k + 1 - x) + model.refine[:, k + 1] * (x - k)
    p = np.clip((1 / (1 + np.exp(-z)) + r) / 2, 1e-7, 1 - 1e-7)
    return np.log10(np.stack([1 - p, p]))


def learn(buckets: DataFrame, table: Broadcast, model: Model, rate: float = 0.3) -> Model:
    """One online pass of every task over the starts of its words, mini-batch by mini-batch in a drawn order, each
    weight stepping by its error over the curvature met lately, while the refinement counts what comes of
    the mixer's outputs. The tasks' weights are averaged by how many bits they saw, their counts added up.
    A start counts as often as its words were met, each time as if it were one more, unseen, sighting."""
    table_bits, n_weights, n_refine = model.table_bits, model.weights.size, model.refine.size

    def turns_of(batches: Batches):
        known = table.value
        for batch in batches:
            for row in range(batch.num_rows):
                words, kinds, times = members(batch.column(0), row)
                for part in parted(words):
                    some, start, owner = starts_of([words[i] for i in part], [kinds[i] for i in part], model.code)
                    drawn = np.random.default_rng(len(part)).permutation(len(some.byte))
                    some = Bits(some.owner[drawn], some.byte[drawn], some.deep[drawn], [x[drawn] for x in some.keys], some.code)
                    n = np.bincount(start, np.array([times[i] for i in part], dtype=np.float64)[owner])[drawn]
                    edges = np.linspace(0, len(drawn), -(-len(part) // 2000) + 1).astype(np.int64)
                    for got, (bit, byte) in steps_with(known, table_bits, some, n, True, edges):
                        yield got, bit, n[byte]

    def run(batches: Batches) -> Batches:
        own, seen = model.weights.reshape(-1).copy(), 0.0
        curve, ones, all_ = np.full(n_weights, 50.0), np.zeros(n_refine), np.zeros(n_refine)
        for got, bit, n in turns_of(batches):
            st, level = inputs(got)
            keys = weight_keys(level)
            z = mixed(own, st, keys)
            at = level[-1] * BINS + np.rint((z + CLIP) * ((BINS - 1) / (2 * CLIP))).astype(np.int64)
            ones += np.bincount(at, n * bit, minlength=n_refine)
            all_ += np.bincount(at, n, minlength=n_refine)
            p = 1 / (1 + np.exp(-z))
            error, bend = (bit - p) * n, p * (1 - p) * n
            curve *= 0.995
            bend *= sum(map(np.abs, st))  # predictors that agree move together: their steps are bounded jointly
            for key, x in zip(keys, st):
                grad = np.bincount(key, x * error, minlength=n_weights)
                curve += np.bincount(key, np.abs(x) * bend, minlength=n_weights)
                own += rate * grad / (curve + 50)
            seen += len(n)
        yield pa.RecordBatch.from_arrays([pa.array([0] * n_weights + [1] * n_refine, pa.int32()), pa.array([*range(n_weights), *range(n_refine)], pa.int32()), pa.array(np.concatenate([own * seen, ones])), pa.array(np.concatenate([np.full(n_weights, seen), all_]))], ["kind", "k", "x", "y"])

    fitted, refine = model.weights.reshape(-1).copy(), model.refine.reshape(-1).copy()
    for r in buckets.select("words").mapInArrow(run, "kind int, k int, x double, y double").groupBy("kind", "k").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect():
        if r.kind == 0 and r.y:
            fitted[r.k] = r.x / r.y
        elif r.kind == 1:
            refine[r.k] = (r.x + 4 * refine[r.k]) / (r.y + 4)
    return model._replace(weights=fitted.reshape(model.weights.shape), refine=refine.reshape(model.refine.shape))


class Speaker:
    """The model with its lookups, as tasks use it."""

    def __init__(self, model: Model, known: Lookup | np.ndarray):
        self.model, self.known, self.weights = model, known if isinstance(known, Lookup) else looked_up(known), model.weights.reshape(-1)
        self.logs = final_logs(model).reshape(-1)

    def log10_words(self, words: list[bytes], kinds: list[int], met: tuple[list[bytes], list[int], list[int]] = ([], [], [])) -> np.ndarray:
        """log10 probability of each word with its closing blank, in a text of the given class. `met`:
        words, classes and counts of the training words, all those at least that start as one of them."""
        out, wide = np.zeros(len(words)), int(2 * CLIP * STEPS) + 1
        all_words, all_kinds, times = [*words, *met[0]], [*kinds, *met[1]], np.array([*[0] * len(words), *met[2]], dtype=np.float64)
        for part in parted(all_words):
            asked = [i for i in part if i < len(words)]
            if not asked:
                continue
            part = asked + [i for i in part if i >= len(words)]
            some, start, owner = starts_of([all_words[i] for i in part], [all_kinds[i] for i in part], self.model.code, len(asked))
            own = owner < len(asked)
            size = int(start[own].max()) + 1  # the starts asked for come first
            total = np.zeros(size)
            edges = np.append(np.arange(0, size, TOGETHER), size)
            for got, (bit, byte) in steps_with(self.known, self.model.table_bits, some, np.bincount(start, times[part][owner]), False, edges):
                st, level = inputs(got)
                z = mixed(self.weights, st, weight_keys(level))
                total[byte] += self.logs[(bit * LEVELS + level[-1]) * wide + np.rint((z + CLIP) * STEPS).astype(np.int64)]
            out[asked] = np.bincount(owner[own], total[start[own]], minlength=len(asked))
        return out


class Trained(NamedTuple):
    model: Model
    table: Broadcast
    order: lm_order.Order
    kinds: Classes
    by_class: DataFrame
    counts: DataFrame
    buckets: DataFrame
    n_buckets: int
    train_tokens: int
    distinct: int


def train(docs: DataFrame) -> Trained:
    """Counts over all given rows, written to the shared folder, and the model fitted on them.

    The table of contexts of up to four bytes is sized by how many of them there are, and is what reaches
    the driver. Contexts of whole words, which grow with the words, stay in buckets of words that start alike."""
    kinds = classes(docs)
    by_class = written(word_counts(docs, kinds), "words")
    counts = written(by_class.groupBy("word").agg(F.sum("n").alias("n")), "totals")
    n, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_buckets = by_class.count() // BUCKET + 1
    buckets = written(gathered(by_class, n_buckets, "words", ["word", "class", "n"]), "buckets")
    code = byte_code(by_class)
    table_bits, table = sized(context_counts(buckets, code))
    share, model = docs.sparkSession.sparkContext.broadcast, start_model(table_bits, code)
    if n:
        unmet = share(opened(table, True))
        model = learn(buckets, unmet, model)
        unmet.destroy()
    return Trained(model, share(opened(table)), lm_order.train(docs, int(v), END), kinds, by_class, counts, buckets, n_buckets, int(n), int(v))


def spoken(queries: DataFrame, trained: Trained) -> DataFrame:
    """word, kind, c (how often met in training), p (log10): the mixer's probability of each given word in a
    text of the class, averaged with the word's share of the training tokens. Each meets, in its bucket, the
    training words that start alike."""
    n, model, table = max(1, trained.train_tokens), trained.model, trained.table

    def run(batches: Batches) -> Batches:
        speaker = Speaker(model, table.value)
        for batch in batches:
            for row in range(batch.num_rows):
                words, kinds = members(batch.column(0), row)
                met = members(batch.column(1), row) or [[], [], []]
                c: dict[bytes, int] = {}
                for w, k in zip(met[0], met[2]):
                    c[w] = c.get(w, 0) + k
                own = np.fromiter(map(c.get, words, repeat(0)), dtype=np.int64, count=len(words))
                p = np.log10((1 - OWN_SHARE) * 10 ** speaker.log10_words(words, kinds, met) + OWN_SHARE * own / n)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(kinds, pa.int32()), pa.array(own), pa.array(p)], ["word", "kind", "c", "p"])

    asked = gathered(queries, trained.n_buckets, "asked", ["word", "kind"])
    return asked.join(trained.buckets.repartition(parts_for(queries, trained.n_buckets), "bucket"), "bucket", "left").select("asked", "words").mapInArrow(run, "word binary, kind int, c long, p double")


class Common(NamedTuple):
    """The commonest words: each one's place, and by place log10(c + 1) and the log10 probabilities by class, NaN
    where no training text of the class holds the word."""

    place: dict[bytes, int]
    log_count: np.ndarray
    log_p: np.ndarray


def common_words(trained: Trained, most: int, longest: int) -> Common:
    """The `most` commonest words of at most `longest` bytes, and the 4096 commonest of up to 4096 bytes."""
    by_count = [F.desc("n"), F.asc("word")]
    size = F.length("word")
    chosen = trained.counts.where(size <= longest).orderBy(*by_count).limit(most).union(trained.counts.where((size > longest) & (size <= 4096)).orderBy(*by_count).limit(4096))
    asked = trained.by_class.join(F.broadcast(chosen.select("word")), "word").select("word", F.col("class").alias("kind"))
    got = spoken(asked, trained).toArrow()
    place: dict[bytes, int] = {}
    at = np.array([place.setdefault(w, len(place)) for w in got["word"].to_pylist()], dtype=np.int64)
    counts, p = np.zeros(len(place)), np.full((len(place), CLASSES), np.nan)
    counts[at] = got["c"].to_numpy()
    p[at, got["kind"].to_numpy()] = got["p"].to_numpy()
    return Common(place, np.log10(counts + 1), p)


SUMS = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]


def told(ids: list, r: lm_order.Read, place: np.ndarray, first_row: int, common: Common, kinds: Classes, order: lm_order.Order) -> pa.RecordBatch:
    """A row for each text with its sums over common words, and one for each other word of each text, also for a
    common word that no training text of its class holds. `place`: of each distinct word among the common ones, or -1."""
    n = len(ids)
    h, kind = lm_order.heard(order, r), kinds.of_each(short_words(r), n)
    place = place[r.token]
    met, spelled = place >= 0, ~h.named
    p = np.full(len(place), np.nan)
    p[met] = common.log_p[place[met], kind[r.text[met]]]
    met = ~np.isnan(p)
    add_up = lambda of, x=None: np.bincount(r.text[of], None if x is None else x[of], n)
    n_tokens = add_up(slice(None))
    base, said = np.zeros(len(place)), np.zeros(len(place))
    base[met] = common.log_count[place[met]]
    both = met & spelled
    said[both] = p[both]
    score = add_up(slice(None), said + h.log10) + kinds.log_share[kind] / np.log(10)
    size = add_up(slice(None), r.size[r.token]).astype(np.int64) + n_tokens
    pairs, inverse, tf = np.unique(r.text[~met] * len(r.words) + r.token[~met], return_inverse=True, return_counts=True)
    text, word = pairs // len(r.words), pairs % len(r.words)
    rest = len(pairs)
    head = [
        pa.array(first_row + np.concatenate([np.arange(n), text])),
        pa.concat_arrays([pa.array([b""] * n, pa.binary()), r.column.take(pa.array(word))]),
        pa.array(np.concatenate([kind, kind[text]]).astype(np.int32)),
        pa.array(np.concatenate([np.zeros(n, dtype=np.int64), tf])),
        pa.array(np.concatenate([np.zeros(n, dtype=np.int64), np.bincount(inverse, spelled[~met], rest).astype(np.int64)])),
    ]
    own = [ids, n_tokens, add_up(met), add_up(met, base), score, size]
    tail = [pa.concat_arrays([pa.array(x, t), pa.nulls(rest, t)]) for x, (_, t) in zip(own, SUMS)]
    return pa.RecordBatch.from_arrays([*head, *tail], ["row", "word", "kind", "tf", "spelled", *(c for c, _ in SUMS)])


def score(docs: DataFrame, trained: Trained, frequent: int = 1 << 18, longest: int = 64) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10) and bits_per_byte of every row.

    A spelled word's probability is the mixer's, averaged with its share of the training tokens (OWN_SHARE),
    which is none for an unknown word.

    The `frequent` commonest words of at most `longest` bytes, and some longer ones, travel to every task with
    their counts and probabilities (that bounds the broadcast). All other words are spelled once for each class
    of texts they stand in and come by a join, one row for each text and word; long ones, of which one may be
    in very many texts, by parts. A null or empty text is its end alone. Rows are told apart by their place, so
    repeated rows and null ids each give a row. An empty training set gives c = 0 and N = 0.
    """
    spark, kinds = docs.sparkSession, trained.kinds
    order = spark.sparkContext.broadcast(trained.order)
    shared = spark.sparkContext.broadcast(common_words(trained, frequent, longest))
    schema = "row long, word binary, kind int, tf long, spelled long, doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long"

    def run(batches: Batches) -> Batches:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, r, common = part.column(0).to_pylist(), lm_order.read_texts(part.column(1), END), shared.value
                place = np.fromiter(map(common.place.get, r.words, repeat(-1)), dtype=np.int64, count=len(r.words))
                for group in lm_order.together(r):
                    n = int(group.text[-1]) + 1
                    yield told(ids[:n], group, place, row, common, kinds, order.value)
                    ids, row = ids[n:], row + n
        pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no buffers

    found = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "found")
    rare = found.where("tf > 0").select("row", "word", "kind", "tf", "spelled")
    asked = written(spoken(rare.select("word", "kind").distinct(), trained), "spoken")
    short = F.length("word") <= longest
    said = rare.where(short).join(asked.where(short), ["word", "kind"]).unionByName(spread_join(rare.where(~short), asked.where(~short), ["word", "kind"], "row"))
    sums_of_rare = said.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).cast("long").alias("n_known"), (F.col("tf") * F.log10(F.col("c") + 1)).alias("base"), (F.col("spelled") * F.col("p")).alias("score"), F.lit(0).cast("long").alias("n_bytes"))
    parts = found.where("tf = 0").select("row", *(n for n, _ in SUMS)).union(sums_of_rare)
    floor = float(np.log10(trained.train_tokens + trained.distinct + 1))
    return (
        parts.groupBy("row")
        .agg(F.first("doc_id", ignorenulls=True).alias("doc_id"), *[F.sum(n).alias(n) for n, _ in SUMS[1:]])
        .select("doc_id", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"))
    )


def train_fold(docs: DataFrame) -> DataFrame:
    return docs.where(fold("doc_id", 7) != 2)
