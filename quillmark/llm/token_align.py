"""Alignment of two tokenizers over the same bytes: groups between common ends, links between overlapping tokens."""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import written
from quillmark.llm.packing import byte_letters

#: Distinct stretches of text that a worker remembers, and as many older ones.
REMEMBERED = 400_000
#: A block of documents is closed when it has so many distinct pairs, counted by document.
BLOCK = 1 << 20
SPACE_MARK = "▁"
#: White space of any kind but the ASCII kind.
OTHER_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\x0b\f\r")
COMPACT = "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at array<int>, times array<int>, pairs array<long>, holders array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, n_best_b long, count_sum long, groups_sha256 string"
DETAIL = "doc_id string, groups array<struct<a:array<int>,b:array<int>>>, links array<struct<a:int,b:int>>"


#: What is known of a part of a text that begins and ends where tokens of both sides do: its groups as text, n_a,
#: n_b, n_groups, and an int64 for each link, the first side's id in its upper half and the second's in its lower.
Stretch = tuple[str, int, int, int, bytes]
Group = tuple[list[int], list[int]]


def merged(a: list[int], b: list[int], bytes_a: list[int], bytes_b: list[int]) -> tuple[list[Group], list[int]]:
    """Two pointers over the cumulative ends of both sides: groups of ids between common ends, and the pair of
    each link. bytes_a and bytes_b: a token's length by its id. Tokens aren't empty, so every pair of
    overlapping ones is met once: where the pointers stand on it. Both sides end alike."""
    groups, pairs = [], []
    i = j = from_i = from_j = 0
    x, y, last = bytes_a[a[0]], bytes_b[b[0]], len(a) - 1
    while True:
        pairs.append(a[i] << 32 | b[j])
        if x < y:
            i += 1
            x += bytes_a[a[i]]
        elif y < x:
            j += 1
            y += bytes_b[b[j]]
        else:
            i, j = i + 1, j + 1
            groups.append((a[from_i:i], b[from_j:j]))
            if i > last:
                return groups, pairs
            from_i, from_j = i, j
            x += bytes_a[a[i]]
            y += bytes_b[b[j]]


def spelled(groups: list[Group]) -> str:
    return ";".join([f"{','.join(map(str, x))}|{','.join(map(str, y))}" if len(x) + len(y) > 2 else f"{x[0]}|{y[0]}" for x, y in groups])


class Aligner:
    """Tokens of both sides for whole texts with a space before them.

    A text is cut before each run of blanks that follows something else. Neither side has a token over such
    a place: the first's pattern parts there, and no piece of the second holds a blank behind another
    sign (blanks that pieces do hold are found when the model is read, and no cut is made there). So a
    stretch's tokens don't depend on its neighbours, and each distinct stretch is encoded once."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in byte_letters().items()}
        spelled = (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in spelled]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.length_a = list(map(len, self.bytes_a))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.length_b, self.space_b = list(map(len, self.bytes_b)), self.b.piece_to_id(SPACE_MARK)
        self.counted_a, self.counted_b = np.array(self.length_a), np.array(self.length_b)
        held = "".join(p for i, p in enumerate(pieces) if not self.b.is_byte(i))
        blanks = "".join(c for c in "\t\n\x0b\f\r" if c not in held)
        if not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            blanks = " " + blanks
        others = OTHER_BLANKS + "".join(c for c in " \t\n\x0b\f\r" if c not in blanks)
        # a run of blanks that follows one of another kind may be one token with it, so it isn't cut off
        self.cut = re.compile(f"[{blanks}]+[^{blanks}]*(?:(?<=[{others}])[{blanks}]+[^{blanks}]*)*").findall if " " in blanks else lambda text: [text]
        self.known: dict[str, Stretch | None] = {}
        self.former: dict[str, Stretch | None] = {}

    def ids(self, stretches: list[str]) -> list[tuple[str, list[int], list[int]]]:
        """Each stretch with its ids. The second model puts a space before what it is given: the stretch's own
        first one, or one to take away."""
        found_b = self.b.encode([s[1:] if s[0] == " " else s for s in stretches], num_threads=1)
        found_b = [[self.space_b] if s == " " else b if s[0] == " " else b[1:] for s, b in zip(stretches, found_b)]
        return [(s, a.ids, b) for s, a, b in zip(stretches, self.a.encode_batch(stretches, add_special_tokens=False), found_b)]

    def same_bytes(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))

    def all_same(self, found: list[tuple[str, list[int], list[int]]]) -> bool:
        """Whether all stretches have the bytes of their tokens: together they do, and each is as long."""
        texts, a, b = zip(*found)
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        if not all(a) or not all(b) or not self.same_bytes("".join(texts), flat_a, flat_b):
            return False
        long = [len(t.encode()) for t in texts]
        return all(np.add.reduceat(said[flat], np.cumsum([0, *map(len, ids[:-1])])).tolist() == long for said, flat, ids in ((self.counted_a, flat_a, a), (self.counted_b, flat_b, b)))

    def stretch(self, a: list[int], b: list[int]) -> Stretch:
        groups, pairs = merged(a, b, self.length_a, self.length_b)
        return spelled(groups), len(a), len(b), len(groups), array("q", pairs).tobytes()

    def learn(self, stretches: set[str]) -> None:
        """What isn't known is encoded; None where the bytes of either side differ from the text's. When there is
        too much, what wasn't met since the last such time is forgotten."""
        if len(self.known) + len(stretches) > REMEMBERED:
            self.known, self.former = {}, self.known
        met = stretches - self.known.keys()
        again = met & self.former.keys()
        self.known.update(zip(again, map(self.former.__getitem__, again)))
        new = list(met - again)
        for at in range(0, len(new), 1000):
            found = self.ids(new[at : at + 1000])
            same = self.all_same(found)
            for s, a, b in found:
                self.known[s] = self.stretch(a, b) if same or self.same_bytes(s, a, b) else None

    def read(self, texts: list[str | None]) -> list[tuple[list[str], Counter[str]] | None]:
        """Each text's stretches in order and how often each stands there, all of them known; None for a text
        without tokens."""
        parts = [self.cut(" " + t) if t else [] for t in texts]
        times = [Counter(p) for p in parts]
        met = set().union(*times)
        if not self.known.keys() >= met:
            self.learn(met)
        return [(p, n) if p and None not in map(self.known.__getitem__, n) else None for p, n in zip(parts, times)]

    def detail(self, text: str | None) -> tuple[list[Group], list[int]]:
        """Every group of a text and the pair of each of its links."""
        groups, pairs = [], []
        found = self.read([text])[0]
        for s, a, b in self.ids(found[0]) if found else []:
            more = merged(a, b, self.length_a, self.length_b)
            groups += more[0]
            pairs += more[1]
        return groups, pairs

    def figures(self, parts: list[str], times: Counter[str]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links and groups_sha256 of a text; its distinct pairs and the links of each."""
        spelled, n_a, n_b, n_groups, pairs = zip(*map(self.known.__getitem__, times))
        n = np.fromiter(times.values(), dtype=np.int64, count=len(times))
        each = np.frombuffer(b"".join(pairs), dtype=np.int64)
        distinct, at = np.unique(each, return_inverse=True)
        links = np.bincount(at, weights=np.repeat(n, np.fromiter(map(len, pairs), dtype=np.int64, count=len(pairs)) >> 3), minlength=len(distinct)).astype(np.int64)
        sha = hashlib.sha256(";".join(map(dict(zip(times, spelled)).__getitem__, parts)).encode()).hexdigest()
        return int(n @ np.array(n_a)), int(n @ np.array(n_b)), int(n @ np.array(n_groups)), int(links.sum()), sha, distinct, links


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process, whatever tasks it runs. Each task has a core, so no threads are made."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(path_a, path_b)


def few(rows: Iterable[tuple], chars: int = 1 << 20, most: int = 256) -> Iterator[list[tuple]]:
    """Lists of (doc_id, text) rows with about so many characters."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1] or "")
        if size >= chars or len(held) >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch["doc_id"].array, batch["text"].array)


def packed(block: int, docs: list[tuple], held: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """A block's rows: first its distinct pairs and how many documents hold each, then its documents, whose pairs
    are named by their place there."""
    columns, nothing = [c.split()[0] for c in COMPACT.split(", ")], np.zeros(0, dtype=np.int32)
    distinct, n = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *held]), return_counts=True)
    yield pd.DataFrame([(block, None, None, None, None, None, None, nothing, nothing, distinct, n.astype(np.int32))], columns=columns, dtype=object)
    for first in range(0, len(docs), 500):
        rows = [(block, *doc[:-2], np.searchsorted(distinct, doc[-2]).astype(np.int32), doc[-1].astype(np.int32), nothing, nothing) for doc in docs[first : first + 500]]
        yield pd.DataFrame(rows, columns=columns, dtype=object)


def compact(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of documents, see `packed`. A block is what a task reads on end until its documents have BLOCK pairs,
    so memory is bounded by that and one text. Rows of documents have n_a, the row of a block none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        size, rows, held = 0, [], []
        nothing = np.zeros(0, dtype=np.int64)
        for given in few(rows_of(batches)):
            for (doc_id, _), found in zip(given, align.read([text for _, text in given])):
                rows.append((doc_id, *(align.figures(*found) if found else (0, 0, 0, 0, "", nothing, nothing))))
                held.append(rows[-1][-2])
                size += 16 + len(rows[-1][-1])
                if size >= BLOCK:
                    yield from packed(block, rows, held)
                    block, size, rows, held = block + 1, 0, [], []
        if rows:
            yield from packed(block, rows, held)
        pa.default_memory_pool().release_unused()

    # ids travel as text: in pandas, a null would turn whole numbers into floating ones
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, COMPACT)


def side(pair: Column, which: str) -> Column:
    return F.shiftright(pair, 32) if which == "a" else pair.bitwiseAND((1 << 32) - 1)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best_a, best_b: whether n is the highest of its id's pairs, for the id
    of either side. Highest counts are one row an id, so no more than a vocabulary has."""
    counts = parts.groupBy("pair").agg(F.sum("holders").alias("n"))
    counts = written(counts.withColumns({"a": side(F.col("pair"), "a"), "b": side(F.col("pair"), "b")}), "pairs")
    for k in ("a", "b"):
        top = counts.groupBy(k).agg(F.max("n").alias(f"top_{k}"))
        counts = counts.join(F.broadcast(top), k)  # bounded by the vocabulary
    return counts.select("pair", "n", (F.col("n") == F.col("top_a")).alias("best_a"), (F.col("n") == F.col("top_b")).alias("best_b"))


def told(key, docs: pa.Table, facts: pa.Table) -> pa.Table:
    """A block's documents with what the counts of their pairs come to."""
    names = [c.split()[0] for c in RESULT.split(", ")]
    order = np.argsort(facts["place"].to_numpy())
    known = {c: facts[c].to_numpy()[order].astype(np.int64) for c in ("n", "best_a", "best_b")}
    flat = lambda c: pc.list_flatten(docs[c]).to_numpy()
    at, times = flat("at"), flat("times").astype(np.int64)
    ends = np.cumsum(pc.list_value_length(docs["at"]).to_numpy())

    def summed(values: np.ndarray) -> np.ndarray:
        so_far = np.concatenate([[0], np.cumsum(values)])
        return np.diff(so_far[ends], prepend=0)

    own = {"n_best": summed(times * known["best_a"][at]), "n_best_b": summed(times * known["best_b"][at]), "count_sum": summed(times * known["n"][at])}
    own["doc_id"] = pc.cast(docs["doc_id"], pa.int64())
    return pa.table({c: own[c] if c in own else docs[c] for c in names})


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as
    many documents as any pair of its first id), n_best_b (the same for its second id), count_sum (that number
    summed over links) and groups_sha256.

    Texts are read with a space before them. Null and empty texts, and those whose tokens of either side don't
    give back the text's bytes, have no tokens: zeros and an empty groups_sha256; they add to no count. Rows
    that repeat an id count each; a null id stays null. Special tokens inside texts are plain text. An empty
    table gives no rows. Columns beside doc_id and text are left alone.

    Pairs are counted over blocks of documents, each of which fetches its pairs' counts once: a pair that all
    documents hold has a row for each block."""
    rows = written(compact(docs, path_a, path_b), "aligned")
    blocks = rows.where("n_a is null").select("block", F.posexplode(F.arrays_zip("pairs", "holders")).alias("place", "p"))
    parts = blocks.select("block", "place", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("holders"))
    facts = parts.join(pair_counts(parts), "pair").select(F.col("block").alias("of"), "place", "n", "best_a", "best_b")
    return rows.where("n_a is not null").drop("pairs", "holders").groupBy("block").cogroup(facts.groupBy("of")).applyInArrow(told, RESULT)


def groups_and_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, groups and links of every text, in order; empty arrays for texts without tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align = aligner(path_a, path_b)
        for doc_id, text in rows_of(batches):
            groups, pairs = align.detail(text)
            links = [{"a": p >> 32, "b": p & ((1 << 32) - 1)} for p in pairs]
            yield pd.DataFrame({"doc_id": [doc_id], "groups": [[{"a": a, "b": b} for a, b in groups]], "links": [links]}, dtype=object)

    found = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(run, DETAIL)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))
