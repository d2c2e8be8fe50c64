"""Cost-balanced packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quillmark.llm.common import Batches, small, texts

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, cost double"
#: Distinct parts of words whose ids a worker remembers; beyond, the older half is forgotten.
REMEMBERED = 200_000

#: Signs that the normalizer leaves as they are but for lower-casing, and whose kinds every edition of the
#: character tables knows alike: printable ASCII, Latin and Cyrillic. Words with others go through the
#: whole tokenizer.
SPANS = ((0x21, 0x7E), (0xA1, 0x12F), (0x131, 0x24F), (0x400, 0x4FF))


def ranges(codes: list[int]) -> str:
    """A character class's inside for ascending codes."""
    starts = [c for c, before in zip(codes, [-1, *codes]) if c != before + 1]
    ends = [c for c, after in zip(codes, [*codes[1:], -1]) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends))


def of_kind(kind: str) -> str:
    return ranges([c for a, b in SPANS for c in range(a, b + 1) if unicodedata.category(chr(c))[0] == kind])


PLAIN = re.compile("".join(["[", *(f"\\u{a:04x}-\\u{b:04x}" for a, b in SPANS), "\\t-\\r ]*"]))


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where that can be seen, else
    one from 256 on, in order."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordTokenizer:
    """Ids of whole texts as little-endian uint32. No token of this vocabulary spans white space or what
    its pattern parts, so a part's ids don't depend on its neighbours: texts are cut by the tokenizer's own
    pattern, and its model encodes each distinct part once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder, self.known, self.letters = Tokenizer.from_file(path), {}, byte_letters()
        with open(path) as f:
            rules = json.load(f)
        pattern = rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = re.compile(pattern.replace(r"\p{L}", of_kind("L")).replace(r"\p{N}", of_kind("N"))).findall
        self.model, self.special = self.encoder.model, [t["content"] for t in rules["added_tokens"]]

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def learn(self, parts: set[str]) -> None:
        """Ids of parts not yet known; the older half of all is forgotten when there are too many."""
        if len(self.known) + len(parts) > REMEMBERED:
            for p in list(islice(self.known, len(self.known) // 2)):
                del self.known[p]
        for p in parts:
            if p not in self.known:
                spelled = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(spelled)]
                self.known[p] = struct.pack(f"<{len(ids)}I", *ids)

    def cut_ids(self, text: str) -> bytes:
        parts = self.cut(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            self.learn(set(parts))
        return b"".join(map(self.known.__getitem__, parts))

    def __call__(self, text: str) -> bytes:
        if self.plain(text):
            return self.cut_ids(text)
        words = (w.decode() for w in text.encode().split())
        return b"".join(self.cut_ids(w) if self.plain(w) else np.array(self.encoder.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes() for w in words)


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process, whatever tasks it runs."""
    return WordTokenizer(path)


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """Place documents of the given token counts, longest first, each into the sequence of lowest
    cost that has room for all of it. A piece of n tokens costs linear * n + quadratic * n * n.
    Where no sequence has that much room, the cheapest one with any room takes what it can and the
    rest moves on. Gives (document, start, length, sequence, offset) and each sequence's cost."""
    total = int(lengths.sum())
    bins = -(-total // capacity)
    cost, room = np.zeros(bins), np.full(bins, capacity, dtype=np.int64)
    price = lambda n: linear * n + quadratic * n * n
    placed, pieces, used = [], [], 0
    for d, n in enumerate(lengths.tolist()):
        full = n // capacity
        for k in range(full):  # the longest possible pieces come first and fill empty sequences
            placed.append((d, k * capacity, capacity, used, 0))
            cost[used], room[used], used = price(capacity), 0, used + 1
        if n % capacity:
            pieces.append((n % capacity, d, full * capacity))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    open_cost, open_room = cost[used:], room[used:]
    for n, d, start in pieces:
        while n:
            fits = open_room >= n
            if not fits.any():
                fits = open_room > 0
            b = int(np.where(fits, open_cost, np.inf).argmin())
            take = min(n, int(open_room[b]))
            placed.append((d, start, take, used + b, capacity - int(open_room[b])))
            open_cost[b] += price(take)
            open_room[b] -= take
            n, start = n - take, start + take
    return placed, cost


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, block_sequences: int = 1024, linear: float = 1.0, quadratic: float | None = None) -> DataFrame:
    """Pieces of every document with their place in a sequence; `ids` are little-endian uint32.

    Each task packs what it reads in blocks of about block_sequences sequences, so nothing is
    shuffled, memory is bounded, and at most one sequence a block is left with padding. A null or
    empty text is the end id alone. Repeated rows are packed once each. An empty table gives none.
    Sequence ids are unique: task, then sequence within it.
    """
    quadratic = 1.0 / capacity if quadratic is None else quadratic

    def run(batches: Batches) -> Batches:
        encode, done = tokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        end, names = np.array([end_id], dtype="<u4").tobytes(), [c.split()[0] for c in SCHEMA.split(", ")]
        held: list[tuple[int | None, bytes]] = []
        tokens = 0

        def flush() -> Batches:
            nonlocal tokens, done
            lengths = np.array([len(x) // 4 for _, x in held], dtype=np.int64)
            placed, cost = balance(lengths, capacity, linear, quadratic)
            for at in range(0, len(placed), 2000):
                d, start, length, b, offset = np.array(placed[at : at + 2000], dtype=np.int64).T
                ids = pa.array([held[k][1][4 * s : 4 * (s + n)] for k, s, n in zip(d.tolist(), start.tolist(), length.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([held[k][0] for k in d.tolist()], pa.int64()), pa.array(start), pa.array(length), ids, pa.array(lengths[d]), pa.array(done + b), pa.array(offset), pa.array(cost[b])], names)
            held.clear()
            tokens, done = 0, done + len(cost)

        for batch in small(batches, 128):
            for i, t in zip(batch.column(0).to_pylist(), texts(batch)):
                held.append((i, encode(t) + end))
                tokens += len(held[-1][1]) // 4
            if tokens >= block_sequences * capacity:
                yield from flush()
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
