"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import Batches, fresh, small, spread_join, texts, written

NGRAM = 5
#: Links: 100 * intersection >= 80 * union, which is 9 * intersection >= 4 * (size + size).
CELL_BITS, CHUNK = 24, 1 << 14
#: The longest prefixes ask for so many shared tokens.
MOST_MATCHES = 16
#: Parts that a frequent token's sets are dealt to.
SALTS, HOT_LEVEL = 64, 5


#: A byte's factor by its place in its word, and which bytes part words.
PLACES = 1 << 16
FACTOR = np.random.default_rng(7).integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (A-Z lower-cased), in order: its bytes, each times its place's factor,
    summed up as a difference of running sums over the text."""
    b = np.frombuffer(text.encode().lower() + b" ", dtype=np.uint8)
    edge = np.flatnonzero(BLANK[b])
    start = np.concatenate([[0], edge[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(start, edge - start + 1)
    term = FACTOR[place & (PLACES - 1)] * (b.astype(np.uint64) + np.uint64(1))
    if int((edge - start).max()) > PLACES:
        term *= np.uint64(2) * (place >> 16).astype(np.uint64) + np.uint64(1)
    run = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(term)])
    word = edge > start
    h = run[edge[word]] - run[start[word]]
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles (A-Z lower-cased)."""
    h = word_hashes(text)
    if not len(h):
        return np.zeros(0, dtype=np.uint64)
    n = min(NGRAM, len(h))
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        x = (x ^ h[k : k + len(x)]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def packed(s: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to tell the shingles of two sets apart."""
    return s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def sketch(s: np.ndarray) -> bytes | None:
    """How many of the set's hashes fall to each of 2^k stretches, k by the set's size; none in the odd
    case that a count exceeds a byte."""
    bits = max(3, len(s).bit_length() - 1)
    n = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else None


def may_link(x: bytes, y: bytes) -> bool:
    """Two sets share at most the smaller count of each stretch: false only where that is too little."""
    a, b = (np.frombuffer(z, dtype=np.uint8).astype(np.int64) for z in (x, y))
    total = int(a.sum() + b.sum())
    while len(a) > len(b):
        a = a[::2] + a[1::2]
    while len(b) > len(a):
        b = b[::2] + b[1::2]
    return 9 * int(np.minimum(a, b).sum()) >= 4 * total


def unpacked(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // 6, 8), dtype=np.uint8)
    wide[:, 2:] = np.frombuffer(x, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def set_id(s: np.ndarray) -> int:
    """64 bits of a set, equal for equal sets alone but for chance (one in 2^64 a pair)."""
    return int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)


def text_key(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "little", signed=True)


class Seen:
    """Remembers a bounded number of keys, to do repeated texts once a task."""

    def __init__(self, most: int = 200_000):
        self.keys, self.most = set(), most

    def new(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.most:
            self.keys.clear()
        self.keys.add(key)
        return True


def sets(docs: DataFrame) -> DataFrame:
    """One row a document (doc_id, n, sid) and, apart, each task's counts of hashed shingles.

    The counts are 2^24 cells a task, at most 255 in each, sent in packed chunks (chunk, cells)."""
    names = ["doc_id", "n", "sid", "chunk", "cells"]

    def run(batches: Batches) -> Batches:
        cells = np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in small(batches, 2000):
            n, sid = [], []
            for t in texts(batch):
                s = shingles(t)
                n.append(len(s))
                sid.append(set_id(s))
                np.add.at(cells, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), none, pa.nulls(len(n), pa.binary())], names)
        few = np.minimum(cells, 255, out=cells).astype(np.uint8).reshape(-1, CHUNK)
        del cells
        used = np.flatnonzero(few.any(axis=1))
        if len(used):
            none, pack = pa.nulls(len(used), pa.int64()), pa.Codec("zstd")
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(used, pa.int32()), pa.array([pack.compress(few[k].tobytes(), asbytes=True) for k in used], pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, n long, sid long, chunk int, cells binary")


def frequency_levels(found: DataFrame) -> np.ndarray:
    """One byte a cell: 0 where the count is what chance brings, then a level for each doubling of what
    goes beyond: a token that stands above the noise of its cell is put last in every prefix.

    Tasks add up chunks as they stream by; 16 MB reach the driver, at any size of the input, in one job whatever
    the number of partitions."""
    mean = (found.agg(F.sum("n")).first()[0] or 0) / (1 << CELL_BITS)

    def add(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        pack = pa.Codec("zstd")
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cells = np.frombuffer(pack.decompress(x, CHUNK, asbytes=True), dtype=np.uint8)
                sums.setdefault(c, np.zeros(CHUNK, dtype=np.int32))[:] += cells
        for c, x in sums.items():
            excess = (x - mean) / (4 * np.sqrt(mean) + 1)
            level = np.where(excess >= 1, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["chunk", "level"])

    parts = found.where(F.col("chunk").isNotNull()).select("chunk", "cells").repartition("chunk").mapInArrow(add, "chunk int, level binary")
    out = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    got = parts.toArrow()
    for chunk, level in zip(got["chunk"].to_pylist(), got["level"]):
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(level.as_buffer(), np.uint8)
    return out


class Prefix(NamedTuple):
    tokens: np.ndarray
    matches: int


#: Most flags of a key filter: 128 MB.
MOST_FLAGS = 30


def key_filter(keys: DataFrame, n: int) -> np.ndarray:
    """Eight flags or more for each of n ids, packed in bytes, set where one of the ids falls.

    The driver gets them in one job, at most 2^MOST_FLAGS (128 MB)."""
    bits = max(20, (8 * n - 1).bit_length())
    part = 20
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))

    def flags(batches: Batches) -> Batches:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            x = batch.column(0).to_numpy()
            for c in np.unique(x >> part).tolist():
                own.setdefault(c, np.zeros(1 << part, dtype=bool))[x[x >> part == c] & ((1 << part) - 1)] = True
        for c, f in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.packbits(f, bitorder="little").tobytes()], pa.binary())], ["part", "flags"])

    places = keys.select(place.alias("x")).distinct().repartition(1 << (bits - part), F.shiftright("x", part))
    out, wide = np.zeros(1 << (bits - 3), dtype=np.uint8), 1 << (part - 3)
    got = places.mapInArrow(flags, "part int, flags binary").toArrow()
    for k, own in zip(got["part"].to_pylist(), got["flags"]):
        out[k * wide : (k + 1) * wide] |= np.frombuffer(own.as_buffer(), np.uint8)
    return out


def prefix(s: np.ndarray, levels: np.ndarray) -> Prefix:
    """The tokens under which a set is filed, and how many a partner must share.

    Tokens stand in one order for all sets: by frequency level, then by hash. A set of n tokens must
    share at least a = ceil(0.8 n) with any partner, so two linked sets share m or more of the first
    n - a + m tokens of each. Longer prefixes (m = 2 to 16) cost more postings but leave fewer
    candidates to verify; m is what costs least, postings being the expected bucket sizes and
    verification the expected candidates, at most their sum over m, times the set's size."""
    level = levels[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    order = np.lexsort((s, level))
    short = len(s) - -(-4 * len(s) // 5)
    most = min(MOST_MATCHES, len(s) - short)
    expected = np.cumsum(16 * (np.exp2(level[order[: short + most]].astype(np.float64)) - 1))
    m = np.arange(1, most + 1)
    cost = short + m + expected[short : short + most] * (1 + len(s) / 64 / m)
    best = int(m[cost.argmin()])
    return Prefix(s[order[: short + best]], best)


def postings(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """token, salt, sid, n, m, most: `most` is the largest partner that can still reach the threshold if
    the first shared token (or one of the first m) is this one. Tokens of ordinary frequency have salt
    -1; those of more are dealt to SALTS parts by set."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    names = ["token", "salt", "sid", "n", "m", "most"]

    def run(batches: Batches) -> Batches:
        seen = Seen()
        for batch in small(batches, 500):
            whole = texts(batch)
            for at in range(0, len(whole), 500):
                cols: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in names]
                for t in whole[at : at + 500]:
                    if not seen.new(text_key(t)):
                        continue
                    s = shingles(t)
                    if not len(s):
                        continue
                    p = prefix(s, shared.value)
                    n, k = len(s), len(p.tokens)
                    most = (9 * (n - np.arange(k) + p.matches - 1)) // 4 - n
                    sid = set_id(s)
                    salt = np.where(shared.value[(p.tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)] >= HOT_LEVEL, sid % SALTS, -1)
                    for c, x in zip(cols, (p.tokens.view(np.int64), salt, np.full(k, sid), np.full(k, n), np.full(k, p.matches), most)):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(kind.to_pandas_dtype()), kind) for c, kind in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "token long, salt int, sid long, n int, m int, most int")


def meeting(filed: DataFrame) -> DataFrame:
    """Postings that meet another set of a size that can link: one shuffle, then a running look along
    each token's sets in order of size. Postings of frequent tokens all stay, whichever part they are
    dealt to, and so does each set once a token."""
    part = Window.partitionBy("token", "salt").orderBy("n", "sid")
    once = filed.withColumn("before", F.lag("sid").over(part)).where("before is null or before <> sid").drop("before")
    # the next larger set is within reach, or one as large or smaller reaches up to this one
    up = F.lead("n").over(part) <= F.col("most")
    down = F.max("most").over(part.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("n")
    return once.withColumn("meets", F.coalesce(up, F.lit(False)) | F.coalesce(down, F.lit(False)) | (F.col("salt") >= 0)).where("meets").drop("meets", "salt")


def beside(pairs: DataFrame, stored: DataFrame, column: str) -> DataFrame:
    """a, b and the column's values x, y of both."""
    named = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    used = stored.select("sid", column).join(named, "sid", "left_semi").dropDuplicates(["sid"])
    left = pairs.join(used.select(F.col("sid").alias("a"), F.col(column).alias("x")), "a")
    return left.join(used.select(F.col("sid").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")


def verified(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """Those (a, b) whose sets link, by the exact rule. Sketches, a tenth of the sets' size, first part
    off the pairs that can't; only for the rest do the sets themselves travel."""

    def filtered(keep) -> Callable[[Batches], Batches]:
        def run(batches: Batches) -> Batches:
            for batch in small(batches, 1000):
                good = [keep(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

        return run

    def linked(x: bytes, y: bytes) -> bool:
        both = np.concatenate([unpacked(x), unpacked(y)])
        both.sort()
        return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)

    possible = written(beside(pairs, stored, "sketch").mapInArrow(filtered(lambda x, y: x is None or y is None or may_link(x, y)), "a long, b long"), "possible")
    return beside(possible, stored, "hashes").mapInArrow(filtered(linked), "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """sid, comp: the smallest sid reachable, for every end of an edge. Each round takes the least
    label among neighbours, then that label's own label; each is written, so none repeats earlier ones.
    A set with many links, or a label that many bear, is dealt to parts."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = written(both.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "label")
    for _ in range(rounds):
        near = spread_join(both, label.withColumnRenamed("sid", "b"), ["b"], "a").groupBy(F.col("a").alias("sid")).agg(F.min("comp").alias("near"))
        low = label.join(near, "sid").select("sid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = label.select(F.col("sid").alias("comp"), F.col("comp").alias("next"))
        new = written(spread_join(low, jump, ["comp"], "sid").select("sid", "old", F.least("comp", "next").alias("comp")), "label")
        label = new.select("sid", "comp")
        if new.where(F.col("old") != F.col("comp")).isEmpty():
            return label
    raise RuntimeError("components did not settle")


class Filed(NamedTuple):
    members: DataFrame  # doc_id, n, sid
    active: DataFrame  # postings that meet another set
    stored: DataFrame  # the sets of those


def filed_sets(docs: DataFrame) -> Filed:
    """Of rows doc_id long, text; each table written."""
    found = written(sets(docs), "sets")
    members = found.where(F.col("n").isNotNull()).select("doc_id", "n", "sid")
    named = docs.where(F.col("doc_id").isNotNull())
    filed = meeting(postings(named, frequency_levels(found)))
    active = written(filed.withColumn("band", F.floor(F.log(1.25, F.col("n"))).cast("int")), "active")
    return Filed(members, active, written(set_table(named, members, active.select("sid").distinct()), "stored"))


def fits(x: str, y: str) -> Column:
    return (F.col(f"{y}.n") <= F.col(f"{x}.most")) & (F.col(f"{x}.n") <= F.col(f"{y}.most")) & (5 * F.col(f"{x}.n") >= 4 * F.col(f"{y}.n")) & (5 * F.col(f"{y}.n") >= 4 * F.col(f"{x}.n"))


#: 64-bit words of the marks that tell how many prefix tokens two sets share at most.
MARKS = 4


def marked(filed: DataFrame) -> DataFrame:
    """Adds marks, one bit for each of a set's filed tokens up to this one in the order of all tokens, and spare:
    how many of those fell on bits already set.

    If this is the k-th token that two sets share, their marks have at least k - spare bits in common, with
    either one's spare. A set's tokens stand in that order as `most` falls."""
    bit = F.pmod(F.xxhash64("token"), F.lit(64 * MARKS))
    so_far = Window.partitionBy("sid").orderBy(F.desc("most")).rowsBetween(Window.unboundedPreceding, 0)
    own = F.expr(f"shiftleft(1L, cast(pmod(xxhash64(token), {64 * MARKS}) % 64 as int))")
    words = {f"w{k}": F.bit_or(F.when(F.floor(bit / 64) == k, own).otherwise(F.lit(0).cast("long"))).over(so_far) for k in range(MARKS)}
    used = sum((F.bit_count(f"w{k}") for k in range(MARKS)), F.lit(0))
    return filed.withColumns(words | {"spare": F.count("*").over(so_far).cast("int")}).withColumn("spare", F.col("spare") - used)


def candidates(filed: DataFrame, by: str = "sid", wide: int = 500) -> DataFrame:
    """a, b: pairs of filed sets (token, sid, n, m, most) that differ in the column `by` and may share as many
    tokens as they must, at places and of sizes that fit.

    Linked sets share m tokens or more that fit; at the m-th of them their marks tell of m - spare or more, and
    only there, or later, a pair is made. A token's sets are parted in groups of some `wide`; each two
    groups, and each with itself, meet in a cell of their own."""
    buckets = filed.groupBy("token").agg(F.min(by).alias("low"), F.max(by).alias("high"), F.count("*").alias("size")).where("low < high")
    told = spread_join(marked(filed), buckets.select("token", F.least(F.ceil(F.col("size") / wide), F.lit(1 << 10)).cast("int").alias("groups")), ["token"], "sid")
    dealt = told.where("groups is not null").withColumn("own", F.expr("cast(pmod(xxhash64(sid), groups) as int)")).withColumn("other", F.explode(F.expr("sequence(0, groups - 1)")))
    dealt = written(dealt.withColumn("cell", F.least("own", "other") * 1024 + F.greatest("own", "other")).drop("other", "groups"), "dealt")
    common = sum((F.bit_count(F.col(f"x.w{k}").bitwiseAND(F.col(f"y.w{k}"))) for k in range(MARKS)), F.lit(0))
    enough = common + F.least("x.spare", "y.spare") >= F.least("x.m", "y.m")
    once = (F.col("x.own") != F.col("y.own")) | (F.col("x.cell") == F.col("x.own") * 1025)
    met = dealt.alias("x").join(dealt.alias("y"), ["token", "cell"]).where((F.col("x.sid") < F.col("y.sid")) & (F.col(f"x.{by}") != F.col(f"y.{by}")) & once & fits("x", "y") & enough)
    return met.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()


class Links(NamedTuple):
    links: DataFrame  # a, b: every two distinct sets that link, a < b
    members: DataFrame  # doc_id, sid, n_links: each document's set, and how many other documents it links to


def links(docs: DataFrame, wide: int = 500) -> Links:
    """The whole join: every link between distinct sets, whether or not others connect its ends.

    Sets of a token that more than `wide` have are compared group by group. Equal sets link, and are told
    by membership. Rows without an id or words link nothing; rows that repeat an id and text count once."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members, active, stored = filed_sets(docs)
    pairs = candidates(active.drop("band"), "sid", wide)
    found = written(verified(written(pairs, "pairs"), stored), "links")
    own = members.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).select("doc_id", "sid").distinct()
    size = own.groupBy("sid").agg(F.count("*").alias("size"))
    both = found.select("a", "b").union(found.select("b", "a"))
    beyond = spread_join(both, size.withColumnRenamed("sid", "b"), ["b"], "a").groupBy(F.col("a").alias("sid")).agg(F.sum("size").alias("beyond"))
    counted = spread_join(own, size.join(beyond, "sid", "left"), ["sid"], "doc_id")
    return Links(found, counted.select("doc_id", "sid", (F.col("size") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links")))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row.

    Equal sets are joined first, by digest. Sets that share a prefix token meet in its bucket: each
    is compared with the bucket's set of most slack, which joins groups of copies in as many
    comparisons as members. Only pairs that are then still apart, share the tokens they must and fit
    in size and position are compared with one another, so every link between components is found.
    A text without words has 0 shingles and its own id. Null ids get a null component and link
    nothing. Rows that repeat an id and text share their result. Works on an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    members, active, stored = filed_sets(docs)

    hubs = active.groupBy("token", "band").agg(F.max(F.struct((F.col("most") - F.col("n")).alias("slack"), (-F.col("sid")).alias("minus"), "n", "most")).alias("h")).select("token", "band", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("n"), F.col("h.most").alias("most"))
    near = spread_join(active, hubs.select("token", "band", F.struct("hub", "n", "most").alias("y")), ["token", "band"], "sid").alias("x")
    star = near.where((F.col("sid") != F.col("y.hub")) & fits("x", "y")).select(F.least("sid", "y.hub").alias("a"), F.greatest("sid", "y.hub").alias("b")).distinct()
    first = written(verified(written(star, "star"), stored), "links")
    comp = components(first)

    label = active.join(comp, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    pairs = candidates(label.drop("band"), "comp")
    links = first.union(verified(written(pairs, "pairs"), stored))
    # the least id of each set, of each component, and back
    lone = written(members.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("least")).join(components(links), "sid", "left"), "lone")
    least = lone.where("comp is not null").groupBy("comp").agg(F.min("least").alias("of_comp"))
    told = spread_join(lone, least, ["comp"], "sid").select("sid", F.coalesce("of_comp", "least").alias("least"))
    out = spread_join(members, told, ["sid"], "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def set_table(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, hashes, sketch: each wanted set, sorted and packed.

    Sets don't travel: the document with the least id stands for its set, and a filter tells the scan which
    documents are meant. The few that it lets by in error, or rows that repeat an id, only make a set stand
    here twice, or without need. Beyond the size that the filter may have, documents meet the ids by a join."""
    keys = written(members.where(F.col("doc_id").isNotNull()).groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(wanted, "sid", "left_semi").select("doc_id"), "keys")
    n = keys.count()
    shared = None
    if 8 * n <= 1 << MOST_FLAGS:
        shared = docs.sparkSession.sparkContext.broadcast(key_filter(keys, n))
    else:
        docs = docs.join(keys, "doc_id", "left_semi")
    flags = 8 * len(shared.value) if shared else 1

    def run(batches: Batches) -> Batches:
        for batch in small(batches, 2000):
            if shared:
                place = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((shared.value[place >> 3] >> (place & 7) & 1).astype(bool)))
            for at in range(0, batch.num_rows, 500):
                own = [s for t in texts(batch.slice(at, 500)) if len(s := shingles(t))]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in own], pa.int64()), pa.array([packed(s) for s in own], pa.binary()), pa.array([sketch(s) for s in own], pa.binary())], ["sid", "hashes", "sketch"])

    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(flags)).alias("place")).mapInArrow(run, "sid long, hashes binary, sketch binary")


def deduplicated(docs: DataFrame) -> DataFrame:
    """Rows of docs, all columns, but of each component only the one with the smallest doc_id.

    Rows with a null id stay. Of rows that repeat that id, all stay. Columns may have any names."""
    gone = fresh(docs, "dropped")
    drop = jaccard_components(docs).where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(gone))
    return docs.join(drop.distinct(), docs["doc_id"] == F.col(gone), "left_anti")
