"""Mixing of sources to target weights, by blocks of words drawn with per-source permutations."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import fresh, small, written

MOST = 3  # times that a source's words may be taken
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = list(b" \t\n\x0b\x0c\r")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> dict[str | None, float]:
    """Shares of the sum of all sizes, by weight in order of code points (null last), none above
    `most` times its source's size; what is left over is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[k % len(weights)] for k, (s, _) in enumerate(order)}
    room = {s: float(most * n) for s, n in order}
    total, out, open_ = float(sum(n for _, n in order)), {}, list(weight)
    while open_:
        unit = (total - sum(out.values())) / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit > room[s]]
        for s in full or open_:
            out[s] = room[s] if full else weight[s] * unit
        open_ = [s for s in open_ if s not in out]
    return out


class Source(NamedTuple):
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def plan(sizes: list[tuple[str | None, int]], block: int) -> list[Source]:
    out, own = [], dict(sizes)
    for name, target in targets(sizes).items():
        size = own[name]
        blocks = -(-size // block)
        # the last block is short: as many slots as the blocks' mean length fills
        slots = min(round(target * blocks / size), MOST * blocks) if size else 0
        out.append(Source(name, size, target, blocks, slots))
    return out


def draw(sources: list[Source], shards: int, seed: int) -> np.ndarray:
    """[shard, source] slots: multinomial draws by what each source still owes, so that the shards'
    counts vary as draws do and their sums are the sources' slots."""
    rng = np.random.default_rng(seed)
    left = np.array([s.slots for s in sources], dtype=np.int64)
    out = np.zeros((shards, len(sources)), dtype=np.int64)
    for k in range(shards):
        todo = left.sum() // (shards - k)
        while todo and left.sum():
            got = np.minimum(rng.multinomial(todo, left / left.sum()), left)
            out[k] += got
            left -= got
            todo -= got.sum()
    return out


def permutation(slot: pd.Series, blocks: pd.Series, key: pd.Series) -> pd.Series:
    """The block of each slot: every pass over a source is a keyed permutation of its blocks, made by
    four rounds on the index's halves, repeated until the result is an index again."""
    n = blocks.to_numpy(dtype=np.uint64)
    turn = slot.to_numpy(dtype=np.uint64) // n
    x = slot.to_numpy(dtype=np.uint64) % n
    half = np.maximum(np.ceil(np.log2(np.maximum(n, 2)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    k = key.to_numpy(dtype=np.int64).view(np.uint64) + turn * np.uint64(0x9E3779B97F4A7C15)
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        y, h, m = x[todo], half[todo], mask[todo]
        a, b = y >> h, y & m
        for r in range(4):
            f = (b + k[todo] + np.uint64(r)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f >> np.uint64(33)) & m)
        x[todo] = (a << h) | b
        todo = x >= n
    return pd.Series(x.astype(np.int64))


class Mix(NamedTuple):
    sizes: DataFrame  # row, doc_id, source, size, start: its place in its source's words
    slots: DataFrame  # shard, source, slot, block
    sources: list[Source]


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def placed(sizes: DataFrame, buckets: int = 1024) -> DataFrame:
    """Adds `start`: the words before a row in its source. Rows of a source stand by hashed bucket,
    then by id; sums of buckets (at most `buckets` a source) give where each bucket begins, so that no
    source has to be ordered by one task."""
    b = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size"), F.lit(buckets)))
    by = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = b.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select("source", "bucket", F.coalesce(F.sum("words").over(by), F.lit(0)).alias("begin"))
    inner = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = b.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    same: Column = F.col("own.source").eqNullSafe(F.col("at.source")) & (F.col("own.bucket") == F.col("at.bucket"))
    return own.alias("own").join(begins.alias("at"), same).select("own.doc_id", "own.source", "own.size", (F.col("begin") + F.col("before")).alias("start"))


def mix(docs: DataFrame, block: int = 64, shards: int = 64, seed: int = 20, sizes: DataFrame | None = None) -> Mix:
    """The mix of docs: which block of which source fills each slot of each output shard.

    Blocks are `block` consecutive words of a source's rows set end to end. Sources are counted one
    row each on the driver; all else stays in the cluster. Null texts have no words; a null source is a
    source of its own, the last. Repeated rows are each mixed. Empty tables and sources without words
    take nothing. The same rows and parameters give the same mix at any partitioning.
    """
    spark = docs.sparkSession
    sizes = written(sized(docs), "sizes") if sizes is None else sizes
    totals = [(r.source, int(r.size)) for r in sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()]
    sources = plan(totals, block)
    counts = draw(sources, shards, seed)
    begins = np.cumsum(counts, axis=0) - counts
    rows = [(k, s.name, int(begins[k, i]), int(counts[k, i]), s.blocks) for k in range(shards) for i, s in enumerate(sources) if counts[k, i]]
    runs = spark.createDataFrame(rows, "shard int, source string, begin long, n long, blocks long")
    step = 4096
    cut = runs.select("shard", "source", "blocks", "begin", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {step}"))).alias("part"))
    spread = cut.repartition(max(1, min(4096, sum(s.slots for s in sources) // 100_000)), "shard", "source", "part")
    slots = spread.select("shard", "source", "blocks", F.explode(F.sequence(F.col("begin") + F.col("part") * step, F.col("begin") + F.least(F.col("n"), (F.col("part") + 1) * step) - 1)).alias("slot"))
    to_block = F.pandas_udf(permutation, "long")
    return Mix(written(placed(sizes), "placed"), slots.select("shard", "source", "slot", to_block("slot", "blocks", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull(), F.lit(seed))).alias("block")), sources)


def parts(m: Mix, block: int = 64) -> DataFrame:
    """source, block, doc_id, start, words: what each row with words gives to each block."""
    spans = m.sizes.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    low, high = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return spans.select("source", "block", "doc_id", "start", "size", (high - low).alias("words"))


def filled(m: Mix, block: int = 64) -> DataFrame:
    """shard, slot, source, block, doc_id, words: the mix itself, blocks joined by index."""
    p, s = parts(m, block).alias("p"), m.slots.alias("s")
    same = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block"))
    return s.join(p, same).select("s.shard", "s.slot", "s.source", "s.block", "p.doc_id", "p.start", "p.words")


def drawn(m: Mix, block: int) -> DataFrame:
    """source, doc_id, start, size, block, words, times: what each row with words gives to each block that the
    mix draws, and how often. Counts of blocks grow with the input, so they are never broadcast."""
    times = m.slots.groupBy("source", "block").agg(F.count("*").alias("times")).hint("merge").alias("t")
    p = parts(m, block).alias("p")
    same = F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block"))
    return p.join(times, same).select("p.source", "p.doc_id", "p.start", "p.size", "p.block", "words", "times")


def taken(m: Mix, block: int = 64) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: words the mix takes, repeats counted."""
    spark = m.sizes.sparkSession
    got = drawn(m, block).groupBy("source", "doc_id", "start", "size").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    info = spark.createDataFrame([(s.name, s.size, s.target) for s in m.sources], "source string, source_size long, target double")
    z = m.sizes.alias("z")
    rows = z.join(got.alias("g"), F.col("z.source").eqNullSafe(F.col("g.source")) & F.col("z.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("z.start") == F.col("g.start")) & (F.col("z.size") == F.col("g.size")), "left")
    return rows.select("z.doc_id", "z.size", "z.source", F.coalesce("taken", F.lit(0)).alias("taken")).alias("r").join(info.alias("i"), F.col("r.source").eqNullSafe(F.col("i.source"))).select("doc_id", "size", "source_size", "target", "taken")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text's stretches (first word, words), in order, each with the white space that follows it."""
    b = text.encode()
    blank = np.isin(np.frombuffer(b, dtype=np.uint8), BLANKS)
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = [*starts[1:].tolist(), len(b)]
    return b"".join(b[int(starts[k]) : ends[k + n - 1]] for k, n in spans).decode()


def mixed_documents(docs: DataFrame, block: int = 64, shards: int = 64, seed: int = 20) -> DataFrame:
    """The mix as rows of docs, all columns, whatever their names: of each row up to MOST copies, the k-th
    holding, in order, the words of those blocks that the mix takes k times or more, with the white space
    behind them. A copy that keeps all words keeps the text as it is; n_chars, where there is such a column, is
    set anew. Their words sum up to `taken`. Rows that the mix doesn't draw are gone."""
    m = mix(docs, block, shards, seed)
    first = (F.greatest(F.col("block") * block, F.col("start")) - F.col("start")).alias("from")
    spans = drawn(m, block).groupBy("source", "doc_id", "start", "size").agg(F.collect_list(F.struct(first, "words", "times")).alias("spans"))
    # rows alike in id, source and size: the one that stands n-th takes the n-th list
    nth = Window.partitionBy("doc_id", "source", "size").orderBy("start")
    lists = m.sizes.where("size > 0").withColumn("n", F.row_number().over(nth)).alias("z").join(spans.alias("s"), F.col("z.source").eqNullSafe(F.col("s.source")) & F.col("z.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("z.start") == F.col("s.start")) & (F.col("z.size") == F.col("s.size"))).select("z.doc_id", "z.source", "z.size", "n", "spans").alias("l")
    names = list(docs.columns)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    own = own.where("size > 0").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy(F.xxhash64("row.text")))).alias("o")
    same = F.col("o.doc_id").eqNullSafe(F.col("l.doc_id")) & F.col("o.source").eqNullSafe(F.col("l.source")) & (F.col("o.size") == F.col("l.size")) & (F.col("o.n") == F.col("l.n"))
    each = own.join(lists, same).select("row", "o.size", "spans", F.explode(F.sequence(F.lit(1), F.array_max("spans.times").cast("int"))).alias("k"))
    kept = F.transform(F.array_sort(F.filter("spans", lambda s: s["times"] >= F.col("k"))), lambda s: F.struct(s["from"].alias("from"), s["words"].alias("words")))
    read = each.select("row", "size", kept.alias("kept")).alias("e").select(*[F.col(f"e.row.`{c}`") for c in names], F.col("e.kept").alias(fresh(docs, "kept_")), F.col("e.size").alias(fresh(docs, "size_")))

    def run(batches):
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            new = []
            for t, some, size in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()):
                new.append(t if sum(s["words"] for s in some) == size else cut(t, [(s["from"], s["words"]) for s in some]))
            cols = batch.columns[: len(names)]
            cols[at] = pa.array(new, cols[at].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                cols[n] = pa.array(map(len, new), cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return read.mapInArrow(run, docs.schema)
