"""Chat formatting: logged snapshots that begin a longer conversation collapse into it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from quillmark.llm.common import written

TEMPLATE = ("<|", "|>\n", "<|end|>\n")
CHUNK = 256


def earlier_chunks() -> WindowSpec:
    return Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: distinct rows with an id and turn; null role or text reads as empty."""
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .where("conv_id is not null and turn is not null")
        .distinct()
    )


def _hash(*cols: str | Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(F.lit(seed), *cols) for seed in (1, 2)]


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, chunk, turn, role, text, n: turns with their place from 1.

    Places are taken in chunks of CHUNK turn numbers, then carried from chunk to chunk, so a conversation of
    any length is spread over tasks."""
    t = turns(conversations).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    carry = t.groupBy("conv_id", "chunk").agg(F.count("*").alias("k")).select(F.col("conv_id").alias("c"), F.col("chunk").alias("p"), F.coalesce(F.sum("k").over(earlier_chunks()), F.lit(0)).alias("base"))
    numbered = t.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text"))).join(carry, (F.col("conv_id") == F.col("c")) & (F.col("chunk") == F.col("p")))
    return numbered.withColumn("n", F.col("base") + F.col("k")).drop("c", "p", "base", "k")


def prefix_hashes(placed: DataFrame) -> DataFrame:
    """conv_id, n, h1, h2: rolling hashes of all turns up to the n-th, without texts.

    A rolling hash joins 64-bit hashes of (place, role, text) by exclusive or, as places make them differ; two
    of them make 128 bits. They run within chunks and are carried from chunk to chunk like places."""
    one, two = _hash("n", "role", "text")
    hashed = placed.select("conv_id", "chunk", "turn", "n", one.alias("x1"), two.alias("x2"))
    whole = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    bases = whole.select(F.col("conv_id").alias("c"), F.col("chunk").alias("p"), *[F.coalesce(F.bit_xor(s).over(earlier_chunks()), F.lit(0)).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))])
    running = Window.partitionBy("conv_id", "chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumns({"r1": F.bit_xor("x1").over(running), "r2": F.bit_xor("x2").over(running)}).join(bases, (F.col("conv_id") == F.col("c")) & (F.col("chunk") == F.col("p")))
    return rolled.select("conv_id", "n", *[F.col(b).bitwiseXOR(F.col(r)).alias(h) for b, r, h in (("b1", "r1", "h1"), ("b2", "r2", "h2"))])


def maximal(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one begins with; of equal ones the
    smallest id stays, and n_copies counts them.

    Prefixes are first summed up to one row for each distinct (length, hashes), so a first turn that
    many conversations share is one row when it meets the whole conversations."""
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("n", "h1", "h2")).alias("e")).select("conv_id", "e.*")
    whole = ends.groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    # a prefix that is not its conversation's end has at least one turn after it
    longer = hashed.select("conv_id", "n", "h1", "h2").join(ends.select(F.col("conv_id"), F.col("n").alias("total")), "conv_id").where("n < total").select("n", "h1", "h2").distinct()
    return whole.join(longer, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def rendered(conversations: DataFrame, segment: int = 512) -> DataFrame:
    """conv_id, n_turns, n_copies, segment, text: the maximal conversations as chat text.

    Turns stand in order of (turn, role, text), repeated rows once; rows with a null id or turn are left
    out. A conversation of more than `segment` turns is several rows, to be joined in order, so no row
    grows without bound. Empty tables give none. Turns are placed once, into a written table, and hashed
    once, into one without texts; texts meet conversations that stay last."""
    placed = written(placed_turns(conversations), "chat-turns")
    kept = maximal(written(prefix_hashes(placed), "chat-prefixes"))
    a, b, c = TEMPLATE
    said = placed.select("conv_id", "n", F.concat(F.lit(a), "role", F.lit(b), "text", F.lit(c)).alias("said")).join(kept, "conv_id")
    rows = said.groupBy("conv_id", "n_turns", "n_copies", F.floor((F.col("n") - 1) / segment).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("n", "said"))).alias("all"))
    return rows.select("conv_id", "n_turns", "n_copies", "segment", F.array_join("all.said", "").alias("text"))
