"""Exact top-k by inner product: a ball tree in every shard, searched by branch and bound.

Shards are searched in rounds, each of some four times as many as the one before; a round starts from the
kth scores over all shards before it."""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import Batches, written

SCALE = 1024
#: How much larger a round is than the one before.
GROWTH = 4
#: Inner products up to here are added up in 64 bits.
SAFE = float(1 << 62)
FOUND = "query_id long, vec_id long, score long"


def usable(col: str) -> Column:
    """The vector and all its components are there and finite."""
    x = F.col(col)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<long>: floor(1024 x) of each component; unusable vectors and null ids are left out."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable("embedding") & F.col("vec_id").isNotNull())
    return kept.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


class Ball(NamedTuple):
    center: np.ndarray
    radius: float
    first: int
    last: int
    left: int  # -1 for a leaf
    right: int


def ball_tree(x: np.ndarray, leaf: int) -> tuple[np.ndarray, list[Ball]]:
    """An order of the rows and balls over stretches of it; a ball splits at the median along the
    direction between two far points."""
    order, balls = np.arange(len(x)), []

    def build(first: int, last: int) -> int:
        rows = x[order[first:last]]
        center = rows.mean(0)
        away = np.sqrt(((rows - center) ** 2).sum(1))
        me = len(balls)
        balls.append(Ball(center, float(away.max()), first, last, -1, -1))
        if last - first > leaf:
            p = rows[away.argmax()]
            q = rows[((rows - p) ** 2).sum(1).argmax()]
            mid = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(rows @ (q - p), mid)]
            balls[me] = balls[me]._replace(left=build(first, first + mid), right=build(first + mid, last))
        return me

    if len(x):
        build(0, len(x))
    return order, balls


def search(ids: np.ndarray, x: np.ndarray, balls: list[Ball], q: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
    """The k best (score, -id) of one shard, or those that can still be among the k best overall:
    scores below `floor`, the kth score found so far elsewhere, are out of the running.

    A score is exact at any size; one among the best that is no 64-bit number is an error."""
    top: list[tuple[int, int]] = []
    qf = q.astype(np.float64)
    norm = float(np.sqrt(qf @ qf))
    # rounding errors of the bound stay far below this
    reach = [float(np.sqrt(b.center @ b.center)) + b.radius for b in balls[:1]]
    slack = 1e-6 * (1 + norm) + 1e-11 * norm * sum(reach)
    bound = lambda b: float(qf @ b.center) + norm * b.radius * (1 + 1e-9) + slack
    if reach and 2 * norm * reach[0] >= SAFE:
        x, q = x.astype(object), q.astype(object)
    todo = [(-bound(balls[0]), 0)] if balls else []
    while todo:
        limit, at = heapq.heappop(todo)
        least = top[0][0] if len(top) == k else None
        if floor is not None and (least is None or floor > least):
            least = floor
        if least is not None and -limit < least:
            break
        b = balls[at]
        if b.left >= 0:
            heapq.heappush(todo, (-bound(balls[b.left]), b.left))
            heapq.heappush(todo, (-bound(balls[b.right]), b.right))
            continue
        for s, i in zip((x[b.first : b.last] @ q).tolist(), ids[b.first : b.last].tolist()):
            if i != own and (floor is None or s >= floor):
                if len(top) < k:
                    heapq.heappush(top, (s, -i))
                elif (s, -i) > top[0]:
                    heapq.heapreplace(top, (s, -i))
    wide = [-i for s, i in top if not -(1 << 63) <= s < 1 << 63]
    if wide:
        raise OverflowError(f"the inner product of vectors {own} and {wide[0]} doesn't fit 64 bits")
    return top


def index(vectors: DataFrame, shard_rows: int = 8192, leaf: int = 64) -> DataFrame:
    """One row a shard: its number, ids and vectors in tree order and balls. Every usable vector is indexed.

    Rows are dealt to shards by hash; vectors of another length than the first are a shard's own group."""
    rows = scaled(vectors)
    shards = max(1, -(-rows.count() // shard_rows))
    names = ["dim", "ids", "vectors", "tree"]

    def run(batches: Batches) -> Batches:
        by_dim: dict[int, list[tuple[int, list[int]]]] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_dim.setdefault(len(v), []).append((i, v))
        for dim, own in by_dim.items():
            for at in range(0, len(own), 2 * shard_rows):
                part = sorted(own[at : at + 2 * shard_rows])
                ids, x = np.array([i for i, _ in part], dtype="<i8"), np.array([v for _, v in part], dtype="<i8")
                order, balls = ball_tree(x.astype(np.float64), leaf)
                tree = b"".join(np.array([b.first, b.last, b.left, b.right, b.radius, *b.center], dtype="<f8").tobytes() for b in balls)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[order].tobytes()], pa.binary()), pa.array([x[order].tobytes()], pa.binary()), pa.array([tree], pa.binary())], names)

    built = rows.repartition(shards, "vec_id").mapInArrow(run, "dim int, ids binary, vectors binary, tree binary")
    return written(built.select(F.spark_partition_id().alias("shard"), "*"), "balls")


def top_k(vectors: DataFrame, queries: Column, k: int = 10, shard_rows: int = 8192, block: int = 4096, leaf: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that `queries` picks, the k largest inner products
    with any other row, ties to the smaller id.

    Queries go to the shards in blocks of at most `block` vectors, which bounds both the broadcast and
    what the driver holds: a block's vectors and kth scores. Where a round has fewer shards than tasks could
    run, each shard is searched by several tasks, with some of the queries each. Vectors that are null, empty
    or hold a null or a value that is not finite take no part; vectors of other lengths than the query's
    neither. Rows that repeat an id are candidates each; as a query, the one with the least vector counts. A
    score among the best that doesn't fit 64 bits is an error. An empty table gives none.
    """
    spark = vectors.sparkSession
    shards = index(vectors, shard_rows, leaf)
    asked = written(scaled(vectors.where(queries)).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    last = shards.agg(F.max("shard")).first()[0]
    out = spark.createDataFrame([], FOUND)
    for low, high in _ranges(asked, block) if last is not None else []:
        rows = asked.where(F.col("vec_id").between(low, high)).collect()
        out = out.union(_searched(shards, last + 1, [(r.vec_id, r.v) for r in rows], k))
    return placed(out).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def placed(found: DataFrame) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))


def rounds(shards: int) -> list[tuple[int, int]]:
    """First and last number (not included) of the shards of each round."""
    out, done, size = [], 0, 1
    while done < shards:
        out.append((done, min(shards, done + size)))
        done, size = done + size, size * GROWTH
    return out


def _ranges(asked: DataFrame, block: int) -> list[tuple[int, int]]:
    """Ranges of ids with at most `block` queries each: the ends of every block, none else, are fetched."""
    n = asked.count()
    if n <= block:
        r = asked.agg(F.min("vec_id"), F.max("vec_id")).first()
        return [(r[0], r[1])] if n else []
    cut = asked.select(F.col("vec_id").alias("q")).repartitionByRange(max(1, -(-n // (8 * block))), "q")

    def ends(batches: Batches) -> Batches:
        held: list[int] = []
        for batch in batches:
            held += batch.column(0).to_pylist()
        held.sort()
        for i in range(0, len(held), block):
            part = held[i : i + block]
            yield pa.RecordBatch.from_arrays([pa.array([part[0]]), pa.array([part[-1]])], ["low", "high"])

    return sorted((r.low, r.high) for r in cut.mapInArrow(ends, "low long, high long").collect())


def _searched(shards: DataFrame, n_shards: int, rows: list[tuple[int, list[int]]], k: int) -> DataFrame:
    """What the shards' searches find for a block of queries; each round starts from the kth score of all before."""
    spark = shards.sparkSession
    shared = spark.sparkContext.broadcast(rows)
    found = spark.createDataFrame([], FOUND)
    for n, (first, last) in enumerate(rounds(n_shards)):
        # at most `block` rows
        kth = {r.query_id: r.score for r in placed(found).where(F.col("rank") == k).select("query_id", "score").collect()} if n else {}
        slices = min(len(rows), -(-spark.sparkContext.defaultParallelism // (last - first)))
        searched = _round(shards.where(F.col("shard").between(first, last - 1)), shared, spark.sparkContext.broadcast(kth), k, slices, last - first)
        found = found.union(written(searched, "found"))
    return found


def _round(shards: DataFrame, queries, floors, k: int, slices: int, n_shards: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            for dim, ids, x, tree, part in zip(*(c.to_pylist() for c in batch.columns)):
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(x, "<i8").reshape(-1, dim)
                flat = np.frombuffer(tree, "<f8").reshape(-1, dim + 5)
                balls = [Ball(b[5:], b[4], int(b[0]), int(b[1]), int(b[2]), int(b[3])) for b in flat]
                got = [(i, -j, s) for i, q in queries.value[part::slices] if len(q) == dim for s, j in search(ids, x, balls, np.array(q, dtype=np.int64), i, k, floors.value.get(i))]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["query_id", "vec_id", "score"])

    dealt = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(n_shards * slices, "shard", "part")
    return dealt.select("dim", "ids", "vectors", "tree", "part").mapInArrow(run, FOUND)
