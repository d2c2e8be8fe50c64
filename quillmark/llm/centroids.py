"""Centroid clustering of quantised vectors: Lloyd's rounds over distinct vectors with their multiplicities."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import Batches, spread_join, written

#: Distances of vectors within this bound fit 64 bits for any two vectors of fewer than 128 components.
LARGEST = 1 << 27
PARTS = 1024
#: Below this, products summed in floating point are exact.
EXACT = 1 << 53


def quantised(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, v: vectors with exactly `dims` components, all finite, as whole numbers floor(scale * x).

    A component beyond LARGEST is an error, as distances would leave 64 bits."""
    fit = (F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) <= LARGEST)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    checked = F.when(small, whole).otherwise(F.raise_error(F.lit(f"components beyond {LARGEST} after scaling")).cast("array<int>"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(fit, F.lit(False)))
    return kept.select("vec_id", checked.alias("v"))


def starts(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order: k rows reach the driver. Ids that repeat stand in
    order of their components; rows without an id come last."""
    rank = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(rank.alias("rank"), "v").orderBy(F.asc_nulls_last("rank"), "v").limit(k).collect()
    return np.array([r.v for r in first], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and its squared distance; the smaller number counts among equals."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    largest = int(max(np.abs(x).max(), np.abs(centroids).max()))
    if 4 * largest * largest * x.shape[1] < EXACT:
        xf, cf = x.astype(np.float64), centroids.astype(np.float64)
        d = ((cf * cf).sum(axis=1) - 2 * (xf @ cf.T)).astype(np.int64) + (x * x).sum(axis=1)[:, None]
    else:
        d = np.stack([np.square(x - c).sum(axis=1) for c in centroids], axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def vectors_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def weighted_sums(centroids: np.ndarray) -> Callable[[Batches], Batches]:
    """For mapInArrow over (v, n): one row a task and centroid with the weight and the weighted sums of the
    vectors that fall to it, as exact whole numbers of any size."""

    def run(batches: Batches) -> Batches:
        k, dims = centroids.shape
        sums, weight = np.zeros((k, dims), dtype=object), np.zeros(k, dtype=np.int64)
        for batch in batches:
            x, n = vectors_of(batch, dims), batch.column(1).to_numpy(zero_copy_only=False)
            at, _ = nearest(x, centroids)
            order = np.argsort(at, kind="stable")
            found, begin = np.unique(at[order], return_index=True)
            if not len(found):
                continue
            small = LARGEST * int(n.sum()) < 1 << 63
            many = (x * n[:, None])[order] if small else (x.astype(object) * n.astype(object)[:, None])[order]
            sums[found] += np.add.reduceat(many, begin, axis=0).astype(object)
            weight[found] += np.add.reduceat(n[order], begin)
        rows = [(c, int(weight[c]), [Decimal(int(s)) for s in sums[c]]) for c in range(k) if weight[c]]
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.decimal128(38, 0)))], ["cluster", "weight", "sums"])

    return run


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid becomes the floor of the mean of its vectors, empty ones stay. Spark adds up
    the tasks' sums; k * dims of them reach the driver."""
    told = distinct.select("v", "n").mapInArrow(weighted_sums(centroids), "cluster int, weight long, sums array<decimal(38,0)>")
    each = told.select("cluster", "weight", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("s").alias("s"), F.sum("weight").alias("weight"))
    out = centroids.copy()
    for r in each.collect():
        out[r.cluster, r.dim] = int(r.s) // r.weight
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """v, n, cluster, distance for each distinct vector."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            at, d = nearest(vectors_of(batch, centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(d)], ["v", "n", "cluster", "distance"])

    return distinct.select("v", "n").mapInArrow(run, "v array<int>, n long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = 40, dims: int = 64, scale: int = 256, rounds: int = 5, salt: str = "2") -> DataFrame:
    """One row for each kept row of (vec_id, embedding): vec_id, cluster, distance (squared), cluster_inertia,
    inertia and centroid_sha256.

    Vectors of another length, null ones and those with a null or non-finite component take no part. The k
    starts are the vectors whose `<salt>:<vec_id>` hashes lowest; of fewer vectors each is one. Rows that
    repeat an id count each. Rows with a null id are clustered, and start a cluster only where others are
    lacking. An empty table gives no rows. Other columns are left alone. Sums that leave 64 bits and
    components beyond 2^27 after scaling are errors.

    Identical vectors are counted first; rounds see each distinct vector once, however many rows bear it.
    At the end rows meet their vector's cluster again: a vector's rows are dealt to parts for that."""
    rows = written(quantised(vectors, dims, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    centroids = starts(rows, k, salt)
    if not len(centroids):
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return rows.select("vec_id", *empty)
    distinct = written(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "distinct")
    for _ in range(rounds):
        centroids = moved(distinct, centroids)
    done = written(assigned(distinct, centroids), "assigned")
    per = done.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("cluster_inertia"))
    spread = {r.cluster: r.cluster_inertia for r in per.collect()}  # k rows
    total = sum(spread.values())
    spelled = [(c, spread[c], total, ",".join(map(str, v.tolist()))) for c, v in enumerate(centroids) if c in spread]
    named = rows.sparkSession.createDataFrame(spelled, "cluster int, cluster_inertia long, inertia long, spelled string")
    each = done.drop("n").join(F.broadcast(named.select("cluster", "cluster_inertia", "inertia", F.sha2("spelled", 256).alias("centroid_sha256"))), "cluster")  # k rows
    return spread_join(rows, each, ["v"], "row", PARTS).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
