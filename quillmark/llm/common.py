"""Helpers that several operators share: reading, folds, bounded samples, written tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quillmark-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and all runs in one machine (tests) a temporary folder takes its place. The
    setting itself can't be changed in a running session."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or own_dir()).rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back, so lost executors cost no rerun.

    Nothing here knows when a reader of the result is done, so the folder's owner clears it, as with
    checkpoints: all lies in its subfolder `quillmark`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Have Spark hand tasks at most so many rows at a time, as texts may be long: both sides of the way to
    Python hold a batch. A session that was given a number of its own keeps it."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, rows)


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it in any case."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], by: str, parts: int = 64) -> DataFrame:
    """rows left join facts, which have one row a key, where a key may have any share of the rows.

    Rows are dealt to parts by the column `by`. The keys of each part, once each, fetch the facts: at most
    `parts` rows a key meet there. Then every part's rows meet its facts. A null key finds nothing."""
    part = fresh(rows, "part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    told = dealt.select(*keys, part).distinct().join(facts, keys)
    return dealt.join(told, [*keys, part], "left").drop(part)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def bounded_sample(df: DataFrame, id_col: str, rows: int) -> DataFrame:
    """At most `rows` rows, chosen by hashed id; of `rows` or fewer all stay.

    Hashes are counted in some 640 classes, each wider than the one before by a 23rd. Classes are taken from
    the narrowest on while their rows fit; one that doesn't (as for an id that very many rows bear) is left
    out. The driver sees those counts alone, and the rows stay in the tasks that read them."""
    band = F.floor(F.log2(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 40)) + 1) * 16).cast("int")
    counts = sorted((r.band, r["count"]) for r in df.groupBy(band.alias("band")).count().collect())
    chosen, total = [], 0
    for k, n in counts:
        if total + n <= rows:
            chosen.append(k)
            total += n
    return df if len(chosen) == len(counts) else df.where(band.isin(chosen))


def texts(batch: pa.RecordBatch, at: int = 1) -> list[str]:
    """The text column; null becomes the empty text."""
    return [t or "" for t in batch.column(at).to_pylist()]


def summed(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.sum(v).alias(v) for v in values])


Batches = Iterator[pa.RecordBatch]


def small(batches: Batches, rows: int = 256) -> Batches:
    """The same rows in batches of at most `rows`, so that few texts at a time are Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no buffers
