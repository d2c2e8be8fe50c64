"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups. DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import spread_join, written

#: Characters that don't tell texts apart.
BLANKS = " \t\n\x0b\f\r"
#: Into so many parts a group's rows are dealt where they meet what is known of their group.
PARTS = 1024


def normalized(text: Column) -> Column:
    """The text without blanks; null is empty. A replacement each is far faster than a pattern."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def content_hash(text: Column) -> Column:
    """128 bits as binary."""
    return F.unhex(F.md5(text))


def facts(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """doc_id, h, norm, sha, n (code points of the text as given): what rows are told apart and ordered by."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("norm"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return rows.select("doc_id", hashed(F.col("norm")).alias("h"), "norm", F.sha2("norm", 256).alias("sha"), "n")


def judged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's size and the row that stays. Groups are summed up where rows are read; a group
    of any size is then dealt to parts, each of which fetches the group's facts once."""
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    told = spread_join(rows, groups, keys, "row", PARTS)
    return told.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def collided(docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """h: hashes under which different normalised texts stand. Equal texts meet, byte by byte, where they
    are read and once more after a shuffle, which moves each distinct text once a task."""
    each = facts(docs, hashed).select("h", "norm").distinct()
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h")


def exact_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts that are equal without blanks form a group. Of it the row with the most code points stays, then
    the one with the smallest doc_id; a null id comes after all others. Of rows that repeat a text under
    the same id exactly one stays. Null texts and texts of blanks alone are one group, as empty. An empty
    table gives no rows. Columns beside doc_id and text are left alone.

    Rows are grouped by hash. Where different texts share one, their rows are grouped by the text itself."""
    digests = written(facts(docs, hashed).drop("norm").withColumn("row", F.monotonically_increasing_id()), "digests")
    double = written(collided(docs, hashed), "collided")
    if double.isEmpty():
        return judged(digests, ["h"])
    apart = written(facts(docs, hashed).join(double, "h", "left_semi").withColumn("row", F.monotonically_increasing_id()), "apart")
    return judged(digests.join(double, "h", "left_anti"), ["h"]).unionByName(judged(apart, ["h", "norm"]))


def deduplicated(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, with all their columns; texts and ids alone decide. The text is matched by its
    SHA-256, its length and its id. Rows that repeat all three are one."""
    own = {c: f"{c}_" + "_" * max(map(len, docs.columns), default=0) for c in ("sha", "n", "id")}
    marked = docs.withColumns({own["sha"]: F.sha2(normalized(F.col("text")), 256), own["n"]: F.length(F.coalesce("text", F.lit(""))), own["id"]: F.col("doc_id").cast("long")})
    stay = exact_duplicates(docs, hashed).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    met = F.col(own["sha"]).eqNullSafe(F.col("_sha")) & F.col(own["id"]).eqNullSafe(F.col("_id"))
    longest = marked.join(stay, met, "left_semi")
    first = longest.groupBy(own["sha"], own["id"]).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), own["n"]).alias("_row"))
    return first.select("_row.*")
