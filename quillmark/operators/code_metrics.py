"""How one author comments code: sizes, markers, connectives and typography, by genre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.text import half_up, utf16_len, whole_word
from quillmark.operators.habits import TYPOGRAPHY, probe_shares
from quillmark.operators.metrics import floor_percentiles, share

#: Markers and connectives that are counted, once a block.
MARKERS = ["TODO", "HACK", "NOTE", "REVIEW", "FIXME", "XXX", "WARN", "IMPORTANT"]
CONNECTIVES = ["потому что", "так как", "поэтому", "то есть", "для того чтобы", "дело в том что", "иначе", "чтобы не", "because", "so that", "otherwise"]
LEAST_LINES = 200


def genre() -> Column:
    return F.when(F.col("is_doc"), "jsdoc").otherwise("code")


def genre_sizes(blocks: DataFrame) -> DataFrame:
    """genre, blocks, line_width and block_lines as structs of percentiles, one_liners, russian."""
    rows = blocks.withColumns({"genre": genre(), "span": F.size("lines")})
    wide = rows.select("genre", F.explode("lines").alias("line")).where("line <> ''").withColumn("width", utf16_len(F.col("line")))
    width = floor_percentiles(wide, ["genre"], "width").select("genre", F.struct("median", "p75", "p90", "max").alias("line_width"))
    spans = floor_percentiles(rows, ["genre"], "span").select("genre", F.col("median").alias("m"), F.col("p90").alias("n"))
    multi = floor_percentiles(rows.where("span > 1"), ["genre"], "span").select("genre", F.col("median").alias("mm"))
    base = rows.groupBy("genre").agg(F.count("*").alias("blocks"), share(F.col("span") == 1).alias("one_liners"), share(F.col("lang") == "ru").alias("russian"))
    out = base.join(width, "genre", "left").join(spans, "genre", "left").join(multi, "genre", "left")
    return out.select("genre", "blocks", "line_width", F.struct(F.col("m").alias("median"), F.coalesce("mm", F.lit(0)).alias("median_multi"), F.col("n").alias("p90"), "one_liners").alias("block_lines"), "russian")


def phrase_counts(blocks: DataFrame, phrases: dict[str, str], lower: bool) -> DataFrame:
    """name, n, share of blocks that a pattern matches; most frequent first by place."""
    text = F.lower("text") if lower else F.col("text")
    each = blocks.agg(F.count("*").alias("_all"), *[F.sum(F.when(text.rlike(p), 1).otherwise(0)).alias(f"_{k}") for k, p in enumerate(phrases.values())])
    rows = each.select("_all", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_{k}").alias("n")) for k, n in enumerate(phrases)])).alias("x")).where("x.n > 0")
    return rows.select("x.name", "x.n", half_up(F.col("x.n") / F.greatest("_all", F.lit(1)), 3).alias("share"))


def marker_counts(blocks: DataFrame) -> DataFrame:
    return phrase_counts(blocks, {m: rf"(?<![A-Za-z0-9_]){m}(?![A-Za-z0-9_])" for m in MARKERS}, lower=False)


def connective_counts(blocks: DataFrame) -> DataFrame:
    return phrase_counts(blocks, {c: c if c.isascii() else whole_word(c) for c in CONNECTIVES}, lower=True)


def split_markers(counts: DataFrame) -> DataFrame:
    """own, foreign: arrays of markers; the own are those met at least a tenth as often as the first."""
    top = Window.partitionBy(F.lit(0))  # MARKERS has eight
    own = counts.withColumn("top", F.max("n").over(top)).where("n >= top / 10").agg(F.collect_set("name").alias("own"))
    vocabulary = F.array(*map(F.lit, MARKERS))
    return own.select(F.array_intersect(vocabulary, "own").alias("own"), F.array_except(vocabulary, "own").alias("foreign"))


def totals(blocks: DataFrame) -> DataFrame:
    spoken = F.size(F.filter("lines", lambda x: x != ""))
    return blocks.agg(F.count("*").alias("blocks"), F.coalesce(F.sum(spoken), F.lit(0)).alias("lines"), F.coalesce(F.sum(F.when(F.col("is_doc"), 1).otherwise(0)), F.lit(0)).alias("doc"), share(F.col("lang") == "ru").alias("russian"))


def repositories(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("repo").agg(F.count("*").alias("blocks"))


def typography(blocks: DataFrame, until: int = 0) -> DataFrame:
    """genre, label, hits, share over comment lines written before `until` (0: all); genres with fewer
    than LEAST_LINES lines stay unmeasured."""
    handwritten = blocks.where(F.col("year") < until) if until else blocks
    lines = handwritten.select(genre().alias("genre"), F.explode("lines").alias("line")).where("line <> ''")
    enough = lines.groupBy("genre").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_LINES).select("genre")
    return probe_shares(lines, TYPOGRAPHY, "line", ["genre"]).join(enough, "genre", "left_semi")
