"""Words that one side uses more than the other: log-odds under a Dirichlet prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import half_up


def word_counts(texts: DataFrame, side: str = "side", text: str = "text") -> DataFrame:
    """side, word, n, n_cap: letters only, lower-cased, yo folded, two letters or longer. n_cap counts
    capitalized uses that don't open the text."""
    folded = F.translate(F.col(text), "ёЁ", "еЕ")
    found = texts.select(F.col(side).alias("side"), F.posexplode(F.regexp_extract_all(folded, F.lit(r"\p{L}+"), F.lit(0))).alias("at", "raw")).withColumn("word", F.lower("raw"))
    capital = (F.col("at") > 0) & (F.substring("raw", 1, 1) != F.substring("word", 1, 1))
    return found.where(F.length("word") >= 2).groupBy("side", "word").agg(F.count("*").alias("n"), F.sum(F.when(capital, 1).otherwise(0)).alias("n_cap"))


def distinctive_words(counts: DataFrame, mine: str, theirs: str, least: int = 40, limit: int = 60, excluded: DataFrame | None = None, prefixes: DataFrame | None = None) -> DataFrame:
    """word, mine, theirs, z, per10k of the `limit` words with the highest z; ties by word.

    One aggregation sets both sides beside each other. Totals and the number of own words are taken
    before any filter, as a row that a broadcast brings. `excluded` has words; `prefixes` first-name
    prefixes of four letters, which veto words of four letters or more. Nothing where a side is empty."""
    on = lambda name, col: F.sum(F.when(F.col("side") == name, F.col(col)).otherwise(0))
    words = counts.groupBy("word").agg(on(mine, "n").alias("y1"), on(theirs, "n").alias("y2"), on(mine, "n_cap").alias("cap"))
    totals = words.agg(F.sum("y1").alias("n1"), F.sum("y2").alias("n2"), F.sum(F.when(F.col("y1") > 0, 1).otherwise(0)).alias("v"))
    kept = words.where((F.col("y1") > 0) & (F.col("y1") + F.col("y2") >= least) & (F.col("cap") / F.greatest("y1", F.lit(1)) <= 0.5))
    if excluded is not None:
        kept = kept.join(excluded, "word", "left_anti")
    if prefixes is not None:
        kept = kept.join(prefixes, (F.length("word") >= 4) & (F.substring("word", 1, 4) == F.col("prefix")), "left_anti")
    rows = kept.crossJoin(F.broadcast(totals)).where("n1 > 0 and n2 > 0")  # totals: one row
    y1, y2, n1, n2 = (F.col(c).cast("double") for c in ("y1", "y2", "n1", "n2"))
    a, a0 = (y1 + y2) * 0.01 + 0.5, (n1 + n2) * 0.01 + F.col("v") * 0.5
    odds = F.log((y1 + a) / (n1 + a0 - y1 - a)) - F.log((y2 + a) / (n2 + a0 - y2 - a))
    z = half_up(odds / F.sqrt(1 / (y1 + a) + 1 / (y2 + a)), 2)
    return rows.select("word", F.col("y1").alias("mine"), F.col("y2").alias("theirs"), z.alias("z"), (half_up(y1 / n1 * 100000) / 10).alias("per10k")).orderBy(F.desc("z"), "word").limit(limit)
