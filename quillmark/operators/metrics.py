"""How one author writes: lengths, punctuation, bursts and emoji, by register and window."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.text import SPACE, emoji_pattern, half_up, utf16_len

SHARES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
ENDS = {"ends_period": ".", "ends_question": "?", "ends_exclamation": "!", "ends_paren": ")"}


#: Distinct values of a key that one task may put in order; keys with more are cut into so many ranges first.
WIDEST, RANGES = 1 << 16, 512
#: Parts that a key's rows are dealt to where they meet what is known of their key.
PARTS = 64


def floor_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float] | None = None, widest: int = WIDEST, ranges: int = RANGES) -> DataFrame:
    """keys, count, mean (one digit), the value of rank min(n - 1, floor(n p)) for each share, max.

    Values are counted first, so a key's rows meet as one row for each distinct value, however many
    they are. Only the range of values that holds a rank is put in order (`holding`), so of a key with more
    than `widest` distinct values a task sees some `ranges`th part for a share. Nulls don't count; NaN is
    the greatest value. Keys may be null."""
    shares = shares or SHARES
    each = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cuts = F.percentile_approx(F.col(value).cast("double"), F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(10 * ranges))
    known = each.groupBy(*keys).agg(F.when(F.count("*") > widest, cuts).alias("_cuts"))
    held = holding(each, known, keys, value, shares)
    inside = with_known(each, held, keys, [value, "_n"]).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    ranked = inside.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*keys, "_lo").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    whole = [F.first(f"_all.{c}").alias(c) for c in ("count", "mean", "max")]
    found = [F.min(F.when(F.col("_upto") > F.col(f"_rank_{name}"), F.col(value))).alias(name) for name in shares]
    return ranked.groupBy(*keys).agg(*whole[:2], *found, whole[2])


def with_known(each: DataFrame, known: DataFrame, keys: list[str], columns: list[str], how: str = "inner") -> DataFrame:
    """Rows of `each` with what is known of their key; a key's rows are dealt to PARTS by their value.

    Where Spark finds `known` small it broadcasts it instead."""
    left = each.withColumn("_part", F.pmod(F.xxhash64(*columns), F.lit(PARTS)).cast("int")).alias("l")
    right = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).alias("r")
    same = reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], F.col("l._part") == F.col("r._part"))
    return left.join(right, same, how).select(*[F.col(f"l.{c}") for c in (*keys, *columns)], *[F.col(f"r.{c}") for c in known.columns if c not in keys])


def holding(each: DataFrame, known: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, _lo, _hi (the least and greatest value of a range that holds a wanted rank), for each share
    _rank_<name> (the rank counted from _lo, null where another range holds it), and _all, the key's figures.

    Where a key is cut comes from a sketch; ranks don't: ranges are counted whole, wherever their ends lie."""
    told = with_known(each, known.where("_cuts is not null"), keys, [value, "_n"], "left")
    at = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(value).cast("double"))))
    counted = told.groupBy(*keys, at.alias("_range")).agg(F.sum("_n").alias("_n"), F.sum(F.col(value) * F.col("_n")).alias("_sum"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    key = Window.partitionBy(*keys).orderBy("_range")  # as many rows as ranges
    all_of = key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.sum("_n").over(all_of)
    figures = F.struct(n.alias("count"), half_up(F.sum("_sum").over(all_of) / n, 1).alias("mean"), F.max("_hi").over(all_of).alias("max"))
    placed = counted.withColumns({"_all": figures, "_before": F.sum("_n").over(key.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")})
    rank = lambda p: F.least(F.col("_all.count") - 1, F.floor(F.col("_all.count") * F.lit(p))) - F.col("_before")
    held = {f"_rank_{name}": F.when((rank(p) >= 0) & (rank(p) < F.col("_n")), rank(p)) for name, p in shares.items()}
    return placed.select(*keys, "_lo", "_hi", "_all", *[c.alias(n) for n, c in held.items()]).where(F.coalesce(*held).isNotNull())


def share(condition: Column, digits: int = 3) -> Column:
    return half_up(F.coalesce(F.avg(F.when(condition, 1.0).otherwise(0.0)), F.lit(0.0)), digits)


def messages_of(turns: DataFrame, *keys: str) -> DataFrame:
    return turns.select(*keys, F.explode("parts").alias("message"))


def punctuation(messages: DataFrame, keys: list[str], text: str = "message") -> DataFrame:
    """keys, n and the shares of messages by how they begin, end and what they hold."""
    m, first, last = F.col(text), F.substring(text, 1, 1), F.substring(text, -1, 1)
    alpha = first.rlike(r"\p{L}")
    capital = alpha & (first == F.upper(first)) & (first != F.lower(first))
    of_letters = F.coalesce(F.sum(F.when(capital, 1)), F.lit(0)) / F.greatest(F.coalesce(F.sum(F.when(alpha, 1)), F.lit(0)), F.lit(1))
    return messages.groupBy(*keys).agg(
        F.count("*").alias("n"),
        half_up(of_letters, 3).alias("starts_capital"),
        *[share(last == c).alias(name) for name, c in ENDS.items()],
        share(~last.isin(list(ENDS.values()))).alias("ends_nothing"),
        share(F.contains(m, F.lit("?"))).alias("has_question"),
        share(F.contains(m, F.lit("!"))).alias("has_exclamation"),
        share(F.contains(m, F.lit("...")) | F.contains(m, F.lit("…"))).alias("has_ellipsis"),
        share(m.rlike(f"{SPACE}—{SPACE}")).alias("has_dash"),
    )


def burst_stats(turns: DataFrame, keys: list[str], n_parts: Column | None = None) -> DataFrame:
    """keys, turns, messages and how turns divide into parts."""
    n = F.size("parts") if n_parts is None else n_parts
    rows = turns.withColumn("_n", n)
    c = F.col("_n")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("turns"),
        F.sum("_n").alias("messages"),
        share(c == 1).alias("single"),
        share(c == 2).alias("double"),
        share(c == 3).alias("triple"),
        share(c > 3).alias("more"),
        half_up(F.sum(F.when(c > 1, c).otherwise(0)) / F.greatest(F.sum(c), F.lit(1)), 3).alias("messages_in_bursts"),
        half_up(F.avg(c), 2).alias("mean_parts"),
    )


def emoji_counts(messages: DataFrame, keys: list[str], text: str = "message", top: int = 15) -> DataFrame:
    """keys, char, n, place: each key's most frequent emoji, ties by code point."""
    found = messages.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(emoji_pattern()), F.lit(0))).alias("char"))
    counts = found.groupBy(*keys, "char").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "char"))).where(F.col("place") <= top)


def facets(turns: DataFrame, recent_from: int) -> DataFrame:
    """Turns that aren't held out, once for each facet (facet, window) that they belong to: their
    register and, if long, `longform`; all time and, if new enough, `recent`."""
    names = F.array_compact(F.array(F.col("register"), F.when(F.col("longform"), "longform")))
    windows = F.array_compact(F.array(F.lit("all"), F.when(F.col("year") >= recent_from, "recent")))
    return turns.where("not holdout").withColumn("facet", F.explode(names)).withColumn("window", F.explode(windows))


def measure(turns: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: message_length, turn_length, punctuation, bursts and emoji as structs."""
    said = messages_of(turns, *keys).withColumn("length", utf16_len(F.col("message")))
    nested = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    emoji = emoji_counts(said, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", "char", "n"))).alias("emoji"))
    out = nested(burst_stats(turns, keys), "bursts")
    for part in (nested(floor_percentiles(said, keys, "length"), "message_length"), nested(floor_percentiles(turns, keys, "chars"), "turn_length"), nested(punctuation(said, keys), "punctuation"), emoji):
        out = out.join(part, keys, "left")
    return out


def chosen_window(measured: DataFrame, least_messages: int = 200) -> DataFrame:
    """One row a facet: the recent window's figures if it holds enough messages, else those of all time."""
    recent = F.col("window") == "recent"
    fit = measured.where(~recent | (F.col("bursts.messages") >= least_messages))
    return fit.withColumn("_k", F.row_number().over(Window.partitionBy("facet").orderBy(F.when(recent, 0).otherwise(1)))).where("_k = 1").drop("_k")


def length_bounds(measured: DataFrame) -> DataFrame:
    """facet, short_max, long_min: turns up to the median are short, those from the third quartile long;
    always by the figures of all time."""
    return measured.where(F.col("window") == "all").select("facet", F.col("turn_length.median").alias("short_max"), F.col("turn_length.p75").alias("long_min"))
