"""Shares of texts that carry a habit, each a label and a pattern."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmark.functions.text import SPACES, half_up, whole_word


class Probe(NamedTuple):
    label: str
    pattern: str


S, NOT_S = f"[{SPACES}]", f"[^{SPACES}]"
#: Habits of machine-made Russian.
HABITS = [
    Probe("однако", whole_word("однако")),
    Probe("таким образом", "(?iu)таким образом"),
    Probe("является", whole_word("являетс[яь]")),
    Probe("данный / данная", whole_word("данн(?:ый|ая|ое|ые|ого|ой)")),
    Probe("в рамках", "(?iu)в рамках"),
    Probe("в связи с", "(?iu)в связи с"),
    Probe("осуществлять", "(?iu)осуществл"),
    Probe("следует отметить", "(?iu)(следует|необходимо) отметить"),
    Probe("списки через дефис", rf"(?m)^{S}*[-–—]{S}+{NOT_S}"),
    Probe("нумерованные списки", rf"(?m)^{S}*[0-9][.)]{S}+{NOT_S}"),
    Probe("буллеты •", rf"(?m)^{S}*•"),
    Probe("markdown-жирный **", r"\*\*"),
    Probe("эмодзи 👍", "👍"),
]
#: Marks of a printed book.
FOREIGN_MARKS = [
    Probe("кавычки-ёлочки «»", "[«»]"),
    Probe("длинное тире —", "—"),
    Probe("короткое тире –", "–"),
    Probe("кавычки-лапки “”", "[“”]"),
    Probe("многоточие одним знаком …", "…"),
    Probe("стрелка →", "→"),
]
DOUBLE_HYPHEN = Probe("двойной дефис --", r"(?<![-\p{L}\p{N}/])--(?![-\p{L}\p{N}])")
TYPOGRAPHY = [*FOREIGN_MARKS, DOUBLE_HYPHEN]
LIST_LABELS = ("списки через дефис", "нумерованные списки", "буллеты •")
MARKDOWN_LABELS = ("markdown-жирный **",)
#: Percent: under RARE a habit isn't the author's, under FOREIGN a mark isn't, from OWN on the double hyphen is.
RARE, FOREIGN, OWN = 0.2, 2.0, 1.0

MEASURED = "label string, hits long, share double"


def probe_shares(texts: DataFrame, probes: list[Probe], text: str = "text", keys: list[str] | None = None) -> DataFrame:
    """keys, label, hits, share (percent): all probes counted in one pass, then turned to rows."""
    keys = keys or []
    sums = texts.groupBy(*keys).agg(F.count("*").alias("_all"), *[F.sum(F.when(F.col(text).rlike(p.pattern), 1).otherwise(0)).alias(f"_{k}") for k, p in enumerate(probes)])
    rows = sums.select(*keys, "_all", F.explode(F.array(*[F.struct(F.lit(p.label).alias("label"), F.coalesce(f"_{k}", F.lit(0)).cast("long").alias("hits")) for k, p in enumerate(probes)])).alias("_p"))
    return rows.select(*keys, "_p.label", "_p.hits", (half_up(F.col("_p.hits") / F.greatest("_all", F.lit(1)) * 100000) / 1000).alias("share"))


def habit_share(measured: DataFrame, labels: tuple[str, ...]) -> Column:
    """Largest share among the labels, as a column of an aggregation; null if none was measured."""
    return F.max(F.when(F.col("label").isin(*labels), F.col("share")))


def foreign_marks(measured: DataFrame, declared: tuple[str, ...] = ()) -> DataFrame:
    """label, share of marks that the author all but never types; those matching a declared mark, of
    which another rule speaks, are left out."""
    import re

    rest = [p.label for p in FOREIGN_MARKS if not any(re.search(p.pattern, m) for m in declared)]
    return measured.where(F.col("label").isin(rest) & (F.col("share") < FOREIGN)).select("label", "share").orderBy("share", "label")


def empty_shares(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], StructType.fromDDL(MEASURED))
