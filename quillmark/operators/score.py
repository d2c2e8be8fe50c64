"""Scores from 0 to 100 of how well texts fit a measured profile: a table of texts in one pass.

Every rule is a column: an array of findings (rule, fragment, penalty), empty where it doesn't apply.
A profile row comes by its register, of which there are five at most."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.config import NeverMark
from quillmark.functions.text import SPACE, SPACES, around, code_overlap, emoji_pattern, emoji_range, longer, shortened, trimmed, utf16_len, whole_word, wide
from quillmark.operators.habits import FOREIGN, FOREIGN_MARKS, RARE, Probe

#: Letters that a phrase in Cyrillic can be met by, in any case.
CYRILLIC = r"[\x{400}-\x{4FF}\x{1C80}-\x{1C88}]"
#: Foreign marks below U+2000.
LOW_MARKS = "«»"
FINDING = "array<struct<rule:string,fragment:string,penalty:int>>"
#: Clerical phrases, and phrases of comments that say nothing.
CLERICAL = [
    Probe("однако", whole_word("однако")),
    Probe("таким образом", "(?iu)таким образом"),
    Probe("является", whole_word("являетс[яь]")),
    Probe("данный", whole_word("данн(?:ый|ая|ое|ые|ого|ой)")),
    Probe("в рамках", "(?iu)в рамках"),
    Probe("в связи с", "(?iu)в связи с"),
    Probe("осуществлять", "(?iu)осуществл"),
    Probe("следует отметить", "(?iu)(следует|необходимо) отметить"),
    Probe("в целом", whole_word("в целом")),
    Probe("стоит отметить", "(?iu)стоит отметить"),
]
FILLER = [
    Probe("назначение", r"(?iu)эт[аот]\p{L}*\s+(метод|функци\p{L}*|класс|компонент)\s+(отвечает|предназначен)"),
    Probe("важно отметить", "(?iu)важно отметить"),
    Probe("стоит учитывать", "(?iu)стоит учитывать"),
    Probe("надёжность", r"(?iu)обеспечива\p{L}*\s+надёжност"),
    Probe("инициализация", "(?imu)^инициализация$"),
]
LIST = rf"(?m)^{SPACE}*([-–—•*]|[0-9][.)]){SPACE}+[^{SPACES}]"
#: Lowest scores of the verdicts.
VERDICTS = [(85, "mine"), (65, "close"), (40, "barely"), (0, "foreign")]


def finding(rule: str, penalty: Column | int, fragment: Column | None = None) -> Column:
    return F.struct(F.lit(rule).alias("rule"), (F.lit(None).cast("string") if fragment is None else fragment).alias("fragment"), F.lit(penalty).cast("int").alias("penalty"))


def when(condition: Column, rule: str, penalty: Column | int, fragment: Column | None = None) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(finding(rule, penalty, fragment))).otherwise(F.lit(None).cast(FINDING))


def each(condition, values: Column, rule: str, penalty, fragment) -> Column:
    return F.transform(F.filter(values, condition), lambda v: finding(rule, penalty(v), fragment(v)))


def probes(text: Column, rule: str, known: list[Probe], penalty: int, cut: int = 60, may: Column | None = None) -> list[Column]:
    """`may` is false where no phrase can be."""
    held = F.lit(True) if may is None else may
    return [when(held & text.rlike(p.pattern), rule, penalty, shortened(F.regexp_extract(text, p.pattern, 0), cut)) for p in known]


def mark_rules(whole: Column, prefix: str, declared: tuple[NeverMark, ...], shares: Column, may: Column) -> list[Column]:
    """Marks that the owner declared, and those whose share (a map by label) says they never type them. `may` is
    false where none of the latter can be."""
    own = [when(F.contains(whole, F.lit(m.mark)), f"{prefix}declared_mark", 15, shortened(around(whole, m.mark), 60)) for m in declared]
    rest = [p for p in FOREIGN_MARKS if not any(re.search(p.pattern, m.mark) for m in declared)]
    return own + [when((F.get(F.array(shares[p.label]), 0) < FOREIGN) & may & whole.rlike(p.pattern), f"{prefix}foreign_mark", 10, F.regexp_extract(whole, p.pattern, 0)) for p in rest]


def looked_over(rows: DataFrame) -> DataFrame:
    """Adds what spares most texts most patterns: _special (there may be an emoji, a foreign mark or Cyrillic, by one
    look at texts that go beyond ASCII) and _cyrillic."""
    special = rf"[{emoji_range()}{LOW_MARKS}{CYRILLIC[1:-1]}]"
    return rows.withColumn("_special", wide(F.col("_w")) & F.col("_w").rlike(special)).withColumn("_cyrillic", F.col("_special") & F.col("_w").rlike(CYRILLIC))


def emoji_in(text: Column) -> Column:
    """All emoji of the text."""
    return F.when(F.col("_special"), F.regexp_extract_all(text, F.lit(emoji_pattern()), F.lit(0))).otherwise(F.array().cast("array<string>"))


def reported(rows: DataFrame, rules: list[Column], ready: Column, n: Column) -> DataFrame:
    """Adds score, verdict, messages and findings, heaviest first, rules in order among equals."""
    arrays = [F.coalesce(r, F.array().cast(FINDING)) for r in rules]
    found = F.when(ready, F.flatten(F.array(*arrays))).otherwise(F.array().cast(FINDING))
    held = rows.withColumns({"_ready": F.coalesce(ready, F.lit(False)), "messages": n, "_found": found})
    total = F.aggregate("_found", F.lit(0), lambda s, f: s + f["penalty"])
    score = F.when(F.col("_ready"), F.greatest(F.lit(0), F.least(F.lit(100), 100 - total))).otherwise(0)
    ordered = F.transform(F.array_sort(F.transform("_found", lambda f, i: F.struct((-f["penalty"]).alias("k"), i.alias("i"), f.alias("f")))), lambda x: x["f"])
    scored = held.withColumns({"score": score, "findings": ordered})
    verdict = F.when(~F.col("_ready"), "nothing to check")
    for least, name in VERDICTS:
        verdict = verdict.when(F.col("score") >= least, name)
    return scored.withColumn("verdict", verdict).drop("_ready", "_found")


def unmeasured(texts: DataFrame) -> DataFrame:
    """texts (id, register, text) of registers without a profile: score 0 and no findings."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda s: trimmed(s) != "")
    none = reported(texts, [F.lit(None).cast(FINDING)], F.lit(False), F.size(parts))
    return none.select("id", "register", "score", "verdict", "messages", "findings")


def check_texts(texts: DataFrame, profile: DataFrame, declared: tuple[NeverMark, ...] = ()) -> DataFrame:
    """texts (id, register, text) against profile rows (register, message_length, turn_length,
    punctuation, bursts, emoji, list_share, markdown_share, mark_shares), shares in percent and null
    where unmeasured, which never counts against a text. Gives id, register, score, verdict, messages,
    findings. Texts without a message, or a register without figures, score 0."""
    rows = texts.select("id", "register", "text").join(F.broadcast(profile), "register", "left")
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), trimmed), lambda s: s != "")
    rows = looked_over(rows.withColumn("_m", parts).withColumn("_w", F.array_join("_m", "\n")))
    m, w, n = F.col("_m"), F.col("_w"), F.size("_m")
    many = lambda cond: F.size(F.filter(m, cond))
    top, p = F.col("message_length.p90"), F.col("punctuation")
    palette = F.transform(F.slice(F.coalesce("emoji", F.array().cast("array<struct<place:int,char:string,n:bigint>>")), 1, 8), lambda e: e["char"])
    foreign = F.array_except(F.array_distinct(emoji_in(w)), palette)
    rules = [
        each(lambda s: longer(s, top), m, "C1 message too long", lambda s: F.least(F.lit(25), 5 + F.floor((utf16_len(s) / F.greatest(top, F.lit(1)) - 1) * 20)), lambda s: shortened(s, 60)),
        when(longer(w, F.col("turn_length.p90")), "C2 whole too long", 10),
        when((F.col("register") != "longform") & (n == 1) & longer(w, top), "C3 one block", 10),
        when(many(lambda s: F.contains(s, F.lit("!"))) > F.greatest(F.lit(1.0), p["has_exclamation"] * n * 3), "C4 exclamations", 10),
        when((p["ends_period"] > 0.5) & (many(lambda s: F.substring(s, -1, 1).rlike(r"[\p{L}\p{N}]")) / F.greatest(n, F.lit(1)) > 0.6), "C5 no final period", 8),
        when((p["starts_capital"] > 0.8) & (many(lambda s: F.substring(s, 1, 1).rlike(r"\p{Ll}")) / F.greatest(n, F.lit(1)) > 0.4), "C6 lower-case start", 8),
        when(F.size(foreign) > 0, "C7 foreign emoji", 6 * F.size(foreign), F.array_join(foreign, " ")),
        when((F.col("list_share") < RARE) & w.rlike(LIST), "C8 list", 15),
        when((F.col("markdown_share") < RARE) & (F.contains(w, F.lit("**")) | F.contains(w, F.lit("__"))), "C9 markdown", 12),
        *probes(w, "C10 clerical", CLERICAL, 10, may=F.col("_cyrillic")),
        *mark_rules(w, "C11 C12 ", declared, F.col("mark_shares"), F.col("_special")),
    ]
    ready = F.col("bursts.messages").isNotNull() & (F.col("bursts.messages") > 0) & (n > 0)
    return reported(rows, rules, ready, n).select("id", "register", "score", "verdict", "messages", "findings")


def check_comments(texts: DataFrame, sizes: DataFrame, own_markers: list[str], foreign_markers: list[str], mark_shares: DataFrame | None = None, declared: tuple[NeverMark, ...] = ()) -> DataFrame:
    """texts (id, register code or jsdoc, text, code) against genre_sizes rows; mark_shares has genre and
    a map mark_shares. A table without sizes scores 0 throughout."""
    profile = sizes.select(F.col("genre").alias("register"), "line_width", "block_lines")
    if mark_shares is not None:
        profile = profile.join(mark_shares.withColumnRenamed("genre", "register"), "register", "left")
    else:
        profile = profile.withColumn("mark_shares", F.lit(None).cast("map<string,double>"))
    strip = lambda s: F.regexp_replace(F.regexp_replace(s, rf"\A{SPACE}*(/\*\*?|\*/|\*|//|#|--){SPACE}?", ""), rf"{SPACE}+\z", "")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), strip), lambda s: trimmed(s) != "")
    rows = texts.select("id", "register", "text", "code").join(F.broadcast(profile), "register", "left").withColumn("_m", lines).withColumn("_w", F.array_join("_m", "\n"))
    rows = looked_over(rows)
    m, w, n = F.col("_m"), F.col("_w"), F.size("_m")
    emoji = emoji_in(w)
    rules = [
        when((F.coalesce("code", F.lit("")) != "") & (code_overlap(w, F.coalesce("code", F.lit(""))) > 0.7), "K1 restates the code", 30, shortened(w, 50)),
        each(lambda s: longer(s, F.col("line_width.p90")), m, "K2 line too wide", lambda s: F.lit(8), lambda s: shortened(s, 60)),
        when(n > F.col("block_lines.p90"), "K3 block too long", 8),
        *[when(w.rlike(rf"(?<![A-Za-z0-9_]){x}(?![A-Za-z0-9_])"), "K4 foreign marker", 12, F.lit(x)) for x in (foreign_markers if own_markers else [])],
        *probes(w, "K5 clerical", CLERICAL, 10, may=F.col("_cyrillic")),
        *probes(w, "K6 filler", FILLER, 12, 40, F.col("_cyrillic")),
        when(F.size(emoji) > 0, "K7 emoji", 10, F.array_join(emoji, " ")),
        *mark_rules(w, "K8 ", declared, F.col("mark_shares"), F.col("_special")),
        when((F.col("register") == "jsdoc") & w.rlike(rf"@(param|returns){SPACE}*\{{"), "K9 typed tag", 12),
    ]
    return reported(rows, rules, F.col("line_width").isNotNull() & (n > 0), n).select("id", "register", "score", "verdict", "messages", "findings")
