"""Removal of private data from messages: tagged entities, then what the tags missed.

Surnames may be very many. `named` finds for each text the few that can stand in it, by joins over distinct
words; only these become the text's own pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import EDGE, SPACE, SPACES, trimmed

#: What stands for a tagged entity. Commands vanish; all other kinds keep their text.
PLACEHOLDERS = {"phone": "<телефон>", "email": "<почта>", "bank_card": "<карта>", "link": "<ссылка>", "mention": "@собеседник", "mention_name": "@собеседник"}
DROPPED = ("bot_command",)
SURNAME = "<имя>"
#: Words that placeholders bring into a text.
PLACEHOLDER_WORDS = ("ссылка", "телефон", "почта", "карта", "имя", "собеседник")

EMAIL = rf"(?i){EDGE}[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+\.[a-z]{{2,}}{EDGE}"
#: The lookaheads at the start are implied by what follows; they leave most places of a text at once.
CARD = rf"(?=[0-9]){EDGE}(?:[0-9][ -]?){{13,19}}{EDGE}"
#: Ten digits at least, which the lookahead asks for.
PHONE = rf"(?=[+0-9])(?=\+?(?:[{SPACES}()-]*[0-9]){{10}})\+?[0-9][0-9{SPACES}()-]{{9,}}[0-9]"


def emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, PLACEHOLDERS["email"])).otherwise(text)


def cards(text: Column) -> Column:
    return F.regexp_replace(text, CARD, PLACEHOLDERS["bank_card"])


def phones(text: Column) -> Column:
    return F.regexp_replace(text, PHONE, PLACEHOLDERS["phone"])


def spaces(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, "[ \t]+", " "))


#: What a word is made of, and characters that mean something in a pattern.
LETTER, SPECIAL = r"[\p{L}\p{N}_]", r"([.*+?^${}()|\[\]\\-])"
LEAST_NAME = 4
#: Rows that may be broadcast.
MOST_BROADCAST = 1 << 20


def surnames(text: Column, names: list[str]) -> Column:
    """Names of four letters or more with whatever ending, longest first, between letters of any script. For
    names that are few and known; else see `named`."""
    known = sorted({n.strip() for n in names if len(n.strip()) >= LEAST_NAME}, key=lambda n: (-len(n), n))
    if not known:
        return text
    return F.regexp_replace(text, name_pattern("|".join(re.sub(SPECIAL, r"\\\1", n) for n in known)), SURNAME)


def name_pattern(names: str) -> str:
    return rf"(?iu)(?<!{LETTER})(?:{names}){LETTER}*"


def own_surnames(text: Column, names: Column) -> Column:
    """The same for names that each row has for itself; a null or empty array leaves the text as it is."""
    ordered = F.array_sort(F.transform(names, lambda n: F.struct((-F.length(n)).alias("k"), n.alias("n"))))
    spelled = F.array_join(F.transform(ordered, lambda x: F.regexp_replace(x["n"], SPECIAL, r"\\$1")), "|")
    head, tail = name_pattern("\0").split("\0")
    return F.when(F.size(names) > 0, F.regexp_replace(text, F.concat(F.lit(head), spelled, F.lit(tail)), F.lit(SURNAME))).otherwise(text)


def caseless(text: Column) -> Column:
    """One spelling for all that a pattern takes as equal but for case; it may take more as equal."""
    return F.translate(F.lower(F.upper(text)), "ς\u0307", "σ")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(caseless(text), F.lit(f"{LETTER}+"), F.lit(0)))


def checked_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else df


def words_with_names(words: DataFrame, names: DataFrame) -> DataFrame:
    """word, names: for each distinct word (column word) the names (column surname) that may begin there.

    A name's first run of letters is the word's beginning, or, where the name goes on after it, the whole
    word. So each word is looked up by its beginnings. Names without a letter or digit go with every word."""
    known = names.select(F.trim("surname").alias("name")).where(F.length("name") >= LEAST_NAME).distinct()
    run = F.regexp_extract(caseless(F.col("name")), f"({LETTER}+)", 1)
    known = known.select("name", run.alias("run"), F.length(run).alias("_n"))
    bounds = known.agg(F.min("_n"), F.max("_n")).first()
    low, high = bounds[0] or 0, bounds[1] or 0
    begins = F.transform(F.sequence(F.lit(low), F.least(F.length("word"), F.lit(high))), lambda n: F.substring(F.col("word"), F.lit(1), n))
    each = words.select("word").distinct().where(F.length("word") >= low).select("word", F.explode(begins).alias("run"))
    return each.join(checked_broadcast(known.select("name", "run")), "run").groupBy("word").agg(F.collect_set("name").alias("names"))


def named(rows: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """Rows with an array column `own_names` of the surnames that may stand in their text; null for none. The
    keys tell rows apart.

    Distinct words meet the names once. Rows then look their words up: by broadcast where the words with
    names are few, else by a join on words, in which a row takes part with each of its words."""
    said = rows.select(*keys, F.explode(words_of(F.col(text))).alias("word"))
    hits = checked_broadcast(words_with_names(said, names).persist())
    found = said.join(hits, "word").select(*keys, F.explode("names").alias("name"))
    own = found.groupBy(*keys).agg(F.collect_set("name").alias("own_names"))
    return rows.join(own, keys, "left")


def scrubbed(text: Column, names: list[str] | None = None) -> Column:
    """Cards go before phones, which would else eat them."""
    return spaces(surnames(phones(cards(emails(text))), names or []))


def cleaned(entities: Column, names: list[str] | None = None) -> Column:
    """The text of an array of (type, text) entities without private data."""
    return scrubbed(untagged(entities), names)


def untagged(entities: Column) -> Column:
    """The text of an array of (type, text) entities, tagged ones by their placeholders."""
    told = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    kept = F.filter(entities, lambda e: ~e["type"].isin(*DROPPED))
    return F.array_join(F.transform(kept, lambda e: F.coalesce(F.get(F.array(told[e["type"]]), 0), e["text"])), "")


def scrubbed_rows(rows: DataFrame, keys: list[str], text: str, names: DataFrame) -> DataFrame:
    """Rows whose text has no private data left, by any number of surnames; the same as `scrubbed`."""
    plain = rows.withColumn(text, phones(cards(emails(F.col(text)))))
    return named(plain, keys, text, names).withColumn(text, spaces(own_surnames(F.col(text), F.col("own_names")))).drop("own_names")


def has_substance(text: Column) -> Column:
    """A letter is left when placeholders are taken away."""
    return F.regexp_replace(text, "<[^>]{1,12}>|@собеседник", "").rlike(r"\p{L}")


def surname_rows(names: DataFrame, name: str = "name") -> DataFrame:
    """surname: distinct words after the first of each sender's name."""
    words = F.split(trimmed(F.col(name)), f"{SPACE}+")
    return names.select(F.explode(F.slice(words, 2, F.greatest(F.size(words), F.lit(2)))).alias("surname")).where("surname <> ''").distinct()


def first_name_prefixes(names: DataFrame, name: str = "name", length: int = 4) -> DataFrame:
    """prefix: first letters of first names of that length or longer."""
    first = F.lower(F.get(F.split(trimmed(F.col(name)), f"{SPACE}+"), 0))
    return names.where(F.length(first) >= length).select(F.substring(first, 1, length).alias("prefix")).distinct()
