"""Stemmers for Russian and English words, as patterns over a word's regions, and their column form."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillmark.functions.text import tokens

#: Endings of the Russian stemmer. Those under "after а, я" count only behind one of these letters.
ENDINGS = {
    "gerund after а, я": "вшись вши в",
    "gerund": "ывшись ившись ывши ивши ыв ив",
    "adjective": "ыми ими его ого ему ому ей ий ый ой ем им ым ом их ых ую юю ая яя ою ею ее ие ые ое",
    "participle after а, я": "ющ вш нн ем щ",
    "participle": "ующ ивш ывш",
    "reflexive": "ся сь",
    "verb after а, я": "ейте уйте ешь нно ете йте ла на ли ем ло но ет ют ны ть й л н",
    "verb": "ейте уйте ила ыла ена ите или ыли ило ыло ено ует уют ены ить ыть ишь ей уй ил ыл им ым ен ят ит ыт ую ю",
    "noun": "иями ями ами иях ией иям ием ях ах ов ев ие ье еи ии ей ой ий ям ем ам ом ию ью ия ья а е и й о у ы ь ю я",
    "superlative": "ейше ейш",
    "derived": "ость ост",
}
#: Suffixes of the English stemmer and what stands for them, the first that fits counts.
SUFFIXES = "ational:ate tional:tion ization:ize fulness:ful ousness:ous iveness:ive ableness:able ation:ate alism:al aliti:al iviti:ive biliti:ble ement: ment: ence: ance: able: ible: ness: ical:ic ful: ous: ive: ize: er: li:"

#: The longest ending is the match that begins leftmost.
_ENDS = {k: re.compile(("(?<=[ая])" if "after" in k else "") + f"(?:{'|'.join(v.split())})$") for k, v in ENDINGS.items()}
_REGIONS = re.compile("([^аеиоуыэюя]*[аеиоуыэюя]?)(.*)", re.S)
_TWO_PAIRS = re.compile("(?:[^аеиоуыэюя]*[аеиоуыэюя]*){2}")


def _without(text: str, *kinds: str) -> str | None:
    """The text without its longest ending of the first kind that has one; None if none has."""
    return next((text[: m.start()] for k in kinds if (m := _ENDS[k].search(text))), None)


def stem_russian(word: str) -> str:
    if len(word) <= 2:
        return word
    head, tail = _REGIONS.fullmatch(word).groups()
    far = _TWO_PAIRS.match(word).end()
    bare = _without(tail, "gerund after а, я", "gerund")
    if bare is None:
        bare = _without(tail, "reflexive")
        bare = tail if bare is None else bare
        adjective = _without(bare, "adjective")
        if adjective is not None:
            short = _without(adjective, "participle after а, я", "participle")
            bare = adjective if short is None else short
        else:
            short = _without(bare, "verb after а, я", "verb", "noun")
            bare = bare if short is None else short
    bare = bare.removesuffix("и")
    m = _ENDS["derived"].search(head + bare)
    if m and m.start() >= far:
        bare = bare[: m.start() - len(head)] if m.start() >= len(head) else bare
        if m.start() < len(head):
            head, bare = head[: m.start()], ""
    whole = head + bare
    if whole.endswith("нн"):
        return whole[:-1]
    short = _without(bare, "superlative")
    if short is not None:
        whole = head + short
        return whole[:-1] if whole.endswith("нн") else whole
    return whole.removesuffix("ь")


def _measure(stem: str) -> int:
    """How often vowels are followed by something else."""
    return len(re.findall(r"[aeiou]+[^aeiou]+", stem))


def _tidied(stem: str) -> str:
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    return stem[:-1] if re.search(r"([^aeiouylsz])\1$", stem) else stem


_PARTICIPLE = re.compile(r"(.*[aeiouy].*)(?:ed|ing)", re.S)
_SUFFIX = [s.split(":") for s in SUFFIXES.split()]


def stem_english(word: str) -> str:
    if len(word) <= 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) else word
    elif m := _PARTICIPLE.fullmatch(word):
        word = _tidied(m[1])
    if word.endswith("y") and re.search("[aeiouy]", word[:-1]):
        word = word[:-1] + "i"
    word = next((word[: -len(old)] + new for old, new in _SUFFIX if word.endswith(old) and _measure(word[: -len(old)])), word)
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or m == 1 and not re.search(r"[^aeiou][aeiou][^aeiouwxy]$", word[:-1]):
            word = word[:-1]
    return word


@lru_cache(maxsize=500_000)
def stem(word: str) -> str:
    """By script: Russian, English, or the word as it is."""
    if re.search("[а-яё]", word):
        return stem_russian(word)
    return stem_english(word) if re.fullmatch("[a-z]+", word) else word


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])


@F.pandas_udf(StringType())
def _stem(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stems(text: Column) -> Column:
    """Stemmed tokens in order, for few texts such as requests. Arrow batches; each worker remembers the words
    that it has met."""
    return _stems(tokens(text))


def vocabulary(words: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """word, stem for each distinct one of `words` (column word) that `known` lacks: no other word meets Python."""
    distinct = words.select("word").distinct()
    new = distinct if known is None else distinct.join(known.select("word"), "word", "left_anti")
    return new.withColumn("stem", _stem("word"))


def stem_text(text: str) -> list[str]:
    """The same for a request on the driver."""
    found = re.findall(r"[^\W_]+", text.lower().replace("ё", "е"))
    return [stem(w) for w in found if len(w) >= 2]
