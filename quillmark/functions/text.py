"""Text functions with the corpus's conventions: lengths in UTF-16 units, Unicode white space, halves rounded up."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the Unicode kind: as characters, as a character class body and as a class.
BLANKS = "\t\n\x0b\f\r " + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
SPACES = r"\t\n\x0B\f\r " + "".join(rf"\x{{{ord(c):X}}}" for c in BLANKS[6:])
SPACE = f"[{SPACES}]"
#: Runs of letters and digits, two or longer. Possessive, as nothing that follows could ask for less.
TOKEN = r"[\p{L}\p{N}]{2,}+"
#: A word's edge that knows ASCII word characters only.
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def wide(text: Column) -> Column:
    """Whether any character lies beyond ASCII: what only such texts can hold need not be looked for in others."""
    return F.octet_length(text) > F.length(text)


def utf16_len(text: Column) -> Column:
    return F.when(wide(text), F.shiftright(F.octet_length(F.encode(text, "UTF-16BE")), 1)).otherwise(F.length(text))


def longer(text: Column, n: Column) -> Column:
    """Whether a text has more than n UTF-16 units. It has no fewer than characters and no more than bytes, so they
    are counted only where these don't tell."""
    return (F.octet_length(text) > n) & ((F.length(text) > n) | (utf16_len(text) > n))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value worked out once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def half_up(x: Column, digits: int = 0) -> Column:
    f = float(10**digits)
    return F.floor(x * f + 0.5) / f


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def shortened(text: Column, n: int) -> Column:
    """At most n characters; what is cut ends in three dots."""
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 3), F.lit("...")))


def near_key(text: Column) -> Column:
    """Texts that differ in case, blanks or punctuation alone have equal keys."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, two or longer, with yo folded."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """How many tokens a text has, without making them."""
    return F.regexp_count(F.lower(text), F.lit(TOKEN))


def whole_word(body: str) -> str:
    """A pattern for `body` between characters that aren't letters, of any script and case."""
    return rf"(?iu)(?<!\p{{L}})(?:{body})(?!\p{{L}})"


def pseudonym(prefix: str, seed: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(seed, 256), 1, 6))


def utc_year(seconds: Column) -> Column:
    return F.year(F.timestamp_seconds(seconds))


@cache
def pictographs() -> list[tuple[int, int]]:
    """Ranges of the Unicode emoji data's pictographs, taken from the property, which Java's patterns don't know."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return [(ord(m[0][0]), ord(m[0][-1])) for m in regex.finditer(r"\p{Extended_Pictographic}+", every)]


def ranged(spans: list[tuple[int, int]]) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in spans)


def emoji_class() -> str:
    """Pictographs, and the katakana letter that chats use as a face."""
    return f"[{ranged(pictographs())}ツ]"


@cache
def emoji_range() -> str:
    """A short class body that holds all emoji, and few letters."""
    return rf"{ranged([x for x in pictographs() if x[1] < 0x2000])}\x{{2000}}-\x{{10FFFF}}"


@cache
def emoji_pattern() -> str:
    """A class of so many ranges is slow to miss, so letters and the like are turned away by a short one before it."""
    return rf"(?=[{emoji_range()}]){emoji_class()}"


def drawn(key: Column, seed: int) -> Column:
    """A number that key and seed alone decide, evenly spread: 52 bits of a hash, so a double holds it."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 13), 16, 10).cast("double")


def around(text: Column, mark: str) -> Column:
    """The mark's first place with the word on either side, blanks as one."""
    from re import escape

    found = F.regexp_extract(text, rf"(?:[^{SPACES}]+{SPACE}+)?[^{SPACES}]*?{escape(mark)}[^{SPACES}]*(?:{SPACE}+[^{SPACES}]+)?", 0)
    return F.regexp_replace(found, f"{SPACE}+", " ")


def code_words(text: Column) -> Column:
    """Distinct lower-case words of three letters or more, camel case and joined names taken apart."""
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\p{L}{3,}+"), F.lit(0)))
    apart = F.flatten(F.transform(runs, lambda w: F.when(w.rlike(r"\p{Ll}\p{Lu}"), F.split(w, r"(?<=\p{Ll})(?=\p{Lu})")).otherwise(F.array(w))))
    return F.array_distinct(F.filter(F.transform(apart, F.lower), lambda w: F.length(w) >= 3))


def shared_words(own: Column, theirs: Column) -> Column:
    """Share of the first words that the others hold; 0 where either are none."""
    share = lambda x: F.when((F.size(x) == 0) | (F.size(theirs) == 0), 0.0).otherwise(F.size(F.array_intersect(x, theirs)) / F.size(x))
    return let(own, share)


def code_overlap(comment: Column, code: Column) -> Column:
    """Share of the comment's words that the code has; 0 where either has none."""
    return let(code_words(code), lambda theirs: shared_words(code_words(comment), theirs))


def script_language(text: Column) -> Column:
    """`ru` where Cyrillic letters are more than 0.3 times the Latin ones, else `en`."""
    ru, en = (F.regexp_count(text, F.lit(p)) for p in ("[а-яёА-ЯЁ]", "[a-zA-Z]"))
    return F.when(ru > en * 0.3, "ru").otherwise("en")


#: Comment syntax by file extension.
SYNTAX = {
    "c": ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "svelte", "vue", "css", "scss", "less", "go", "rs", "java", "kt", "swift", "c", "h", "cpp"],
    "hash": ["fish", "sh", "bash", "zsh", "py", "rb", "toml", "yaml", "yml", "conf"],
    "lua": ["lua"],
}


def comment_syntax(path: Column) -> Column:
    """c, hash, lua, or null for files whose comments aren't read."""
    extension = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit(None).cast("string")
    for kind, extensions in SYNTAX.items():
        out = F.when(extension.isin(extensions), kind).otherwise(out)
    return out
