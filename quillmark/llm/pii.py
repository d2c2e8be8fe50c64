"""Surrogates for personal data: keyed, of the same type and format, the same for the same entity."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import small, texts, Batches

#: Common given names by script and gender.
NAMES = {
    ("latin", "f"): ["Mary", "Anna", "Emma", "Laura", "Sarah", "Julia", "Marie", "Sophie", "Elena", "Carmen", "Ingrid", "Claire", "Susan", "Linda", "Karen", "Helen"],
    ("latin", "m"): ["James", "John", "Peter", "Thomas", "David", "Michael", "Pierre", "Carlos", "Hans", "Juan", "Robert", "William", "Daniel", "Stefan", "Louis", "Miguel"],
    ("cyrillic", "f"): ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Андрей", "Михаил", "Николай"],
}
#: Further given names, taken for one only beside a surname.
MORE_NAMES = {
    ("latin", "f"): ["Olivia", "Priya", "Fatima", "Aisha", "Yuki", "Patricia", "Jennifer", "Elizabeth", "Margaret", "Charlotte", "Isabella", "Camille", "Francesca", "Giulia", "Katarzyna", "Lucía", "Sofía", "Heike", "Sabine", "Ayşe"],
    ("latin", "m"): ["Noah", "Ahmed", "Mohammed", "Omar", "Raj", "Hiroshi", "Richard", "Charles", "Matthew", "Andrew", "Christopher", "George", "Giovanni", "Marco", "Jürgen", "Klaus", "François", "José", "Luis", "Mehmet"],
}
GIVEN = {n.casefold(): kind for kind, names in NAMES.items() for n in names}
MORE = {n.casefold(): kind for kind, names in MORE_NAMES.items() for n in names}
#: Honorifics that announce a surname.
HONORIFICS = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora", "Don", "Doña", "Господин", "Госпожа"]
#: What comes before a name, what comes after one, and what is addressed but is no name.
BEFORE_NAMES = ["my name is", "name:", "dear", "signed", "signed by", "regards,", "sincerely,", "contact:", "attn:", "attention:", "author:", "patient:", "customer:"]
AFTER_NAMES = ["said", "says", "wrote", "writes", "asked", "asks", "replied", "told", "called", "lives", "joined", "answered"]
NO_NAMES = ["sir", "madam", "sirs", "all", "team", "colleague", "colleagues", "friend", "friends", "customer", "customers", "reader", "readers", "the"]

#: In the order in which they claim text: (type, pattern, what a text must hold for it). The named group, if any, is replaced.
PATTERNS = [
    ("email", r"(?<![\w.%+-])[\w.%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])", r"@"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp_|sk-|xox[bp]-)[A-Za-z0-9-]{16,}", r"AKIA|ASIA|ghp_|sk-|xox[bp]-"),
    ("secret", r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_\-+/.]{6,}[A-Za-z0-9_\-+/=])", r"[=:]\s*[\"']?[A-Za-z0-9_\-+/.]{6}"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}\d{2} ?[A-Z0-9]{4}"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)", r"\d\.\d+\.\d"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", r"\d-\d\d-\d"),
    ("card", r"(?<![\d.+])\d(?:[ -]?\d){12,18}(?![\d])", r"\d(?:[ -]?\d){12}"),
    ("phone", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,8}){1,4}(?![\w])|(?<![\w.])\+\d{9,15}(?!\w)|(?<![\w.+-])[2-9]\d{9}(?![\w-])|(?i:(?<![a-z])(?:phone|tel|call|fax|mobile)\.?:? )(?P<value>[2-9]\d\d-\d{4})(?![\w-])", r"\d[ .()-]*\d[ .()-]*\d[ .()-]*\d[ .()-]*\d[ .()-]*\d[ .()-]*\d"),
]
FINDERS = [(kind, re.compile(p), re.compile(needed)) for kind, p, needed in PATTERNS]
DIGIT = re.compile(r"\d")
NEED_DIGITS = {"iban", "ip", "ssn", "card", "phone"}
LEAST_DIGITS = {"phone": 9}
CAPITALIZED = re.compile(r"[A-ZÀ-ÖØ-ÞŚŞŽŠČА-ЯЁ][\w'’-]*")
BEFORE_NAME = re.compile(r"(?i:(?<!\w)(?:" + "|".join(map(re.escape, sorted(BEFORE_NAMES, key=len, reverse=True))) + r"))[ \n]+\Z")
TITLE = re.compile(r"(?<!\w)(?:" + "|".join(HONORIFICS) + r")\.? \Z")
AFTER_NAME = re.compile(r" (?:" + "|".join(AFTER_NAMES) + r")(?!\w)")

#: Letters that stand for each other: within one script, and accented ones among themselves.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "àáâãäåæçèéêëìíîïñòóôõöøùúûüý"]
#: In names vowels stand for vowels and consonants for consonants; signs that are neither stay.
SOUNDS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çñ"]
#: Endings of Russian surnames, which tell gender; they stay.
ENDINGS = ["ская", "ский", "цкая", "цкий", "ова", "ева", "ёва", "ина", "ына", "ов", "ев", "ёв", "ин", "ын", "ко", "ук", "юк"]


class Entity(NamedTuple):
    start: int
    end: int
    kind: str
    value: str


def named(text: str) -> list[Entity]:
    """Names of persons: a known given name, alone or before a surname, in title case or capitals; words that
    follow a title or the like of "my name is"; two capitalized words before the like of "said". Where the
    whole name stands in a text, so do its parts when they come alone."""
    words = []
    for m in CAPITALIZED.finditer(text):
        a, b = m.span()
        if a and (text[a - 1].isalnum() or text[a - 1] == "_"):
            continue
        word = text[a:b]
        for tail in ("'s", "’s", "'", "’", "-"):
            word = word.removesuffix(tail)
        words.append((a, a + len(word), word))
    found: list[Entity] = []
    parts: dict[str, str] = {}
    k = 0
    while k < len(words):
        a, b, w = words[k]
        low = w.casefold()
        follows = words[k + 1] if k + 1 < len(words) and words[k + 1][0] == b + 1 and text[b] == " " and len(words[k + 1][2]) > 1 else None
        if follows and (w.isupper() != follows[2].isupper()):
            follows = None
        # the words just before are looked at only where they can announce a name
        before = text[max(0, a - 24) : a]
        if before[-1:] in (" ", "\n") and TITLE.search(before):
            found.append(Entity(a, b, "surname", w))
            parts[low] = "surname"
            if follows and low not in GIVEN:
                found.append(Entity(follows[0], follows[1], "surname", follows[2]))
                parts[follows[2].casefold()] = "surname"
                k += 1
        elif low in GIVEN or (low in MORE and follows):
            end = follows[1] if follows else b
            found.append(Entity(a, end, "name", text[a:end]))
            if follows:
                parts[follows[2].casefold()] = "surname"
                parts[low] = "name"
                k += 1
        elif low not in NO_NAMES and len(w) > 1 and not before.endswith((" the ", "The ")) and (before[-1:] in (" ", "\n") and BEFORE_NAME.search(before) or follows and follows[2].casefold() not in NO_NAMES and AFTER_NAME.match(text, follows[1])):
            end = follows[1] if follows else b
            found.append(Entity(a, end, "name", text[a:end]))
            parts[low] = "name"
            if follows:
                parts[follows[2].casefold()] = "surname"
                k += 1
        k += 1
    if parts:
        taken = {e.start for e in found}
        inside = {a for e in found for a, b, _ in words if e.start < a < e.end} if len(found) < 50 else spans_inside(found, words)
        found += [Entity(a, b, parts[w.casefold()], w) for a, b, w in words if w.casefold() in parts and a not in taken and a not in inside]
    return found


def spans_inside(found: list[Entity], words: list[tuple[int, int, str]]) -> set[int]:
    """Starts of words that lie inside one of the entities, which are in order of place."""
    out, k = set(), 0
    for a, _, _ in words:
        while k < len(found) and found[k].end <= a:
            k += 1
        if k < len(found) and found[k].start < a:
            out.add(a)
    return out


def detect(text: str) -> list[Entity]:
    """Entities in order of place; earlier patterns claim text first, names last, none overlap."""
    found: list[Entity] = []
    taken = bytearray()
    digits = DIGIT.search(text) is not None

    def claim(e: Entity) -> None:
        nonlocal taken
        taken = taken or bytearray(len(text))
        if e.start < e.end and taken.find(1, e.start, e.end) < 0:
            taken[e.start : e.end] = b"\1" * (e.end - e.start)
            found.append(e)

    for kind, finder, needed in FINDERS:
        if (kind in NEED_DIGITS and not digits) or not needed.search(text):
            continue
        for m in finder.finditer(text):
            short = "value" in finder.groupindex and m["value"] is not None
            if short or sum(map(str.isdigit, m[0])) >= LEAST_DIGITS.get(kind, 0):
                claim(Entity(*m.span("value" if short else 0), kind, m["value" if short else 0]))
    for e in named(text):
        claim(e)
    return sorted(found)


def digest(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode(), key=key, digest_size=8).digest())


def places(alphabets: list[str]) -> dict[str, tuple[int, int]]:
    return {c: (k, i) for k, a in enumerate(alphabets) for i, c in enumerate(a)}


PLACES, SOUND_PLACES = places(ALPHABETS), places(SOUNDS)


def permuted(key: bytes, kind: str, chars: str, alphabets: list[str], place: dict[str, tuple[int, int]]) -> str:
    """A keyed one-to-one map of the strings of one format: digits to digits, letters to letters of
    their alphabet. Two halves take turns shifting each other's characters by keyed amounts, which can
    be undone, so that different entities of a format never meet."""
    at = [place[c] for c in chars]
    form = ",".join(str(a) for a, _ in at)
    x = [i for _, i in at]
    half = (len(x) + 1) // 2
    for turn in range(8):
        own = range(half) if turn % 2 else range(half, len(x))
        other = ",".join(map(str, x[half:] if turn % 2 else x[:half]))
        h = digest(key, kind, form, turn, other)
        for k in own:
            if k % 8 == 0 or k == own[0]:
                h = digest(key, kind, form, turn, other, k)
            x[k] = (x[k] + h) % len(alphabets[at[k][0]])
            h //= 37
    return "".join(alphabets[a][i] for (a, _), i in zip(at, x))


def shaped(key: bytes, kind: str, value: str) -> str:
    """Characters of an alphabet replaced, all else and upper case left as they stand."""
    alphabets, place = (SOUNDS, SOUND_PLACES) if kind in ("surname", "given") else (ALPHABETS, PLACES)
    low = value.lower() if len(value.lower()) == len(value) else value
    at = [i for i, c in enumerate(low) if c in place]
    new = list(value)
    for i, c in zip(at, permuted(key, kind, "".join(low[i] for i in at), alphabets, place)):
        new[i] = c.upper() if value[i] != low[i] and len(c.upper()) == 1 else c
    return "".join(new)


def ending(name: str) -> str:
    low = name.lower()
    return next((e for e in ENDINGS if low.endswith(e) and len(low) > len(e) + 1), "")


def surname(key: bytes, value: str) -> str:
    """Of the same letters' kinds and, in Russian, of the same ending."""
    end = ending(value)
    if not end:
        return walked(key, "surname", value, lambda v: not ending(v))
    stem = value[: len(value) - len(end)]
    new = shaped(key, "surname", stem)
    while ending(new + value[len(stem) :]) != end:
        new = shaped(key, "surname", new)
    return new + value[len(stem) :]


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def walked(key: bytes, kind: str, value: str, valid) -> str:
    """Apply the map until its result is valid; on valid values this is one-to-one as well."""
    new = shaped(key, kind, value)
    while not valid(new):
        new = shaped(key, kind, new)
    return new


def surrogate(key: bytes, kind: str, value: str) -> str:
    """The replacement of an entity: same type, format, script, gender and letter case.

    Cards keep their check digit right (or wrong), addresses stay in range, given names change within
    gender and script, e-mail hosts keep their top-level domain. Phones and cards depend on digits
    alone and e-mail and names not on case, so that all spellings of an entity agree."""
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        was = luhn(digits)
        return refill(value, walked(key, kind, digits, lambda v: luhn(v) == was))
    if kind in ("phone", "ssn", "iban"):
        plain = re.sub(r"[^0-9A-Za-z]", "", value)
        return refill(value, shaped(key, kind, plain))
    if kind == "ip":
        return walked(key, kind, value, lambda v: all(int(o) < 256 and (o[0] != "0" or o == "0") for o in v.split(".")))
    if kind == "email":
        name, host = value.rsplit("@", 1)
        labels = host.split(".")
        return f"{shaped(key, 'mailbox', name)}@{'.'.join([*(shaped(key, 'host', x) for x in labels[:-1]), labels[-1]])}"
    if kind == "key":
        head = next(h for h in ("AKIA", "ASIA", "ghp_", "sk-", "xoxb-", "xoxp-") if value.startswith(h))
        return head + shaped(key, kind, value[len(head) :])
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return hexes(key, value)
    if kind == "name":
        given, _, last = value.partition(" ")
        new = given_name(key, given)
        return f"{new} {surname(key, last)}" if last else new
    if kind == "surname":
        return surname(key, value)
    return shaped(key, kind, value)


def given_name(key: bytes, given: str) -> str:
    """The next of its gender and script in a keyed cycle; a name that isn't known gets one of like letters."""
    low = given.casefold()
    kind = GIVEN.get(low) or MORE.get(low)
    if not kind:
        return shaped(key, "given", given)
    names = NAMES[kind] + MORE_NAMES.get(kind, [])
    order = sorted(range(len(names)), key=lambda i: digest(key, "given", names[i]))
    new = names[order[(order.index([n.casefold() for n in names].index(low)) + 1) % len(names)]]
    return new.upper() if given.isupper() and len(given) > 1 else new


def hexes(key: bytes, value: str) -> str:
    """As `permuted`, over hexadecimal digits."""
    x, half = [int(c, 16) for c in value], (len(value) + 1) // 2
    for turn in range(8):
        own = range(half) if turn % 2 else range(half, len(x))
        other = ",".join(map(str, x[half:] if turn % 2 else x[:half]))
        for k in own:
            x[k] = (x[k] + digest(key, "hex", len(x), turn, other, k)) % 16
    return "".join("0123456789abcdef"[i] for i in x)


def refill(written: str, chars: str) -> str:
    it = iter(chars)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in written)


#: Signs by which spellings of one entity differ.
SPELLING = str.maketrans("", "", " ()+-.")


def identity(kind: str, value: str) -> str:
    """The same for all spellings of an entity that share a surrogate but for case and separators."""
    low = value.casefold()
    return low.translate(SPELLING) if kind in ("phone", "card", "ssn", "iban") else low


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (type, entity, surrogate) of each distinct entity.

    Surrogates of one type and format are one-to-one and depend on key and entity alone, so an entity keeps
    its surrogate in every text, and two never share one; that a surrogate is also another entity of the
    text is no harm, as that one is replaced as well. Collision check: where a surrogate is its own entity,
    or that of an entity of another format in this text, the entity's map is applied again until it is free."""
    found = detect(text)
    if not found:
        return text, []
    new: dict[tuple[str, str], str] = {}
    owner: dict[tuple[str, str], str] = {}
    for e in found:
        if (e.kind, e.value) not in new:
            own, s = identity(e.kind, e.value), surrogate(key, e.kind, e.value)
            for k in range(64):
                if identity(e.kind, s) != own and owner.setdefault((e.kind, identity(e.kind, s)), own) == own:
                    break
                s = surrogate(key + bytes([k]), e.kind, s)
            new[e.kind, e.value] = s
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], new[e.kind, e.value]]
        at = e.end
    return "".join(out) + text[at:], [(k, v, s) for (k, v), s in new.items()]


def pseudonymized(docs: DataFrame, key: bytes) -> DataFrame:
    """Rows of docs, all columns, with surrogates in `text` and, where there is one, n_chars set anew.

    One pass, nothing shuffled. Null and empty texts stay as they are; repeated rows are replaced
    alike; an empty table stays empty. The same key gives the same surrogates everywhere."""

    def run(batches: Batches) -> Batches:
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            new = [t if t is None else replace(t, key)[0] for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            n = batch.schema.get_field_index("n_chars")
            if n >= 0:
                kind = batch.schema.field(n)
                batch = batch.set_column(n, kind, pa.array([old if t is None else len(t) for t, old in zip(new, batch.column(n).to_pylist())], kind.type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def entities(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, kind, entity, surrogate: one row for each distinct entity of each text."""

    def run(batches: Batches) -> Batches:
        for batch in small(batches):
            rows = [(i, *e) for i, t in zip(batch.column(0).to_pylist(), texts(batch)) for e in replace(t, key)[1]]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], ["doc_id", "kind", "entity", "surrogate"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, entity string, surrogate string")


def collisions(found: DataFrame) -> DataFrame:
    """Of `entities`: surrogates that stand for entities which differ by more than case or separators."""
    plain = F.lower(F.regexp_replace("entity", "[ ()+-]", ""))
    return found.groupBy("kind", "surrogate").agg(F.countDistinct(plain).alias("n_entities")).where("n_entities > 1")

