"""A chat export of any size, read by byte ranges: one document spreads over as many tasks as it has ranges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators.metrics import with_known

#: Bytes of a range, and of what is read at once where an entry reaches beyond its range.
RANGE, STEP = 32 << 20, 1 << 18
STRING = rb'"(?:[^"\\]|\\.)*"'
#: A key with its plain value, if any, a string, or a bracket.
TOKEN = re.compile(rb"(?P<key>" + STRING + rb")\s*:\s*(?P<value>" + STRING + rb"|[^\s,{}\[\]\"]+)?|" + STRING + rb"|(?P<open>[{\[])|[}\]]")
STRINGS = re.compile(STRING)
#: Brackets open around a section, its list, a chat's fields, its messages, and inside a message.
SECTION, LISTED, CHAT, MESSAGES, INSIDE = 1, 2, 4, 5, 6
FIELDS = {"id": "bigint", "name": "string", "type": "string"}
CARRIED = ["section", "listed", "chat", "field"]
EVENT = "k bigint, kind string, section string, listed string, chat bigint, field string, place bigint, raw string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def stamped(path: str) -> tuple:
    """Size and time of the file: part of every plan over it, so what is cached of an earlier file isn't met."""
    system, name = opened(path)
    info = system.get_file_info(name)
    return info.size, info.mtime_ns


class Span:
    """The lines that begin in one range of a file. A line break is never part of a JSON string, so no
    string reaches over an end of a span."""

    def __init__(self, path: str, stamp: tuple, start: int, size: int):
        system, name = opened(path)
        if stamped(path) != stamp:
            raise OSError(f"{path} has changed while it was read")
        self.file = system.open_input_file(name)
        self.start = self._line_after(start)
        self.end = max(self.start, self._line_after(start + size))
        self.text = self.file.read_at(self.end - self.start, self.start)

    def _line_after(self, at: int) -> int:
        at -= 1
        while 0 <= at < self.file.size():
            found = self.file.read_at(STEP, at).find(b"\n")
            if found >= 0:
                return at + found + 1
            at += STEP
        return max(0, min(at + 1, self.file.size()))

    def longer(self) -> bool:
        """Adds the lines that follow, up to STEP bytes' worth or one line; False at the file's end."""
        at = self.start + len(self.text)
        to = self._line_after(min(at + STEP, self.file.size()))
        self.text += self.file.read_at(to - at, at)
        return to > at


def _depth(span: Span) -> int:
    """Brackets that the span opens less those that it closes."""
    bare = STRINGS.sub(b"", span.text)
    if b'"' in bare:
        raise ValueError(f"a string that doesn't end, in the lines from byte {span.start}")
    return sum(bare.count(c) for c in (b"{", b"[")) - sum(bare.count(c) for c in (b"}", b"]"))


def _entries(span: Span, depth: int, texts: bool, section: str | None, listed: str | None, chat: int | None, field: str | None, place: int) -> Iterator[tuple]:
    """Events of a span (kind, section, listed, chat, field, place, raw): chats that begin, plain fields of
    chats, messages (only with `texts`), and last the state at its end. Unknown context is null; a place
    counts from the last key of a chat, or from `place`."""
    end, at, began, known = len(span.text), 0, None, False
    last = len(span.text.rstrip())
    while True:
        token = TOKEN.search(span.text, at)
        if token is None or (token.end() >= last and token.group()[:1] == b'"'):
            # what begins in the span may end behind it: a message, or a key whose value isn't seen yet
            if (began is not None or (token and token.start() < end)) and span.longer():
                last = len(span.text.rstrip())
                continue
            if token is None and began is not None:
                raise ValueError(f"a message that doesn't end, from byte {span.start + began}")
        if token is None or (began is None and token.start() >= end):
            break
        at = token.end()
        if token["key"]:
            if depth not in (SECTION, LISTED, CHAT):
                continue
            name = json.loads(token["key"])
            if depth == SECTION:
                section, listed = name, ""
            elif depth == LISTED:
                listed = name
            else:
                field, place, known = name, 0, True
                if name in FIELDS and token["value"]:
                    yield "field", section, listed, chat, name, 0, token["value"].decode()
        elif token["open"]:
            depth += 1
            if depth == CHAT and token["open"] == b"{":
                chat, field, place, known = span.start + token.start(), "", 0, True
                yield "chat", section, listed, chat, field, 0, None
            elif depth == INSIDE and token["open"] == b"{":
                began = token.start()
        elif not token.group().startswith(b'"'):
            depth -= 1
            if depth == MESSAGES and began is not None:
                if texts:
                    yield "message", section, listed, chat, field, place, span.text[began:at].decode()
                place, began = place + 1, None
    yield "end", section, listed, chat, field, place, "key" if known else None


def _events(spans: DataFrame, path: str, stamp: tuple, size: int, texts: bool) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.astype(object).where(part.notna(), None).itertuples(index=False):
                span, rows = Span(path, stamp, row.k * size, size), []
                chat = None if row.chat is None else int(row.chat)
                for event in _entries(span, row.depth, texts, row.section, row.listed, chat, row.field, row.place):
                    rows.append((row.k, *event))
                    if len(rows) == 1000:
                        yield pd.DataFrame(rows, columns=columns).astype(whole)
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype(whole)

    columns = [c.split(" ")[0] for c in EVENT.split(", ")]
    whole = {"chat": "Int64", "place": "Int64"}
    return spans.mapInPandas(run, EVENT)


def read_messages(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """pos, raw, section (0 for chats, 1 for left_chats), chat_no, id, name, type: each message of one
    export document as JSON, with its chat's fields and its place there.

    The file is cut at line breaks near each `size` bytes and read three times: brackets are counted, then
    chats and the state at each end are noted, then messages are cut out. Between readings one small row a
    range is carried on in order, so a chat of any size spreads over tasks. A message is read by the task in
    whose range it begins. A document without line breaks is one range. Brackets that don't close, strings
    and messages that don't end are errors; commas are checked inside messages alone."""
    stamp = stamped(path)
    if stamp[0] is None:
        raise FileNotFoundError(path)
    n = max(1, -(-stamp[0] // size))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["net"] = [_depth(Span(path, stamp, k * size, size)) for k in part["k"]]
            yield part

    nets = spark.range(0, n, 1, n).toDF("k").mapInPandas(count, "k bigint, net bigint").persist()
    if nets.agg(F.sum("net")).first()[0] != 0:
        raise ValueError(f"{path}: brackets don't close")
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    none = {c: F.lit(None).cast("bigint" if c == "chat" else "string") for c in CARRIED}
    based = nets.select("k", F.coalesce(F.sum("net").over(before), F.lit(0)).alias("depth"))
    first = _events(based.withColumns(none | {"place": F.lit(0)}).repartition(n), path, stamp, size, False).persist()
    ends = first.where("kind = 'end'").select("k", *CARRIED, "place", F.col("raw").isNotNull().alias("known"))
    carried = ends.withColumn("upto", F.coalesce(F.sum("place").over(before), F.lit(0))).select("k", *[F.last(c, True).over(before).alias(c) for c in CARRIED], (F.col("upto") - F.coalesce(F.last(F.when(F.col("known"), F.col("upto")), True).over(before), F.lit(0))).alias("place"))
    states = based.join(carried, "k")
    told = first.alias("e").join(carried.alias("c"), "k").select("kind", *[F.coalesce(f"e.{c}", f"c.{c}").alias(c) for c in CARRIED], "raw")
    listed = F.col("section").isin("chats", "left_chats") & (F.col("listed") == "list")
    no = F.row_number().over(Window.partitionBy("section").orderBy("chat")) - 1  # one narrow row a chat
    chats = told.where((F.col("kind") == "chat") & listed).select("section", "chat", no.alias("chat_no"))
    fields = told.where(F.col("kind") == "field").groupBy("chat").agg(*[F.max(F.when(F.col("field") == f, F.from_json(F.concat(F.lit('{"v":'), "raw", F.lit("}")), f"v {kind}", {"mode": "FAILFAST"})["v"])).alias(f) for f, kind in FIELDS.items()])
    heads = chats.join(fields, "chat", "left").select("chat", F.when(F.col("section") == "chats", 0).otherwise(1).alias("section"), "chat_no", *FIELDS)
    messages = _events(states.repartition(n), path, stamp, size, True).where((F.col("kind") == "message") & listed & (F.col("field") == "messages"))
    found = messages.select("chat", F.col("place").cast("int").alias("pos"), "raw")
    return with_known(found, heads, ["chat"], ["pos", "raw"]).drop("chat")
