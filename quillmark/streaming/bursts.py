"""Bursts over a stream of messages: session windows for counts, and turns by the batch rules with state by chat."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillmark.config import Config

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MESSAGE = "pos long, ts long, is_owner boolean, fits boolean, clean string, reply_to long, register string"
OPEN = "pos long, ts long, reply_to long, register string, parts array<string>, last long"
TURN = "chat_key string, pos long, ts long, reply_to long, register string, parts array<string>"


def burst_sessions(messages: DataFrame, gap_seconds: int = 90, late: str = "6 hours") -> DataFrame:
    """chat_key, author, start, end, n_parts, chars: a session window for each author's run of messages
    (event_time, chat_key, from_id, text). Messages later than `late` behind the newest are dropped.

    The session's state is two sums, so a long session holds no texts."""
    timely = messages.withWatermark("event_time", late) if messages.isStreaming else messages
    return (
        timely.groupBy("chat_key", F.col("from_id").alias("author"), F.session_window("event_time", f"{gap_seconds} seconds").alias("w"))
        .agg(F.count("*").alias("n_parts"), F.sum(F.length("text")).alias("chars"))
        .select("chat_key", "author", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_parts", "chars")
    )


def ingest(messages: DataFrame, path: str, checkpoint: str):
    """Appends redacted micro-batches to a table, exactly once by the checkpoint; ends when all is read."""
    from quillmark.operators.redact import scrubbed

    clean = messages.withColumn("text", scrubbed(F.col("text")))
    return clean.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Turns(StatefulProcessor):
    """One chat's open turn, and its messages that the watermark hasn't reached.

    A message waits until none can come before it any more, so order of arrival doesn't matter within the
    watermark's delay. State is what arrives in that delay, and one turn of at most `max_parts` parts."""

    def __init__(self, window: int, cap: int):
        self.window, self.cap = window, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", MESSAGE)
        self.open = handle.getValueState("open", OPEN)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(r.pos, r.ts, r.is_owner, r.fits, r.clean, r.reply_to, r.register) for r in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(m[1] for m in new) * 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        held = [tuple(m) for m in self.waiting.get()]
        due = sorted((m for m in held if m[1] * 1000 <= until), key=lambda m: (m[1], m[0]))
        now = tuple(self.open.get()) if self.open.exists() else None
        closed = []
        for pos, ts, own, fits, clean, reply_to, register in due:
            if now and (not own or (fits and (len(now[4]) >= self.cap or ts - now[5] > self.window))):
                closed.append(now)
                now = None
            if fits:
                now = (*now[:4], [*now[4], clean], ts) if now else (pos, ts, reply_to, register, [clean], ts)
            elif own and now:
                now = (*now[:5], ts)  # carries the time on
        if now and (now[5] + self.window) * 1000 <= until:
            closed.append(now)
            now = None
        if due:
            rest = [m for m in held if m[1] * 1000 > until]
            self.waiting.put(rest) if rest else self.waiting.clear()
        if now:
            self.open.update(now)
            self.handle.registerTimer((now[5] + self.window) * 1000)
        else:
            self.open.clear()
        return iter([Row(chat_key=key[0], pos=t[0], ts=t[1], reply_to=t[2], register=t[3], parts=list(t[4])) for t in closed])


def turn_stream(marked: DataFrame, config: Config | None = None, late: str = "6 hours") -> DataFrame:
    """Turns of a stream of `turns.judged` messages, as `turns.bursts` gives them: chat_key, pos, ts, reply_to,
    register and parts, each once it can't grow any more.

    Messages are read in order of time and then pos, whatever order they come in, up to `late` behind the newest;
    those that come after the watermark has passed them are dropped, and so are those without a chat or a time. Files that were read in order
    give the turns of the batch rules where no message has an earlier time than one before it. Who quoted
    whom is for a join with what is stored. State needs the RocksDB store."""
    spark = marked.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        raise ValueError(f"turns by state need a RocksDB store: set {PROVIDER}")
    config = config or Config()
    fits = F.col("is_owner") & F.col("reason").isNull()
    rows = marked.where("chat_key is not null and ts is not null").select(
        F.timestamp_seconds("ts").alias("event_time"), "chat_key", F.col("pos").cast("long").alias("pos"), F.col("ts").cast("long").alias("ts"), "is_owner", fits.alias("fits"), F.when(fits, F.col("clean")).alias("clean"), F.col("reply_to").cast("long").alias("reply_to"), "register"
    )
    keyed = rows.withWatermark("event_time", late).groupBy("chat_key")
    return keyed.transformWithState(Turns(config.burst_window_seconds, config.max_parts), TURN, "append", "eventTime")
