"""Turns: bursts of one author's messages with the message they answer, by window functions alone.

The rules read a chat in export order. A chat is cut into stretches by export position; windows run within
a stretch, so one chat of any length spreads over tasks. What a stretch needs to know of those before it
(the open run, the time of its last message, the parts of the open turn, the pending message) comes from
summaries of one row a stretch, which are put together in order and joined back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.config import Config
from quillmark.functions.text import trimmed, utc_year, utf16_len
from quillmark.operators.redact import has_substance

STRUCTURAL = r"[\[\]{}<>;=]"
#: Export positions in a stretch of a chat.
STRETCH = 1 << 16


def reject_reason(text: Column, is_forwarded: Column, is_via_bot: Column, n_links: Column) -> Column:
    """Why a message isn't its author's own writing; null where it is. The first reason counts."""
    t = trimmed(text)
    share = F.regexp_count(t, F.lit(STRUCTURAL)) / F.greatest(utf16_len(t), F.lit(1))
    return (
        F.when(is_forwarded, "forwarded")
        .when(is_via_bot, "via-bot")
        .when(F.coalesce(t, F.lit("")) == "", "empty")
        .when(t.rlike(r"\A[{\[<]") | (share > 0.03), "structured")
        .when(n_links > 3, "link-spam")
    )


def judged(messages: DataFrame, owner: Column) -> DataFrame:
    """Adds is_owner, substance and reason; messages have chat_key, pos, id, from_id, ts, text (as
    written), clean (redacted), is_forwarded, is_via_bot, n_links and reply_to."""
    substance = (F.coalesce("clean", F.lit("")) != "") & has_substance(F.coalesce("clean", F.lit("")))
    reason = F.coalesce(reject_reason(F.col("text"), F.col("is_forwarded"), F.col("is_via_bot"), F.col("n_links")), F.when(~substance, "empty"))
    return messages.withColumns({"is_owner": F.col("from_id").eqNullSafe(owner), "substance": substance}).withColumn("reason", F.when(~F.col("is_owner"), "not-owner").otherwise(reason))


def filter_stats(marked: DataFrame) -> DataFrame:
    return marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def in_stretches(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("stretch", F.floor(F.col("pos") / size))


def started(marked: DataFrame, config: Config, stretch: int = STRETCH) -> DataFrame:
    """Accepted messages with run, sess and chunk, which together with chat_key name their turn.

    Anyone else's message ends a run; a rejected one of the owner's only carries the time on. Within a
    stretch all is known but for one message: the first accepted one before anyone else's (`lead`) begins a
    turn or goes on with one, as the stretches before have it."""
    here = Window.partitionBy("chat_key", "stretch").orderBy("pos")
    so_far = here.rowsBetween(Window.unboundedPreceding, 0)
    own = F.col("is_owner")
    fit = own & F.col("reason").isNull()
    rows = in_stretches(marked, stretch).withColumns({"others": F.sum(F.when(own, 0).otherwise(1)).over(so_far), "fits": F.sum(F.when(fit, 1).otherwise(0)).over(so_far), "before": F.lag(F.when(own, F.col("ts"))).over(here)})
    rows = rows.withColumn("nth", F.col("fits") - F.coalesce(F.last(F.when(~own, F.col("fits")), ignorenulls=True).over(so_far), F.lit(0)))
    rows = rows.withColumn("lead", fit & (F.col("others") == 0) & (F.col("nth") == 1))
    rows = rows.withColumn("cut", fit & ~F.col("lead") & ((F.col("nth") == 1) | (F.col("ts") - F.col("before") > config.burst_window_seconds)))
    kept = rows.where(fit).join(carried_bursts(rows, config), ["chat_key", "stretch"]).withColumn("cut", F.when(F.col("lead"), F.col("lead_cut")).otherwise(F.col("cut")))
    sess = kept.withColumns({"sess": F.col("sess_base") + F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(so_far), "since": F.last(F.when(F.col("cut"), F.col("fits")), ignorenulls=True).over(so_far)})
    at = F.coalesce(F.col("fits") - F.col("since"), F.col("parts_open") + F.col("fits") - 1)
    return sess.withColumns({"run": F.col("run_base") + F.col("others"), "chunk": F.floor(at / config.max_parts)}).select(*marked.columns, "run", "sess", "chunk")


def carried_bursts(rows: DataFrame, config: Config) -> DataFrame:
    """chat_key, stretch and what the stretches before leave: run_base and sess_base (how many runs ended and
    bursts began), parts_open (messages of the burst that is open) and lead_cut (whether `lead` begins one).

    One row a stretch, so a chat's summaries are few where its messages are many."""
    cuts = F.sum(F.when(F.col("cut"), 1).otherwise(0))
    ends = rows.groupBy("chat_key", "stretch").agg(
        F.max("others").alias("others"),
        F.max_by(F.struct(F.when(F.col("is_owner"), F.col("ts")).alias("ts"), (F.col("nth") > 0).alias("fit")), "pos").alias("last"),
        F.max(F.when(F.col("lead"), F.struct("ts", "before"))).alias("lead"),
        cuts.alias("cuts"),
        F.max("fits").alias("fits"),
        F.max(F.when(F.col("cut"), F.col("fits"))).alias("at_cut"),
    )
    chat = Window.partitionBy("chat_key").orderBy("stretch")
    so_far, former = chat.rowsBetween(Window.unboundedPreceding, 0), chat.rowsBetween(Window.unboundedPreceding, -1)
    # an accepted message waits in the open run if one came after the last stretch in which someone else spoke, that one included
    spoken = ends.withColumn("spoken", F.sum(F.when(F.col("others") > 0, 1).otherwise(0)).over(so_far))
    waits = spoken.withColumn("waits", F.max("last.fit").over(Window.partitionBy("chat_key", "spoken").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.col("lead.ts") - F.coalesce("lead.before", F.lag("last.ts").over(chat))
    told = waits.withColumn("lead_cut", F.when(F.col("lead").isNotNull(), ~F.coalesce(F.lag("waits").over(chat), F.lit(False)) | (gap > config.burst_window_seconds)))
    told = told.withColumn("begun", F.col("cuts") + F.when(F.col("lead_cut"), 1).otherwise(0))
    told = told.withColumns({"open": F.sum(F.when(F.col("begun") > 0, 1).otherwise(0)).over(so_far), "tail": F.when(F.col("cuts") > 0, F.col("fits") - F.col("at_cut") + 1).otherwise(F.col("fits"))})
    told = told.withColumn("tail", F.sum("tail").over(Window.partitionBy("chat_key", "open").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)))
    base = lambda c: F.coalesce(F.sum(c).over(former), F.lit(0))
    return told.select("chat_key", "stretch", "lead_cut", base("others").alias("run_base"), base("begun").alias("sess_base"), F.coalesce(F.lag("tail").over(chat), F.lit(0)).alias("parts_open"))


def bursts(marked: DataFrame, config: Config, stretch: int = STRETCH) -> DataFrame:
    """One row a turn: chat_key, pos and ts of its first message, reply_to, parts in order."""
    first = F.min_by(F.struct("pos", "ts", "reply_to", "register"), "pos")
    return (
        started(marked, config, stretch)
        .groupBy("chat_key", "run", "sess", "chunk")
        .agg(first.alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "clean"))), lambda p: p["clean"]).alias("parts"))
        .select("chat_key", "first.*", "parts")
    )


def with_context(turns: DataFrame, marked: DataFrame, config: Config, stretch: int = STRETCH) -> DataFrame:
    """Adds context_in, context_explicit and context_lag: the quoted message if there is one, else the
    last thing said since the turn before, unless too long ago. One incoming message serves one turn."""
    others = marked.where(~F.col("is_owner") & F.col("substance"))
    heard = others.select("chat_key", "pos", F.struct("pos", "ts", F.substring("clean", 1, config.context_max_chars).alias("text")).alias("said"), F.lit(None).cast("struct<pos:bigint,ts:bigint>").alias("turn"))
    starts = turns.select("chat_key", "pos", F.lit(None).cast("struct<pos:bigint,ts:bigint,text:string>").alias("said"), F.struct(F.col("pos").cast("long").alias("pos"), F.col("ts").cast("long").alias("ts")).alias("turn"))
    both = in_stretches(heard.select("chat_key", "pos", F.col("said").cast("struct<pos:bigint,ts:bigint,text:string>").alias("said"), "turn").unionByName(starts), stretch)
    here = Window.partitionBy("chat_key", "stretch").orderBy("pos")
    turn_at = F.when(F.col("turn").isNotNull(), F.col("pos"))
    told = both.withColumns({"said": F.last("said", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)), "former": F.last(turn_at, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))})
    ends = both.groupBy("chat_key", "stretch").agg(F.max_by("said", F.when(F.col("said").isNotNull(), F.col("pos"))).alias("said"), F.max(turn_at).alias("former"))
    past = Window.partitionBy("chat_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("chat_key", "stretch", *[F.last(c, ignorenulls=True).over(past).alias(f"{c}_carried") for c in ("said", "former")])
    matched = told.where("turn is not null").join(carried, ["chat_key", "stretch"]).withColumns({c: F.coalesce(c, f"{c}_carried") for c in ("said", "former")})
    fresh = (F.col("said.pos") > F.coalesce("former", F.lit(-1))) & (F.col("turn.ts") - F.col("said.ts") <= config.context_max_age_seconds)
    inferred = matched.withColumn("guess", F.when(fresh, F.col("said"))).select("chat_key", "pos", "guess")
    ids = marked.where("id is not null").groupBy("chat_key", F.col("id").alias("reply_to")).agg(F.max_by(F.struct("ts", "is_owner", "substance", "clean"), "pos").alias("quote"))
    asked = turns.where(F.coalesce("reply_to", F.lit(0)) != 0).select("chat_key", "pos", "reply_to").join(ids, ["chat_key", "reply_to"]).where("not quote.is_owner and quote.substance")
    quoted = asked.select("chat_key", "pos", F.struct(F.col("quote.ts").alias("ts"), F.substring("quote.clean", 1, config.context_max_chars).alias("text")).alias("quote"))
    rows = turns.join(inferred, ["chat_key", "pos"], "left").join(quoted, ["chat_key", "pos"], "left")
    when = F.coalesce("quote.ts", "guess.ts")
    return rows.withColumns({"context_in": F.coalesce("quote.text", "guess.text"), "context_explicit": F.col("quote").isNotNull(), "context_lag": F.when(when.isNotNull(), F.greatest(F.lit(0), F.col("ts") - when))}).drop("guess", "quote")


def finished(turns: DataFrame, config: Config) -> DataFrame:
    """Adds text, n_parts, chars, longform and year."""
    text = F.array_join("parts", "\n")
    return turns.withColumns({"text": text, "n_parts": F.size("parts"), "chars": utf16_len(text), "year": utc_year(F.col("ts"))}).withColumn("longform", F.col("chars") >= config.longform_min_chars)


def build_turns(marked: DataFrame, config: Config | None = None, stretch: int = STRETCH) -> DataFrame:
    """Turns of `judged` messages. Chats without the owner's own writing give none; an empty table gives none."""
    config = config or Config()
    return finished(with_context(bursts(marked, config, stretch), marked, config, stretch), config)


def pick_holdout(turns: DataFrame, size: int, least: int = 15) -> DataFrame:
    """Adds holdout: `size` turns at even strides among those whose text and context are long enough,
    all of them if there are no more.

    Strides are by rank in id order. Ranks come from counts of id ranges, so no task sees all ids."""
    if size <= 0:
        return turns.withColumn("holdout", F.lit(False))
    fit = turns.where((F.length("context_in") >= least) & (F.length("text") >= least)).select("id")
    total = fit.count()
    step = max(1, total // size)
    ranked = ranks(fit, "id")
    chosen = ranked.where(((F.col("rank") - 1) % step == 0) & (F.floor((F.col("rank") - 1) / step) < size)).select("id", F.lit(True).alias("holdout"))
    return turns.join(chosen, "id", "left").withColumn("holdout", F.coalesce("holdout", F.lit(False)))


def ranks(rows: DataFrame, key: str, *ties: str, per_range: int = 1 << 16) -> DataFrame:
    """Adds rank, from 1 in order of a whole-number key that is there (then of `ties`, if keys repeat): ranks within ranges of the key plus the
    counts of the ranges before."""
    r = rows.withColumn("_range", F.floor(F.col(key) / per_range))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = r.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return r.join(base, "_range").withColumn("rank", F.col("_base") + F.row_number().over(Window.partitionBy("_range").orderBy(key, *ties))).drop("_range", "_base")
