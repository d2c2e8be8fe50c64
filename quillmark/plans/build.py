"""Building the corpus: export to turns, indexes and profile; repositories to comments and theirs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.config import Config
from quillmark.functions.text import script_language
from quillmark.operators import code_metrics, comments, habits, lexicon, metrics, redact, turns
from quillmark.sources import export, repositories
from quillmark.sources.store import CHAT, CODE, Store, missing, refreshed, with_ids

#: What tells the messages of an export apart.
PLACE = ["section", "chat_no", "pos"]


def corpus_messages(rows: DataFrame, owner: str) -> DataFrame:
    """Messages redacted with the senders' surnames, however many, and marked as the owner's, others' or rejected."""
    names = redact.surname_rows(rows.select(F.col("sender").alias("name")).distinct())
    clean = redact.scrubbed_rows(rows.withColumn("clean", redact.untagged(F.col("entities"))), PLACE, "clean", names)
    return turns.judged(clean, F.lit(owner))


def owner_id(rows: DataFrame, config: Config) -> str:
    if config.owner_id:
        return config.owner_id
    found = export.owner_of(rows).first()
    if not found:
        raise ValueError("the export has no messages")
    return found.from_id


def expect_owner(store: Store, owner: str) -> None:
    """A corpus is one person's: another's export is refused."""
    known = store.meta().get("owner_id")
    if known and known != owner:
        raise ValueError(f"the corpus belongs to {known}, not {owner}")


def lexicon_sides(marked: DataFrame) -> DataFrame:
    """side, text: the owner's messages that aren't forwarded, kept or not, and everyone else's."""
    return marked.where(~(F.col("is_owner") & F.col("is_forwarded"))).select(F.when(F.col("is_owner"), "mine").otherwise("theirs").alias("side"), F.col("clean").alias("text"))


def chat_profile(corpus: DataFrame, marked: DataFrame, config: Config, now_year: int) -> dict[str, DataFrame]:
    spark = corpus.sparkSession
    excluded = spark.createDataFrame([(w,) for w in redact.PLACEHOLDER_WORDS], "word string")
    prefixes = redact.first_name_prefixes(marked.select(F.col("sender").alias("name")).distinct())
    said = metrics.messages_of(corpus)
    return {
        "registers": metrics.measure(metrics.facets(corpus, config.recent_from(now_year)), ["facet", "window"]),
        "markers": lexicon.distinctive_words(lexicon.word_counts(lexicon_sides(marked)), "mine", "theirs", excluded=excluded, prefixes=prefixes),
        "habits": habits.probe_shares(said, habits.HABITS, "message"),
        "typography": habits.probe_shares(said, habits.TYPOGRAPHY, "message"),
    }


def build_chat(spark: SparkSession, path: str, store: Store, config: Config | None = None, now: datetime.datetime | None = None) -> dict[str, int]:
    """Reads an export and replaces the chat half of the store. Gives the counts of the build report."""
    config, now = config or Config(), now or datetime.datetime.now(datetime.UTC)
    told = export.read_by_ranges(spark, path).persist()
    rows = export.shaped(export.without_stopped(told, config.chat_stop_list))
    owner = owner_id(export.shaped(told), config)
    expect_owner(store, owner)
    marked = corpus_messages(rows, owner).persist()
    built = turns.build_turns(marked, config).withColumn("lang", script_language(F.col("text")))
    numbered = turns.pick_holdout(with_ids(built, store.next_id(CHAT)), config.holdout_size)
    with store.building():  # turns, indexes, profile and meta appear together, or not at all
        store.write_turns(numbered, CHAT)
        store.rebuild_indexes()
        corpus = store.turns().where(F.col("register").isin(*CHAT))
        store.save_profile("chat", chat_profile(corpus, marked, config, now.year))
        report = {r.reason: r.n for r in turns.filter_stats(marked).collect()} | {"turns": corpus.count()}
        store.set_meta({"owner_id": owner, "built_at": now.isoformat(), "recent_from": str(config.recent_from(now.year)), **{f"report.{k}": str(v) for k, v in report.items()}})
    marked.unpersist()
    told.unpersist()
    return report


def code_profile(corpus: DataFrame, config: Config) -> dict[str, DataFrame]:
    return {
        "sizes": code_metrics.genre_sizes(corpus),
        "code_markers": code_metrics.marker_counts(corpus),
        "connectives": code_metrics.connective_counts(corpus),
        "typography": code_metrics.typography(corpus, config.handwritten_until),
        "repositories": code_metrics.repositories(corpus),
        "totals": code_metrics.totals(corpus),
    }


def build_code(spark: SparkSession, repos: dict[str, str], store: Store, config: Config, now: datetime.datetime | None = None) -> int:
    """Reads repositories (name: root) and replaces the code half of the store; wrong roots change nothing.

    Only files whose content is new since the last build are blamed; the other lines come from the store."""
    now = now or datetime.datetime.now(datetime.UTC)
    files = repositories.candidates(spark, repos, list(config.code_emails)).persist()
    cache = store.blame()
    todo = missing(files, cache).persist()
    counts = {"report.files": files.count(), "report.files_blamed": todo.count()}
    store.save_blame(refreshed(cache, files, repositories.read_blame(todo)))
    found = comments.comment_corpus(repositories.read_files(files), store.blame(), list(config.code_emails)).persist()
    built = with_ids(comments.comment_turns(found, config.longform_min_chars), store.next_id(CODE))
    with store.building():
        store.write_turns(built.withColumn("holdout", F.lit(False)), CODE)
        store.rebuild_indexes()
        store.save_profile("code", code_profile(found, config))
        store.set_meta({"code_emails": ",".join(config.code_emails), "code_built_at": now.isoformat(), **{k: str(v) for k, v in counts.items()}})
    n = found.count()
    for df in (found, todo, files):
        df.unpersist()
    return n
