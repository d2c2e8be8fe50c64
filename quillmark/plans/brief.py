"""Requests: examples for writing and replying, constraints from the profile, and their rendering."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillmark.config import NeverMark
from quillmark.operators import code_metrics, habits, metrics, score, search
from quillmark.sources.store import CODE, Store

DEFAULT_EXAMPLES, DEFAULT_FOUND = 18, 15


class Constraint(NamedTuple):
    name: str
    value: object


def bounded(n: int, low: int, high: int, what: str) -> int:
    if not low <= n <= high:
        raise ValueError(f"{what}: {low} to {high}, not {n}")
    return n


def one_request(store: Store, text: str) -> DataFrame:
    return store.spark.createDataFrame([(0, text)], "query_id int, query string")


def length_limits(store: Store, register: str, length: str | None) -> dict[str, int]:
    """short: at most the median; long: at least the third quartile; of all time."""
    if length is None:
        return {}
    row = metrics.length_bounds(store.profile("chat", "registers")).where(F.col("facet") == register).first()
    return {} if row is None else {"max_chars": row.short_max} if length == "short" else {"min_chars": row.long_min}


def examples_for(store: Store, text: str, register: str = "dm", lang: str | None = None, length: str | None = None, examples: int = DEFAULT_EXAMPLES, now: int = 2026) -> DataFrame:
    """Turns on a topic, for writing or rephrasing."""
    bounded(examples, 4, 40, "examples")
    store = store.snapshot()
    return search.search(store.index(), store.turns(), one_request(store, text), examples, now, seed=1, register=register, lang=lang, **length_limits(store, register, length))


def reply_examples(store: Store, incoming: str, register: str = "dm", examples: int = DEFAULT_EXAMPLES, now: int = 2026) -> tuple[DataFrame, DataFrame]:
    """Answers to messages like this one, filled up by topic, and what they are worth."""
    bounded(examples, 4, 40, "examples")
    store = store.snapshot()
    asked = one_request(store, incoming)
    pairs = search.search(store.index(context=True), store.turns(), asked, examples, now, match_context=True, seed=1, register=register, require_context=True)
    topical = search.search(store.index(), store.turns(), asked, examples, now, seed=1, register=register)
    both = search.with_topic(pairs, topical, examples)
    return both, search.pair_quality(both, search.pair_stats(search.facet_filter(store.turns(), register=register)), examples)


def find(store: Store, query: str, limit: int = DEFAULT_FOUND, match_incoming: bool = False, now: int = 2026, **facets) -> DataFrame:
    bounded(limit, 1, 50, "limit")
    store = store.snapshot()
    return search.search(store.index(match_incoming), store.turns(), one_request(store, query), limit, now, match_context=match_incoming, seed=1, **facets)


def score_profile(store: Store) -> DataFrame:
    """What check_texts asks for: one row a facet."""
    shares = store.profile("chat", "habits").agg(habits.habit_share(None, habits.LIST_LABELS).alias("list_share"), habits.habit_share(None, habits.MARKDOWN_LABELS).alias("markdown_share"))
    marks = store.profile("chat", "typography").agg(F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("mark_shares"))
    return metrics.chosen_window(store.profile("chat", "registers")).withColumnRenamed("facet", "register").crossJoin(shares).crossJoin(marks)  # one row each


def comment_marks(store: Store) -> DataFrame:
    """genre and mark_shares, a map by label: at most two rows."""
    marks = store.profile("code", "typography")
    return marks.groupBy("genre").agg(F.map_from_entries(F.collect_list(F.struct("label", "share"))).alias("mark_shares"))


def check(store: Store, texts: DataFrame, declared: tuple[NeverMark, ...] = ()) -> DataFrame:
    """texts: id, register, text and, if at hand, code, what a comment stands by. Registers code and jsdoc
    are held to the rules of comments, all others to those of messages. A half of the profile that isn't
    built scores 0."""
    texts = texts if "code" in texts.columns else texts.withColumn("code", F.lit(None).cast("string"))
    is_comment = F.coalesce(F.col("register").isin(*CODE), F.lit(False))
    said, comments = texts.where(~is_comment), texts.where(is_comment)
    said = score.check_texts(said, score_profile(store), declared) if store.profile("chat", "registers") is not None else score.unmeasured(said)
    sizes = store.profile("code", "sizes")
    if sizes is None:
        return said.unionByName(score.unmeasured(comments))
    split = code_metrics.split_markers(store.profile("code", "code_markers")).first()
    return said.unionByName(score.check_comments(comments, sizes, split.own, split.foreign, comment_marks(store), declared))


def reply_constraints(quality: Row | None, limit: int) -> list[Constraint]:
    """What the examples of a reply are worth, from a pair_quality row (None: no examples), and two fixed lines."""
    if quality is None or quality.few_pairs:
        worth = [Constraint("examples_by_topic_only", True)]
    else:
        worth = [Constraint("pairs_found", (quality.pairs, limit))] * quality.short + [Constraint("pairs_by_order_only", True)] * quality.none_quoted
    return [*worth, Constraint("answer_without_retelling", True), Constraint("greet_only_at_the_start", True)]


#: Held by every rephrasing.
REPHRASE = [Constraint("keep_all_facts", True), Constraint("add_and_drop_nothing", True), Constraint("shorten_what_is_longer_than_usual", True)]


def percent(share: float) -> str:
    return f"{int(share * 1000 + 0.5) / 10:g}%"


def chat_constraints(m: Row, list_share: float | None, markdown_share: float | None, markers: list[str], declared: tuple[NeverMark, ...], foreign: list[tuple[str, float]], hyphen: float | None) -> list[Constraint]:
    """Numbers to hold a text to; `m` is one facet's row. Without messages there are none."""
    if m is None or not m.bursts.messages:
        return []
    p = m.punctuation
    out = [Constraint("message_max", m.message_length.p90), Constraint("message_target", m.message_length.median), Constraint("turn_max", m.turn_length.p90)]
    if m.register != "longform":
        out.append(Constraint("in_bursts", percent(m.bursts.messages_in_bursts)))
    out += [Constraint("starts_capital", percent(p.starts_capital)), Constraint("ends_period", percent(p.ends_period)), Constraint("has_exclamation", percent(p.has_exclamation))]
    if m.emoji:
        out.append(Constraint("emoji", [e.char for e in m.emoji[:6]]))
    if list_share is not None and markdown_share is not None and max(list_share, markdown_share) < habits.RARE:
        out.append(Constraint("no_lists_or_markdown", max(list_share, markdown_share)))
    words = [w for w in markers if len(w) >= 3][:12]
    if words:
        out.append(Constraint("colloquial", words))
    return out + mark_constraints(declared, foreign, hyphen)


def mark_constraints(declared: tuple[NeverMark, ...], foreign: list[tuple[str, float]], hyphen: float | None) -> list[Constraint]:
    out = [Constraint("never_mark", (m.mark, m.stand_in)) for m in declared]
    if foreign:
        out.append(Constraint("foreign_marks", foreign))
    if hyphen is not None and hyphen >= habits.OWN:
        out.append(Constraint("double_hyphen", hyphen))
    return out


def code_constraints(sizes: Row, own_markers: list[str]) -> list[Constraint]:
    out = [Constraint("line_max", sizes.line_width.p90), Constraint("line_median", sizes.line_width.median), Constraint("one_liners", percent(sizes.block_lines.one_liners)), Constraint("block_multi", sizes.block_lines.median_multi), Constraint("block_max", sizes.block_lines.p90)]
    if sizes.genre == "jsdoc":
        out.append(Constraint("no_types_in_tags", True))
    elif own_markers:
        out.append(Constraint("markers", own_markers))
    return [*out, Constraint("why_not_what", True), Constraint("russian", percent(sizes.russian)), Constraint("no_emoji", True)]


def constraints(store: Store, register: str, declared: tuple[NeverMark, ...] = ()) -> list[Constraint]:
    """The constraints of a register; a handful of profile rows reach the driver."""
    if register in ("code", "jsdoc"):
        sizes = store.profile("code", "sizes")
        row = sizes.where(F.col("genre") == register).first() if sizes is not None else None
        if row is None:
            return []
        own = code_metrics.split_markers(store.profile("code", "code_markers")).first()
        marks = store.profile("code", "typography").where(F.col("genre") == register)
        head = code_constraints(row, own.own if own else [])
    else:
        row = score_profile(store).where(F.col("register") == register).first()
        marks = store.profile("chat", "typography")
        head = chat_constraints(row, row and row.list_share, row and row.markdown_share, [r.word for r in store.profile("chat", "markers").orderBy(F.desc("z"), "word").collect()], (), [], None)
        if not head:
            return []
    foreign = [(r.label, r.share) for r in habits.foreign_marks(marks, tuple(m.mark for m in declared)).collect()]
    hyphen = marks.where(F.col("label") == habits.DOUBLE_HYPHEN.label).first()
    return head + mark_constraints(declared, foreign, hyphen.share if hyphen else None)


def render(task: str, examples: list[Row], held: list[Constraint], contract: str) -> str:
    """A brief as markdown: task, examples, constraints, output contract, in this order."""
    shown = []
    for e in examples:
        if e.context_in:
            shown.append(f"> {e.context_in}")
        shown += [*e.parts, ""]
    lists = [f"- {c.name}: {', '.join(map(str, c.value)) if isinstance(c.value, (list, tuple)) else c.value}" for c in held]
    return "\n".join(["# Task", "", task, "", "# Examples", "", *shown, "# Constraints", "", *lists, "", "# Output", "", contract])


def render_check(report: Row) -> str:
    lines = [f"{report.score}/100, {report.verdict} ({report.register}, {report.messages} messages)"]
    return "\n".join(lines + [f"- {f.rule} (-{f.penalty})" + (f': "{f.fragment}"' if f.fragment else "") for f in report.findings])
