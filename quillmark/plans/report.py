"""Profiles and build reports as markdown: names and numbers of a handful of rows, wording aside."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmark.operators import code_metrics, habits, metrics
from quillmark.plans.brief import percent
from quillmark.sources.store import CODE, Store

#: How many words, connectives, rare habits and repositories are shown: briefly, in full.
WORDS, CONNECTIVES, RARE_HABITS, REPOSITORIES, EMOJI = (30, 60), (6, 12), 10, 20, 6
PUNCTUATION = ("starts_capital", "ends_period", "ends_question", "ends_paren", "ends_nothing", "has_exclamation", "has_ellipsis", "has_dash")
BURSTS = ("messages_in_bursts", "single", "double", "triple", "more")


def section(title: str, lines: list[str]) -> list[str]:
    return [f"## {title}", *(f"- {x}" for x in lines), ""] if lines else []


def shares(row: Row, names: tuple[str, ...]) -> list[str]:
    return [f"{n}: {percent(row[n])}" for n in names]


def typography(marks) -> list[str]:
    """Marks never typed, and the double hyphen where it is the author's own; `marks` has label and share."""
    if marks is None:
        return []
    own = marks.where((F.col("label") == habits.DOUBLE_HYPHEN.label) & (F.col("share") >= habits.OWN)).select("label", "share").collect()
    return section("Never typed", [f"{r.label}: {r.share:g}%" for r in habits.foreign_marks(marks).collect()]) + section("Own", [f"{r.label}: {r.share:g}%" for r in own])


def render_profile(store: Store, register: str = "dm", full: bool = False) -> str:
    """How the owner writes in a register; a register without figures is said to be empty."""
    if register in CODE:
        return render_code_profile(store, register, full)
    measured = store.profile("chat", "registers")
    rows = [] if measured is None else measured.where(F.col("facet") == register).collect()
    all_time = next((r for r in rows if r.window == "all"), None)
    m = None if measured is None else metrics.chosen_window(measured.where(F.col("facet") == register)).first()
    if m is None or not m.bursts.messages:
        return f"# {register}\n\nempty\n"
    out = [f"# {register}", "", f"{m.bursts.turns} turns, {m.bursts.messages} messages, window: {m.window}", ""]
    lengths = [f"message: median {m.message_length.median}, p25 {m.message_length.p25}, p90 {m.message_length.p90}", f"turn: median {m.turn_length.median}, p90 {m.turn_length.p90}"]
    if m.window == "recent" and all_time:
        lengths.append(f"of all time: median {all_time.message_length.median}, ends_period {percent(all_time.punctuation.ends_period)}")
    out += section("Length", lengths)
    if register != "longform":
        out += section("Bursts", shares(m.bursts, BURSTS))
    out += section("Punctuation", shares(m.punctuation, PUNCTUATION))
    out += section("Emoji", [f"{e.char}: {e.n}" for e in (m.emoji or [])[:EMOJI]])
    out += section("Words", [r.word for r in store.profile("chat", "markers").orderBy(F.desc("z"), "word").limit(WORDS[full]).collect()])
    rare = store.profile("chat", "habits").where(F.col("share") < habits.RARE).orderBy("share", "label").limit(RARE_HABITS)
    out += section("Not done", [f"{r.label}: {r.share:g}%" for r in rare.collect()])
    return "\n".join(out + typography(store.profile("chat", "typography")))


def render_code_profile(store: Store, register: str, full: bool = False) -> str:
    sizes = store.profile("code", "sizes")
    s = None if sizes is None else sizes.where(F.col("genre") == register).first()
    if s is None:
        return f"# {register}\n\nempty\n"
    blocks, counts = store.profile("code", "totals").first().blocks, store.profile("code", "code_markers")
    out = [f"# {register}", "", f"{s.blocks} of {blocks} blocks", ""]
    b = s.block_lines
    out += section("Size", [f"line: median {s.line_width.median}, p90 {s.line_width.p90}", f"one_liners: {percent(b.one_liners)}", f"lines of longer blocks: median {b.median_multi}, p90 {b.p90}"])
    out += section("Language", [f"russian: {percent(s.russian)}"])
    said = store.profile("code", "connectives").orderBy(F.desc("n"), "name").limit(CONNECTIVES[full])
    out += section("Connectives", [f"{r.name}: {r.n} ({percent(r.share)})" for r in said.collect()])
    split = code_metrics.split_markers(counts).first()
    if split.own:
        used = {r.name: r.n for r in counts.collect()}  # at most as many as MARKERS
        out += section("Markers", [f"own: {', '.join(f'{x} ({used[x]})' for x in split.own)}", f"others: {', '.join(f'{x} ({used.get(x, 0)})' for x in split.foreign)}"])
    if full:
        repos = store.profile("code", "repositories").agg(F.count("*").alias("n"), F.max("blocks").alias("most")).first()
        out += section("Repositories", [f"{repos.n}, the largest with {percent(repos.most / blocks)} of the blocks"] if repos.n else [])
    return "\n".join(out + typography(store.profile("code", "typography").where(F.col("genre") == register)))


def render_report(store: Store) -> str:
    """Counts of the stored chat turns, and of the messages that were kept and left out."""
    t = store.turns().where(~F.col("register").isin(*CODE))
    n = lambda c: F.count(F.when(c, 1))
    row = t.agg(F.countDistinct("chat_key").alias("chats"), F.count("*").alias("turns"), F.coalesce(F.sum("n_parts"), F.lit(0)).alias("messages"), n(F.col("context_in").isNotNull()).alias("with_context"), n(F.col("longform")).alias("longform"), n(F.col("holdout")).alias("holdout")).first()
    left = {k.removeprefix("report."): v for k, v in sorted(store.meta().items()) if k.startswith("report.") and not k.startswith("report.files")}
    return "\n".join([*section("Corpus", [f"{k}: {v}" for k, v in row.asDict().items()]), *section("Messages", [f"{k}: {v}" for k, v in left.items() if k != "turns"])])


def render_code_report(store: Store) -> str:
    """Counts of the stored comments, of blamed and known files, and the repositories with most blocks."""
    totals = store.profile("code", "totals")
    if totals is None:
        return "## Comments\n- none\n"
    t, meta = totals.first(), store.meta()
    files, blamed = (int(meta.get(f"report.{k}", "0")) for k in ("files", "files_blamed"))
    lines = [f"blocks: {t.blocks}", f"code: {t.blocks - t.doc}", f"jsdoc: {t.doc}", f"russian: {percent(t.russian)}", f"files blamed: {blamed}", f"files known: {files - blamed}"]
    most = store.profile("code", "repositories").orderBy(F.desc("blocks"), "repo").limit(REPOSITORIES).collect()
    return "\n".join([*section("Comments", lines), *section("Repositories", [f"{r.repo}: {r.blocks}" for r in most])])
