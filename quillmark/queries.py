"""Queries of the operators over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.config import Config
from quillmark.functions.text import SPACES, code_words, emoji_class, half_up, near_key, pseudonym, shared_words, tokens, utf16_len, whole_word
from quillmark.llm.common import written
from quillmark.operators import habits, lexicon, metrics, redact, score, search, turns
from quillmark.operators.habits import Probe

NOW, RECENT_FROM = 2026, 2020
#: Probes that the driver's documents hold.
PROBES = [Probe("bold", r"\*\*"), Probe("exclamation", "!"), Probe("percent run", "%%%"), Probe("hash", "#"), Probe("quote", '"'), Probe("license", whole_word("license")), Probe("list item", rf"(?m)^[{SPACES}]*[-•*][{SPACES}]+[^{SPACES}]")]
EVENTS = Config(burst_window_seconds=6 * 3600, context_max_age_seconds=12 * 3600)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Adapters: the driver's tables as the corpus's inputs.


def document_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = read(spark, sf_dir, "documents"), F.col("doc_id") % 3
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(k == 0, "dm").when(k == 1, "group").otherwise("code").alias("register"),
        F.filter(F.split("text", "\n", -1), lambda x: x != "").alias("parts"),
        "text",
        utf16_len(F.col("text")).alias("chars"),
        (utf16_len(F.col("text")) >= 1000).alias("longform"),
        (F.col("doc_id") % 50 == 0).alias("holdout"),
        "lang",
        (2015 + F.col("doc_id") % 10).cast("int").alias("year"),
        F.when(F.col("doc_id") % 4 == 0, F.col("lang")).alias("context_in"),
        (F.col("doc_id") % 8 == 0).alias("context_explicit"),
        F.lit(0).cast("long").alias("context_lag"),
        "source",
    )


DOCS = """t AS (SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'dm' WHEN 1 THEN 'group' ELSE 'code' END AS register,
  list_filter(string_split(text, chr(10)), lambda x: x <> '') AS parts, text, CAST(length(text) AS INTEGER) AS chars, length(text) >= 1000 AS longform,
  doc_id % 50 = 0 AS holdout, lang, CAST(2015 + doc_id % 10 AS INTEGER) AS year, CASE WHEN doc_id % 4 = 0 THEN lang END AS context_in, doc_id % 8 = 0 AS context_explicit, source FROM documents)"""


def pair_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations").withColumn("context_in", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("role = 'assistant'")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.lit("dm").alias("register"),
        "text",
        F.array("text").alias("parts"),
        utf16_len(F.col("text")).alias("chars"),
        F.lit(False).alias("longform"),
        (F.col("conv_id") % 40 == 0).alias("holdout"),
        F.lit(None).cast("string").alias("lang"),
        (2015 + F.col("conv_id") % 10).cast("int").alias("year"),
        "context_in",
        (F.col("conv_id") % 3 == 0).alias("context_explicit"),
        (F.col("turn") * 700).alias("context_lag"),
    )


PAIRS = """p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context_in FROM conversations),
t AS (SELECT conv_id * 1000 + turn AS id, 'dm' AS register, text, context_in, conv_id % 3 = 0 AS context_explicit, turn * 700 AS context_lag,
  CAST(2015 + conv_id % 10 AS INTEGER) AS year, conv_id % 40 = 0 AS holdout FROM p WHERE role = 'assistant')"""


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind = F.col("event_type")
    rows = e.select(
        F.col("user_id").cast("string").alias("chat_key"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("pos"),
        F.col("event_id").alias("id"),
        F.when(kind.isin("click", "purchase", "error"), "owner").otherwise("other").alias("from_id"),
        F.unix_timestamp("ts").alias("ts"),
        F.concat(kind, F.lit(" "), F.col("event_id").cast("string")).alias("text"),
        (kind == "error").alias("is_via_bot"),
        F.lit(False).alias("is_forwarded"),
        F.lit(0).alias("n_links"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") - 150).alias("reply_to"),
        F.lit("dm").alias("register"),
    )
    return turns.judged(rows.withColumn("clean", F.col("text")), F.lit("owner"))


EVENT_TURNS = """m AS (SELECT CAST(user_id AS VARCHAR) AS chat_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_id AS id,
  event_type IN ('click', 'purchase', 'error') AS own, event_type = 'error' AS bot, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
  event_type || ' ' || event_id AS text, CASE WHEN event_id % 3 = 0 THEN event_id - 150 END AS reply_to FROM events),
r AS (SELECT *, sum(CASE WHEN own THEN 0 ELSE 1 END) OVER (PARTITION BY chat_key ORDER BY pos) AS run FROM m),
o AS (SELECT *, ts - lag(ts) OVER (PARTITION BY chat_key, run ORDER BY pos) AS gap FROM r WHERE own),
k AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY chat_key, run ORDER BY pos) = 1 OR gap > 21600 THEN 1 ELSE 0 END AS brk FROM o WHERE NOT bot),
s AS (SELECT *, sum(brk) OVER (PARTITION BY chat_key, run ORDER BY pos) AS sess FROM k),
c AS (SELECT *, (row_number() OVER (PARTITION BY chat_key, run, sess ORDER BY pos) - 1) // 10 AS chunk FROM s),
t AS (SELECT chat_key, min(pos) AS pos, arg_min(ts, pos) AS ts, arg_min(reply_to, pos) AS reply_to, string_agg(text, chr(10) ORDER BY pos) AS text, count(*) AS n_parts
      FROM c GROUP BY chat_key, run, sess, chunk)"""


# Queries.


def said_counts(texts: DataFrame) -> DataFrame:
    """word, n over all texts."""
    return texts.select(F.explode_outer(tokens(F.col("text"))).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n"))


def frequent_words(counts: DataFrame, n: int = 6) -> DataFrame:
    """query_id, query: the most frequent words of four letters or more, as one request. Marks are taken off distinct
    words, which keep their lengths."""
    top = counts.where(F.length("word") >= 4).groupBy(search.folded(F.col("word")).alias("w")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(n)
    return top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "w"))).alias("all")).select(F.lit(0).alias("query_id"), F.array_join("all.w", " ").alias("query"))


MARKS = f"'{search.MARKED}', '{search.PLAIN}'"


def sql_terms(column: str) -> str:
    return rf"list_transform(list_filter(regexp_extract_all(translate(lower({column}), 'ё', 'е'), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 2), lambda w: translate(w, {MARKS}))"


def sql_bm25(column: str, asked: str) -> str:
    return f"""w AS (SELECT unnest({sql_terms('text')}) AS w FROM {asked}),
q AS (SELECT w AS term FROM (SELECT w, count(*) AS n FROM w WHERE length(w) >= 4 GROUP BY w ORDER BY n DESC, w LIMIT 6)),
d AS (SELECT id, {sql_terms(column)} AS ts FROM t WHERE NOT holdout AND {column} IS NOT NULL),
g AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM d),
post AS (SELECT id, n_len, term, count(*) AS tf FROM (SELECT id, len(ts) AS n_len, unnest(ts) AS term FROM d) GROUP BY ALL),
nt AS (SELECT term, count(*) AS n_t FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
i AS (SELECT term, CASE WHEN ln((g.n - n_t + 0.5) / (n_t + 0.5)) <= 0 THEN 1e-6 ELSE ln((g.n - n_t + 0.5) / (n_t + 0.5)) END AS idf FROM nt, g),
b AS (SELECT id, -sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_len / al))) AS score FROM post JOIN i USING (term), g GROUP BY id)"""


NEAR = r"regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')"


def sql_ranked(cost: str, where: str, limit: int) -> str:
    return f"""r AS (SELECT t.*, score, floor(({cost}) * 1e9 + 0.5) / 1e9 AS cost FROM b JOIN t USING (id) WHERE NOT holdout AND {where}),
over_ AS (SELECT * FROM r ORDER BY cost, id LIMIT {3 * limit}),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {NEAR} ORDER BY cost, id) AS k FROM over_) WHERE k = 1),
placed AS (SELECT *, row_number() OVER (ORDER BY cost, id) AS place FROM one)"""


def rounded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("score", half_up(F.col("score"), 3))


def reply_bm25_topk(spark, sf_dir):
    t = pair_turns(spark, sf_dir)
    asked = frequent_words(said_counts(read(spark, sf_dir, "conversations").where("role = 'user'")))
    found = search.search(search.TextIndex(t, "context_in", stemmed=False), t, asked, 15, NOW, match_context=True, stemmed=False, require_context=True)
    return rounded(found).select("place", "id", "score", "year", "context_explicit")


REPLY = f"WITH {PAIRS},\n{sql_bm25('context_in', '''(SELECT text FROM conversations WHERE role = 'user')''')},\n" + sql_ranked("score + 0.12 * greatest(0, 2026 - year) + CASE WHEN context_explicit THEN 0 ELSE 1.5 END + CASE WHEN NOT context_explicit AND context_lag > 1800 THEN 0.8 ELSE 0 END", "context_in <> ''", 15)
REPLY_SQL = REPLY + "\nSELECT CAST(place AS INTEGER) AS place, id, floor(score * 1000 + 0.5) / 1000 AS score, year, context_explicit FROM placed WHERE place <= 15"


def turn_bm25_topk(spark, sf_dir):
    t = document_turns(spark, sf_dir).drop("parts")
    found = search.search(search.TextIndex(t, "text", stemmed=False), t, frequent_words(said_counts(read(spark, sf_dir, "documents"))), 20, NOW, stemmed=False, register="dm", year_from=2017, min_chars=100)
    return rounded(found).select("place", "id", "score", "year", "chars")


TURN_SQL = f"WITH {DOCS},\n{sql_bm25('text', 'documents')},\n" + sql_ranked("score + 0.12 * greatest(0, 2026 - year)", "register = 'dm' AND year >= 2017 AND chars >= 100", 20) + "\nSELECT CAST(place AS INTEGER) AS place, id, floor(score * 1000 + 0.5) / 1000 AS score, year, chars FROM placed WHERE place <= 20"


def stemmed_search(spark, sf_dir):
    t = document_turns(spark, sf_dir).drop("parts")
    counts = written(said_counts(read(spark, sf_dir, "documents")), "words")  # the request's words and the vocabulary
    found = search.search(search.TextIndex(t, words=counts), t, frequent_words(counts), 20, NOW, seed=7, register="longform", lang="en")
    return rounded(found).select("place", "id", "score", "source")


def reply_with_topup(spark, sf_dir):
    t = pair_turns(spark, sf_dir)
    asked = frequent_words(said_counts(read(spark, sf_dir, "conversations").where("role = 'user'")))
    pairs = search.search(search.TextIndex(t, "context_in", stemmed=False), t, asked, 10, NOW, match_context=True, stemmed=False, require_context=True, year_from=2022)
    topical = search.search(search.TextIndex(t, "text", stemmed=False), t, asked, 40, NOW, stemmed=False)
    return search.with_topic(pairs, topical, 40).select("place", "id", "origin")


def _topup_sql() -> str:
    first = sql_bm25("context_in", "(SELECT text FROM conversations WHERE role = 'user')")
    a = f"SELECT id, place, 0 AS origin FROM (WITH {PAIRS},\n{first},\n" + sql_ranked("score + 0.12 * greatest(0, 2026 - year) + CASE WHEN context_explicit THEN 0 ELSE 1.5 END + CASE WHEN NOT context_explicit AND context_lag > 1800 THEN 0.8 ELSE 0 END", "context_in <> '' AND year >= 2022", 10) + "\nSELECT * FROM placed WHERE place <= 10)"
    b = f"SELECT id, place, 1 AS origin FROM (WITH {PAIRS},\n{sql_bm25('text', '''(SELECT text FROM conversations WHERE role = 'user')''')},\n" + sql_ranked("score + 0.12 * greatest(0, 2026 - year)", "true", 40) + "\nSELECT * FROM placed WHERE place <= 40)"
    return f"""WITH both_ AS ({a} UNION ALL {b}),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY origin) AS k FROM both_) WHERE k = 1)
SELECT CAST(n AS INTEGER) AS place, id, CAST(origin AS INTEGER) AS origin FROM (SELECT *, row_number() OVER (ORDER BY origin, place, id) AS n FROM once) WHERE n <= 40"""


def sql_percentiles(rows: str, key: str, value: str) -> str:
    at = lambda p: f"list_extract(xs, CAST(least(n - 1, floor(n * CAST({p} AS DOUBLE))) AS BIGINT) + 1)"
    return f"""SELECT {key}, n AS count, floor(s / n * 10 + 0.5) / 10 AS mean, {at(0.25)} AS p25, {at(0.5)} AS median, {at(0.75)} AS p75, {at(0.9)} AS p90, m AS max
FROM (SELECT {key}, list_sort(list({value})) AS xs, count(*) AS n, sum(CAST({value} AS DOUBLE)) AS s, max({value}) AS m FROM {rows} GROUP BY {key})"""


def length_stats_by_register(spark, sf_dir):
    return metrics.floor_percentiles(document_turns(spark, sf_dir), ["register"], "chars")


def numeric_floor_percentiles(spark, sf_dir):
    return metrics.floor_percentiles(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


def burst_turns(spark, sf_dir):
    done = turns.finished(turns.bursts(event_messages(spark, sf_dir), EVENTS), EVENTS)
    return done.select("chat_key", "pos", "ts", "n_parts", "text", "chars", "year", "longform")


BURST_SQL = f"WITH {EVENT_TURNS}\nSELECT chat_key, CAST(pos AS INTEGER) AS pos, ts, CAST(n_parts AS INTEGER) AS n_parts, text, CAST(length(text) AS INTEGER) AS chars, CAST(year(to_timestamp(ts) AT TIME ZONE 'UTC') AS INTEGER) AS year, length(text) >= 300 AS longform FROM t"


def turn_context(spark, sf_dir):
    return turns.build_turns(event_messages(spark, sf_dir), EVENTS).select("chat_key", "pos", "context_in", "context_explicit", "context_lag")


CONTEXT_SQL = f"""WITH {EVENT_TURNS},
u AS (SELECT *, lag(pos) OVER (PARTITION BY chat_key ORDER BY pos) AS before FROM t),
g AS (SELECT u.chat_key, u.pos, max(m.pos) AS said FROM u JOIN m ON m.chat_key = u.chat_key AND NOT m.own AND m.pos < u.pos AND m.pos > coalesce(u.before, -1) GROUP BY ALL),
f AS (SELECT u.*, i.text AS guess, i.ts AS guess_ts, e.text AS quote, e.ts AS quote_ts FROM u
  LEFT JOIN g USING (chat_key, pos) LEFT JOIN m i ON i.chat_key = u.chat_key AND i.pos = g.said AND u.ts - i.ts <= 43200
  LEFT JOIN m e ON e.chat_key = u.chat_key AND e.id = u.reply_to AND u.reply_to <> 0 AND NOT e.own)
SELECT chat_key, CAST(pos AS INTEGER) AS pos, coalesce(quote, guess) AS context_in, quote IS NOT NULL AS context_explicit, greatest(0, ts - coalesce(quote_ts, guess_ts)) AS context_lag
FROM (SELECT * FROM f)"""
# greatest() skips nulls in DuckDB
CONTEXT_SQL = CONTEXT_SQL.replace("greatest(0, ts - coalesce(quote_ts, guess_ts))", "CASE WHEN coalesce(quote_ts, guess_ts) IS NOT NULL THEN greatest(0, ts - coalesce(quote_ts, guess_ts)) END")


def filter_stats(spark, sf_dir):
    texts = read(spark, sf_dir, "pages").select(F.col("html").alias("text")).unionByName(read(spark, sf_dir, "documents").select("text"))
    reason = turns.reject_reason(F.col("text"), F.lit(False), F.lit(False), F.lit(0))
    return turns.filter_stats(texts.withColumn("reason", reason))


FILTER_SQL = rf"""WITH x AS (SELECT regexp_replace(coalesce(text, ''), '^[{SPACES}]+|[{SPACES}]+$', '', 'g') AS s FROM (SELECT html AS text FROM pages UNION ALL SELECT text FROM documents)),
y AS (SELECT CASE WHEN s = '' THEN 'empty' WHEN s[1] IN ('{{', '[', '<') OR (length(s) - length(translate(s, '[]{{}}<>;=', ''))) / length(s) > CAST(0.03 AS DOUBLE) THEN 'structured' ELSE 'kept' END AS reason FROM x)
SELECT reason, count(*) AS n FROM y GROUP BY reason"""


def punctuation_profile(spark, sf_dir):
    return metrics.punctuation(metrics.messages_of(document_turns(spark, sf_dir), "register"), ["register"])


def sql_share(cond: str, name: str) -> str:
    return f"floor(avg(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0 END) * 1000 + 0.5) / 1000 AS {name}"


PUNCT_SQL = rf"""WITH {DOCS}, m AS (SELECT register, unnest(parts) AS m FROM t), x AS (SELECT *, m[1] AS f, m[-1] AS l FROM m)
SELECT register, count(*) AS n,
  floor(coalesce(sum(CASE WHEN regexp_matches(f, '\p{{L}}') AND f = upper(f) AND f <> lower(f) THEN 1 END), 0) / greatest(coalesce(sum(CASE WHEN regexp_matches(f, '\p{{L}}') THEN 1 END), 0), 1) * 1000 + 0.5) / 1000 AS starts_capital,
  {sql_share("l = '.'", 'ends_period')}, {sql_share("l = '?'", 'ends_question')}, {sql_share("l = '!'", 'ends_exclamation')}, {sql_share("l = ')'", 'ends_paren')},
  {sql_share("l NOT IN ('.', '?', '!', ')')", 'ends_nothing')}, {sql_share("contains(m, '?')", 'has_question')}, {sql_share("contains(m, '!')", 'has_exclamation')},
  {sql_share("contains(m, '...') OR contains(m, '…')", 'has_ellipsis')}, {sql_share(f"regexp_matches(m, '[{SPACES}]—[{SPACES}]')", 'has_dash')}
FROM x GROUP BY register"""


def burst_stats(spark, sf_dir):
    return metrics.burst_stats(document_turns(spark, sf_dir), ["register"])


BURST_STATS_SQL = f"""WITH {DOCS}, x AS (SELECT register, len(parts) AS n FROM t)
SELECT register, count(*) AS turns, sum(n)::BIGINT AS messages, {sql_share('n = 1', 'single')}, {sql_share('n = 2', 'double')}, {sql_share('n = 3', 'triple')}, {sql_share('n > 3', 'more')},
  floor(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / greatest(sum(n), 1) * 1000 + 0.5) / 1000 AS messages_in_bursts, floor(avg(n) * 100 + 0.5) / 100 AS mean_parts FROM x GROUP BY register"""


def recent_vs_all(spark, sf_dir):
    m = metrics.measure(metrics.facets(document_turns(spark, sf_dir), RECENT_FROM), ["facet", "window"])
    picked = metrics.chosen_window(m, 400)
    return picked.select("facet", "window", F.col("bursts.turns").alias("turns"), F.col("bursts.messages").alias("messages"), F.col("turn_length.median").alias("turn_median"), F.col("message_length.p90").alias("message_p90"), F.col("punctuation.ends_period").alias("ends_period"))


RECENT_SQL = f"""WITH {DOCS},
f AS (SELECT *, unnest(CASE WHEN longform THEN [register, 'longform'] ELSE [register] END) AS facet FROM t WHERE NOT holdout),
w AS (SELECT *, unnest(CASE WHEN year >= {RECENT_FROM} THEN ['all', 'recent'] ELSE ['all'] END) AS "window" FROM f),
a AS (SELECT facet, "window", count(*) AS turns, sum(len(parts))::BIGINT AS messages, list_sort(list(chars)) AS cs FROM w GROUP BY ALL),
m AS (SELECT facet, "window", unnest(parts) AS m FROM w),
b AS (SELECT facet, "window", list_sort(list(CAST(length(m) AS INTEGER))) AS ls, {sql_share("m[-1] = '.'", 'ends_period')} FROM m GROUP BY ALL),
j AS (SELECT * FROM a JOIN b USING (facet, "window") WHERE "window" = 'all' OR messages >= 400),
k AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY CASE WHEN "window" = 'recent' THEN 0 ELSE 1 END) AS k FROM j)
SELECT facet, "window", turns, messages, cs[CAST(least(len(cs) - 1, floor(len(cs) * 0.5::DOUBLE)) AS BIGINT) + 1] AS turn_median, ls[CAST(least(len(ls) - 1, floor(len(ls) * 0.9::DOUBLE)) AS BIGINT) + 1] AS message_p90, ends_period FROM k WHERE k = 1"""


def habit_shares(spark, sf_dir):
    return habits.probe_shares(document_turns(spark, sf_dir), PROBES, "text", ["register"])


def typography_shares(spark, sf_dir):
    """The author's own typography probes, and which of those that are hit somewhere count as foreign."""
    shares = habits.probe_shares(metrics.messages_of(document_turns(spark, sf_dir)), [*habits.TYPOGRAPHY, *PROBES[:3]], "message")
    return shares.withColumn("foreign", F.col("share") < habits.FOREIGN)


def sql_probes(rows: str, column: str, probes: list[tuple[str, str]], key: str = "") -> str:
    k = f"{key}, " if key else ""
    each = " UNION ALL ".join(f"SELECT {k}'{label}' AS label, sum(CASE WHEN regexp_matches({column}, '{p}') THEN 1 ELSE 0 END)::BIGINT AS hits, count(*) AS n FROM {rows}" + (f" GROUP BY {key}" if key else "") for label, p in probes)
    return f"SELECT {k}label, hits, floor(hits / n * 100 * 1000 + 0.5) / 1000 AS share FROM ({each})"


DUCK_PROBES = [("bold", r"\*\*"), ("exclamation", "!"), ("percent run", "%%%"), ("hash", "#"), ("quote", '"'), ("license", r"(?i)(^|[^\p{L}])license($|[^\p{L}])"), ("list item", rf"(?m)^[{SPACES}]*[-•*][{SPACES}]+[^{SPACES}]")]
DUCK_TYPO = [*[(p.label, p.pattern) for p in habits.FOREIGN_MARKS], (habits.DOUBLE_HYPHEN.label, r"(^|[^-\p{L}\p{N}/])--($|[^-\p{L}\p{N}/])"), *DUCK_PROBES[:3]]
HABIT_SQL = f"WITH {DOCS}\n{sql_probes('t', 'text', DUCK_PROBES, 'register')}".replace("* 100 * 1000 + 0.5) / 1000", "* 100 * 100000 / 100 + 0.5) / 1000")
TYPO_SQL = f"WITH {DOCS}, m AS (SELECT unnest(parts) AS m FROM t)\nSELECT *, share < 2 AS \"foreign\" FROM ({sql_probes('m', 'm', DUCK_TYPO)})"


def word_counts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 == 0, "mine").otherwise("theirs").alias("side"), "text")
    return lexicon.word_counts(d)


COUNTS = r"""d AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'mine' ELSE 'theirs' END AS side, regexp_extract_all(translate(text, 'ёЁ', 'еЕ'), '\p{L}+') AS ws FROM documents),
e AS (SELECT side, unnest(ws) AS raw, unnest(range(len(ws))) AS i FROM d),
c AS (SELECT side, lower(raw) AS word, count(*) AS n, sum(CASE WHEN i > 0 AND raw[1] <> lower(raw)[1] THEN 1 ELSE 0 END)::BIGINT AS n_cap FROM e WHERE length(lower(raw)) >= 2 GROUP BY ALL)"""


def distinctive_words(spark, sf_dir):
    return lexicon.distinctive_words(word_counts(spark, sf_dir), "mine", "theirs")


DISTINCTIVE_SQL = f"""WITH {COUNTS},
w AS (SELECT word, sum(CASE WHEN side = 'mine' THEN n ELSE 0 END)::DOUBLE AS y1, sum(CASE WHEN side = 'theirs' THEN n ELSE 0 END)::DOUBLE AS y2, sum(CASE WHEN side = 'mine' THEN n_cap ELSE 0 END) AS cap FROM c GROUP BY word),
g AS (SELECT sum(y1) AS n1, sum(y2) AS n2, sum(CASE WHEN y1 > 0 THEN 1 ELSE 0 END) AS v FROM w),
a AS (SELECT *, (y1 + y2) * 0.01::DOUBLE + 0.5 AS a, (n1 + n2) * 0.01::DOUBLE + v * 0.5 AS a0 FROM w, g WHERE y1 > 0 AND y1 + y2 >= 40 AND cap / y1 <= 0.5),
z AS (SELECT word, y1 AS mine, y2 AS theirs, floor((ln((y1 + a) / (n1 + a0 - y1 - a)) - ln((y2 + a) / (n2 + a0 - y2 - a))) / sqrt(1 / (y1 + a) + 1 / (y2 + a)) * 100 + 0.5) / 100 AS z, floor(y1 / n1 * 100000 + 0.5) / 10 AS per10k FROM a)
SELECT * FROM z ORDER BY z DESC, word LIMIT 60"""


def _redacted(f):
    def run(spark, sf_dir):
        return read(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("text"))

    return run


redact_email, redact_card, whitespace = _redacted(redact.emails), _redacted(redact.cards), _redacted(redact.spaces)


def redact_phone(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(redact.PHONE)), F.lit(0)).cast("long").alias("n_phones"))


def redact_all(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", redact.scrubbed(F.col("text"), ["Petrov", "Schmidt", "Eriner", "Thing"]).alias("text"))


REDACT = "SELECT doc_id, {} AS text FROM documents"
EMAIL_SQL = REDACT.format(r"regexp_replace(text, '\b[\w.%+-]+@[\w.-]+\.[a-z]{2,}\b', '<почта>', 'gi')")
CARD_SQL = REDACT.format(r"regexp_replace(text, '\b(?:\d[ -]?){13,19}\b', '<карта>', 'g')")
SPACE_SQL = REDACT.format(rf"regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^[{SPACES}]+|[{SPACES}]+$', '', 'g')")
PHONE_SQL = rf"SELECT doc_id, CAST(coalesce(len(list_filter(regexp_extract_all(text, '\+?\d[\d{SPACES}()-]{{9,}}\d'), lambda m: length(regexp_replace(m, '\D', '', 'g')) >= 10)), 0) AS BIGINT) AS n_phones FROM documents"

# a match of PHONE has ten digits, so it lies in no match that stays; longer ones go first
REDACT_ALL_SQL = rf"""WITH e AS (SELECT doc_id, text FROM ({EMAIL_SQL})),
c AS (SELECT doc_id, regexp_replace(text, '\b(?:\d[ -]?){{13,19}}\b', '<карта>', 'g') AS text FROM e),
f AS (SELECT *, list_filter(regexp_extract_all(text, '\+?\d[\d{SPACES}()-]{{9,}}\d'), lambda m: length(regexp_replace(m, '\D', '', 'g')) >= 10) AS found FROM c),
o AS (SELECT doc_id, text, list_transform(list_sort(list_transform(found, lambda m: {{'k': -length(m), 'm': m}})), lambda x: x.m) AS found FROM f),
p AS (SELECT doc_id, list_reduce(list_prepend(text, found), lambda a, b: replace(a, b, '<телефон>')) AS text FROM o),
n AS (SELECT doc_id, regexp_replace(text, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:Schmidt|Petrov|Eriner|Thing)[\p{{L}}\p{{N}}_]*', '\1<имя>', 'g') AS text FROM p)
SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '^[{SPACES}]+|[{SPACES}]+$', '', 'g') AS text FROM n"""


def near_dup_collapse(spark, sf_dir):
    """Distinct lines of documents: of those alike but for case and punctuation, the first stays."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    key = near_key(F.col("line"))
    kept = d.groupBy(key.alias("key")).agg(F.min(F.struct("doc_id", "at", "line")).alias("f"), F.count("*").alias("n"))
    return kept.select("key", "f.doc_id", F.col("f.at").alias("line_no"), "f.line", "n")


NEAR_SQL = r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), d AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM s),
k AS (SELECT *, regexp_replace(lower(line), '[^\p{L}\p{N}]+', '', 'g') AS key FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS k, count(*) OVER (PARTITION BY key) AS n FROM k)
SELECT key, doc_id, CAST(i AS INTEGER) AS line_no, line, n FROM r WHERE k = 1"""


def holdout_pick(spark, sf_dir):
    return turns.pick_holdout(pair_turns(spark, sf_dir).drop("holdout"), 50).where("holdout").select("id", "context_in")


HOLDOUT_SQL = f"""WITH {PAIRS}, f AS (SELECT id, context_in FROM t WHERE length(context_in) >= 15 AND length(text) >= 15),
n AS (SELECT greatest(1, count(*) // 50) AS step FROM f), r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS k FROM f)
SELECT id, context_in FROM r, n WHERE k % step = 0 AND k // step < 50"""


def pair_stats(spark, sf_dir):
    return search.pair_stats(document_turns(spark, sf_dir), ["register"]).withColumn("share", half_up(F.col("share"), 3))


PAIR_SQL = f"""WITH {DOCS} SELECT register, count(*) AS turns, count(context_in) AS pairs, sum(CASE WHEN context_explicit THEN 1 ELSE 0 END)::BIGINT AS quoted,
  floor(count(context_in) / count(*) * 1000 + 0.5) / 1000 AS share FROM t WHERE NOT holdout GROUP BY register"""


def owner_detect(spark, sf_dir):
    from quillmark.sources import export

    c = read(spark, sf_dir, "conversations")
    rows = c.select(F.lit(0).alias("section"), F.col("conv_id").alias("chat_no"), F.col("turn").alias("pos"), F.lit("personal_chat").alias("chat_type"), F.col("role").alias("from_id"))
    return export.owner_of(rows)


OWNER_SQL = "SELECT role AS from_id FROM (SELECT role, count(*) AS n, min((conv_id, turn)) AS f FROM conversations GROUP BY role ORDER BY n DESC, f LIMIT 1)"


def pseudonyms(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return c.select("conv_id", pseudonym("chat", F.concat(F.col("conv_id").cast("string"), F.lit(":name"))).alias("chat_key"))


PSEUDONYM_SQL = "SELECT DISTINCT conv_id, 'chat-' || substr(sha256(conv_id || ':name'), 1, 6) AS chat_key FROM conversations"


def code_overlaps(spark, sf_dir):
    """Each document as a comment on the benchmark item whose rank is its number modulo the count of items."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("code"))
    n = items.count()
    # an item's words are made once, not with each document that it meets
    b = turns.ranks(items, "item_id", "code").select((F.col("rank") - 1).alias("k"), code_words(F.col("code")).alias("theirs"))
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % F.lit(max(1, n))).alias("k"), code_words(F.col("text")).alias("own"))
    met = d.join(F.broadcast(b) if n <= search.MOST_LOCAL else b, "k")
    return met.select("doc_id", half_up(shared_words(F.col("own"), F.col("theirs")), 3).alias("overlap"))


def _words_sql(c: str) -> str:
    return rf"list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all({c}, '\p{{L}}{{3,}}'), lambda w: string_split(regexp_replace(w, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), ' '))), lambda w: lower(w)), lambda w: length(w) >= 3))"


OVERLAP_SQL = f"""WITH b AS (SELECT row_number() OVER (ORDER BY item_id, text) - 1 AS k, text AS code FROM benchmark), j AS (SELECT doc_id, {_words_sql('d.text')} AS own, {_words_sql('code')} AS theirs FROM documents d JOIN b ON b.k = d.doc_id % (SELECT greatest(count(*), 1) FROM benchmark))
SELECT doc_id, floor((CASE WHEN len(own) = 0 OR len(theirs) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(own, theirs))::DOUBLE / len(own) END) * 1000 + 0.5) / 1000 AS overlap FROM j"""


def score_texts(spark, sf_dir):
    """Documents scored against the profile of the documents of their register that aren't long."""
    t = document_turns(spark, sf_dir)
    usual = written(t.where("not longform and chars < 600").select("id", "register", "parts", "chars"), "usual")  # measured several times
    measured = metrics.measure(usual, ["register"])
    shares = habits.probe_shares(metrics.messages_of(usual), habits.HABITS, "message").agg(habits.habit_share(None, habits.LIST_LABELS).alias("list_share"), F.lit(0.1).alias("markdown_share"))
    marks = F.map_from_arrays(F.array(*[F.lit(p.label) for p in habits.FOREIGN_MARKS]), F.array(*[F.lit(0.0)] * len(habits.FOREIGN_MARKS)))
    profile = measured.crossJoin(shares).withColumn("mark_shares", marks)
    out = score.check_texts(t, profile)
    return out.select("id", "register", "score", "verdict", "messages", F.size("findings").alias("n_findings"))


def _score_sql() -> str:
    at = lambda xs, p: f"{xs}[CAST(least(len({xs}) - 1, floor(len({xs}) * {p}::DOUBLE)) AS BIGINT) + 1]"
    return rf"""WITH {DOCS},
u AS (SELECT * FROM t WHERE NOT longform AND chars < 600), um AS (SELECT register, unnest(parts) AS m FROM u),
a AS (SELECT register, {at('cs', 0.9)} AS turn_top FROM (SELECT register, list_sort(list(chars)) AS cs FROM u GROUP BY register)),
b AS (SELECT register, {at('ls', 0.9)} AS top, ex, per, cap FROM (SELECT register, list_sort(list(length(m))) AS ls, {sql_share("contains(m, '!')", 'ex')}, {sql_share("m[-1] = '.'", 'per')},
  floor(coalesce(sum(CASE WHEN regexp_matches(m[1], '\p{{L}}') AND m[1] = upper(m[1]) AND m[1] <> lower(m[1]) THEN 1 END), 0) / greatest(coalesce(sum(CASE WHEN regexp_matches(m[1], '\p{{L}}') THEN 1 END), 0), 1) * 1000 + 0.5) / 1000 AS cap FROM um GROUP BY register)),
ml AS (SELECT max(s) AS list_share FROM (SELECT floor(avg(CASE WHEN regexp_matches(m, p) THEN 1.0::DOUBLE ELSE 0 END) * 100000 + 0.5) / 1000 AS s FROM um, (SELECT unnest(['(?m)^[{SPACES}]*[-–—][{SPACES}]+[^{SPACES}]', '(?m)^[{SPACES}]*[0-9][.)][{SPACES}]+[^{SPACES}]', '(?m)^[{SPACES}]*•']) AS p) GROUP BY p)),
x AS (SELECT id, register, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(s, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')), lambda s: s <> '') AS m FROM t),
y AS (SELECT *, array_to_string(m, chr(10)) AS w, len(m) AS n FROM x),
z AS (SELECT y.*, a.*, b.*, list_share FROM y JOIN a USING (register) JOIN b USING (register), ml),
f AS (SELECT id, register, n,
  list_transform(list_filter(m, lambda s: length(s) > top), lambda s: CAST(least(25, 5 + floor((length(s)::DOUBLE / greatest(top, 1) - 1) * 20)) AS INTEGER)) AS c1,
  length(w) > turn_top AS c2, register <> 'longform' AND n = 1 AND length(w) > top AS c3,
  len(list_filter(m, lambda s: contains(s, '!'))) > greatest(1.0, ex * n * 3) AS c4,
  per > 0.5 AND len(list_filter(m, lambda s: regexp_matches(s, '[\p{{L}}\p{{N}}]$'))) / greatest(n, 1) > 0.6 AS c5,
  cap > 0.8 AND len(list_filter(m, lambda s: regexp_matches(s, '^\p{{Ll}}'))) / greatest(n, 1) > 0.4 AS c6,
  list_share < 0.2 AND regexp_matches(w, '(?m)^[{SPACES}]*([-–—•*]|[0-9][.)])[{SPACES}]+[^{SPACES}]') AS c8, regexp_matches(w, '\*\*|__') AS c9 FROM z),
s AS (SELECT id, register, n, greatest(0, 100 - coalesce(list_sum(c1), 0) - c2::INT * 10 - c3::INT * 10 - c4::INT * 10 - c5::INT * 8 - c6::INT * 8 - c8::INT * 15 - c9::INT * 12) AS score,
  len(c1) + c2::INT + c3::INT + c4::INT + c5::INT + c6::INT + c8::INT + c9::INT AS n_findings FROM f)
SELECT id, register, CAST(CASE WHEN n = 0 THEN 0 ELSE score END AS INTEGER) AS score, CASE WHEN n = 0 THEN 'nothing to check' WHEN score >= 85 THEN 'mine' WHEN score >= 65 THEN 'close' WHEN score >= 40 THEN 'barely' ELSE 'foreign' END AS verdict,
  CAST(n AS INTEGER) AS messages, CAST(CASE WHEN n = 0 THEN 0 ELSE n_findings END AS INTEGER) AS n_findings FROM s"""


def facet_scan(spark, sf_dir):
    return search.facet_filter(document_turns(spark, sf_dir), register="longform", lang="en", require_context=True, year_from=2018, max_chars=50_000).select("id", "year", "chars")


FACET_SQL = f"WITH {DOCS} SELECT id, year, chars FROM t WHERE NOT holdout AND longform AND lang = 'en' AND context_in <> '' AND year >= 2018 AND chars <= 50000"


def random_topup(spark, sf_dir):
    return search.sample(document_turns(spark, sf_dir), 40, seed=3, register="dm").select("id", "place")


DRAW_SQL = rf"""WITH {DOCS}, d AS (SELECT id, text, CAST('0x' || substr(sha256('3:' || id), 1, 13) AS BIGINT) AS cost FROM t WHERE NOT holdout AND register = 'dm'),
n AS (SELECT * FROM d ORDER BY cost, id LIMIT 40), k AS (SELECT *, row_number() OVER (PARTITION BY {NEAR} ORDER BY cost, id) AS k FROM n)
SELECT id, CAST(row_number() OVER (ORDER BY cost, id) AS INTEGER) AS place FROM k WHERE k = 1"""


def emoji_palette(spark, sf_dir):
    said = metrics.messages_of(document_turns(spark, sf_dir), "register")
    return metrics.emoji_counts(said.withColumn("message", F.concat("message", F.when(F.contains("message", F.lit("!")), "😀").otherwise("🎉"))), ["register"])


EMOJI_SQL = rf"""WITH {DOCS}, m AS (SELECT register, unnest(parts) AS m FROM t),
e AS (SELECT register, unnest(regexp_extract_all(m || CASE WHEN contains(m, '!') THEN '😀' ELSE '🎉' END, '{emoji_class()}')) AS char FROM m),
c AS (SELECT register, char, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY register ORDER BY n DESC, char) AS INTEGER) AS place FROM c)
SELECT * FROM r WHERE place <= 15"""


def length_bounds(spark, sf_dir):
    m = metrics.floor_percentiles(document_turns(spark, sf_dir), ["register"], "chars").select(F.col("register").alias("facet"), F.lit("all").alias("window"), F.struct("median", "p75").alias("turn_length"))
    return metrics.length_bounds(m)


BOUNDS_SQL = f"WITH {DOCS}, p AS ({sql_percentiles('t', 'register', 'chars')}) SELECT register AS facet, median AS short_max, p75 AS long_min FROM p"

#: name: (query, SQL or None)
CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "reply_bm25_topk": (reply_bm25_topk, REPLY_SQL),
    "turn_bm25_topk": (turn_bm25_topk, TURN_SQL),
    "stemmed_search": (stemmed_search, None),
    "reply_with_topup": (reply_with_topup, _topup_sql()),
    "length_stats_by_register": (length_stats_by_register, f"WITH {DOCS} " + sql_percentiles("t", "register", "chars")),
    "numeric_floor_percentiles": (numeric_floor_percentiles, sql_percentiles("lineitem", "l_returnflag", "l_quantity")),
    "burst_turns": (burst_turns, BURST_SQL),
    "turn_context": (turn_context, CONTEXT_SQL),
    "filter_stats": (filter_stats, FILTER_SQL),
    "punctuation_profile": (punctuation_profile, PUNCT_SQL),
    "burst_stats": (burst_stats, BURST_STATS_SQL),
    "recent_vs_all": (recent_vs_all, RECENT_SQL),
    "habit_shares": (habit_shares, HABIT_SQL),
    "typography_shares": (typography_shares, TYPO_SQL),
    "word_counts": (word_counts, f"WITH {COUNTS} SELECT * FROM c"),
    "distinctive_words": (distinctive_words, DISTINCTIVE_SQL),
    "redact_email": (redact_email, EMAIL_SQL),
    "redact_card": (redact_card, CARD_SQL),
    "redact_phone": (redact_phone, PHONE_SQL),
    "redact_all": (redact_all, REDACT_ALL_SQL),
    "whitespace": (whitespace, SPACE_SQL),
    "near_dup_collapse": (near_dup_collapse, NEAR_SQL),
    "holdout_pick": (holdout_pick, HOLDOUT_SQL),
    "pair_stats": (pair_stats, PAIR_SQL),
    "owner_detect": (owner_detect, OWNER_SQL),
    "pseudonyms": (pseudonyms, PSEUDONYM_SQL),
    "code_overlap": (code_overlaps, OVERLAP_SQL),
    "score_texts": (score_texts, _score_sql()),
    "facet_scan": (facet_scan, FACET_SQL),
    "length_bounds": (length_bounds, BOUNDS_SQL),
    "random_topup": (random_topup, DRAW_SQL),
    "emoji_palette": (emoji_palette, EMOJI_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
