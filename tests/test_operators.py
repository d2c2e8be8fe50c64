import datetime
import json
import math
import random
import re
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from quillmark import config
from quillmark.functions import stem, text
from quillmark.operators import code_metrics, comments, habits, lexicon, metrics, redact, score, search, turns
from quillmark.sources import export, ranges, repositories, store


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.utf16_len(F.col("a")), a="a😀б") == 4
    assert one(spark, text.trimmed(F.col("a")), a="  a b \n") == "a b"
    assert one(spark, text.near_key(F.col("a")), a="Ок, ДА!") == "окда"
    assert one(spark, text.shortened(F.col("a"), 5), a="abcdefgh") == "ab..."
    assert one(spark, text.half_up(F.lit(-2.5)), a="") == -2.0
    assert one(spark, text.script_language(F.col("a")), a="это comment") == "ru"
    assert one(spark, text.comment_syntax(F.col("a")), a="x/y.TSX") == "c"
    assert one(spark, text.comment_syntax(F.col("a")), a="README") is None
    assert one(spark, F.col("a").rlike(text.whole_word("однако")), a="Ну, Однако же") is True
    assert one(spark, F.col("a").rlike(text.whole_word("однако")), a="неоднако") is False
    assert one(spark, F.regexp_count("a", F.lit(text.emoji_pattern())), a="a😀ツ1") == 2
    assert one(spark, text.around(F.col("a"), "—"), a="one two — three four") == "two — three"
    assert one(spark, text.code_overlap(F.col("a"), F.col("b")), a="set the retry timeout", b="setRetryTimeout()") == 0.75


@pytest.mark.parametrize("family", ["сообщение сообщения сообщений сообщениями", "работа работы работу работой", "comment comments", "caching cache cached", "running runs run"])
def test_stem_families(family):
    assert len({stem.stem(w) for w in family.split()}) == 1


def test_stems_column(spark):
    assert one(spark, text.tokens(F.col("a")), a="Ёлка, я и Comments") == ["елка", "comments"]
    assert one(spark, stem.stems(F.col("a")), a="Ёлка, я и Comments") == stem.stem_text("Ёлка, я и Comments")


def test_config():
    got = config.load({"QUILLMARK_BURST_WINDOW_SECONDS": "60", "QUILLMARK_NEVER_MARKS": "—:-, ::;, …", "QUILLMARK_CODE_EMAILS": "a@b.c, d@e.f"})
    assert got.burst_window_seconds == 60 and got.code_emails == ("a@b.c", "d@e.f")
    assert got.never_marks == (config.NeverMark("—", "-"), config.NeverMark(":", ";"), config.NeverMark("…"))
    assert got.recent_from(2026) == 2025
    with pytest.raises(ValueError, match="QUILLMARK_HOLDOUT_SIZE"):
        config.load({"QUILLMARK_HOLDOUT_SIZE": "many"})


def test_redaction(spark):
    say = lambda a, names=None: one(spark, redact.scrubbed(F.col("a"), names), a=a)
    assert say("write  to a.b@c.de now") == "write to <почта> now"
    assert say("card 4111 1111 1111 1111.") == "card <карта>."
    assert say("call +49 (170) 123-45-67 or 12-34") == "call <телефон> or 12-34"
    assert say("с Ивановым и Petrovs", ["Иванов", "Petrov"]) == "с <имя> и <имя>"
    assert one(spark, redact.has_substance(F.col("a")), a="<ссылка> )") is False
    entities = F.from_json("a", export.ENTITY)
    raw = json.dumps([{"type": "bot_command", "text": "/go"}, {"type": "text_link", "text": "see "}, {"type": "phone", "text": "1"}, {"type": "mention", "text": "@x"}])
    assert one(spark, redact.cleaned(entities), a=raw) == "see <телефон>@собеседник"
    names = spark.createDataFrame([("Ivan Petrov",), ("Olga",), (" Ann de Vries ",)], "name string")
    assert {r.surname for r in redact.surname_rows(names).collect()} == {"Petrov", "de", "Vries"}
    assert {r.prefix for r in redact.first_name_prefixes(names).collect()} == {"ivan", "olga"}


NAMES = ["Petrov", "Petrovsky", "Smith-Jones", "O'Neil", "Иванов", "ΠΑΠΑΣ", "Straße", "van.der", "(Weird", "C++dev", "Lee", "  Kowalski ", "!!!!", "ab_c", "İnce", "1234"]
TEXTS = ["petrov", "PETROVSKYmu said", "xPetrov no", "with smith-jones's dog and Smith alone", "smith-jone", "o'neil O'NEILS o neil", "с Ивановым, ивановы", "παπας ΠΑΠΑΣΤΟ", "STRASSE straße", "van.derbilt vanxder", "so (weirdo) weird", "c++developer c dev", "Lee Leeds", "kowalskiego", "wow!!!! and !!!!x", "AB_C1 ab-c", "ince İNCE inces", "call 1234567", None, "", "nothing"]


def test_surnames_by_join_are_those_of_one_pattern(spark):
    rng = random.Random(1)
    letters = "abcdeéжз"
    many = ["".join(rng.choices(letters, k=rng.randrange(3, 7))) for _ in range(300)]
    said = TEXTS + [" ".join(w + rng.choice(["", "a", "-b", "!"]) for w in rng.choices(many + ["zzzz", "yyyy"], k=6)) for _ in range(60)]
    rows = spark.createDataFrame([(k // 7, k % 7, t) for k, t in enumerate(said)], "a int, b int, text string")
    for names in (NAMES, many, [*NAMES, *many], []):
        want = {(r.a, r.b): r.t for r in rows.select("a", "b", redact.spaces(redact.surnames(redact.phones(F.col("text")), names)).alias("t")).collect()}
        known = spark.createDataFrame([(n,) for n in names], "surname string")
        assert {(r.a, r.b): r.text for r in redact.scrubbed_rows(rows, ["a", "b"], "text", known).collect()} == want


def test_a_million_surnames(spark):
    names = spark.range(1_000_000).select(F.concat(F.lit("Name"), F.hex("id")).alias("surname"))
    rows = spark.createDataFrame([(0, "so nameF423Fov and name0 left"), (1, "nam and Nobody")], "id int, text string")
    got = {r.id: r.text for r in redact.scrubbed_rows(rows, ["id"], "text", names).collect()}
    assert got == {0: "so <имя> and <имя> left", 1: "nam and Nobody"}


def expected_turns(rows, window, cap, age):
    """The rules read one message after another."""
    by_id = {m["id"]: m for m in rows}
    out, now, last, pending = [], None, 0, None
    for m in rows:
        if m["from_id"] != "me":
            now = None
            if m["clean"]:
                pending = m
            continue
        if m["is_via_bot"] or not m["clean"]:
            last = m["ts"]
            continue
        if now is None or len(now["parts"]) >= cap or m["ts"] - last > window:
            quote = by_id.get(m["reply_to"]) if m["reply_to"] else None
            if quote is not None and (quote["from_id"] == "me" or not quote["clean"]):
                quote = None
            guess = pending if pending is not None and m["ts"] - pending["ts"] <= age else None
            said, pending = quote or guess, None
            now = {"pos": m["pos"], "parts": [], "context": said and said["clean"], "explicit": quote is not None, "lag": max(0, m["ts"] - said["ts"]) if said else None}
            out.append(now)
        now["parts"].append(m["clean"])
        last = m["ts"]
    return out


@pytest.mark.parametrize(("window", "cap", "age", "stretch"), [(90, 10, 300, turns.STRETCH), (300, 3, 1000, turns.STRETCH), (90, 10, 300, 1), (300, 3, 1000, 2), (200, 4, 1000, 5), (400, 3, 5000, 17), (90, 2, 300, 60)])
def test_turns_follow_the_rules(spark, window, cap, age, stretch):
    rng, rows = random.Random(window), []
    for chat in range(12):
        ts = 1_700_000_000
        for pos in range(120):
            ts += rng.choice([5, 30, 90, 91, 200, 400, -20])
            kept = rng.random() < 0.9
            rows.append({"chat_key": f"c{chat}", "pos": pos, "id": pos + 1 if rng.random() < 0.95 else 7, "from_id": rng.choice(["me", "me", "you"]), "ts": ts, "text": f"word{pos}", "clean": f"word{pos}" if kept else "", "is_forwarded": False, "is_via_bot": rng.random() < 0.1, "n_links": 0, "reply_to": rng.choice([None, 0, rng.randrange(1, 121)]), "register": "dm"})
    df = spark.createDataFrame(rows, "chat_key string, pos int, id long, from_id string, ts long, text string, clean string, is_forwarded boolean, is_via_bot boolean, n_links int, reply_to long, register string")
    built = turns.build_turns(turns.judged(df, F.lit("me")), config.Config(burst_window_seconds=window, max_parts=cap, context_max_age_seconds=age), stretch)
    got = {(r.chat_key, r.pos, tuple(r.parts), r.context_in, r.context_explicit, r.context_lag) for r in built.collect()}
    want = {(c, t["pos"], tuple(t["parts"]), t["context"], t["explicit"], t["lag"]) for c in {r["chat_key"] for r in rows} for t in expected_turns([r for r in rows if r["chat_key"] == c], window, cap, age)}
    assert got == want and len(got) > 300


@pytest.mark.parametrize("stretch", [3, 40])
def test_one_chat_of_long_runs_spreads_over_tasks(spark, stretch):
    """Hardly anyone else speaks, so runs, bursts and pending messages reach over many stretches."""
    rng, rows, ts = random.Random(stretch), [], 1_700_000_000
    for pos in range(2000):
        ts += rng.choice([1, 2, 3, 100])
        who = "you" if rng.random() < 0.004 else "me"
        rows.append({"chat_key": "c", "pos": pos * 2, "id": pos + 1, "from_id": who, "ts": ts, "text": f"word{pos}", "clean": f"word{pos}" if rng.random() < 0.5 else "", "is_forwarded": False, "is_via_bot": rng.random() < 0.3, "n_links": 0, "reply_to": None, "register": "dm"})
    df = spark.createDataFrame(rows, "chat_key string, pos int, id long, from_id string, ts long, text string, clean string, is_forwarded boolean, is_via_bot boolean, n_links int, reply_to long, register string")
    held = config.Config(burst_window_seconds=50, max_parts=7, context_max_age_seconds=100_000)
    marked = turns.judged(df, F.lit("me"))
    got = {(r.pos, tuple(r.parts), r.context_in, r.context_lag) for r in turns.build_turns(marked, held, stretch).collect()}
    assert got == {(t["pos"], tuple(t["parts"]), t["context"], t["lag"]) for t in expected_turns(rows, 50, 7, 100_000)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert turns.started(marked, held, stretch).select(F.spark_partition_id()).distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rejects(spark):
    rows = [("a", True, False, 0), ("a", False, True, 0), ("  ", False, False, 0), ('{"a": 1}', False, False, 0), ("x = [1]; y", False, False, 0), ("see", False, False, 4), ("fine", False, False, 3), (None, False, False, 0)]
    df = spark.createDataFrame(rows, "t string, f boolean, b boolean, n int")
    got = [r.x for r in df.select(turns.reject_reason(F.col("t"), F.col("f"), F.col("b"), F.col("n")).alias("x")).collect()]
    assert got == ["forwarded", "via-bot", "empty", "structured", "structured", "link-spam", None, "empty"]


def test_holdout(spark):
    df = spark.createDataFrame([(i * 3, "t" * 20, "c" * (20 if i % 2 else 5)) for i in range(100)], "id long, text string, context_in string")
    ids = sorted(r.id for r in turns.pick_holdout(df, 10).where("holdout").collect())
    assert ids == [3 * (2 * k + 1) for k in range(0, 50, 5)]
    assert turns.pick_holdout(df, 0).where("holdout").count() == 0
    assert turns.pick_holdout(df, 80).where("holdout").count() == 50


def test_floor_percentile(spark):
    df = spark.createDataFrame([("a", x) for x in [4, 1, 3, 2]] + [("b", None)], "k string, x int")
    assert [tuple(r) for r in metrics.floor_percentiles(df, ["k"], "x").collect()] == [("a", 4, 2.5, 2, 3, 4, 4, 4)]


def percentiles_by_sorting(rows, shares):
    groups, out = {}, {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    for k, xs in groups.items():
        xs.sort(key=lambda x: (x != x, x))  # NaN last
        out[k] = tuple(xs[min(len(xs) - 1, math.floor(len(xs) * p))] for p in shares.values())
    return out


@pytest.mark.parametrize("widest,ranges", [(1 << 16, 512), (0, 2), (0, 7), (50, 16)])
def test_percentiles_by_ranges_are_those_of_sorting(spark, widest, ranges):
    rng = random.Random(5)
    rows = [("spread", rng.lognormvariate(0, 40)) for _ in range(3000)] + [("narrow", 1000 + rng.random() * 1e-9) for _ in range(500)]
    rows += [("ties", float(rng.randrange(3))) for _ in range(2000)] + [("hot", 7.0)] * 999 + [("hot", x / 10) for x in range(100)] + [("one", -0.5), (None, 3.0), (None, 1.0), ("none", None)]
    rows += [("odd", x) for x in (math.inf, -math.inf, math.nan, math.nan, 0.0, 2.0)]
    shares = {"lowest": 0.0, "tenth": 0.1, "median": 0.5, "p99": 0.99, "whole": 1.0}
    got = metrics.floor_percentiles(spark.createDataFrame(rows, "k string, x double").repartition(7), ["k"], "x", shares, widest, ranges).collect()
    plain = lambda t: tuple("nan" if x != x else x for x in t)
    assert {r.k: plain(r[s] for s in shares) for r in got} == {k: plain(t) for k, t in percentiles_by_sorting(rows, shares).items()}
    assert {r.k: r["count"] for r in got}["hot"] == 1099 and len(got) == 7


def test_percentiles_of_whole_numbers_beyond_doubles(spark):
    """Neighbours above 2^53 are one double but stay apart."""
    rows = [("k", (1 << 53) + x) for x in range(1000)]
    got = metrics.floor_percentiles(spark.createDataFrame(rows, "k string, x long"), ["k"], "x", {"median": 0.5, "p90": 0.9}, 10, 8).first()
    assert (got["median"], got.p90, got["max"]) == ((1 << 53) + 500, (1 << 53) + 900, (1 << 53) + 999)
    assert metrics.floor_percentiles(spark.createDataFrame(rows, "k string, x long").where("x < 0"), ["k"], "x").count() == 0


def test_no_task_orders_all_values_of_a_key(spark):
    """Of 200 000 distinct values only ranges that hold a rank reach the ordering."""
    rows = spark.range(200_000).selectExpr("'k' as k", "cast(id as double) / 7 as x")
    shares = {"median": 0.5, "p90": 0.9}
    each = rows.groupBy("k", "x").agg(F.count("*").alias("_n"))
    known = each.groupBy("k").agg(F.percentile_approx("x", [i / 64 for i in range(1, 64)], 640).alias("_cuts"))
    held = metrics.holding(each, known, ["k"], "x", shares)
    ordered = metrics.with_known(each, held, ["k"], ["x", "_n"]).where("x between _lo and _hi")
    assert held.count() == 2 and ordered.count() < 200_000 * 2 / 64 * 1.5
    got = metrics.floor_percentiles(rows, ["k"], "x", shares, 1000, 64).first()
    assert (got["median"], got.p90) == (100_000 / 7, 180_000 / 7)


def turn_rows(spark, rows):
    return spark.createDataFrame([(i, r, t.split("\n"), t, len(t), len(t) >= 300, False, 2015 + i % 10) for i, (r, t) in enumerate(rows)], "id long, register string, parts array<string>, text string, chars int, longform boolean, holdout boolean, year int")


def test_measures(spark):
    t = turn_rows(spark, [("dm", "Да.\nНу да!"), ("dm", "ок"), ("group", "Что?"), ("dm", "x" * 300)])
    got = {(r.facet, r.window): r for r in metrics.measure(metrics.facets(t, 2017), ["facet", "window"]).collect()}
    assert set(got) == {("dm", "all"), ("dm", "recent"), ("group", "all"), ("group", "recent"), ("longform", "all"), ("longform", "recent")}
    dm = got["dm", "all"]
    assert dm.bursts.messages == 4 and dm.punctuation.starts_capital == 0.5 and dm.punctuation.ends_exclamation == 0.25
    assert metrics.chosen_window(metrics.measure(metrics.facets(t, 2017), ["facet", "window"])).select("window").distinct().first().window == "all"


def test_lexicon(spark):
    texts = [("mine", "ага " * 60 + "дом")] + [("theirs", "да " * 60 + "Ёж еж дом")]
    c = lexicon.word_counts(spark.createDataFrame(texts, "side string, text string"))
    assert c.where("side = 'theirs' and word = 'еж'").first().n == 2
    best = lexicon.distinctive_words(c, "mine", "theirs").first()
    assert best.word == "ага" and best.z > 0
    assert lexicon.distinctive_words(c.where("side = 'mine'"), "mine", "theirs").count() == 0
    veto = spark.createDataFrame([("ага",)], "word string")
    assert lexicon.distinctive_words(c, "mine", "theirs", excluded=veto).where("word = 'ага'").count() == 0


def test_probes(spark):
    df = spark.createDataFrame([("- раз\n- два",), ("однако — да",), ("a --flag",), ("так -- так",)], "text string")
    got = {r.label: r for r in habits.probe_shares(df, [*habits.HABITS, *habits.TYPOGRAPHY]).collect()}
    assert got["списки через дефис"].hits == 1 and got["однако"].share == 25.0 and got["двойной дефис --"].hits == 1
    measured = habits.probe_shares(df, habits.TYPOGRAPHY)
    assert {r.label for r in habits.foreign_marks(measured, ("…",)).collect()} == {"кавычки-ёлочки «»", "короткое тире –", "кавычки-лапки “”", "стрелка →"}
    assert habits.empty_shares(df).agg(habits.habit_share(None, habits.LIST_LABELS).alias("s")).first().s is None


def searchable(spark):
    rows = [(1, "Сообщение про деплой сервера", 2026), (2, "сообщения о погоде", 2026), (3, "Деплой упал", 2016), (4, "деплой упал!", 2016), (5, "кот", 2026)]
    return spark.createDataFrame([(i, t, "dm", "ru", y, len(t), False, False, "вопрос", i == 1, 10 * i) for i, t, y in rows], "id long, text string, register string, lang string, year int, chars int, longform boolean, holdout boolean, context_in string, context_explicit boolean, context_lag long")


def test_search(spark):
    t = searchable(spark)
    ask = lambda q: spark.createDataFrame([(0, q)], "query_id int, query string")
    index = search.build_index(t)
    assert index.n_docs == 5
    found = search.search(index, t, ask("это деплой серверов"), 3).orderBy("place").collect()
    assert [r.id for r in found] == [1, 3]  # 4 repeats 3
    filled = search.search(index, t, ask("не в на"), 3, seed=5).collect()
    assert len(filled) == 3 and all(r.source == 1 for r in filled)
    assert [r.term for r in search.query_terms(ask("в " + " ".join(f"w{'x' * k}" for k in range(1, 30)))).collect()][0] == "w" + "x" * 29
    by_context = search.search(search.build_index(t, "context_in"), t, ask("вопрос"), 5, match_context=True).orderBy("place").first()
    assert by_context.id == 1
    stats = search.pair_stats(t)
    assert stats.first().quoted == 1
    quality = search.pair_quality(search.search(index, t, ask("деплой"), 5), stats, 5).first()
    assert (quality.few_pairs, quality.short, quality.none_quoted) == (False, True, False)


def many_turns(spark, n=6000):
    """Turns over many blocks of ids: frequent words everywhere, rare ones here and there, some texts alike."""
    rng = random.Random(3)
    words, weights = [f"wort{k}" for k in range(400)], [1 / (k + 1) for k in range(400)]
    rows = [(i * 3, " ".join(rng.choices(words, weights, k=rng.randrange(3, 30))), "dm" if i % 3 else "group", 2016 + i % 11, i % 7 == 0, i * 10) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string, register string, year int, context_explicit boolean, context_lag long").selectExpr("*", "false as holdout", "length(text) as chars", "length(text) > 200 as longform", "'de' as lang", "text as context_in")


def test_bounds_give_the_same_best(spark, monkeypatch):
    t = many_turns(spark).persist()
    monkeypatch.setattr(search, "FIRST_BLOCKS", 16)
    monkeypatch.setattr(search, "BLOCK_BITS", 7)
    index = search.build_index(t, stemmed=False)
    bounded = search.Index(index.postings, index.n_docs, index.avg_len, search.block_bounds(index.postings))
    asked = spark.createDataFrame([(0, "wort1 wort390"), (1, "wort2 wort380 wort300 wort5"), (2, "nothing here"), (3, "wort399")], "query_id int, query string")
    rows = lambda i, **facets: sorted((r.query_id, r.place, r.id, round(r.score, 9)) for r in search.search(i, t, asked, 4, stemmed=False, **facets).collect())
    for facets in ({}, {"register": "group", "match_context": True}, {"year_from": 2025}, {"min_chars": 10_000}):
        assert rows(bounded, **facets) == rows(index, **facets)
    scored = []
    plain = search.bm25
    monkeypatch.setattr(search, "bm25", lambda i, a, w=None: (scored.append(w), plain(i, a, w))[1])
    assert len(rows(bounded)) == len(rows(index)) > 8
    blocks = t.select(F.shiftright("id", 7)).distinct().count()
    assert scored[0].where("query_id = 0").count() == 16 and scored[1].where("query_id = 0").count() < blocks / 2  # those with the rare word
    t.unpersist()


def test_texts_are_fetched_for_winners_alone(spark, capsys):
    t = many_turns(spark, 200)
    search.search(search.build_index(t, stemmed=False), t, spark.createDataFrame([(0, "wort1 wort3")], "query_id int, query string"), 4, stemmed=False).explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    winners = plan[plan.index("BroadcastExchange") :]
    assert "WindowGroupLimit" in winners.split("row_number")[1] or "Window" in winners
    assert plan.index("text#") < plan.index("BroadcastExchange")


def test_a_key_of_any_size_collapses_to_one_row_a_task(spark, capsys):
    t = spark.range(0, 5000, 1, 8).selectExpr("0 as query_id", "id", "id % 7 as cost", "if(id % 2 = 0, 'Same, text!', 'same text') as text")
    got = search.collapsed(t, 5, ["cost", "id"])
    assert [(r.id, r.place) for r in got.collect()] == [(0, 1)]
    got.explain()
    assert "partial_min_by" in capsys.readouterr().out


@pytest.mark.parametrize("stemmed", [False, True])
def test_a_request_counts_terms_in_one_pass(spark, stemmed):
    rows = [(1, "Crème creme a CRÈME, ёж еж", False), (2, "sage é cats cat 12 1", False), (3, None, False), (4, "", False), (5, "creme", True)]
    t = spark.createDataFrame(rows, "id long, text string, holdout boolean")
    asked = spark.createDataFrame([(0, x) for x in ("creme", "crem", "еж", "cat", "none")], "query_id int, term string")
    made = search.TextIndex(t, stemmed=stemmed, words=search.said_words(t, "text")).cut(asked, True)
    whole = search.build_index(t, stemmed=stemmed)
    assert (made.n_docs, made.avg_len) == (whole.n_docs, whole.avg_len) == (3, 3.0)
    got, want = ({tuple(r) for r in i.postings.select("id", "term", "tf", "len").collect()} for i in (made, whole.cut(asked, True)))
    assert got == {x for x in want if x[1] in ("creme", "crem", "еж", "cat")} and len(got) >= 3
    assert "regexp_extract_all" not in made.postings._jdf.queryExecution().toString()


def test_a_word_meets_the_stemmer_once(spark):
    words = spark.createDataFrame([("сообщения",), ("running",), ("сообщения",), ("x1",)], "word string")
    known = stem.vocabulary(words)
    assert {r.word: r.stem for r in known.collect()} == {w: stem.stem(w) for w in ("сообщения", "running", "x1")}
    more = words.unionByName(spark.createDataFrame([("cached",), ("cached",)], "word string"))
    assert [(r.word, r.stem) for r in stem.vocabulary(more, known).collect()] == [("cached", stem.stem("cached"))]
    t = searchable(spark)
    held = stem.vocabulary(search.said_words(t, "text"))
    same = [sorted(map(tuple, search.build_index(t, known=k).postings.select("id", "term", "tf", "len").collect())) for k in (None, held)]
    assert same[0] == same[1] and len(same[0]) > 5


def profile_row(spark):
    length = {"p25": 3, "median": 10, "p75": 20, "p90": 20}
    shares = {"has_exclamation": 0.01, "ends_period": 0.9, "starts_capital": 0.95}
    schema = "register string, message_length struct<p25:int,median:int,p75:int,p90:int>, turn_length struct<p25:int,median:int,p75:int,p90:int>, punctuation struct<has_exclamation:double,ends_period:double,starts_capital:double>, bursts struct<messages:int>, emoji array<struct<place:int,char:string,n:bigint>>, list_share double, markdown_share double, mark_shares map<string,double>"
    return spark.createDataFrame([("dm", length, length, shares, {"messages": 500}, [{"place": 1, "char": "😀", "n": 3}], 0.0, None, {"длинное тире —": 0.1})], schema)


def test_scores(spark):
    texts = ["Да.", "x" * 30, "Раз!\nДва!", "Да. 🎉", "- раз.\n- два.", "**Да**.", "Однако да.", "А — да.", "", "А … да."]
    df = spark.createDataFrame([(i, "dm", t) for i, t in enumerate(texts)] + [(99, "group", "x")], "id int, register string, text string")
    got = {r.id: r for r in score.check_texts(df, profile_row(spark), (config.NeverMark("…", "..."),)).collect()}
    rules = lambda i: [f.rule[:3].strip() for f in got[i].findings]
    assert got[0].score == 100 and got[0].verdict == "mine" and got[0].findings == []
    assert rules(1) == ["C1", "C2", "C3", "C5", "C6"] and got[1].score == 100 - 15 - 10 - 10 - 8 - 8
    assert rules(2) == ["C4"] and rules(3) == ["C7"] and "C8" in rules(4) and rules(5) == []
    assert rules(6) == ["C10"] and rules(7) == ["C11"] and rules(9) == ["C11"] and got[9].findings[0].penalty == 15
    assert got[8].score == 0 and got[99].score == 0 and got[8].verdict == "nothing to check"


def test_one_look_spares_most_texts_the_patterns(spark):
    """What emoji, foreign marks and Cyrillic are told by misses no such character, and accented letters aren't taken for one."""
    marks = [re.sub(r"[\[\]]", "", p.pattern) for p in habits.FOREIGN_MARKS]
    held = [c for m in marks for c in m] + [chr(c) for span in text.pictographs() for c in span] + ["ツ", "Ѐ", "ӿ", "ᲀ"]
    rows = spark.createDataFrame([(c, True) for c in held if ord(c) > 127] + [(c, False) for c in ("é", "ñü", "plain", "1#*")], "_w string, want boolean")
    got = [(r._w, r._special, r.want) for r in score.looked_over(rows).collect()]
    assert len(got) > 100 and [x for x in got if x[1] != x[2]] == []


def test_longer_counts_utf16_units(spark):
    texts = ["", "a" * 5, "a" * 6, "é" * 5, "é" * 6, "😀" * 2, "😀" * 3, "a😀😀", "aa😀😀", "€" * 5, None]
    rows = spark.createDataFrame([(t, n) for t in texts for n in (0, 2, 5, 6, None)], "t string, n int")
    got = rows.select(text.longer(F.col("t"), F.col("n")).alias("a"), (text.utf16_len(F.col("t")) > F.col("n")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(bool(r.a) for r in got) > 10


SOURCE = """/**
 * Считает сумму чисел, потому что так надо.
 *
 * И ещё строка.
 */
export function add(a, b) {
\treturn a + b // tail
}

// TODO: because it breaks otherwise
// second line

const x = 1
/* one line */
// eslint-disable-next-line
"""


def test_words_of_code_are_made_once(spark):
    df = spark.createDataFrame([("setRetry ÉtéABC ab straßeNeu", "RETRY neu")], "a string, b string").select(text.code_overlap(F.col("a"), F.col("b")).alias("x"))
    assert df.first().x == 2 / 6  # set, retry, été, abc, straße, neu
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2


@pytest.mark.parametrize("words, wide, cyrillic", [("plain", False, False), ("é – 😀", True, False), ("\u1c82днако", True, True), ("ОДНАКО", True, True), (None, None, None)])
def test_texts_that_hold_no_such_letter_meet_no_such_pattern(spark, words, wide, cyrillic):
    r = score.looked_over(spark.createDataFrame([(words,)], "_w string")).select("_wide", "_cyrillic", text.utf16_len(F.col("_w")).alias("n")).first()
    assert (r._wide, r._cyrillic) == (wide, cyrillic) and r.n == (None if words is None else len(words.encode("utf-16-le")) // 2)
    assert all(re.search("[\u0400-\u04ff]", p.pattern) for p in [*score.CLERICAL, *score.FILLER]) and not any(p.pattern.isascii() for p in habits.FOREIGN_MARKS)


def test_comments(spark):
    files = spark.createDataFrame([("r", "a.ts", SOURCE), ("r", "b.py", "#!/bin/sh\n# hash note here\nx = 1"), ("r", "c.bin", "// no"), ("r", "d.lua", "--- doc line\n-- more\nf()"), ("r", "e.ts", None)], "repo string, path string, source string")
    got = {(r.path, r.start_line): r for r in comments.comment_blocks(files).collect()}
    assert set(got) == {("a.ts", 2), ("a.ts", 10), ("a.ts", 14), ("b.py", 2), ("d.lua", 1)}
    doc = got["a.ts", 2]
    assert doc.is_doc and doc.lines == ["Считает сумму чисел, потому что так надо.", "", "И ещё строка."] and doc.lang == "ru" and doc.code == "export function add(a, b) {"
    assert got["a.ts", 10].code == "const x = 1" and got["d.lua", 1].is_doc and got["b.py", 2].code == "x = 1"
    blame = spark.createDataFrame([("r", "a.ts", n, "me@x.y" if n < 11 else "other@x.y", 2020) for n in range(1, 16)], "repo string, path string, line_no int, email string, year int")
    mine = comments.comment_corpus(files, blame, ["ME@x.y"])
    assert [(r.path, r.start_line, r.year) for r in mine.collect()] == [("a.ts", 2, 2020)]
    as_turns = comments.comment_turns(mine).first()
    assert as_turns.register == "jsdoc" and as_turns.chat_key.startswith("repo-") and as_turns.context_in == doc.code


def test_code_metrics(spark):
    rows = [("r", ["TODO: x", "", "because"], False, "en", 2020), ("r", ["Да"], True, "ru", 2021), ("s", ["TODO again"], False, "en", 2024)]
    b = spark.createDataFrame([(*r, "\n".join(r[1])) for r in rows], "repo string, lines array<string>, is_doc boolean, lang string, year int, text string")
    sizes = {r.genre: r for r in code_metrics.genre_sizes(b).collect()}
    assert sizes["code"].block_lines.one_liners == 0.5 and sizes["code"].block_lines.median_multi == 3 and sizes["jsdoc"].russian == 1.0
    assert [(r.name, r.n) for r in code_metrics.marker_counts(b).collect()] == [("TODO", 2)]
    assert {r.name for r in code_metrics.connective_counts(b).collect()} == {"because"}
    split = code_metrics.split_markers(code_metrics.marker_counts(b)).first()
    assert split.own == ["TODO"] and len(split.foreign) == 7
    assert code_metrics.typography(b).count() == 0
    assert code_metrics.totals(b).first().lines == 4
    texts = spark.createDataFrame([(0, "code", "// FIXME set retry timeout", "fixme setRetryTimeout"), (1, "jsdoc", "@param {string} a", "")], "id int, register string, text string, code string")
    got = {r.id: {f.rule[:2] for f in r.findings} for r in score.check_comments(texts, code_metrics.genre_sizes(b), split.own, split.foreign).collect()}
    assert {"K1", "K2", "K4"} <= got[0]
    assert "K9" in got[1]


def chats():
    m = lambda i, who, t, body, **more: {"id": i, "type": "message", "date_unixtime": str(1_700_000_000 + t), "from": who, "from_id": who, "text": [body], "text_entities": [{"type": "plain", "text": body}], **more}
    friend = [m(1, "Ann Smith", 0, "привет, как дела сегодня?"), m(2, "me", 10, "Нормально."), m(3, "me", 20, "Работаю над задачей."), {"id": 4, "type": "service"}, m(5, "me", 5000, "чужое", forwarded_from="x"), m(6, "Ann Smith", 6000, "а что Smith?"), m(7, "me", 6010, "Ничего, спасибо.", reply_to_message_id=1)]
    return {"chats": {"list": [{"id": 1, "name": "Ann", "type": "personal_chat", "messages": friend}, {"id": 2, "name": "Saved", "type": "saved_messages", "messages": [m(1, "me", 0, "заметка себе")]}]}, "left_chats": {"list": [{"id": 3, "name": "Spam", "type": "private_supergroup", "messages": [m(1, "you", 0, "x")]}]}}


def test_build_and_serve(spark, tmp_path):
    from quillmark.plans import brief, build

    (tmp_path / "dump.json").write_text(json.dumps(chats(), indent=1))
    s = store.Store(spark, f"file://{tmp_path}/corpus")
    report = build.build_chat(spark, f"file://{tmp_path}/dump.json", s, config.Config(holdout_size=0, chat_stop_list=("spam",)), datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC))
    assert report == {"kept": 4, "forwarded": 1, "not-owner": 2, "turns": 3}
    rows = {r.text: r for r in s.turns().collect()}
    assert rows["Нормально.\nРаботаю над задачей."].context_in == "привет, как дела сегодня?"
    quoted = rows["Ничего, спасибо."]
    assert quoted.context_explicit and quoted.register == "dm" and quoted.chat_key.startswith("chat-")
    assert s.vocabulary().count() == s.vocabulary().select("word").distinct().count() > 5 and s.index().bounds.count() > 5
    words = s.vocabulary().count()
    s.rebuild_indexes()
    assert s.vocabulary().count() == words and s.index().postings.count() > 5
    assert s.turn(quoted.id).count() == 1 and s.next_id() > quoted.id and s.meta()["owner_id"] == "me"
    both, quality = brief.reply_examples(s, "привет, как дела", examples=4)
    assert both.count() == 3 and quality.first().few_pairs is False
    assert brief.find(s, "задача", 5).orderBy("place").first().text.endswith("задачей.")
    held = brief.constraints(s, "dm")
    assert held[0].name == "message_max"
    text_ = brief.render("Answer", both.collect(), held, "plain text")
    assert text_.index("# Task") < text_.index("# Examples") < text_.index("# Constraints") < text_.index("# Output")
    checked = brief.check(s, spark.createDataFrame([(0, "dm", "Да.")], "id int, register string, text string")).first()
    assert brief.render_check(checked).startswith(f"{checked.score}/100")
    with pytest.raises(ValueError, match="belongs to"):
        build.expect_owner(s, "somebody")
    with pytest.raises(ValueError, match="4 to 40"):
        brief.reply_examples(s, "x", examples=99)
    s.export(f"file://{tmp_path}/copy")
    with pytest.raises(FileExistsError):
        s.export(f"file://{tmp_path}/copy")
    assert store.Store(spark, f"file://{tmp_path}/copy").turns().count() == 3
    s.write_turns(s.turns().limit(0), ("code", "jsdoc"))
    assert s.turns().count() == 3


def test_a_build_that_ends_early_leaves_the_corpus_as_it_was(spark, tmp_path, monkeypatch):
    from quillmark.plans import brief, build

    (tmp_path / "dump.json").write_text(json.dumps(chats()))
    s, held = store.Store(spark, f"file://{tmp_path}/corpus"), config.Config(holdout_size=0)
    build.build_chat(spark, f"file://{tmp_path}/dump.json", s, held)
    before = s.snapshot()
    seen = lambda at: (sorted(r.text for r in at.turns().collect()), at.index().postings.count(), at.profile("chat", "registers").count(), at.meta())
    was = seen(s)
    with monkeypatch.context() as m:
        real = store.Store.save_profile
        m.setattr(store.Store, "save_profile", lambda *a: (real(*a), 1 / 0))
        with pytest.raises(ZeroDivisionError):
            build.build_chat(spark, f"file://{tmp_path}/dump.json", s, held)
    assert seen(s) == was and s.manifest().version == before.manifest().version
    new = spark.createDataFrame([r.asDict() | {"id": 99, "text": "Совсем новое слово."} for r in s.turns().limit(1).collect()], store.TURN)
    with pytest.raises(ZeroDivisionError), s.building():
        s.write_turns(new, ("dm",))
        assert [r.id for r in s.turns().where("register = 'dm'").collect()] == [99]  # seen inside
        1 / 0
    assert seen(s) == was
    with s.building():
        s.write_turns(s.turns().where("register = 'dm'").unionByName(new), ("dm",))
        s.rebuild_indexes()
    assert "Совсем новое слово." in seen(s)[0] and seen(before) == was and s.manifest().version == before.manifest().version + 1
    assert brief.find(s, "новое слово", 5).count() > 0
    assert len(s.prune(keep=1)) > 5 and seen(s)[1] > was[1] and s.prune(keep=1) == []
    with pytest.raises(ValueError, match="snapshot"):
        before.set_meta({"a": "b"})
    late = store.Store(spark, s.path)
    with pytest.raises(OSError, match="another build"), late.building():
        s.set_meta({"a": "b"})


def test_broken_export(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"chats": {"list": [')
    with pytest.raises(Exception):
        export.read_export(spark, f"file://{tmp_path}/bad.json").count()
    with pytest.raises(ValueError, match="don't close"):
        export.read_by_ranges(spark, f"file://{tmp_path}/bad.json")
    (tmp_path / "bad.json").write_text('{"chats": "\n}')
    with pytest.raises(Exception, match="doesn't end"):
        export.read_by_ranges(spark, f"file://{tmp_path}/bad.json")
    (tmp_path / "bad.json").write_text('{"chats": {"list": [{"id": 1, "messages": [{"id": 1 "type": 2}]}]}}')
    with pytest.raises(Exception, match="(?i)malformed"):
        export.read_by_ranges(spark, f"file://{tmp_path}/bad.json").collect()
    (tmp_path / "none.json").write_text("")
    assert export.read_by_ranges(spark, f"{tmp_path}/none.json").count() == 0


def hard_chats():
    """Sections that aren't chats, fields after messages, brackets and quotes in texts, empty lists."""
    found = chats()
    for k, c in enumerate(found["chats"]["list"]):
        for j, m in enumerate(c["messages"]):
            m["text_entities"] = [{"type": "bold", "text": f'}}]{{["\\" é\n {k} {j}'}, *m.get("text_entities", [])]
            m["reactions"] = [{"count": 1, "recent": [{"from": "x"}]}]
    last = found["chats"]["list"][-1]
    turned = {"messages": last["messages"], "pins": [{"type": "message", "id": 9}], "about": {"id": 77, "name": "no"}} | {f: last[f] for f in ("type", "name", "id")}
    found["chats"]["list"][-1] = turned
    found["chats"]["list"] += [{"id": 8, "name": None, "type": "bot_chat", "messages": []}, {"id": 9, "type": "personal_chat", "messages": found["chats"]["list"][0]["messages"]}]
    other = {"list": [{"id": 5, "name": "other", "type": "personal_chat", "messages": [{"id": 1, "type": "message"}]}]}
    return {"about": "{[", "stories": other, "personal": {"list": [[{"messages": [{"id": 2}]}]]}, **found, "sessions": other}


@pytest.mark.parametrize(("indent", "size"), [(1, 40), (1, 333), (1, 1 << 20), (None, 100), (0, 64)])
def test_an_export_by_ranges_reads_as_one_document(spark, tmp_path, indent, size):
    (tmp_path / "dump.json").write_text(json.dumps(hard_chats(), ensure_ascii=False, indent=indent))
    path = f"file://{tmp_path}/dump.json"
    want = export.messages(export.read_export(spark, path))
    got = export.shaped(export.read_by_ranges(spark, path, size))
    rows = lambda df: sorted(map(str, df.select(want.columns).collect()))
    assert rows(got) == rows(want) and len(rows(got)) == 14


def test_one_chat_is_read_by_many_tasks(spark, tmp_path):
    said = [{"id": k, "type": "message", "text_entities": [{"type": "plain", "text": f"n {k}"}]} for k in range(400)]
    (tmp_path / "one.json").write_text(json.dumps({"chats": {"list": [{"id": 1, "name": "a", "type": "personal_chat", "messages": said}]}}, indent=1))
    rows = ranges.read_messages(spark, f"{tmp_path}/one.json", 4096)
    assert sorted((r.pos, json.loads(r.raw)["id"], r.chat_no) for r in rows.collect()) == [(k, k, 0) for k in range(400)]
    path = f"{tmp_path}/one.json"
    span = ranges.Span(path, ranges.stamped(path), 4096, 4096)
    assert 4096 <= span.start < 4200 and 8192 <= span.end < 8300


def test_blame():
    porcelain = f"{'a' * 40} 1 3 1\nauthor X\nauthor-mail <Me@X.Y>\nauthor-time 1700000000\n\tcode\n"
    assert repositories.parse_blame(porcelain) == [(3, "me@x.y", 2023)]
    assert repositories.is_repository("/proc") is False


def test_cache(spark):
    files = spark.createDataFrame([("r", "a", "1"), ("r", "b", "2")], "repo string, path string, blob string")
    cache = spark.createDataFrame([("r", "a", "1", "x"), ("r", "b", "0", "y")], "repo string, path string, blob string, data string")
    assert [r.path for r in store.missing(files, cache).collect()] == ["b"]
    new = spark.createDataFrame([("r", "b", "2", "z")], cache.schema)
    assert {r.data for r in store.refreshed(cache, files, new).collect()} == {"x", "z"}


def test_streaming(spark, tmp_path):
    from quillmark.streaming import bursts

    at = datetime.datetime(2024, 1, 1)
    rows = [("c", "me", "one", at + datetime.timedelta(seconds=s)) for s in (0, 90, 181, 400)]
    src = f"file://{tmp_path}/in"
    df = spark.createDataFrame(rows, "chat_key string, from_id string, text string, event_time timestamp")
    df.write.parquet(src)
    batch = bursts.burst_sessions(df).orderBy("start").collect()
    assert [(r.n_parts, r.chars) for r in batch] == [(2, 6), (1, 3), (1, 3)]  # a gap of the window's length goes on
    stream = spark.readStream.schema(df.schema).parquet(src)
    q = bursts.burst_sessions(stream, late="0 seconds").writeStream.format("memory").queryName("bursts_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("bursts_out").orderBy("start").collect() == batch[:2]  # the last may still grow
    bursts.ingest(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/ck").awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 4


@pytest.fixture
def rocksdb(spark):
    from quillmark.streaming import bursts

    spark.conf.set(bursts.PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(bursts.PROVIDER)


MESSAGES = "chat_key string, pos int, id long, from_id string, ts long, text string, clean string, is_forwarded boolean, is_via_bot boolean, n_links int, reply_to long, register string"


def streamed_turns(spark, folder, files, held, name, late="10 seconds"):
    """Turns of a stream that reads one file a batch, in the order given."""
    from quillmark.streaming import bursts

    for n, rows in enumerate(files):
        path = f"{folder}/in/{n}.json"
        spark.createDataFrame(rows, MESSAGES).coalesce(1).write.mode("overwrite").json(f"file://{path}.d")
    stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(f"file://{folder}/in")
    q = bursts.turn_stream(turns.judged(stream, F.lit("me")), held, late).writeStream.format("memory").queryName(name).option("checkpointLocation", f"file://{folder}/ck").outputMode("append").trigger(availableNow=True).start()
    q.processAllAvailable()
    q.awaitTermination(120)
    return {(r.chat_key, r.pos, r.ts, r.reply_to, r.register, tuple(r.parts)) for r in spark.table(name).collect()}


def said(chat, pos, ts, who="me", text=None, bot=False, reply_to=None):
    text = f"word{pos}" if text is None else text
    return (chat, pos, pos + 1, who, ts, text, text, False, bot, 0, reply_to, "dm")


def test_streamed_turns_are_those_of_the_batch(rocksdb, tmp_path):
    spark, rng, rows = rocksdb, random.Random(9), []
    for chat in range(5):
        ts = 1_700_000_000
        for pos in range(60):
            ts += rng.choice([0, 5, 30, 90, 91, 200])
            rows.append(said(f"c{chat}", pos, ts, rng.choice(["me", "me", "me", "you"]), "" if rng.random() < 0.1 else None, rng.random() < 0.1, rng.choice([None, 3])))
    rows.sort(key=lambda r: r[4])
    held = config.Config(max_parts=3)
    batch = turns.bursts(turns.judged(spark.createDataFrame(rows, MESSAGES), F.lit("me")), held)
    want = {(r.chat_key, r.pos, r.ts, r.reply_to, r.register, tuple(r.parts)) for r in batch.collect()}
    files = [rows[:110], rows[110:200], rows[200:], [said("end", 0, rows[-1][4] + 100_000, "you")]]
    for f in files[:3]:
        rng.shuffle(f)
    assert streamed_turns(spark, tmp_path, files, held, "turns_ordered") == want and len(want) > 60


def test_streamed_turns_wait_for_late_messages_and_drop_later_ones(rocksdb, tmp_path):
    t = 1_700_000_000
    # a batch drops what is behind the watermark that the batch before it had reached
    files = [[said("c", 0, t), said("c", 2, t + 20)], [said("c", 1, t + 15)], [said("x", 0, t + 5000, "you")], [said("x", 1, t + 5001, "you")], [said("c", 3, t + 30)], [said("x", 2, t + 9000, "you")]]
    got = streamed_turns(rocksdb, tmp_path, files, config.Config(), "turns_late")
    assert got == {("c", 0, t, None, "dm", ("word0", "word1", "word2"))}  # word3 comes when its time is long over


def test_streamed_turns_need_the_store_they_name(spark):
    from quillmark.streaming import bursts

    with pytest.raises(ValueError, match="RocksDB"):
        bursts.turn_stream(turns.judged(spark.createDataFrame([], MESSAGES), F.lit("me")))


def test_an_export_keeps_every_profile_table(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/own")
    tables = {name: spark.createDataFrame([(name,)], "label string") for name in ("sizes", "connectives", "repositories", "totals")}
    s.save_profile("code", tables)
    s.export(f"file://{tmp_path}/copy")
    copied = store.Store(spark, f"file://{tmp_path}/copy")
    assert {name: copied.profile("code", name).first().label for name in tables} == {name: name for name in tables}


def test_one_repository_is_read_by_many_tasks_at_one_revision(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Me", "-c", "user.email=me@x.y", *a], check=True, capture_output=True)
    run("init")
    for k in range(24):
        (tmp_path / f"f {k}.py").write_text(f"# {k}\n" * (k + 1))
    run("add", ".")
    run("commit", "-m", "first")
    files = repositories.candidates(spark, {"r": str(tmp_path)}, ["me@x.y"]).persist()
    assert files.count() == 24 and repositories.candidates(spark, {"r": str(tmp_path)}, ["you@x.y"]).count() == 0
    (tmp_path / "f 0.py").write_text("edited\n\n\n")
    run("commit", "-am", "second")
    (tmp_path / "f 1.py").write_text("not committed\n")
    lines = repositories.read_blame(files, 8).withColumn("task", F.spark_partition_id())
    rows = lines.collect()
    assert sorted((r.path, r.line_no, r.email) for r in rows) == sorted((f"f {k}.py", n + 1, "me@x.y") for k in range(24) for n in range(k + 1))
    assert len({r.task for r in rows}) > 4 and files.select(F.spark_partition_id()).distinct().count() == 1
    assert {r.path: r.source for r in repositories.read_files(files).collect()} == {f"f {k}.py": f"# {k}\n" * (k + 1) for k in range(24)}


def test_code_build_blames_what_is_new(spark, tmp_path):
    import subprocess

    from quillmark.plans import brief, build, report

    root = tmp_path / "repo"
    root.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=Me", "-c", "user.email=me@x.y", *a], check=True, capture_output=True)
    run("init")
    (root / "a.py").write_text("# Keeps the order, because later steps rely on it.\nx = 1\n")
    (root / "b.py").write_text("# TODO drop this branch when the old format is gone.\ny = 2\n")
    run("add", ".")
    run("commit", "-m", "first")
    s = store.Store(spark, f"file://{tmp_path}/corpus")
    nothing = spark.createDataFrame([(0, "dm", "Да."), (1, "code", "x")], "id int, register string, text string")
    assert [(r.score, r.verdict) for r in brief.check(s, nothing).collect()] == [(0, "nothing to check")] * 2 and s.merged_profile() is None
    config_ = config.Config(code_emails=("me@x.y",))
    (tmp_path / "dump.json").write_text(json.dumps(chats()))
    build.build_chat(spark, f"file://{tmp_path}/dump.json", s, config.Config(holdout_size=0, chat_stop_list=("spam",)), datetime.datetime(2026, 1, 1, tzinfo=datetime.UTC))
    assert build.build_code(spark, {"r": str(root)}, s, config_) == 2
    assert s.meta()["report.files_blamed"] == "2" and sorted(r.id for r in s.turns().select("id").collect()) == [1, 2, 3, 4, 5]
    (root / "b.py").write_text("# TODO drop this branch when the old format is gone.\ny = 3\n")
    run("commit", "-am", "second")
    assert build.build_code(spark, {"r": str(root)}, s, config_) == 2
    assert (s.meta()["report.files"], s.meta()["report.files_blamed"]) == ("2", "1")
    assert {(r.path, r.line_no, r.email) for r in s.blame().collect()} == {(p, n, "me@x.y") for p in ("a.py", "b.py") for n in (1, 2)}
    merged = s.merged_profile()
    assert merged.built_at.startswith("2026-01-01") and merged.recent_from == 2025
    assert {"registers", "typography", "code_sizes", "code_typography", "code_markers"} <= set(merged.tables)
    texts = spark.createDataFrame([(0, "code", "FIXME 👍", ""), (1, "dm", "Да.", None)], "id int, register string, text string, code string")
    got = {r.id: r for r in brief.check(s, texts).collect()}
    assert {f.rule[:2] for f in got[0].findings} == {"K4", "K7"} and got[1].messages == 1
    shown = report.render_profile(s, "code", full=True)
    assert "because: 1" in shown and "own: TODO (1)" in shown and "## Repositories" in shown
    assert "## Bursts" in report.render_profile(s, "dm") and "empty" in report.render_profile(s, "group")
    assert "files known: 1" in report.render_code_report(s) and "turns: 3" in report.render_report(s)
    s.export(f"file://{tmp_path}/copy")
    assert store.Store(spark, f"file://{tmp_path}/copy").blame().count() == 0


def test_reply_notes(spark):
    from quillmark.plans import brief

    Quality = namedtuple("Quality", "pairs few_pairs short none_quoted")
    names = lambda q: [c.name for c in brief.reply_constraints(q, 4)][:-2]
    assert names(None) == names(Quality(0, True, False, False)) == ["examples_by_topic_only"]
    assert names(Quality(2, False, True, True)) == ["pairs_found", "pairs_by_order_only"] and names(Quality(4, False, False, False)) == []
