"""The operators: SQL where there is some, else brute force, round trips and held-out accuracy; then odd inputs."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import chat, langid, lm_order, lm_score, mixing, ngram_join, packing, pii, quality, queries, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SQL = queries.oracle_sql()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "a text without an id", "en", "a"), (3, "same words here again", "en", "a"), (3, "same words here again", "en", "a"), (4, "same words here again", "en", "b"), (5, "word " * 50_000, "en", "b"), (6, "x" * 100_000, None, "b"), (7, "\n\t ", "fr", None), (8, "Mail a.b@c.de \U0001f600 or call +49 170 1234567", "en", "a")]
    d = docs(spark, rows)
    for c in ("score", "n", "sid", "token", "row", "bucket", "size", "start", "kept", "block", "times", "comp", "_spans", "_lists", "_i", "spans", "k", "dropped", "part", "n_"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).withColumn("n", F.lit(1))


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, spark, duck, same):
    assert same(queries.queries()[name](spark, SF), SQL[name], duck) > 0


def test_packing(spark, given, odd, none):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(queries.tokenizer_path())
    for d in (given, odd):
        rows = packing.pack(d, queries.tokenizer_path()).collect()
        by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
            assert len(r.ids) == 4 * r.length
        texts = collections.defaultdict(list)
        for r in d.select("doc_id", "text").collect():
            texts[r.doc_id].append(encoder.encode(r.text or "", add_special_tokens=False).ids + [1])
        assert set(by_doc) == set(texts)
        for i, wanted in texts.items():
            got = collections.Counter(int(x) for p in by_doc[i] for x in np.frombuffer(p.ids, "<u4"))
            assert got == collections.Counter(x for ids in wanted for x in ids)
            if len(wanted) == 1:
                whole = b"".join(p.ids for p in sorted(by_doc[i], key=lambda p: p.start))
                assert np.frombuffer(whole, "<u4").tolist() == wanted[0] and {p.doc_tokens for p in by_doc[i]} == {len(wanted[0])}
        for parts in by_seq.values():
            at = 0
            for p in sorted(parts, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 2048
        assert len(by_seq) * 2048 < 1.1 * sum(r.length for r in rows) + 8 * 2048
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_balance_takes_the_cheapest_that_fits():
    placed, cost = packing.balance(np.array([5, 4, 3, 3, 1]), 8, 1.0, 1.0)
    assert sum(p[2] for p in placed) == 16 and len(cost) == 2
    assert sorted(p[3] for p in placed if p[0] in (0, 1)) == [0, 1]


def test_toxicity(spark, given, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = toxicity.train(big, labels)
    got = {r.doc_id: r for r in toxicity.score(big, model).collect()}
    pairs = [(got[r.doc_id].score, r.toxic) for r in labels.dropDuplicates(["doc_id"]).collect() if r.doc_id in got and held(r.doc_id, 3) == 1 and r.toxic is not None]
    hit = sum(1 for s, y in pairs if y == 1 and s >= 0.7)
    wrong = sum(1 for s, y in pairs if y == 0 and s >= 0.7)
    assert hit >= 0.75 * sum(y for _, y in pairs) and wrong <= 0.02 * len(pairs) + 1
    assert toxicity.score(odd, model).count() == 10 and toxicity.score(none, model).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    untrained = toxicity.train(none, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(odd, untrained).collect())


def test_restoration():
    counts = collections.Counter()
    for w in ["stupid", "idiot", "people", "little", "the", "loose"] * 50:
        s = [0, 0, 0, *map(toxicity.symbol, w), 0]
        for k in range(len(s) - 3):
            counts[((s[k] * 28 + s[k + 1]) * 28 + s[k + 2]) * 28 + s[k + 3]] += 1
    r = toxicity.Restorer(toxicity.log_lm(counts))
    assert r.text("you 1d10t") == "you idiot" and "stupid" in r.words("s t u p i d") and "stupid" in r.words("st.u.p1d!!") and r.word("idiooooot") == ("idiot",)
    assert r.word("people") == ("people",) and r.word("2024") == ()


def test_quality_order_never_changes_results(spark, given, odd, none):
    want = {tuple(r) for r in quality.cascade(given).collect()}
    assert want == {tuple(r) for r in quality.cascade(given, tuple(reversed(quality.RULES))).collect()}
    r = {x.doc_id: x for x in quality.cascade(odd).collect()}
    assert r[5].n_words == 50_000 and r[5].n_repeat_words == 50_000 and not r[5].kept and r[1].n_words == 0 and r[6].word_chars == 100_000
    assert quality.cascade(odd).count() == 10 and quality.cascade(none).count() == 0
    assert quality.keep(odd).columns == odd.columns and quality.keep(none).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "other"), (4, 0, "user", "other"), (5, None, "user", "x"), (None, 0, "user", "x"), (6, 0, None, None)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("h1", F.lit("clash"))
    got = {r.conv_id: r for r in chat.rendered(c).collect()}
    assert set(got) == {1, 4, 6} and got[1].n_copies == 2 and got[4].n_turns == 1
    assert got[1].text == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"
    assert chat.rendered(c.limit(0)).count() == 0
    long = spark.createDataFrame([(1, k, "user", str(k)) for k in range(1200)], "conv_id long, turn long, role string, text string")
    assert "".join(r.text for r in sorted(chat.rendered(long).collect(), key=lambda r: r.segment)).count("<|end|>") == 1200


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(700)] + [(700, None), (701, [1.0, float("nan")] * 4), (702, [None] * 8), (800, [0.5] * 3), (900, rng.normal(size=8).tolist()), (900, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit("clash"))
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=128, block=3, leaf=8).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q, v in ok:
        if q % 100 == 0 and (q != 900 or v == min(w for i, w in ok if i == 900)):
            best = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v)))[:10]
            assert [(k + 1, i, -s) for k, (s, i) in enumerate(best)] == sorted(got[q])
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_rounds_share_the_kth_score(spark, monkeypatch):
    assert topk.rounds(0) == [] and topk.rounds(1) == [(0, 1)] and topk.rounds(7) == [(0, 1), (1, 5), (5, 7)] and topk.rounds(50)[-1] == (21, 50)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(1200)], "vec_id long, embedding array<double>")
    passed, plain = [], topk._round
    monkeypatch.setattr(topk, "_round", lambda shards, q, floors, *more: (passed.append(dict(floors.value)), plain(shards, q, floors, *more))[1])
    best = {(r.query_id, r["rank"]): r.score for r in topk.top_k(df, F.col("vec_id") < 6, 5, shard_rows=100, leaf=16).collect()}
    assert [len(f) for f in passed] == [0, 6, 6]  # 12 shards: 1, 4, 7
    for q in range(6):
        assert passed[1][q] <= passed[2][q] <= best[q, 5]
    assert any(passed[1][q] < passed[2][q] for q in range(6))


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=3) * 2.0**19).tolist()) for i in range(300)] + [(1000, [-3e6, 0.0, 0.0])]
    ask = lambda more: topk.top_k(spark.createDataFrame(rows + more, "vec_id long, embedding array<double>"), F.col("vec_id") < 5, 3, shard_rows=64, leaf=8).collect()
    own = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    best = {q: sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in own if i != q)[:3] for q, v in own[:5]}
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ask([])) == [(q, k + 1, i, -s) for q in range(5) for k, (s, i) in enumerate(best[q])]
    with pytest.raises(Exception, match="doesn't fit 64 bits"):
        ask([(2, [3e6, 0.0, 0.0]), (1001, [1e7, 1e7, 1e7]), (1002, [-1e7, -1e7, -1e7])])


def test_mixing(spark, given, odd, none):
    for d in (given, odd):
        rows = mixing.taken(mixing.mix(d)).collect()
        assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((r.doc_id or -1, len(WORD.findall(r.text or ""))) for r in d.collect())
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
        again = mixing.taken(mixing.mix(d.repartition(5))).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    m = mixing.mix(given)
    per = {r.source_size: r for r in mixing.taken(m).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
    for r in per.values():
        assert abs(r.taken - r.target) <= max(256, 0.05 * r.target) * 4
    assert mixing.targets([("a", 10), ("b", 100), (None, 40)]) == {"a": 25.0, "b": 50.0, None: 75.0} and mixing.targets([("a", 1), ("b", 99)]) == {"a": 3.0, "b": 97.0}
    assert mixing.taken(mixing.mix(none)).count() == 0 and mixing.mixed_documents(none).count() == 0
    n = np.arange(1000)
    import pandas as pd

    p = mixing.permutation(pd.Series(n), pd.Series([1000] * 1000), pd.Series([7] * 1000))
    assert sorted(p) == n.tolist() and p.tolist() != n.tolist()


def test_mixed_documents_hold_what_is_taken(given):
    want = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(given)).collect()}
    got = collections.Counter()
    for r in mixing.mixed_documents(given).collect():
        got[r.doc_id] += len(WORD.findall(r.text))
    assert {i: n for i, n in want.items() if n} == dict(got)


def sets_of(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()


def test_join_odd(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd).collect()}
    assert {(3, 1, 3), (4, 1, 3), (1, 0, 1), (2, 0, 2), (5, 1, 5), (None, 1, None)} <= got
    assert ngram_join.jaccard_components(odd).count() == 10 and ngram_join.jaccard_components(none).count() == 0
    assert ngram_join.deduplicated(odd).columns == odd.columns


def test_join_brute_force(spark):
    rng = np.random.default_rng(5)
    base, rows = [f"w{k}" for k in range(4000)], []
    for g in range(12):
        start = [base[k] for k in rng.integers(0, 4000, int(rng.integers(8, 300)))]
        for _ in range(int(rng.integers(1, 9))):
            t = list(start)
            for _ in range(int(rng.integers(0, max(2, len(t) // 30)))):
                t[int(rng.integers(0, len(t)))] = base[int(rng.integers(0, 4000))]
            rows.append((len(rows), " ".join(t), "en", "a"))
    s = [sets_of(r[1]) for r in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == {i: (len(s[i]), comp[i]) for i in range(len(rows))}


@pytest.mark.parametrize("wide", [1000, 3])
def test_join_has_every_link(spark, wide):
    rng, rows = np.random.default_rng(9), []
    for g in range(3):
        start = [f"w{k}" for k in rng.integers(0, 4000, 150)]
        for _ in range(8):
            t = list(start)
            t[int(rng.integers(0, len(t)))] = f"v{len(rows)}"
            rows.append((len(rows), " ".join(t), "en", "a"))
    rows += [(len(rows), rows[0][1], "en", "a"), (None, rows[0][1], "en", "a"), (90, "", "en", "a")]
    s = {i: sets_of(t) for i, t, *_ in rows if i is not None and t}
    near = {(i, j) for i in s for j in s if i != j and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])}
    got = ngram_join.links(docs(spark, rows), wide)
    own = {r.doc_id: r for r in got.members.collect()}
    assert {i: r.n_links for i, r in own.items()} == {i: sum(1 for a, _ in near if a == i) for i in s}
    assert {(r.a, r.b) for r in got.links.collect()} == {tuple(sorted((own[i].sid, own[j].sid))) for i, j in near if own[i].sid != own[j].sid}


def test_words_hash_alike_wherever_they_stand():
    a, b = ngram_join.word_hashes("One two\tthree"), ngram_join.word_hashes("three  x ONE\n")
    assert a[0] == b[2] and a[2] == b[0] and len({*a, *b}) == 4 and len(ngram_join.word_hashes(" \n")) == 0
    assert len(ngram_join.word_hashes("y" * 70_000 + " z")) == 2


def test_levels_and_flags_reach_the_driver_in_few_jobs(spark):
    """Their jobs don't grow with the number of shuffle partitions, and they hold every shingle and id."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 48)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("few-jobs", "")
    try:
        common = "a line that all of these texts hold"
        levels = ngram_join.frequency_levels(ngram_join.sets(docs(spark, [(k, f"{common} text{k}", None, None) for k in range(40)])))
        at = (ngram_join.shingles(common) >> np.uint64(64 - ngram_join.CELL_BITS)).astype(np.int64)
        assert (levels[at] > 0).all() and np.count_nonzero(levels) <= 40 + len(at)
        ids = spark.range(0, 300_000, 3).withColumnRenamed("id", "doc_id")
        flags = ngram_join.key_filter(ids, 100_000)
        place = np.array([r.x for r in ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(flags))).alias("x")).collect()])
        assert (flags[place >> 3] >> (place & 7) & 1).all() and int(np.bitwise_count(flags).sum()) == len(np.unique(place))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)


def test_words_that_start_alike_are_spelled_once():
    """Each distinct start of a class stands once, as its bytes stand alone, and those asked for come first."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice(list(b"abc\xc3\xa9"), int(rng.integers(0, 9)))) for _ in range(2000)] + [b"x" * 70_000, b"x" * 69_999, b""]
    kinds = rng.integers(0, 3, len(words)).tolist()
    s, alone = lm_score.starts_of(words, kinds, asked=50), lm_score.bits_of(words, kinds)
    o = np.argsort(s.owner, kind="stable")
    assert (s.owner[o] == alone.owner).all() and (s.bits.byte[s.start[o]] == alone.byte).all() and (s.bits.deep[s.start[o]] == alone.deep).all()
    assert all((x[s.start[o]] == y).all() for x, y in zip(s.bits.keys, alone.keys))
    told = {(k, w[:i]) for w, k in zip([w + b" " for w in words[:2000]], kinds) for i in range(1, len(w) + 1)}
    few = lm_score.starts_of(words[:2000], kinds[:2000])
    assert len(few.bits.byte) == len(told) < len(few.start) / 2
    first = np.unique(s.start[s.owner < 50])
    assert (first == np.arange(len(first))).all()


def test_words_are_read_by_arrow_as_by_python():
    """Blanks at edges, other scripts and null: the words that bytes.split gives, in whatever groups texts are taken."""
    given = [" The\tthe\x0b ", None, "", "\n", "É É\xa0x\x1cy\u2003Z\x85z a", "b " * 30_000, "b c"]
    r = lm_order.read_texts(pa.array(given), b"")
    want = [[*(t or "").encode().lower().split(), b""] for t in given]
    assert [[r.words[w] for w in r.token[r.text == k]] for k in range(len(given))] == want and r.column.to_pylist() == r.words
    groups = list(lm_order.together(r))
    assert [[r.words[w] for w in g.token[g.text == k]] for g in groups for k in range(g.text[-1] + 1)] == want and len(groups) == 3


def test_common_words_are_spelled_for_classes_that_hold_them(spark, given):
    """Not for every class: what a class's training texts don't hold comes by the join, with the same result."""
    t = lm_score.train(lm_score.train_fold(given))
    common, held = lm_score.common_words(t, 1 << 18, 64), {(bytes(r.word), r["class"]) for r in t.by_class.collect()}
    assert {(w, k) for w, i in common.place.items() for k in np.flatnonzero(~np.isnan(common.log_p[i])).tolist()} == held
    assert np.isnan(common.log_p).any()


def test_lm_base_and_bits(spark, given, odd, none):
    d = given.unionByName(docs(spark, [(10_000, None, None, None), (10_001, "", None, None)]))
    t = lm_score.train(lm_score.train_fold(d))
    rows = {r.doc_id: r for r in lm_score.score(d, t, frequent=500).collect()}
    every = {r.doc_id: [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(r.text or "")] + [""] for r in d.collect()}
    c = collections.Counter(w for i, ws in every.items() if held(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    assert t.train_tokens == n
    for i, ws in every.items():
        assert rows[i].n_tokens == len(ws) and rows[i].n_known == sum(1 for w in ws if c[w])
        assert rows[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), abs=1e-6)
        assert rows[i].score < 0 and rows[i].bits_per_byte > 0
    same = {r.doc_id: r.score for r in lm_score.score(d, t).collect()}
    assert all(same[i] == pytest.approx(rows[i].score, rel=1e-6) for i in rows)
    assert lm_score.score(odd, t).count() == 10 and lm_score.score(none, t).count() == 0
    empty = lm_score.train(none)
    assert empty.train_tokens == 0 and lm_score.score(odd, empty).count() == 10


def test_word_probabilities_sum_to_at_most_one():
    m = lm_score.start_model(12)
    s = lm_score.Speaker(m, np.zeros((2, len(lm_score.ORDERS) << 12), dtype=np.float32))
    words = [bytes([a]) for a in range(33, 127)]
    assert (10 ** s.log10_words(words, [0] * len(words))).sum() <= 1


def test_lm_contexts_grow_with_the_words(spark):
    rng = np.random.default_rng(3)
    word = lambda letters: bytes(rng.choice(np.frombuffer(letters, np.uint8), 9))
    words, bits = sorted({word(b"abcdefghijklm") for _ in range(4000)}), []
    for some in (words[:100], words):
        rows = lm_score.gathered(spark.createDataFrame([(bytearray(w), 0, 2) for w in some], "word binary, class int, n long"), 3, "words", ["word", "class", "n"])
        table_bits, table = lm_score.sized(lm_score.context_counts(rows))
        bits.append(table_bits)
    assert sum(1 << b for b in bits[1]) > 4 * sum(1 << b for b in bits[0])
    known = lm_score.opened(table)
    level = lambda asked, met, i: [x[i] & 15 for x, _ in lm_score.steps_with(known, table_bits, lm_score.bits_of(asked + met, [0] * len(asked + met)), np.repeat([0.0] * len(asked) + [2.0] * len(met), 10), False)]
    # what was never met is unseen, however many contexts the table holds: here words of other letters, behind their first byte
    others = [word(b"nopqrstuvwxyz") for _ in range(500)]
    for i in range(len(lm_score.ORDERS)):
        assert all((x[:5000].reshape(500, 10)[:, 1:] == 0).all() for x in level(others, words, i))
    # the word so far is counted exactly: how many words start alike
    got = level([], words, 4)[0].reshape(-1, 10)
    for k in (5, 8):
        alike = collections.Counter(w[:k] for w in words)
        assert got[:, k].tolist() == [min(lm_score.LEVELS - 1, int(math.log2(2 * alike[w[:k]] + 1))) for w in words]


def test_pii(spark, odd, none):
    key = b"k"
    text = "Mary Jones wrote a.b@c.de, then A.B@c.de; call +49 170 1234567 or +49-170-1234567; card 4111 1111 1111 1111; ip 10.0.0.1; password=hunter2xyz"
    new, found = pii.replace(text, key)
    got = {(k, v): s for k, v, s in found}
    assert not any(v in new for _, v in got)
    emails = [s for (k, _), s in got.items() if k == "email"]
    assert len({e.lower() for e in emails}) == 1 and all(e.endswith(".de") for e in emails)
    assert len({re.sub(r"\D", "", s) for (k, _), s in got.items() if k == "phone"}) == 1
    card = next(s for (k, _), s in got.items() if k == "card")
    assert pii.luhn(card.replace(" ", "")) and [len(x) for x in card.split(" ")] == [4, 4, 4, 4]
    name = next(s for (k, _), s in got.items() if k == "name")
    assert pii.GIVEN[name.split()[0].casefold()] == ("latin", "f")
    assert pii.replace(text, key) == (new, found) and pii.replace(text, b"other")[0] != new
    out = pii.pseudonymized(odd, key)
    assert out.columns == odd.columns and out.count() == 10 and pii.pseudonymized(none, key).count() == 0
    assert "a.b@c.de" not in out.where("doc_id = 8").first().text
    clean = docs(spark, [(1, "Nothing private in 3 short words of 2024.", "en", "a")])
    assert pii.pseudonymized(clean, key).first().text == "Nothing private in 3 short words of 2024."
    given = spark.read.parquet(f"{SF}/documents.parquet")
    assert pii.collisions(pii.entities(given, key)).count() == 0


def test_surrogates_are_one_to_one():
    values = [f"{k:09d}" for k in range(3000)]
    assert len({pii.shaped(b"k", "phone", v) for v in values}) == 3000


def test_language(spark, odd, none):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(big)
    rows = langid.predict(big, model).join(big.select("doc_id", "lang", "text"), "doc_id").where(F.length("text") > 100).collect()
    test = [r for r in rows if held(r.doc_id, 3) == 1 and r.lang]
    assert sum(r.lang == r.lang_pred for r in test) >= 0.95 * len(test) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and got[1].score == 0.0
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.train(none)).collect()} == {"und"}


def test_pipeline(spark, given):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "pii", "mixing", "packing"]
    at, steps = given, []
    for _, f in corpus_pipeline.STAGES:
        at = f(spark, at, SF)
        steps.append(at)
    kept = {r.doc_id for r in quality.cascade(given).where("kept").collect()}
    assert {r.doc_id for r in steps[0].collect()} == kept
    comp = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(steps[0]).collect()}
    assert {r.doc_id for r in steps[1].collect()} == {i for i, c in comp.items() if i == c}
    assert all(s.columns == given.columns for s in steps[:4])
    words = sum(len(WORD.findall(r.text)) for r in steps[3].collect())
    assert steps[4].agg(F.sum("length")).first()[0] >= words
    assert corpus_pipeline.run(spark, SF).count() == steps[4].count()


def test_mixed_and_deduplicated_rows_keep_columns_of_any_name(odd):
    got = mixing.mixed_documents(odd)
    assert got.columns == odd.columns
    want = {r.doc_id: r.taken for r in mixing.taken(mixing.mix(odd)).where("taken > 0").groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    words = collections.Counter()
    for r in got.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r["_spans"] == r["dropped"] == r["k"] == "clash" and r.n_chars == len(r.text)
    assert dict(words) == want
    assert ngram_join.deduplicated(odd).columns == odd.columns


def test_cut_keeps_line_breaks():
    text = " one two\nthree\tfour\n\nfive  "
    assert mixing.cut(text, [(0, 2), (2, 2)]) == "one two\nthree\tfour\n\n" and mixing.cut(text, [(1, 1), (4, 1)]) == "two\nfive  "


def test_pipeline_on_odd_and_no_rows(spark, odd, none):
    for d, least in ((odd, 1), (none, 0)):
        at = d
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
        assert at.count() >= 0 and (d is odd or at.count() == 0)


def test_names_outside_lists_and_parts_of_names():
    new, found = pii.replace("Zorblat Quux said: MARY JONES and Priya Sharma came. Dear Noah, call 5551234567 or phone 555-0199. Later Jones left; Mary's car. The United Nations said no.", b"k")
    for v in ("Zorblat", "Quux", "MARY", "JONES", "Jones", "Priya", "Sharma", "Noah", "5551234567", "555-0199", "Mary"):
        assert v not in new
    assert "The United Nations said no." in new
    by = {(k, v): s for k, v, s in found}
    assert by["name", "MARY JONES"].split()[1].casefold() == by["surname", "Jones"].casefold()
    assert by["name", "MARY JONES"].split()[0].casefold() == by["name", "Mary"].casefold()


def test_a_persons_surrogate_is_the_same_beside_any_other():
    names = ["Mary", "Anna", "Emma", "Laura", "Sarah", "Julia"]
    alone = {n: pii.replace(f"Here is {n}.", b"k")[1][0][2] for n in names}
    _, found = pii.replace("Here are " + ", ".join(names) + ".", b"k")
    assert {v: s for _, v, s in found} == alone and len(set(alone.values())) == len(names) and not any("[" in s for s in alone.values())
    for v, end in (("Иванова", "ова"), ("Петров", "ов"), ("Достоевский", "ский")):
        s = pii.surname(b"k", v)
        assert s.endswith(end) and s != v and len(s) == len(v)


def test_reading_order_brute_force():
    rng = np.random.default_rng(4)
    split = [[b"w%d" % k for k in rng.integers(0, 6, n)] for n in (40, 0, 25, 300)]
    model = lm_order.start(12)
    for _ in range(3):
        lm_order.learned(model, lm_order.questions(lm_order.read(split, b""), 12), np.full(lm_order.GATES * (lm_order.PREDICTORS + 1), 50.0))
    r = lm_order.read(split, b"")
    h, q = lm_order.heard(model, r), lm_order.questions(r, 12)
    p = dict(zip(zip(q.token.tolist(), (q.gate // 4).tolist()), lm_order.probabilities(model, q).tolist()))
    at, asked = 0, 0
    for words in split:
        last: dict = {}
        before = [None, None]
        for w in [*words, b""]:
            want, named = 0.0, False
            two, one = last.get(tuple(before)), last.get(before[1])
            if two is not None:
                asked, named = asked + 1, two == w
                want += math.log10(p[at, 0] if named else 1 - p[at, 0])
            if not named and one is not None and one != two:
                asked, named = asked + 1, one == w
                want += math.log10(p[at, 1] if named else 1 - p[at, 1])
            assert h.named[at] == named and h.log10[at] == pytest.approx(want)
            last[tuple(before)] = last[before[1]] = w
            before, at = [before[1], w], at + 1
    assert at == len(r.token) and asked == len(q.bit) > 300


def test_lm_hears_the_order_of_words(spark, given):
    t = lm_score.train(lm_score.train_fold(given))
    phrase = "the road goes ever on and on down from the door".split()
    again, mixed = " ".join(phrase * 6), " ".join(np.random.default_rng(1).permutation(phrase * 6))
    got = {r.doc_id: r.score for r in lm_score.score(docs(spark, [(1, again, "en", "a"), (2, mixed, "en", "a")]), t).collect()}
    assert got[1] > got[2] + 5


def test_code_of_bytes():
    code = lm_score.code_of(np.bincount(np.frombuffer(b"aaaaaaabbbc" * 1000, np.uint8), minlength=256))
    assert code.size[97] == 1 and code.size[98] == 2 and sum(2.0**-n for n in code.size) == 1
    said = {tuple(code.bit[b, : code.size[b]].tolist()) for b in range(256)}
    assert len(said) == 256 and (lm_score.EVEN.size == 8).all()


def test_samples_are_bounded_whatever_repeats(spark):
    from quillmark.llm.common import bounded_sample

    d = spark.range(5000).selectExpr("id % 3000 as id").union(spark.range(4000).selectExpr("7L as id"))
    n = bounded_sample(d, "id", 1000).count()
    assert 500 < n <= 1000 and bounded_sample(d, "id", 10_000).count() == 9000
