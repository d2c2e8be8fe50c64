"""Token alignment, centroid clustering and exact deduplication: SQL is tested with the others; here brute force and odd rows."""

import collections
import hashlib
import math
import random

import public_tokenizers
import pytest
from conftest import SF
from pyspark.sql import functions as F

from quillmark.llm import centroids, exact_dedup, queries, token_align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = ("n", "h", "sha", "row", "part", "norm", "block", "pairs", "times", "v", "cluster", "kept", "first", "group_size")


def clashing(df):
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASH if c not in df.columns])


# Exact deduplication.

TEXTS = [(1, "a b"), (2, "a  b"), (3, "ab"), (4, None), (5, ""), (6, " \n\t"), (None, "a  b"), (7, "x" * 100_000), (8, "x " * 100_000), (9, "a b"), (9, "a b"), (10, "é\xa0é"), (11, "éé"), (12, "A b")]


def expected_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\f\r")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for norm, members in groups.items():
        first = min(members, key=lambda m: m[:3])
        waiting = True
        for m in members:
            kept = waiting and m == first
            waiting = waiting and not kept
            out.append((m[3], first[3], len(members), kept, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def weak(text):
    """Three hashes for all texts, so that most meet others under theirs."""
    return (F.length(text) % 3).cast("string").cast("binary")


@pytest.mark.parametrize("hashed", [exact_dedup.content_hash, weak])
def test_exact_duplicates(spark, hashed):
    rng = random.Random(5)
    rows = TEXTS + [(100 + k, rng.choice(["hot text", "hot  text", "hottext"])) for k in range(500)] + [(1000 + k, f"own {k}") for k in range(50)]
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(5)
    got = exact_dedup.exact_duplicates(d, hashed)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected_groups(rows)


def test_deduplicated_keeps_rows_whole(spark):
    d = clashing(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    got = exact_dedup.deduplicated(d)
    assert got.columns == d.columns
    stay = sorted((r.doc_id, r.text) for r in got.where("doc_id is not null").collect())
    assert stay == [(2, "a  b"), (6, " \n\t"), (8, "x " * 100_000), (10, "é\xa0é"), (11, "éé"), (12, "A b")]


def test_dedup_is_native_and_empty_tables_stay_empty(spark, capsys):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.deduplicated(none).count() == 0
    queries.op13_exact_dedup(spark, SF).explain()
    assert "Python" not in (plan := capsys.readouterr().out) and "Arrow" not in plan


# Centroid clustering.


def expected_clusters(rows, k, rounds, scale=256, dims=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in ranked[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w)), n) for n, w in enumerate(c))
    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        c = [[sum(xs) // len(own[n]) for xs in zip(*own[n])] if own[n] else w for n, w in enumerate(c)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    per = collections.Counter()
    for _, n, d in found:
        per[n] += d
    return sorted([(i, n, d, per[n], sum(per.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in found], key=repr)


@pytest.mark.parametrize("dims", [2, 5])
def test_clusters(spark, dims):
    rng = random.Random(dims)
    vector = lambda: [float(rng.randrange(-2000, 2000)) / 64 for _ in range(dims)]
    hot = vector()
    rows = [(k, vector()) for k in range(120)] + [(500 + k, hot) for k in range(80)] + [(7, hot), (7, hot), (None, hot), (None, vector())]
    odd = [(900, None), (901, []), (902, hot[:-1]), (903, [*hot[:-1], None]), (904, [*hot[:-1], float("nan")]), (905, [*hot[:-1], float("-inf")])]
    d = clashing(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).repartition(4)
    got = centroids.clustered(d, k=9, dims=dims, rounds=3)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_clusters(rows + odd, 9, 3, dims=dims)


def test_few_and_large_vectors(spark):
    d = spark.createDataFrame([(1, [3.0, 4.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.cluster, r.distance) for r in centroids.clustered(d, dims=2).orderBy("vec_id").collect()] == [(1, 0, 0), (2, 0, 0)]
    wide = [(1, [500_000.0, -500_000.0]), (2, [-500_000.0, 500_000.0]), (3, [400_000.0, 0.5])]  # products beyond 2^53
    got = centroids.clustered(spark.createDataFrame(wide, "vec_id long, embedding array<double>"), k=2, dims=2, rounds=2)
    assert sorted(map(tuple, got.collect()), key=repr) == expected_clusters(wide, 2, 2, dims=2)
    assert centroids.clustered(d.limit(0), dims=2).count() == 0
    with pytest.raises(Exception, match="beyond"):
        centroids.clustered(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<float>"), dims=2).collect()


# Token alignment.

SAID = ["plain words", "", None, " ", "\n", "trailing blanks \n\t ", "  many   blanks\r\n here", "d'accord, it's <|endoftext|> and <s></s>", "a ▁ mark", "日本語のテキスト 😀 é", "x" * 5000, "nbsp\xa0 here　 there", "tab\tand\x0bvt\x0cff", "\x00 nul"]


def whole(text):
    """Groups and links of a text by whole encodings and a plain reading of byte ranges."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    if not text:
        return [], []
    raw = (" " + text).encode()
    align = token_align.aligner(*PATHS)

    def spans(ids, said):
        at, out = 0, []
        for i in ids:
            out.append((i, at, at + len(said[i])))
            at += len(said[i])
        return out, b"".join(said[i] for i in ids)

    (xs, one), (ys, two) = spans(a.encode(" " + text, add_special_tokens=False).ids, align.bytes_a), spans(b.encode(text), align.bytes_b)
    if one != raw or two != raw:
        return [], []
    groups, before = [], 0
    for end in sorted({x[2] for x in xs} & {y[2] for y in ys}):
        groups.append(([i for i, s, e in xs if before < e <= end], [i for i, s, e in ys if before < e <= end]))
        before = end
    links = [(i, j) for i, s, e in xs for j, u, w in ys if s < w and u < e] if len(xs) < 200 else [(i, j) for i, s, e in xs for j, u, w in ys if max(s, u) < min(e, w)]
    return groups, links


def expected_alignment(rows):
    seen = [(i, *whole(t)) for i, t in rows]
    count = collections.Counter(p for _, _, links in seen for p in set(links))
    top_a, top_b = collections.Counter(), collections.Counter()
    for (a, b), n in count.items():
        top_a[a], top_b[b] = max(top_a[a], n), max(top_b[b], n)
    out = []
    for i, groups, links in seen:
        spelled = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == top_a[p[0]] for p in links), sum(count[p] == top_b[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(spelled.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_alignment(spark, block, monkeypatch):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 1500").orderBy("doc_id").limit(25).collect()]
    rows = given + [(1000 + k, t) for k, t in enumerate(SAID)] + [(1, "same text"), (1, "same text"), (None, "no id")]
    monkeypatch.setattr(token_align, "BLOCK", block)
    d = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)
    assert sorted(map(tuple, token_align.aligned(d, *PATHS).collect()), key=repr) == expected_alignment(rows)
    assert token_align.aligned(d.limit(0), *PATHS).count() == 0


def test_groups_and_links(spark):
    rows = [(k, t) for k, t in enumerate(SAID)]
    got = {r.doc_id: r for r in token_align.groups_and_links(spark.createDataFrame(rows, "doc_id long, text string"), *PATHS).collect()}
    for i, t in rows:
        groups, links = whole(t)
        assert [(list(g.a), list(g.b)) for g in got[i].groups] == groups and sorted((x.a, x.b) for x in got[i].links) == sorted(links)


def test_what_was_forgotten_is_learnt_again(monkeypatch):
    monkeypatch.setattr(token_align, "REMEMBERED", 20)
    fresh = token_align.Aligner(*PATHS)
    for k in range(30):
        text = f"word{k} and other{k} words {k}"
        assert fresh.detail(text)[0] == whole(text)[0] and len(fresh.known) <= 20 and len(fresh.former) <= 20


def test_queries_of_whole_tables(spark):
    got = queries.queries()["op12_token_alignment"](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.count() == n and got.where("n_links <> n_a + n_b - n_groups or n_best > n_links").count() == 0
