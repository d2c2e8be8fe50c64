"""Queries of the llm operators over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import centroids, chat, exact_dedup, langid, lm_score, mixing, ngram_join, packing, pii, quality, token_align, topk, toxicity
from quillmark.llm.common import few_rows, fold, table

#: Key of the surrogates that the query makes; a deployment passes its own.
DEMO_KEY = b"quillmark-demo-key"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.cascade(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *quality.METRICS, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = lm_score.train(lm_score.train_fold(docs))
    scored = lm_score.score(docs, trained)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(trained.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.pseudonymized(docs, DEMO_KEY).select("doc_id", "text", "n_chars")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_packing, op2_toxicity, op3_quality_cascade, op4_chat_formatting, op5_exact_top_k, op6_mixing, op7_ngram_jaccard_join, op8_lm_scoring, op9_pii_surrogates, op10_language_id, op11_centroid_clustering, op12_token_alignment, op13_exact_dedup, pipeline)

    def with_few_rows(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            few_rows(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: with_few_rows(f) for f in own}


OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
      FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM g) WHERE k > 1),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
             CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN hit USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f
"""

OP4 = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, list(role || chr(0) || text ORDER BY turn, role, text) AS said,
             list('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) ORDER BY turn, role, text) AS parts FROM t GROUP BY conv_id),
u AS (SELECT said, any_value(parts) AS parts, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY said),
k AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.said[1] = a.said[1] AND len(b.said) > len(a.said) AND b.said[1:len(a.said)] = a.said))
SELECT conv_id, CAST(len(said) AS BIGINT) AS n_turns, n_copies, s AS segment, array_to_string(parts[s * 512 + 1 : s * 512 + 512], '') AS text
FROM (SELECT *, unnest(range(0, (len(said) + 511) // 512)) AS s FROM k)
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') AS s
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT s FROM g GROUP BY s HAVING count(*) > 1),
h AS (SELECT g.* FROM g JOIN shared USING (s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, seen) AS (SELECT DISTINCT doc_id, doc_id FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP11_ROUND = """,
a{k} AS MATERIALIZED (SELECT r, n, v, cluster, distance FROM (SELECT x.r, x.n, x.v, c.c AS cluster, CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance,
    row_number() OVER (PARTITION BY x.r ORDER BY list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.c) AS k FROM d x, c{k} c) WHERE k = 1)"""
OP11_MOVE = """,
c{next} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT cluster, i, sum(CAST(v[i] AS HUGEINT) * n) AS s, CAST(sum(n) AS HUGEINT) AS n FROM (SELECT cluster, v, n, unnest(range(1, 65)) AS i FROM a{k}) GROUP BY cluster, i) GROUP BY cluster) m ON m.cluster = c.c)"""
OP11 = (
    """WITH x AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, v, count(*) AS n FROM x GROUP BY v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM x) ORDER BY h NULLS LAST, v LIMIT 40)"""
    + "".join(OP11_ROUND.format(k=k) + OP11_MOVE.format(k=k, next=k + 1) for k in range(5))
    + OP11_ROUND.format(k=5)
    + """
SELECT x.vec_id, CAST(a5.cluster AS INTEGER) AS cluster, a5.distance, CAST(sum(a5.distance) OVER (PARTITION BY a5.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a5.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c5.v, ',')) AS centroid_sha256 FROM x JOIN a5 ON a5.v = x.v JOIN c5 ON c5.c = a5.cluster"""
)

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[ 	-]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER g AS k, first_value(doc_id) OVER g AS keep_id
      FROM d WINDOW g AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_cascade": OP3, "op4_chat_formatting": OP4, "op5_exact_top_k": OP5, "op7_ngram_jaccard_join": OP7, "op11_centroid_clustering": OP11, "op13_exact_dedup": OP13}
