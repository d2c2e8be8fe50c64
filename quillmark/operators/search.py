"""BM25 search over turns: an index of postings, and ranking for one request or a table of them.

Ranking sees ids and what costs depend on; texts are fetched for the winners alone."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions.stem import stem_text, stems, vocabulary
from quillmark.functions.text import drawn, half_up, let, near_key, token_count, tokens, wide
from quillmark.llm.common import written

#: Words without a topic.
STOP_TEXT = (
    "не в на что это как то у ты да но так ну по же за вот если или к мне он все для из бы мы они его ее там уже еще тут когда до от чтобы был "
    "быть есть меня тебя себя очень просто может можно надо тоже сейчас потом раз без она мной тебе ему ей их наш ваш этот тот сам весь"
)
STOP_WORDS = sorted(set(stem_text(STOP_TEXT)))
MAX_TERMS = 16
K1, B = 1.2, 0.75
RECENCY, INFERRED, SLOW, SLOW_SECONDS = 0.12, 1.5, 0.8, 1800
#: Latin letters lose their marks in the index, Cyrillic ones don't.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


#: Rows that may come to the driver to be looked up in every task from then on: asked terms and winners.
MOST_LOCAL = 1 << 16
#: Words that a filter may name.
MOST_NAMED = 1 << 10
#: Words of a vocabulary that may be broadcast.
MOST_WORDS = 1 << 20
#: Ids in a block of postings, and the blocks that are searched first.
BLOCK_BITS, FIRST_BLOCKS = 10, 32


def folded(word: Column) -> Column:
    return F.when(wide(word), F.translate(word, MARKED, PLAIN)).otherwise(word)


def terms(text: Column, stemmed: bool = True) -> Column:
    return F.transform(stems(text) if stemmed else tokens(text), folded)


def local(rows: DataFrame, most: int = MOST_LOCAL) -> tuple[DataFrame, int | None]:
    """The rows as a table that every task may hold, and how many they are; the frame itself and None where
    there are more than `most`."""
    found = rows.limit(most + 1).collect()
    return (F.broadcast(rows.sparkSession.createDataFrame(found, rows.schema)), len(found)) if len(found) <= most else (rows, None)


@dataclass
class Index:
    """postings: term, id, tf, len. n_docs and avg_len are over all indexed rows.

    bounds (term, block, n, max_tf, min_len), where at hand: how many postings a term has in a block of
    ids, and the figures that no score there goes beyond."""

    postings: DataFrame
    n_docs: int
    avg_len: float
    bounds: DataFrame | None = None

    def cut(self, asked: DataFrame, few: bool) -> Index:
        """The same with the postings of asked terms alone. Of few terms the files' statistics are asked."""
        wanted = asked.select("term").distinct()
        if few:
            names = [r.term for r in wanted.collect()]
            only = lambda df: df.where(F.col("term").isin(names))
        else:
            only = lambda df: df.join(wanted, "term", "left_semi")
        return replace(self, postings=only(self.postings), bounds=None if self.bounds is None else only(self.bounds))


@dataclass
class WordIndex(Index):
    """An index that is made for a request: rows (id, len, word) and each word's term. Stems are looked up in the
    vocabulary, whose words that lead to asked terms are few; only their rows are counted."""

    words: DataFrame | None = None
    terms: DataFrame | None = None

    def cut(self, asked: DataFrame, few: bool) -> Index:
        wanted, n = local(self.terms.join(asked.select("term").distinct(), "term", "left_semi"))
        return Index(counted(self.words.join(wanted, "word")), self.n_docs, self.avg_len)


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def said_words(rows: DataFrame, text: str) -> DataFrame:
    """id, len and each token as word. A plain explode would have the tokens made twice, first to see whether
    there are any."""
    found = rows.select("id", tokens(F.col(text)).alias("_t")).select("id", F.size("_t").alias("len"), F.explode_outer("_t").alias("word"))
    return found.where("word is not null")


def build_index(turns: DataFrame, text: str = "text", stemmed: bool = True, known: DataFrame | None = None) -> Index:
    """Index of all turns that aren't held out and have that text. Terms are counted within their turn; ids are
    unique. `known` (word, stem) holds every word, where the corpus keeps its vocabulary: it is broadcast
    where it has no more than MOST_WORDS words. Else the distinct words are stemmed here."""
    rows = turns.where(~F.col("holdout") & F.col(text).isNotNull())
    n, avg = rows.agg(F.count("*"), F.avg(token_count(F.col(text)))).first()  # each token is one term
    said = said_words(rows, text)
    if not stemmed:
        return Index(counted(said.withColumn("term", folded(F.col("word")))), int(n), float(avg or 0.0))
    found = (vocabulary(said) if known is None else known).select("word", folded(F.col("stem")).alias("term"))
    held = F.broadcast(found) if known is not None and known.limit(MOST_WORDS + 1).count() <= MOST_WORDS else found
    return WordIndex(counted(said.join(held, "word")), int(n), float(avg or 0.0), words=said, terms=found)


@dataclass
class TextIndex:
    """Turns that are searched as they stand: what requests ask for is counted in one pass over the texts, which
    gives n_docs and avg_len too. `words` (word) holds every word that may be there and is needed for stems."""

    turns: DataFrame
    text: str = "text"
    stemmed: bool = True
    words: DataFrame | None = None

    def cut(self, asked: DataFrame, few: bool) -> Index:
        """The index that build_index makes, cut to the asked terms."""
        names, wanted = None, None
        if few:
            names = [r.term for r in asked.select("term").distinct().collect()]
            if self.stemmed:
                known = vocabulary(self.words).select("word", folded(F.col("stem")).alias("term"))
                wanted, n = local(known.where(F.col("term").isin(names)), MOST_NAMED)
                names = None if n is None else [r.word for r in wanted.collect()]
        if names is None:
            known = vocabulary(self.words) if self.stemmed else None
            return build_index(self.turns, self.text, self.stemmed, known).cut(asked, few)
        rows = self.turns.where(~F.col("holdout") & F.col(self.text).isNotNull()).select("id", tokens(F.col(self.text)).alias("_t"))
        own = (lambda w: w) if self.stemmed else folded
        hits = F.transform(F.filter("_t", lambda w: own(w).isin(names)), own)
        each = let(hits, lambda h: F.transform(F.array_distinct(h), lambda w: F.struct(w.alias("word"), F.size(F.filter(h, lambda x: x == w)).cast("long").alias("tf"))))
        held = written(rows.select("id", F.size("_t").alias("len"), each.alias("hits")), "asked")
        n, avg = held.agg(F.count("*"), F.avg("len")).first()
        found = held.select("id", "len", F.explode("hits").alias("h")).select("id", "len", "h.word", "h.tf")
        found = found.join(wanted, "word") if self.stemmed else found.withColumnRenamed("word", "term")
        return Index(found.groupBy("id", "term").agg(F.sum("tf").alias("tf"), F.first("len").alias("len")), int(n), float(avg or 0.0))


def block_bounds(postings: DataFrame) -> DataFrame:
    """term, block, n, max_tf, min_len: a posting's weight grows with tf and shrinks with len, so these two bound
    it whatever the average length comes to."""
    return postings.groupBy("term", F.shiftright("id", BLOCK_BITS).alias("block")).agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"))


def query_terms(requests: DataFrame, stemmed: bool = True, text: str = "query") -> DataFrame:
    """query_id, term: distinct, without stop words, the 16 longest, earlier ones first among equals."""
    found = F.array_except(F.array_distinct(terms(F.col(text), stemmed)), F.array(*map(F.lit, STOP_WORDS)))
    placed = F.array_sort(F.transform(found, lambda w, i: F.struct((-F.length(w)).alias("k"), i.alias("i"), w.alias("term"))))
    return requests.select("query_id", F.explode(F.slice(placed, 1, MAX_TERMS)).alias("t")).select("query_id", "t.term")


def weight(index: Index, tf: Column, length: Column) -> Column:
    """What a posting adds to a score, but for its term's rarity."""
    long = K1 * (1 - B + B * length / F.lit(max(index.avg_len, 1e-9)))
    return tf * (K1 + 1) / (tf + long)


def rarity(index: Index, seen: DataFrame) -> DataFrame:
    """term, idf of terms with their number of postings n_t."""
    n = F.lit(float(index.n_docs))
    idf = F.log((n - F.col("n_t") + 0.5) / (F.col("n_t") + 0.5))
    return seen.select("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf"))


def bm25(index: Index, asked: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """query_id, id, score (lower is better) from an index cut to the asked terms. With `wanted` (query_id,
    block) the ids of those blocks alone are scored."""
    # every posting has both; named here, so that this use of the postings shares the other's shuffle
    both = F.col("tf") + F.col("len") > 0
    counts = index.postings.groupBy("term").agg(F.count(F.when(both, 1)).alias("n_t")) if index.bounds is None else index.bounds.groupBy("term").agg(F.sum("n").alias("n_t"))
    known = F.broadcast(asked.join(rarity(index, counts), "term"))  # a row for each asked term
    hits = index.postings.join(known, "term")
    if wanted is not None:
        hits = hits.withColumn("block", F.shiftright("id", BLOCK_BITS)).join(wanted, ["query_id", "block"], "left_semi")
    return hits.groupBy("query_id", "id").agg((-F.sum(F.col("idf") * weight(index, F.col("tf"), F.col("len")))).alias("score"))


def facet_filter(turns: DataFrame, register: str | None = None, lang: str | None = None, require_context: bool = False, year_from: int | None = None, min_chars: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Turns that aren't held out and fit; `longform` is a flag over any register."""
    out = turns.where(~F.col("holdout"))
    if register:
        out = out.where(F.col("longform") if register == "longform" else F.col("register") == register)
    if lang:
        out = out.where(F.col("lang") == lang)
    if require_context:
        out = out.where(F.col("context_in").isNotNull() & (F.col("context_in") != ""))
    if year_from is not None:
        out = out.where(F.col("year") >= year_from)
    if min_chars is not None:
        out = out.where(F.col("chars") >= min_chars)
    if max_chars is not None:
        out = out.where(F.col("chars") <= max_chars)
    return out


def ranked(scores: DataFrame, turns: DataFrame, now: int, recency: float = RECENCY, match_context: bool = False) -> DataFrame:
    """query_id, id, score, cost: the score plus what age and a doubtful pairing cost."""
    age = F.greatest(F.lit(0), F.lit(now) - F.col("year")) * recency
    cost = F.col("score") + age
    if match_context:
        cost = cost + F.when(F.col("context_explicit"), 0.0).otherwise(INFERRED) + F.when(~F.col("context_explicit") & (F.col("context_lag") > SLOW_SECONDS), SLOW).otherwise(0.0)
    # summing order differs from run to run in the last digits, which must not decide ranks
    return scores.join(turns, "id").withColumn("cost", half_up(cost, 9))


def collapsed(candidates: DataFrame, limit: int, order: list[str], text: str = "text") -> DataFrame:
    """Of near-duplicates the first in order, then the first `limit` of each query; adds place. The first of a key
    is a minimum, taken in every task before anything moves, so a key of any size is one row a task."""
    rows, first = F.struct(*candidates.columns), F.struct(*order)
    once = candidates.groupBy("query_id", near_key(F.col(text)).alias("_key")).agg(F.min_by(rows, first).alias("_row")).select("_row.*")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= limit)


def top_candidates(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of lowest cost for each query: tasks pass on n rows a query at most."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("cost", "id"))).where(F.col("_r") <= n).drop("_r")


def best(index: Index, asked: DataFrame, facts: DataFrame, n: int, now: int, recency: float, match_context: bool) -> DataFrame:
    """query_id, id, score, cost of the n best ids for each request. `facts` are the ids that may be found, with
    what costs depend on.

    With bounds, blocks of ids are ranked by the lowest cost that any id in them can have. The FIRST_BLOCKS
    best give n costs to beat; after that only blocks that can beat them are read. The result is the same."""
    top = lambda wanted=None: top_candidates(ranked(bm25(index, asked, wanted), facts, now, recency, match_context), n).select("query_id", "id", "score", "cost")
    if index.bounds is None:
        return top()
    known = F.broadcast(asked.join(rarity(index, index.bounds.groupBy("term").agg(F.sum("n").alias("n_t"))), "term"))
    least = index.bounds.join(known, "term").groupBy("query_id", "block").agg((-F.sum(F.col("idf") * weight(index, F.col("max_tf"), F.col("min_len")))).alias("least"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("least", "block"))
    first, n_first = local(least.withColumn("_p", place).where(F.col("_p") <= FIRST_BLOCKS).select("query_id", "block"))
    found, n_found = local(top(first)) if n_first is not None else (None, None)
    if n_found is None:
        return top()
    beaten = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("cost").alias("cost")).where(F.col("n") >= n).select("query_id", "cost")
    # costs are rounded at nine digits, sums differ in the last ones
    rest = least.join(F.broadcast(beaten), "query_id", "left").where(F.col("cost").isNull() | (F.col("least") <= F.col("cost") + 1e-6))
    rest = rest.join(first, ["query_id", "block"], "left_anti").select("query_id", "block")
    return top_candidates(found.unionByName(top(rest)), n)


def search(index: Index | TextIndex, turns: DataFrame, requests: DataFrame, limit: int = 20, now: int = 2026, recency: float = RECENCY, match_context: bool = False, stemmed: bool = True, seed: int | None = None, **facets) -> DataFrame:
    """query_id, place, id, score, source and the turn's columns: the best `limit` turns for each request
    (query_id, query). Three times as many are ranked before near-duplicates collapse.

    With a seed, requests that come out short are filled up with turns drawn by hash: no list is empty
    while the facet has turns. Requests without a usable word match nothing and are only filled up."""
    requests, n = local(requests.select("query_id", "query"))
    asked = query_terms(requests, stemmed)
    asked = asked if n is None else local(asked, MOST_LOCAL * MAX_TERMS)[0]
    fit = facet_filter(turns, **facets)
    facts = fit.select("id", "year", *(["context_explicit", "context_lag"] if match_context else []))
    cut = index.cut(asked, n is not None and n <= 64)
    found = best(cut, asked, facts, 3 * limit, now, recency, match_context).withColumn("source", F.lit(0))
    if seed is not None:
        draw = fit.select("id", drawn(F.col("id"), seed).alias("cost")).orderBy("cost", "id").limit(2 * limit)  # 2 * limit rows
        spare = requests.select("query_id").crossJoin(F.broadcast(draw)).select("query_id", "id", F.lit(None).cast("double").alias("score"), "cost", F.lit(1).alias("source"))
        found = found.unionByName(spare)
    few = n is not None and 5 * limit * n <= MOST_LOCAL * MAX_TERMS
    own = turns.drop("query_id", "score", "cost", "source")  # names that the result has for itself
    return collapsed(own.join(F.broadcast(found) if few else found, "id"), limit, ["source", "cost", "id"])


def with_topic(pairs: DataFrame, topical: DataFrame, limit: int) -> DataFrame:
    """Matched pairs, then turns on the same topic up to `limit`; a turn counts where it stands first."""
    both = pairs.withColumn("origin", F.lit(0)).unionByName(topical.withColumn("origin", F.lit(1)))
    once = both.withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "id").orderBy("origin"))).where("_k = 1").drop("_k")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("origin", "place", "id"))).where(F.col("place") <= limit)


def sample(turns: DataFrame, n: int, seed: int, **facets) -> DataFrame:
    """n turns drawn by hash, near-duplicates collapsed: the same seed draws the same turns."""
    draw = facet_filter(turns, **facets).select("id", drawn(F.col("id"), seed).alias("cost")).orderBy("cost", "id").limit(n)
    own = turns.join(F.broadcast(draw), "id")  # n rows
    return collapsed(own.withColumn("query_id", F.lit(0)), n, ["cost", "id"]).drop("query_id", "cost")


def holdout_turns(turns: DataFrame, n: int = 20) -> DataFrame:
    return turns.where("holdout").orderBy("id").limit(n)


def pair_stats(turns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, turns, pairs, quoted, share: how much reply material there is."""
    pairs = F.coalesce(F.sum(F.when(F.col("context_in").isNotNull(), 1)), F.lit(0))
    quoted = F.coalesce(F.sum(F.when(F.col("context_explicit"), 1)), F.lit(0))
    return turns.where(~F.col("holdout")).groupBy(*(keys or [])).agg(F.count("*").alias("turns"), pairs.alias("pairs"), quoted.alias("quoted"), (pairs / F.greatest(F.count("*"), F.lit(1))).alias("share"))


def pair_quality(examples: DataFrame, stats: DataFrame, limit: int, least_share: float = 0.05) -> DataFrame:
    """query_id and flags: few_pairs (no pairs, or hardly any in the register), short (fewer pairs than
    asked for) and none_quoted. few_pairs speaks for itself; the others are false beside it."""
    pairs, quoted = F.count(F.col("context_in")), F.coalesce(F.sum(F.when(F.col("context_explicit") & F.col("context_in").isNotNull(), 1)), F.lit(0))
    found = examples.groupBy("query_id").agg(pairs.alias("pairs"), quoted.alias("quoted")).crossJoin(F.broadcast(stats.select("share")))  # one row
    few = (F.col("pairs") == 0) | (F.col("share") < least_share)
    return found.select("query_id", "pairs", few.alias("few_pairs"), (~few & (F.col("pairs") < limit)).alias("short"), (~few & (F.col("quoted") == 0)).alias("none_quoted"))
