"""A training corpus from `documents`: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import mixing, ngram_join, packing, pii, quality
from quillmark.llm.common import few_rows, table, written
from quillmark.llm.queries import DEMO_KEY, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    few_rows(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    few_rows(spark)
    return ngram_join.deduplicated(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates."""
    few_rows(spark)
    return pii.pseudonymized(docs, DEMO_KEY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought near their target weights, blocks of words repeated up to three times."""
    few_rows(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    few_rows(spark)
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("pii", surrogates), ("mixing", source_mix), ("packing", packed)]

#: SQL can express neither the surrogates, nor the draws, nor the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all of `documents`, each written and read again as the next one's input.

    Null and empty texts are what the quality rules reject. Rows that repeat an id are judged one by one, and
    all go or stay together as near copies. Null ids stay through every stage; an empty table gives no rows.
    Further columns travel along, whatever their names, until packing, which gives its own."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
