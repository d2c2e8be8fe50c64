"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import bounded_sample, small, texts, Batches

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Text:
    """What rules ask of a text. Each figure is computed when first asked for, and kept."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a 3-word window that the text holds twice or more."""
        if self.n_words < 4:
            return 0
        code: dict[bytes, int] = {}
        w = np.array([code.setdefault(x, len(code)) for x in self.words], dtype=np.int64)
        _, pair = np.unique(w[:-1] * len(code) + w[1:], return_inverse=True)
        _, kind, times = np.unique(pair[:-1] * len(code) + w[2:], return_inverse=True, return_counts=True)
        again = times[kind] > 1
        hit = np.zeros(len(w), dtype=bool)
        for k in range(3):
            hit[k : k + len(again)] |= again
        return int(hit.sum())


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


#: Integer arithmetic, so that SQL decides alike.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 50 * t.n_words),
    Rule("symbols", lambda t: 100 * t.n_symbols > 25 * t.n_words),
    Rule("duplicate_lines", lambda t: 100 * t.n_dup_lines > 30 * len(t.lines)),
    Rule("word_length", lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words),
)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000) -> tuple[Rule, ...]:
    """Rules by estimated rejections per second, highest first, ties by name.

    Every rule runs on every row of a sample of at most sample_rows rows, each on a fresh Text so
    that its whole cost shows. The order changes what is computed, never which rows are kept."""

    def run(batches: Batches) -> Batches:
        cost, hits = np.zeros(len(rules)), np.zeros(len(rules), dtype=np.int64)
        for batch in small(batches):
            for t in texts(batch):
                for k, rule in enumerate(rules):
                    began = time.perf_counter()
                    hits[k] += rule.rejects(Text(t))
                    cost[k] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays([pa.array([r.name for r in rules]), pa.array(cost), pa.array(hits)], ["rule", "cost", "hits"])

    seen = bounded_sample(docs.select("doc_id", "text"), "doc_id", sample_rows).mapInArrow(run, "rule string, cost double, hits long")
    rate = {r.rule: r.hits / max(r.cost, 1e-9) for r in seen.groupBy("rule").agg(F.sum("cost").alias("cost"), F.sum("hits").alias("hits")).collect()}
    return tuple(sorted(rules, key=lambda r: (-rate.get(r.name, 0.0), r.name)))


def cascade(docs: DataFrame, rules: tuple[Rule, ...] | None = None, metrics: bool = True, sample_rows: int = 2000) -> DataFrame:
    """doc_id, kept and, if asked for, the METRICS of every document, whole texts read.

    A row leaves the cascade at the first rule that rejects it. A null or empty text has no word
    and zero everywhere; the default rules reject it. Repeated rows are judged alike, one result a
    row. An empty table gives an empty result. Other columns are ignored.
    """
    ordered = order_rules(docs, rules or RULES, sample_rows)
    names = METRICS if metrics else ()

    def run(batches: Batches) -> Batches:
        for batch in small(batches):
            seen = [Text(t) for t in texts(batch)]
            kept = [not any(r.rejects(t) for r in ordered) for t in seen]
            cols = [pa.array([getattr(t, n) for t in seen], pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols, pa.array(kept, pa.bool_())], ["doc_id", *names, "kept"])

    kinds = "".join(f"{n} long, " for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}kept boolean")


def keep(docs: DataFrame, rules: tuple[Rule, ...] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Rows of docs, all columns, that no rule rejects: one pass, no shuffle."""
    ordered = order_rules(docs, rules or RULES, sample_rows)

    def run(batches: Batches) -> Batches:
        for batch in small(batches):
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array([not any(r.rejects(x) for r in ordered) for x in map(Text, texts(batch, at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
