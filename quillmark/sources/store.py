"""The stored corpus: Parquet under one folder that the cluster shares, published by manifests.

A table is written to a folder of its own under data/ and never changed. A manifest names the folders that make
up a version of the corpus, with its key and value pairs (meta); manifests are numbered, and renaming one into
place publishes all its tables together. Readers take the newest. A build that ends early leaves folders that
no manifest names, and the version before it as it was.

Tables: turns/<register>, so the chat and the code half are replaced apart; postings and context_postings, the
two search indexes, each with its bounds by term and block of ids; vocabulary, the stem of every word that a
build has met; profile_chat/ and profile_code/, the two halves of the profile; blame, the authors of lines for
the next build."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.stem import vocabulary
from quillmark.operators.search import Index, block_bounds, build_index, said_words
from quillmark.operators.turns import ranks

TURN = (
    "id bigint, chat_key string, register string, longform boolean, holdout boolean, lang string, ts bigint, year int, parts array<string>, "
    "text string, n_parts int, chars int, context_in string, context_explicit boolean, context_lag bigint"
)
STORED = TURN.replace("register string, ", "")
COLUMNS = [c.strip().split(" ")[0] for c in TURN.split(", ")]
CHAT, CODE = ("dm", "group"), ("code", "jsdoc")
POSTINGS = "id bigint, term string, tf bigint, len int"
BOUNDS = "term string, block bigint, n bigint, max_tf bigint, min_len int"
#: Folders that a table of words may lie in before they are made one.
MOST_FOLDERS = 16
BLAME = "repo string, path string, blob string, line_no int, email string, year int"


class Profile(NamedTuple):
    """Both halves: tables by name, the code half's under code_<name>; scalars are the chat half's where it has them."""

    built_at: str
    recent_from: int
    tables: dict[str, DataFrame]


class Manifest(NamedTuple):
    """tables: names with the folders, below the store's, that hold their rows."""

    version: int
    tables: dict[str, list[str]]
    meta: dict[str, str]


class Store:
    def __init__(self, spark: SparkSession, path: str, pinned: Manifest | None = None):
        self.spark, self.path, self._pinned, self._draft = spark, path.rstrip("/"), pinned, None

    # Files and manifests.

    def _file(self, name: str):
        """Hadoop's file system and path of a name below the store."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[str]:
        fs, where = self._file(folder)
        return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []

    def manifest(self) -> Manifest:
        """The version to read: the build's own, the one this store is held at, or the newest."""
        if self._draft or self._pinned:
            return self._draft or self._pinned
        versions = [int(n) for n in self._names("manifests") if n.isdecimal()]
        if not versions:
            return Manifest(0, {}, {})
        return self._version(max(versions))

    def _version(self, version: int) -> Manifest:
        fs, where = self._file(f"manifests/{version:012d}")
        opened = fs.open(where)
        try:
            told = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()
        return Manifest(version, told["tables"], told["meta"])

    def snapshot(self) -> Store:
        """This store held at its present version, whatever is published meanwhile."""
        return Store(self.spark, self.path, self.manifest())

    def _publish(self, done: Manifest) -> None:
        fs, hidden = self._file(f"manifests/_{uuid.uuid4().hex}")
        out = fs.create(hidden, False)
        out.write(bytearray(json.dumps({"tables": done.tables, "meta": done.meta}, ensure_ascii=False).encode()))
        out.close()
        _, to = self._file(f"manifests/{done.version + 1:012d}")
        if fs.exists(to) or not fs.rename(hidden, to):
            raise OSError(f"another build has published version {done.version + 1}")

    @contextmanager
    def building(self) -> Iterator[Store]:
        """All that is written inside becomes one version, published at the end; inside, it can be read. After an
        error nothing is published. A build within a build is part of it."""
        if self._pinned:
            raise ValueError("a snapshot can't be written to")
        if self._draft:
            yield self
            return
        now = self.manifest()
        self._draft = Manifest(now.version, dict(now.tables), dict(now.meta))
        try:
            yield self
            self._publish(self._draft)
        finally:
            self._draft = None

    def prune(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest manifests, and the folders that none of them names. Not for the time of a
        build, whose folders no manifest names yet. Gives the folders' names."""
        versions = sorted(n for n in self._names("manifests") if n.isdecimal())
        used = {f.split("/")[1] for n in versions[-keep:] for folders in self._version(int(n)).tables.values() for f in folders}
        gone = [n for n in self._names("data") if n not in used]
        for name in [f"manifests/{n}" for n in self._names("manifests") if n not in versions[-keep:]] + [f"data/{n}" for n in gone]:
            fs, where = self._file(name)
            fs.delete(where, True)
        return gone

    def _at(self, name: str) -> list[str]:
        return [f"{self.path}/{f}" for f in self.manifest().tables.get(name, [])]

    def _exists(self, name: str) -> bool:
        return name in self.manifest().tables

    def _read(self, name: str, schema: str) -> DataFrame:
        folders = self._at(name)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, more: bool = False) -> None:
        """A new folder for the table, beside those it has (more) or in their place."""
        with self.building():
            folder = f"data/{name.replace('/', '.')}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/{folder}")
            self._draft.tables[name] = [*(self._draft.tables.get(name, []) if more else []), folder]

    # Tables.

    def turns(self) -> DataFrame:
        """All turns. Columns that older files lack read as null: that is how the schema grows. A filter on the
        register leaves the other registers' folders unread."""
        found = [self._read(t, STORED).withColumn("register", F.lit(t.split("/")[1])) for t in sorted(self.manifest().tables) if t.startswith("turns/")]
        return reduce(DataFrame.unionByName, found, self.spark.createDataFrame([], TURN)).select(*COLUMNS)

    def turn(self, id: int) -> DataFrame:
        return self.turns().where(F.col("id") == id)

    def next_id(self, replaced: tuple[str, ...] = ()) -> int:
        """One beyond every id that stays when the turns of these registers are replaced."""
        kept = self.turns().where(~F.col("register").isin(*replaced)) if replaced else self.turns()
        return kept.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]

    def write_turns(self, turns: DataFrame, registers: tuple[str, ...]) -> None:
        """Replaces the turns of these registers, one job, others untouched; a register without new turns
        is emptied."""
        with self.building():
            folder = f"data/turns-{uuid.uuid4().hex}"
            turns.where(F.col("register").isin(*registers)).select(*COLUMNS).write.partitionBy("register").parquet(f"{self.path}/{folder}")
            written = self._names(folder)
            for r in registers:
                self._draft.tables.pop(f"turns/{r}", None)
                if f"register={r}" in written:
                    self._draft.tables[f"turns/{r}"] = [f"{folder}/register={r}"]

    def vocabulary(self) -> DataFrame:
        return self._read("vocabulary", "word string, stem string")

    def learn_words(self) -> None:
        """Stems of the words that no build before has met; all others stay as they are."""
        rows = self.turns().where("not holdout")
        words = [said_words(rows.where(F.col(c).isNotNull()), c).select("word").distinct() for c in ("text", "context_in")]
        new = vocabulary(words[0].unionByName(words[1]), self.vocabulary())
        if len(self._at("vocabulary")) < MOST_FOLDERS:
            self._write(new, "vocabulary", more=True)
        else:
            self._write(self.vocabulary().unionByName(new), "vocabulary")

    def rebuild_indexes(self, stemmed: bool = True) -> None:
        with self.building():
            if stemmed:
                self.learn_words()
            for name, column in (("postings", "text"), ("context_postings", "context_in")):
                index = build_index(self.turns(), column, stemmed, self.vocabulary() if stemmed else None)
                self._by_term(index.postings, name)
                self._by_term(block_bounds(self._read(name, POSTINGS)), f"{name}_bounds")
                self.set_meta({f"{name}.n_docs": str(index.n_docs), f"{name}.avg_len": repr(index.avg_len)})

    def _by_term(self, rows: DataFrame, name: str) -> None:
        """Files that each hold a range of terms in order, so a filter on terms skips most of them."""
        self._write(rows.repartitionByRange("term").sortWithinPartitions("term"), name)

    def index(self, context: bool = False) -> Index:
        name = "context_postings" if context else "postings"
        meta = self.meta()
        bounds = self._read(f"{name}_bounds", BOUNDS) if self._exists(f"{name}_bounds") else None
        return Index(self._read(name, POSTINGS), int(meta.get(f"{name}.n_docs", "0")), float(meta.get(f"{name}.avg_len", "0")), bounds)

    def meta(self) -> dict[str, str]:
        return dict(self.manifest().meta)

    def set_meta(self, values: dict[str, str]) -> None:
        with self.building():
            self._draft.meta.update(values)

    def save_profile(self, half: str, tables: dict[str, DataFrame]) -> None:
        """half: chat or code; each half is replaced without the other."""
        with self.building():
            for name in self._parts(f"profile_{half}"):
                del self._draft.tables[f"profile_{half}/{name}"]
            for name, df in tables.items():
                self._write(df, f"profile_{half}/{name}")

    def profile(self, half: str, name: str) -> DataFrame | None:
        folders = self._at(f"profile_{half}/{name}")
        return self.spark.read.parquet(*folders) if folders else None

    def blame(self) -> DataFrame:
        return self._read("blame", BLAME)

    def save_blame(self, rows: DataFrame) -> None:
        """Replaces the cache by `rows`, which may read it."""
        self._write(rows, "blame")

    def merged_profile(self) -> Profile | None:
        """None before the first build."""
        halves = [(h, n) for h in ("chat", "code") for n in self._parts(f"profile_{h}")]
        if not halves:
            return None
        named = {n if h == "chat" or n.startswith("code_") else f"code_{n}": self.profile(h, n) for h, n in halves}
        meta = self.meta()
        return Profile(meta.get("built_at", meta.get("code_built_at", "")), int(meta.get("recent_from", "0")), named)

    def _parts(self, name: str) -> list[str]:
        """Names of the tables that make up a larger one."""
        return sorted(t.split("/")[1] for t in self.manifest().tables if t.startswith(f"{name}/"))

    def export(self, to: str) -> None:
        """A copy of one version for serving: turns, indexes, profiles and meta. The place must hold no corpus."""
        here, target = self.snapshot(), Store(self.spark, to)
        if target.manifest().version:
            raise FileExistsError(to)
        with target.building():
            target.set_meta(here.meta())
            for name in here.manifest().tables:
                if name not in ("blame", "vocabulary"):
                    target._write(self.spark.read.parquet(*here._at(name)), name)


def with_ids(turns: DataFrame, first: int) -> DataFrame:
    """Adds id: consecutive numbers from `first` in order of (chat_key, ts, pos), the same at every run.

    Numbers come from ranks of a whole-number key within ranges, so no task orders the table."""
    keyed = turns.withColumn("_key", F.xxhash64("chat_key", "ts", *[c for c in ("pos", "repo", "path", "start_line") if c in turns.columns], "text"))
    keyed = keyed.withColumn("_key", F.shiftright("_key", 40))  # 2^24 ranges of neighbours, told apart below
    from pyspark.sql.window import Window

    n = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("chat_key", "ts", "text")))
    unique = n.withColumn("_u", F.col("_key") * (1 << 36) + F.col("_n"))
    return ranks(unique, "_u", per_range=1 << 48).withColumn("id", F.col("rank") + (first - 1)).drop("_key", "_n", "_u", "rank")


def missing(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (repo, path, blob) whose blame isn't cached for that blob: what is left to do."""
    return files.join(cache.select("repo", "path", "blob").distinct(), ["repo", "path", "blob"], "left_anti")


def refreshed(cache: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """The cache for the next run: rows of files that still are as they were, and the new ones."""
    return cache.join(files.select("repo", "path", "blob"), ["repo", "path", "blob"], "left_semi").unionByName(found)
