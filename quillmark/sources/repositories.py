"""Source repositories: tracked files, their content and their blame, read with git where the files are."""

from __future__ import annotations

import datetime
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quillmark.operators.comments import MAX_SOURCE


def git(repo: str, *args: str) -> str:
    """A missing git is an error, not an answer."""
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def is_repository(path: str) -> bool:
    try:
        return git(path, "rev-parse", "--is-inside-work-tree").strip() == "true"
    except (subprocess.CalledProcessError, NotADirectoryError):
        return False


def tracked(repo: str, rev: str) -> dict[str, str]:
    """path: blob of each file of a revision."""
    rows = (line.partition("\t") for line in git(repo, "ls-tree", "-r", "-z", rev).split("\0") if line)
    return {path: head.split(" ")[2] for head, _, path in rows if head.split(" ")[1] == "blob"}


def touched(repo: str, rev: str, emails: list[str]) -> set[str]:
    """Paths that any of these authors changed up to a revision, merges left out."""
    return set(filter(None, git(repo, "log", "--no-merges", "--name-only", "--format=", "-z", *(f"--author={e}" for e in emails), rev).replace("\n", "\0").split("\0")))


def candidates(spark: SparkSession, repos: dict[str, str], emails: list[str]) -> DataFrame:
    """repo, root, rev, path, blob: files of HEAD that an author has touched, listed for each repository
    (name: root). Later readings take the revision that was HEAD here, whatever is edited or committed since."""
    bad = [root for root in repos.values() if not is_repository(root)]
    if bad:
        raise ValueError(f"not a repository: {', '.join(bad)}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, root, rev in part[["repo", "root", "rev"]].itertuples(index=False):
                own = touched(root, rev, emails)
                rows = [(name, root, rev, path, blob) for path, blob in sorted(tracked(root, rev).items()) if path in own]
                yield pd.DataFrame(rows, columns=["repo", "root", "rev", "path", "blob"])

    heads = [(name, root, git(root, "rev-parse", "HEAD").strip()) for name, root in sorted(repos.items())]
    roots = spark.createDataFrame(heads, "repo string, root string, rev string").repartition(max(1, len(repos)), "repo")
    return roots.mapInPandas(run, "repo string, root string, rev string, path string, blob string")


def spread(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Files dealt to tasks one by one: a repository is listed by one task, and adaptive execution would leave
    its names in one small partition, though each stands for much work."""
    return files.repartition(tasks or 2 * files.sparkSession.sparkContext.defaultParallelism, "repo", "path")


def read_files(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """repo, path, blob, source; too large ones are left out. A repository's files spread over tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 64):  # few sources at a time in memory
                some = part.iloc[at : at + 64].copy()
                some["source"] = [git(root, "cat-file", "blob", blob) for root, blob in zip(some["root"], some["blob"])]
                yield some[some["source"].str.len() <= MAX_SOURCE][["repo", "path", "blob", "source"]]

    return spread(files, tasks).mapInPandas(run, "repo string, path string, blob string, source string")


def parse_blame(porcelain: str) -> list[tuple[int, str, int]]:
    """(line, email in lower case, UTC year) from `git blame --line-porcelain`."""
    out, line, email, year = [], 0, "", 0
    for row in porcelain.split("\n"):
        if row.startswith("\t"):
            out.append((line, email, year))
            continue
        word, _, rest = row.partition(" ")
        if len(word) == 40 and rest[:1].isdigit():
            line = int(rest.split(" ")[1])
        elif word == "author-mail":
            email = rest.strip("<>").lower()
        elif word == "author-time":
            year = datetime.datetime.fromtimestamp(int(rest), datetime.UTC).year
    return out


def read_blame(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """repo, path, blob, line_no, email, year of every line. A repository's files spread over tasks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for repo, root, rev, path, blob in part[["repo", "root", "rev", "path", "blob"]].itertuples(index=False):
                found = parse_blame(git(root, "blame", "--line-porcelain", rev, "--", path))
                yield pd.DataFrame([(repo, path, blob, *x) for x in found], columns=["repo", "path", "blob", "line_no", "email", "year"])

    return spread(files, tasks).mapInPandas(run, "repo string, path string, blob string, line_no int, email string, year int")
