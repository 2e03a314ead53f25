"""Commit logs, renames and tracked files of a repository, read by Spark from git.

GitLog is a Spark data source over a repository: its partitions are ranges of commits, each read by a
task that runs git on its own range, so a log of any length is a table that no list on the driver has
held. Executors must see the repository's folder. Settings of the repository that make git run programs are switched off
on every call.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trowel.session import ship_package

HARDENED = ["git", "-c", "core.fsmonitor=", "-c", "core.quotepath=off"]
TIMEOUT_S, MAX_COMMITS = 60, 4000
#: Commits that a task reads.
RANGE = 1000
LOG = "ord long, sha string, at long, author string, subject string, paths array<string>, renames array<struct<old: string, new: string>>"
#: A rename's place is its commit's, the oldest lowest, times this, and its place within the commit.
RENAMES_OF_A_COMMIT = 1 << 20


def run_git(root: str, *args: str) -> str | None:
    """Output of a git command, or None if it fails or takes too long."""
    try:
        done = subprocess.run([*HARDENED, "-C", root, *args], capture_output=True, timeout=TIMEOUT_S, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.decode("utf-8", "replace")


def is_repo(root: str) -> bool:
    return os.path.exists(os.path.join(root, ".git")) or (run_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def is_shallow(root: str) -> bool:
    return (run_git(root, "rev-parse", "--is-shallow-repository") or "").strip() == "true"


class CommitRange(InputPartition):
    def __init__(self, first: int, count: int) -> None:
        super().__init__((first, count))


def parse_log(text: str, first: int) -> Iterator[tuple]:
    """Rows of LOG from git's output, commits numbered from first."""
    for n, record in enumerate(r for r in text.split("\x1e") if r.strip()):
        head, _, names = record.partition("\n")
        sha, at, author, subject = head.split("\x1f", 3)
        changes = [line.split("\t") for line in names.split("\n") if "\t" in line]
        renames = [{"old": c[1], "new": c[2]} for c in changes if c[0].startswith("R") and len(c) == 3]
        yield first + n, sha, int(at) if at.isdigit() else 0, author, subject, [c[-1] for c in changes], renames


class LogReader(DataSourceReader):
    def __init__(self, root: str, most: int) -> None:
        self.root, self.most = root, most

    def partitions(self) -> list[CommitRange]:
        counted = (run_git(self.root, "rev-list", "--no-merges", "--count", f"--max-count={self.most}", "HEAD") or "0").strip()
        n = int(counted) if counted.isdigit() else 0
        return [CommitRange(first, min(RANGE, n - first)) for first in range(0, n, RANGE)] or [CommitRange(0, 0)]

    def read(self, partition: CommitRange) -> Iterator[tuple]:
        first, count = partition.value
        if not count:
            return
        text = run_git(self.root, "log", f"--skip={first}", f"--max-count={count}", "--no-merges", "-M", "--name-status", "--relative", "--format=%x1e%H%x1f%at%x1f%an%x1f%s")
        if text is None:
            raise RuntimeError(f"git could not read commits from {first} on")
        yield from parse_log(text, first)


class TrackedReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in (run_git(self.root, "ls-files", "-z") or "").split("\0"):
            if path:
                yield (path,)


class GitLog(DataSource):
    """Format trowel_git. Options: path, the repository; table, log (of LOG) or tracked (relpath); max_commits."""

    @classmethod
    def name(cls) -> str:
        return "trowel_git"

    def schema(self) -> str:
        return "relpath string" if self.options.get("table") == "tracked" else LOG

    def reader(self, schema) -> DataSourceReader:
        root = self.options["path"]
        return TrackedReader(root) if self.options.get("table") == "tracked" else LogReader(root, int(self.options.get("max_commits", MAX_COMMITS)))


def _read(spark: SparkSession, root: str, **options: object) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(GitLog)
    return spark.read.format(GitLog.name()).options(**options).load(root)


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """tracked(relpath)."""
    return _read(spark, root, table="tracked")


def log(spark: SparkSession, root: str, max_commits: int = MAX_COMMITS) -> DataFrame:
    """The newest commits but merges, as LOG says; ord is a commit's place, the newest 0."""
    return _read(spark, root, max_commits=max_commits)


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """commits(ord, sha, at, author, subject), commit_files(ord, path) and renames(ord, old, new), oldest first by ord."""
    renames = log.select("ord", F.posexplode("renames").alias("nth", "r"))
    place = F.col("nth") - F.col("ord") * RENAMES_OF_A_COMMIT
    return log.select("ord", "sha", "at", "author", "subject"), log.select("ord", F.explode("paths").alias("path")), renames.select(place.alias("ord"), "r.old", "r.new")
