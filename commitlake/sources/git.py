"""Data sources over a git repository: ``gitlog``, ``gitchanges``, ``gittree`` and ``gitblame``.

Git itself gives the records, NUL-separated where they may hold any character. A repository is read where the task
runs; on a cluster the repository must lie on a shared path, or these readers run once to fill Parquet tables.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Commits a task reads.
COMMITS = 1000


def git(repo: str, *args: str, given: str = "") -> str:
    """Output of one git command on the text ``given``, free of the caller's repository variables.

    A command that fails raises: an empty history must not be taken for one that could not be read.
    """
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")} | {"GIT_CONFIG_NOSYSTEM": "1", "LC_ALL": "C"}
    done = subprocess.run(["git", "-C", repo, *args], input=given.encode(), capture_output=True, env=env, check=False)
    if done.returncode:
        raise RuntimeError(f"git {args[0]} in {repo}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "replace")


def is_shallow(repo: str) -> bool:
    """Whether the history of a clone has been cut."""
    return git(repo, "rev-parse", "--is-shallow-repository").strip() == "true"


class _Part(InputPartition):
    def __init__(self, value: list[str], first: int = 0) -> None:
        super().__init__(value)
        self.items, self.first = value, first


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.rev = options["path"], options.get("rev", "HEAD")

    def partitions(self) -> list[InputPartition]:
        return [_Part([])]

    def commits(self, *order: str) -> list[InputPartition]:
        """The commits in parts; a part knows the place of its first."""
        ids = git(self.repo, "rev-list", *order, self.rev).split()
        return [_Part(ids[i : i + COMMITS], i) for i in range(0, len(ids), COMMITS)]


class _Log(_Reader):
    def partitions(self) -> list[InputPartition]:
        return self.commits("--reverse")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        out = git(self.repo, "log", "--no-walk=unsorted", "--stdin", "-z", "--format=%H%x1f%P%x1f%aI%x1f%s%x1f%b", given="\n".join(partition.items))
        for pos, record in enumerate((r for r in out.split("\0") if r), partition.first):
            commit, parents, stamp, subject, body = record.split("\x1f", 4)
            yield pos, commit, parents.split(), stamp, subject, body


_CHANGE = r":(\d+) (\d+) (\w+) (\w+) "
#: An entry of the raw format: a commit's id; a rename or copy with its two paths; another change with its one.
_ENTRY = re.compile(rf"([0-9a-f]{{40,64}})\0|{_CHANGE}([RC]\d*)\0([^\0]*)\0([^\0]*)\0|{_CHANGE}([A-Z]\d*)\0([^\0]*)\0")


def _changes(raw: str, place: dict[str, int]) -> Iterator[tuple]:
    """Rows of ``gitchanges``; seq rises with the place of the commit and, in it, with the place of the change."""
    commit = ""
    for n, entry in enumerate(_ENTRY.finditer(raw)):
        if entry[1]:
            commit = entry[1]
            continue
        old_mode, new_mode, old_blob, new_blob, status, old, new = entry.group(*range(2, 9)) if entry[2] else (*entry.group(*range(9, 15)), entry[14])
        yield (place[commit] << 32) + n, commit, status, old_mode, new_mode, old_blob, new_blob, old, new


class _Changes(_Reader):
    """Changes of each commit against its parent, newest commit first; merges have none."""

    def partitions(self) -> list[InputPartition]:
        return self.commits()

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        place = {commit: partition.first + i for i, commit in enumerate(partition.items)}
        out = git(self.repo, "diff-tree", "--stdin", "-r", "-M", "--raw", "-z", "--root", "--no-abbrev", given="\n".join(partition.items) + "\n")
        yield from _changes(out, place)


class _Tree(_Reader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for record in git(self.repo, "ls-tree", "-r", "-z", self.rev).split("\0"):
            if record:
                head, path = record.split("\t", 1)
                mode, _, blob = head.split()
                yield path, mode, blob


class _Blame(_Reader):
    """Files of the tree in parts of 64; each file is blamed by one git process in its task."""

    def partitions(self) -> list[InputPartition]:
        records = [r.split("\t", 1) for r in git(self.repo, "ls-tree", "-r", "-z", self.rev).split("\0") if r]
        paths = [path for head, path in records if head.startswith("100")]
        return [_Part(paths[i : i + 64]) for i in range(0, len(paths), 64)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.items:
            yield path, git(self.repo, "blame", "--porcelain", self.rev, "--", path)


def _source(format_name: str, fields: str, reader: type[_Reader]) -> type[DataSource]:
    class Git(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return fields

        def reader(self, schema) -> DataSourceReader:
            return reader(self.options)

    return Git


#: Options of each: ``path`` (the repository) and ``rev`` (HEAD).
FORMATS = [
    _source("gitlog", "pos bigint, hash string, parents array<string>, datetime string, message string, body string", _Log),
    _source("gitchanges", "seq bigint, hash string, status string, old_mode string, new_mode string, old_blob string, new_blob string, old string, new string", _Changes),
    _source("gittree", "path string, mode string, blob string", _Tree),
    _source("gitblame", "path string, porcelain string", _Blame),
]


def register(spark: SparkSession) -> None:
    """Make the formats known to the session."""
    for each in FORMATS:
        spark.dataSource.register(each)
