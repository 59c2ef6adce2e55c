"""Which repositories a session belongs to: by its remote, by the folders it ran in, by a hash or an id of the project.

Folders are compared by equality: a session's path is exploded into the folders above it, a handful of rows, and these
meet the repositories' roots in an equi-join, however many sessions and repositories there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _segments(path: Column) -> Column:
    """Segments of an absolute path without empty ones, ``.`` and what ``..`` takes back."""

    def step(held: Column, s: Column) -> Column:
        shorter = F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(0)))
        return F.when(s.isin("", "."), held).when(s == "..", shorter).otherwise(F.concat(held, F.array(s)))

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def normal_path(path: Column) -> Column:
    """An absolute path in its shortest spelling; NULL for a relative one and for NULL. Links are not followed."""
    return F.when(path.startswith("/"), F.concat(F.lit("/"), F.array_join(_segments(path), "/")))


def folders(path: Column) -> Column:
    """The folder itself and all above it, shortest first; empty for NULL and relative paths."""
    parts = _segments(path)
    each = F.transform(parts, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/")))
    return F.when(path.startswith("/"), F.concat(F.array(F.lit("/")), each)).otherwise(F.array().cast("array<string>"))


def belonging(sessions: DataFrame, repos: DataFrame, *, key: str, paths: list[str], remote: str, commits: list[str] = (), known: DataFrame | None = None) -> DataFrame:
    """``key``, repo: every repository a session ran on; each pair once.

    ``repos``: repo, root_dir, remote (host/path, or NULL). Where both sides name a remote it decides, in any case of
    letters; another remote still belongs if the session ran inside of the repository from one of its commits (``known``:
    repo, hash). Without two remotes the folder decides: one of ``paths`` is the root or below it. Sessions without paths
    and remote belong nowhere; a session may belong to several repositories.
    """
    lower = lambda c: F.lower(F.nullif(F.col(c), F.lit("")))
    mine = sessions.select(key, F.filter(F.array(*(F.col(p) for p in paths)), lambda x: x.isNotNull()).alias("m_paths"), lower(remote).alias("m_remote"), F.array(*(F.col(c) for c in commits)).cast("array<string>").alias("m_commits"))
    places = repos.select("repo", normal_path(F.col("root_dir")).alias("m_root"), lower("remote").alias("m_own"))
    by_remote = mine.where("m_remote IS NOT NULL").join(places, F.col("m_remote") == F.col("m_own")).select(key, "repo")
    around = F.explode(F.array_distinct(F.flatten(F.transform("m_paths", folders)))).alias("m_root")
    inside = mine.select(key, "m_remote", "m_commits", around).join(places, "m_root")
    found = by_remote.unionByName(inside.where("m_remote IS NULL OR m_own IS NULL").select(key, "repo"))
    if known is not None and commits:
        other = inside.where("m_remote <> m_own").select(key, "repo", F.explode("m_commits").alias("hash"))
        found = found.unionByName(other.join(known.select("repo", "hash"), ["repo", "hash"], "left_semi").select(key, "repo"))
    return found.distinct()


def belonging_by_hash(sessions: DataFrame, places: DataFrame, *, key: str, hash_: str) -> DataFrame:
    """``key``, repo: sessions whose project hash is the SHA-256 of one of a repository's folders (``places``: repo, path)."""
    hashes = places.select("repo", F.sha2("path", 256).alias("m_hash")).distinct()
    return sessions.select(key, F.col(hash_).alias("m_hash")).join(hashes, "m_hash").select(key, "repo").distinct()


def belonging_by_id(sessions: DataFrame, repos: DataFrame, *, key: str, project: str, paths: list[str], known: DataFrame | None = None) -> DataFrame:
    """``key``, repo: sessions by their project id (``repos``: repo, root_dir, ids), else by their folder.

    A folder counts only where the session's project id names no other repository: it has none, the id ``global``, or one
    of the repository's commits (``known``: repo, hash).
    """
    by_id = sessions.select(key, F.col(project).alias("m_id")).join(repos.select("repo", F.explode("ids").alias("m_id")), "m_id").select(key, "repo")
    places = repos.select("repo", normal_path(F.col("root_dir")).alias("m_root"))
    around = F.explode(F.array_distinct(F.flatten(F.transform(F.array(*(F.col(p) for p in paths)), folders)))).alias("m_root")
    inside = sessions.select(key, F.nullif(project, F.lit("")).alias("hash"), around).join(places, "m_root")
    found = by_id.unionByName(inside.where("hash IS NULL OR hash = 'global'").select(key, "repo"))
    if known is not None:
        found = found.unionByName(inside.join(known.select("repo", "hash"), ["repo", "hash"], "left_semi").select(key, "repo"))
    return found.distinct()
