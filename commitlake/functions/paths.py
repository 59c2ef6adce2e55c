"""Paths, remotes, globs and small formats, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    """The last segment of a path."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension of a path's name; NULL without a dot or with only a leading one."""
    name = file_name(path)
    none = ~name.contains(".") | (name.startswith(".") & (F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) == 1))
    return F.when(~none, F.lower(F.substring_index(name, ".", -1)))


def path_key(path: Column) -> Column:
    """Key of a single path in a language table."""
    return F.concat(F.lit("/"), path)


def parse_remote(remote: Column) -> Column:
    """Struct host, path of a URL or scp-like remote; NULL where it is neither or its path has no slash.

    The host is in lower case, without user and port; the path without slashes around it and without ``.git``.
    """
    url = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:]+)(?::\d+)?/(.*)$"
    scp = r"^(?:[^@/:]+@)?([^/:@]+):(?!//)(.*)$"
    found = lambda pattern: F.struct(F.regexp_extract(remote, pattern, 1).alias("h"), F.regexp_extract(remote, pattern, 2).alias("p"))
    hit = F.when(remote.rlike(url), found(url)).when(remote.rlike(scp), found(scp))
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(hit["p"], r"^/+|/+$", ""), r"\.git$", ""), r"/+$", "")
    return F.when(hit.isNotNull() & path.contains("/"), F.struct(F.lower(hit["h"]).alias("host"), path.alias("path")))


def inside(path: Column, root: Column) -> Column:
    """Whether ``path`` is ``root`` or below it; false for NULL."""
    bare = F.regexp_replace(root, r"/+$", "")
    return F.coalesce((path == root) | path.startswith(F.concat(bare, F.lit("/"))), F.lit(False))


def project_dir(path: Column) -> Column:
    """Name of a log folder: everything but letters and digits as ``-``."""
    return F.regexp_replace(path, r"[^a-zA-Z0-9]", "-")


def cache_key(path: Column) -> Column:
    """Name of a cache: the path's last segment and twelve digits of its SHA-256."""
    return F.concat_ws("-", file_name(path), F.substring(F.sha2(path, 256), 1, 12))


def remote_project_id(key: Column) -> Column:
    """Project id of a normalised remote (host/path)."""
    return F.sha1(F.concat(F.lit("git-remote:"), key))


def safe_name(name: Column) -> Column:
    """A name whose quotes, backslashes, control characters and trailing white space are ``_``."""
    return F.regexp_replace(name, r'[\\"\x00-\x1f\x7f]|\s+$', "_")


def local_path(uri: Column) -> Column:
    """Path of a ``file:`` URI, NULL for another."""
    return F.when(F.lower(uri).startswith("file://"), F.url_decode(F.replace(F.regexp_extract(uri, r"^[A-Za-z]+://[^/]*(/.*)?$", 1), F.lit("+"), F.lit("%2B"))))


def glob_pattern(glob: str) -> str:
    """Regular expression of a glob: ``**/`` any number of folders, ``**`` anything, ``*`` and ``?`` within a segment."""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob)
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(t) or re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", t) for t in tokens) + "$"


def glob_match(path: Column, globs: list[str]) -> Column:
    """Whether any glob matches the whole path; false for NULL."""
    hit = F.lit(False)
    for glob in globs:
        hit = hit | F.coalesce(path.rlike(glob_pattern(glob)), F.lit(False))
    return hit


def compact(n: Column) -> Column:
    """A count as 950, 1.2K, 3.4M or 5.6B, ties to even; a value that rounds up to the next unit takes it."""
    unit = lambda divisor, mark: F.format_string(f"%.1f{mark}", F.rint(n / (divisor / 10)) / 10)
    return F.when(n < 1000, n.cast("string")).when(n < 999_950, unit(1e3, "K")).when(n < 999_950_000, unit(1e6, "M")).otherwise(unit(1e9, "B"))


def duration(seconds: Column) -> Column:
    """Seconds as 0.2s, 4m02s or 1h03m."""
    whole = F.floor(seconds + 0.5).cast("bigint")
    return (
        F.when(seconds < 59.95, F.format_string("%.1fs", seconds))
        .when(whole < 3600, F.format_string("%dm%02ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh%02dm", F.floor(whole / 3600), F.floor(whole / 60) % 60))
    )
