"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders of this process; removed when it ends, because lazily evaluated results read them until then.
_scratch: list[tuple[SparkSession, str]] = []


def build_session(master: str = "local[8]", name: str = "commitlake", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, adaptive execution, Arrow."""
    builder = (
        SparkSession.builder.master(master)
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once a context: it is sent to the executors as a zip file."""
    context = spark.sparkContext
    if getattr(context, "_commitlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="commitlake-code-")) / "commitlake_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._commitlake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine (master ``local``) may do without that setting; it gets a temporary folder. On a
    cluster its absence raises: each executor would write to a disk of its own and read less back, unseen.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="commitlake-")
        spark.conf.set("spark.checkpoint.dir", found)
        _scratch.append((spark, found))
    return found.rstrip("/")


@contextlib.contextmanager
def utc(spark: SparkSession) -> Iterator[None]:
    """Plans built inside read and write timestamps in UTC, whatever the zone of the session.

    An expression takes the session's zone when it is resolved, which is when the DataFrame is made.
    """
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one. It is not created yet; the first writer does that."""
    path = f"{shared_dir(spark)}/commitlake/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append((spark, path))
    return path


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, whatever its scheme."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


@atexit.register
def release() -> None:
    """Remove the intermediate tables of this process; results that still read them cannot be computed any more.

    Runs at the end of the process. A long session calls it when it has written its results.
    """
    while _scratch:
        spark, path = _scratch.pop()
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                remove_path(spark, path)
                if spark.conf.get("spark.checkpoint.dir", None) == path:
                    spark.conf.unset("spark.checkpoint.dir")
