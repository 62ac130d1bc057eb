"""Intermediate tables in the shared folder that the cluster names, and small files of its file system."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.  Only where the setting is unset and the master is local, one of our own takes its place."""
    out = spark.conf.get("spark.checkpoint.dir", None)
    if not out:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        out = "file://" + tempfile.mkdtemp(prefix="weftlog-")
        spark.conf.set("spark.checkpoint.dir", out)
    return out.rstrip("/")


#: Bytes of a Parquet table for each shuffle partition at most: about 100,000 events or orders.
BYTES = 2 << 20


def roomy(spark: SparkSession, path: str) -> None:
    """Raise the session's shuffle partitions so that their number grows with a table, and what a task sorts or counts does not.

    Adaptive execution joins partitions that turn out small; the setting is never lowered.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    wanted = size // BYTES + 1
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back, with Spark's codec or another.

    Its plan is then a scan, so what is built on it several times is computed once and planned small, and a lost executor
    loses nothing of it.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, uri: str):
    """The file system that a path lies in, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_text(spark: SparkSession, uri: str, text: str) -> None:
    """A small text as one file of the cluster's file system; one that exists is replaced."""
    system, path = _file(spark, uri)
    out = system.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, uri: str) -> str:
    system, path = _file(spark, uri)
    stream = system.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def moved(spark: SparkSession, pattern: str, target) -> int:
    """Rename the files under a pattern; ``target`` gives a file's new path from its old one, a path of its own.  Returns how many there were."""
    system, path = _file(spark, pattern)
    found = [str(x.getPath()) for x in system.globStatus(path) or []]
    for old in found:
        new = _file(spark, target(old))[1]
        system.mkdirs(new.getParent())
        if not system.rename(_file(spark, old)[1], new):
            raise OSError(f"cannot rename {old} to {new}")
    return len(found)
