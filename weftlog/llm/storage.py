"""Shared storage: intermediate tables and files that every executor can read again."""

from __future__ import annotations

import posixpath
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch; documents are long, and a task holds a batch or two at once.
BATCH_ROWS = 1000


def bounded_memory(spark: SparkSession) -> None:
    """Session settings under which a task's memory outside the heap stays small.

    Batches to and from Python are of BATCH_ROWS rows, and Parquet files are read through one buffer: the parallel reads of
    whole column chunks keep a native buffer of that size for each of their threads.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and the master is local (tests), one of our own."""
    bounded_memory(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="weftlog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; this cuts its lineage, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = fresh(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a row's place in its file; the file's place among all files comes before them.
PLACE_BITS = 36


def stable(df: DataFrame) -> DataFrame:
    """``df`` if its rows can be told by file and place (a scan of Parquet files with filters and projections that depend on the rows alone); else a written copy."""
    plan = df._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    for node in nodes:
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    if {node.nodeName() for node in nodes} <= {"LogicalRelation", "Project", "Filter"} and plan.deterministic():
        try:
            df.select(df.metadataColumn("_metadata")["row_index"]).schema  # noqa: B018  (Parquet alone has it)
        except AnalysisException:
            return written(df, "rows")
        return df
    return written(df, "rows")


def numbered(df: DataFrame, **columns: Column) -> DataFrame:
    """(row, columns): rows of a ``stable`` table with a number that each scan gives alike, however the scan is split.

    The number is the file's place among the paths of all files that hold rows, and the row's place in the file.  The driver holds the
    paths, as it does for the scan itself.
    """
    meta = df.metadataColumn("_metadata")
    paths = sorted(r.path for r in df.select(meta["file_path"].alias("path")).distinct().collect())
    files = df.sparkSession.createDataFrame(list(enumerate(paths)), "_file long, _path string")
    rows = df.select(meta["file_path"].alias("_path"), meta["row_index"].alias("_place"), *[c.alias(name) for name, c in columns.items()])
    return rows.join(F.broadcast(files), "_path").select((F.shiftleft("_file", PLACE_BITS) + F.col("_place")).alias("row"), *columns)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI or an absolute local path."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri[5:])


def put(uri: str, parts) -> int:
    """Write byte strings as one file by a private name that is then renamed, so that a repeated task replaces it whole. Returns its size."""
    fs, path = filesystem(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    part, size = f"{posixpath.dirname(path)}/_{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part) as out:
        for x in parts:
            out.write(x)
            size += len(x)
    fs.move(part, path)
    return size
