"""Cutting lineage in loops: written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it isn't set, a local session gets a temporary one; a cluster, whose executors couldn't see that, is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in this application's part of it."""
    return f"{shared_dir(spark)}/quernstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder. Results are lazy and read it, so this comes after their last use."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quernstone/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Whether Spark removes an execution's shuffle files when it ends; by default they stay until the driver's collector finds them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back, so that a loop's plan stays short and a lost executor costs no recomputation of earlier rounds.

    The shuffle files of the write go when it is done: what is read from now on is the table, so rounds don't add up on disk.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table made by ``cut`` that no further plan reads."""
    for at in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, marked for broadcast if it is counted to have at most ``most`` rows; larger, the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, for clusters that have no copy on their path."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(tempfile.mkdtemp(prefix="quernstone-")) / f"{top.name}.zip"
    with zipfile.ZipFile(at, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(application)
