"""Session factory and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "crawlmill") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CRAWLMILL_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session, whose executors are this process, takes a
    folder of its own; a cluster raises an error, as its executors could not read
    each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    given = spark.sparkContext.getCheckpointDir()  # a folder of this application's own within the one named
    if given or named:
        return (given or named).rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="crawlmill-checkpoint-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_CUTS: list[str] = []


def drop_cuts(spark: SparkSession) -> None:
    """Deletes the tables ``cut`` has written; for long sessions, once the results that need them are stored."""
    while _CUTS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    A written Parquet table rather than ``checkpoint()``: it is compressed and
    columnar, and like a checkpoint it outlives any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/crawlmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)
