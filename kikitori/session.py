"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("kikitori").config("spark.driver.memory", memory)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and the master is local (tests), one of our own. A cluster
    must name one: executors on other machines couldn't read a folder of this one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = getattr(shared_folder, "own", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="kikitori-")
            shared_folder.own = folder
    return folder.rstrip("/")


def _path(spark: SparkSession, folder: str):
    return spark._jvm.org.apache.hadoop.fs.Path(folder)


def drop_table(spark: SparkSession, folder: str) -> None:
    """Delete a table written by :func:`cut`; a missing one is no error."""
    path = _path(spark, folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    Returns the frame over the written table and the folder (for :func:`drop_table`)."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder
