"""Where intermediate tables go: only folders that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only in a local session that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = spark.conf.get("spark.evenkeel.scratch", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="evenkeel-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.evenkeel.scratch", folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends there.

    A lost executor re-reads the files; nothing is recomputed and nothing is kept on one machine.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/evenkeel-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Deletes the tables that this process has written with ``materialise``; call it when no frame that reads them is needed any more."""
    done = 0
    while _written:
        done += delete(spark, _written.pop())
    return done


def delete(spark: SparkSession, folder: str) -> bool:
    """Deletes a folder on any file system that Spark can write to; False if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
