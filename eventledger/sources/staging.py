"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a folder of this machine if that is all the session has (local master, as in tests), else an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(spark.sparkContext, "_eventledger_dir", None)
    if own is None:
        own = spark.sparkContext._eventledger_dir = "file://" + tempfile.mkdtemp(prefix="eventledger-")
    return own


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    The folder is removed when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        where = jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
