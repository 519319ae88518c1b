"""Tables written to the folder that driver and executors share, to cut a plan or to end a loop."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own; a cluster has none to offer."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df``, written and read back. ``clear`` removes it."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove all that ``kept`` has written in this process, once results are stored. The number of tables removed."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
