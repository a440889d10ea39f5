"""The folder that driver and executors share, and tables that are kept in it."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``; where that is unset
    on one machine (as in tests) under a temporary folder that goes at exit. A
    cluster without the setting is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = os.path.join(tempfile.gettempdir(), f"cairnspark-core-{os.getpid()}")
        if not os.path.isdir(own):
            os.makedirs(own)
            atexit.register(shutil.rmtree, own, True)
        at = f"file://{own}"
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once: written to a fresh shared folder and read from
    there, however often it is used and whatever executors are lost."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is such a file or folder, on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
