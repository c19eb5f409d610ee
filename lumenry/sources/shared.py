"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session names it; where it names none and all is one process (tests), a folder of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lumenry-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def table(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet and read again: what is used several times is computed once."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/lumenry-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_PREPARED: dict[tuple, str] = {}


def prepared(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries of one application share, written by the first that asks for it: ``name`` stands for how it is made, ``source`` for the input's path."""
    key = (spark.sparkContext.applicationId, shared_dir(spark), name, source)
    if key in _PREPARED:
        where = spark._jvm.org.apache.hadoop.fs.Path(_PREPARED[key])
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            del _PREPARED[key]
    if key not in _PREPARED:
        path = f"{shared_dir(spark).rstrip('/')}/lumenry-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _PREPARED[key] = path
    return spark.read.parquet(_PREPARED[key])
