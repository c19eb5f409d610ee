"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a Python worker at once where a table is written.
ARROW_ROWS = 1000

#: Byte table: A-Z to a-z; every ASCII byte that is neither digit nor letter to a space.
#: UTF-8 bytes from 0x80 up stay, so non-ASCII characters belong to words.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split() if text else []


def crc_bucket(column: str, n: int):
    """crc32 of the column's text form, modulo n; a null id falls into bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow whose function yields column dicts; Arrow types follow the Spark schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for columns in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()  # workers live on after the task

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, one is made if all is one process (tests); a cluster must name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lumenry-checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    return where


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this holds, at most ARROW_ROWS rows go to a Python worker at once: whole texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(ARROW_ROWS, int(before)) if int(before) > 0 else ARROW_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(df: DataFrame) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumenry-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
