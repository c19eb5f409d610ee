"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its DuckDB equivalent."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _load() -> None:
    from lumenry.jobs import answer_jobs, audit_jobs, bundle_jobs, corpus_jobs, file_jobs, governance_jobs, label_jobs, loop_jobs, option_jobs, replay_jobs, reply_jobs, retrieval_jobs, run_jobs, trace_jobs  # noqa: F401


_load()
