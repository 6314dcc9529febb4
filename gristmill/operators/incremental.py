"""Incremental maintenance: upserts by key, expiring caches, restartable chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_rows(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows whose key the state lacks."""
    return df.join(state.select(key), key, "left_anti")


def updated_rows(df: DataFrame, state: DataFrame, key: str, modified: str, since: Column) -> DataFrame:
    """Rows whose key the state has and that were modified after `since`; a null time is no change."""
    return df.join(state.select(key), key, "left_semi").filter(F.col(modified) > since)


def upsert(state: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """The state with the changed rows in place of their predecessors; running it twice changes nothing more."""
    return state.join(changed.select(key), key, "left_anti").unionByName(changed)


def update_snapshot(state: DataFrame, df: DataFrame, key: str, modified: str, since: Column, at: Column) -> tuple[DataFrame, DataFrame]:
    """(the new state, one row of history: at, new, updated): rows that the state lacks or that changed after `since` come in.

    The state is a snapshot to be written anew; an index over it is fitted on the new one.
    """
    fresh, changed = new_rows(df, state, key), updated_rows(df, state, key, modified, since)
    both = fresh.withColumn("__new", F.lit(1)).unionByName(changed.withColumn("__new", F.lit(0)))
    history = both.agg(F.coalesce(F.sum("__new"), F.lit(0)).alias("new"), F.coalesce(F.sum(1 - F.col("__new")), F.lit(0)).alias("updated"))
    return upsert(state, both.drop("__new"), key), history.select(at.alias("at"), "new", "updated")


def valid_entries(cache: DataFrame, now: Column, ttl_seconds: float, at: str = "ts") -> DataFrame:
    """Entries younger than the time to live; `at` is seconds since 1970."""
    return cache.filter(now - F.col(at) < ttl_seconds)


def cache_key(identity: Column, content: Column) -> Column:
    """An identity and a digest of the content, the same in every process."""
    return F.concat_ws("_", identity, F.sha2(content, 256))


def pending_chunks(df: DataFrame, key: str, chunk: int, done: DataFrame) -> DataFrame:
    """Rows of the chunks of `chunk` consecutive keys that `done` (chunk_id) lacks, with their chunk_id."""
    return df.withColumn("chunk_id", F.floor(F.col(key) / chunk).cast("bigint")).join(done.select("chunk_id"), "chunk_id", "left_anti")


def run_chunks(df: DataFrame, key: str, chunk: int, folder: str, work: Callable[[DataFrame], DataFrame]) -> int:
    """Apply `work` to the chunks not yet written to `folder` and append them by chunk; gives how many rows were left.

    A run that broke off leaves whole chunk folders; the next run starts after them.
    """
    spark = df.sparkSession
    try:
        done = spark.read.parquet(folder).select("chunk_id").distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        # Nothing is written yet.
        done = spark.createDataFrame([], "chunk_id bigint")
    left = pending_chunks(df, key, chunk, done)
    n = left.count()
    if n:
        work(left).write.mode("append").partitionBy("chunk_id").parquet(folder)
    return n
