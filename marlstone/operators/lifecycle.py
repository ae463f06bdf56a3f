"""Incremental maintenance of an index table: what to skip, replace, drop and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import exprs as X


def plan_index(files: DataFrame, stored: DataFrame, now: int, ttl: int = 3600) -> DataFrame:
    """files(file_path, content_hash, mtime, token_count) with action: skip_fresh, skip_same_hash or index.

    Fresh is a file of the same mtime that was indexed less than ttl seconds ago, by stored(file_path, content_hash, mtime,
    indexed_at).
    """
    s = stored.select("file_path", F.col("content_hash").alias("_hash"), F.col("mtime").alias("_mtime"), F.col("indexed_at").alias("_at"))
    fresh = (F.col("mtime") == F.col("_mtime")) & (F.lit(now) - F.col("_at") < ttl)
    action = F.when(fresh, "skip_fresh").when(F.col("content_hash") == F.col("_hash"), "skip_same_hash").otherwise("index")
    return files.join(s, "file_path", "left").withColumn("action", action).drop("_hash", "_mtime", "_at")


def index_stats(planned: DataFrame) -> DataFrame:
    return planned.agg(
        F.count_if(F.col("action") == "index").alias("files_indexed"),
        F.count_if(F.col("action") != "index").alias("files_skipped"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"),
    )


def replace_files(table: DataFrame, new: DataFrame) -> DataFrame:
    """table with the rows of every file in new replaced by new's."""
    return table.join(new.select("file_path").distinct(), "file_path", "left_anti").unionByName(new)


def invalidate(files: DataFrame, glob: str | None = None) -> DataFrame:
    """files without those that fit; without all of them if no glob is given."""
    return files.filter(~X.glob_match(F.col("file_path"), glob)) if glob else files.limit(0)


def status(files: DataFrame, now: int) -> DataFrame:
    facts = files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"),
        F.max("indexed_at").alias("last_indexed"),
    )
    return facts.withColumn("age", X.humane_age(F.lit(now) - F.col("last_indexed")))
