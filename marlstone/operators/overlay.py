"""Changed files of a working copy laid over a shared snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.search import HANDLE, ORDER


def merge(local: DataFrame, shared: DataFrame, dirty: DataFrame, columns: tuple[str, ...] = HANDLE) -> DataFrame:
    """Local rows of dirty(path), then shared rows of all other files; the first row of each id, with its source."""
    paths = dirty.select(F.col("path").alias("file_path")).distinct()
    a = local.select(*columns).join(paths, "file_path", "left_semi").select(*columns, F.lit(0).alias("layer"))
    b = shared.select(*columns).join(paths, "file_path", "left_anti").select(*columns, F.lit(1).alias("layer"))
    rest = [c for c in columns if c not in ("id", *ORDER)]
    one = a.unionByName(b).groupBy("id").agg(F.min(F.struct("layer", *ORDER, *rest)).alias("r")).select("id", "r.*")
    return one.withColumn("source", F.when(F.col("layer") == 0, "local").otherwise("shared")).drop("layer")


def merge_refs(local: DataFrame, shared: DataFrame, dirty: DataFrame) -> DataFrame:
    """As merge(), for references, which are the same if file, lines, name and preview are."""
    paths = dirty.select(F.col("path").alias("file_path")).distinct()
    key = ["file_path", "line_start", "line_end", "name", "preview"]
    rest = ["qualifier", "ref_type", "source_id", "start_byte", "end_byte"]
    a = local.join(paths, "file_path", "left_semi").select(*key, *rest, F.lit(0).alias("layer"))
    b = shared.join(paths, "file_path", "left_anti").select(*key, *rest, F.lit(1).alias("layer"))
    one = a.unionByName(b).groupBy(*key).agg(F.min(F.struct("layer", *rest)).alias("r")).select(*key, "r.*")
    return one.withColumn("source", F.when(F.col("layer") == 0, "local").otherwise("shared")).drop("layer")


def merged_summary(merged: DataFrame, local_truncated: bool, shared_truncated: bool) -> DataFrame:
    has = F.col("content").isNotNull() if "content" in merged.columns else F.lit(False)
    return merged.agg(
        F.count("*").alias("total_matches"),
        F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"),
        F.lit(local_truncated or shared_truncated).alias("truncated"),
        F.count_if(has).alias("expanded_count"),
        ((F.count_if(has) > 0) & (F.count_if(has) == F.count("*"))).alias("auto_expanded"),
    )


def rebuild(local: DataFrame, files: DataFrame, dirty: DataFrame) -> DataFrame:
    """Nodes of the working copy: local without the files of dirty(path, status), and these, unless deleted, indexed again."""
    from marlstone.operators import index

    paths = dirty.select(F.col("path").alias("file_path"), "status").distinct()
    changed = files.join(paths.filter("status <> 'deleted'").select("file_path").distinct(), "file_path", "left_semi")
    kept = local.select(*index.NODE).join(paths.select("file_path").distinct(), "file_path", "left_anti")
    return kept.select(*index.NODE).unionByName(index.nodes(changed))


def drop_stale_provenance(provenance: DataFrame, shards: DataFrame) -> DataFrame:
    """provenance(repo_id, generation, ...) without the rows of repositories whose shard has another generation now.

    Local rows, which have no repository, stay, and so do those of unknown shards.
    """
    now = shards.select("repo_id", F.col("generation").alias("_now"))
    moved = provenance.join(now, "repo_id").filter("NOT generation <=> _now").select("repo_id").distinct()
    return provenance.join(moved, "repo_id", "left_anti")
