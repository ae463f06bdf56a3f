"""Handles to their text, with staleness checks; local and shared copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import exprs as X


def expand(ids: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """ids(position, id) with status and, where ok, content.

    nodes(id, file_path, start_byte, end_byte, indexed_hash) as indexed; files(file_path, content, content_hash) as they are.
    Ids with and without their h are the same. not_found: no such node or no such file; stale: the file has changed. Nodes are
    reduced to those asked for, and files to theirs, before their content is joined.
    """
    key = F.concat(F.lit("h"), X.raw_id(F.col("id")))
    asked = ids.select("position", key.alias("id"))
    n = nodes.select("id", "file_path", "start_byte", "end_byte", "indexed_hash")
    known = asked.join(n, "id", "left")
    f = files.select("file_path", "content", "content_hash").join(known.select("file_path").distinct(), "file_path", "left_semi")
    joined = known.join(f, "file_path", "left")
    status = (
        F.when(F.col("indexed_hash").isNull() | F.col("content_hash").isNull(), "not_found")
        .when(F.col("indexed_hash") != F.col("content_hash"), "stale")
        .otherwise("ok")
    )
    return joined.select("position", "id", "file_path", status.alias("status"), F.when(status == "ok", X.byte_slice(F.col("content"), F.col("start_byte"), F.col("end_byte"))).alias("content"))


def require_all(expanded: DataFrame) -> DataFrame:
    """expanded as it is; raises if a handle is missing or stale."""
    bad = expanded.filter("status <> 'ok'").select("id", "status").limit(5).collect()
    if bad:
        raise LookupError(", ".join(f"{r.id} {r.status}" for r in bad))
    return expanded


def auto_expand(found: DataFrame, budget: int) -> DataFrame:
    """found(id, token_count, content) with content kept for all rows if their tokens fit the budget, and for none otherwise."""
    total = found.agg((F.coalesce(F.sum("token_count"), F.lit(0)) <= budget).alias("fit"))
    return found.join(F.broadcast(total)).withColumn("content", F.when(F.col("fit") & (F.lit(budget) > 0), F.col("content"))).drop("fit")


def budget_expand(found: DataFrame, query: str, budget: int, priors: dict[int, float] | None = None) -> DataFrame:
    """found with content kept for all rows if their tokens fit the budget, else for those that rank.choose() takes."""
    from marlstone.operators.rank import choose

    total = found.agg((F.coalesce(F.sum("token_count"), F.lit(0)) <= budget).alias("_fit"))
    chosen = choose(found, query, budget, priors).select("id", "chosen")
    kept = (F.col("_fit") | F.col("chosen")) & (F.lit(budget) > 0)
    return found.join(chosen, "id").join(F.broadcast(total)).withColumn("content", F.when(kept, F.col("content"))).drop("_fit", "chosen")


def expand_note(expanded: DataFrame) -> DataFrame:
    """One row: counts of expand_summary(), auto_expanded if no row is without content, and a note where some are."""
    total = F.coalesce(F.sum("token_count"), F.lit(0)).cast("long")
    facts = expanded.agg(
        F.count_if(F.col("content").isNotNull()).alias("expanded_count"),
        F.coalesce(F.sum(F.when(F.col("content").isNotNull(), F.col("token_count"))), F.lit(0)).cast("long").alias("expanded_tokens"),
        F.count("*").alias("handles"),
        total.alias("total_tokens"),
    )
    note = F.format_string("Expanded %d/%d handles (%d/%d tokens).", "expanded_count", "handles", "expanded_tokens", "total_tokens")
    every = F.col("expanded_count") == F.col("handles")
    return facts.withColumn("auto_expanded", every).withColumn("note", F.when(~every, note))


def expand_summary(expanded: DataFrame) -> DataFrame:
    """One row: handles that have content, and their tokens."""
    has = F.col("content").isNotNull()
    return expanded.agg(
        F.count_if(has).alias("expanded_count"),
        F.coalesce(F.sum(F.when(has, F.col("token_count"))), F.lit(0)).cast("long").alias("expanded_tokens"),
        F.count("*").alias("handles"),
    )


def by_provenance(ids: DataFrame, local: DataFrame, shared: DataFrame) -> DataFrame:
    """Distinct ids with source (local before shared) and content; failed where neither has it."""
    a = local.select("id", F.col("content").alias("_local"))
    b = shared.select("id", F.col("content").alias("_shared"))
    joined = ids.select("id").distinct().join(a, "id", "left").join(b, "id", "left")
    source = F.when(F.col("_local").isNotNull(), "local").when(F.col("_shared").isNotNull(), "shared").otherwise("failed")
    return joined.select("id", source.alias("source"), F.coalesce("_local", "_shared").alias("content"))


def check_generation(handles: DataFrame, shards: DataFrame) -> DataFrame:
    """handles(id, repo_id, generation) with status: ok, conflict if the shard has moved on, or not_ready if it has no snapshot."""
    s = shards.select("repo_id", F.col("generation").alias("_now"), F.col("status").alias("_status"))
    status = (
        F.when(F.col("_status").isNull() | (F.col("_status") != "ready"), "not_ready")
        .when(F.col("generation") != F.col("_now"), "conflict")
        .otherwise("ok")
    )
    return handles.join(s, "repo_id", "left").withColumn("status", status).drop("_now", "_status")
