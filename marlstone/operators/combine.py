"""Set operations on search results, caps and summaries."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import exprs as X
from marlstone.operators.search import HANDLE, ORDER


def union_any(branches: list[DataFrame], limit: int | None = 100) -> DataFrame:
    """Rows of all branches, the first of each id, in order of branch and place."""
    tagged = [b.select(*HANDLE).withColumn("branch", F.lit(k)) for k, b in enumerate(branches)]
    every = functools.reduce(DataFrame.unionByName, tagged)
    rest = [c for c in HANDLE if c not in ("id", *ORDER)]
    one = every.groupBy("id").agg(F.min(F.struct("branch", *ORDER, *rest)).alias("r")).select("id", "r.*")
    return one if limit is None else one.orderBy("branch", *ORDER, "id").limit(limit)


def intersect_all(branches: list[DataFrame], limit: int | None = 100) -> DataFrame:
    """Rows of the first branch whose id is in all others."""
    from marlstone.operators.search import first

    found = branches[0]
    for other in branches[1:]:
        found = found.join(other.select("id").distinct(), "id", "left_semi")
    return first(found, limit)


def branches(nodes: DataFrame, conditions: list[Column], limit: int | None = None) -> DataFrame:
    """The rows of nodes that fit each condition, with branch, its number; at most limit of each. One scan for all of them."""
    fits = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in enumerate(conditions))))
    each = nodes.select(*HANDLE, F.explode(fits).alias("branch"))
    if limit is None:
        return each
    place = F.row_number().over(Window.partitionBy("branch").orderBy(*ORDER))
    return each.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def union_where(nodes: DataFrame, conditions: list[Column], each: int | None = None, limit: int | None = 100) -> DataFrame:
    """union_any() of the branches of conditions on the same nodes."""
    rest = [c for c in HANDLE if c not in ("id", *ORDER)]
    found = branches(nodes, conditions, each)
    one = found.groupBy("id").agg(F.min(F.struct("branch", *ORDER, *rest)).alias("r")).select("id", "r.*")
    return one if limit is None else one.orderBy("branch", *ORDER, "id").limit(limit)


def intersect_where(nodes: DataFrame, conditions: list[Column], each: int | None = None, limit: int | None = 100) -> DataFrame:
    """intersect_all() of the branches of conditions on the same nodes."""
    from marlstone.operators.search import first

    if each is None:
        return first(nodes.filter(functools.reduce(operator.and_, conditions)).select(*HANDLE), limit)
    rest = [c for c in HANDLE if c != "id"]
    found = branches(nodes, conditions, each).groupBy("id").agg(F.count_distinct("branch").alias("_n"), F.min(F.struct(*ORDER, *(c for c in rest if c not in ORDER))).alias("_r"))
    return first(found.filter(F.col("_n") == len(conditions)).select("id", *(f"_r.{c}" for c in rest)), limit)


def dedupe(found: DataFrame) -> DataFrame:
    """The first row of each id."""
    rest = [c for c in found.columns if c not in ("id", *ORDER)]
    return found.groupBy("id").agg(F.min(F.struct(*ORDER, *rest)).alias("r")).select("id", "r.*")


def summary(found: DataFrame, limit: int) -> DataFrame:
    """One row: matches among the first two limits' worth, truncated, returned, and tokens of those returned."""
    ranked = found.orderBy(*ORDER).limit(2 * limit).withColumn("_n", F.row_number().over(Window.orderBy(*ORDER)))
    kept = F.col("_n") <= limit
    return ranked.agg(
        F.count("*").alias("total_matches"),
        (F.count("*") > limit).alias("truncated"),
        F.count_if(kept).alias("returned"),
        F.coalesce(F.sum(F.when(kept, F.col("token_count"))), F.lit(0)).cast("long").alias("total_tokens"),
    )


def references_summary(refs: DataFrame, limit: int) -> DataFrame:
    """As summary(), for references, whose tokens are those of their previews."""
    order = ("file_path", "start_byte", "end_byte", "preview")
    ranked = refs.select(*order).orderBy(*order).limit(2 * limit).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    kept = F.col("_n") <= limit
    return ranked.agg(
        F.count("*").alias("total_matches"),
        (F.count("*") > limit).alias("truncated"),
        F.count_if(kept).alias("returned"),
        F.coalesce(F.sum(F.when(kept, X.token_count(F.col("preview")))), F.lit(0)).cast("long").alias("total_tokens"),
    )


def newest_keys(seen: DataFrame, cap: int) -> DataFrame:
    """key, first_seen of the cap keys of seen(key, at) that were inserted last; seeing a key again does not renew it."""
    once = seen.groupBy("key").agg(F.min("at").alias("first_seen"))
    return once.orderBy(F.desc("first_seen"), F.desc("key")).limit(cap)
