"""Event-log analytics: acceptance by glob and node type, hit rates, retention."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import exprs as X

# Globs that count for a hit, days kept, and rows kept.
TOP_GLOBS, RETENTION_DAYS, QUERY_CAP, EXPAND_CAP = 5, 30, 10_000, 50_000


def flagged(handles: DataFrame, expands: DataFrame) -> DataFrame:
    """handles with expanded, whether an expansion of the same query and handle exists."""
    done = expands.select("query_event_id", "handle_id").distinct().withColumn("_done", F.lit(True))
    return handles.join(done, ["query_event_id", "handle_id"], "left").withColumn("expanded", F.col("_done").isNotNull()).drop("_done")


def glob_scores(queries: DataFrame, handles: DataFrame, expands: DataFrame, now: int, half_life_days: float = 7.0) -> DataFrame:
    """glob, score: the share of returned handles that were expanded, each decaying with the age of its query."""
    at = queries.select(F.col("id").alias("query_event_id"), "ts")
    rows = flagged(handles.filter("first_match_glob IS NOT NULL"), expands).join(at, "query_event_id")
    weight = X.decay(F.lit(now) - F.col("ts"), half_life_days)
    done = F.sum(F.when(F.col("expanded"), weight).otherwise(0.0))
    return rows.groupBy(F.col("first_match_glob").alias("glob")).agg((done / F.sum(weight)).alias("score"))


#: Columns of the state of decayed scores: sums of weights, all and of expanded handles, as they were at a time.
STATE = "glob string, at long, returned double, expanded double"


def _weights(rows: DataFrame, at: int, half_life_days: float, returned: bool, expanded: bool) -> DataFrame:
    """STATE of rows(first_match_glob, ts), each counted with its weight at a time that is not before any of theirs."""
    weight = X.decay(F.lit(at) - F.col("ts"), half_life_days)
    own = rows.filter("first_match_glob IS NOT NULL").groupBy(F.col("first_match_glob").alias("glob"))
    sums = own.agg(F.sum(weight if returned else F.lit(0.0)).alias("returned"), F.sum(weight if expanded else F.lit(0.0)).alias("expanded"))
    return sums.select("glob", F.lit(at).cast("long").alias("at"), "returned", "expanded")


def merge_decayed(*states: DataFrame, at: int, half_life_days: float = 7.0) -> DataFrame:
    """One STATE of several: their sums, decayed to a time that is not before theirs. Any order and grouping gives the same."""
    every = functools.reduce(DataFrame.unionByName, states)
    fade = X.decay(F.lit(at) - F.col("at"), half_life_days)
    sums = every.groupBy("glob").agg(F.sum(F.col("returned") * fade).alias("returned"), F.sum(F.col("expanded") * fade).alias("expanded"))
    return sums.select("glob", F.lit(at).cast("long").alias("at"), "returned", "expanded")


def update_decayed(
    state: DataFrame, new: tuple[DataFrame, DataFrame], known: tuple[DataFrame, DataFrame], at: int, half_life_days: float = 7.0
) -> DataFrame:
    """The STATE after new events: new and known are each handles(query_event_id, handle_id, first_match_glob, ts) and expands.

    New handles count at once, and as expanded if an expansion of theirs came before them. Known handles count as expanded by
    their first expansion; of them only those that new expansions name are looked up, so the log is not summed again. Times
    after at count as at when they come, so at must not be before them.
    """
    keys = ["query_event_id", "handle_id"]
    handles, expands = new
    fresh = expands.select(*keys).distinct().join(known[1].select(*keys).distinct(), keys, "left_anti")
    late = known[0].join(fresh, keys, "left_semi")
    ever = known[1].select(*keys).unionByName(expands.select(*keys)).distinct()
    own = handles.join(ever, keys, "left_semi")
    parts = (
        _weights(handles, at, half_life_days, True, False),
        _weights(own, at, half_life_days, False, True),
        _weights(late, at, half_life_days, False, True),
    )
    return merge_decayed(state, *parts, at=at, half_life_days=half_life_days)


def decayed_scores(state: DataFrame) -> DataFrame:
    """glob, score of a STATE, as glob_scores() of all its events; a score does not change while nothing happens."""
    return state.select("glob", (F.col("expanded") / F.col("returned")).alias("score"))


def node_type_priors(handles: DataFrame, expands: DataFrame) -> DataFrame:
    rows = flagged(handles.filter(F.col("node_type").between(0, 7)), expands)
    return rows.groupBy("node_type").agg(F.avg(F.col("expanded").cast("double")).alias("prior"))


def metrics(queries: DataFrame, handles: DataFrame, expands: DataFrame, now: int, lookback_days: float) -> DataFrame:
    """One row: sample_count, handle_expand_accept_rate, avg_tokens_per_expand, glob_hit_rate_at_k; 0 where there is nothing."""
    since = now - int(max(lookback_days, 0.0) * 86_400)
    own = queries.filter(F.col("ts") >= since)
    rows = flagged(handles.join(own.select(F.col("id").alias("query_event_id")), "query_event_id", "left_semi"), expands)
    parts = (
        own.agg(F.count("*").alias("sample_count")),
        rows.agg(F.coalesce(F.avg(F.col("expanded").cast("double")), F.lit(0.0)).alias("handle_expand_accept_rate")),
        expands.filter(F.col("expanded_at") >= since).agg(F.coalesce(F.avg("token_count"), F.lit(0.0)).alias("avg_tokens_per_expand")),
        hit_rate(own, rows),
    )
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))
    return out


def hit_rate(queries: DataFrame, flagged_handles: DataFrame) -> DataFrame:
    """One row: the share of queries' first predicted globs that an expanded handle of the query has as its first match."""
    asked = queries.filter("predicted_globs IS NOT NULL").select(
        F.col("id").alias("query_event_id"), F.posexplode(F.slice("predicted_globs", 1, TOP_GLOBS)).alias("place", "first_match_glob")
    )
    hits = flagged_handles.filter("expanded").select("query_event_id", "first_match_glob").distinct().withColumn("_hit", F.lit(1.0))
    joined = asked.join(hits, ["query_event_id", "first_match_glob"], "left")
    return joined.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0.0))), F.lit(0.0)).alias("glob_hit_rate_at_k"))


def prune(queries: DataFrame, handles: DataFrame, expands: DataFrame, now: int, query_cap: int = QUERY_CAP, expand_cap: int = EXPAND_CAP):
    """queries, handles and expands after retention: the newest rows of the last days; handles go with their query, expansions
    lose it. The caps are the store's own limits."""
    since = now - RETENTION_DAYS * 86_400
    q = queries.filter(F.col("ts") >= since).orderBy(F.desc("ts"), F.desc("id")).limit(query_cap)
    e = expands.filter(F.col("expanded_at") >= since).orderBy(F.desc("expanded_at"), F.desc("id")).limit(expand_cap)
    kept = q.select(F.col("id").alias("query_event_id"), F.lit(True).alias("_kept"))
    h = handles.join(kept.drop("_kept"), "query_event_id", "left_semi")
    e = e.join(kept, "query_event_id", "left").withColumn("query_event_id", F.when(F.col("_kept"), F.col("query_event_id"))).drop("_kept")
    return q, h, e


def latest_query(handles: DataFrame, queries: DataFrame) -> DataFrame:
    """handle_id with the query event that returned it last, by time and then id."""
    at = queries.select(F.col("id").alias("query_event_id"), "ts")
    joined = handles.select("handle_id", "query_event_id").join(at, "query_event_id")
    return joined.groupBy("handle_id").agg(F.max(F.struct("ts", "query_event_id")).alias("m")).select("handle_id", "m.query_event_id")


def answer_shape(answers: DataFrame) -> DataFrame:
    """answers(id, text) with the paths, headings, bullets and fences of each, and whether it is grounded and structured.

    Grounded: three paths or more. Structured: three headings or more, with five bullets or a fence.
    """
    lines = F.split("text", "\n")
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern)))
    shape = answers.select(
        "id",
        F.regexp_count("text", F.lit(r"[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\.[a-z]{1,4}\b")).alias("paths"),
        count(r"^#{1,6} ").alias("headings"),
        count(r"^\s*[-*] ").alias("bullets"),
        count(r"^```").alias("fences"),
    )
    return shape.withColumn("grounded", F.col("paths") >= 3).withColumn(
        "structured", (F.col("headings") >= 3) & ((F.col("bullets") >= 5) | (F.col("fences") >= 1))
    )


def append_events(folder: str, queries: DataFrame | None = None, handles: DataFrame | None = None, expands: DataFrame | None = None) -> None:
    """Appends query events, the handles they returned and expansions to the tables of these names in folder.

    A query event without globs is written with null, not with an empty list.
    """
    if queries is not None:
        globs = F.when(F.size("predicted_globs") > 0, F.col("predicted_globs"))
        queries.withColumn("predicted_globs", globs).write.mode("append").parquet(f"{folder}/queries")
    if handles is not None:
        handles.write.mode("append").parquet(f"{folder}/handles")
    if expands is not None:
        expands.write.mode("append").parquet(f"{folder}/expands")


def run_summary(runs: DataFrame) -> DataFrame:
    """One row a variant of runs(variant, tokens, duration, turns, success, grounded, structured): totals, extremes and rates."""
    rate = lambda c: F.avg(F.col(c).cast("double")).alias(f"{c}_rate")
    return runs.groupBy("variant").agg(
        F.count("*").alias("runs"),
        F.sum("tokens").cast("long").alias("tokens"),
        F.max("duration").alias("max_duration"),
        F.avg("duration").alias("avg_duration"),
        F.sum("turns").cast("long").alias("turns"),
        *map(rate, ("success", "grounded", "structured")),
    )
