"""Scoring, evidence packs and choice under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import exprs as X
from marlstone.operators.search import ORDER
from marlstone.sources.state import written

# Weight by node type, in the order of X.NODE_TYPES.
TYPE_WEIGHT = (0.6, 0.5, 0.2, 1.0, 0.8, 0.8, 1.0, 0.3)
#: Handles of one file that a budget expands, and lines between two that make them neighbours.
PER_FILE, LINE_GAP = 2, 2


def score(query: str, priors: dict[int, float] | None = None) -> Column:
    """Of a handle: relevance to the terms of the query, node type (a prior replaces its weight) and cost in tokens."""
    terms = X.terms_of(query)
    hay = F.concat_ws(" ", F.lower("file_path"), F.lower("preview"))
    hits = sum((F.contains(hay, F.lit(t)).cast("int") for t in terms), F.lit(0))
    relevance = F.greatest(hits / F.lit(float(len(terms))), F.lit(0.1)) if terms else F.lit(1.0)
    weights = [(priors or {}).get(k, w) for k, w in enumerate(TYPE_WEIGHT)]
    weight = F.element_at(F.array(*map(F.lit, weights)), F.col("node_type") + 1)
    cost = 1.0 / (1.0 + F.log(F.greatest(F.col("token_count"), F.lit(1)).cast("double")))
    return 0.6 * relevance + 0.25 * weight + 0.15 * cost


def evidence(found: DataFrame, query: str, max_handles: int = 8, max_per_file: int = 2) -> DataFrame:
    """The best max_handles of found, max_per_file of a file at most, with score and rank."""
    best = (F.desc("score"), "token_count", *ORDER)
    # scores are rounded so that equal ones tie on every engine
    scored = found.withColumn("score", F.round(score(query), 9))
    capped = scored.withColumn("_in_file", F.row_number().over(Window.partitionBy("file_path").orderBy(*best)))
    taken = capped.filter(F.col("_in_file") <= max_per_file).orderBy(*best).limit(max_handles)
    return taken.withColumn("rank", F.row_number().over(Window.orderBy(*best))).drop("_in_file")


def evidence_files(pack: DataFrame) -> DataFrame:
    """By file: handles in order of rank, their tokens, and the file's first rank."""
    return pack.groupBy("file_path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s.id), ",").alias("handle_ids"),
        F.sum("token_count").cast("long").alias("tokens"),
        F.min("rank").alias("first_rank"),
    )


def guidance(pack: DataFrame, totals: DataFrame, max_handles: int = 8) -> DataFrame:
    """One row of confidence and what to do next, from a pack and a one-row summary(total_matches, truncated)."""
    facts = pack.agg(
        F.count("*").alias("selected"),
        F.countDistinct("file_path").alias("files"),
        F.coalesce(F.avg(F.when(F.col("rank") <= 3, F.col("score"))), F.lit(0.0)).alias("top"),
    ).join(F.broadcast(totals.select("total_matches", "truncated")))
    signal = F.when(F.col("total_matches") == 0, 0.0).when(F.col("total_matches") < 3, 0.4).otherwise(1.0)
    raw = (
        0.55 * F.col("top")
        + 0.20 * F.least("files", F.lit(3)) / 3.0
        + 0.15 * F.least(F.col("selected") / F.lit(float(max(max_handles, 1))), F.lit(1.0))
        + 0.10 * signal
        - F.when(F.col("truncated"), 0.10).otherwise(0.0)
    )
    some = F.col("selected") > 0
    c = F.when(some, F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 9)).otherwise(0.0)
    g = facts.withColumn("confidence", c)
    stop = some & ((F.col("confidence") >= 0.55) | ((F.col("selected") >= 4) & (F.col("files") >= 2)))
    most = F.when(F.col("confidence") >= 0.75, 2).when(F.col("confidence") >= 0.5, 3).otherwise(4)
    return g.select(
        "confidence",
        F.when(F.col("confidence") < 0.35, "low").when(F.col("confidence") < 0.7, "medium").otherwise("high").alias("band"),
        stop.alias("stop_querying"),
        F.when(stop, "expand_then_answer").otherwise("refine_query").alias("action"),
        F.when(some, F.least("selected", most).cast("int")).otherwise(0).alias("expand_count"),
        F.when(~some, 2).when(stop, 0).otherwise(1).alias("more_queries"),
    )


def suggestions(pack: DataFrame, recent: DataFrame, most: int = 6) -> DataFrame:
    """Ids to expand next, position by position: the first of a pack, those of recent(id) last; if all of them are recent, those of the
    pack that are not come before them."""
    seen = pack.join(recent.select("id", F.lit(True).alias("is_recent")).distinct(), "id", "left").withColumn(
        "is_recent", F.coalesce("is_recent", F.lit(False))
    )
    facts = seen.agg(F.bool_and(F.when(F.col("rank") <= most, F.col("is_recent"))).alias("all_recent"), F.least(F.count("*"), F.lit(most)).alias("n"))
    pool = seen.join(F.broadcast(facts)).filter(F.col("all_recent") | (F.col("rank") <= most))
    place = F.row_number().over(Window.orderBy("is_recent", "rank"))
    return pool.withColumn("place", place).filter(F.col("place") <= F.col("n")).select("place", "id", "is_recent")


def choose(
    found: DataFrame, query: str, budget: int, priors: dict[int, float] | None = None, most: int | None = None, step: int = 10_000
) -> DataFrame:
    """found with chosen: by score, what fits the budget, PER_FILE of a file at most, none next to one chosen before.

    The choice goes along the handles by score, step of them at a time. What can no longer be chosen, as it is too large for what
    is left, or as its file is full or it stands next to one that was chosen, is left out by Spark before the next step is
    sorted, so each step chooses one at least. A handle that is chosen takes a token at least, so the state, which the driver
    holds, is budget handles at most, but for those of no token. most bounds the rows that are looked at, all of them by default.
    """
    small = found.withColumn("score", F.round(score(query, priors), 9)).select(
        "id", "file_path", "node_ord", "line_start", "line_end", "token_count", "score"
    )
    order = [F.desc("score"), F.asc("token_count"), *map(F.asc, ORDER), F.asc("_row")]
    ranked = small if most is None else small.orderBy(*order[:-1]).limit(most)
    rows = written(ranked.withColumn("_row", F.monotonically_increasing_id()))
    fields = {"score": -F.col("score"), **{c: F.col(c) for c in ("token_count", *ORDER, "_row")}}
    place = F.struct(*(v.alias(c) for c, v in fields.items()))
    used, taken, picked, last = 0, {}, [], None
    while used <= budget:
        left = rows.filter(F.col("token_count") <= budget - used)
        if last is not None:
            left = left.filter(place > F.struct(*(F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in last.items())))
        if taken:
            spans = [(path, a, b, len(own) >= PER_FILE) for path, own in taken.items() for a, b in own]
            known = rows.sparkSession.createDataFrame(spans, "_path string, _a int, _b int, _full boolean")
            near = (F.col("line_start") <= F.col("_b") + LINE_GAP) & (F.col("_a") <= F.col("line_end") + LINE_GAP)
            left = left.join(F.broadcast(known), (F.col("file_path") == F.col("_path")) & (F.col("_full") | near), "left_anti")
        found_now = left.orderBy(*order).limit(step).collect()
        if not found_now:
            break
        for r in found_now:
            own = taken.get(r.file_path, ())
            near = any(r.line_start <= d + LINE_GAP and c <= r.line_end + LINE_GAP for c, d in own)
            if not near and len(own) < PER_FILE and used + r.token_count <= budget:
                taken[r.file_path] = (*own, (r.line_start, r.line_end))
                used += r.token_count
                picked.append((r["_row"],))
        r = found_now[-1]
        last = {"score": -r.score, **{c: r[c] for c in ("token_count", *ORDER, "_row")}}
    chosen = rows.sparkSession.createDataFrame(picked, "_row long").withColumn("chosen", F.lit(True))
    return rows.join(F.broadcast(chosen), "_row", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))).drop("_row")


# Words that are no symbols.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "this", "that", "auth", "authentication", "token", "user", "users",
    "request", "response", "middleware", "handler", "function", "class", "method", "const", "let", "return", "true",
    "false", "null", "undefined",
)


def symbol_candidates(pack: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Identifier-like words of the previews of a pack's first eight handles by weight; ties to the longer, then by name."""
    word = F.explode(F.split("preview", r"[^\p{L}\p{N}_]+")).alias("symbol")
    low = F.lower("symbol")
    words = pack.filter(F.col("rank") <= 8).select(word).filter(F.octet_length("symbol") >= 4)
    own = words.filter(~F.col("symbol").rlike("^[0-9]") & ~low.isin(*STOP_WORDS, *X.terms_of(query)))
    weight = 1 + 2 * F.col("symbol").rlike(r"\p{Lu}").cast("int") + F.contains("symbol", F.lit("_")).cast("int")
    ranked = own.groupBy("symbol").agg(F.sum(weight).cast("long").alias("weight"))
    return ranked.orderBy(F.desc("weight"), F.desc(F.octet_length("symbol")), "symbol").limit(limit)


def top_counts(events: DataFrame, column: str, n: int = 20) -> DataFrame:
    counted = events.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "name").limit(n)
