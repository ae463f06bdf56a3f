"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws the key -ln(u) / weight: u is a hash of its id and the seed, weight its quality. Sorted by that key
within its source, the documents' sizes are prefix-summed against the source's budget. A budget above the source's size is
met by complete epochs first and a fractional one after; the document at the edge of the fraction is cut to the budget.

No source is sorted in one task: keys fall into ranges whose count follows the number of documents of the source, ranges
are prefix-summed by their totals, and only documents of one range are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import WORD, cut, fits, keyed

#: Sources whose budgets are broadcast at most; beyond, budgets are joined by a shuffle.
BROADCAST_SOURCES = 100_000
#: Documents of a key range, about.
RANGE_ROWS = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """From 1 to 2: the higher, the more of the text is lower-case letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{Ll}]+", ""))
    return F.coalesce(1.0 + letters / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sources(source, source_size) with target: share of all sizes split by weight, none above most times its size.

    Sources take the weights in turn, by code point, null last. A source reaches its cap before another if its cap over its
    weight is smaller; in that order, the level is what the rest divides by the weights not yet capped. The windows run over
    one row per source, not over documents.
    """
    ordered = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    w = sources.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = w.select(
        "*",
        (
            (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        ).alias("level"),
    )
    # the level of the first source that stays below its cap holds for all after it
    free = F.when(F.col("ratio") > F.col("level"), F.struct(F.col("ratio").alias("r"), F.col("level").alias("level")))
    w = w.withColumn("held", F.min(free).over(everything))
    return w.select(
        "source",
        "source_size",
        F.when(F.col("held").isNull() | (F.col("ratio") < F.col("held.r")), F.col("cap"))
        .otherwise(F.col("weight") * F.col("held.level"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Every document of docs(doc_id, text, source) with size, source_size, target and taken; keep names further columns.

    Null and empty texts have size 0 and are taken 0 times; null sources are one source. Documents with equal keys go by
    doc_id, then size; rows equal in both differ in nothing that counts. An empty table gives no rows. Further columns,
    whatever their names, are left out unless named in keep.
    """
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    sized = cut(
        docs.select(
            *dict.fromkeys(("doc_id", "source", *keep)),
            word_count(F.col("text")).alias("size"),
            (-F.log(u) / quality_weight(F.col("text"))).alias("_key"),
        ).withColumn("_source", keyed("source"))
    )
    totals = cut(sized.groupBy("_source").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("_n")))
    budget = (
        targets(totals.select("source", "source_size"), weights, share, most)
        .withColumn("_source", keyed("source"))
        .join(totals.select("_source", "_n"), "_source")
        .drop("source")
        .withColumn("_ranges", F.ceil(F.col("_n") / RANGE_ROWS))
    )
    budget = cut(budget)
    if fits(budget, BROADCAST_SOURCES):
        budget = F.broadcast(budget)
    # 1 - exp(-key) rises with the key and spreads it over 0 to 1
    ranged = (
        sized.join(budget, "_source")
        .withColumn("_range", F.least(F.floor((1 - F.exp(-F.col("_key"))) * F.col("_ranges")), F.col("_ranges") - 1))
        .repartition("_source", "_range")
    )
    by_range = ranged.groupBy("_source", "_range").agg(F.sum("size").alias("_range_size"))
    offsets = by_range.select(
        "_source",
        "_range",
        F.coalesce(
            F.sum("_range_size").over(
                Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    within = (
        Window.partitionBy("_source", "_range")
        .orderBy("_key", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = ranged.join(offsets, ["_source", "_range"]).withColumn(
        "_before", F.col("_offset") + F.sum("size").over(within) - F.col("size")
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    return placed.select(
        *dict.fromkeys(("doc_id", *keep)), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )
