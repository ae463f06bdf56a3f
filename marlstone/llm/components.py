"""Connected components of links between long ids, by alternating stars over checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import cut, release, spread_join


def _with_least(links: DataFrame) -> DataFrame:
    """links(a, b), a checkpoint, with m, the least of a and its partners; a may have any number of partners."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return spread_join(links, least, "a", "b")


def _large(links: DataFrame) -> DataFrame:
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    return _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    own = links.groupBy("a").agg(F.min("b").alias("b"))
    return _with_least(links).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct()


def _state(links: DataFrame):
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, root for every node of links(a long, b long); root is the least node of its component.

    With a number of rounds, root may be another node of its component, and not the same one for all of it. Links count both ways; links of a node to itself and repeated links change nothing. Each round at least halves the depth
    of the trees, and writes its table to the shared checkpoint folder.
    """
    now = cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    if rounds is not None:
        for _ in range(rounds):
            now = cut(_small(cut(_large(now).distinct())))
            release(links.sparkSession)
        least = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        return least.union(now.select("b").join(now.select(F.col("a").alias("b")), "b", "left_anti").distinct().select("b", F.col("b").alias("root")))
    state = _state(now)
    while state[0]:
        now = cut(_small(cut(_large(now).distinct())))
        after = _state(now)
        if after == state:
            break
        state = after
        release(links.sparkSession)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
