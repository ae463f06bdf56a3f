"""Full-text search by a positional inverted index.

A posting is a token of a node with its places there. Postings are stored in buckets of their tokens and sorted by token, so a
search reads the buckets of its own tokens, and of their files the row groups that hold them; a phrase is an intersection of
places. Postings are many times as much as their texts before they are written, so they are not shuffled: a task makes those of
a run of stored nodes in one pass, sorts them and writes a file for each bucket. A node is named by its file and place alone.
"""

from __future__ import annotations

import functools
import operator
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import exprs as X
from marlstone.operators.search import ORDER, first, phrases
from marlstone.sources.snapshots import Snapshots

#: Buckets of a new index, and postings of an Arrow batch.
BUCKETS, BATCH = 64, 50_000
COLUMNS = "token string, bucket int, file_path string, node_ord long, positions array<int>"


def _postings(buckets: int):
    def run(batches):
        import pyarrow as pa

        names = COLUMNS.replace(", ", " ").split()[::2]
        kinds = pa.string(), pa.int32(), pa.string(), pa.int64(), pa.list_(pa.int32())
        rows: list[tuple] = []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                for path, order, text in zip(*(c.to_pylist() for c in batch.slice(k, 250).columns), strict=True):
                    at: dict[str, list[int]] = {}
                    for place, token in enumerate(text.split()):
                        at.setdefault(token, []).append(place)
                    rows += ((t, zlib.crc32(t.encode("utf-8", "surrogatepass")) % buckets, path, order, p) for t, p in at.items())
                    if len(rows) >= BATCH:
                        yield out()
                        rows = []
        if rows:
            yield out()

    return run


def postings(nodes: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """token, bucket, file_path, node_ord, positions (from 0) of nodes(file_path, node_ord, content or norm_text)."""
    text = F.col("norm_text") if "norm_text" in nodes.columns else X.norm(F.col("content"))
    return nodes.select("file_path", "node_ord", F.coalesce(text, F.lit("")).alias("t")).mapInArrow(_postings(buckets), COLUMNS)


def layout() -> dict:
    return {"partition": "bucket", "local": True, "order": ["bucket", "token", "file_path", "node_ord"]}


def _holds(words: list[str]) -> Column:
    """Whether a row of columns p:token, the places of each token in a node, holds the words one after another."""
    places = [F.col(f"`p:{w}`") for w in words]
    if len(words) == 1:
        return places[0].isNotNull()
    back = lambda p, k: F.transform(p, lambda x: x - k)  # noqa: E731  a second parameter of the inner one would be the index
    starts = [back(p, k) if k else p for k, p in enumerate(places)]
    return F.coalesce(F.size(functools.reduce(F.array_intersect, starts)) > 0, F.lit(False))


def found(index: Snapshots, *any_of: str, none_of: tuple[str, ...] = (), glob: str | None = None, generation: int | None = None) -> DataFrame:
    """file_path, node_ord of the nodes that hold the terms of one of any_of and of none of none_of, see search.grep().

    Reads the buckets of the terms' tokens only.
    """
    wanted, unwanted = ([p for a in asked if (p := phrases(a)) is not None] for asked in (any_of, none_of))
    tokens = sorted({w for asked in wanted + unwanted for words in asked for w in words})
    buckets = index.manifest(generation).get("settings", {}).get("buckets", BUCKETS)
    own = sorted({zlib.crc32(t.encode("utf-8", "surrogatepass")) % buckets for t in tokens})
    rows = index.read("postings", generation, F.col("bucket").isin(own) & F.col("token").isin(tokens))
    rows = rows if glob is None else rows.filter(X.glob_match(F.col("file_path"), glob))
    if not wanted:
        return rows.select(*ORDER).limit(0)
    if wanted == [[tokens]] and len(tokens) == 1:
        return rows.select(*ORDER)
    # places travel only where a phrase needs them
    placed = {w for asked in wanted + unwanted for words in asked if len(words) > 1 for w in words}
    empty = F.array().cast("array<int>")
    each = [
        F.first(F.when(F.col("token") == t, F.col("positions") if t in placed else empty), ignorenulls=True).alias(f"p:{t}") for t in tokens
    ]
    nodes = rows.groupBy(*ORDER).agg(*each)
    either = lambda many: functools.reduce(operator.or_, (functools.reduce(operator.and_, map(_holds, p)) for p in many), F.lit(False))
    return nodes.filter(either(wanted) & ~either(unwanted)).select(*ORDER)


def grep(index: Snapshots, *any_of: str, none_of: tuple[str, ...] = (), glob: str | None = None, limit: int | None = 100, generation: int | None = None) -> DataFrame:
    """The nodes that found() names, without their content; with a limit, the first of them, and only their partitions are read."""
    hits = first(found(index, *any_of, none_of=none_of, glob=glob, generation=generation), limit)
    nodes = index.read("nodes", generation).drop("content", "norm_text")
    if limit is not None and limit <= 10_000:
        # few rows name the partitions of the nodes that are read
        parts = index.manifest(generation)["settings"]["parts"]
        keys = hits.select(*ORDER, F.pmod(F.crc32("file_path"), F.lit(parts)).cast("int").alias("part"))
        return nodes.join(F.broadcast(keys), ["part", *ORDER], "left_semi").drop("part")
    return nodes.join(hits, list(ORDER), "left_semi").drop("part")
