"""Exact top-k inner products by ball trees, one per shard of the vectors.

Queries go out in blocks of bounded size, each against all shards. A shard is a run of a partition's rows, at most shard_rows
of them: no vector is shuffled. Its ball tree is searched best node first, nodes being ordered by the upper bound of an inner
product inside their ball, query . centre + |query| radius; a node below the query's current k-th score is cut off. The k-th
scores that a pilot shard reaches are shared with all tasks, so every shard starts from them, and a task's shards pass theirs
on to its next.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import cut

LEAF = 64
#: Query components of a broadcast block.
BLOCK_CELLS = 4_000_000


class BallTree:
    """Over the rows of x; equal rows belong together, as they were merged before."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x, self.leaf = x, leaf
        self.order = np.arange(len(x))
        self.bounds: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        todo = [(0, len(x), None)]
        while todo:
            a, b, slot = todo.pop()
            node = len(self.bounds)
            if slot is not None:
                parent, side = slot
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            own = x[self.order[a:b]]
            centre = own.mean(0)
            away = ((own - centre) ** 2).sum(1)
            self.bounds.append((a, b))
            self.children.append(None)
            centres.append(centre)
            radii.append(float(np.sqrt(away.max())))
            if b - a > leaf and radii[-1] > 0:
                # halves by nearness to two far points
                first = own[away.argmax()]
                second = own[((own - first) ** 2).sum(1).argmax()]
                side = own @ (second - first)
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(side, half)]
                todo += [(a, a + half, (node, 0)), (a + half, b, (node, 1))]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.sizes = np.sqrt((self.centres**2).sum(1))

    def above(self, q: np.ndarray, bound, visit) -> None:
        """Visits leaves' rows best bound first while a node's bound reaches bound(), which visit may raise."""
        length = np.sqrt(q @ q)
        # what rounding may take from a score or a bound grows with the vectors
        upper = self.centres @ q + length * self.radii + 1e-10 * length * (self.sizes + self.radii)
        heap = [(-upper[0], 0)]
        while heap:
            best, node = heapq.heappop(heap)
            if -best < bound():
                return
            if self.children[node] is None:
                a, b = self.bounds[node]
                visit(self.order[a:b])
            else:
                for child in self.children[node]:
                    if upper[child] >= bound():
                        heapq.heappush(heap, (-upper[child], child))


def _top(ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _merged(ids: np.ndarray, x: np.ndarray, most: int):
    """Distinct rows of x, and the most smallest ids of each, as flat arrays with offsets; an id that is there several times
    may be the query's own, so as many more are kept."""
    most += int(np.unique(ids, return_counts=True)[1].max()) - 1 if len(ids) else 0
    distinct, at = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, at.ravel()))
    at, ids = at.ravel()[order], ids[order]
    first = np.searchsorted(at, np.arange(len(distinct)))
    kept = np.arange(len(at)) - first[at] < most
    return distinct, ids[kept], np.searchsorted(at[kept], np.arange(len(distinct) + 1))


def _search(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray):
    """(query row, id, score) of the best k of each query among the shard's rows; floor: shared k-th scores, raised here."""
    distinct, flat, at = _merged(ids, x, k + 1)
    tree = BallTree(distinct)
    out = []
    # whole numbers below 2**53 are exact as doubles, and so are their sums; larger scores are summed as integers
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    whole = distinct.astype(np.int64) if largest >= 2**53 else None
    for row in range(len(q)):
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def bound():
            return max(floor[row], best[-1]) if len(best) >= k else floor[row]  # noqa: B023

        def visit(rows):
            nonlocal best_ids, best
            if whole is None:
                scores = (distinct[rows] @ q[row]).astype(np.int64)  # noqa: B023
            else:
                scores = whole[rows] @ q[row].astype(np.int64)  # noqa: B023
            rows, scores = rows[scores >= bound()], scores[scores >= bound()]
            if not len(rows):
                return
            new = np.concatenate([flat[at[r] : at[r + 1]] for r in rows])
            new_scores = np.repeat(scores, at[rows + 1] - at[rows])
            other = new != qids[row]  # noqa: B023
            best_ids, best = _top(np.concatenate((best_ids, new[other])), np.concatenate((best, new_scores[other])), k)

        tree.above(q[row], bound, visit)
        if len(best) >= k:
            floor[row] = max(floor[row], best[-1])
        out += [(row, i, s) for i, s in zip(best_ids.tolist(), best.tolist(), strict=True)]
    return out


def _against(vectors: DataFrame, block, k: int, shard_rows: int) -> DataFrame:
    """query_id, vec_id, score: each shard's best k of vectors(vec_id, v) for the block's queries."""

    def run(batches):
        import pyarrow as pa

        qids, q, floor = block.value
        floor = floor.copy()

        def solve(parts):
            ids = np.concatenate([p[0] for p in parts])
            x = np.concatenate([p[1] for p in parts])
            made = _search(ids, x, qids, q, k, floor)
            rows = np.array([m[0] for m in made], np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(qids[rows]),
                    pa.array(np.array([m[1] for m in made], np.int64)),
                    pa.array(np.array([m[2] for m in made], np.int64)),
                ],
                names=["query_id", "vec_id", "score"],
            )

        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            for a in range(0, len(ids), shard_rows):
                held.append((ids[a : a + shard_rows], x[a : a + shard_rows]))
                n += len(held[-1][0])
                if n >= shard_rows:
                    yield solve(held)
                    held, n = [], 0
        if held:
            yield solve(held)

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def _floors(queries: DataFrame, pilot, k: int) -> DataFrame:
    """queries(vec_id, v) with floor, the k-th score that the pilot's (ids, rows) give a query; made in tasks, some queries at once."""

    def run(batches):
        import pyarrow as pa

        ids, x = pilot.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1_000):
                part = batch.slice(a, 1_000)
                qids = part.column(0).to_numpy(zero_copy_only=False)
                scores = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(qids), -1) @ x.T
                scores[ids[None, :] == qids[:, None]] = -np.inf
                floor = np.partition(scores, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(qids), -np.inf)
                # a little lower, by more than rounding
                floor = np.where(np.isfinite(floor), floor - 1e-9 * np.abs(floor), -np.inf)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(floor, pa.float64())], names=["vec_id", "v", "floor"])

    return queries.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, floor double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def vectors_of(table: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, v: floor(scale * component) as doubles; without null vectors, null ids, and null or non-finite components."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("double"))
    return (
        table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
        .filter(F.coalesce(sound, F.lit(False)))
        .select("vec_id", whole.alias("v"))
    )


def _matrix(column, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(rows, -1)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 20_000, block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of each of queries(vec_id, v) with vectors(vec_id, v).

    A row of the query's own id is no candidate; ties go to the smaller vec_id; with fewer rows than k, all are returned.
    Vectors of another length than the query's are not compared. Of several queries with one id, the first by components
    counts; rows repeated in vectors are candidates each. Components are whole numbers, and scores must fit a long. Empty tables
    give no rows; further columns are ignored. The driver holds one block of queries and a pilot of shard_rows / 10 vectors.
    """
    context = vectors.sparkSession.sparkContext
    vectors = vectors.withColumn("n", F.size("v"))
    one = cut(queries.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("n", F.size("v")))
    parts = []
    for length in one.groupBy("n").agg(F.count("*").alias("queries")).orderBy("n").collect():
        blocks = -(-length.queries * max(1, length.n) // block_cells)
        rows = vectors.filter(F.col("n") == length.n).select("vec_id", "v")
        asked = one.filter(F.col("n") == length.n).select("vec_id", "v")
        taken = rows.limit(max(1, min(shard_rows // 10, block_cells // max(1, length.n)))).toArrow()
        if taken.num_rows and length.n:
            ids = taken.column(0).to_numpy()
            asked = cut(_floors(asked, context.broadcast((ids, _matrix(taken.column(1), len(ids)))), k))
        else:
            asked = asked.withColumn("floor", F.lit(float("-inf")))
        for b in range(blocks):
            own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
            if not own.num_rows:
                continue
            qids = own.column(0).to_numpy()
            held = context.broadcast((qids, _matrix(own.column(1), len(qids)), own.column(2).to_numpy()))
            # what a block found is at most k rows per query once it is merged
            parts.append(cut(_best(_against(rows, held, k, shard_rows), k)) if blocks > 1 else _best(_against(rows, held, k, shard_rows), k))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", F.col("score").cast("long"))
