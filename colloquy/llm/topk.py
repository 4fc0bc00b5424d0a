"""Exact top-k search by inner product in M-trees.

Each batch of rows that a task reads becomes an M-tree.  Inner products turn into a metric by
one more dimension: with every row lengthened to the batch's longest, the nearest row of a query is that
with the highest product.  A node is a page of entries, each with a routing vector, a covering radius and
its distance from the node's own routing vector.  The search takes the page with the least bound first.
Before it computes a distance it bounds it from stored ones by the triangle inequality, and it
drops what cannot reach the best k found in any batch so far.  Scores are whole numbers.

The queries are sent to the tasks in blocks of ``QUERY_BLOCK``; a block is one pass over the rows, which stay
where they are.  What is shuffled is k rows a query and task.  With several blocks each one's results are written before
the next is sent, so that driver and workers hold one block at a time.

Nulls: rows without an id or a vector take no part.  Vectors may have any length.  Ties go to the smaller id;
repeated rows are rows each.  Empty tables, or no queries, give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import cut_lineage, table, written

K = 5
QUERY_BLOCK = 4096
PAGE = 512
FAN = 8
#: Slack for distances in floating point, as a part of the largest one.
SLACK = 1e-9


class MTree:
    """Over rows of numbers; ``ids`` break ties."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, seed: int = 5):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows[order].astype(np.float64), ids[order]
        squares = (self.rows**2).sum(axis=1)
        self.limit = squares.max()
        self.points = np.concatenate([self.rows, np.sqrt(self.limit - squares)[:, None]], axis=1)
        self.rng = np.random.default_rng(seed)
        self.pages: list[tuple] = []
        every = np.arange(len(rows))
        self.root = self.build(every, self.points[0])

    def build(self, members: np.ndarray, routing: np.ndarray) -> int:
        """Makes the page of some rows under a routing vector, and all pages below; returns its number."""
        away = np.sqrt(((self.points[members] - routing) ** 2).sum(axis=1))
        page = len(self.pages)
        self.pages.append(())
        if len(members) <= PAGE or away.max() == away.min() == 0:
            by = np.argsort(away, kind="stable")
            self.pages[page] = (True, self.rows[members[by]], self.ids[members[by]], away[by])
            return page
        pivots = self.points[self.rng.choice(members, FAN, replace=False)]
        squares = (pivots**2).sum(axis=1)[None, :] - 2 * self.points[members] @ pivots.T
        nearest = squares.argmin(axis=1)
        if (nearest == nearest[0]).all():  # many equal rows: cut by count
            nearest = np.arange(len(members)) * FAN // len(members)
        routings, radii, parents, below = [], [], [], []
        for j in np.unique(nearest):
            part = members[nearest == j]
            routings.append(pivots[j])
            radii.append(np.sqrt(((self.points[part] - pivots[j]) ** 2).sum(axis=1)).max())
            parents.append(np.sqrt(((pivots[j] - routing) ** 2).sum()))
            below.append(self.build(part, pivots[j]))
        self.pages[page] = (False, np.array(routings), np.array(radii), np.array(parents), below)
        return page

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple[float, int]]) -> None:
        """Improves ``best``, a heap of (score, -id) with the worst first, for one query vector."""
        length = float(query @ query)
        point = np.append(query, 0.0)
        slack = SLACK * (np.sqrt(length) + np.sqrt(self.limit) + 1)

        def reach() -> float:
            """The farthest that a row can be and still enter."""
            if len(best) < k:
                return np.inf
            return np.sqrt(max(0.0, length + self.limit - 2 * best[0][0])) + slack

        far = reach()
        queue = [(0.0, self.root, np.sqrt(((point - self.points[0]) ** 2).sum()))]
        while queue:
            bound, page, away = heapq.heappop(queue)
            if bound > far:
                break
            node = self.pages[page]
            if node[0]:
                _, rows, ids, stored = node
                # rows stand in the order of their distances: those that the triangle leaves are a slice
                near = slice(*np.searchsorted(stored, (away - far, away + far + slack)))
                scores = rows[near] @ query
                hits = range(len(scores)) if len(best) < k else np.flatnonzero(scores >= best[0][0])
                for i in hits:
                    entry = (float(scores[i]), -int(ids[near][i]))
                    if entry[1] != -own:
                        if len(best) < k:
                            heapq.heappush(best, entry)
                        elif entry > best[0]:
                            heapq.heapreplace(best, entry)
                far = reach()
            else:
                _, routings, radii, parents, below = node
                maybe = np.flatnonzero(np.abs(away - parents) - radii <= far)
                distances = np.sqrt(((routings[maybe] - point) ** 2).sum(axis=1))
                least = np.maximum(bound, distances - radii[maybe])
                for j in np.flatnonzero(least <= far):
                    heapq.heappush(queue, (float(least[j]), below[maybe[j]], float(distances[j])))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones end in zeros."""
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, *, id_col: str = "vec_id", vector_col: str = "vector", query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` rows with the highest inner products of each query.

    Both tables have an id and an array<long> column; ties go to the smaller id, and a row with the
    query's id is none of its results.  Rows without an id or a vector take no part; a shorter vector counts
    as if it ended in zeros; repeated rows are rows each, and repeated queries share the ranks of their id,
    each with results of its own.  Products are exact: it raises where lengths allow for one of 2 to the power 53 or more.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    asked = cut_lineage(asked.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("copies")))  # k ranks hold no more
    n_blocks = max(1, -(-asked.count() // query_block))
    parts = []
    for block in range(n_blocks):
        own = asked.where(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)) == block).toArrow()
        width = max([0, *own.column("v").combine_chunks().value_lengths().to_pylist()])
        vectors = matrix(own.column("v").combine_chunks(), width).astype(np.float64)
        sent = spark.sparkContext.broadcast((own.column("id").to_numpy(), vectors, own.column("copies").to_numpy()))

        def scan(batches, sent=sent):
            ids, vectors, copies = sent.value
            longest_query = np.sqrt((vectors**2).sum(axis=1).max(initial=0))
            best: list[list] = [[] for _ in ids]
            for batch in batches:
                if not batch.num_rows:
                    continue
                column = batch.column(1)
                longest = max(vectors.shape[1], max(column.value_lengths().to_pylist()))
                tree = MTree(matrix(column, longest), batch.column(0).to_numpy())
                if longest_query * np.sqrt(tree.limit) >= 2**53:
                    raise OverflowError("inner products may exceed what doubles hold exactly")
                wide = np.zeros((len(ids), longest))
                wide[:, : vectors.shape[1]] = vectors
                for i in range(len(ids)):
                    tree.search(wide[i], int(ids[i]), k, best[i])
            found = [(int(q), -x, int(score)) for q, heap, n in zip(ids, best, copies, strict=True) for score, x in heap for _ in range(n)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

        part = rows.mapInArrow(scan, "query_id long, vec_id long, score long")
        if n_blocks > 1:
            part = written(part, "top")
            sent.unpersist()
        parts.append(part)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_numbers(rows: DataFrame, vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Adds ``vector``: each component's floor after scaling; null if a component is null or not finite."""
    x = F.col(vector_col)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return rows.withColumn("vector", F.when(x.isNotNull() & F.coalesce(good, F.lit(False)), scaled))


def op6_topk(spark, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(rows, rows.where("vec_id % 50 = 0"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND list_bool_and(list_transform(embedding, lambda x: isfinite(x::DOUBLE)))),
p AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
