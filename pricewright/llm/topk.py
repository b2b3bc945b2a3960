"""Exact top-k search by inner product with ball trees and branch and bound.

The vectors are dealt into shards, and each shard's ball tree is built once and written as one row. Copies
of the queries go to the trees, are streamed past them in blocks, and open balls best bound first. Before
that each query searches one shard alone; the k-th score found there goes along to all other shards as
the score to beat, so that they open only balls that can still hold a better one.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewright.llm.common import cut, partitions

LEAF = 64
#: So many queries are held against a tree together.
BLOCK_QUERIES = 1024
#: Scores are long; one beyond that range counts as the end of it.
LEAST, MOST = -(2**63), 2**63 - 1


def integer_vector(embedding: Column) -> Column:
    """floor(256 * x) of every component, or null if the vector or a component is null or not finite."""
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(embedding.isNotNull() & F.coalesce(fine, F.lit(False)), whole)


class BallTree:
    """A binary tree of balls over integer vectors; ``bound`` of a ball is above every score in it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.order = np.arange(len(ids))
        self.spans: list[tuple[int, int]] = []  # the rows of each ball, in ``order``
        self.children: list[tuple[int, int] | None] = []
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._grow(0, len(ids))
        self.ids, self.vectors = self.ids[self.order], self.vectors[self.order]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)
        self.largest = max((abs(int(x)) for x in (self.vectors.min(initial=0), self.vectors.max(initial=0))), default=0)

    def _grow(self, start: int, end: int) -> int:
        me, points = len(self.spans), self.vectors[self.order[start:end]].astype("f8")
        centre = points.mean(0)
        distance = np.sqrt(((points - centre) ** 2).sum(1))
        self.spans.append((start, end))
        self.centres.append(centre)
        self.radii.append(float(distance.max()))
        self.children.append(None)
        if end - start > LEAF and distance.max() > 0:
            far = points[distance.argmax()]
            other = points[((points - far) ** 2).sum(1).argmax()]
            side = (points @ (other - far)).argsort(kind="stable")
            self.order[start:end] = self.order[start:end][side]
            half = (start + end) // 2
            self.children[me] = (self._grow(start, half), self._grow(half, end))
        return me

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: list[int | None], k: int) -> tuple[list, int]:
        """The k best (score, -id) of each query, but for its own row; ``floors`` are scores others have found already.

        Returns the found (query, id, score) and the number of balls opened.
        """
        asked = queries.astype("f8")
        norms = np.sqrt((asked**2).sum(1))
        # A bound is a float; the slack is far above its rounding and below the step of an integer score.
        bounds = asked @ self.centres.T + norms[:, None] * self.radii[None] * (1 + 1e-9)
        bounds += 1e-9 * (np.abs(bounds) + norms[:, None] * np.sqrt((self.centres**2).sum(1))[None] + 1) + 1e-3
        # Scores are exact in floats as long as they stay under 2**53; beyond that Python's integers take over.
        limit = max(self.largest, 1) * max(abs(int(queries.min(initial=0))), abs(int(queries.max(initial=0))), 1) * max(queries.shape[1], 1)
        exact = limit < 2**53
        vectors, asked = (self.vectors.astype("f8"), asked) if exact else (self.vectors.astype(object), queries.astype(object))
        found, opened = [], 0
        for q, bound in enumerate(bounds):
            best: list[tuple[int, int]] = []  # a heap of (score, -id) with the worst on top
            floor = floors[q]
            heap = [(-bound[0], 0)]
            while heap:
                least, node = heapq.heappop(heap)
                worst = best[0][0] if len(best) == k else floor
                if worst is not None and max(LEAST, min(-least, MOST)) < worst:
                    break
                opened += 1
                if self.children[node]:
                    for child in self.children[node]:
                        heapq.heappush(heap, (-bound[child], child))
                    continue
                start, end = self.spans[node]
                scores = vectors[start:end] @ asked[q]
                for row in np.flatnonzero(scores >= worst) if worst is not None and exact else range(end - start):
                    own = int(self.ids[start + row])
                    entry = (max(LEAST, min(MOST, int(scores[row]))), -own)
                    if own == query_ids[q] or floor is not None and entry[0] < floor:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
            found += [(int(query_ids[q]), -i, s) for s, i in best]
        return found, opened


FOUND = "query_id long, vec_id long, score long"


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _meet(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Searches each tree (shard, tree) for the queries (shard, query_id, vector, floor) sent to its shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, mine = None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            ends = np.append(np.flatnonzero(np.diff(shards)) + 1, len(shards))
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                if shards[start] != mine:  # the tree stands before the queries of its shard; an empty shard has none
                    tree, mine, raw = None, shards[start], batch.column(1)[start].as_py()
                    if raw is not None:
                        tree, start = pickle.loads(raw), start + 1
                for at in range(start, end, BLOCK_QUERIES) if tree else ():
                    part = batch.slice(at, min(BLOCK_QUERIES, end - at))
                    found, _ = tree.search(part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).to_pylist(), k)
                    columns = zip(*found, strict=True) if found else [[]] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    first = trees.select("shard", "tree", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<long>").alias("vector"), F.lit(None).cast("long").alias("floor"))
    both = first.unionByName(queries.select("shard", F.lit(None).cast("binary").alias("tree"), "query_id", "vector", "floor"))
    return both.repartition("shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first()).mapInArrow(search, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 32_768) -> DataFrame:
    """The ``k`` vectors with the highest inner product for each query: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and an integer ``vector``, ``queries`` query_id and ``vector``; rows whose
    id or vector is null take no part; a query finds vectors of its own length only. Ties go to the smaller
    id; fewer candidates give fewer rows; a query never finds the rows with its own id; of a query id that is
    repeated the least vector counts; repeated vectors are each found. A score beyond a long is the
    greatest or least long. Memory per task is one shard and one block of queries, whatever the size of the
    tables.
    """
    vectors = vectors.where("vec_id is not null and vector is not null").select("vec_id", "vector", F.size("vector").alias("length"))
    queries = queries.where("query_id is not null and vector is not null").groupBy("query_id").agg(F.min("vector").alias("vector")).withColumn("length", F.size("vector"))
    # So many shards of each length; small tables are dealt to as many tasks as there are, if that is worth it.
    most = partitions(vectors.sparkSession)
    shards = cut(vectors.groupBy("length").agg(F.greatest(F.ceil(F.count("*") / shard_rows), F.least(F.lit(most), F.ceil(F.count("*") / 2048))).cast("long").alias("shards")))
    name = lambda number: (F.shiftleft(F.col("length").cast("long"), 32) + number).alias("shard")
    placed = vectors.join(shards, "length").select("vec_id", "vector", name(F.pmod(F.xxhash64("vec_id"), F.col("shards"))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = BallTree(rows["vec_id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype("i8"))
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "tree": [pickle.dumps(tree)]})

    trees = cut(placed.groupBy("shard").applyInPandas(grow, "shard long, tree binary"))
    asked = queries.join(shards, "length").withColumn("home", F.pmod(F.xxhash64("query_id"), F.col("shards")))
    first = cut(_best(_meet(trees, asked.select(name(F.col("home")), "query_id", "vector", F.lit(None).cast("long").alias("floor")), k), k))
    floors = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    others = asked.join(floors, "query_id", "left").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))).where("other != home")
    rest = _meet(trees, others.select(name(F.col("other")), "query_id", "vector", "floor"), k)
    return _best(first.select("query_id", "vec_id", "score").unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Searches all rows for those whose id ``every`` divides, on vectors in 256ths, rounded down."""
    rows = embeddings.select("vec_id", integer_vector(F.col("embedding")).alias("vector"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return top_k(rows, queries, k)
