"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order of distance. Each block of vectors is posted in
inverted files, one per pivot, with the pivot's place in each vector's order. A query reads the files
of its own nearest pivots and adds up, vector by vector, how far the two orders agree: with places
counted from 0 and a missing pivot at place L, the footrule distance of two orders of L pivots is
L (L + 1) - 2 * (sum over shared pivots of L - the later place). The best of each batch of a block by
footrule are compared by exact distance. Equal vectors of a batch are one posting with their ids, so copies
take one place among the best, however many there are.

Vectors and queries meet in blocks: a task has one block of queries in memory and streams one block of
vectors past it, so memory is bounded and no key decides where a row goes. Every vector is indexed.
Only the pivots (at most MAX_PIVOTS vectors, sampled) pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from togglelog.llm.storage import written

PIVOTS = 256
PLACES = 128
MAX_PIVOTS = 4096
# Of each batch as many distinct vectors as this share of its rows, but at least so many, are compared exactly.
RERANK_SHARE = 0.1
RERANK_LEAST = 100
# Rows of a block of vectors, of a batch of it, and of a block of queries.
BLOCK_VECTORS = 50_000
BATCH_VECTORS = 8192
BLOCK_QUERIES = 4096


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def pivots_of(vectors: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """Distinct vectors in the order of a hash of their components, from a bounded sample."""
    if not 0 < pivots <= MAX_PIVOTS:
        raise ValueError(f"pivots must be 1 to {MAX_PIVOTS}")
    order = F.xxhash64("vector")
    rows = vectors.select("vector", order.alias("h")).groupBy("h").agg(F.first("vector").alias("vector"))
    found = rows.orderBy("h").limit(pivots).select("vector").collect()
    return np.array([r[0] for r in found], np.float64)


def nearest(
    vectors: DataFrame, queries: Column, k: int = 10, pivots: int = PIVOTS, places: int = PLACES,
    rerank_share: float = RERANK_SHARE, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query among vectors (vec_id, embedding).

    `queries` is a condition on vec_id that says which rows ask. The score is the Euclidean distance in
    double precision; ties go to the smaller vec_id. A query is not its own neighbour, nor is any row of
    the same vec_id; repeated rows count once. Vectors that are null, zero or have null or non-finite
    components, rows with a null vec_id, and vectors of another dimension than most take no part.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    out = "query_id long, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("vector") == sizes[0]["size"])
    centres = pivots_of(rows, pivots)
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    n_blocks, n_query_blocks = -(-total // block_vectors), max(1, -(-asking // block_queries))
    places = min(places, len(centres))
    # narrow before the shuffle: 32-bit floats where the source has no more
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    packed = rows.select(
        "vec_id", F.col("vector").cast(f"array<{kind}>").alias("vector"), F.xxhash64("vec_id").alias("h"), queries.alias("asks")
    )

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    own, other = F.pmod("h", F.lit(n_blocks)).cast("int"), F.pmod("h", F.lit(n_query_blocks)).cast("int")
    answers = packed.select(own.alias("block"), F.lit(1).alias("side"), "vec_id", "vector", spread(n_query_blocks).alias("query_block"))
    asked = packed.where("asks").select(spread(n_blocks).alias("block"), F.lit(0).alias("side"), "vec_id", "vector", other.alias("query_block"))
    keys = ["block", "query_block"]
    met = answers.unionByName(asked).repartition(max(1, n_blocks * n_query_blocks), *keys).sortWithinPartitions(*keys, "side", "vec_id")
    found = met.select("block", "query_block", "side", "vec_id", "vector").mapInArrow(searcher(centres, places, k, rerank_share), out)
    best = written(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "neighbours")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def pivot_orders(vectors: np.ndarray, centres: np.ndarray, places: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; of equally near ones the first."""
    far = (centres**2).sum(axis=1)[None] - 2 * vectors @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :places]


class InvertedFiles:
    """Postings of a batch of vectors: for each pivot the vectors that hold it, and L - its place."""

    def __init__(self, orders: np.ndarray, pivots: int):
        n, self.places = orders.shape
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = (by_pivot // self.places).astype(np.int32)
        self.weights = (self.places - by_pivot % self.places).astype(np.float32)
        self.starts = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))
        self.size = n

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """For each vector, half of L (L + 1) less its footrule distance to an order."""
        rows, weights = [], []
        for place, pivot in enumerate(order.tolist()):
            start, stop = self.starts[pivot], self.starts[pivot + 1]
            rows.append(self.rows[start:stop])
            weights.append(np.minimum(self.weights[start:stop], self.places - place))
        return np.bincount(np.concatenate(rows), np.concatenate(weights), self.size)


def searcher(centres: np.ndarray, places: int, k: int, share: float) -> Callable:
    """Over rows sorted by (block, query_block, side, vec_id): the k best of each block for each query."""

    def search(ids: list, vectors: list, asked: tuple, best: list) -> None:
        """Look through one batch of a block; best[q] keeps the k nearest so far."""
        query_ids, query_vectors, query_orders = asked
        ids, (data, groups) = np.array(ids, np.int64), equal_vectors(np.concatenate(vectors))
        # k + 1 ids are enough: the query itself may be one of them
        holders = [np.unique(ids[rows])[: k + 1].tolist() for rows in groups]
        files = InvertedFiles(pivot_orders(data, centres, places), len(centres))
        most = min(len(data), max(RERANK_LEAST, k + 1, int(share * len(ids))))
        for q, order in enumerate(query_orders):
            near = np.argsort(-files.agreement(order), kind="stable")[:most]
            far = np.sqrt(((data[near] - query_vectors[q]) ** 2).sum(axis=1))
            some = _least(far, k)
            found = {(d, v) for d, g in zip(far[some].tolist(), near[some].tolist()) for v in holders[g] if v != query_ids[q]}
            best[q] = sorted(found.union(best[q]))[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        waiting: tuple[list, list] = ([], [])
        query_ids: list[int] = []
        query_parts: list[np.ndarray] = []
        asked, best = None, []

        def flush() -> None:
            nonlocal asked, best
            if waiting[0] and query_ids:
                if asked is None:
                    data = np.concatenate(query_parts)
                    asked, best = (query_ids, data, pivot_orders(data, centres, places)), [[] for _ in query_ids]
                search(*waiting, asked, best)
            waiting[0].clear()
            waiting[1].clear()

        def results() -> pa.RecordBatch:
            rows = [(q, v, s) for q, found in zip(query_ids, best) for s, v in found]
            columns = zip(*rows) if rows else ((), (), ())
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds)], ["query_id", "vec_id", "score"])

        for batch in batches:
            block, query_block, side, ids = (batch.column(i).to_numpy() for i in range(4))
            lists = batch.column(4)
            data = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
            cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(query_block) != 0) | (np.diff(side) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(ids)]):
                if start == stop:
                    continue
                now = (block[start], query_block[start])
                if now != key:
                    flush()
                    if best:
                        yield results()
                    key, query_ids, query_parts, asked, best = now, [], [], None, []
                if side[start] == 0:
                    query_ids += ids[start:stop].tolist()
                    query_parts.append(data[start:stop])
                    continue
                for at in range(start, stop, BATCH_VECTORS):
                    end = min(at + BATCH_VECTORS, stop)
                    waiting[0].extend(ids[at:end].tolist())
                    waiting[1].append(data[at:end])
                    if len(waiting[0]) >= BATCH_VECTORS:
                        flush()
        flush()
        if best:
            yield results()

    return run


def equal_vectors(data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct vectors in the order they come in, and the rows of each."""
    data = np.ascontiguousarray(data + 0.0)  # no negative zeros
    whole = data.view(np.dtype((np.void, data.itemsize * data.shape[1]))).ravel()
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    group = place[group.ravel()]
    rows = np.argsort(group, kind="stable")
    return data[first[order]], np.split(rows, np.cumsum(np.bincount(group))[:-1])


def _least(far: np.ndarray, k: int) -> np.ndarray:
    """Places of the k + 1 least distances, and of all equal to the last of these."""
    last = min(k, len(far) - 1)
    return np.flatnonzero(far <= np.partition(far, last)[last])
