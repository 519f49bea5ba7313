"""Exact inner-product top-k by branch and bound on a ball tree per shard, with the k-th score shared between shards.

A shard is a bounded number of vectors with a tree over them; inner nodes split their vectors at the median of the
direction in which these spread most, and every node knows its centre and radius. No vector x of a node can have an inner
product with a query q above q . centre + |q| * radius. A search takes nodes in falling order of this bound and ends when
the bound of the next lies below the k-th score so far. The k-th score of one shard is a lower end for all of them: a first
pass looks at the best leaf of each shard only and shares the largest k-th score it meets, so that most shards end their
search at the root. In a task the score goes on from shard to shard.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portage.llm.scratch import Scratch, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOP = 5
SCALE = 256
#: Numbers in the matrix of a shard, vectors of a leaf, and numbers in the queries that one pass over the shards takes.
SHARD_NUMBERS = 1 << 20
LEAF = 64
BLOCK_NUMBERS = 1 << 18
_ID, _TREE = "row_key long, vec_id {}", "row_keys array<long>, ids array<{}>, width int, vectors binary, nodes binary"
#: Sums of fewer products below 2^53 are exact in doubles.
_EXACT = 2.0**53


def whole_vectors(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[pa.RecordBatch]:
    """row_key, vec_id and vector in whole numbers, as doubles, of the rows whose components are all finite."""
    for batch in batches:
        lists = batch.column("embedding").cast(pa.list_(pa.float64()))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        values = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
        row = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore"):
            numbers = np.floor(scale * values)
        # A finite component whose product leaves the doubles has no whole number either.
        bad = np.unique(row[~np.isfinite(numbers)])
        good = np.array(lists.is_valid().to_numpy(zero_copy_only=False))
        good[bad] = False
        offsets = pa.array(np.concatenate(([0], np.cumsum(np.where(good, sizes, 0)))).astype(np.int32))
        kept = pa.ListArray.from_arrays(offsets, pa.array(numbers[good[row]]))
        columns = [batch.column("row_key"), batch.column("vec_id"), kept]
        yield pa.RecordBatch.from_arrays(columns, names=["row_key", "vec_id", "vector"]).filter(pa.array(good))


def matrix(vectors: pa.ListArray, width: int | None = None) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, which change no inner product."""
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width))
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products as exact integers; of Python's kind where doubles might round."""
    n = min(queries.shape[1], vectors.shape[1])
    queries, vectors = queries[:, :n], vectors[:, :n]
    if np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(n, 1) < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(q, v)) for v in vectors] for q in queries]
    return np.array(exact, object).reshape(len(queries), len(vectors))


def build_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the vectors, and the nodes as (first, end, left child, right child, radius, centre...); root first.

    A node's vectors stand together in the order. Children are 0 in a leaf.
    """
    order, nodes = np.arange(len(vectors)), []
    waiting = [(0, len(vectors), -1, 0)]
    while waiting:
        first, end, parent, side = waiting.pop()
        own = vectors[order[first:end]]
        with np.errstate(over="ignore", invalid="ignore"):
            centre = own.mean(axis=0)
            away = own - centre
            radius = float(np.sqrt(np.square(away).sum(axis=1).max(initial=0)))
        nodes.append([first, end, 0, 0, radius, *centre])
        if parent >= 0:
            nodes[parent][2 + side] = len(nodes) - 1
        if end - first > LEAF and 0 < radius < np.inf:
            # The direction of the vector furthest from the centre, seen from the one furthest from it.
            far = away[np.argmax(np.square(away).sum(axis=1))]
            along = away @ (far - away[np.argmax(np.square(away - far).sum(axis=1))])
            half = (end - first) // 2
            order[first:end] = order[first:end][np.argsort(along, kind="stable")]
            waiting += [(first, first + half, len(nodes) - 1, 0), (first + half, end, len(nodes) - 1, 1)]
    return order, np.array(nodes)


def build_shards(batches: Iterator[pa.RecordBatch], shard_numbers: int) -> Iterator[pa.RecordBatch]:
    """One row per shard: the keys, ids and vectors in the order of its tree, and the nodes."""
    def shard(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        vectors = matrix(pa.concat_arrays([part.column("vector") for part in parts]))
        order, nodes = build_tree(vectors)
        one = lambda name: pa.array([table.column(name).take(pa.array(order)).to_pylist()], pa.list_(table.schema.field(name).type))
        return pa.RecordBatch.from_arrays(
            [one("row_key"), one("vec_id"), pa.array([vectors.shape[1]], pa.int32()),
             pa.array([vectors[order].astype("<f8").tobytes()], pa.binary()), pa.array([nodes.astype("<f8").tobytes()], pa.binary())],
            names=["row_keys", "ids", "width", "vectors", "nodes"],
        )

    parts, rows, width = [], 0, 0
    for batch in batches:
        start = 0
        for i, size in enumerate(pc.list_value_length(batch.column("vector")).to_pylist()):
            wider = max(width, size + 1)
            if rows and (rows + 1) * wider > shard_numbers:
                if i > start:
                    parts.append(batch.slice(start, i - start))
                yield shard(parts)
                parts, rows, start, wider = [], 0, i, size + 1
            rows, width = rows + 1, wider
        if batch.num_rows > start:
            parts.append(batch.slice(start))
    if parts:
        yield shard(parts)


class Shard:
    """A shard's tree, with the bounds of all its nodes for a block of queries."""

    def __init__(self, row: dict, queries: np.ndarray):
        width = row["width"].as_py()
        self.keys = row["row_keys"].values.to_numpy()
        self.ids = row["ids"].values
        self.rank = np.empty(len(self.keys), np.int64)  # of equal scores the smaller id comes first, null last
        self.rank[pc.array_sort_indices(self.ids).to_numpy()] = np.arange(len(self.keys))
        self.vectors = np.frombuffer(row["vectors"].as_buffer(), "<f8").reshape(len(self.keys), width)
        nodes = np.frombuffer(row["nodes"].as_buffer(), "<f8").reshape(-1, 5 + width)
        self.spans = nodes[:, :4].astype(np.int64).tolist()
        n = min(width, queries.shape[1])
        centres, radius = nodes[:, 5:], nodes[:, 4]
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt(np.square(queries).sum(axis=1))
            reach = np.outer(norms, radius)
            # Room for rounding, so that no bound is too small.
            room = 1e-9 * (np.outer(norms, np.sqrt(np.square(centres).sum(axis=1))) + reach) + 1e-6
            bounds = queries[:, :n] @ centres[:, :n].T + reach + room
        self.bounds = np.where(np.isnan(bounds), np.inf, bounds)
        largest = np.abs(queries).max(initial=0) * np.abs(self.vectors).max(initial=0)
        self.exact = width == queries.shape[1] and largest * max(width, 1) < _EXACT

    def scores(self, query: np.ndarray, own_key: int, node: int, least: float) -> tuple[list[int], list[int]]:
        """Scores of at least ``least`` under a node and their places, without the query's own row."""
        first, end = self.spans[node][:2]
        own = self.vectors[first:end]
        values = (own @ query).astype(np.int64) if self.exact else products(query[None], own)[0]
        found = np.flatnonzero((values >= least) & (self.keys[first:end] != own_key))
        return values[found].tolist(), (found + first).tolist()

    def best_leaf(self, q: int) -> int:
        """The leaf that falling bounds lead to."""
        node = 0
        while self.spans[node][2]:
            left, right = self.spans[node][2:]
            node = left if self.bounds[q, left] >= self.bounds[q, right] else right
        return node

    def search(self, q: int, query: np.ndarray, own_key: int, top: int, least: float) -> list[tuple[int, int]]:
        """The best (score, place) of the shard, ``top`` at most, that reach ``least``, a lower end of the k-th of all."""
        waiting, best = [(-self.bounds[q, 0], 0)], []
        while waiting and -waiting[0][0] >= least:
            node = heapq.heappop(waiting)[1]
            left, right = self.spans[node][2:]
            if left:
                for child in (left, right):
                    heapq.heappush(waiting, (-self.bounds[q, child], child))
                continue
            for score, place in zip(*self.scores(query, own_key, node, least)):
                heapq.heappush(best, (score, -self.rank[place], place))
                if len(best) > top:
                    heapq.heappop(best)
            if len(best) == top:
                least = max(least, best[0][0])
        return [(score, place) for score, _, place in sorted(best, reverse=True)]


def _lower_double(value: int) -> float:
    """A double that is not above a whole number."""
    return float(value) if abs(value) < _EXACT else float(np.nextafter(float(value), -np.inf))


def first_scores(batches: Iterator[pa.RecordBatch], queries: np.ndarray, keys: list[int], top: int) -> Iterator[pa.RecordBatch]:
    """query and the k-th score of its best leaf, where that leaf has so many vectors."""
    best: dict[int, int] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard({name: batch.column(name)[i] for name in batch.schema.names}, queries)
            for q, key in enumerate(keys):
                scores = sorted(shard.scores(queries[q], key, shard.best_leaf(q), -np.inf)[0], reverse=True)
                if len(scores) >= top:
                    best[q] = max(best.get(q, scores[top - 1]), scores[top - 1])
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(best), pa.int32()), pa.array([_lower_double(v) for v in best.values()], pa.float64())], names=["query", "least"]
    )


def search_shards(
    batches: Iterator[pa.RecordBatch], queries: np.ndarray, keys: list[int], top: int, least: list[float]
) -> Iterator[pa.RecordBatch]:
    """query_key, vec_id and score of what may be among each query's best."""
    least = list(least)
    for batch in batches:
        for i in range(batch.num_rows):
            shard = Shard({name: batch.column(name)[i] for name in batch.schema.names}, queries)
            asked, places, scores = [], [], []
            for q, key in enumerate(keys):
                found = shard.search(q, queries[q], key, top, least[q])
                if len(found) == top:
                    least[q] = max(least[q], found[top - 1][0])
                asked += [key] * len(found)
                places += [place for _, place in found]
                scores += [score for score, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(asked, pa.int64()), shard.ids.take(pa.array(places, pa.int64())), pa.array(scores, pa.int64())],
                names=["query_key", "vec_id", "score"],
            )


def _blocks_of_queries(queries: DataFrame, block_numbers: int) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Vectors and keys of the queries, so many at a time that their matrix holds about ``block_numbers`` numbers."""
    keys, vectors, width = [], [], 0
    for row in queries.toLocalIterator():
        keys.append(row["row_key"])
        vectors.append(row["vector"])
        width = max(width, len(row["vector"]) + 1)
        if len(keys) * width >= block_numbers:
            yield matrix(pa.array(vectors, pa.list_(pa.float64()))), keys
            keys, vectors, width = [], [], 0
    if keys:
        yield matrix(pa.array(vectors, pa.list_(pa.float64()))), keys


def top_k(
    vectors: DataFrame, is_query, top: int = TOP, scale: int = SCALE, shard_numbers: int = SHARD_NUMBERS,
    block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """query_id, rank, vec_id and score: the ``top`` rows of largest integer inner product with each query's vector.

    Queries are the rows that ``is_query``, a condition on vec_id, holds for; all rows but a query's own are searched, and
    a repeated row is a row of its own. Components count as floor(scale * x). Vectors that are null, or hold a null or a
    component that is not finite, take no part; shorter vectors count as if they ended in zeros. Equal scores go by vec_id,
    null last. A score beyond 64 bits is an error. Other columns are not read.

    The driver holds one block of queries at a time; each block is two passes over the shards.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    keyed = vectors.select(F.monotonically_increasing_id().alias("row_key"), "vec_id", "embedding")
    whole = keyed.mapInArrow(lambda batches: whole_vectors(batches, scale), _ID.format(kind) + ", vector array<double>")
    whole = scratch.stored(whole, "vectors")
    numbers = whole.agg(F.sum(F.size("vector") + 1)).first()[0] or 0
    # As many tasks as there will be shards, so that they are full; no row is shuffled.
    gathered = whole.coalesce(max(1, -(-numbers // shard_numbers)))
    shards = scratch.stored(gathered.mapInArrow(lambda batches: build_shards(batches, shard_numbers), _TREE.format(kind)), "shards")
    asked = whole.where(is_query)
    schema = f"query_key long, vec_id {kind}, score long"
    found = spark.createDataFrame([], schema)
    for block, keys in _blocks_of_queries(asked, block_numbers):
        first = shards.mapInArrow(lambda batches, q=block, k=keys: first_scores(batches, q, k, top), "query int, least double")
        least = [float("-inf")] * len(keys)
        for row in first.groupBy("query").agg(F.max("least").alias("least")).collect():
            least[row["query"]] = row["least"]
        best = shards.mapInArrow(lambda batches, q=block, k=keys, l=least: search_shards(batches, q, k, top, l), schema)
        found = found.union(scratch.stored(best, "found"))
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    names = asked.select(F.col("row_key").alias("query_key"), F.col("vec_id").alias("query_id"))
    result = stored(ranked.join(names, "query_key").select("query_id", "rank", "vec_id", "score"), "nearest")
    scratch.clear()
    return result
