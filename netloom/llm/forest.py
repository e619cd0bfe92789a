"""Nearest neighbours by inner product in a forest of hash prefixes."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TREES = 80
BITS = 32  # length of a hash string
SHARD_ROWS = 32_768  # rows of one forest
BLOCK_QUERIES = 1_024  # queries that one building of a forest serves
MOST_TASKS = 20_000  # beyond so many pairs of shard and block a task has several, one after the other
# Expected share of the nearest that a search may miss, by the collision law of the hash.
MISS = 0.07


def usable(vector: Column) -> Column:
    """Not null, with components, all finite, not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """Sorted hash strings of one shard, a tree at a time.

    A bit tells the side of a random plane. Vectors get one more component that makes all norms equal to the largest, and
    queries get 0 there; so the angle falls as the inner product grows.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5):
        self.ids, self.vectors = ids, vectors
        self.small = vectors.astype(np.float32)
        norms = (vectors**2).sum(axis=1)
        self.norm = math.sqrt(norms.max())
        lifted = np.column_stack([self.small, np.sqrt(np.maximum(norms.max() - norms, 0))]).astype(np.float32)
        self.planes = np.random.default_rng(seed).standard_normal((TREES, BITS, lifted.shape[1])).astype(np.float32)
        self.order, self.strings = [], []
        for tree in range(TREES):
            strings = self._hash(lifted, tree)
            order = np.argsort(strings, kind="stable")
            self.order.append(order)
            self.strings.append(strings[order])

    def _hash(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        bits = (vectors @ self.planes[tree].T) > 0
        return bits @ (np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, vector ids, scores) of the k nearest found, nearest first."""
        lifted = np.column_stack([queries, np.zeros(len(queries))]).astype(np.float32)
        ranges = np.zeros((BITS + 1, TREES, len(ids), 2), np.int32)  # rows of each prefix length, in each tree
        for tree in range(TREES):
            strings = self._hash(lifted, tree)
            for level in range(BITS + 1):
                low = strings >> np.uint64(BITS - level) << np.uint64(BITS - level)
                ranges[level, tree, :, 0] = np.searchsorted(self.strings[tree], low, "left")
                ranges[level, tree, :, 1] = np.searchsorted(self.strings[tree], low + np.uint64((1 << (BITS - level)) - 1), "right")
        for row, query in enumerate(queries):
            yield int(ids[row]), *self._climb(ids[row], query, ranges[:, :, row], k)

    def _climb(self, own: int, query: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """From the longest matches up, all trees at once, until what is still outside is expected to hold few of the k nearest."""
        widths = (ranges[:, :, 1] - ranges[:, :, 0]).sum(axis=1)
        level = int(np.flatnonzero(widths > k)[-1]) if widths[0] > k else 0
        seen = np.zeros(len(self.ids), bool)
        seen[self.ids == own] = True
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.float32)
        small, length = query.astype(np.float32), math.sqrt((query**2).sum())
        new = np.zeros(len(self.ids), bool)
        spans = ranges.tolist()
        past = [(a, a) for a, _ in spans[level]]  # what the level before has marked lies inside; only both sides are new
        while True:
            for order, (a, b), (low, high) in zip(self.order, spans[level], past, strict=True):
                if a < low:
                    new[order[a:low]] = True
                if high < b:
                    new[order[high:b]] = True
            past = spans[level]
            fresh = np.flatnonzero(new & ~seen)
            seen |= new
            found = np.concatenate([found, fresh])
            scores = np.concatenate([scores, self.small[fresh] @ small])
            if level == 0:
                break
            if len(found) >= k:
                best = np.partition(scores, len(scores) - k)[-k:]
                same = 1 - np.arccos(np.clip(best / (length * self.norm), -1, 1)) / math.pi
                if ((1 - same**level) ** TREES).mean() <= MISS:
                    break
            level -= 1
        if len(found) > k:  # exact scores for all that single precision cannot tell from the k-th
            edge = np.partition(scores, len(scores) - k)[-k]
            found = found[scores >= edge - 1e-4 * length * self.norm]
        exact = (self.vectors[found] * query).sum(axis=1)
        top = np.lexsort((self.ids[found], -exact))[:k]
        return self.ids[found[top]], exact[top]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (dimension, pair, is_query): the vectors of a shard are indexed, then a block of queries streams by."""
    current, held, forest = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if current != (keys[0, a], keys[1, a]):
                current, held, forest = (keys[0, a], keys[1, a]), [], None
            ids = batch.column(3).slice(a, b - a).to_numpy()
            vectors = _matrix(batch.column(4).slice(a, b - a), b - a)
            if not keys[2, a]:
                held.append((ids, vectors))
                continue
            if forest is None:
                if not held:
                    continue
                forest, held = Forest(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])), []
            for i in range(0, b - a, 64):
                out = list(forest.search(ids[i : i + 64], vectors[i : i + 64], k))
                column = [np.concatenate(x) for x in zip(*((np.full(len(v), q), v, s) for q, v, s in out), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(column[0], pa.int64()), pa.array(column[1], pa.int64()), pa.array(column[2], pa.float64())], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of `vectors` (vec_id, embedding) that is_query selects.

    Every row is indexed. Rows are dealt into shards of bounded size by a digest of their id; in each shard every tree is a
    sorted array of hash strings. A query descends to its longest matching prefixes in all trees, then ascends in all trees
    together, one bit at a time, until the expected share of the k nearest that no tree shares a prefix with is at most
    MISS, given the similarities found so far. So searches in clustered data end early, and in unclustered data they
    go on as far as the recall asks. The stated queries visit all shards in blocks, a task for each shard and block; the
    best k of all shards are ranked.

    Scores are inner products of the given components in double precision, ties go to the smaller vec_id; with fewer than k
    others, all are returned. Vectors null, empty, zero or with null or non-finite components take no part, neither do rows
    with a null id. Vectors meet those of their own length only. A query does not meet rows of its own id. Rows repeating an
    id are separate candidates; as queries they count once. Empty table: no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    good = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    good = good.withColumn("dimension", F.size("vector"))
    asking = good.where("asks").dropDuplicates(["vec_id"])
    shards, blocks = max(1, math.ceil(good.count() / SHARD_ROWS)), max(1, math.ceil(asking.count() / BLOCK_QUERIES))
    tasks = min(shards * blocks, MOST_TASKS)

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def pair(shard: Column, block: Column):
        return (shard * F.lit(blocks) + block).cast("bigint").alias("pair")

    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks))
    index = good.select("dimension", "vec_id", "vector", shard.alias("shard"), every(blocks).alias("block"), F.lit(0).alias("asking"))
    asked = asking.select("dimension", "vec_id", "vector", every(shards).alias("shard"), block.alias("block"), F.lit(1).alias("asking"))
    rows = index.unionByName(asked).select("dimension", pair(F.col("shard"), F.col("block")), "asking", "vec_id", "vector")
    rows = rows.repartitionById(tasks, F.pmod("pair", F.lit(tasks)).cast("int")).sortWithinPartitions("dimension", "pair", "asking")
    found = rows.mapInArrow(lambda b: _searched(b, k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
