"""Hard negatives from exact integer inner products, several candidates to one wide integer."""

import math
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import written

# Candidates whose components stand side by side in one wide integer.
FIELDS = 1024
# A shard holds so many components at most, and so many rows where there are enough shards to keep tasks busy.
SHARD_COMPONENTS = 1 << 23
SHARD_ROWS = 4096
# More shards than this get larger instead, as every anchor visits every shard.
MANY_SHARDS = 1024
# Sums of products stay below this, so that a field has at most seven bytes.
LARGEST = 1 << 55


class PackedRows:
    """Whole-number vectors, component by component in the fields of wide integers.

    A candidate's component c is stored as c + most, which is never negative, in a field of `width` bytes; so one
    multiplication by an anchor's component serves all candidates of the integer. The fields of the sum over components hold
    score + most * (sum of the anchor). Half a field is added to each, so that no field is negative and none borrows from the next.
    """

    def __init__(self, vectors: np.ndarray, most: int, width: int):
        self.most, self.width, self.rows = most, width, len(vectors)
        fields = np.ascontiguousarray((vectors + most).T).astype("<u8")
        self.wide = []
        for i in range(0, self.rows, FIELDS):
            rows = min(FIELDS, self.rows - i)
            block = np.ascontiguousarray(fields[:, i : i + rows]).view(np.uint8).reshape(len(fields), rows, 8)[:, :, :width]
            half = int.from_bytes((b"\0" * (width - 1) + b"\x80") * rows, "little")
            self.wide.append((rows, half, [int.from_bytes(c.tobytes(), "little") for c in block]))

    def scores(self, anchor: list[int]) -> np.ndarray:
        """The inner products of all rows with the anchor."""
        found = np.zeros((self.rows, 8), np.uint8)
        at = 0
        for rows, half, components in self.wide:
            total = sum(map(mul, anchor, components), half)
            found[at : at + rows, : self.width] = np.frombuffer(total.to_bytes(rows * self.width, "little"), np.uint8).reshape(rows, self.width)
            at += rows
        return found.view("<i8")[:, 0] - ((1 << (8 * self.width - 1)) + self.most * sum(anchor))


def first_rows(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of `rows`, which are in the order that breaks ties, the k of the highest scores, highest first."""
    values = scores[rows]
    if len(rows) > k:
        edge = np.partition(values, len(rows) - k)[-k]
        above = np.flatnonzero(values > edge)
        rows = rows[np.sort(np.concatenate([above, np.flatnonzero(values == edge)[: k - len(above)]]))]
        values = scores[rows]
    return rows[np.argsort(-values, kind="stable")]


def _shards(batches: Iterator[pa.RecordBatch], most: int, width: int) -> Iterator[tuple]:
    """(packed rows, ids, labels, anchors) where rows come ordered by (dimension, shard, asking, vec_id): a shard's rows are packed, then anchors stream by."""
    current, held, shard = None, [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1, 2)])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if current != (keys[0, a], keys[1, a]):
                current, held, shard = (keys[0, a], keys[1, a]), [], None
            part = batch.slice(a, b - a)
            ids, labels = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            vectors = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b - a, int(keys[0, a]))
            if not keys[2, a]:
                held.append((ids, labels, vectors))
                continue
            if shard is None:
                if not held:
                    continue
                ids_, labels_, vectors_ = (np.concatenate(x) for x in zip(*held, strict=True))
                shard, held = (PackedRows(vectors_, most, width), ids_, labels_), []
            yield *shard, zip(ids.tolist(), labels.tolist(), vectors.tolist(), part.column(6).to_pylist(), strict=True)


def _searched(rows: DataFrame, pick: Callable, columns: list[str], shards: int, most: int, width: int) -> DataFrame:
    """What `pick` (anchor's goals, scores, ids, labels, anchor's id and label) finds for each anchor in each shard, each shard a partition of its own."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed, ids, labels, anchors in _shards(batches, most, width):
            out = []
            for anchor, label, vector, goals in anchors:
                scores = packed.scores(vector)
                for place, found in pick(goals, scores, ids, labels, anchor, label):
                    out.append((np.full(len(found), anchor), np.full(len(found), place), ids[found], scores[found]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], columns)

    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("dimension", "shard", "asking", "vec_id")
    return dealt.mapInArrow(search, ", ".join(f"{c} bigint" for c in columns))


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, highest: int = 90, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, from `vectors` (vec_id, embedding, label).

    Components become floor(scale * x), scores are exact integer inner products, higher ones come first, ties go to the smaller
    vec_id. The positives of an anchor, a row that is_anchor selects, are its first `positives` other rows of its label; for
    each, the first `negatives` rows of other labels whose score is from `least` to `highest` per cent of the positive's.

    Rows are dealt evenly into shards, one to a task, and packed (`PackedRows`); the anchors are a stated query set and
    stream by each shard, once for the positives and once for the negatives. A shard gives at most `positives` and
    `positives` x `negatives` rows for an anchor; those of all shards are ranked. So a task holds one shard and a batch of anchors.

    Rows with null vec_id, label or vector, or with null, NaN or infinite components take no part. An empty vector meets empty
    ones, with score 0; vectors meet those of their own length only. A row does not meet rows of its own id. Rows repeating an
    id are separate candidates; as anchors they count once, with the smallest label and vector. An anchor without positives,
    or a positive without negatives, gives no rows. Empty table: no rows; other columns are not read. Vectors so large that a
    score could pass 2^55 are refused with ValueError.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))
    size = lambda c: F.abs(c.cast("double"))
    rows = written(good.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.size(x).alias("dimension"),
        F.aggregate(x, F.lit(0.0), lambda s, c: s + F.floor(F.lit(float(scale)) * size(c)) + 1).alias("length"),
        F.coalesce(F.array_max(F.transform(x, lambda c: F.floor(F.lit(float(scale)) * size(c)) + 1)), F.lit(0)).cast("double").alias("largest"),
    ), "negatives-rows")
    n, dimension, most, longest = rows.agg(F.count("*"), F.max("dimension"), F.max("largest"), F.max(F.when(F.col("asks"), F.col("length")))).first()
    bound = max(1.0, longest or 0.0) * 2 * max(1.0, most or 0.0)
    if bound >= LARGEST:
        raise ValueError(f"inner products of these vectors may reach {bound:.3g}; at most 2^55 is supported")
    width, most = (int(bound).bit_length() + 1 + 7) // 8, int(most or 0)
    fit = max(FIELDS, SHARD_COMPONENTS // max(1, dimension or 0))
    shards = max(1, math.ceil(n / fit), min(MANY_SHARDS, math.ceil(n / SHARD_ROWS)))

    # the table is written, so its rows have the same number in every attempt
    index = rows.select("dimension", (F.monotonically_increasing_id() % shards).cast("int").alias("shard"), F.lit(0).alias("asking"), "vec_id", "label", "vector", F.lit(None).cast("array<bigint>").alias("goals"))
    asked = rows.where("asks").groupBy("vec_id", "dimension").agg(F.min(F.struct("label", "vector")).alias("one"))
    asked = asked.groupBy("vec_id").agg(F.min_by(F.struct("dimension", "one"), "one").alias("one"))
    asked = asked.select(F.col("one.dimension").alias("dimension"), F.lit(1).alias("asking"), "vec_id", "one.one.*")

    def with_anchors(anchors: DataFrame) -> DataFrame:
        visits = anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        return index.unionByName(visits.select(*index.columns))

    def same_label(goals, scores, ids, labels, anchor, label):
        yield 0, first_rows(scores, np.flatnonzero((labels == label) & (ids != anchor)), positives)

    def other_label(goals, scores, ids, labels, anchor, label):
        others = np.flatnonzero((labels != label) & (ids != anchor))
        values = 100 * scores[others]
        for place, score in enumerate(goals, 1):
            yield place, first_rows(scores, others[(values >= least * score) & (values <= highest * score)], negatives)

    found = _searched(with_anchors(asked.withColumn("goals", F.lit(None).cast("array<bigint>"))), same_label, ["anchor_id", "place", "positive_id", "positive_score"], shards, most, width)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = written(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "negatives-positives")

    goals = best.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("goals"))
    found = _searched(with_anchors(asked.join(goals, "vec_id")), other_label, ["anchor_id", "place", "negative_id", "negative_score"], shards, most, width)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.join(best, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
