"""Best-fit packing: pieces of documents fill sequences by combinations of exactly the missing length."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.packing import encoder
from netloom.llm.words import small_batches

LENGTH = 2048
END_ID = 0
# Ids in one output batch.
BATCH_IDS = 1 << 20


class Complements:
    """How many pieces of each length are available, and which sums one, two or three of them have.

    `ones` and `pairs` are indexed by the sum and kept up to date as pieces are taken; a sum of three is one piece beside an
    indexed pair.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts.astype(np.int64)
        self.ones = self.counts > 0
        n = len(counts)
        some = self.ones.astype(np.float64)
        sums = np.rint(np.convolve(some, some)[:n]).astype(np.int64)
        twins = np.zeros(n, np.int64)
        twins[::2] = self.ones[: (n + 1) // 2]
        self.pairs = (sums - twins) // 2
        self.pairs[::2] += self.counts[: (n + 1) // 2] >= 2

    def take(self, length: int, times: int = 1) -> None:
        """Takes pieces of one length; a negative number puts them back."""
        before = int(self.counts[length])
        after = before - times
        self.counts[length] = after
        if (before > 0) != (after > 0):
            self.ones[length] = False
            others = np.flatnonzero(self.ones[: max(0, len(self.ones) - length)])
            self.pairs[others + length] += 1 if after else -1
            self.ones[length] = after > 0
        if (before > 1) != (after > 1) and 2 * length < len(self.pairs):
            self.pairs[2 * length] += 1 if after > 1 else -1

    def pair(self, total: int) -> tuple[int, ...]:
        """Two available pieces of that sum, the longest with its complement; empty if there are none."""
        if total < 2 or not self.pairs[total]:
            return ()
        longer = np.arange(total - 1, (total - 1) // 2, -1)
        for a in longer[self.ones[longer] & self.ones[total - longer]].tolist():
            if 2 * a != total or self.counts[a] > 1:
                return a, total - a
        return ()

    def filling(self, gap: int) -> tuple[int, ...]:
        """One, two or three available pieces that fill the gap exactly; empty if there are none."""
        if self.ones[gap]:
            return (gap,)
        two = self.pair(gap)
        if two or gap < 3:
            return two
        first = np.arange(gap - 2, 0, -1)
        for a in first[self.ones[first] & (self.pairs[gap - first] > 0)].tolist():
            self.take(a)
            two = self.pair(gap - a)
            self.take(a, -1)
            if two:
                return a, *two
        return ()


def plan(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length in a sequence, number of such sequences) that use up counts[length]; a sequence holds len(counts) - 1.

    The longest piece left opens a sequence. What is missing is filled by an exact combination, else the longest piece that fits
    goes in and the rest is tried again. A pattern is used as often as its pieces last, so the work depends on the number of
    different lengths and not on the number of pieces.
    """
    left, size, out = Complements(counts), len(counts) - 1, []
    for longest in range(size, 0, -1):
        while left.counts[longest]:
            pieces, gap = [longest], size - longest
            left.take(longest)
            while gap:
                found = left.filling(gap)
                if not found:
                    fitting = np.flatnonzero(left.ones[: gap + 1])
                    if not len(fitting):
                        break
                    found = (int(fitting[-1]),)
                for x in found:
                    left.take(x)
                pieces += found
                gap -= sum(found)
            need = Counter(pieces)
            more = min(int(left.counts[x]) // m for x, m in need.items())
            if more:
                for x, m in need.items():
                    left.take(x, m * more)
            out.append((dict(need), 1 + more))
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, copies, first_sequence, offset): from that rank on, pieces of the length stand `copies` in each sequence, at offset and after."""
    out, ranks, sequence = [], Counter(), 0
    for need, times in patterns:
        offset = 0
        for length, copies in sorted(need.items(), reverse=True):
            out.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += copies * times
            offset += copies * length
        sequence += times
    return out


def cut_pieces(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids, part, nth: the pieces of each document, numbered by length within their input partition.

    A document of more than `length` ids is cut from its end, so that only its first piece is shorter.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids", "part", "nth"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seen = encoder(path), TaskContext.get().partitionId(), [0] * (length + 1)
        last = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = code.ids(text or "") + last
                tokens = len(ids) // 4
                first = (tokens - 1) % length + 1
                for piece, stop in enumerate(range(first, tokens + 1, length)):
                    start = max(0, stop - length) if piece else 0
                    rows.append((doc_id, piece, start, stop - start, ids[4 * start : 4 * stop], part, seen[stop - start]))
                    seen[stop - start] += 1
                held += tokens
                if held > BATCH_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    columns = f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, part int, nth bigint"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(cut, columns)


def pack_best_fit(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH, carry: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: one row for each piece of a document in a sequence of at most `length` ids.

    carry: an expression over `ids` to return in place of the ids, such as a digest; the ids themselves then stay where they are.

    Each row of `docs` is tokenised whole and gets end_id; only longer ones are cut. The pieces are a table in the shared
    folder, and all of them are packed together: the number of pieces of each length (at most `length` numbers, whatever the
    size of the table) is planned into patterns, and a piece finds its place by its length and its rank among the pieces of that
    length. Ranks come from counts by input partition and length, so pieces are not sorted, and neither a frequent length nor
    the driver holds more than counts.

    ids are little-endian unsigned 32-bit numbers; the string of an added token of the file is its one id. Null and empty text
    give the one id end_id. Null and repeated doc_ids are packed like any other, row by row. Empty table: no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    pieces = written(cut_pieces(docs, path, end_id, length), "bestfit-pieces")
    counted = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "bestfit-counts")
    counts = np.zeros(length + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        counts[row["length"]] = row["n"]
    places = spark.createDataFrame(slots(plan(counts)), "length bigint, rank bigint, copies bigint, first_sequence bigint, place bigint")

    # Where along the ranks of a length a partition begins, and where a slot does; between two such ranks both stay the same.
    by_length = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.select("length", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("rank"), "part")
    bounds = parts.withColumn("slot", F.lit(None).cast("struct<copies:bigint,first_sequence:bigint,place:bigint>"))
    bounds = bounds.unionByName(places.select("length", "rank", F.lit(None).cast("int").alias("part"), F.struct("copies", "first_sequence", "place").alias("slot")))
    bounds = bounds.groupBy("length", "rank").agg(F.max("part").alias("part"), F.max("slot").alias("slot"))
    along = Window.partitionBy("length").orderBy("rank")
    holds = lambda c: F.last(F.when(F.col(c).isNotNull(), F.struct(F.col("rank").alias("since"), F.col(c).alias("value"))), ignorenulls=True).over(along)
    stretches = bounds.select(
        F.col("length").alias("of"), "rank", F.coalesce(F.lead("rank").over(along), F.lit((1 << 63) - 1)).alias("until"), holds("part").alias("p"), holds("slot").alias("s"))
    stretches = stretches.select("of", "rank", "until", F.col("p.since").alias("part_rank"), F.col("p.value").alias("in_part"), F.col("s.since").alias("slot_rank"), "s.value.*")

    carry = F.col("ids") if carry is None else carry.alias("carried")
    kept = pieces.select("doc_id", "piece", "start", "length", carry, "part", "nth")
    rank = F.col("part_rank") + F.col("nth")
    found = kept.join(stretches, (F.col("length") == F.col("of")) & (F.col("part") == F.col("in_part")) & (rank >= F.col("rank")) & (rank < F.col("until")))
    nth = rank - F.col("slot_rank")
    return found.select(
        *kept.columns[:5], (F.col("first_sequence") + ((nth - nth % F.col("copies")) / F.col("copies")).cast("bigint")).alias("sequence_id"),
        (F.col("place") + nth % F.col("copies") * F.col("length")).alias("offset"))
