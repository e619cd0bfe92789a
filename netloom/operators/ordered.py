"""Ordered computations inside a group that may hold most of all rows.

A window over such a group would put it into one task. Here the group is cut into order-preserving
chunks, each chunk is a window of its own, and only one row per chunk meets in the window that adds
up the chunks. The cut is by the first of `levels`; a chunk of more than `hot` rows is cut again by
the second level and the third. All levels must be consistent with the order of rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
CHUNK = ["chunk0", "chunk1", "chunk2"]


def with_chunks(df: DataFrame, part: list[str], levels: list[str], hot: int | None = HOT_ROWS) -> DataFrame:
    """Add chunk0..chunk2. The finer levels, numbers, are -1 where the first level is small enough.

    hot None: the first level alone bounds a chunk, as a range of sequence numbers does, and nothing is counted.
    """
    first = F.expr(levels[0])
    if hot is None:
        return df.withColumns({"chunk0": first, "chunk1": F.lit(0).cast("bigint"), "chunk2": F.lit(0).cast("bigint")})
    crowded = (
        df.select(*part, first.alias("chunk0")).groupBy(*part, "chunk0").count()
        .where(F.col("count") > hot).select(*part, "chunk0", F.lit(True).alias("crowded"))
    )
    whole = df.withColumn("chunk0", first)
    if crowded.isEmpty():  # one count; the plans that follow then need no join to cut
        return whole.withColumns({f"chunk{i}": F.lit(-1 if i < len(levels) else 0).cast("bigint") for i in (1, 2)})
    cut = whole.join(crowded, [*part, "chunk0"], "left")
    finer = {
        f"chunk{i}": F.when(F.col("crowded"), F.expr(levels[i])).otherwise(F.lit(-1)) if i < len(levels) else F.lit(0)
        for i in (1, 2)
    }
    return cut.withColumns(finer).drop("crowded")


def _prefix(chunks: DataFrame, part: list[str], value: str, fold) -> DataFrame:
    """Exclusive running fold of `value` over chunks, in two steps: inside chunk0, then over chunk0."""
    inside = Window.partitionBy(*part, "chunk0").orderBy("chunk1", "chunk2").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*part).orderBy("chunk0").rowsBetween(Window.unboundedPreceding, -1)
    coarse = chunks.groupBy(*part, "chunk0").agg(fold(value).alias("v")).withColumn("outer", fold("v").over(across)).drop("v")
    return chunks.withColumn("inner", fold(value).over(inside)).join(coarse, [*part, "chunk0"])


def _attach(df: DataFrame, chunks: DataFrame, part: list[str], columns: list[str]) -> DataFrame:
    """Bring the per-chunk columns to the rows; the join key is the key of the window that follows."""
    return df.join(chunks.select(*part, *CHUNK, *columns), [*part, *CHUNK], "left")


def global_rank(df: DataFrame, part, levels, order, name: str, start: int = 0, hot: int | None = HOT_ROWS) -> DataFrame:
    """Place of each row in its group under a total order."""
    cut = with_chunks(df, part, levels, hot)
    counts = cut.groupBy(*part, *CHUNK).agg(F.count(F.lit(1)).alias("n"))
    offsets = _prefix(counts, part, "n", F.sum).select(
        *part, *CHUNK, (F.coalesce("outer", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("offset_")
    )
    local = Window.partitionBy(*part, *CHUNK).orderBy(*order)
    placed = _attach(cut, offsets, part, ["offset_"])
    return placed.withColumn(name, (F.col("offset_") + F.row_number().over(local) - 1 + start).cast("bigint")).drop(*CHUNK, "offset_")


def running_max(df: DataFrame, part, levels, order, value: str, name: str, hot: int = HOT_ROWS) -> DataFrame:
    """Largest `value` so far, this row included, under a total order."""
    cut = with_chunks(df, part, levels, hot)
    tops = cut.groupBy(*part, *CHUNK).agg(F.max(value).alias("top"))
    before = _prefix(tops, part, "top", F.max).select(*part, *CHUNK, F.greatest("outer", "inner").alias("before_"))
    local = Window.partitionBy(*part, *CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _attach(cut, before, part, ["before_"])
        .withColumn(name, F.greatest(F.col("before_"), F.max(value).over(local)))
        .drop(*CHUNK, "before_")
    )


def runs(df: DataFrame, part, levels, order, label: str, name: str, hot: int = HOT_ROWS) -> DataFrame:
    """Number the runs of equal neighbouring `label`s, from 0, under a total order."""
    cut = with_chunks(df, part, levels, hot)
    local = Window.partitionBy(*part, *CHUNK).orderBy(*order)
    changed = F.when(F.lag(label).over(local) != F.col(label), 1).otherwise(0)
    marked = cut.withColumn("changed_", changed)
    edge = F.struct(*order)
    chunks = marked.groupBy(*part, *CHUNK).agg(
        F.min_by(label, edge).alias("head"), F.max_by(label, edge).alias("tail"), F.sum("changed_").alias("inner_changes")
    )
    inside = Window.partitionBy(*part, "chunk0").orderBy("chunk1", "chunk2")
    firsts = chunks.groupBy(*part, "chunk0").agg(F.max_by("tail", F.struct("chunk1", "chunk2")).alias("tail0"))
    across = Window.partitionBy(*part).orderBy("chunk0")
    previous = firsts.withColumn("tail_before", F.lag("tail0").over(across)).drop("tail0")
    chunks = chunks.join(previous, [*part, "chunk0"]).withColumn("prev_tail", F.coalesce(F.lag("tail").over(inside), "tail_before"))
    chunks = chunks.withColumn("jump", F.when(F.col("prev_tail") != F.col("head"), 1).otherwise(0))
    chunks = chunks.withColumn("changes", F.col("jump") + F.col("inner_changes"))
    offsets = _prefix(chunks, part, "changes", F.sum).select(
        *part, *CHUNK, (F.coalesce("outer", F.lit(0)) + F.coalesce("inner", F.lit(0)) + F.col("jump")).alias("offset_")
    )
    so_far = local.rowsBetween(Window.unboundedPreceding, 0)
    return (
        _attach(marked, offsets, part, ["offset_"])
        .withColumn(name, (F.col("offset_") + F.sum("changed_").over(so_far)).cast("bigint"))
        .drop(*CHUNK, "offset_", "changed_")
    )


def running(df: DataFrame, part, levels, order, folds: dict, hot: int = HOT_ROWS) -> DataFrame:
    """Inclusive running folds. `folds` maps a column to (aggregate, combine); the result is `<column>_upto`.

    `aggregate` is an aggregate function that also runs over windows, `combine` joins two partial results.
    """
    cut = with_chunks(df, part, levels, hot)
    totals = cut.groupBy(*part, *CHUNK).agg(*[agg(c).alias(c) for c, (agg, _) in folds.items()])
    inside = Window.partitionBy(*part, "chunk0").orderBy("chunk1", "chunk2").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*part).orderBy("chunk0").rowsBetween(Window.unboundedPreceding, -1)
    coarse = totals.groupBy(*part, "chunk0").agg(*[agg(c).alias(c) for c, (agg, _) in folds.items()])
    coarse = coarse.select(*part, "chunk0", *[F.coalesce(agg(c).over(across), F.lit(0)).alias(f"{c}_outer") for c, (agg, _) in folds.items()])
    fine = totals.select(*part, *CHUNK, *[F.coalesce(agg(c).over(inside), F.lit(0)).alias(f"{c}_inner") for c, (agg, _) in folds.items()])
    before = fine.join(coarse, [*part, "chunk0"]).select(
        *part, *CHUNK, *[both(F.col(f"{c}_outer"), F.col(f"{c}_inner")).alias(f"{c}_before") for c, (_, both) in folds.items()]
    )
    local = Window.partitionBy(*part, *CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _attach(cut, before, part, [f"{c}_before" for c in folds])
    return joined.withColumns({
        f"{c}_upto": both(F.col(f"{c}_before"), F.coalesce(agg(c).over(local), F.lit(0))) for c, (agg, both) in folds.items()
    }).drop(*CHUNK, *[f"{c}_before" for c in folds])


def nearest_value(df: DataFrame, part, levels, order, value: str, name: str, ahead: bool = False, own: bool = False, hot: int = HOT_ROWS) -> DataFrame:
    """The last `value` that is not null before each row (`ahead`: the first after it) under a total order; `own`: the row itself counts.

    Of each chunk one value goes on to the chunks that follow, so nothing but values of chunks crosses them.
    """
    turned = [F.desc(x) if ahead else F.asc(x) for x in order]
    cut = with_chunks(df, part, levels, hot)
    there = lambda place: F.when(F.col(value).isNotNull(), place)
    edge = F.min_by if ahead else F.max_by
    chunks = cut.groupBy(*part, *CHUNK).agg(edge(value, there(F.struct(*order))).alias(value))
    coarse = chunks.groupBy(*part, "chunk0").agg(edge(value, there(F.struct("chunk1", "chunk2"))).alias(value))

    def passed(window: list, *by: str):
        by = [F.desc(x) if ahead else F.asc(x) for x in by]
        return F.last(value, ignorenulls=True).over(Window.partitionBy(*window).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))

    across = coarse.select(*part, "chunk0", passed(part, "chunk0").alias("outer_"))
    before = chunks.withColumn("inner_", passed([*part, "chunk0"], "chunk1", "chunk2")).join(across, [*part, "chunk0"])
    before = before.select(*part, *CHUNK, F.coalesce("inner_", "outer_").alias("before_"))
    local = Window.partitionBy(*part, *CHUNK).orderBy(*turned).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    joined = _attach(cut, before, part, ["before_"])
    return joined.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(local), "before_")).drop(*CHUNK, "before_")


ADD = (F.sum, lambda a, b: a + b)
XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
# for values above 0, as a fold over nothing gives 0
MAX = (F.max, F.greatest)
