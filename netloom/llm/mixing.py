"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.common import WORD, written

# Rows of one order cell, and of the last slot, that a single task sorts.
CELL_ROWS = 20_000
EDGE_ROWS = 200_000
SLOTS = 65_536
# Sources whose cuts are sent to all tasks; more are joined by source.
BROADCAST_SOURCES = 100_000


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked_weights(docs: DataFrame, weights: list[int]) -> DataFrame:
    """(source, weight): the sources by code point, null last, weigh the given numbers in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    return docs.select("source").distinct().select("source", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).alias("weight"))


def targets(sizes: DataFrame, weights: DataFrame, repeats: int, budget: int | None) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the budget by weight, at most `repeats` times the source's size.

    The excess of capped sources is shared by weight among the others until none is above its cap. In the order of cap
    over weight, the sources before some place are capped; the level is the first share that its own source can take.
    Windows here run over one row for each source.
    """
    known = sizes.alias("s").join(weights.select(F.col("source").alias("w_source"), "weight"), F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
    known = known.withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).withColumn("cap", F.col("source_size") * repeats)
    live = known.where("weight > 0").withColumn("full", F.col("cap") / F.col("weight"))
    all_sizes = sizes.agg(F.sum("source_size").alias("all_size"))
    order = Window.orderBy("full", F.col("source").asc_nulls_last())
    total = F.lit(budget).cast("bigint") if budget is not None else F.sum("source_size").over(Window.partitionBy())
    if budget is None:  # sources without weight still count for the budget
        live = live.join(F.broadcast(all_sizes))
        total = F.col("all_size")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    live = live.withColumn("level", (total - before).cast("double") / rest).withColumn("place", F.row_number().over(order))
    level = F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.col("place"))).over(Window.partitionBy())
    live = live.withColumn("found", level)
    share = F.least(F.col("cap").cast("double"), F.coalesce(F.col("found") * F.col("weight"), F.col("cap").cast("double")))
    live = live.select("source", "source_size", F.greatest(share, F.lit(0.0)).alias("target"))
    return live.unionByName(known.where("weight <= 0").select("source", "source_size", F.lit(0.0).alias("target")))


def mark_of(seed: str) -> Column:
    """The place of a document in the shuffled order of its source: 16 hexadecimal digits."""
    return F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 16)


def mix(docs: DataFrame, weights: DataFrame, repeats: int = 3, budget: int | None = None, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, first_finish: one row for each row of `docs`.

    Each source is a queue of its documents, shuffled by a digest of seed and id, gone through up to `repeats` times.
    The virtual finish time of a document is the source's words up to its end over the source's target. All queues are
    served in the order of finish times and cut where the budget is used up, so at any point each source is within
    one document of its share. Whole documents only; the one that would cross the budget is left out.

    Running sums are exact at any size without a task that holds a source: a source is cut into cells by the leading
    digits of the shuffle digest, cells are summed and only rows of one cell are ordered. The global order is cut into
    slots of finish time; only the slot in which the budget ends is sorted, after being refined to a bounded number of rows.

    size: words of the text unless given. Null text: size 0. Documents of size 0 are never taken. A null source is a source.
    Rows with the same id are taken in the order of size; null ids come first. Empty table: no rows.
    """
    size = words_of(F.col("text")) if size is None else size.cast("bigint")
    sized = written(docs.select("doc_id", "source", F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).alias("size"), mark_of(seed).alias("mark")), "mix-sizes")
    digits = 0
    count = sized.count()
    while digits < 6 and CELL_ROWS * 16**digits < count:
        digits += 1
    sized = sized.withColumn("cell", F.substring("mark", 1, digits) if digits else F.lit(""))
    cells = written(sized.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "mix-cells")
    aims = targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, repeats, budget)
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("offset", F.coalesce(F.sum("cell_size").over(before), F.lit(0)))
    cells = cells.join(aims.withColumnRenamed("source", "a_source"), F.col("source").eqNullSafe(F.col("a_source"))).drop("a_source", "cell_size")
    cells = cells.withColumnRenamed("source", "c_source").withColumnRenamed("cell", "c_cell")
    inside = Window.partitionBy("source", "cell").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = sized.withColumn("inside", F.sum("size").over(inside))
    queue = queue.join(cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell")))
    queue = written(queue.select("doc_id", "source", "size", "mark", "source_size", "target", (F.col("offset") + F.col("inside")).alias("end")), "mix-queue")

    def finish(turn: Column) -> Column:
        return F.when((F.col("size") > 0) & (F.col("target") > 0), (turn * F.col("source_size") + F.col("end")).cast("double") / F.col("target"))

    copies = queue.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("turn")).withColumn("finish", finish(F.col("turn"))).where("finish IS NOT NULL")
    total = budget
    if total is None:
        total = aims.agg(F.round(F.sum("target")).cast("bigint")).first()[0] or 0
    low, high, used = _edge(copies, total)
    order = Window.orderBy("finish", F.col("source").asc_nulls_last(), "end", "turn").rowsBetween(Window.unboundedPreceding, 0)
    last = copies.where((F.col("finish") >= low) & (F.col("finish") < high))
    last = last.withColumn("sum", F.sum("size").over(order)).where(F.col("sum") <= total - used)
    last = last.groupBy(F.col("source").alias("l_source"), F.col("end").alias("l_end")).agg(F.count("*").alias("late"))
    whole = sum((F.coalesce((finish(F.lit(t)) < low), F.lit(False)).cast("int") for t in range(repeats)), F.lit(0))
    out = queue.join(F.broadcast(last), F.col("source").eqNullSafe(F.col("l_source")) & (F.col("end") == F.col("l_end")) & (F.col("size") > 0), "left")
    out = out.withColumn("copies", whole + F.coalesce("late", F.lit(0)).cast("int"))
    return out.select("doc_id", "source", "size", F.col("source_size").cast("bigint").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), finish(F.lit(0)).alias("first_finish"))


def _edge(copies: DataFrame, total: int) -> tuple[float, float, int]:
    """(low, high, used): the slot of finish times in which the budget ends, and what earlier slots use.

    Each pass sums the sizes in SLOTS equal slots and keeps the one that crosses the budget, until it has at most EDGE_ROWS
    rows. Finish times grow strictly within a source, so slots can be refined as far as rows of different sources tie.
    """
    top = copies.agg(F.max("finish")).first()[0]
    if top is None:
        return 0.0, 0.0, 0
    low, high, used = 0.0, float(top) * (1 + 1e-9) + 1e-9, 0
    while True:
        width = (high - low) / SLOTS
        slot = F.least(F.floor((F.col("finish") - low) / width), F.lit(SLOTS - 1)).alias("slot")
        sums = copies.where((F.col("finish") >= low) & (F.col("finish") < high)).groupBy(slot).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("finish").alias("first"), F.max("finish").alias("last"))
        over = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)  # SLOTS rows at most
        found = sums.withColumn("sum", F.sum("size").over(over)).where(F.col("sum") > total - used).orderBy("slot").first()
        if found is None:
            return high, high, used
        used += found["sum"] - found["size"]
        low, high = found["first"], math.nextafter(found["last"], math.inf)
        if found["rows"] <= EDGE_ROWS or found["first"] == found["last"]:
            return low, high, used


def mixed_documents(docs: DataFrame, weights: DataFrame, repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of `docs`, all columns, each as often as `mix` takes it, spread over the output as the queues are served.

    A budget cuts each queue at one place, so what a source takes is a number of whole rounds and one more up to a document.
    These places, one row for each source, go to the documents; texts move once, to the range of their finish time. That
    time takes the share of marks for the share of words before a document, which agree in the mean.
    """
    taken = mix(docs, weights, repeats=repeats, seed=seed).where("size > 0").withColumn("mark", mark_of(seed))
    order = F.struct("mark", "doc_id", "size")
    cuts = taken.groupBy("source").agg(
        F.min("copies").alias("__rounds"), F.max("copies").alias("__most"), F.max(F.struct(F.col("copies"), order.alias("last"))).alias("__cut"),
        (F.first("source_size") / F.greatest(F.first("target"), F.lit(1e-9))).alias("__pace"),
    )
    cuts = written(cuts.select(F.col("source").alias("__source"), "__rounds", "__most", F.col("__cut.last").alias("__last"), "__pace"), "mix-cuts")
    small = cuts.count() <= BROADCAST_SOURCES
    rows = docs.withColumn("__size", words_of(F.col("text"))).where("__size > 0")
    rows = rows.join(F.broadcast(cuts) if small else cuts, F.col("source").eqNullSafe(F.col("__source")))
    place = F.struct(mark_of(seed).alias("mark"), F.col("doc_id"), F.col("__size").alias("size"))
    copies = F.when(place <= F.col("__last"), F.col("__most")).otherwise(F.col("__rounds"))
    rows = rows.withColumn("__copies", copies).where("__copies > 0").withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    share = F.conv(F.substring(mark_of(seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rows = rows.withColumn("__finish", (F.col("__turn") - 1 + share) * F.col("__pace"))
    return rows.repartitionByRange("__finish").sortWithinPartitions("__finish").select(*docs.columns)
