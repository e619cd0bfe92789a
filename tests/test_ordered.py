"""Chunked ordered operators against plain windows, with most rows in one group and at one moment."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.operators.ordered import ADD, XOR, global_rank, nearest_value, running, running_max, runs

LEVELS = ["us div 1000000L", "us", "seq div 8L"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    out = []
    for i in range(3000):
        us = 5_000_000 if i % 3 == 0 else rng.randrange(0, 40_000_000)
        out.append(("big" if i % 10 else "small", us, i, rng.randrange(100), rng.choice("ab")))
    return spark.createDataFrame(out, "capture_id string, us bigint, seq bigint, v bigint, label string").repartition(5).cache()


@pytest.mark.parametrize("hot", [5, 200, 10_000])
def test_rank(rows, hot):
    w = Window.partitionBy("capture_id").orderBy("us", "seq")
    got = global_rank(rows, ["capture_id"], LEVELS, ["us", "seq"], "r", hot=hot).select("capture_id", "seq", "r")
    want = rows.select("capture_id", "seq", (F.row_number().over(w) - 1).cast("bigint").alias("r"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("hot", [5, 10_000])
def test_running_max(rows, hot):
    w = Window.partitionBy("capture_id").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    got = running_max(rows, ["capture_id"], LEVELS, ["us", "seq"], "v", "m", hot=hot).select("capture_id", "seq", "m")
    want = rows.select("capture_id", "seq", F.max("v").over(w).alias("m"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("hot", [5, 10_000])
def test_running_folds(rows, hot):
    w = Window.partitionBy("capture_id").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    base = rows.withColumn("x", F.col("v"))
    got = running(base, ["capture_id"], LEVELS, ["us", "seq"], {"v": ADD, "x": XOR}, hot=hot).select("capture_id", "seq", "v_upto", "x_upto")
    want = base.select("capture_id", "seq", F.sum("v").over(w), F.bit_xor("x").over(w))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("hot", [5, 10_000])
def test_runs(rows, hot):
    w = Window.partitionBy("capture_id").orderBy("us", "seq")
    got = runs(rows, ["capture_id"], LEVELS, ["us", "seq"], "label", "run", hot=hot).select("capture_id", "seq", "run")
    changed = rows.withColumn("c", F.when(F.lag("label").over(w) != F.col("label"), 1).otherwise(0))
    want = changed.select("capture_id", "seq", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("hot", [5, 10_000])
@pytest.mark.parametrize("ahead", [False, True])
def test_nearest_value(rows, hot, ahead):
    some = rows.withColumn("mark", F.when(F.col("v") < 10, F.struct("seq", "v")))
    order = [F.desc(x) if ahead else F.asc(x) for x in ("us", "seq")]
    w = Window.partitionBy("capture_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    got = nearest_value(some, ["capture_id"], LEVELS, ["us", "seq"], "mark", "m", ahead=ahead, hot=hot).select("capture_id", "seq", "m")
    want = some.select("capture_id", "seq", F.last("mark", ignorenulls=True).over(w).alias("m"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    whole = rows.withColumn("mark", F.struct("seq", "v"))
    got = nearest_value(whole, ["capture_id"], LEVELS, ["us", "seq"], "mark", "m", ahead=ahead, hot=hot).select("capture_id", "seq", "m.seq")
    lag = F.lag("seq").over(Window.partitionBy("capture_id").orderBy(*order))
    assert got.exceptAll(whole.select("capture_id", F.col("seq"), lag)).count() == 0


def test_own_value_counts(rows):
    w = Window.partitionBy("capture_id").orderBy("us", "seq").rowsBetween(Window.unboundedPreceding, 0)
    some = rows.withColumn("mark", F.when(F.col("v") < 10, F.col("v")))
    got = nearest_value(some, ["capture_id"], LEVELS, ["us", "seq"], "mark", "m", own=True, hot=50).select("capture_id", "seq", "m")
    assert got.exceptAll(some.select("capture_id", "seq", F.last("mark", ignorenulls=True).over(w))).count() == 0
