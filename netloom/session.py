"""Session settings that this library is built for."""

from pyspark.sql import SparkSession

# All are runtime SQL settings; `tune` sets them for the session.
SETTINGS = {
    # JVMs do not compile methods of more than 8000 bytes to machine code. Wide projections exceed that as one
    # generated method; beyond the limit Spark generates one class per operator, which is compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Aggregates that keep sets switch to sorting after this many keys per task; the default is 128.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # Spark 4.1 drops the shuffle of a grouping over a union whose sides are partitioned by its key. Together with
    # reused exchanges that returned several rows per key (seen in 4.1.2), so the shuffle is kept.
    "spark.sql.unionOutputPartitioning": "false",
    # Kept tables shrink to a few bytes a row, in memory a row has a hundred times as many. Splits and merged shuffle
    # partitions of this size keep a task's sorts and groupings in memory, whatever the size of the table.
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    # Folders by capture are written without ordering every task's rows by capture first, unless a task has more captures than this.
    "spark.sql.maxConcurrentOutputFileWriters": "16",
}


def tune(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def fit_shuffles(spark: SparkSession, parts: int) -> SparkSession:
    """Shuffles start from at least so many partitions, or more where the session, or a larger input before, says so.

    With a fixed number a partition grows with the input until its sort or grouping spills. Adaptive execution merges small ones.
    """
    told = [int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(FIRST_PARTITIONS, None) or 0)]
    spark.conf.set(FIRST_PARTITIONS, str(max(*told, parts)))
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName("netloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    return tune(builder.getOrCreate())
