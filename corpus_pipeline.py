"""A training corpus from raw documents: quality, exact dedup, near-dedup, mix, pack."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import exact, mixing, near, packing, quality
from netloom.llm.common import written
from netloom.llm.queries import tokenizer_path

# Ids of dropped documents, and sources, that are sent to all tasks up to this number; more are joined by key.
BROADCAST_ROWS = 500_000


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of `docs`, which come from `by_row`, whose row_id is not among `dropped` (doc_id). Texts move only if the ids are too many to send."""
    dropped = written(dropped.select(F.col("doc_id").alias("dropped_id")).distinct(), "dropped")
    small = dropped.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(dropped) if small else dropped, F.col("row_id") == F.col("dropped_id"), "left_anti").drop("row_id")


def judged_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").alias("doc_id"), "text")


def by_row(docs: DataFrame, nulls_first: bool) -> DataFrame:
    """`docs` with row_id, which no two rows share and which has the order of doc_id.

    It is doc_id itself where that is never null nor repeated. Else rows are numbered once in the order of doc_id and text
    digest, so that a decision about one row reaches no other; texts are then dealt out once.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn("row_id", F.col("doc_id"))
    order = F.asc_nulls_first("doc_id") if nulls_first else F.asc_nulls_last("doc_id")
    keys = [order, F.sha2(F.coalesce("text", F.lit("")), 256), F.col("row_id")]
    ranked = docs.withColumn("row_id", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ranked.withColumn("row_id", F.monotonically_increasing_id()), "pipeline-rows")


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. Each row is judged by its own text; nothing is joined."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the largest id; a null id loses to any other. Null and repeated ids decide nothing else."""
    rows = by_row(docs, nulls_first=True)
    return without(rows, exact.exact_duplicates(judged_rows(rows)).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8), the document with the smallest id; a null id loses to any other."""
    rows = by_row(docs, nulls_first=False)
    return without(rows, near.near_duplicates(judged_rows(rows), width=5, percent=80).where("NOT kept"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in about the order of virtual finish times."""
    return mixing.mixed_documents(docs, mixing.ranked_weights(docs, [1, 2, 3]))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", judge_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_documents),
]

# Neither the classifier, the tokenizer nor the plan of windows can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
