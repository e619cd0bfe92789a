"""What the operators share: tables in the shared folder and a left join that no key can overload."""

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}

# White space of the word definition: space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session on this machine may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN_FOLDER.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="netloom-llm-"))


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: short lineage, and nothing to recompute when an executor is lost."""
    path = f"{shared_folder(frame.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def attach(rows: DataFrame, facts: DataFrame, keys: list[str], met: str, total: int, spread: Column, share: float = 1e-3) -> DataFrame:
    """Left join of `facts` (one row for each key) to `rows`, whatever share of the rows one key has.

    met: the column of `facts` with the number of rows of its key, out of `total`. Keys with more than `share` of the rows
    number fewer than 1/share, so these facts are broadcast; the rest is joined by key, and rows already served are
    spread by `spread`. Columns of facts other than the keys come along; both frames need distinct names besides keys.
    """
    values = [c for c in facts.columns if c not in keys]
    hot = F.col(met) > F.lit(total * share)
    left, cold, warm = rows.alias("r"), facts.where(~hot), facts.where(hot)
    warm = warm.select(*[F.col(k).alias(f"__w_{k}") for k in keys], *[F.col(v).alias(f"__w_{v}") for v in values], F.lit(True).alias("__w"))
    cond = [F.col(f"r.{k}") == F.col(f"__w_{k}") for k in keys]
    left = left.join(F.broadcast(warm), cond, "left").withColumn("__salt", F.when(F.col("__w"), spread).otherwise(F.lit(0).cast("bigint")))
    left = left.drop(*[f"__w_{k}" for k in keys])
    cold = cold.select(*[F.col(k).alias(f"__c_{k}") for k in keys], *[F.col(v).alias(f"__c_{v}") for v in values], F.lit(0).cast("bigint").alias("__c_salt"))
    cond = [F.col(k) == F.col(f"__c_{k}") for k in keys] + [F.col("__salt") == F.col("__c_salt"), F.col("__w").isNull()]
    out = left.join(cold, cond, "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.when(F.col("__w"), F.col(f"__w_{v}")).otherwise(F.col(f"__c_{v}")).alias(v) for v in values])
