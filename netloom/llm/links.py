"""Connected components of links between documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of the links (a, b) can reach.

    Each round every id takes the least label among its neighbours, then the label of its label, so chains shorten by
    half and more. Rounds end when no label changes; each round is a table in the shared folder. Hot ends are folded
    before their shuffle, and joins on them are split by adaptive execution.
    """
    both = links.select("a", "b").where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", "label", F.least("label", "near").alias("low"))
        onto = labels.select(F.col("id").alias("to"), F.col("label").alias("further"))
        step = step.join(onto, F.col("low") == F.col("to")).select("id", F.least("low", "further").alias("label"), (F.least("low", "further") < F.col("label")).alias("moved"))
        step = written(step, "labels")
        labels = step.select("id", "label")
        if step.where("moved").isEmpty():
            return labels.withColumnRenamed("label", "component")
