"""Facts of keys beside the rows of the keys, whatever share of the rows a key has."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot with more than one of so many rows, so fewer keys than this can be.
HOT_SHARE = 1_000


def beside(rows: DataFrame, facts: DataFrame, keys: list[str], met: str, total: int) -> DataFrame:
    """Inner join of `facts`, one row for each key, to `rows`.

    met: the column of `facts` with the number of rows of its key, out of `total`. Facts of hot keys number fewer than
    HOT_SHARE and are broadcast, so their rows stay where they are; the other rows meet their facts by key, at most
    total / HOT_SHARE of a key. Rows with a null key have no facts and are left out, as in any inner join.
    """
    is_hot = F.col(met) > F.lit(total / HOT_SHARE)
    hot = F.broadcast(facts.where(is_hot))
    served = rows.join(hot, keys)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(facts.where(~is_hot), keys)
    return served.unionByName(rest)
