"""Exact dedup over an extendible-hash index in shared files. DataFrame functions only."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import attach, written

# A directory has at most 2 ** MOST_BITS cells; beyond that buckets grow instead, and owner tasks spill.
MOST_BITS = 16
# Chains in a bucket.
CAPACITY = 4_096
# Keys of texts that occur more than once are sent to all tasks up to this number (16 bytes each), else joined by key.
BROADCAST_KEYS = 200_000


def directory(chains: DataFrame, capacity: int) -> DataFrame:
    """(cell, bucket, local_depth) for all cells of the directory.

    The directory doubles until no bucket holds more than `capacity` chains: a bucket is a prefix of the key bits, and its
    local depth is the least at which its chains fit. Cells are counted at the finest depth that the number of chains
    can ask for; coarser buckets are sums of cells.
    """
    count = chains.count()
    bits = 0
    while bits < MOST_BITS and (capacity << bits) < 4 * count:
        bits += 1
    cells = chains.groupBy(cell_of(F.col("key"), bits).alias("cell")).agg(F.count("*").alias("n"))
    # every prefix of every cell: at most 2 ** MOST_BITS rows for each depth
    prefixes = cells.select("cell", "n", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("cell", bits - d).alias("prefix")) for d in range(bits + 1)])).alias("p")).select("cell", "n", "p.*")
    fits = prefixes.groupBy("depth", "prefix").agg(F.sum("n").alias("held")).where((F.col("held") <= capacity) | (F.col("depth") == bits))
    local = prefixes.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("local_depth"))
    # the first cell of the prefix names the bucket, so bucket ids are in key order
    span = F.pow(F.lit(2.0), F.lit(bits) - F.col("local_depth")).cast("bigint")
    return local.select("cell", (F.col("cell") - F.pmod("cell", span)).alias("bucket"), "local_depth", F.lit(bits).alias("global_depth"))


def cell_of(key, bits: int):
    """The first `bits` bits of a 64-bit key."""
    return F.shiftrightunsigned(key, 64 - bits).cast("bigint") if bits else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Index:
    """What a search needs: an entry for each row, the directory, and the chains in files ordered by bucket and key."""

    entries: DataFrame  # doc_id, key, bytes, digest
    cells: DataFrame  # cell, bucket, local_depth, global_depth
    chains: DataFrame  # bucket, key, bytes, digest, rows
    bits: int

    def bucket_of(self, rows: DataFrame) -> DataFrame:
        """`rows`, which have a key, with the bucket that the directory names; at most 2 ** MOST_BITS cells of 16 bytes are broadcast."""
        return rows.withColumn("cell", cell_of(F.col("key"), self.bits)).join(F.broadcast(self.cells.select("cell", "bucket")), "cell").drop("cell")


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> Index:
    """Copies of a text are folded into one chain entry before the shuffle, so a text that a third of all rows share is one row for
    each map task. Overfull buckets of chains split by doubling the directory; owner tasks write ranges of (bucket, key)."""
    text = whole_text()
    entries = written(docs.select("doc_id", F.xxhash64(text).alias("key"), F.octet_length(text).alias("bytes"), F.unhex(F.sha2(text, 256)).alias("digest")), "dedup-entries")
    chains = written(entries.groupBy("key", "bytes", "digest").agg(F.count("*").alias("rows")), "dedup-chains")
    cells = written(directory(chains, capacity), "dedup-directory")
    bits = cells.agg(F.max("global_depth")).first()[0] or 0
    index = Index(entries, cells, chains, bits)
    ordered = index.bucket_of(chains).select("bucket", "key", "bytes", "digest", "rows").repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    return Index(entries, cells, written(ordered, "dedup-index"), bits)


def groups_of(docs: DataFrame, index: Index) -> DataFrame:
    """key, digest, keep_id, group_size of all texts of the index.

    Owner tasks hold ranges of (bucket, key): they fold the chains of a key, and where it has more than one row they compare the
    texts byte by byte. Copies of a text are folded where they lie first, into 64 rows at most, which alone go to their owner.
    """
    owned = index.chains.repartitionByRange("bucket", "key")
    # a range of (bucket, key) keeps the rows of a key together, so the owners group without a further shuffle
    met = owned.groupBy("bucket", "key").agg(F.sum("rows").alias("rows"), F.first("digest").alias("digest"))
    met = written(met, "dedup-owned")
    single = met.where("rows = 1").select("key", "digest", F.lit(None).cast(index.entries.schema["doc_id"].dataType).alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))

    twins = met.where("rows > 1").select("bucket", F.col("key").alias("twin"), "rows")
    total = index.entries.count()
    few = twins.count() <= BROADCAST_KEYS
    # fewer than a thousand keys can have over a thousandth of the rows
    hot = twins if few else twins.where(F.col("rows") > total / 1000)
    texts = docs.select("doc_id", whole_text().alias("whole")).withColumn("key", F.xxhash64("whole"))
    found = texts.join(F.broadcast(hot.drop("rows")), F.col("key") == F.col("twin"))
    if not few:
        cold = texts.join(F.broadcast(hot), F.col("key") == F.col("twin"), "left_anti").join(twins.where(F.col("rows") <= total / 1000).drop("rows"), F.col("key") == F.col("twin"))
        found = found.unionByName(cold)
    # the place where a row lies is no part of the result: it only keeps the copies of a text on as many tasks
    near = found.withColumn("place", F.spark_partition_id() % 64).groupBy("bucket", "key", "whole", "place").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    compared = near.repartitionByRange("bucket", "key").groupBy("bucket", "key", "whole").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return single.unionByName(compared.select("key", F.unhex(F.sha2("whole", 256)).alias("digest"), "keep_id", "group_size"))


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of `docs`.

    1. Index entries: 64-bit key, byte length and digest of each text; only these move.
    2. `build_index`: chains in buckets of at most `capacity`, split by doubling the directory, in shared files by bucket and key.
    3. `groups_of`: owner tasks fold ranges of keys; a key with more than one row has its texts compared byte by byte, and
       colliding texts of one key become groups of their own.
    4. Every row finds its group through the index, texts that occur once included: what is not in a bucket is not in the
       result. A group with a large share of the rows is broadcast, not shuffled.

    The row with the largest doc_id stays. A null text counts as empty. A null doc_id loses to any other; a group of null
    ids only has keep_id null and keeps all its rows. Rows that repeat id and text are one document: all carry kept.
    An empty table gives no rows; other columns are not read.
    """
    return found_in(build_index(docs, capacity), docs)


def found_in(index: Index, docs: DataFrame) -> DataFrame:
    groups = written(groups_of(docs, index), "dedup-groups")
    out = attach(index.entries, groups, ["key", "digest"], "group_size", index.entries.count(), F.xxhash64("doc_id", "digest")).where("group_size IS NOT NULL")
    alone = F.col("group_size") == 1
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), "group_size",
        (alone | F.col("keep_id").isNull() | F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )
