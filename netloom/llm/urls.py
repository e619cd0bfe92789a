"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the rest. DataFrame functions only."""

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import attach, written

# (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_pages", "suffix_hosts", "suffix_block")
# Labelled rows that the trees are fitted on, in expectation; chosen by a digest of the url.
SAMPLE_ROWS = 20_000
# Labelled rows of the average verdict that a suffix is taken to have besides its own.
PRIOR = 20.0


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, number sign or the end; A-Z in lower case."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a parent domain of it and the start of the path, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def lexical(pages: DataFrame) -> DataFrame:
    """Adds the features of the url itself to (url, host, path)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    part = lambda c: (F.length(url) - F.length(F.replace(url, c))) / size
    entropy = F.aggregate(F.array_distinct(F.split(url, "")), F.lit(0.0), lambda a, c: a - F.when((c == "") | (part(c) <= 0), 0.0).otherwise(part(c) * F.log2(part(c))))
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    return pages.withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "depth": _count(F.col("path"), "/").cast("double"),
        "labels": (_count(F.col("host"), ".") + 1).cast("double"), "digit_ratio": _count(url, "0123456789") / size, "entropy": entropy,
        "parameters": F.when(asked == "", 0.0).otherwise(_count(asked, "&") + 1.0), "hyphens": _count(F.col("host"), "-").cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    })


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, score: one row for each row of `pages` (page_id, url).

    A rule decides where one fits, the longest wins. For the rest, trees trained on labelled urls (url, verdict) give the
    probability of block; without `labelled`, the urls that rules decide are the labels. The features: lengths, depth, digit
    share, entropy of characters, numbers of parameters, labels and hyphens, and of the host's last label: its
    pages, its hosts and its share of blocked labels, drawn to the mean by PRIOR rows. Suffix statistics cover all rows; the
    trees are fitted on about sample_rows labelled rows. A suffix with a large share of the pages is broadcast, not shuffled.

    Null url or no ://: host and path are empty, no rule fits, the trees judge the empty url. Repeated rows are judged alike;
    null ids stay. With labels of one kind only that verdict holds for the rest, with none it is allow, and score is 1 or 0.
    Empty table: no rows; other columns, the page text among them, are not read.
    """
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    base = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    base = base.withColumn("rule", rule).withColumn("ruled", verdict)
    rows = written(lexical(base), "url-features")
    if labelled is None:
        known = rows.where("ruled IS NOT NULL").withColumn("block", (F.col("ruled") == "block").cast("double"))
    else:
        known = labelled.select("url", (F.col("verdict") == "block").cast("double").alias("block")).where("block IS NOT NULL")
        known = lexical(known.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))))
    counts = known.agg(F.count("*").alias("n"), F.avg("block").alias("mean")).first()
    mean = counts["mean"] if counts["n"] else 0.0
    seen = known.groupBy("suffix").agg(F.sum("block").alias("blocked"), F.count("*").alias("marked"))
    # hosts are folded before they are counted, so that a host with many pages is one row
    suffixes = rows.groupBy("suffix", "host").agg(F.count("*").alias("n")).groupBy("suffix").agg(F.sum("n").alias("met"), F.count("*").alias("hosts"))
    suffixes = suffixes.join(seen.withColumnRenamed("suffix", "s"), F.col("suffix") == F.col("s"), "left").select(
        "suffix", "met", F.log1p(F.col("met").cast("double")).alias("suffix_pages"), F.log1p(F.col("hosts").cast("double")).alias("suffix_hosts"),
        ((F.coalesce("blocked", F.lit(0.0)) + PRIOR * mean) / (F.coalesce("marked", F.lit(0)) + PRIOR)).alias("suffix_block"),
    )
    suffixes = written(suffixes, "url-suffixes")
    total = rows.count()
    full = lambda x: attach(x, suffixes, ["suffix"], "met", total, F.xxhash64("url")).fillna({"suffix_pages": 0.0, "suffix_hosts": 0.0, "suffix_block": mean})
    if not counts["n"] or mean in (0.0, 1.0):
        return rows.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("block" if mean else "allow")).alias("verdict"), F.lit(float(mean)).alias("score"))
    share = min(1.0, sample_rows / counts["n"])
    picked = F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = written(full(known.where(picked)).select(*FEATURES, "block"), "url-train")
    if train.select("block").distinct().count() < 2:
        train = written(full(known).select(*FEATURES, "block"), "url-train")
    trees = GBTClassifier(labelCol="block", featuresCol="features", maxIter=20, maxDepth=4, maxBins=32, stepSize=0.2, seed=7)
    model = trees.fit(assembler.transform(train))
    out = model.transform(assembler.transform(full(rows))).withColumn("score", vector_to_array("probability")[1])
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
