"""Quality classifier: a regularised quadratic discriminant over transformed statistics of whole texts."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import written
from netloom.llm.words import small_batches, span_hashes, text_slices, word_bounds

FEATURES = (
    "log_words", "word_length", "log_line_words", "upper", "digit", "stop", "mark", "symbol", "other_letters",
    "distinct_words", "distinct_lines", "short_lines", "marked_words", "distinct_pairs",
)
# Tried across folds; a pooled share of 1 would leave no quadratic term.
SHARES = tuple((pooled, shrink) for pooled in (0.1, 0.25, 0.5, 0.75) for shrink in (0.01, 0.05, 0.2, 0.5))
EDGE = 0.002  # shares are seen through log(share + EDGE)

# Classes of bytes; fixed values.
_CLASS = np.zeros((6, 256), np.float64)
_CLASS[0, 65:91] = 1
_CLASS[1, 48:58] = 1
_CLASS[2, [ord(c) for c in ".?"]] = 1
_CLASS[3, [ord(c) for c in ",;:'\"-()"]] = 1
_CLASS[4, [ord(c) for c in "!*$%&#|@~^<>={}[]\\/_+`"]] = 1
_CLASS[5, 128:] = 1
_SYMBOL = _CLASS[4].astype(bool)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(hashes: np.ndarray, place: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(hashes[a:b])) for a, b in zip(place[:-1], place[1:], strict=True)], np.float64)


def statistics(column: pa.Array) -> np.ndarray:
    """Rows of FEATURES for a batch of texts."""
    rows = []
    for _, data, offsets in text_slices(column):
        size = np.maximum(np.diff(offsets), 1).astype(np.float64)
        share = [_sums(k[data], offsets) / size for k in _CLASS]
        starts, ends, place = word_bounds(data, offsets)
        count = np.diff(place).astype(np.float64)
        some = np.maximum(count, 1)
        hashes = span_hashes(data, starts, ends)
        length = _sums((ends - starts).astype(np.float64), place) / some
        marked = _sums((_SYMBOL[data[np.maximum(ends - 1, 0)]] if len(ends) else np.zeros(0)).astype(np.float64), place) / some
        pairs = hashes[:-1] * np.uint64(3) + hashes[1:] if len(hashes) else hashes
        pair_place = np.minimum(place, len(pairs))
        distinct, distinct_pairs = _distinct(hashes, place) / some, _distinct(pairs, pair_place) / some
        # lines: cut at line feeds and at the ends of texts
        feeds = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
        begin = begin[begin < len(data)]
        finish = np.minimum(np.concatenate([begin[1:], [len(data)]]) if len(begin) else begin, len(data))
        line_place = np.searchsorted(begin, offsets)
        in_line = np.searchsorted(starts, finish) - np.searchsorted(starts, begin)
        lines = np.maximum(np.diff(line_place), 1).astype(np.float64)
        short = _sums((in_line <= 3).astype(np.float64), line_place) / lines
        same = _distinct(span_hashes(data, begin, finish), line_place) / lines
        logs = lambda x: np.log(x + EDGE)
        rows.append(np.column_stack([
            np.log1p(count), np.log1p(length), np.log1p(count / lines), logs(share[0]), logs(share[1]), logs(share[2]), logs(share[3]), logs(share[4]), logs(share[5]),
            distinct * np.log1p(count), same, logs(short), logs(marked), np.sqrt(1 - np.minimum(distinct_pairs, 1)),
        ]))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = statistics(batch.column(1))
        offsets = pa.array(np.arange(len(values) + 1) * len(FEATURES), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))], ["doc_id", "x"])


@dataclass
class Discriminant:
    """Centres, inverse Cholesky factors and constants of both classes; `constant` alone where a class had no rows."""

    constant: float
    shift: np.ndarray | None = None
    scale: np.ndarray | None = None
    centres: tuple = ()
    factors: tuple = ()
    offsets: tuple = ()

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.shift is None:
            return np.full(len(x), self.constant)
        x = np.clip((x - self.shift) / self.scale, -8, 8)
        log = [c - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, c in zip(self.centres, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


@dataclass
class Sums:
    """Rows, sums and sums of products of the statistics, by class."""

    n: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def __sub__(self, other: "Sums") -> "Sums":
        return Sums(self.n - other.n, self.first - other.first, self.second - other.second)

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.n + other.n, self.first + other.first, self.second + other.second)


def fold_of(doc_id: Column) -> Column:
    """The fold of a training row: what is left of crc32 of the id modulo 5; held-out rows would have 0."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5).cast("int")


def sums_by_fold(known: DataFrame) -> dict[int, Sums]:
    """From (doc_id, x, quality), in one aggregate of at most ten rows."""
    d = len(FEATURES)
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    out: dict[int, Sums] = {}
    for r in known.groupBy("quality", fold_of(F.col("doc_id")).alias("fold")).agg(F.count("*").alias("n"), *sums).orderBy("fold", "quality").collect():
        held = out.setdefault(r["fold"], Sums(np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))))
        c = r["quality"]
        held.n[c] = r["n"]
        held.first[c] = [r[f"s{i}"] for i in range(d)]
        held.second[c] = [[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]
    return out


def discriminant(sums: Sums, pooled: float, shrink: float) -> Discriminant:
    """The covariance of a class is drawn by `pooled` to that of both and by `shrink` to a multiple of the identity."""
    d, n = len(FEATURES), sums.n
    if n.min() < 2:
        return Discriminant(float(n[1] / n.sum()) if n.sum() else 0.5)
    shift = sums.first.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diagonal(sums.second.sum(axis=0)) / n.sum() - shift**2, 1e-6))
    mean = [sums.first[c] / n[c] for c in (0, 1)]
    cov = [(sums.second[c] / n[c] - np.outer(mean[c], mean[c])) / np.outer(scale, scale) for c in (0, 1)]
    both = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    centres, factors, offsets = [], [], []
    for c in (0, 1):
        s = (1 - pooled) * cov[c] + pooled * both
        s = (1 - shrink) * s + (shrink * max(np.trace(s) / d, 1e-3)) * np.eye(d)
        lower = np.linalg.cholesky(s)
        centres.append((mean[c] - shift) / scale)
        factors.append(np.linalg.inv(lower))
        offsets.append(float(np.log(n[c] / n.sum()) - np.log(np.diagonal(lower)).sum()))
    return Discriminant(float(n[1] / n.sum()), shift, scale, tuple(centres), tuple(factors), tuple(offsets))


def _chosen(known: DataFrame, folds: dict[int, Sums], whole: Sums) -> tuple[float, float]:
    """The pair of shares with the least log loss on folds that its model has not seen; losses are summed as whole numbers."""
    models = {f: [discriminant(whole - s, *shares) for shares in SHARES] for f, s in folds.items()}
    if len(models) < 2:
        return SHARES[0]

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(SHARES), np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            quality, fold = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for f in np.unique(fold):
                some = fold == f
                for k, model in enumerate(models[f]):
                    score = np.clip(model.scores(x[some]), 1e-9, 1 - 1e-9)
                    total[k] += np.rint(-1e6 * np.log(np.where(quality[some] == 1, score, 1 - score))).astype(np.int64).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(SHARES))), pa.array(total)], ["shares", "loss"])

    rows = known.select("x", F.col("quality").cast("int").alias("quality"), fold_of(F.col("doc_id")).alias("fold")).mapInArrow(losses, "shares bigint, loss bigint")
    loss = {r["shares"]: r["loss"] for r in rows.groupBy("shares").agg(F.sum("loss").alias("loss")).collect()}
    return SHARES[min(loss, key=lambda k: (loss[k], k))] if loss else SHARES[0]


def fit(features: DataFrame, labels: DataFrame, shares: tuple[float, float] | None = None) -> Discriminant:
    """From (doc_id, x) and (doc_id, quality): means and covariances by class in one aggregate over all labelled rows.

    shares: `pooled` and `shrink` of `discriminant`. Without them the pair of SHARES is taken that does best across four folds
    of these rows: the sums of a fold are taken from those of all, so a model costs no further pass, and one pass scores each
    row by the models that have not seen it. Repeated label rows count once; a document with both labels counts in both
    classes; null labels and ids do not count.
    """
    marked = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").distinct()
    known = written(features.join(marked, "doc_id"), "quality-labelled")
    folds = sums_by_fold(known)
    if not folds:
        return Discriminant(0.5)
    whole = reduce(Sums.__add__, folds.values())
    return discriminant(whole, *(shares or _chosen(known, folds, whole)))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs`.

    Statistics of whole texts (bytes by class, words, pairs of words, lines), transformed by logs and roots, are written
    once; the model, its shares of shrinkage included, sees labelled rows that are not held out, and nothing but the statistics. The score is the posterior of
    label 1: the difference of the two Mahalanobis log densities, with inverse Cholesky factors computed once.

    Null text counts as empty and gets a score like any other. A null id is not held out and has no label. Repeated rows get
    equal scores. No labels, or a class with fewer than two rows: every score is the share of label 1, or 0.5. Other
    columns are not read.
    """
    features = _written_features(docs)
    model = fit(features.where(~held_out(F.col("doc_id"))), labels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    out = features.mapInArrow(scored, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _written_features(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    features = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")
    return written(features, "quality-statistics")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, whose score reaches the threshold.

    The model is that of `quality_scores`. Rows are scored where they are read, so texts are read twice and never shuffled.
    """
    model = fit(_written_features(docs).where(~held_out(F.col("doc_id"))), labels)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.scores(statistics(pa.array(text, pa.string()))))

    return docs.where(score(F.col("text").cast("string")) >= threshold)
