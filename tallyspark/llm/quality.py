"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of the whole text (and of its worst stretch of words) are transformed towards normal shape. Each class gets a mean and a covariance, shrunk
towards a mix of its diagonal and the pooled covariance; a document's score is the logistic of the difference of the classes' log densities, each a Mahalanobis
term from the cached Cholesky factor of the class plus its log determinant, plus the log odds of the classes. Densities are tempered
(``temper``) since the statistics are far from independent.

Scale: fitting needs only sums of statistics and their products over all labelled training rows (no sample), added up per class in each task before they are shuffled:
2 * (1 + d + d * d) numbers reach the driver. Statistics for fitting are taken of labelled texts only, which a broadcast of the labels finds while there are at most ``broadcast_labels`` of them;
with more labels those of all texts are stored once, and ids and statistics are joined instead of texts. Scoring is one pass without a shuffle.

Defined cases: null and empty texts have the statistics of no words and get a score like any other; labels other than 0 and 1 and null ids are not learnt
from; a label that repeats counts as often as it is there, and so does a document id; with one class only, every score is 1 if that class is 1, else 0, and with no labels the score is 0.5; empty tables give empty results.
Columns of documents are kept by ``keep_good``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, crc_mod, released, scratch, stored
from .wordhash import each_text

STATS = (
    "words", "word_bytes", "symbols", "upper", "pipes", "repeats", "variety", "digits", "marks",
    "worst_symbols", "worst_upper", "worst_pipes", "worst_repeats",
)
#: Words in a stretch of which the worst counts.
STRETCH = 16

_CLASS = np.zeros(256, np.uint8)
for _c in range(128):
    _ch = chr(_c)
    # 1 upper case, 2 lower case, 3 digit, 4 sentence marks, 5 bar, 6 other visible ASCII
    _CLASS[_c] = 1 if _ch.isupper() else 2 if _ch.islower() else 3 if _ch.isdigit() else 4 if _ch in ".,;:'\"-()?" else 5 if _ch == "|" else 6 if 32 < _c < 127 else 0


def _root(x: float) -> float:
    return float(np.sqrt(x))


def statistics(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The transformed statistics of one text; zeros without words."""
    out = np.zeros(len(STATS))
    n = len(starts)
    if not n:
        return out
    kind = _CLASS[data]
    sums = np.zeros((5, len(data) + 1), np.int64)
    for row, k in enumerate((1, 2, 3, 5, 6)):
        np.cumsum(kind == k, out=sums[row, 1:])
    total = sums[:, -1]
    letters = max(1, int(total[0] + total[1]))
    size = int((ends - starts).sum())
    same = np.zeros(n + 1, np.int64)
    if n > 1:
        np.cumsum(hashes[1:] == hashes[:-1], out=same[2:])
    out[:9] = (
        np.log1p(n), np.log(size / n), _root(total[4] / size), _root(total[0] / letters), _root(total[3] / n), _root(same[-1] / max(8, n - 1)),
        _root(1 - len(np.unique(hashes)) / n) / np.log1p(n), _root(total[2] / size), _root(np.count_nonzero(kind == 4) / size),
    )
    width = min(STRETCH, n)
    a, b = starts[: n - width + 1], ends[width - 1 :]
    part = sums[:, b] - sums[:, a]
    length = np.maximum(1, b - a)
    out[9:] = (
        _root((part[4] / length).max()), _root((part[0] / np.maximum(8, part[0] + part[1])).max()), _root((part[3] / width).max()),
        _root(((same[width:] - same[1 : n - width + 2]) / max(8, width - 1)).max()),
    )
    return out


def column_statistics(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), len(STATS)))
    for i, data, starts, ends, hashes in each_text(column):
        out[i] = statistics(data, starts, ends, hashes)
    return out


def stats_column(text: Column) -> Column:
    """The statistics of a text column as array<double>."""

    @F.arrow_udf("array<double>")
    def stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = column_statistics(batch)
            offsets = np.arange(0, values.size + 1, len(STATS), dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))

    return stats(text)


@dataclass
class Model:
    """Per class: mean, inverse of the Cholesky factor, log determinant, rows."""

    means: list[np.ndarray]
    whiten: list[np.ndarray]
    logdet: list[float]
    rows: list[int]
    temper: float = 0.25

    def score(self, x: np.ndarray) -> np.ndarray:
        if not all(self.rows):
            return np.full(len(x), 0.5 if not any(self.rows) else float(self.rows[1] > 0))
        logs = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - 0.5 * d for m, w, d in zip(self.means, self.whiten, self.logdet, strict=True)]
        z = self.temper * (logs[1] - logs[0]) + np.log(self.rows[1] / self.rows[0])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def from_moments(n: list[int], sums: list[np.ndarray], products: list[np.ndarray], shrink: float, pool: float, floor: float, temper: float = 0.25) -> Model:
    """Shrunk class models. shrink: weight of the diagonal; pool: weight of the pooled covariance; floor: variance added to each statistic."""
    d = len(STATS)
    means = [s / max(1, k) for s, k in zip(sums, n, strict=True)]
    scatter = [p - k * np.outer(m, m) for p, k, m in zip(products, n, means, strict=True)]
    pooled = sum(scatter) / max(1, sum(n) - 2)
    whiten, logdet = [], []
    for k, s in zip(n, scatter, strict=True):
        own = s / max(1, k - 1)
        cov = (1 - pool) * own + pool * pooled
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov)) + floor * np.eye(d)
        root = np.linalg.cholesky(cov)
        whiten.append(np.linalg.inv(root))
        logdet.append(2 * float(np.log(np.diag(root)).sum()))
    return Model(means, whiten, logdet, n, temper)


def moments(rows: DataFrame) -> DataFrame:
    """quality, at, x: numbers of rows, sums and products of statistics by class, in one flat list each. rows: quality (int), and text or stats (array<double>)."""
    d, texts = len(STATS), "text" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            classes = batch.column(0).to_numpy(zero_copy_only=False)
            x = column_statistics(batch.column(1)) if texts else batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            for c in (0, 1):
                mine = x[classes == c]
                held[c] += np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
        for c in (0, 1):
            if held[c, 0]:
                at = np.arange(held.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c), pa.int32()), pa.array(at, pa.int32()), pa.array(held[c])], names=["quality", "at", "x"])

    return rows.mapInArrow(released(run), "quality int, at int, x double").groupBy("quality", "at").agg(F.sum("x").alias("x"))


def fit(labelled: DataFrame, shrink: float = 0.3, pool: float = 0.3, floor: float = 1e-3) -> Model:
    """Model of rows with quality (0 or 1) and text or stats (array<double>)."""
    d = len(STATS)
    rows = labelled.where("quality in (0, 1)").select(F.col("quality").cast("int").alias("quality"), "text" if "text" in labelled.columns else "stats")
    got = {(r["quality"], r["at"]): r["x"] for r in moments(rows).collect()}
    at = lambda c, i: got.get((c, i), 0.0)
    n = [int(at(c, 0)) for c in (0, 1)]
    sums = [np.array([at(c, 1 + i) for i in range(d)]) for c in (0, 1)]
    products = [np.array([at(c, 1 + d + i) for i in range(d * d)]).reshape(d, d) for c in (0, 1)]
    return from_moments(n, sums, products, shrink, pool, floor)


def learnt(docs: DataFrame, labels: DataFrame, broadcast_labels: int = 2_000_000, **how: float) -> Model:
    """The model of the rows of docs with a label, outside the held-out fold."""
    bounded_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("_label_of"), F.col("quality").alias("_quality")).where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("quality").isin(0, 1))
    if known.count() <= broadcast_labels:
        mine = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_label_of")).select("_quality", "text")
        return fit(mine.select(F.col("_quality").alias("quality"), "text"), **how)
    with scratch(docs.sparkSession):
        table = stored(docs.select("doc_id", stats_column(F.col("text")).alias("stats")), "quality-stats")
        return fit(table.join(known, F.col("doc_id") == F.col("_label_of")).select(F.col("_quality").alias("quality"), "stats"), **how)


def score_text(text: Column, model: Model) -> Column:
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(model.score(column_statistics(batch)))

    return score(text)


def scored(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """doc_id, score for each row of docs."""
    return docs.select("doc_id", score_text(F.col("text"), learnt(docs, labels, **how)).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3, **how: float) -> DataFrame:
    """docs whose score is at least ``least``, with their columns only."""
    return docs.where(score_text(F.col("text"), learnt(docs, labels, **how)) >= least)


def op7_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, labels).select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
