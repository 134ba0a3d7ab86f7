"""Text quality by ordinal cumulative-link regression on graded ratings.

P(grade <= g) = logistic(threshold_g - w . x): one weight vector w, shared by all grades, over hashed text, and ordered
thresholds. The hashed features are the shares of each word, of each word's shape (letters and digits folded, marks
kept) and of each pair of neighbouring shapes, with a few shares of the whole text (repeated lines, repeated words,
line and word lengths) in buckets of their own. Weights and thresholds are fitted by gradient steps on a bounded
sample: at most ``RATED`` rated training rows, by a hash of doc_id; the model has ``1 << HASH_BITS`` weights.

Scoring is one pass over the texts. The expected grade is the sum of the tail probabilities, and the tail probability
P(grade >= ``selected``) decides the selection.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import byte_list, identified, real_id

RATED, HASH_BITS, STEPS, RATE, RIDGE = 8192, 16, 150, 0.1, 1e-5

_LETTERS, _DIGITS = re.compile(rb"[A-Za-z\x80-\xff]+"), re.compile(rb"[0-9]+")
_SIZE = 1 << HASH_BITS
_STATS = 8  # the last buckets


class Buckets(dict):
    """(bucket of the word, bucket of its shape) by word."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > 400_000:
            self.clear()
        shape = _DIGITS.sub(b"0", _LETTERS.sub(b"a", word))
        found = (zlib.crc32(word.lower()) % (_SIZE - _STATS), zlib.crc32(b"\0" + shape) % (_SIZE - _STATS))
        if len(word) < 64:
            self[word] = found
        return found


def features(buckets: Buckets, text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) pairs, buckets may repeat; the empty text has the last bucket alone."""
    words = text.split()
    n = len(words)
    if not n:
        return np.array([_SIZE - 1]), np.array([1.0])
    pairs = np.array([buckets[w] for w in words], dtype=np.int64)
    shapes = pairs[:, 1]
    neighbours = (shapes[:-1] * 31 + shapes[1:]) % (_SIZE - _STATS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stats = [1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(words)) / n, min(1.0, len(text) / n / 16), min(1.0, n / max(1, len(lines)) / 64), min(1.0, np.log1p(n) / 10), sum(w in b"|#*%$&" for w in words) / n]
    index = np.concatenate([pairs.reshape(-1), neighbours, np.arange(_SIZE - _STATS, _SIZE - _STATS + len(stats))])
    value = np.concatenate([np.full(2 * n, 1 / n), np.full(n - 1, 1 / max(1, n - 1)), stats])
    return index, value * 4


class Model:
    """Weights, ordered thresholds, and the share of each grade among the rated rows."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1 .. G, a row per text."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thresholds[None, :], -30, 30)))


def thresholds_of(cuts: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the gaps."""
    return np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))


def loss_and_gradient(weights: np.ndarray, cuts: np.ndarray, index: np.ndarray, value: np.ndarray, owner: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood with the ridge, and its gradients by weights and by cuts."""
    n, top = len(grades), len(cuts)
    thresholds = thresholds_of(cuts)
    z = np.bincount(owner, value * weights[index], minlength=n)
    upper = np.concatenate([thresholds, [np.inf]])[grades]  # P(grade) = S(upper - z) - S(lower - z)
    lower = np.concatenate([[-np.inf], thresholds])[grades]
    a, b = (1 / (1 + np.exp(-np.clip(t - z, -30, 30))) for t in (upper, lower))
    p = np.maximum(1e-9, a - b)
    da, db = a * (1 - a) / p, b * (1 - b) / p
    dz = da - db  # d(-log p)/dz
    dt = np.zeros(top)
    np.add.at(dt, np.minimum(grades, top - 1), np.where(grades < top, -da, 0))
    np.add.at(dt, np.maximum(grades - 1, 0), np.where(grades > 0, db, 0))
    dcut = np.cumsum(dt[::-1])[::-1].copy()
    dcut[1:] *= np.exp(cuts[1:])
    loss = -np.log(p).mean() + RIDGE / 2 * float(weights @ weights)
    return loss, np.bincount(index, value * dz[owner], minlength=len(weights)) / n + RIDGE * weights, dcut / n


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, top: int) -> Model:
    """Maximum likelihood with a small ridge, by Adam steps; thresholds stay ordered through their log gaps."""
    weights = np.zeros(_SIZE)
    share = np.array([(np.sum(grades >= g) + 0.5) / (len(grades) + 1) for g in range(1, top + 1)])
    first = -np.log(share / (1 - share))
    cuts = np.concatenate([first[:1], np.log(np.maximum(1e-3, np.diff(first)))])
    if not len(rows):
        return Model(weights, thresholds_of(cuts))
    index, value, owner = (np.concatenate(x) for x in zip(*((i, v, np.full(len(i), n)) for n, (i, v) in enumerate(rows)), strict=True))
    m = [np.zeros(_SIZE + top), np.zeros(_SIZE + top)]
    for step in range(1, STEPS + 1):
        _, by_weight, by_cut = loss_and_gradient(weights, cuts, index, value, owner, grades)
        g = np.concatenate([by_weight, by_cut])
        m[0] = 0.9 * m[0] + 0.1 * g
        m[1] = 0.99 * m[1] + 0.01 * g * g
        move = RATE * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)
        weights -= move[:_SIZE]
        cuts -= move[_SIZE:]
    return Model(weights, thresholds_of(cuts))


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def _vectors(batches):
    buckets = Buckets()
    for batch in batches:
        out = []
        for text in byte_list(batch.column(2)):
            index, value = features(buckets, text)
            own, where = np.unique(index, return_inverse=True)
            out.append((own.astype("<i4").tobytes(), np.bincount(where, value).astype("<f4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], names=["doc_id", "grade", "index", "value"])


def learn(docs: DataFrame, ratings: DataFrame, top: int, rated: int = RATED) -> Model:
    """The model of at most ``rated`` training rows; ratings (doc_id, grade) from 0 to ``top``.

    Ratings without doc_id or grade are left out; of several for one document the highest counts.
    """
    rows = ratings.where("doc_id is not null and grade is not null").where(~held_out())
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.greatest(F.lit(0), F.least(F.lit(top), F.col("grade").cast("int")))).alias("grade"))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rated)
    found = identified(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text").mapInArrow(_vectors, "doc_id long, grade int, index binary, value binary")
    held = {r["doc_id"]: r for r in found.toLocalIterator()}
    held = [held[k] for k in sorted(held)]
    return fit([(np.frombuffer(r["index"], dtype="<i4").astype(np.int64), np.frombuffer(r["value"], dtype="<f4").astype(float)) for r in held], np.array([r["grade"] for r in held], dtype=np.int64), top)


def grades_of(labels: DataFrame) -> DataFrame:
    """Graded ratings from the labels: 0 poor, 1 good but toxic, 2 good; a null toxic counts as not toxic."""
    return labels.select("doc_id", F.when(F.col("quality") > 0, F.when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)).when(F.col("quality").isNotNull(), 0).alias("grade"))


def classify(docs: DataFrame, ratings: DataFrame, top: int = 2, selected: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, expected_grade, score, predicted, selected.

    ``score`` is the tail probability P(grade >= selected); texts with at least 0.5 are selected. Null and empty texts
    have the score of the empty text; a null doc_id comes back as null; repeated rows are scored each; an empty table
    gives no rows; other columns are not looked at. Without ratings every grade is as likely.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, ratings, top))

    def scan(batches):
        buckets, m = Buckets(), model.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for n, text in enumerate(byte_list(batch.column(1))):
                index, value = features(buckets, text)
                z[n] = m.weights[index] @ value
            tails = m.tails(z)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, selected - 1])], names=["doc_id", "expected_grade", "score"])

    out = identified(docs).mapInArrow(scan, "doc_id long, expected_grade double, score double").select(real_id("doc_id"), "expected_grade", "score")
    good = F.col("score") >= 0.5
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "expected_grade", "score", good.cast("int").alias("predicted"), good.alias("selected"))
