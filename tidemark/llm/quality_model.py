"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector for all grades and ordered
thresholds. x marks which hashed words and which measured ranges (symbols, repeats, endings,
capitals, length ...) a text has. Weights carry an L1 penalty, so only words that tell grades apart
keep one, and a long text of ordinary words adds no noise. The fit gives each text an expected
grade and the tail probability of the top grade; a text is kept if that tail is at least KEEP.

Fitting uses at most MAX_LABELLED rated rows, those with the smallest hash of doc_id, and of them as many as have
MAX_MARKS features in all: both bounds are parameters. Features are computed on the executors, one task
fits, and only grades, thresholds and weights other than 0 come to the driver. Scoring covers every
text whole, in one Arrow pass without a shuffle.

Defined cases: a null or empty text has only measured features; a text of any length has at most SIZE features; a
rating given twice counts once, with the lower grade; null grades and ids are not used; a rated id on several
rows rates each, within the bounds; rows tied in the hash follow by id, grade and features; without two different
grades there is nothing to learn, so every document is kept with a tail of 1. Repeated rows get their own results;
only doc_id and text are read, so other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import filter_texts, map_texts, table
from tidemark.llm.quality_rules import text_stats
from tidemark.llm.tokens import PLAIN, Words

MAX_LABELLED = 20_000
MAX_MARKS = 10_000_000
BITS = 18
#: A text is kept if it has the top grade with this probability at least; held-out ratings lose under 1 % of sound texts to it.
KEEP = 0.7
_RANGES = {
    "symbols": ("n_symbols", "n_words", (0.0, 0.02, 0.1, 0.3)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.0, 0.1, 0.3, 0.6)),
    "repeats": ("n_repeat_words", "n_words", (0.0, 0.1, 0.2, 0.4)),
    "endings": ("n_ended", "n_lines", (0.1, 0.3, 0.6, 0.9)),
    "letters": ("n_letters", "word_chars", (0.6, 0.75, 0.85, 0.95)),
    "capitals": ("n_upper", "n_letters", (0.02, 0.1, 0.3, 0.6)),
    "variety": ("n_distinct", "n_words", (0.1, 0.3, 0.5, 0.8)),
    "bare": ("n_bare", "n_words", (0.0, 0.05, 0.2, 0.4)),
    "word_length": ("word_chars", "n_words", (2.5, 4.0, 7.0, 12.0)),
}
_LENGTHS = (1, 5, 10, 20, 40, 100)
#: Measured features stand before the hashed words.
N_MEASURED = sum(len(cuts) for *_, cuts in _RANGES.values()) + len(_LENGTHS)
SIZE = N_MEASURED + (1 << BITS)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every feature a text has; words may repeat."""
    stats = text_stats(texts)
    marks = [stats[a] / np.maximum(stats[b], 1) > c for a, b, cuts in _RANGES.values() for c in cuts]
    marks += [stats["n_words"] >= n for n in _LENGTHS]
    text, measured = np.nonzero(np.stack(marks, 1))
    w = Words(texts, fold=PLAIN)
    words = (w.hash >> np.uint64(64 - BITS)).astype(np.int64) + N_MEASURED
    return np.concatenate([text, w.text_of()]), np.concatenate([measured, words])


def distinct(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(text.astype(np.int64) * SIZE + feature)
    return both // SIZE, both % SIZE


@dataclass
class Model:
    """grades in order, weights by feature, thresholds between the grades."""

    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(expected grade, probability of the top grade) of each text."""
        if not len(self.thresholds):
            grade = float(self.grades[0]) if len(self.grades) else np.nan
            return np.full(len(texts), grade), np.ones(len(texts))
        text, feature = features(texts)
        useful = self.weights[feature] != 0
        text, feature = distinct(text[useful], feature[useful])
        x = np.bincount(text, self.weights[feature], minlength=len(texts))
        above = _sigmoid(x[:, None] - self.thresholds)  # P(grade > k)
        return self.grades[0] + above @ np.diff(self.grades), above[:, -1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(text: np.ndarray, feature: np.ndarray, grade: np.ndarray, rounds: int = 300, penalty: float = 1e-3, least: int = 3, screen: float = 2.0) -> Model:
    """Accelerated proximal gradient on the cumulative-link likelihood less penalty * |w|.

    (text, feature) are distinct. Features in fewer than ``least`` texts, or whose mean grade is
    within ``screen`` standard errors of the whole mean, are left out beforehand. Columns are
    scaled by their frequency and the step is one over the curvature's bound, by power iteration.
    """
    grades, y = np.unique(grade, return_inverse=True)
    if len(grades) < 2:
        return Model(grades, np.zeros(SIZE), np.zeros(0))
    n, k = len(y), len(grades) - 1
    seen = np.bincount(feature, minlength=SIZE)
    off = np.bincount(feature, (y - y.mean()).astype(np.float32)[text], minlength=SIZE)
    used = np.flatnonzero((seen >= least) & (np.abs(off) > screen * y.std() * np.sqrt(np.maximum(seen, 1))))
    place = np.full(SIZE, -1, np.int32)
    place[used] = np.arange(len(used))
    feature = place[feature]
    text, feature = text[feature >= 0], feature[feature >= 0]
    scale = 1 / np.sqrt(np.maximum(seen[used] / n, 1e-3))
    times = lambda v: np.bincount(text, (v * scale)[feature], minlength=n)
    back = lambda r: np.bincount(feature, r[text], minlength=len(used)) * scale / n
    v = np.ones(len(used))
    for _ in range(20):
        v = back(times(v / max(np.linalg.norm(v), 1e-12)))
    step = 1.5 / max(np.linalg.norm(v), 1e-6)

    share = (y[:, None] > np.arange(k)).mean(0)  # P(grade > k) without features
    start = np.log((1 - share) / share)
    first, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))  # thresholds: their order holds at each step
    w, v, t = np.zeros(len(used)), np.zeros(len(used)), 1.0
    for _ in range(rounds):
        cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        below = _sigmoid(cuts - times(v)[:, None])  # P(grade <= k)
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        lo, hi = edge[np.arange(n), y], edge[np.arange(n), y + 1]
        p = np.maximum(hi - lo, 1e-9)
        up = v + step * back(hi + lo - 1)
        new = np.sign(up) * np.maximum(np.abs(up) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t_new * (new - w), t_new
        by_cut = (np.bincount(y, hi * (1 - hi) / p, minlength=k + 1)[:k] - np.bincount(y, lo * (1 - lo) / p, minlength=k + 1)[1:]) / n
        first += by_cut.sum()
        gaps = gaps + np.array([by_cut[i + 1 :].sum() for i in range(k - 1)]) * np.exp(gaps)
    weights = np.zeros(SIZE)
    weights[used] = w * scale
    return Model(grades, weights, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def grades_of(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic marks: 0 poor and toxic, 1 poor, 2 sound but toxic, 3 sound; null toxic: not."""
    grade = 2 * F.col("quality") + 1 - F.coalesce(F.col("toxic"), F.lit(0))
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, max_labelled: int = MAX_LABELLED, max_marks: int = MAX_MARKS) -> Model:
    """A model from (doc_id, grade) ratings of docs."""
    rated = ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    rated = rated.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(max_labelled).select(F.col("doc_id").alias("rated_id"), "grade", "h")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rated), F.col("doc_id") == F.col("rated_id"))

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        text, feature = distinct(*features(texts))
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        packed = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield {"h": batch.column(0), "doc_id": batch.column(1), "grade": batch.column(2), "features": pa.array(packed, pa.binary())}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grade, sizes, marks = [], [], []
        total = 0
        for batch in batches:
            for g, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total += len(own) // 4
                if total <= max_marks:
                    grade.append(g)
                    sizes.append(len(own) // 4)
                    marks.append(own)
        text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        feature = np.frombuffer(b"".join(marks), np.int32)
        del marks
        model = fit(text, feature, np.array(grade, np.int64))
        used = np.flatnonzero(model.weights)
        yield pa.RecordBatch.from_pylist([{"grades": model.grades, "thresholds": model.thresholds, "features": used, "weights": model.weights[used]}], schema=_MODEL)

    found = map_texts(rows, ["h", "doc_id", "grade"], "h long, doc_id long, grade int, features binary", work)
    # the rows with the least hashes in one partition, in order: a row may be rated once and stand many times
    few = found.orderBy("h", "doc_id", "grade", "features").limit(max_labelled).select("grade", "features")
    row = few.mapInArrow(learn, "grades array<long>, thresholds array<double>, features array<long>, weights array<double>").first()
    weights = np.zeros(SIZE)
    if row is None:
        return Model(np.zeros(0, np.int64), weights, np.zeros(0))
    weights[np.array(row.features, np.int64)] = row.weights
    return Model(np.array(row.grades, np.int64), weights, np.array(row.thresholds))


_MODEL = pa.schema([("grades", pa.list_(pa.int64())), ("thresholds", pa.list_(pa.float64())), ("features", pa.list_(pa.int64())), ("weights", pa.list_(pa.float64()))])


def score_documents(docs: DataFrame, model: Model, threshold: float = KEEP) -> DataFrame:
    """doc_id, expected_grade, p_top and kept of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> Iterator[dict[str, pa.Array]]:
        expected, top = sent.value.score(texts)
        yield {"doc_id": batch.column(0), "expected_grade": pa.array(expected), "p_top": pa.array(top), "kept": pa.array(top >= threshold)}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "doc_id long, expected_grade double, p_top double, kept boolean", work)


def keep_sound(docs: DataFrame, model: Model, threshold: float = KEEP) -> DataFrame:
    """The documents that the model keeps, with all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return filter_texts(docs, lambda texts: sent.value.score(texts)[1] >= threshold)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, grades_of(table(spark, sf_dir, "labels"))))
