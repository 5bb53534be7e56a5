"""Quality classification by a regularised quadratic discriminant.

1. One pass over the texts gives the transformed statistics of each document.
2. Labelled training rows are joined to them; sums and sums of products by class
   are all that the fit needs, so every labelled row counts and none is sampled.
3. Each class covariance is shrunk towards the pooled one and towards a multiple
   of the identity; its Cholesky factor is inverted once and kept in the model.
4. The score is a logistic function of the difference of the log-densities.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold_of, id_and_text, in_pieces, lean, limit_batches, utf8, written

#: Code points below 128 by kind: 1 upper, 2 lower, 3 digit, 4 space, 5 sentence marks, 6 other marks; bytes of longer characters count as lower.
KINDS = np.array([1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 3 if 48 <= c <= 57 else 4 if c in b" \t\n\r\x0b\x0c" else 5 if c in b".,;:'\"?-()" else 6 for c in range(256)], np.uint8)
NAMES = ("words", "word_length", "upper", "digits", "sentence_marks", "other_marks", "distinct_words", "top_word", "line_length", "distinct_lines", "packed")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text; all are finite, for the empty text too."""
    n = len(text)
    if not n:
        return [0.0] * len(NAMES)
    kinds = np.bincount(KINDS[np.frombuffer(text, np.uint8)], minlength=7)
    letters = kinds[1] + kinds[2]
    words = text.split()
    w = max(1, len(words))
    distinct = set(words)
    top = most(words)
    lines = [x for x in text.split(b"\n") if x]
    root = lambda x: float(np.sqrt(x))
    return [
        float(np.log1p(len(words))),
        float(np.log((n - kinds[4] + 1) / w)),
        root(kinds[1] / max(1, letters)),
        root(kinds[3] / n),
        root(kinds[5] / n),
        root(kinds[6] / n),
        float(np.log1p(len(distinct)) / np.log1p(w)),
        root(top / w),
        float(np.log1p(n / max(1, len(lines)))),
        len(set(lines)) / max(1, len(lines)),
        len(zlib.compress(text, 1)) / (n + 16),
    ]


def most(words: list[bytes]) -> int:
    counts: dict = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    return max(counts.values(), default=0)


def all_statistics(texts: list[bytes]) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(-1, len(NAMES))


@dataclass
class Discriminant:
    """means, inverted Cholesky factors and log-determinants of both classes; odds is the log of the prior odds."""

    means: list
    factors: list
    logdets: list
    odds: float
    width: float

    @classmethod
    def fit(cls, counts, sums, products, alpha: float, beta: float, width: float) -> "Discriminant":
        """counts[c], sums[c] and products[c] of the rows of class c."""
        n = np.array(counts, float)
        odds = float(np.log((n[1] + 1) / (n[0] + 1)))
        if min(n) < 2:  # nothing to tell the classes apart by
            return cls([], [], [], odds, width)
        means = [s / k for s, k in zip(sums, n)]
        scatter = [p - np.outer(s, s) / k for p, s, k in zip(products, sums, n)]
        pooled = (scatter[0] + scatter[1]) / (n.sum() - 2)
        floor = beta * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(pooled))
        factors, logdets = [], []
        for s, k in zip(scatter, n):
            own = s / max(1, k - 1)
            low = np.linalg.cholesky((1 - alpha - beta) * own + alpha * pooled + floor)
            factors.append(np.linalg.inv(low))
            logdets.append(2 * float(np.log(np.diag(low)).sum()))
        return cls(means, factors, logdets, odds, width)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; a documented ``width`` keeps large differences of log-density apart."""
        gap = np.full(len(x), self.odds)
        if self.factors:
            density = [-0.5 * ((((x - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.logdets)]
            gap = gap + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(np.sign(gap) * self.width * np.log1p(np.abs(gap) / self.width), -700, 700)))


def as_lists(x: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float64()))


def statistics_rows(batches):
    for batch in batches:
        yield pa.record_batch({"doc_id": batch.column(0), "x": as_lists(all_statistics(utf8(batch.column(1))))})


def labelled_statistics(batches):
    for batch in batches:
        yield pa.record_batch({"x": as_lists(all_statistics(utf8(batch.column(0)))), "y": batch.column(1)})


def class_sums(batches):
    """Rows (class, place, value) of rows (x, y): count, sums and products of what this task has read."""
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        x = np.array(batch.column(0).flatten()).reshape(-1, d)
        y = batch.column(1).to_numpy()
        for c in (0, 1):
            part = x[y == c]
            total[c] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
    c, place = np.divmod(np.arange(total.size), total.shape[1])
    yield pa.record_batch({"c": c, "place": place, "value": total.ravel()})


def training_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, y) of rows with label 0 or 1 whose crc32(doc_id) mod 3 is not 1; of a doc_id labelled more than once the largest label."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("long").alias("y"))
    return known.where("doc_id IS NOT NULL AND y IN (0, 1)").where(fold_of(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("y").alias("y"))


def fit_quality(labelled: DataFrame, alpha: float = 0.1, beta: float = 0.02, width: float = 8.0) -> Discriminant:
    """The model of all labelled rows (x, y)."""
    sums = labelled.select("x", "y").mapInArrow(class_sums, "c long, place long, value double").groupBy("c", "place").agg(F.sum("value").alias("value")).collect()
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for r in sums:
        total[r.c, r.place] = r.value
    return Discriminant.fit(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), alpha, beta, width)


def with_statistics(texts: DataFrame) -> DataFrame:
    """(doc_id, x) of (doc_id, text)."""
    return texts.mapInArrow(lean(bounded(statistics_rows, size=4 << 20)), "doc_id long, x array<double>")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, **fit) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null counts as empty; the empty text has a score like any other. Where a class
    has fewer than two labelled rows, all scores are the smoothed share of label 1.
    Rows without doc_id are scored and not held out; repeated rows are each
    scored. An empty table gives no rows. Other columns are not read.
    """
    limit_batches(docs.sparkSession)
    stats = written(with_statistics(id_and_text(docs, id_col, text_col)), "statistics")
    model = fit_quality(stats.join(training_labels(labels, label_col), "doc_id"), **fit)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, len(NAMES))
            yield pa.record_batch({"doc_id": batch.column(0), "score": model.scores(x)})

    out = stats.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_column(model: Discriminant, text: Column) -> Column:
    """The score of a text column, for filters that keep all other columns."""

    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(all_statistics(utf8(texts))))

    return F.arrow_udf(in_pieces(score), "double")(text)


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5, most_broadcast: int = 1_000_000, **fit) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more; scored where they are read.

    The model learns from all labelled rows. Up to ``most_broadcast`` labels, which are
    counted, are sent to the texts, and statistics are made of labelled texts only;
    beyond that, statistics of all texts are joined to the labels.
    """
    limit_batches(docs.sparkSession)
    texts, known = id_and_text(docs, id_col, text_col), training_labels(labels, label_col)
    if known.limit(most_broadcast + 1).count() <= most_broadcast:
        held = texts.join(F.broadcast(known), "doc_id")
        labelled = held.select("text", "y").mapInArrow(lean(bounded(labelled_statistics, size=4 << 20)), "x array<double>, y long")
    else:
        labelled = with_statistics(texts).join(known, "doc_id")
    return docs.where(score_column(fit_quality(labelled, **fit), docs[text_col].cast("string")) >= threshold)
