import zlib

import numpy as np
from pyspark.sql import functions as F

from neumes.llm.quality import NAMES, Discriminant, drop_low_quality, quality_scores, statistics
from neumes.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.1"


def area(rows, label):
    """Area under the curve over held-out rows."""
    pos, neg = ([r.score for r in rows if r.held_out and r[label] == k] for k in (1, 0))
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_discriminant_against_plain_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(size=(200, 3)) + 1, rng.normal(size=(300, 3)) * 2]
    m = Discriminant.fit([len(a) for a in x], [a.sum(0) for a in x], [a.T @ a for a in x], 0.2, 0.1, 8.0)
    cov = [np.cov(a.T) for a in x]
    pooled = sum(c * (len(a) - 1) for c, a in zip(cov, x)) / (sum(map(len, x)) - 2)
    point = rng.normal(size=(20, 3))
    logs = []
    for a, c in zip(x, cov):
        c = 0.7 * c + 0.2 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-6 * np.eye(3)
        d = point - a.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    gap = logs[1] - logs[0] + np.log(301 / 201)
    assert ((m.scores(point) > 0.5) == (gap > 0)).all() and np.argsort(m.scores(point)).tolist() == np.argsort(gap).tolist()


def test_statistics_are_finite():
    for text in (b"", b" ", b"\n\n", b"a", "é".encode() * 9, b"!!!", b"A" * 100_000, b"\x00\x01"):
        assert len(statistics(text)) == len(NAMES) and np.isfinite(statistics(text)).all()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert area(rows, "quality") > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    clean = [r for r in rows if r.held_out and r.quality == 1]
    assert np.mean([r.predicted for r in clean]) > 0.98
    for most in (1_000_000, 0):  # labels sent to the texts, and joined to statistics of all
        kept = {r.doc_id for r in drop_low_quality(docs, labels, most_broadcast=most).select("doc_id").collect()}
        assert kept == {r.doc_id for r in rows if r.predicted} | {r.doc_id for r in quality_scores(docs, labels).join(labels, "doc_id", "left_anti").where("predicted = 1").collect()}


def test_models_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for score in (quality_scores, toxicity_scores):
        rows = score(docs, none).collect()
        assert len(rows) == 3 and {r.score for r in rows} == {0.5} and sum(r.held_out for r in rows) == 2 * (zlib.crc32(b"1") % 3 == 1)
        assert score(docs.limit(0), none).count() == 0


def test_labels_are_learnt_from_training_rows_only(spark):
    """Held-out labels may be anything."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    odd = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for score in (quality_scores, toxicity_scores):
        a, b = ({r.doc_id: r.score for r in score(docs, x).collect()} for x in (labels, odd))
        assert a == b
