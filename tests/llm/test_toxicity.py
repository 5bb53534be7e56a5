"""Toxicity against plain Kneser-Ney models, planted cases and held-out rows."""

import zlib
from collections import defaultdict
from math import lgamma, log

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neumes.llm.toxicity import Model, discounts, fit, histories, logistic, pair, shared_counts, toxicity_scores, word_stream

from .test_models import area

ROWS = [("the cat sat on the mat", 0), ("the cat ate. The mat sat", 0), ("a dog sat on the mat", 0), ("the dog ate the cat", 0), ("a cat", 0), ("the rotten cat sat", 1), ("the rotten mat, the rotten dog", 1), ("a rotten dog", 1), ("", 1)]
CORPUS = [t for t, _ in ROWS] + ["the cat and the bird", "a bird sat", None]


def split(text):
    return [w.strip(".,") for w in (text or "").lower().split()]


def plain_models(share, own):
    """P(word | history) of each class by dictionaries; ``own(n0, n1, share)`` is the weight of the reading by class."""
    texts = defaultdict(int)
    for t in CORPUS:
        for w in set(split(t)):
            texts[w] += 1
    total = sum(texts.values()) + len(texts)
    words, pairs = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for t, y in ROWS:
        w = split(t)
        for x in set(w):
            words[x][y] += 1
        for x in set(zip([None, *w], w)):
            pairs[x][y] += 1

    def off(counts):
        d = discounts([sum(c == k for c in counts) for k in (1, 2, 3, 4)])
        return lambda n: d[min(n, 3)]

    offs = {name: [off([v[c] for v in t.values()]) for c in (0, 1)] + [off([sum(v) for v in t.values()])] for name, t in (("w", words), ("p", pairs))}
    every = sum(map(sum, words.values()))
    mass = [sum(offs["w"][c](v[c]) for v in words.values()) for c in (0, 1)] + [sum(offs["w"][2](sum(v)) for v in words.values())]
    pool, q = {}, {}
    for w, v in words.items():
        lower = (texts[w] + 1) / total
        pool[w] = (sum(v) - offs["w"][2](sum(v)) + mass[2] * lower) / every
        o = own(*v, share)
        q[w] = [o * (v[c] - offs["w"][c](v[c]) + mass[c] * lower) / (every * (share if c else 1 - share)) + (1 - o) * pool[w] for c in (0, 1)]
    ratios = {}
    for (u, w), v in pairs.items():
        after = {x: n for (h, x), n in pairs.items() if h == u}
        t = [sum(n[c] for n in after.values()) for c in (0, 1)]
        p = [(v[c] - offs["p"][c](v[c]) + sum(offs["p"][c](n[c]) for n in after.values()) * q[w][c]) / t[c] if t[c] else q[w][c] for c in (0, 1)]
        both = (sum(v) - offs["p"][2](sum(v)) + sum(offs["p"][2](sum(n)) for n in after.values()) * pool[w]) / sum(t)
        mine, gain = (t[1] + share) / (sum(t) + 1), q[w][1] / q[w][0]
        odds = mine / (1 - mine) * gain
        o = own(*v, min(max(odds / (1 + odds), 1e-9), 1 - 1e-9))
        base = both / (1 - mine + mine * gain)
        ratios[u, w] = log(o * p[1] + (1 - o) * base * gain) - log(o * p[0] + (1 - o) * base)
    return {w: log(v[1] / v[0]) for w, v in q.items()}, ratios


def bayes(prior):
    def own(n0, n1, share):
        n = n0 + n1
        expected = lgamma(n + 1) - lgamma(n0 + 1) - lgamma(n1 + 1) + n1 * log(share) + n0 * log(1 - share)
        return 1 / (1 + np.exp(-(log(prior / (1 - prior)) - log(n + 1) - expected)))

    return own


@pytest.mark.parametrize("prior", [1 - 1e-15, 0.2])
def test_models_equal_plain_kneser_ney(spark, prior):
    """With a prior of nearly 1 each class has its own model throughout; that is Kneser-Ney as in textbooks."""
    corpus = shared_counts(spark.createDataFrame([(t,) for t in CORPUS], "text string").repartition(3))
    model = fit(spark.createDataFrame(ROWS, "text string, y long").repartition(2), corpus, prior, prior, 0.0)
    n = [sum(len(set(split(t))) for t, y in ROWS if y == c) for c in (0, 1)]
    words, pairs = plain_models(n[1] / sum(n), bayes(prior))
    hashed = lambda w: word_stream(pa.array([w]))[0] if w else np.zeros(1, np.int64)
    assert len(model.words) == len(words) and len(model.keys) == len(pairs)
    for w, r in words.items():
        assert model.word_ratio[np.searchsorted(model.words, hashed(w)[0])] == pytest.approx(r, abs=1e-5)
    for (u, w), r in pairs.items():
        assert model.ratio[np.searchsorted(model.keys, pair(hashed(u), hashed(w))[0])] == pytest.approx(r, abs=1e-5)
    # by length, in order; an expression never seen has its word's difference, a word never seen none
    gap = model.gaps(pa.array(["A rotten bird cat", None, "", "?!"]))
    assert gap.tolist() == pytest.approx([(pairs[None, "a"] + pairs["a", "rotten"] + words["cat"]) / 4, 0, 0, 0], abs=1e-5)


def test_discounts_are_those_of_modified_kneser_ney():
    assert discounts([50, 20, 5, 3]) == pytest.approx([0, 1 - 2 * (50 / 90) * 20 / 50, 2 - 3 * (50 / 90) * 5 / 20, 2.85 if 3 - 4 * (50 / 90) * 3 / 5 > 2.85 else 3 - 4 * (50 / 90) * 3 / 5])
    assert discounts([0, 0, 0, 0]) and all(0 <= d < i + 1 for i, d in enumerate(discounts([1, 9, 90, 900])))


def test_histories_do_not_cross_texts():
    stream, ends = word_stream(pa.array(["One two. -- Three", None, "", "two"]))
    assert ends.tolist() == [0, 3, 3, 3, 4] and histories(stream, ends).tolist() == [0, stream[0], stream[1], 0] and stream[1] == stream[3]


def corpus_of_marked_words(copies=0):
    rng = np.random.default_rng(5)
    words = np.array(["the", "of", "and", "la"] + [f"w{i}" for i in range(3000)])
    odds = 1 / np.arange(1, len(words) + 1)
    rows, labels = [], []
    for i in range(1800):
        t = list(rng.choice(words, size=rng.integers(20, 200), p=odds / odds.sum()))
        toxic = i % 4 == 0
        for _ in range(rng.integers(2, 6) if toxic else 0):
            t.insert(rng.integers(len(t)), rng.choice(["Grumble!", "fizzle", "blargh"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    near = list(rng.choice(words[500:], size=120))
    for i in range(copies):  # near copies of one clean text
        near[i % 120] = f"changed{i}"
        rows.append((5000 + i, " ".join(near)))
        labels.append((5000 + i, 0))
    return rows, labels


@pytest.mark.parametrize("copies", [0, 900])
def test_toxicity_on_rows_with_marked_words(spark, copies):
    """Label 1 goes with a few words; a large group of near copies must not make the words of all others stand out."""
    rows, labels = corpus_of_marked_words(copies)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), labels).join(labels, "doc_id").collect()
    assert area(out, "toxic") > 0.97
    assert np.mean([r.toxic for r in out if r.predicted]) > 0.95
    assert np.mean([r.predicted for r in out if r.toxic]) > 0.85


def test_expressions_of_ordinary_words_count_beyond_their_words(spark):
    """Two words that both classes use alike, in one order in texts of one class only."""
    rows = [("x%d alpha beta y%d" % (i, i), 1) for i in range(60)] + [("x%d beta alpha y%d" % (i, i), 0) for i in range(60)]
    texts = spark.createDataFrame(rows, "text string, y long")
    model = fit(texts, shared_counts(texts), ahead=0.0)
    forth, back, one = model.gaps(pa.array(["z alpha beta", "z beta alpha", "alpha"]))
    assert forth > 0.3 and back < -0.3 and abs(one) < 0.02


def test_rare_expressions_keep_their_difference(spark):
    """A word of a few texts of one class counts, and the more for each of them."""
    rows = [("common words of all texts" + " few" * (i < 2) + " some" * (i < 5) + " many" * (i < 15), 1) for i in range(100)] + [("common words of all texts", 0)] * 300
    texts = spark.createDataFrame(rows, "text string, y long")
    gaps = fit(texts, shared_counts(texts), ahead=0.0).gaps(pa.array(["x few", "x some", "x many", "x common"]))
    assert abs(gaps[3]) < 1e-2 < gaps[1] < gaps[2] and 0 < gaps[0] < gaps[1]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity_scores(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    found = (area(rows, "toxic"), np.mean([r.predicted for r in held if r.toxic]), np.mean([r.toxic for r in held if r.predicted]))
    print("area, recall, precision", found)
    assert found[0] >= 0.95 and found[1] >= 0.85 and found[2] >= 0.97


def test_shared_counts_are_of_all_texts_and_words(spark):
    """Words of the corpus, in the sample or not; the table grows with the texts."""
    rows = [(i, "Common word%d, common" % (i % 150)) for i in range(300)] + [(300, None)]
    got = {r.word: r.texts for r in shared_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    key = lambda w: int(word_stream(pa.array([w]))[0][0])
    assert len(got) == 151 and got[key("common")] == 300 and got[key("word7")] == 2


def test_odd_rows(spark):
    """Nulls, repeats, very long texts, other columns of clashing names, empty tables."""
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, None), (None, "c", "y"), (3, "", ""), (4, "rotten " * 60_000, "z")] + [(10 + i, f"word{i} of a text", "w") for i in range(40)]
    docs = spark.createDataFrame([(i, t, o, o, 1.5) for i, t, o in rows], "doc_id long, text string, word string, history string, score double")
    labels = spark.createDataFrame([(10 + i, i % 2, "t") for i in range(40)] + [(10, 1, "t"), (None, 1, None), (11, None, None), (4, 1, "")], "doc_id long, toxic int, text string")
    out = toxicity_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out) and {r.score for r in out if r.doc_id == 2} == {r.score for r in out if r.doc_id == 3}
    assert toxicity_scores(docs.limit(0), labels).count() == 0


def test_logistic_recovers_a_line():
    rng = np.random.default_rng(3)
    x = rng.normal(size=20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(float)
    assert logistic(x, y, np.ones_like(x)) == pytest.approx((2, -1), abs=0.12)


def test_short_texts_are_lengthened():
    m = Model(np.array([5]), np.array([1.0], np.float32), np.empty(0, np.int64), np.empty(0, np.float32), 20.0)
    assert m.gaps(pa.array([None], pa.string())).tolist() == [0] and Model(*word_stream(pa.array(["w"]))[:1], np.array([2.1], np.float32), np.empty(0, np.int64), np.empty(0, np.float32), 20.0).gaps(pa.array(["W"]))[0] == pytest.approx(0.1)
