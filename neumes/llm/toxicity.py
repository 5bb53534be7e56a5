"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

1. An expression is a word after its history, the preceding word. Of a bounded
   sample of labelled rows, Spark counts in how many documents of each class each
   expression and each word occurs; in how many texts of the whole corpus each word
   occurs is a written table of all its words, which grows with the corpus.
2. The class models are interpolated Kneser-Ney models with the discounts of its
   modified form. An expression backs off to its word, whose history is the text: what
   counts is how many different texts it continues. Words back off to the shared
   counts of the corpus, which are the same for both classes.
3. Sampling makes any two estimates differ. Each expression therefore has two
   readings: its own class models, or one model for both classes, in which it
   differs no more than its word does (a word: not at all). The probabilities are
   those of both readings, weighted by how likely each is after the counts have been
   seen (a binomial share as given, against any share). All expressions take part,
   each as far as its counts bear it.
4. The score is a logistic function, fitted on training rows kept out of the counts,
   of the difference of both log-likelihoods divided by the length of the text.

Counts stay in Spark; only the finished differences, one 32-bit number for each
expression of the bounded sample, go to the tasks that score.
"""

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fold_of, id_and_text, limit_batches, written

MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: The history of a first word.
START = 0
#: Counts by which the typical share of a class is told: words of so many in the smaller class.
TYPICAL = 16
#: A difference of the log-likelihoods for each word that a text of some hundred words bears out.
UNIT = 0.01
#: Of the logistic function's slope, where the scores' deviation is 1.
RIDGE = 0.05


def word_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text begins and ends.

    Words are parts between ASCII white space, A-Z lower-cased, without marks at
    their ends; parts of marks alone are no words.
    """
    split = pc.ascii_split_whitespace(pc.fill_null(pc.ascii_lower(texts), ""))
    coded = split.flatten().dictionary_encode()
    names = [c.strip(MARKS) for c in coded.dictionary.to_pylist()]
    hashes = np.array([xxhash.xxh3_64_intdigest(w) or 1 if w else START for w in names], np.uint64).view(np.int64)
    stream = hashes[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.empty(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]).astype(np.int64)
    real = stream != START
    return stream[real], np.concatenate([[0], np.cumsum(real)])[ends]


def histories(stream: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word before each word of the same text; START before the first."""
    before = np.concatenate([[START], stream[:-1]])[: len(stream)]
    heads = ends[:-1][np.diff(ends) > 0]
    before[heads] = START
    return before


def pair(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    """One 64-bit number for an expression (the finaliser of splitmix64 over both hashes)."""
    with np.errstate(over="ignore"):
        x = history.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))).view(np.int64)


def expressions(batches):
    """Rows (history, word, n0, n1) of training rows (text, y): documents of each class; words alone have no history."""
    for batch in batches:
        stream, ends = word_stream(batch.column(0))
        y = batch.column(1).to_numpy()
        words, place = np.unique(stream, return_inverse=True)
        known, before = np.unique(histories(stream, ends), return_inverse=True)
        docs = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        for alone in (True, False):
            keys = place if alone else before * max(1, len(words)) + place
            once = np.unique(docs * (int(keys.max(initial=0)) + 1) + keys)
            doc, key = np.divmod(once, int(keys.max(initial=0)) + 1)
            key, at = np.unique(key, return_inverse=True)
            n = [np.bincount(at, y[doc] == c, len(key)).astype(np.int64) for c in (0, 1)]
            history = pa.nulls(len(key), pa.int64()) if alone else pa.array(known[key // max(1, len(words))])
            yield pa.record_batch({"history": history, "word": words[key % max(1, len(words))], "n0": n[0], "n1": n[1]})


def text_counts(batches):
    """Rows (word, texts) of texts (text): how many of a batch hold each of their words."""
    for batch in batches:
        stream, ends = word_stream(batch.column(0))
        words, place = np.unique(stream, return_inverse=True)
        docs = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        held = np.unique(docs * max(1, len(words)) + place) % max(1, len(words))
        yield pa.record_batch({"word": words, "texts": np.bincount(held, minlength=len(words)).astype(np.int64)})


def discounts(of_counts) -> list[float]:
    """What modified Kneser-Ney takes off counts of 0, 1, 2, and 3 or more, by how many expressions have counts of 1 to 4."""
    n1, n2, n3, n4 = (max(1, int(n or 0)) for n in of_counts)
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(min(max(x, 0.05 * i), 0.95 * i) for i, x in enumerate(d, 1))]


def log_factorial(n: np.ndarray) -> np.ndarray:
    """Of whole numbers, each distinct one once."""
    values, at = np.unique(n, return_inverse=True)
    return np.array([lgamma(v + 1.0) for v in values.tolist()])[at] if len(values) else np.empty(0)


def own_share(n0: np.ndarray, n1: np.ndarray, share: np.ndarray, prior: float) -> np.ndarray:
    """How likely the classes have a share of their own, where a share of ``share`` was expected.

    By Bayes' rule, with ``prior`` before the counts; an own share may be any with equal odds.
    """
    n = n0 + n1
    expected = log_factorial(n) - log_factorial(n0) - log_factorial(n1) + n1 * np.log(share) + n0 * np.log1p(-share)
    odds = np.log(prior) - np.log1p(-prior) - np.log(n + 1.0) - expected
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def interpolated(n, taken, mass, lower, total):
    """Kneser-Ney: what is left of the counts, and the mass taken from the history dealt as ``lower`` is; ``lower`` without a history."""
    return np.where(total > 0, (n - taken + mass * lower) / np.maximum(total, 1e-300), lower)


@dataclass(frozen=True)
class Level:
    """What all expressions of a level share: discounts of class 0, of class 1 and of both together."""

    off: tuple[list[float], list[float], list[float]]

    def taken(self, which: int, n: np.ndarray) -> np.ndarray:
        return np.array(self.off[which])[np.minimum(n, 3)]


def discount(n: Column, off: list[float]) -> Column:
    return F.when(n >= 3, off[3]).when(n == 2, off[2]).when(n == 1, off[1]).otherwise(0.0)


def level_of(counts: DataFrame) -> Level:
    """The discounts of a table (n0, n1)."""
    n = (F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1"))
    found = counts.agg(*(F.count_if(c == k).alias(f"c{i}_{k}") for i, c in enumerate(n) for k in (1, 2, 3, 4))).first()
    return Level(tuple(discounts([found[f"c{i}_{k}"] for k in (1, 2, 3, 4)]) for i in range(3)))


WORDS = "word long, q0 double, q1 double, pool double, ratio double"


def word_models(level: Level, sums: dict, share: float, prior: float):
    """Rows ``WORDS`` of (word, n0, n1, texts): probabilities in both classes and in their union, and the log of the classes' ratio."""

    def run(batches):
        for batch in batches:
            n0, n1, texts = (batch.column(i).to_numpy() for i in (1, 2, 3))
            lower = (texts + 1.0) / sums["texts"]
            own = own_share(n0, n1, np.full(len(n0), share), prior)
            pool = interpolated(n0 + n1, level.taken(2, n0 + n1), sums["taken2"], lower, np.float64(sums["n0"] + sums["n1"]))
            q = [own * interpolated(n, level.taken(c, n), sums[f"taken{c}"], lower, (sums["n0"] + sums["n1"]) * (share if c else 1 - share)) + (1 - own) * pool for c, n in enumerate((n0, n1))]
            yield pa.record_batch({"word": batch.column(0), "q0": q[0], "q1": q[1], "pool": pool, "ratio": np.log(q[1]) - np.log(q[0])})

    return run


def expression_models(level: Level, share: float, prior: float):
    """Rows (key, ratio) of (history, word, n0, n1, q0, q1, pool, ratio, t0, t1, m0, m1, m2): t totals, m masses of the history."""

    def run(batches):
        for batch in batches:
            history, word, n0, n1, q0, q1, pool, low, t0, t1, m0, m1, m2 = (batch.column(i).to_numpy() for i in range(13))
            gain = np.exp(low)
            mine = (t1 + share) / (t0 + t1 + 1)  # the share of class 1 after the history
            odds = mine / (1 - mine) * gain
            own = own_share(n0, n1, np.clip(odds / (1 + odds), 1e-9, 1 - 1e-9), prior)
            both = interpolated(n0 + n1, level.taken(2, n0 + n1), m2, pool, (t0 + t1).astype(float))
            plain = both / (1 - mine + mine * gain)
            p0 = own * interpolated(n0, level.taken(0, n0), m0, q0, t0.astype(float)) + (1 - own) * plain
            p1 = own * interpolated(n1, level.taken(1, n1), m1, q1, t1.astype(float)) + (1 - own) * plain * gain
            yield pa.record_batch({"key": pair(history, word), "ratio": (np.log(p1) - np.log(p0)).astype(np.float32)})

    return run


@dataclass
class Model:  # sent as its fields, in their order
    """Sorted keys and log-ratios of words and of expressions; expressions without one have that of their word, others none.

    ``ahead``: so many words without a difference lengthen each text, so that a text of
    a few words does not stand out by one of them.
    """

    words: np.ndarray
    word_ratio: np.ndarray
    keys: np.ndarray
    ratio: np.ndarray
    ahead: float
    slope: float = 0.0
    shift: float = 0.0

    def gaps(self, texts: pa.Array) -> np.ndarray:
        """The difference of both log-likelihoods by length, for each text; 0 without words."""
        stream, ends = word_stream(texts)
        words, place = np.unique(stream, return_inverse=True)
        of_word = looked_up(self.words, self.word_ratio, words, np.zeros(len(words), np.float32))
        keys, at = np.unique(pair(histories(stream, ends), stream), return_inverse=True)
        nothing = np.full(len(keys), np.nan, np.float32)
        found = looked_up(self.keys, self.ratio, keys, nothing)[at]
        found = np.where(np.isnan(found), of_word[place], found)
        sizes = np.diff(ends)
        total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), found, len(sizes))
        return total / np.maximum(sizes + self.ahead, 1)

    def scores(self, gaps: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * damped(gaps) + self.shift, -700, 700)))


def fields(model: Model) -> tuple:
    return model.words, model.word_ratio, model.keys, model.ratio, model.ahead, model.slope, model.shift


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    if not len(keys):
        return otherwise
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def damped(gaps: np.ndarray) -> np.ndarray:
    """Differences on a scale that is even up to ``UNIT`` and logarithmic beyond: a few texts far away don't set the scale."""
    return np.sign(gaps) * np.log1p(np.abs(gaps) / UNIT)


def logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of a weighted logistic fit with a small ridge on the scaled slope."""
    scale = float(np.std(x)) or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weights * (y - p)) - np.array([RIDGE * b[0], 0.0])
        h = (z * (weights * p * (1 - p))[:, None]).T @ z + np.diag([RIDGE, 1e-3])
        step = np.linalg.solve(h, g)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, b[0] / scale), float(b[1])


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, most_rows: int, most_words: int) -> tuple[DataFrame, np.ndarray]:
    """A written sample (text, y, part), and how many labelled training rows each class has.

    Of each class, in the order of a hash of doc_id, at most ``most_rows`` rows,
    without copies, whose words (at most (characters + 1) / 2) sum up to ``most_words``;
    part 0 to 3 comes from the same hash.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("long").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)").where(fold_of(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64(F.lit("toxic"), "doc_id")
    picked = [known.where(F.col("y") == c).orderBy(place, "doc_id").limit(most_rows) for c in (0, 1)]
    ids = F.broadcast(written(picked[0].unionAll(picked[1]), "picked"))  # at most 2 x most_rows ids
    rows = written(docs.join(ids, "doc_id").select("doc_id", "text", "y", place.alias("place"), ((F.coalesce(F.char_length("text"), F.lit(0)) + 1) / 2).cast("long").alias("words"), F.xxhash64("text").alias("copy")), "training")
    held, taken, seen = [0, 0], [], set()
    for r in rows.select("doc_id", "y", "words", "place", "copy").orderBy("place", "doc_id").collect():  # at most 2 x most_rows rows
        if r.copy not in seen and held[r.y] + r.words <= most_words:
            held[r.y] += r.words
            seen.add(r.copy)
            taken.append((r.doc_id,))
    spark = docs.sparkSession
    sample = rows.join(F.broadcast(spark.createDataFrame(taken, "doc_id long").distinct()), "doc_id").select("text", "y", F.pmod(F.shiftright("place", 8), F.lit(4)).cast("int").alias("part"))
    return written(sample, "sample"), np.array([sizes.get(0, 0), sizes.get(1, 0)], float)


def shared_counts(texts: DataFrame) -> DataFrame:
    """(word, texts): in how many texts each word of the corpus occurs, written."""
    return written(texts.select("text").mapInArrow(bounded(text_counts, size=4 << 20), "word long, texts long").groupBy("word").agg(F.sum("texts").alias("texts")), "corpus-words")


def fit(counted: DataFrame, corpus: DataFrame, word_prior: float = 1e-3, prior: float = 1e-6, ahead: float = 20.0) -> Model:
    """The model of training rows (text, y) and the shared counts (word, texts), without its logistic function.

    ``word_prior`` and ``prior``: how likely a word, and a word after a certain other one,
    differs between the classes, before anything is counted.
    """
    counts = written(counted.mapInArrow(bounded(expressions, size=4 << 20), "history long, word long, n0 long, n1 long").groupBy("history", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "expressions")
    alone = written(counts.where("history IS NULL").drop("history").join(corpus, "word", "left").select("word", "n0", "n1", F.coalesce("texts", F.lit(0)).alias("texts")), "words")
    level = level_of(alone)
    taken = lambda c, off: F.coalesce(F.sum(discount(c, off)), F.lit(0.0))
    both = F.col("n0") + F.col("n1")
    sums = alone.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n0", "n1")), *(taken(c, level.off[i]).alias(f"taken{i}") for i, c in enumerate((F.col("n0"), F.col("n1"), both)))).first().asDict()
    sums["texts"] = float(sum(corpus.agg(F.coalesce(F.sum("texts"), F.lit(0)), F.count("*")).first()) or 1)
    every = max(1, sums["n0"] + sums["n1"])
    share = min(max(sums["n1"] / every, 0.5 / every), 1 - 0.5 / every)
    # groups of copies would shift the share of all counts, but not that of the typical word
    typical = alone.where(both * min(share, 1 - share) >= TYPICAL).agg(F.percentile(F.col("n1") / both, 0.5, both)).first()[0]
    share = min(max(typical, 0.5 / every), 1 - 0.5 / every) if typical is not None else share
    words = written(alone.mapInArrow(word_models(level, sums, share, word_prior), WORDS), "word-models")

    pairs = counts.where("history IS NOT NULL")
    level = level_of(pairs)
    of_history = pairs.groupBy("history").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), *(taken(c, level.off[i]).alias(f"m{i}") for i, c in enumerate((F.col("n0"), F.col("n1"), both))))
    full = pairs.join(words, "word").join(of_history, "history").select("history", "word", "n0", "n1", "q0", "q1", "pool", "ratio", "t0", "t1", "m0", "m1", "m2")
    ratios = full.mapInArrow(expression_models(level, share, prior), "key long, ratio float")

    def arrays(table: DataFrame, key: str):  # at most a row for each word of the bounded sample: 12 bytes
        found = table.orderBy(key).toArrow()
        return found[key].to_numpy(), found["ratio"].to_numpy()

    return Model(*arrays(words.select("word", F.col("ratio").cast("float").alias("ratio")), "word"), *arrays(ratios, "key"), ahead)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, most_rows: int = 4000, most_words: int = 2_000_000, **fitting) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from rows of ``labels`` with label 0 or 1 whose crc32(doc_id) mod 3 is
    not 1 (a doc_id labelled more than once counts with its largest label), at most
    ``most_rows`` rows and ``most_words`` words of each class; that also bounds what
    is sent to the tasks, 12 bytes for each expression. Null counts as empty; texts
    without words have the score of no difference. Where a class has no labelled
    row, all scores are the smoothed share of label 1. Rows without doc_id are scored
    and not held out; repeated rows are each scored. An empty table gives no rows.
    Other columns are not read.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    texts = id_and_text(docs, id_col, text_col)
    sample, sizes = training_rows(texts, labels, label_col, most_rows, most_words)
    model = fit(sample.where("part > 0").select("text", "y"), shared_counts(texts), **fitting)
    calibrate(model, sample.where("part = 0").select("text", "y"), sizes)
    sent = spark.sparkContext.broadcast(fields(model))

    def score(batches):
        model = Model(*sent.value)
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": model.scores(model.gaps(batch.column(1)))})

    out = texts.mapInArrow(bounded(score, size=4 << 20), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def calibrate(model: Model, rows: DataFrame, sizes: np.ndarray) -> None:
    """Sets slope and shift by rows (text, y) outside the counts, each class weighted by its share of the labelled rows."""
    sent = rows.sparkSession.sparkContext.broadcast(fields(model))

    def gaps(batches):
        model = Model(*sent.value)
        for batch in batches:
            yield pa.record_batch({"y": batch.column(1), "gap": model.gaps(batch.column(0))})

    found = rows.mapInArrow(bounded(gaps), "y long, gap double").orderBy("y", "gap").toArrow()  # two numbers for each of at most 2 x most_rows rows
    y, gap = found["y"].to_numpy(), found["gap"].to_numpy()
    if min(sizes) < 1 or len(np.unique(y)) < 2:
        model.slope, model.shift = 0.0, float(np.log((sizes[1] + 1) / (sizes[0] + 1)))
        return
    share = np.array([(y == c).mean() for c in (0, 1)])
    model.slope, model.shift = logistic(damped(gap), y.astype(float), (sizes / sizes.sum() / share)[y])
