"""Duration-weighted comparison of labelled intervals (half-open, in beats)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chords import VOCABULARIES, parse_chord
from ..functions.text import let, rate


def spans(rows: DataFrame, key: str, order: str, label: Column, duration: Column, sustain: str = ".") -> DataFrame:
    """(key, span_no, label, start_beat, duration): gaps and islands of a beat clock.

    A row with the sustain label prolongs the span before it; before the first label
    it only moves the clock. Equal labels in a row are spans of their own.
    """
    up_to = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    clock = rows.select(F.col(key), F.col(order), label.alias("label"), duration.cast("double").alias("d"))
    clock = clock.withColumns({"span_no": F.sum((F.col("label") != sustain).cast("int")).over(up_to).cast("long"), "start": F.coalesce(F.sum("d").over(before), F.lit(0.0))})
    held = clock.where("span_no > 0").groupBy(key, "span_no")
    return held.agg(F.max(F.when(F.col("label") != sustain, F.col("label"))).alias("label"), F.min("start").alias("start_beat"), F.sum("d").alias("duration"))


OTHER = ("span_no", "label", "start_beat", "duration")


def overlaps(left: DataFrame, right: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """Pairs of spans of one key that overlap, with their common duration.

    ``left`` and ``right`` have (key, span_no, label, start_beat, duration). Spans meet
    within a key and, with ``width``, only in buckets of so many beats, so that a key
    with very many spans does not compare all with all.
    """
    r = right.select(F.col(key).alias("_key"), *(F.col(c).alias(f"other_{c}") for c in OTHER))
    end, other_end = F.col("start_beat") + F.col("duration"), F.col("other_start_beat") + F.col("other_duration")
    on = (F.col(key) == F.col("_key")) & (F.col("start_beat") < other_end) & (F.col("other_start_beat") < end)
    begin, over = F.greatest("start_beat", "other_start_beat"), F.least(end, other_end)
    if width is None:
        return left.join(r, on).drop("_key").withColumn("overlap", over - begin)
    put = lambda d, low, high, name: d.withColumn(name, F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    met = put(left, F.col("start_beat"), end, "_bucket").join(put(r, F.col("other_start_beat"), other_end, "_other"), on & (F.col("_bucket") == F.col("_other")))
    return met.where(F.floor(begin / width) == F.col("_bucket")).drop("_key", "_bucket", "_other").withColumn("overlap", over - begin)


def symbol_recall(truth: DataFrame, pred: DataFrame, key: str, mapping=lambda c: c, width: float | None = None) -> DataFrame:
    """(key, csr, compared, total, excluded): share of the truth's duration whose label agrees, in percent.

    Spans of the truth whose mapped label is null are left out and counted; null
    labels of the prediction never agree. Without spans all is 0.
    """
    mapped = truth.withColumn("mapped", mapping(F.col("label")))
    totals = mapped.groupBy(key).agg(F.coalesce(F.sum(F.when(F.col("mapped").isNotNull(), F.col("duration"))), F.lit(0.0)).alias("total"), F.count_if(F.col("mapped").isNull()).alias("excluded"))
    met = overlaps(mapped.where("mapped IS NOT NULL"), pred, key, width).withColumn("other", mapping(F.col("other_label")))
    equal = met.groupBy(key).agg(F.sum(F.when(F.col("mapped") == F.col("other"), F.col("overlap")).otherwise(0.0)).alias("compared"), F.count_if(F.col("other").isNull()).alias("unmapped_pred"))
    out = totals.join(equal, key, "left").withColumns({"compared": F.coalesce("compared", F.lit(0.0)), "unmapped_pred": F.coalesce("unmapped_pred", F.lit(0))})
    return out.withColumn("csr", rate(F.col("compared"), F.col("total"), 0))


def vocabulary_recalls(truth: DataFrame, pred: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """(key, vocabulary, csr) for each chord vocabulary; spans are joined once."""
    names = list(VOCABULARIES)
    # a label is read where its span is made: pairs carry an array of what it stands for in each vocabulary (fields of a struct would each be read anew)
    mapped = lambda d: d.withColumn("label", let(parse_chord(F.col("label")), lambda p: F.array(*(f(p) for f in VOCABULARIES.values()))))
    left, right = mapped(truth), mapped(pred)
    total = lambda n: F.coalesce(F.sum(F.when(F.get("label", F.lit(names.index(n))).isNotNull(), F.col("duration"))), F.lit(0.0)).alias(f"total_{n}")
    totals = left.groupBy(key).agg(*map(total, names))
    compared = lambda n: F.sum(F.when(F.get("label", F.lit(names.index(n))) == F.get("other_label", F.lit(names.index(n))), F.col("overlap")).otherwise(0.0)).alias(f"same_{n}")
    equal = overlaps(left, right, key, width).groupBy(key).agg(*map(compared, names))
    # one row a key until the vocabularies are told apart
    rows = F.array(*(F.struct(F.lit(n).alias("vocabulary"), rate(F.coalesce(f"same_{n}", F.lit(0.0)), F.col(f"total_{n}"), 0).alias("csr")) for n in names))
    return totals.join(equal, key, "left").select(key, F.inline(rows))


def directional_hamming(left: DataFrame, right: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """(key, hamming, duration): of each left span, what its largest single overlap leaves uncovered, summed."""
    best = overlaps(left, right, key, width).groupBy(key, "span_no").agg(F.max("overlap").alias("best"))
    rest = F.col("duration") - F.coalesce("best", F.lit(0.0))
    return left.join(best, [key, "span_no"], "left").groupBy(key).agg(F.sum(rest).alias("hamming"), F.sum("duration").alias("duration"))


def segmentation_quality(truth: DataFrame, pred: DataFrame, key: str, width: float | None = None) -> DataFrame:
    """(key, over, under, quality): 100 * max(0, 1 - the larger Hamming distance / duration).

    The duration is the truth's, else the prediction's; where both are empty the
    quality is 1.
    """
    over = directional_hamming(truth, pred, key, width).select(key, F.col("hamming").alias("over"), F.col("duration").alias("d1"))
    under = directional_hamming(pred, truth, key, width).select(key, F.col("hamming").alias("under"), F.col("duration").alias("d2"))
    both = over.join(under, key, "full").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("over", "under", "d1", "d2")})
    total = F.when(F.col("d1") > 0, F.col("d1")).otherwise(F.col("d2"))
    share = F.greatest(F.lit(0.0), 1.0 - F.try_divide(F.greatest("over", "under"), total)) * 100.0
    return both.select(key, "over", "under", F.coalesce(share, F.lit(1.0)).alias("quality"))


def interval_report(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """Recalls by vocabulary, segmentation, and numbers and durations of spans, one row per key."""
    wide = vocabulary_recalls(truth, pred, key).groupBy(key).pivot("vocabulary", list(VOCABULARIES)).agg(F.first("csr"))
    count = lambda d, n: d.groupBy(key).agg(F.count("*").alias(f"{n}_spans"), F.sum("duration").alias(f"{n}_duration"))
    return wide.join(segmentation_quality(truth, pred, key), key, "full").join(count(truth, "truth"), key, "left").join(count(pred, "pred"), key, "left")
