"""Error rates and chord scores, per unit and aggregated."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import chord_list, first_spine
from ..functions.batches import roots as batch_roots
from ..functions.chords import parse_chord
from ..functions.distance import text_errors
from ..functions.text import bag_matches, edit_distance, let, position_matches, precision_recall_f1, rate
from .alignment import alignment_counts, common_subsequence, windowed_matches

KINDS = ("cer", "ser", "ler")


def with_text_errors(pairs: DataFrame, pred: str = "pred_text", truth: str = "gt_text", kinds=KINDS) -> DataFrame:
    """Adds <kind>_errors and <kind>_total for each kind of symbol, of whole texts; nulls where a text is null."""
    found = pairs.withColumn("_errors", text_errors(F.col(pred), F.col(truth), kinds))
    names = [f"{k}_{part}" for k in kinds for part in ("errors", "total")]
    return found.withColumns({n: F.col("_errors")[n] for n in names}).drop("_errors")


def with_token_errors(pairs: DataFrame, pred: str, truth: str, name: str) -> DataFrame:
    """Adds <name>_errors and <name>_total for two token arrays."""
    return pairs.withColumns({f"{name}_errors": edit_distance(F.col(pred), F.col(truth)), f"{name}_total": F.size(truth)})


def micro_macro(errors: DataFrame, by: list[str], kinds=KINDS) -> DataFrame:
    """Pooled rate and mean of the units' rates, in percent, with the number of units; null where the pool is empty."""
    out = [F.count("*").alias("units")]
    for kind in kinds:
        e, n = F.col(f"{kind}_errors").cast("long"), F.col(f"{kind}_total").cast("long")
        out += [rate(F.sum(e), F.sum(n)).alias(f"{kind}_micro"), F.avg(rate(e, n)).alias(f"{kind}_macro")]
    return errors.groupBy(*by).agg(*out)


def sequence_error_rates(errors: DataFrame, by: list[str], kind: str = "ser") -> DataFrame:
    """Symbol error rate, and share of sequences with any error; both 100 where there is nothing to compare."""
    e, n = F.col(f"{kind}_errors").cast("long"), F.col(f"{kind}_total").cast("long")
    return errors.groupBy(*by).agg(rate(F.sum(e), F.sum(n), 100).alias("ser"), rate(F.count_if(e > 0), F.count("*"), 100).alias("seq_er"))


def spine_rates(errors: DataFrame, spine: str = "spine", kinds=KINDS) -> DataFrame:
    """Pooled rates of each spine and, as OVERALL, of all; 100 where nothing can be compared."""
    totals = [F.sum(f"{k}_{part}").alias(f"{k}_{part}") for k in kinds for part in ("errors", "total")]
    sums = errors.rollup(spine).agg(F.grouping(spine).alias("all"), *totals)
    return sums.select(F.when(F.col("all") == 1, "OVERALL").otherwise(F.col(spine)).alias(spine), *(rate(F.col(f"{k}_errors"), F.col(f"{k}_total"), 100).alias(k) for k in kinds))


def spine_report(texts: DataFrame, keys: list[str], pred: str = "pred_text", truth: str = "gt_text", kinds=KINDS) -> DataFrame:
    """(keys, spine, <kind>...): rates of each spine that the truth has, and, as OVERALL, of the whole texts.

    A spine that the prediction lacks counts as empty.
    """
    from .notation import spine_columns

    joined = lambda c: F.array_join(c["tokens"], "\n")
    of = lambda spine: F.coalesce(joined(F.get(F.filter("_ps", lambda c: c["spine"] == spine), F.lit(0))), F.lit(""))
    pair = lambda spine, t, p: F.struct(spine.alias("spine"), t.alias("_t"), p.alias("_p"))
    each = F.filter(F.transform("_ts", lambda c: pair(c["spine"], joined(c), of(c["spine"]))), lambda x: x["_t"] != "")
    # a page's spines meet on its row: no join
    rows = texts.withColumns({"_ts": F.coalesce(spine_columns(F.col(truth)), F.array().cast("array<struct<spine:string,tokens:array<string>>>")), "_ps": spine_columns(F.col(pred))})
    rows = rows.select(*keys, F.inline(F.concat(each, F.array(pair(F.lit("OVERALL"), F.col(truth), F.col(pred))))))
    rows = with_text_errors(rows, "_p", "_t", kinds)
    return rows.select(*keys, "spine", *(rate(F.col(f"{k}_errors"), F.col(f"{k}_total"), 100).alias(k) for k in kinds))


def model_evaluation(predictions: DataFrame, kinds=KINDS) -> DataFrame:
    """(model, pages, failed, <kind>_micro, <kind>_macro) of (page, model, pred_text, gt_text, error).

    Pages whose run failed keep their row, with the error, and are counted but not measured.
    """
    ok = F.col("error").isNull() & F.col("pred_text").isNotNull()
    measured = micro_macro(with_text_errors(predictions.where(ok), kinds=kinds), ["model"], kinds).drop("units")
    return predictions.groupBy("model").agg(F.count("*").alias("pages"), F.count_if(~ok).alias("failed")).join(measured, "model", "left")


def roots(tokens: Column) -> Column:
    return batch_roots(tokens)


def root_scores(pairs: DataFrame, pred: str, truth: str, reach: int = 3) -> DataFrame:
    """Adds matches, precision, recall and F1 of chord roots, by position, bag, subsequence and window.

    Positions are those of all tokens; the other ways, and all denominators, leave
    out tokens without root.
    """
    rows = pairs.withColumns({"_p": roots(F.col(pred)), "_t": roots(F.col(truth))}).withColumns({"_pv": F.array_compact("_p"), "_tv": F.array_compact("_t")})
    found = {"position": position_matches(F.col("_p"), F.col("_t")), "bag": bag_matches(F.col("_pv"), F.col("_tv")), "lcs": common_subsequence(F.col("_pv"), F.col("_tv")), "window": windowed_matches(F.col("_pv"), F.col("_tv"), reach)}
    rows = rows.withColumns({f"{k}_matches": c for k, c in found.items()})
    for k in found:
        p, r, f = precision_recall_f1(F.col(f"{k}_matches"), F.size("_pv"), F.size("_tv"))
        rows = rows.withColumns({f"{k}_precision": p, f"{k}_recall": r, f"{k}_f1": f})
    return rows.drop("_p", "_t", "_pv", "_tv")


def position_pairs(pairs: DataFrame, pred: str, truth: str, id_col: str = "page") -> DataFrame:
    """(page, pos, pred, truth) parsed chords at the places that both sequences have."""
    n = F.least(F.size(pred), F.size(truth))
    zipped = F.arrays_zip(F.slice(F.col(pred), F.lit(1), n).alias("p"), F.slice(F.col(truth), F.lit(1), n).alias("t"))
    rows = pairs.select(F.col(id_col).alias("page"), F.posexplode(zipped).alias("pos", "z"))
    return rows.select("page", "pos", parse_chord(F.col("z.p")).alias("pred"), parse_chord(F.col("z.t")).alias("truth"))


def part_accuracy(positions: DataFrame, part: str, by: list[str], top: int = 5) -> DataFrame:
    """Of places with equal roots: how many agree in ``part``, and the ``top`` commonest disagreements.

    Missing qualities count as dom, missing extensions as none.
    """
    return part_accuracies(positions, (part,), by, top).drop("part")


#: What stands for a part that is missing.
MISSING = {"quality": "dom", "extension": "none"}


def part_value(chord: Column, part: str) -> Column:
    return F.coalesce(F.nullif(chord[part], F.lit("")), F.lit(MISSING[part]))


def part_accuracies(positions: DataFrame, parts: tuple[str, ...], by: list[str], top: int = 5) -> DataFrame:
    """``part_accuracy`` of several parts, from one pass over the places; ``part`` tells which."""
    one = lambda part: F.struct(F.lit(part).alias("part"), part_value(F.col("truth"), part).alias("t"), part_value(F.col("pred"), part).alias("p"))
    same_root = positions.where(F.col("pred.root") == F.col("truth.root")).select(*by, "pos", F.inline(F.array(*map(one, parts))))
    by = ["part", *by]
    counted = same_root.groupBy(*by, "t", "p").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    wrong = F.filter(F.collect_list(F.when(F.col("t") != F.col("p"), F.struct((-F.col("n")).alias("order"), "first", "t", "p", "n"))), lambda x: x.isNotNull())
    out = counted.groupBy(*by).agg(F.sum("n").alias("compared"), F.coalesce(F.sum(F.when(F.col("t") == F.col("p"), F.col("n"))), F.lit(0)).alias("equal"), F.slice(F.array_sort(wrong), 1, top).alias("errors"))
    return out.withColumn("accuracy", rate(F.col("equal"), F.col("compared"), 0))


def full_chord_scores(positions: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of chords equal in root, quality and extension; two missing parts are equal.

    ``sizes``: (by, n_pred, n_truth), the numbers of chords with a root.
    """
    same = F.col("pred.root").isNotNull() & (F.col("pred.root") == F.col("truth.root")) & F.col("pred.quality").eqNullSafe(F.col("truth.quality")) & F.col("pred.extension").eqNullSafe(F.col("truth.extension"))
    hits = positions.groupBy(*by).agg(F.count_if(same).alias("matches"))
    p, r, f = precision_recall_f1(F.col("matches"), F.col("n_pred"), F.col("n_truth"))
    return sizes.join(hits, by, "left").withColumn("matches", F.coalesce("matches", F.lit(0))).select(*by, "matches", p.alias("precision"), r.alias("recall"), f.alias("f1"))


def count_analysis(pairs: DataFrame, pred: str, truth: str, shown: int = 20) -> DataFrame:
    """Adds counts of both sequences, their difference, whether they match, and the first roots."""
    first = lambda c: F.slice(F.transform(roots(F.col(c)), lambda r: F.coalesce(r, F.lit("?"))), 1, shown)
    return pairs.withColumns({"n_pred": F.size(pred), "n_truth": F.size(truth), "difference": F.size(pred) - F.size(truth), "same_count": F.size(pred) == F.size(truth), "pred_roots": first(pred), "truth_roots": first(truth)})


def chord_metric_bundle(pairs: DataFrame, pred: str, truth: str, id_col: str = "page") -> DataFrame:
    """All chord scores of each page, one row: counts, four root scores, quality, extension and full-chord scores."""
    rows = count_analysis(root_scores(pairs, pred, truth), pred, truth).withColumnRenamed(id_col, "page")
    # places that both sequences have are compared on the page's row; the longer one's rest meets nulls
    short = lambda c: F.transform(c, lambda t: let(parse_chord(t), lambda x: F.struct(x["root"].alias("root"), x["quality"].alias("quality"), x["extension"].alias("extension"))))
    same = lambda p, t, part: F.coalesce(part_value(p, part) == part_value(t, part), F.lit(False))
    equal = lambda p, t: F.struct(same(p, t, "quality").alias("quality"), same(p, t, "extension").alias("extension"), (p["quality"].eqNullSafe(t["quality"]) & p["extension"].eqNullSafe(t["extension"])).alias("full"))
    places = F.array_compact(F.zip_with(short(pred), short(truth), lambda p, t: F.when(p["root"] == t["root"], equal(p, t))))
    real = lambda c: F.size(F.array_compact(roots(F.col(c))))
    rows = rows.withColumns({"_places": places, "_np": real(pred), "_nt": real(truth)})
    compared = F.size("_places").cast("long")
    hits = lambda part: F.size(F.filter("_places", lambda x: x[part])).cast("long")
    rows = rows.withColumn("full_matches", hits("full"))
    p, r, f = precision_recall_f1(F.col("full_matches"), F.col("_np"), F.col("_nt"))
    rows = rows.withColumns({"full_precision": p, "full_recall": r, "full_f1": f})
    for part in MISSING:
        rows = rows.withColumns({f"{part}_accuracy": rate(hits(part), compared, 0), f"{part}_compared": compared})
    return rows.drop("_places", "_np", "_nt")


def page_chord_metrics(pairs: DataFrame, pred: str, truth: str) -> DataFrame:
    """Adds three alignments (with dots, of chords, of roots) with their rates; a rate is 100 where there is no truth."""
    rows = pairs
    no_dots = lambda c: F.filter(c, lambda t: t != ".")
    views = {"token": (F.col(pred), F.col(truth)), "chord": (no_dots(F.col(pred)), no_dots(F.col(truth))), "root": (F.array_compact(roots(F.col(pred))), F.array_compact(roots(F.col(truth))))}
    for name, (p, t) in views.items():
        rows = rows.withColumns({f"_{name}_p": p, f"_{name}_t": t})
    # all functions of a page in one pass through Python
    rows = rows.withColumns({f"{name}_alignment": alignment_counts(F.col(f"_{name}_p"), F.col(f"_{name}_t")) for name in views})
    for name in views:
        rows = rows.withColumn(f"{name}_total", F.size(f"_{name}_t"))
        rows = rows.withColumn(f"{name}_ser", rate(F.col(f"{name}_alignment.edit_distance"), F.col(f"{name}_total"), 100))
    return rows.drop(*(f"_{name}_{side}" for name in views for side in "pt"))


def pooled_chord_metrics(pages: DataFrame, by: list[str]) -> DataFrame:
    """Pooled counters and rates of pages, with mean and population deviation of the pages' rates."""
    out = [F.count("*").alias("pages")]
    for name in ("token", "chord", "root"):
        total = F.sum(f"{name}_total")
        part = lambda field, name=name: F.sum(F.col(f"{name}_alignment.{field}"))
        out += [part(f).alias(f"{name}_{f}") for f in ("edit_distance", "matches", "substitutions", "insertions", "deletions")]
        out += [total.alias(f"{name}_total"), rate(part("edit_distance"), total, 100).alias(f"{name}_ser"), F.avg(f"{name}_ser").alias(f"{name}_ser_mean"), F.stddev_pop(f"{name}_ser").alias(f"{name}_ser_std")]
    return pages.groupBy(*by).agg(*out)


def mean_ignoring_nan(value: Column) -> Column:
    return F.avg(F.when(~F.isnan(value), value))


def bucket_means(values: DataFrame, n_col: str, metric_cols: list[str], by: list[str], cap: int = 9) -> DataFrame:
    """Means by the number of systems, ``cap`` and more together; rows without a number are left out."""
    rows = values.where(F.col(n_col).isNotNull()).withColumn("bucket", F.least(F.col(n_col), F.lit(cap)))
    return rows.groupBy(*by, "bucket").agg(F.count("*").alias("units"), *(F.avg(m).alias(f"mean_{m}") for m in metric_cols))


def page_records(pairs: DataFrame, keys: list[str], pred: str = "pred_text", truth: str = "gt_text", missing: float | None = 100.0) -> DataFrame:
    """(keys, metric, value): cer, ser and ler of the page and of its kern spine, chord_ser and root_ser, in percent.

    Where a chord spine is missing or empty, chord rates are ``missing``; null
    leaves them out of means.
    """
    rows = pairs.select(*keys, F.col(pred).alias("_p"), F.col(truth).alias("_t"))
    made = {"_pk": first_spine(F.col("_p")), "_tk": first_spine(F.col("_t")), "_pt": chord_list(F.col("_p")), "_tt": chord_list(F.col("_t"))}
    rows = rows.withColumns(made)
    rows = rows.withColumns({"_whole": text_errors(F.col("_p"), F.col("_t"), KINDS), "_kern": text_errors(F.col("_pk"), F.col("_tk"), KINDS)})
    rates = [rate(F.col(of)[f"{k}_errors"], F.col(of)[f"{k}_total"]).alias(f"{prefix}{k}") for of, prefix in (("_whole", ""), ("_kern", "kern_")) for k in KINDS]
    scored = page_chord_metrics(rows.select(*keys, "_pt", "_tt", *rates), "_pt", "_tt")
    there = (F.size("_pt") > 0) & (F.size("_tt") > 0)
    value = lambda c: F.when(there | F.lit(missing is not None), F.when(F.size("_tt") > 0, F.col(c)).otherwise(F.lit(missing)))
    out = scored.select(*keys, *KINDS, *(f"kern_{k}" for k in KINDS), value("chord_ser").alias("chord_ser"), value("root_ser").alias("root_ser"))
    records = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in out.columns if c not in keys))
    return out.select(*keys, F.inline(records))
