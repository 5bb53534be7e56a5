"""Paired comparison of models over the same units."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stars
from .positions import positions


def long_form(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, metric, model, value) of columns named <metric>_<model>."""
    rows = wide.unpivot(keys, columns, "column", "value")
    return rows.select(*keys, F.regexp_extract("column", "^(.*)_[^_]*$", 1).alias("metric"), F.substring_index("column", "_", -1).alias("model"), "value")


def wide_form(values: DataFrame, keys: list[str], model: str, names: list[str], value: str, complete: bool = True) -> DataFrame:
    """A column for each model; with ``complete``, only keys that all models have."""
    wide = values.groupBy(*keys).pivot(model, names).agg(F.first(value))
    return wide.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names)) if complete else wide


def paired_stats(pairs: DataFrame, by: list[str], base: str, other: str, tolerance: float = 0.0) -> DataFrame:
    """Counts, medians, mean difference, wins, ties and losses of ``other`` against ``base``; lower is better."""
    rows = pairs.where(F.col(base).isNotNull() & F.col(other).isNotNull()).withColumn("_d", F.col(base) - F.col(other))
    d = F.col("_d")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.median(base).alias("base_median"), F.median(other).alias("other_median"), F.median(d).alias("median_diff"), F.avg(d).alias("mean_diff"),
        F.count_if(d > tolerance).alias("wins"), F.count_if(F.abs(d) <= tolerance).alias("ties"), F.count_if(d < -tolerance).alias("losses"),
    )


def signed_ranks(pairs: DataFrame, by: list[str], base: str, other: str) -> DataFrame:
    """(by, n, w_plus, w_minus): rank sums of the absolute differences, zeros left out, ties at their mean rank."""
    d = pairs.withColumn("_d", F.col(base) - F.col(other)).where("_d <> 0").withColumn("_a", F.abs("_d"))
    tied = d.groupBy(*by, "_a").agg(F.count("*").alias("_n"), F.count_if(F.col("_d") > 0).alias("_p"))
    counted = positions(tied, by, ["_a"], ["_n"])  # one metric may hold all differences: ranges of it are counted apart
    ranked = counted.withColumn("_r", F.col("upto__n") - F.col("_n") + (F.col("_n") + 1) / 2.0)
    return ranked.groupBy(*by).agg(F.sum("_n").alias("n"), F.sum(F.col("_r") * F.col("_p")).alias("w_plus"), F.sum(F.col("_r") * (F.col("_n") - F.col("_p"))).alias("w_minus"), F.sum(F.pow(F.col("_n").cast("double"), 3) - F.col("_n")).alias("tie_term"))


def upper_tail(n: int, w: float, ties: float, exact_to: int) -> float:
    """P(W+ >= w) without a difference: by all sign patterns for small n without ties, else the normal limit."""
    if n == 0:
        return 1.0
    if n <= exact_to and not ties:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return float(ways[int(np.ceil(w)) :].sum() / 2.0**n)
    from math import erfc, sqrt

    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 0.5 * erfc((w - n * (n + 1) / 4) / sqrt(2 * spread)) if spread > 0 else 1.0


def wilcoxon_p(n: Column, w_plus: Column, tie_term: Column, exact_to: int = 50) -> Column:
    """One-sided p-value that differences tend to be positive. Called on a row for each comparison."""

    @F.arrow_udf("double")
    def run(n: pa.Array, w: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([upper_tail(int(a or 0), float(b or 0), float(c or 0), exact_to) for a, b, c in zip(n.to_pylist(), w.to_pylist(), t.to_pylist())], pa.float64())

    return run(n.cast("long"), w_plus.cast("double"), tie_term.cast("double"))


def holm(tests: DataFrame, p: str, family: list[str], tie_break: list[str]) -> DataFrame:
    """Adds p_adj: Holm's step-down over each family of tests."""
    order = Window.partitionBy(*family).orderBy(p, *tie_break)
    ranked = tests.withColumns({"_i": F.row_number().over(order), "_m": F.count("*").over(Window.partitionBy(*family))})
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("p_adj", F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_m") - F.col("_i") + 1)).over(run))).drop("_i", "_m")


def significance(values: DataFrame, unit: str, base: str, models: list[str]) -> DataFrame:
    """(metric, model, n, ..., p_raw, p_adj, sig) from long (unit, model, metric, value), NaN as missing.

    Each model is compared with ``base`` on the units that both have; Holm runs over
    all rows of the result, which has one for each metric and model.
    """
    clean = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    first = clean.where(F.col("model") == base).select(unit, "metric", F.col("value").alias("base_value"))
    pairs = clean.where(F.col("model").isin(models)).select(unit, "metric", "model", F.col("value").alias("other_value")).join(first, [unit, "metric"])
    keys = ["metric", "model"]
    stats = paired_stats(pairs, keys, "base_value", "other_value")
    ranks = signed_ranks(pairs, keys, "base_value", "other_value").withColumnRenamed("n", "n_ranked")
    tests = stats.join(ranks, keys, "left").withColumn("p_raw", wilcoxon_p(F.col("n_ranked"), F.col("w_plus"), F.col("tie_term")))
    return holm(tests, "p_raw", [], keys).withColumn("sig", stars(F.col("p_adj"))).drop("n_ranked", "tie_term", "w_minus")


def with_overall_metrics(table: DataFrame, predictions: DataFrame, models: dict[str, str], page: str = "page", truth: str = "gt") -> DataFrame:
    """``table`` with <name>_cer, _ser and _ler of whole texts; pages without all of their texts have nulls.

    ``models``: names by the column of ``predictions`` that holds a model's text.
    """
    from .metrics import KINDS, rate, with_text_errors

    rows = predictions.where(F.col(truth).isNotNull())
    columns = []
    for column, name in models.items():
        rows = with_text_errors(rows.where(F.col(column).isNotNull()), column, truth)
        rows = rows.withColumns({f"{name}_{k}": rate(F.col(f"{k}_errors"), F.col(f"{k}_total")) for k in KINDS})
        columns += [f"{name}_{k}" for k in KINDS]
    return table.join(rows.select(page, *columns), page, "left")


def common_units(values: DataFrame, unit: str, model: str) -> DataFrame:
    """Units that every model of the table has."""
    models = values.select(model).distinct()
    each = values.groupBy(unit).agg(F.count_distinct(model).alias("models"))
    return each.join(F.broadcast(models.agg(F.count("*").alias("models"))), "models").select(unit)


def with_columns_of(table: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the columns of another one by key; rows without a match keep theirs, with nulls."""
    return table.join(other, keys, "left")


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(op, key): keys of either side (union), of both (intersect) and of the left alone (except), each once."""
    a, b = left.select(key), right.select(key)
    sets = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.join(b, key, "left_anti").distinct()}
    out = None
    for name, keys in sets.items():
        part = keys.select(F.lit(name).alias("op"), key)
        out = part if out is None else out.unionByName(part)
    return out


def missing_units(left: DataFrame, right: DataFrame, unit: str) -> DataFrame:
    return left.select(unit).distinct().join(right, unit, "left_anti")


def dataset_diff(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows on one side only, or with different columns: (keys, status, differing)."""
    a = left.select(*keys, F.struct(*columns).alias("_a"), F.lit(1).alias("_ia"))
    b = right.select(*keys, F.struct(*columns).alias("_b"), F.lit(1).alias("_ib"))
    both = a.join(b, keys, "full")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns)))
    status = F.when(F.col("_ia").isNull(), "right_only").when(F.col("_ib").isNull(), "left_only").when(F.size(differ) > 0, "different")
    return both.select(*keys, status.alias("status"), F.when(F.col("_ia").isNotNull() & F.col("_ib").isNotNull(), differ).otherwise(F.array().cast("array<string>")).alias("differing")).where("status IS NOT NULL")


def positional_diff(left: DataFrame, right: DataFrame, by: list[str], order: str, shown: int = 10) -> DataFrame:
    """The first differences of two splits (n, text, width, height), compared row by row within each group.

    Rows of another n are not compared further; sizes of an unread image are null.
    Also told is how many rows each group has on either side.
    """
    numbered = lambda d: positions(d.select(*by, order, "n", "text", "width", "height"), by, [order])
    side = lambda d, p: numbered(d).select(*by, (F.col("position") - 1).alias("row"), *(F.col(c).alias(f"{p}_{c}") for c in ("n", "text", "width", "height")))
    both = side(left, "l").join(side(right, "r"), [*by, "row"])
    same = lambda c: F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
    unread = F.col("l_width").isNull() | F.col("r_width").isNull()
    n = F.when(~same("n"), F.array(F.lit("n"))).otherwise(F.array_compact(F.array(F.when(~same("text"), F.lit("text")), F.when(unread, F.lit("unreadable")).when(~(same("width") & same("height")), F.lit("shape")))))
    found = both.select(*by, "row", F.explode(n).alias("kind"))
    place = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("row"))
    first = found.withColumn("place", place).where(F.col("place") <= shown).drop("place")  # each task sends its first ones only
    return first.join(found.groupBy(*by, "kind").agg(F.count("*").alias("mismatches")), [*by, "kind"])


def size_mismatches(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Groups with other numbers of rows on either side."""
    count = lambda d, name: d.groupBy(*by).agg(F.count("*").alias(name))
    both = count(left, "left_rows").join(count(right, "right_rows"), by, "full").fillna(0, ["left_rows", "right_rows"])
    return both.where("left_rows <> right_rows")
