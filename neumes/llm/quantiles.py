"""Operator 12: mergeable quantile summaries by greedy bucket histograms.

Rows are counted by distinct value. Within each group a cumulative window packs
values into disjoint buckets (low, high, count): a value that alone holds a share
of 1/cells of the rows is heavy and gets a bucket of its own, the others fall into
the cell of the rows below them, so that a bucket of several values holds less
than 2/cells of the rows. Cells are also cut at equal numbers of distinct values,
so that a summary never has fewer buckets than ``least`` while there are values.

Summaries merge without the rows. Both ends of a bucket are values that occur, so
each holds a row at least; the other rows of a bucket are spread evenly between
its ends. Where buckets of several summaries overlap, the rows up to each of their
ends add up, and the points and gaps that result are packed again in the same way. A rank read from
the merged summary is off by one partly covered bucket of each part and one packed
bucket at most: less than 2/600 + 2/500 of the rows and one row, below 1 %.

Groups may be of any size: running counts come from ranges of the sorted values,
not from one task a group, and a merge sees only summaries, whose size is bounded.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neumes.operators.positions import positions

from .common import written

#: Rows that share a part of a group; ``WHOLE`` marks the merged group.
BATCHES, WHOLE = 16, -1
#: Money beyond this has no exact cents in a double.
MOST = 9e13


def batch_of(id_col: Column) -> Column:
    return (F.crc32(id_col.cast("string").cast("binary")) % BATCHES).cast("int")


def values(money: Column, batch: Column) -> Column:
    """Cents of a money amount, shifted by 10 for each batch."""
    return F.floor(100 * money.cast("double") + 0.5) + 1000 * batch


def usable(money: Column) -> Column:
    """False for null, infinite, NaN and amounts beyond 9e13."""
    return F.coalesce(F.abs(money.cast("double")) <= MOST, F.lit(False))


def click_counts(clicks: DataFrame) -> DataFrame:
    """stream, grp, batch, x, rows: values of clicks by client.

    Rows of one click_id are one click; should they differ, its smallest client and
    value count. Rows lacking id, client or value take no part.
    """
    one = clicks.select("click_id", "client_id", "value").groupBy("click_id").agg(F.min("client_id").alias("client_id"), F.min("value").alias("value"))
    rows = one.filter(F.col("click_id").isNotNull() & F.col("client_id").isNotNull() & usable(F.col("value")))
    rows = rows.select(F.col("client_id").cast("string").alias("grp"), batch_of(F.col("click_id")).alias("batch"), "value")
    return _counted(rows.select(F.lit("value").alias("stream"), "grp", "batch", values(F.col("value"), F.col("batch")).alias("x"), F.lit(1).cast("long").alias("rows")))


def price_counts(lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream, grp, batch, x, rows: prices of the items of sale lines, by brand.

    Lines are counted by item and batch before they meet the items, so that an item
    that holds a third of the lines sends 16 rows. Rows lacking item, vendor, brand
    or price take no part.
    """
    few = lines.filter(F.col("item_id").isNotNull() & F.col("vendor_id").isNotNull()).select("item_id", batch_of(F.col("vendor_id")).alias("batch"))
    few = few.groupBy("item_id", "batch").agg(F.count("*").alias("rows"))
    known = items.filter(F.col("brand").isNotNull() & usable(F.col("price"))).select("item_id", F.col("brand").cast("string").alias("grp"), "price")
    met = few.join(known, "item_id")
    return _counted(met.select(F.lit("price").alias("stream"), "grp", "batch", values(F.col("price"), F.col("batch")).alias("x"), "rows"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("stream", "grp", "batch", "x").agg(F.sum("rows").alias("rows"))


def summaries(ranked: DataFrame, keys: Sequence[str], cells: int = 600, least: int = 20) -> DataFrame:
    """keys, low, high, rows, and exactly known: before (rows below low), total, top (rows of high).

    ``ranked`` has the distinct values x of each group with rows and their positions.
    The bucket of a value is named by whether it is heavy, its cell and its slice of the
    distinct values; a heavy value moves the rows below by a cell at least, so that no
    cell is met again behind it.
    """
    before = F.col("upto_rows") - F.col("rows")
    # whole numbers are divided as such: no rounding moves a value to another bucket
    cell = F.expr(f"cast((upto_rows - rows) * {cells} div total_rows as int)").alias("cell")
    part = F.expr(f"cast((position - 1) * {least} div group_rows as int)").alias("slice")
    heavy = (F.col("rows") * cells >= F.col("total_rows")).alias("heavy")
    rows = ranked.select(*keys, "x", "rows", before.alias("before"), "total_rows", heavy, cell, part)
    packed = rows.groupBy(*keys, "cell", "slice", "heavy").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.sum("rows").alias("rows"), F.min("before").alias("before"), F.max("total_rows").alias("total"), F.max_by("rows", "x").alias("top")
    )
    return packed.select(*keys, "low", "high", "rows", "before", "total", "top")


def _rows_upto(bucket: Column, x: Column) -> Column:
    """Rows of a part up to x, by its last bucket that begins at x or before; none if there is no such bucket.

    Both ends of a bucket hold a row; those between are spread evenly, in whole rows.
    """
    low, high, rows, before = (bucket[c] for c in ("low", "high", "rows", "before"))
    between = F.floor((rows - 2) * ((x - low) / (high - low)))
    return F.when(bucket.isNull(), 0).when(x >= high, before + rows).when(x < low, before).otherwise(before + 1 + between)


def merged(parts: DataFrame, keys: Sequence[str], part: str = "batch", numbers: Sequence[int] = tuple(range(BATCHES)), cells: int = 500, least: int = 20) -> DataFrame:
    """keys, low, high, rows, before, total: the summary of the summaries of a key's parts, which are named by ``numbers``.

    Reads nothing but the buckets of ``parts``. At each end of a bucket the rows up to it
    are the sum over the parts of what their buckets there have, in whole numbers, so
    that no rounding gathers; these points and the gaps between them are packed again.
    A key has as many rows here as its summaries have bucket ends, however many rows
    they stand for.
    """
    # few keys have so many rows that a bucket holds several values; the others take a shorter way
    wide = written(parts.filter(F.col("low") < F.col("high")).select(*keys).distinct(), "wide-groups")
    single = _single_points(parts.join(wide, list(keys), "left_anti"), keys)
    spread = _spread_points(parts.join(wide, list(keys), "left_semi"), keys, part, numbers)
    return _repacked(single, keys, cells, least).unionByName(_repacked(spread, keys, cells, least))


def _single_points(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x, upto, below: rows up to and below each value, of keys whose buckets all hold one value."""
    points = parts.groupBy(*keys, F.col("low").alias("x")).agg(F.sum("rows").alias("rows"))
    points = points.withColumn("upto", F.sum("rows").over(Window.partitionBy(*keys).orderBy("x")))
    return points.select(*keys, "x", "upto", (F.col("upto") - F.col("rows")).alias("below"))


def _spread_points(parts: DataFrame, keys: Sequence[str], part: str, numbers: Sequence[int]) -> DataFrame:
    """As ``_single_points``, at the ends of buckets of any kind: of each part the last bucket that begins there or before tells its rows."""
    bucket = F.struct("low", "high", "rows", "before")
    first, last = F.struct(F.col("low").alias("x"), bucket.alias("bucket")), F.struct(F.col("high").alias("x"), F.lit(None).alias("bucket"))
    met = parts.select(*keys, part, F.inline(F.when(F.col("low") < F.col("high"), F.array(first, last)).otherwise(F.array(first))))
    ordered = Window.partitionBy(*keys).orderBy("x")
    met = met.withColumns({f"_{k}": F.last(F.when(F.col(part) == n, F.col("bucket")), True).over(ordered) for k, n in enumerate(numbers)})
    upto = lambda x: sum((_rows_upto(F.col(f"_{k}"), x) for k in range(len(numbers))), F.lit(0)).cast("long")
    points = met.select(*keys, "x", upto(F.col("x")).alias("upto"), upto(F.col("x") - 1).alias("below"))
    return points.groupBy(*keys, "x").agg(F.max("upto").alias("upto"), F.max("below").alias("below"))


def _repacked(points: DataFrame, keys: Sequence[str], cells: int, least: int) -> DataFrame:
    """Points, and the gaps between them that hold rows, packed into buckets."""
    group = Window.partitionBy(*keys)
    ordered = group.orderBy("x")
    points = points.withColumns({"next": F.lead("x").over(ordered), "then": F.lead("below").over(ordered), "place": F.row_number().over(ordered) - 1, "places": F.count("*").over(group), "total": F.max("upto").over(group)})
    span = lambda low, high, before, rows: F.struct(low.alias("low"), high.alias("high"), before.alias("before"), rows.alias("rows"))
    own, gap = span(F.col("x"), F.col("x"), F.col("below"), F.col("upto") - F.col("below")), span(F.col("x") + 1, F.col("next") - 1, F.col("upto"), F.col("then") - F.col("upto"))
    spans = points.select(*keys, "place", "places", "total", F.inline(F.when(F.col("then") > F.col("upto"), F.array(own, gap)).otherwise(F.array(own))))
    packed = spans.select(
        *keys, "low", "high", "rows", "before", "total", (F.col("rows") * cells >= F.col("total")).alias("heavy"),
        F.expr(f"cast(before * {cells} div total as int)").alias("cell"), F.expr(f"cast(place * {least} div places as int)").alias("slice"),
    )
    packed = packed.groupBy(*keys, "cell", "slice", "heavy").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows"), F.min("before").alias("before"), F.max("total").alias("total"))
    return packed.select(*keys, "low", "high", "rows", "before", "total")


def steps_within(before: Column, upto: Column, total: Column, steps: int) -> Column:
    """The i of 1..steps-1 whose ceil(i * total / steps)-th smallest row is behind ``before`` rows and within ``upto``."""
    begin, end = F.floor(before * steps / total) + 1, F.least(F.floor(upto * steps / total), F.lit(steps - 1))
    return F.when(begin <= end, F.sequence(begin, end)).otherwise(F.array().cast("array<bigint>"))


def answers(buckets: DataFrame, keys: Sequence[str], steps: int = 20) -> DataFrame:
    """keys, i, total, target, answer, points and the other columns of the bucket: the upper end of the bucket that holds the target."""
    points = F.count("*").over(Window.partitionBy(*keys)).alias("points")
    asked = buckets.filter(F.col("total") >= steps).select("*", points)
    asked = asked.withColumn("i", F.explode(steps_within(F.col("before"), F.col("before") + F.col("rows"), F.col("total"), steps)))
    return asked.withColumns({"target": target(F.col("i"), F.col("total"), steps), "answer": F.col("high")})


def target(i: Column, total: Column, steps: int) -> Column:
    return F.floor((i * total + steps - 1) / steps)


def exact_steps(ranked: DataFrame, keys: Sequence[str], steps: int = 20) -> DataFrame:
    """keys, i, n, exact_x: the exact values at the targets of all groups of at least ``steps`` rows."""
    here = steps_within(F.col("upto_rows") - F.col("rows"), F.col("upto_rows"), F.col("total_rows"), steps)
    return ranked.filter(F.col("total_rows") >= steps).select(*keys, F.col("x").alias("exact_x"), F.col("total_rows").alias("n"), F.explode(here).alias("i"))


def quantile_report(counts: DataFrame, steps: int = 20, permille: int = 10) -> DataFrame:
    """Summaries of all batches of each group, and of the groups by merging those, with exact ranks beside the answers.

    ``counts`` has stream, grp, batch, x, rows, once for each value. Groups and batches
    of fewer than ``steps`` rows are summarised and merged, but have no answers; no
    rows, no answers. Rows of a result: stream, grp, batch (-1: merged), i, n, target,
    exact_x, points, answer, n_below, n_upto, rank_error, within. Ties are rows of one
    value and never split.
    """
    batch, whole = ["stream", "grp", "batch"], ["stream", "grp"]
    ranked = positions(counts, batch, ["x"], ["rows"])
    parts = written(summaries(ranked, batch), "summaries")
    each = answers(parts, batch, steps).withColumns({"n_upto": F.col("before") + F.col("rows"), "n_below": F.col("before") + F.col("rows") - F.col("top")})
    each = each.join(exact_steps(ranked, batch, steps).drop("n"), [*batch, "i"]).withColumn("n", F.col("total"))
    asked = written(answers(merged(parts, whole), whole, steps), "answers")
    # values and answers in one table, once each: an answer between values adds no rows
    values = counts_of(ranked).unionByName(asked.select(*whole, F.col("answer").alias("x"), F.lit(0).cast("long").alias("rows"), F.lit(1).alias("asked")))
    values = positions(values.groupBy(*whole, "x").agg(F.sum("rows").alias("rows"), F.max("asked").alias("asked")), whole, ["x"], ["rows"])
    known = values.filter("asked = 1").select(*whole, F.col("x").alias("answer"), F.col("upto_rows").alias("n_upto"), (F.col("upto_rows") - F.col("rows")).alias("n_below"))
    rest = asked.join(known, [*whole, "answer"]).join(exact_steps(values, whole, steps), [*whole, "i"]).withColumn("batch", F.lit(WHOLE))
    columns = [*batch, F.col("i").cast("int").alias("i"), "n", "target", "exact_x", "points", "answer", "n_below", "n_upto"]
    out = each.select(*columns).unionByName(rest.select(*columns))
    error = F.greatest(F.lit(0).cast("long"), F.col("n_below") + 1 - F.col("target"), F.col("target") - F.col("n_upto"))
    return out.withColumn("rank_error", error).withColumn("within", 1000 * F.col("rank_error") <= permille * F.col("n"))


def counts_of(ranked: DataFrame) -> DataFrame:
    return ranked.select("stream", "grp", "x", "rows", F.lit(0).alias("asked"))
