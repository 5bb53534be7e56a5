"""Staged training sets: who is eligible at a stage, replay of earlier ones, sampling by hash."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_maxima(samples: DataFrame, page: str, n: str) -> DataFrame:
    """Adds page_max_n: the largest n of a page; a sample without page has its own."""
    most = F.max(n).over(Window.partitionBy(page))
    return samples.withColumn("page_max_n", F.when(F.col(page).isNull(), F.col(n)).otherwise(most))


def eligible_prefixes(samples: DataFrame, stages: list[int], final_stage: int, n: str = "n") -> DataFrame:
    """Adds stage: samples with n = min(stage, page_max_n), or page_max_n from the final stage on."""
    rows = samples.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    target = F.when(F.col("stage") >= final_stage, F.col("page_max_n")).otherwise(F.least("stage", "page_max_n"))
    return rows.where(F.col(n) == target)


def eligible_stacks(samples: DataFrame, stages: list[int], max_n: int, n: str = "n") -> DataFrame:
    """Adds stage: samples with n = min(stage, max_n); also the rule of validation sets."""
    rows = samples.withColumn("stage", F.explode(F.array(*map(F.lit, stages))))
    return rows.where(F.col(n) == F.least("stage", F.lit(max_n)))


def hash_order(id_col: Column, seed: int | str) -> Column:
    """An order that depends on id and seed only."""
    return F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))))


def hash_sample(rows: DataFrame, by: list[str], id_col: str, share: float, seed: int | str, digits: int = 4) -> DataFrame:
    """Of each group max(1, round(share * size)) rows in hash order, halves to even.

    Hashes are counted by their first ``digits`` (16 ** digits buckets): all rows below
    the bucket in which a group's sample ends stay, and only that bucket is ranked. No
    group, however large, is sorted in one task.
    """
    hashed = rows.withColumn("_h", hash_order(F.col(id_col), seed)).withColumn("_b", F.substring("_h", 1, digits))
    group = Window.partitionBy(*by)
    sizes = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_c"))
    so_far = F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = sizes.withColumns({"_to": so_far, "_n": F.sum("_c").over(group)}).withColumn("_k", F.greatest(F.lit(1), F.bround(F.col("_n") * share, 0)))
    ends = ends.where("_to >= _k AND _to - _c < _k").select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col("_b").alias("_last"), (F.col("_k") - F.col("_to") + F.col("_c")).alias("_left"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = hashed.join(ends, same).where("_b <= _last")
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", id_col))
    return within.withColumn("_r", place).where("_b < _last OR _r <= _left").select(*rows.columns)


def epoch(eligible: DataFrame, stage: int, share: float, id_col: str, seed: int | str, train: bool = True) -> DataFrame:
    """The samples of a stage with its replay of each earlier stage's own pool, marked by ``origin``."""
    now = eligible.where(F.col("stage") == stage).withColumn("origin", F.lit("current"))
    if not train or stage <= 1 or share <= 0:
        return now
    earlier = hash_sample(eligible.where(F.col("stage") < stage), ["stage"], id_col, share, seed)
    return now.unionByName(earlier.withColumn("origin", F.lit("replay")))


def online_epoch(spark, length: int, stage: int, share: float, real: DataFrame | None = None, final_stage: int | None = None) -> DataFrame:
    """(kind, n, draw): ``length`` stacks of the stage, a share of that for each earlier one, and real entries at the end."""
    again = max(1, round(share * length)) if share > 0 else 0
    plan = spark.createDataFrame([("stack", stage, length)] + [("stack", s, again) for s in range(1, stage) if again], "kind string, n int, times int")
    out = plan.select("kind", "n", F.explode(F.sequence(F.lit(1), "times")).alias("draw"))
    if real is not None and final_stage is not None and stage >= final_stage:
        out = out.unionByName(real.select(F.lit("real").alias("kind"), "n", F.lit(0).alias("draw")))
    return out


def epoch_limit(rows: DataFrame, id_col: str, seed: int | str, size: int) -> DataFrame:
    """At most ``size`` samples of a shuffled epoch."""
    return rows.orderBy(hash_order(F.col(id_col), seed), id_col).limit(size)


def integrity_violations(samples: DataFrame, n: str, expected: Column, shown: int = 5) -> DataFrame:
    """The first samples whose n is another than expected; none if all is well."""
    return samples.where(F.col(n) != expected).orderBy(n).limit(shown)


def stage_of_epoch(epoch_col: Column, increment: int, start: int, stages: int) -> Column:
    return F.least(F.floor(epoch_col / increment).cast("int") + start, F.lit(start + stages - 1))


def decode_length(stage: Column, most: int) -> Column:
    """How long a decoded text may be: 550 tokens for each system, 512 at least."""
    return F.least(F.lit(most), F.greatest(F.lit(512), 550 * stage))


def accumulation(stage: Column, cutoff: int, steps: int, rate: float) -> Column:
    """STRUCT<accumulate, learning_rate>: more steps and a larger rate up to the cutoff stage."""
    early = stage <= cutoff
    return F.struct(F.when(early, steps).otherwise(1).alias("accumulate"), F.when(early, rate * steps).otherwise(rate).alias("learning_rate"))
