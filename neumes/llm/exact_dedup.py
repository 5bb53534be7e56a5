"""Exact deduplication that treats frequent digests apart from the rest.

1. One pass over the texts writes a compact table of digests.
2. Misra-Gries summaries of its partitions, merged to one of ``counters``
   entries, hold every digest that more than 1/(counters+1) of the rows carry.
3. An exact pass over these candidates finds size and winner of each; at most
   ``counters`` rows are broadcast, and the copies are settled on the map side.
4. The other digests, none of them frequent, are shuffled and ranked.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, limit_batches, written


def misra_gries(pairs, counters: int) -> dict:
    """The summary of (key, weight) pairs in at most ``counters`` entries."""
    held: dict = {}
    for key, weight in pairs:
        held[key] = held.get(key, 0) + weight
        if len(held) > 2 * counters:
            held = shrunk(held, counters)
    return shrunk(held, counters)


def shrunk(held: dict, counters: int) -> dict:
    """Subtracts the (counters+1)-th largest count from all; at most ``counters`` stay positive."""
    if len(held) <= counters:
        return held
    less = sorted(held.values(), reverse=True)[counters]
    return {k: n - less for k, n in held.items() if n > less}


def frequent(digests: DataFrame, counters: int) -> DataFrame:
    """Candidates (digest, least): all digests of more than 1/(counters+1) of the rows are among them."""

    def summary(batches):
        def pairs():
            for b in batches:  # each distinct digest of a batch once
                found = pa.table({"digest": b.column(0), "least": b.column(1)}).group_by("digest").aggregate([("least", "sum")])
                yield from zip(found["digest"].to_pylist(), found["least_sum"].to_pylist())

        held = misra_gries(pairs(), counters)
        yield pa.record_batch({"digest": pa.array(list(held), pa.binary()), "least": pa.array(list(held.values()), pa.int64())})

    one = digests.select("digest", F.lit(1).cast("long").alias("least"))
    schema = "digest binary, least long"
    first = one.mapInArrow(summary, schema)
    # merged by levels, so that no task reads more than some dozens of summaries of bounded size
    level = first
    n = digests.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // 32)
        level = level.repartition(n).mapInArrow(summary, schema)
    return level


def bare(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 4096) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical without the white space [\\x20\\x09-\\x0D];
    null counts as empty, and all empty texts form one group. Of a group, the
    row with the most code points in its original text stays, then the smallest
    doc_id (null after all others). Rows that repeat a doc_id with equal texts
    are ranked as they come, and exactly one row of each group is kept. An
    empty table gives no rows. Other columns of ``docs`` are not read.
    """
    limit_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = written(
        id_and_text(docs, id_col, text_col).select("doc_id", F.char_length(text).cast("long").alias("n_chars"), F.unhex(F.sha2(bare(text), 256)).alias("digest"), F.monotonically_increasing_id().alias("row_id")),
        "digests",
    )
    # the winner is the least of these in the order of its fields
    rank = F.struct((-F.col("n_chars")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_id"))
    candidates = F.broadcast(frequent(digests, counters).select("digest"))  # at most ``counters`` rows
    winners = written(digests.join(candidates, "digest").groupBy("digest").agg(F.min(rank).alias("best"), F.count("*").alias("group_size")), "winners")
    hot = F.broadcast(winners)  # at most ``counters`` rows

    result = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_chars"]
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    settled = digests.join(hot, "digest").select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("best.row_id") == F.col("row_id")).alias("kept"), sha, "n_chars")
    group = Window.partitionBy("digest")
    ordered = group.orderBy("rank")
    others = (
        digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
        .withColumn("rank", rank)
        .select("*", F.row_number().over(ordered).alias("place"), F.first("doc_id").over(ordered).alias("keep_id"), F.count("*").over(group).alias("group_size"))
        .select("doc_id", "keep_id", "group_size", (F.col("place") == 1).alias("kept"), sha, "n_chars")
    )
    return settled.select(result).unionAll(others.select(result))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one of each group of equal texts.

    Rows that repeat a doc_id, or have none, are told apart by their text as well; of
    rows equal in both the one with the longest original text stays.
    """
    result = exact_dedup(docs, id_col, text_col, **options)
    known = docs.groupBy(id_col).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | F.col(id_col).isNull())
    # rows travel whole, in one column, so that no name can clash
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("body"))
    if known.isEmpty():
        return rows.join(result.where(~F.col("kept")).select(F.col("doc_id").alias("id")), "id", "left_anti").select("row.*")
    stay = result.where("kept").select(F.col("doc_id").alias("stays"), F.col("text_sha256").alias("digest"))
    marked = rows.withColumn("sha", F.sha2(bare(F.col("body")), 256)).withColumn("chars", F.char_length("body"))
    held = marked.join(stay, F.col("id").eqNullSafe(F.col("stays")) & (F.col("sha") == F.col("digest")), "left_semi")
    place = F.row_number().over(Window.partitionBy("sha", "id").orderBy(F.desc("chars")))
    return held.withColumn("place", place).where("place = 1").select("row.*")
