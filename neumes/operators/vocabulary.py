"""Vocabularies: building, encoding, decoding, padding."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import positions

PAD = "<pad>"


def build(tokens: DataFrame, token_col: str = "tokens") -> DataFrame:
    """(token, id): distinct tokens numbered from 1 in lexicographic order, with <pad> as 0.

    Numbers come from ranges of the sorted tokens, so that a vocabulary of any size is
    numbered by many tasks.
    """
    words = tokens.select(F.explode(token_col).alias("token")).where("token IS NOT NULL").distinct()
    numbered = positions(words.where(F.col("token") != PAD), [], ["token"]).select("token", F.col("position").alias("id"))
    return numbered.unionByName(words.sparkSession.createDataFrame([(PAD, 0)], "token string, id long"))


def encode(samples: DataFrame, vocabulary: DataFrame, id_col: str, token_col: str = "tokens", unknown: int = 0) -> DataFrame:
    """(id, ids): tokens looked up by a join, in their order; unknown ones get ``unknown``."""
    flat = samples.select(id_col, F.posexplode(token_col).alias("pos", "token"))
    found = flat.join(vocabulary.withColumnRenamed("id", "_id"), "token", "left")
    return found.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_id", F.lit(unknown)).alias("i")))), lambda x: x["i"]).alias("ids"))


def decode(samples: DataFrame, vocabulary: DataFrame, id_col: str, ids_col: str = "ids") -> DataFrame:
    flat = samples.select(id_col, F.posexplode(ids_col).alias("pos", "_id"))
    found = flat.join(vocabulary.withColumnRenamed("id", "_id"), "_id", "left")
    return found.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def padded(ids: Column, length: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), F.greatest(length - F.size(ids), F.lit(0))))


def batches(samples: DataFrame, order: str, size: int, ids_col: str = "ids", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds batch_id, and pads ids to the longest of their batch. Samples are numbered by ranges, so one group takes many tasks."""
    rows = positions(samples, by, [order]).withColumn("batch_id", F.floor((F.col("position") - 1) / size)).drop("position", "group_rows")
    return rows.withColumn("padded", padded(F.col(ids_col), F.max(F.size(ids_col)).over(Window.partitionBy(*by, "batch_id"))))


def with_noise(ids: Column, key: Column, vocabulary_size: int, share: float = 0.2, seed: int = 42, pad: int = 0) -> Column:
    """Ids with a share of them, but for the first and padding, replaced by a uniform one; from hashes, so repeatable in any engine."""
    drawn = lambda i, salt: F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"), F.lit(str(seed)), F.lit(salt))), 1, 8), 16, 10).cast("long")
    noisy = lambda x, i: (i > 0) & (x != pad) & (drawn(i, "u") % 1_000_000 < int(share * 1_000_000))
    return F.transform(ids, lambda x, i: F.when(noisy(x, i), drawn(i, "v") % vocabulary_size).otherwise(x))


def longest(samples: DataFrame, token_col: str = "tokens", headroom: float = 1.1) -> DataFrame:
    """(max_length): the longest sequence with headroom, cut to a whole number."""
    return samples.agg((F.max(F.size(token_col)) * headroom).cast("int").alias("max_length"))
