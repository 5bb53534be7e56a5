"""URL filtering against a dated list, as of the time of each capture.

List entries are dated changes: from ``listed`` on, ``pattern`` has ``action``
(block, allow, or none to take it off the list). Per pattern, an entry holds until
the next one; that turns the list into validity intervals. A capture is evaluated
against the intervals that hold at its fetch time, by an as-of join: equal pattern
key, and fetch time inside the interval.

Keys of a capture are its host with all parent domains, and host plus path
prefixes. A list of at most ``most_broadcast`` intervals, which is counted, is
broadcast; a larger one is joined by shuffle, with captures of a host dealt to
``salts`` tasks and the list repeated for each, so that a host that holds a third
of all captures does not end in one task.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIONS = ("allow", "block", "none")


def host_of(url: Column) -> Column:
    """The lower-cased host, without user, port and final dots; empty if there is none."""
    host = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.+$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path without query, fragment and empty segments."""
    path = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.coalesce(path, F.lit(""))


def capture_keys(url: Column) -> Column:
    """(kind, pattern) of all entries that could apply to a URL: domains, then path prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.filter(F.split(path_of(url), "/"), lambda x: x != "")
    prefixes = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat_ws("/", host, F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    keyed = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("pattern")))
    return F.when(host != "", F.concat(keyed("domain", domains), keyed("prefix", prefixes))).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, action, since, until): half-open, until is null for the entry that still holds.

    Of entries of one pattern and date the last in the order of their action
    (allow, block, none) holds. Patterns are compared in lower case. Entries
    without pattern, date or a known action are left out.
    """
    known = entries.select(F.lower(entries["kind"]).alias("kind"), F.lower(entries["pattern"]).alias("pattern"), F.lower(entries["action"]).alias("action"), entries["listed"].cast("timestamp").alias("since"))
    known = known.where(F.col("kind").isNotNull() & F.col("pattern").isNotNull() & F.col("since").isNotNull() & F.col("action").isin(*ACTIONS))
    known = known.groupBy("kind", "pattern", "since").agg(F.max("action").alias("action"))
    return known.withColumn("until", F.lead("since").over(Window.partitionBy("kind", "pattern").orderBy("since"))).where("action <> 'none'")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched", most_broadcast: int = 100_000, salts: int = 16) -> DataFrame:
    """One row per capture: page_id, host, fetched, blocked, pattern, listed.

    Of the entries that apply, the longest pattern decides, then a prefix before a
    domain, then block before allow; pattern and listed are null where none applies.
    URLs that are null or have no host match no entry, as captures without fetch
    time do. Repeated captures are each evaluated. Empty tables give no rows or no
    matches. Other columns are not read.
    """
    rows = captures.select(captures[id_col].cast("long").alias("page_id"), captures[url_col].cast("string").alias("url"), captures[fetched_col].cast("timestamp").alias("fetched"), F.monotonically_increasing_id().alias("row_id"))
    held = intervals(entries)
    keyed = rows.select("page_id", "row_id", "fetched", host_of(F.col("url")).alias("host"), F.explode_outer(capture_keys(F.col("url"))).alias("key")).select("page_id", "row_id", "fetched", "host", "key.kind", "key.pattern")
    on = ["kind", "pattern"]
    if held.limit(most_broadcast + 1).count() <= most_broadcast:
        matched = keyed.join(F.broadcast(held), on, "left")
    else:
        keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
        dealt = held.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        matched = keyed.join(dealt, [*on, "salt"], "left")
    active = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    rank = F.when(active, F.struct(F.length("pattern").alias("length"), F.col("kind"), F.col("action"), F.col("pattern"), F.col("since")))
    best = matched.groupBy("row_id", "page_id", "fetched", "host").agg(F.max(rank).alias("best"))
    return best.select("page_id", "host", "fetched", F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("listed"))
