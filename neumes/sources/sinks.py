"""Writers of results. Large results stay in many files; single files are asked for."""

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, single: bool = False) -> None:
    """A text file (or folder of files) of the one string column, overwritten."""
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def append_lines(lines: DataFrame, path: str) -> None:
    """More lines of a split; those that stand there stay. Files of one folder are one split."""
    lines.write.mode("append").text(path)


def write_texts(texts: DataFrame, path: str, by: list[str], text_col: str = "text") -> None:
    """Texts in folders by key."""
    texts.select(*by, F.col(text_col).alias("value")).write.mode("overwrite").partitionBy(*by).text(path)


def write_csv(table: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in a fixed order, with header; booleans as 1 and 0."""
    kinds = dict(table.dtypes)
    table.select(*(F.col(c).cast("int").alias(c) if kinds[c] == "boolean" else F.col(c) for c in columns)).write.mode("overwrite").option("header", True).csv(path)


def stored_vocabulary(spark, path: str, build) -> DataFrame:
    """The vocabulary at ``path``, built and written if there is none yet."""
    exists = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    if not exists:
        build().write.parquet(path)
    return spark.read.parquet(path)


def shown(value) -> str:
    return "" if value is None else f"{value:.2f}" if isinstance(value, float) else str(value)


def markdown(table: DataFrame, title: str = "", most: int = 1000) -> str:
    """An aggregated table as Markdown; ``(none)`` if it is empty. Rows beyond ``most`` are not shown, and the report says so."""
    found = table.limit(most + 1).collect()
    columns = []
    for i, name in enumerate(table.columns):
        cells = [name, *(shown(r[i]) for r in found[:most])]
        width = max(map(len, cells))
        cells.insert(1, "-" * width)
        columns.append([c + (" " * (width - len(c))) for c in cells])
    lines = [f"| {' | '.join(row)} |" for row in zip(*columns)] if found else ["(none)"]
    if found:
        lines[1] = lines[1].replace(" ", "-")
    if len(found) > most:
        lines.append(f"\nOnly the first {most} rows are shown.")
    return "\n".join(([title, ""] if title else []) + lines) + "\n"


def clipped(metric: Column) -> Column:
    return F.least(metric, F.lit(100.0))


def write_logged(records: DataFrame, path: str, metrics: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """Writes (metric, value, ...) as Parquet and returns what the log says of it: (metric, records, missing, mean), a row for each of ``metrics``.

    Means leave null and NaN out and are of values clipped at 100. They are collected
    while the rows are written: one pass, however many metrics.
    """
    seen, v = Observation(), F.col(value)
    there = v.isNotNull() & ~F.isnan(v)
    named = [(m, F.col(metric) == m) for m in metrics]
    parts = [c for i, (_, own) in enumerate(named) for c in (F.count_if(own).alias(f"n{i}"), F.count_if(own & there).alias(f"k{i}"), F.avg(F.when(own & there, clipped(v))).alias(f"m{i}"))]
    records.observe(seen, *parts).write.mode("overwrite").parquet(path)
    got = seen.get
    rows = [(m, got[f"n{i}"], got[f"n{i}"] - got[f"k{i}"], got[f"m{i}"]) for i, m in enumerate(metrics)]
    return records.sparkSession.createDataFrame(rows, "metric string, records long, missing long, mean double")
