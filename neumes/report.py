"""A report on predictions of several models: rates, significance, and where two models differ."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import compare, forensics, metrics
from .sources import files, scans, sinks


def long_texts(pages: DataFrame, models: list[str]) -> DataFrame:
    """(page, model, pred_text, gt_text, error) of (page, gt, <model>...); a page that a model has no text of failed."""
    one = lambda m: F.struct(F.lit(m).alias("model"), F.col(m).alias("pred_text"))
    rows = pages.where(F.col("gt").isNotNull()).select("page", F.col("gt").alias("gt_text"), F.inline(F.array(*map(one, models))))
    return rows.withColumn("error", F.when(F.col("pred_text").isNull(), "no prediction"))


def sections(pages: DataFrame, models: list[str]) -> list[tuple[str, DataFrame]]:
    """(title, table) of a report; the first model is the one that the others are compared with."""
    texts = long_texts(pages, models)
    out = [("Error rates", metrics.model_evaluation(texts).orderBy("model"))]
    records = metrics.page_records(texts.where(F.col("error").isNull()), ["page", "model"])
    means = records.groupBy("metric", "model").agg(F.count("*").alias("pages"), metrics.mean_ignoring_nan(sinks.clipped(F.col("value"))).alias("mean"))
    out.append(("Means of pages, clipped at 100", means.orderBy("metric", "model")))
    if len(models) > 1:
        out.append((f"Significance against {models[0]}", compare.significance(records, "page", models[0], models[1:]).orderBy("metric", "model")))
    if len(models) == 2:
        found = forensics.process_pages(both(pages, models), "page", "gt", dict(zip(("baseline", "replay"), models)))
        labels = forensics.model_labels(found).withColumn("model", F.when(F.col("model") == "baseline", models[0]).otherwise(models[1]))
        counted = forensics.confusions(labels.where("label <> 'correct'"), ["level"])
        out += [
            ("Errors of both", forensics.shared_errors(found).orderBy("level")),
            (f"Errors of {models[0]} alone", forensics.error_types(found, "replay").orderBy("level", F.desc("count"), "label")),
            (f"Errors of {models[1]} alone", forensics.error_types(found, "baseline").orderBy("level", F.desc("count"), "label")),
            ("Most frequent confusions", forensics.top_by_count(counted, ["level", "model"], 10, ["gt", "pred"]).drop("first").orderBy("level", "model", "place")),
        ]
    return out


def both(pages: DataFrame, models: list[str]) -> DataFrame:
    """Pages with a text of the truth and of all models."""
    return pages.where(" AND ".join(f"`{c}` IS NOT NULL" for c in ("gt", *models)))


def listings(pages: DataFrame, models: list[str]) -> DataFrame:
    """(name, text): the listing of each page of two models, as files are named."""
    whole = both(pages, models)
    found = forensics.process_pages(whole, "page", "gt", dict(zip(("baseline", "replay"), models)))
    texts = forensics.hotspot_texts(forensics.hotspots(found, ["page", "level"], begins=F.col("begins") & (F.col("level") == "chord")))
    return texts.select(F.concat("page", F.lit("_diff.txt")).alias("name"), "text")


def report(spark: SparkSession, folder: str, models: list[str], out: str) -> str:
    """Writes ``report.md`` and, for two models, listings of all pages to ``out``, from files <page>__<gt or model>.kern; returns the report."""
    files.register(spark)
    pages = scans.predictions(spark, folder, models).cache()
    try:
        text = "\n".join(sinks.markdown(table, f"## {title}") for title, table in sections(pages, models))
        spark.createDataFrame([("report.md", text)], "name string, text string").write.format("neumes_texts").mode("append").save(out)
        if len(models) == 2:
            listings(pages, models).write.format("neumes_texts").mode("append").save(out)
    finally:
        pages.unpersist()
    return text
