"""Scans and sinks on files that a query writes and reads back, with their SQL."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import assemble, metrics, vocabulary
from ..sources import files, scans, sinks
from ..sources.tables import scratch
from ..streaming import stages
from .oracles import _EVENTS, ORACLES
from .pages import _NOTES, _RECORDS, both, both_texts
from .pages import note_rows as notes
from .queries import SCORES, long, r6, score_rows, t, user_sequences

_SPLITS = ("train", "val", "test")
_SPLIT_ROWS = f"""
s AS (
  SELECT o_orderkey, {list(_SPLITS)}[1 + o_custkey % 3] AS split, (o_orderkey % 2)::BIGINT AS fold, o_orderkey % 7 = 0 AS short,
         CASE WHEN o_orderkey % 5 = 0 THEN 'syn/' ELSE 'jpg/' END || o_orderkey || '.jpg' AS img, 'gt/' || o_orderkey || '.txt' AS gt, (o_orderkey % 9)::BIGINT AS n
  FROM orders)"""


def split_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a split file for each split and fold; some lines are too short."""
    key = F.col("o_orderkey")
    img = F.concat(F.when(key % 5 == 0, "syn/").otherwise("jpg/"), key.cast("string"), F.lit(".jpg"))
    line = F.when(key % 7 == 0, img).otherwise(F.concat_ws("  ", img, F.concat(F.lit("gt/"), key.cast("string"), F.lit(".txt")), (key % 9).cast("string")))
    rows = t(spark, sf_dir, "orders").select(F.get(F.array(*map(F.lit, _SPLITS)), (F.col("o_custkey") % 3).cast("int")).alias("split"), (key % 2).alias("fold"), line.alias("value"))
    root = scratch(spark, "splits")
    for split in _SPLITS:
        for fold in (0, 1):
            sinks.write_lines(rows.where((F.col("split") == split) & (F.col("fold") == fold)).select("value"), f"{root}/{split}_{fold}.txt")
    return root


@both("split_source", f"WITH {_SPLIT_ROWS} SELECT img, gt, n, split, fold, starts_with(img, 'syn') AS is_synthetic FROM s WHERE NOT short AND split = 'train' AND fold = 1")
def split_source(spark, sf_dir):
    """One split and fold of a folder of split files: the other files stay unread."""
    files.register(spark)
    rows = spark.read.format("neumes_splits").load(split_folder(spark, sf_dir)).where("split = 'train' AND fold = 1")
    return rows.select("img", "gt", long("n").alias("n"), "split", long("fold").alias("fold"), "is_synthetic")


@both("manifest_files", f"WITH {_SPLIT_ROWS} SELECT img, gt, n, starts_with(img, 'syn') AS is_synthetic FROM s WHERE NOT short AND split = 'val' AND fold = 0")
def manifest_files(spark, sf_dir):
    """A split file by Spark's own reader."""
    rows = scans.manifest(spark, f"{split_folder(spark, sf_dir)}/val_0.txt")
    return rows.select("img", "gt", long("n").alias("n"), "is_synthetic")


@both("positional_manifest", "SELECT 'img ' || s_suppkey AS x, 'img' AS img, s_suppkey::VARCHAR AS gt FROM supplier")
def positional_manifest(spark, sf_dir):
    """The first two fields between single blanks."""
    path = scratch(spark, "positional")
    rows = t(spark, sf_dir, "supplier").select(F.concat(F.lit("img "), F.col("s_suppkey").cast("string")).alias("value"))
    sinks.write_lines(rows, path)
    out = scans.positional_manifest(spark, path)
    return out.select(F.concat_ws(" ", "img", "gt").alias("x"), "img", "gt")


def text_folder(spark, sf_dir) -> str:
    """Texts of benchmark items as files, with a second role for those of even ids."""
    files.register(spark)
    path = scratch(spark, "texts")
    text = F.coalesce("text", F.lit(""))
    role = lambda name, text: F.struct(F.concat(F.lit("item"), F.col("item_id").cast("string"), F.lit(f"__{name}.kern")).alias("name"), text.alias("text"))
    roles = F.when(F.col("item_id") % 2 == 0, F.array(role("gt", text), role("base", F.replace(text, F.lit("e"), F.lit("E"))))).otherwise(F.array(role("gt", text)))
    t(spark, sf_dir, "benchmark").select(F.inline(roles)).write.format("neumes_texts").mode("overwrite").save(path)
    return path


@both("notation_files", "SELECT 'item' || item_id || '__' || unnest(CASE WHEN item_id % 2 = 0 THEN ['gt', 'base'] ELSE ['gt'] END) AS page_id, md5(unnest(CASE WHEN item_id % 2 = 0 THEN [coalesce(text, ''), replace(coalesce(text, ''), 'e', 'E')] ELSE [coalesce(text, '')] END)) AS text_md5 FROM benchmark")
def notation_files(spark, sf_dir):
    """Files of whole texts, written by name and read by Spark's reader."""
    rows = scans.notation(spark, text_folder(spark, sf_dir), "*.kern")
    return rows.select("page_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@both("text_source", "SELECT 'item' || item_id AS name, md5(coalesce(text, '')) AS text_md5 FROM benchmark")
def text_source(spark, sf_dir):
    """The texts of one role; files of the other are not read."""
    rows = spark.read.format("neumes_texts").option("pattern", r"([^/]+)__gt\.kern$").load(text_folder(spark, sf_dir))
    return rows.select("name", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@both("prediction_files", "SELECT 'item' || item_id AS page, md5(coalesce(text, '')) AS gt_md5, CASE WHEN item_id % 2 = 0 THEN md5(replace(coalesce(text, ''), 'e', 'E')) END AS base_md5 FROM benchmark")
def prediction_files(spark, sf_dir):
    """Texts of a page by role, from the names of files; a role without a file is null."""
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(f"{c}_md5")
    return scans.predictions(spark, text_folder(spark, sf_dir), ["base"]).select("page", md5("gt"), md5("base"))


@both("file_listing", "SELECT 'item' || item_id || '__gt' AS stem, octet_length(encode(coalesce(text, '')))::BIGINT AS length, item_id % 2 = 1 AS alone FROM benchmark")
def file_listing(spark, sf_dir):
    """Names and sizes of files, and which have no partner; contents are not read."""
    found = scans.listing(spark, text_folder(spark, sf_dir), "*.kern").where("length IS NOT NULL")
    gt, base = (found.where(F.col("stem").endswith(f"__{role}")).withColumn("page", F.substring_index("stem", "__", 1)) for role in ("gt", "base"))
    lonely = scans.missing_pairs(gt.drop("stem").withColumnRenamed("page", "stem"), base.drop("stem").withColumnRenamed("page", "stem")).select(F.col("stem").alias("page"), F.lit(True).alias("alone"))
    return gt.join(lonely, "page", "left").select("stem", "length", F.coalesce("alone", F.lit(False)).alias("alone"))


@both("dataset_splits", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'train' WHEN s_suppkey % 3 = 1 THEN 'validation' ELSE 'test' END AS split, s_suppkey, s_name FROM supplier")
def dataset_splits(spark, sf_dir):
    """Folders of a dataset as one table; validation stands in a folder named val."""
    root, rows = scratch(spark, "dataset"), t(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    for rest, folder in enumerate(("train", "val", "test")):
        rows.where(F.col("s_suppkey") % 3 == rest).write.parquet(f"{root}/{folder}")
    return scans.dataset(spark, root, ["train", "validation", "test"]).select("split", "s_suppkey", "s_name")


@both("annotation_decode", f"""
WITH {_NOTES}, y AS (SELECT page, sys, string_agg(kern || chr(9) || chord, chr(10) ORDER BY k) || ' it''s "' || sys || '" \\' AS kern FROM nt GROUP BY page, sys)
SELECT page AS page_id, (sys - 1)::BIGINT AS idx, CASE WHEN sys % 2 = 1 THEN (page % 50)::BIGINT END AS from_x, (sys * 100 + 60)::BIGINT AS to_y, md5(kern) AS kern_md5 FROM y""")
def annotation_decode(spark, sf_dir):
    """Annotations as Python writes them, in a table of files, read as systems with boxes; a missing number is None."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("kern", F.lit("\t"), "chord").alias("x")))), lambda x: x["x"])
    systems = notes(spark, sf_dir).groupBy("page", "sys").agg(F.concat(F.array_join(lines, "\n"), F.lit(" it's \""), F.col("sys").cast("string"), F.lit('" \\')).alias("text"))
    quoted = F.col("text")
    for sign, escape in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(sign), F.lit(escape))
    one = F.format_string("{'bounding_box': {'fromX': %s, 'toX': 500, 'fromY': %d, 'toY': %d, }, '**kern': '%s'}", F.when(F.col("sys") % 2 == 1, (F.col("page") % 50).cast("string")).otherwise("None"), F.col("sys") * 100, F.col("sys") * 100 + 60, quoted)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sys", one.alias("x")))), lambda x: x["x"]), ", ")
    path = scratch(spark, "annotations")
    systems.groupBy(F.col("page").alias("page_id")).agg(F.concat(F.lit("{'systems': ["), parts, F.lit("], 'seen': True}")).alias("annotation")).write.parquet(path)
    # an inner one would read each annotation again to filter pages without systems before
    rows = scans.annotations(spark, path).select("page_id", F.inline_outer("systems")).where("idx IS NOT NULL")
    return rows.select("page_id", long("idx").alias("idx"), long("bounding_box.fromX").alias("from_x"), long("bounding_box.toY").alias("to_y"), F.md5(F.col("kern").cast("binary")).alias("kern_md5"))


def _drawn(salt: str) -> str:
    return f"list_sum(list_transform(range(1, 9), lambda d: (strpos('0123456789abcdef', md5(concat_ws(':', user_id, i - 1, 42, '{salt}'))[d]) - 1) * (16 ** (8 - d))::BIGINT))::BIGINT"


@both("noisy_ids", f"""
WITH {_EVENTS}, e AS (SELECT user_id, list_transform(types, lambda x: strpos('cepsv', x[1]) - 1) AS ids FROM s)
SELECT user_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i > 1 AND x <> 0 AND {_drawn('u')} % 1000000 < 200000 THEN {_drawn('v')} % 5 ELSE x END), ' ') AS ids FROM e""")
def noisy_ids(spark, sf_dir):
    """Sequences with a fifth of their ids replaced, the first and padding left alone."""
    number = F.transform("types", lambda x: F.instr(F.lit("cepsv"), F.substring(x, 1, 1)).cast("long") - 1)
    rows = user_sequences(spark, sf_dir).select("user_id", number.alias("ids"))
    noisy = vocabulary.with_noise(F.col("ids"), F.col("user_id"), 5)
    return rows.select("user_id", F.array_join(F.transform(noisy, lambda x: x.cast("string")), " ").alias("ids"))


_ENTRY = "CASE WHEN o_orderkey % 13 = 0 THEN 'jpg/page_' || o_orderkey || '.jpg' ELSE 'jpg/img_' || o_custkey || '.jpg' END"


@both("prefix_skips", f"""
WITH e AS (SELECT {_ENTRY} AS img, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS page_no FROM orders),
f AS (SELECT DISTINCT {_ENTRY} AS img, o_custkey % 19 <> 0 AS readable FROM orders WHERE o_custkey % 17 <> 0),
p AS (SELECT c_custkey AS page_no, c_nationkey % 6 AS systems FROM customer WHERE c_custkey % 23 <> 0),
x AS (
  SELECT coalesce(systems, 0) AS systems, CASE WHEN f.img IS NULL THEN 'image not found' WHEN e.page_no IS NULL THEN 'no page number' WHEN p.page_no IS NULL THEN 'page not annotated' WHEN systems = 0 THEN 'no systems' WHEN NOT readable THEN 'image unreadable' END AS skipped
  FROM e LEFT JOIN f USING (img) LEFT JOIN p ON p.page_no = e.page_no)
SELECT skipped, count(*) AS entries, sum(CASE WHEN skipped IS NULL THEN least(systems, 4) ELSE 0 END)::BIGINT AS prefixes FROM x GROUP BY skipped""")
def prefix_skips(spark, sf_dir):
    """Entries of a split that give no prefixes, by the reason, and how many prefixes the others give."""
    key = F.col("o_orderkey")
    img = F.concat(F.when(key % 13 == 0, F.concat(F.lit("jpg/page_"), key.cast("string"))).otherwise(F.concat(F.lit("jpg/img_"), F.col("o_custkey").cast("string"))), F.lit(".jpg"))
    orders = t(spark, sf_dir, "orders").select(img.alias("img"), "o_custkey")
    images = orders.where("o_custkey % 17 <> 0").select(F.col("img").alias("path"), (F.col("o_custkey") % 19 != 0).alias("readable")).distinct()
    annotated = t(spark, sf_dir, "customer").where("c_custkey % 23 <> 0").select(F.col("c_custkey").alias("page_no"), (F.col("c_nationkey") % 6).alias("systems"))
    out = assemble.skip_counts(assemble.with_skip_reason(orders.select("img"), images, annotated), 4)
    return out.select("skipped", "entries", long("prefixes").alias("prefixes"))


@both("logged_metrics", f"WITH {_RECORDS} SELECT metric, count(*) AS records, (count(*) - count(value))::BIGINT AS missing, round(avg(least(value, 100)), 6)::DOUBLE AS mean FROM rc GROUP BY metric")
def logged_metrics(spark, sf_dir):
    """Records of pages written, with the means of each metric from the same pass."""
    rows = metrics.page_records(both_texts(spark, sf_dir), ["page"], "baseline_text", "gt_text")
    names = [*metrics.KINDS, *(f"kern_{k}" for k in metrics.KINDS), "chord_ser", "root_ser"]
    return sinks.write_logged(rows, scratch(spark, "records"), names).withColumn("mean", r6(F.col("mean")))


@both("stage_stream", ORACLES["stage_machine"])
def stage_stream(spark, sf_dir):
    """The stage machine over a stream of files in which scores come in no order: as over the whole table."""
    root = scratch(spark, "scores")
    scores = score_rows(spark, sf_dir)
    for part in range(3):  # files of one micro-batch each
        scores.where(F.pmod(F.xxhash64("run_id", "epoch"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    out = stages.stage_stream(stream, SCORES).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True)
    out.start().awaitTermination()
    best = F.when(F.col("best") < 1e300, F.col("best"))
    rows = spark.read.parquet(f"{root}/out")
    return rows.select("run_id", long("epoch").alias("epoch"), *(long(c).alias(c) for c in ("stage", "below", "no_improve")), r6(best).alias("best"), "at_final", "stop")
