"""Scans with fixed schemas. All go through Spark's readers, so any file system will do."""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.literals import literal
from ..functions.text import page_number

SYSTEMS = "array<struct<idx:int,bounding_box:struct<fromX:int,toX:int,fromY:int,toY:int>,kern:string>>"
ANNOTATION = "struct<systems:array<struct<bounding_box:struct<fromX:int,toX:int,fromY:int,toY:int>,`**kern`:string>>>"
VALUES = "page string, model string, metric string, value double"


def annotations(spark: SparkSession, path: str, page_col: str = "page_id", column: str = "annotation") -> DataFrame:
    """(page_id, systems) of a Parquet table whose annotation is a JSON or Python literal; null where it is neither. Images are not read."""
    rows = spark.read.parquet(path).select(F.col(page_col).alias("page_id"), F.col(column).alias("_a"))
    parsed = rows.withColumn("_s", F.try_variant_get(literal(F.col("_a")), "$", ANNOTATION)["systems"])
    systems = F.transform("_s", lambda s, i: F.struct(i.alias("idx"), s["bounding_box"].alias("bounding_box"), s["**kern"].alias("kern")))
    return parsed.select("page_id", systems.cast(SYSTEMS).alias("systems"))


def dataset(spark: SparkSession, root: str, splits: list[str], schema: str | None = None) -> DataFrame:
    """The split folders of a dataset in one table with a split column; ``validation`` is also looked for as ``val``."""
    out = None
    for split in splits:
        reader = spark.read if schema is None else spark.read.schema(schema)
        try:
            part = reader.parquet(f"{root}/{split}")
        except Exception:
            if split != "validation":
                raise
            part = reader.parquet(f"{root}/val")
        part = part.withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def manifest(spark: SparkSession, path: str, with_n: bool = True) -> DataFrame:
    """(img, gt, n, split, fold, is_synthetic) of split files; lines with too few fields are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return manifest_rows(lines, with_n)


def manifest_rows(lines: DataFrame, with_n: bool = True) -> DataFrame:
    """As ``manifest``, of (value, file)."""
    fields = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ", -1)
    rows = lines.withColumn("_f", fields).where(F.size("_f") >= (3 if with_n else 2))
    n = F.get("_f", F.lit(2)) if with_n else F.lit(None)
    return rows.select(
        F.get("_f", F.lit(0)).alias("img"), F.get("_f", F.lit(1)).alias("gt"), n.cast("int").alias("n"), F.regexp_extract("file", r"([a-z]+)_\d+\.txt$", 1).alias("split"),
        F.nullif(F.regexp_extract("file", r"_(\d+)\.txt$", 1), F.lit("")).cast("int").alias("fold"), F.lower(F.get("_f", F.lit(0))).rlike("syn").alias("is_synthetic"),
    )


def distinct_texts(rows: DataFrame, column: str = "gt") -> DataFrame:
    """(path) of each text once, however many rows name it."""
    return rows.select(F.col(column).alias("path")).where("path IS NOT NULL").distinct()


def positional_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(img, gt): the first two fields between single blanks."""
    parts = F.split("value", " ", -1)
    return spark.read.text(path).select(F.get(parts, F.lit(0)).alias("img"), F.trim(F.get(parts, F.lit(1))).alias("gt"))


def with_systems_count(rows: DataFrame, text_col: str, marker: str = "!!linebreak:original") -> DataFrame:
    """Adds n: markers in the text, and one."""
    return rows.withColumn("n", F.size(F.split(text_col, rf"\Q{marker}\E", -1)))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, stem, length) of files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("stem"), "length")


def resolved(rows: DataFrame, files: DataFrame, column: str, bases: list[str]) -> DataFrame:
    """Adds <column>_path: the first that exists of the raw path, base/raw, and base/raw without its first folder; else base/raw."""
    raw = F.col(column)
    short = F.regexp_replace(raw, "^[^/]+/", "")
    tries = [raw] + [F.concat_ws("/", F.lit(b), r) for b in bases for r in (raw, short)]
    known = files.select(F.regexp_replace("path", "^file:", "").alias("_path"))
    out = rows
    for i, t in enumerate(tries):
        out = out.withColumn(f"_t{i}", t).join(known.withColumn(f"_ok{i}", F.lit(True)).withColumnRenamed("_path", f"_t{i}"), f"_t{i}", "left")
    found = F.coalesce(*(F.when(F.col(f"_ok{i}"), F.col(f"_t{i}")) for i in range(len(tries))), F.col("_t1" if bases else "_t0"))
    return out.withColumn(f"{column}_path", found).drop(*(f"_{p}{i}" for p in ("t", "ok") for i in range(len(tries))))


def existing(rows: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose paths in all columns exist."""
    for c in columns:
        rows = rows.join(files.select(F.regexp_replace("path", "^file:", "").alias(c)), c, "left_semi")
    return rows


def missing_pairs(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Images without a text of the same stem; a listing is sound if there are none."""
    return files.join(texts.select("stem"), "stem", "left_anti")


def notation(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(page_id, text, path) of notation files, one row per file."""
    texts = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return texts.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.[^./]*$", 1).alias("page_id"), F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))


def predictions(spark: SparkSession, path: str, models: list[str]) -> DataFrame:
    """(page, gt, <model>...) of files named <page>__<gt or model>.kern."""
    texts = spark.read.option("pathGlobFilter", "*__*.kern").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    rows = texts.select(F.regexp_extract(name, r"([^/]+)__[A-Za-z0-9]+\.kern$", 1).alias("page"), F.regexp_extract(name, r"__([A-Za-z0-9]+)\.kern$", 1).alias("role"), "value")
    return rows.groupBy("page").pivot("role", ["gt", *models]).agg(F.first("value"))


def metric_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header; NaN and empty fields are null."""
    rows = spark.read.option("header", True).schema(schema).csv(path)
    return rows.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes))


def csv_models(columns: list[str]) -> list[str]:
    """Models named by the suffixes of a wide table's columns."""
    return sorted({c.rsplit("_", 1)[1] for c in columns if "_" in c})


def images(spark: SparkSession, path: str, white: int = 128) -> DataFrame:
    """(path, width, height, valid); an unreadable image counts as a white square."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path)
    ok = F.col("image.width") > 0
    return rows.select(F.col("image.origin").alias("path"), F.when(ok, F.col("image.width")).otherwise(white).alias("width"), F.when(ok, F.col("image.height")).otherwise(white).alias("height"), ok.alias("valid"))


def png_size(content: Column) -> Column:
    """STRUCT<width, height> from the header of PNG bytes; null for other bytes."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def jpeg_frame(content: bytes) -> tuple[int, int] | None:
    """Width and height in the first frame header of JPEG bytes. Segments before it are skipped by their lengths."""
    at = 2 if content[:2] == b"\xff\xd8" else len(content)
    while at + 9 <= len(content) and content[at] == 0xFF:
        mark = content[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        at += 1 if mark == 0xFF else 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def image_size(content: Column) -> Column:
    """STRUCT<width, height> from the header of PNG or JPEG bytes; null for other bytes. Nothing is decoded."""

    @F.arrow_udf("struct<width:int,height:int>")
    def run(files: pa.Array) -> pa.Array:
        sizes = [None if f is None else jpeg_frame(f) for f in files.to_pylist()]
        return pa.array([None if s is None else {"width": s[0], "height": s[1]} for s in sizes], pa.struct([("width", pa.int32()), ("height", pa.int32())]))

    return F.coalesce(png_size(content), run(content))


def checkpoints(files: DataFrame) -> DataFrame:
    """Sorted checkpoint paths of a listing."""
    return files.where(F.col("path").endswith(".ckpt")).select("path").orderBy("path")


def with_page_number(rows: DataFrame, page: str = "page") -> DataFrame:
    return rows.withColumn("n", page_number(F.col(page)))
