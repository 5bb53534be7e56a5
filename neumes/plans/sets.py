"""Operators on sets of samples, boxes, paths and files, bound to tables, with their SQL."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assemble, boxes, compare, curriculum, forensics, metrics, vocabulary
from ..sources import scans, sinks
from .files import scratch
from .oracles import _EVENTS, _PAGES, ORACLES
from .pages import _END, _HEAD, _NOTES, _measured, _texts, both, both_texts, page_texts, predicted_rows
from .pages import note_rows as notes
from .queries import long, order_pages, r6, t, user_sequences

# --- geometry and numbers


@both("page_geometry", """
SELECT p_partkey, least(p_size * 10 + 20, p_partkey % 500 + 100)::BIGINT AS crop, greatest(p_size, p_partkey % 97)::BIGINT AS stack_width, (3 * 128)::BIGINT AS stack_height,
       CASE WHEN p_size + 100 <> 128 THEN greatest(1, round_even((p_partkey % 1000 + 50) * 128 / (p_size + 100)::DOUBLE, 0)) ELSE p_partkey % 1000 + 50 END::BIGINT AS width, 128::BIGINT AS height,
       least(ceil((p_partkey % 1000 + 50) * 128 / (p_size + 100)::DOUBLE), 1000)::BIGINT AS capped FROM part""")  # fmt: skip
def page_geometry(spark, sf_dir):
    """Heights of crops, sizes of stacks, and sizes scaled to a height."""
    w, h = F.col("p_partkey") % 1000 + 50, F.col("p_size") + 100
    stack, scaled = assemble.stack_size(F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 97), F.lit(3), 128), assemble.scaled_size(w, h, F.lit(128))
    return t(spark, sf_dir, "part").select(
        "p_partkey", long(assemble.crop_height(F.col("p_size") * 10, 20, F.col("p_partkey") % 500 + 100)).alias("crop"), long(stack["width"]).alias("stack_width"), long(stack["height"]).alias("stack_height"),
        long(scaled["width"]).alias("width"), long(scaled["height"]).alias("height"), long(assemble.capped_width(w, h, 128)).alias("capped"),
    )


@both("stage_numbers", """
WITH s AS (SELECT p_partkey, least(p_partkey % 60 // 5 + 1, 9) AS stage FROM part)
SELECT p_partkey, stage::BIGINT AS stage, least(4000, greatest(512, 550 * stage))::BIGINT AS decode_length, CASE WHEN stage <= 2 THEN 4 ELSE 1 END::BIGINT AS accumulate, CASE WHEN stage <= 2 THEN 0.0004 ELSE 0.0001 END::DOUBLE AS learning_rate FROM s""")  # fmt: skip
def stage_numbers(spark, sf_dir):
    """The stage of an epoch, how long texts may be at it, and its accumulation."""
    rows = t(spark, sf_dir, "part").select("p_partkey", curriculum.stage_of_epoch(F.col("p_partkey") % 60, 5, 1, 9).alias("stage"))
    a = curriculum.accumulation(F.col("stage"), 2, 4, 0.0001)
    return rows.select("p_partkey", long("stage").alias("stage"), long(curriculum.decode_length(F.col("stage"), 4000)).alias("decode_length"), long(a["accumulate"]).alias("accumulate"), a["learning_rate"].cast("double").alias("learning_rate"))


@both("image_stats", """
SELECT round(avg(p_size), 6)::DOUBLE AS mean_width, max(p_size)::BIGINT AS max_width, min(p_size)::BIGINT AS min_width, max(p_partkey)::BIGINT AS max_height, trunc(max(p_size) * 1.1::DOUBLE)::BIGINT AS width_limit, trunc(max(p_partkey) * 1.1::DOUBLE)::BIGINT AS height_limit FROM part""")
def image_stats(spark, sf_dir):
    out = assemble.size_stats(t(spark, sf_dir, "part"), "p_size", "p_partkey")
    return out.select(r6(F.col("mean_width")).alias("mean_width"), *(long(c).alias(c) for c in ("max_width", "min_width", "max_height", "width_limit", "height_limit")))


@both("image_sizes", "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size END::BIGINT AS width, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 5000 + 1 END::BIGINT AS height FROM part")
def image_sizes(spark, sf_dir):
    """Sizes in the headers of PNG and JPEG bytes; other bytes have none."""
    number = lambda c, n: F.lpad(F.hex(c.cast("long")), n, "0")
    w, h = F.col("p_size"), F.col("p_partkey") % 5000 + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w, 8), number(h, 8), F.lit("0800000000"))
    jpeg = F.concat(F.lit("FFD8FFE000040000FFC0001108"), number(h, 4), number(w, 4), F.lit("0301220002110103110100"))
    content = F.unhex(F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, jpeg).otherwise("474946383961"))
    rows = t(spark, sf_dir, "part").select("p_partkey", scans.image_size(content).alias("s"))
    return rows.select("p_partkey", long("s.width").alias("width"), long("s.height").alias("height"))


# --- boxes

_BOXES = f"""
{_NOTES},
bx AS (SELECT page, k AS id, CASE WHEN s % 6 = 0 THEN 'clef' ELSE 'staff' END AS class, p % 50 AS x1, p % 50 + 500 + q AS x2, (CASE WHEN p % 4 = 0 AND k > 1 THEN k - 1 ELSE k END) * 100 + s % 12 AS y1, (CASE WHEN p % 4 = 0 AND k > 1 THEN k - 1 ELSE k END) * 100 + s % 12 + 60 + q % 8 AS y2 FROM nt),
bs AS (SELECT page, list({{'id': id, 'y1': y1, 'y2': y2, 'w': x2 - x1}} ORDER BY (y1 + y2) / 2.0, id) AS b FROM bx WHERE class = 'staff' GROUP BY page),
bg AS (
  SELECT page, list_reduce(b, lambda acc, x: CASE WHEN len(list_filter(acc, lambda h: least(h.y2, x.y2) - greatest(h.y1, x.y1) >= 0.6 * (greatest(h.y2, x.y2) - least(h.y1, x.y1)))) > 0
      THEN list_transform(acc, lambda h: CASE WHEN x.w < h.w AND h.id0 = list_filter(acc, lambda g: least(g.y2, x.y2) - greatest(g.y1, x.y1) >= 0.6 * (greatest(g.y2, x.y2) - least(g.y1, x.y1)))[1].id0 THEN {{'id0': h.id0, 'id': x.id, 'y1': h.y1, 'y2': h.y2, 'w': x.w}} ELSE h END)
      ELSE list_append(acc, {{'id0': x.id, 'id': x.id, 'y1': x.y1, 'y2': x.y2, 'w': x.w}}) END, []::STRUCT(id0 BIGINT, id BIGINT, y1 BIGINT, y2 BIGINT, w BIGINT)[]) AS kept FROM bs),
kb AS (SELECT bx.* FROM (SELECT page, unnest(kept).id AS id FROM bg) JOIN bx USING (page, id))"""


def detections(spark, sf_dir) -> DataFrame:
    """(page_id, box_id, class, x1, y1, x2, y2, image_height): a box for each note, some on top of the one before."""
    k, p, s, q = (F.col(c) for c in "kpsq")
    row = F.when((p % 4 == 0) & (k > 1), k - 1).otherwise(k)
    rows = notes(spark, sf_dir).select(F.col("page").alias("page_id"), long(k).alias("box_id"), F.when(s % 6 == 0, "clef").otherwise("staff").alias("class"), (p % 50).cast("int").alias("x1"), (row * 100 + s % 12).cast("int").alias("y1"), (p % 50 + 500 + q).cast("int").alias("x2"), (row * 100 + s % 12 + 60 + q % 8).cast("int").alias("y2"))
    return rows.withColumn("image_height", F.lit(1000))


@both("box_classes", f"WITH {_BOXES} SELECT class, count(*) AS boxes FROM bx GROUP BY class")
def box_classes(spark, sf_dir):
    return boxes.class_counts(detections(spark, sf_dir))


@both("merged_boxes", f"WITH {_BOXES} SELECT page AS page_id, id AS box_id, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2 FROM kb")
def merged_boxes(spark, sf_dir):
    """Of boxes on top of each other the narrowest."""
    out = boxes.merge_duplicates(boxes.staves(detections(spark, sf_dir)))
    return out.select("page_id", "box_id", *(long(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


def _filled(boxes: str) -> str:
    """``boxes`` with their order i, and those put in between corners that are far apart."""
    return f"""
{_BOXES},
kp AS (SELECT bx.*, pos FROM (SELECT page, unnest(kept).id AS id, generate_subscripts(kept, 1) AS pos FROM bg) JOIN bx USING (page, id)),
co AS ({boxes}),
cd AS (SELECT *, lead(x1) OVER w AS nx, lead(y1) OVER w AS ny, count(*) OVER (PARTITION BY page) AS n FROM co WINDOW w AS (PARTITION BY page ORDER BY i)),
ce AS (SELECT *, sqrt(((nx - x1) * (nx - x1) + (ny - y1) * (ny - y1))::DOUBLE) AS apart FROM cd),
cm AS (SELECT page, median(apart) AS m, trunc(median(x2 - x1))::BIGINT AS mw, trunc(median(y2 - y1))::BIGINT AS mh FROM ce GROUP BY page),
cv AS (SELECT ce.*, mw, mh, greatest(1, round_even(apart / m, 0) - 1)::INTEGER AS missing FROM ce JOIN cm USING (page) WHERE n >= 3 AND m > 0 AND apart > 1.8::DOUBLE * m),
cw AS (SELECT page, i, k, trunc(x1 + k::DOUBLE / (missing + 1) * (nx - x1))::BIGINT AS x1, trunc(y1 + k::DOUBLE / (missing + 1) * (ny - y1))::BIGINT AS y1, mw, mh FROM (SELECT *, unnest(range(1, missing + 1)) AS k FROM cv)),
cf AS (
  SELECT page, id, i, 0 AS k, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2, false AS inserted FROM co
  UNION ALL SELECT page, NULL, i, k, x1, y1, x1 + mw, y1 + mh, true FROM cw),
cs AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) / 2.0, i, k) AS system_no FROM cf)"""


@both("gap_interpolate", f"""
WITH {_filled("SELECT *, row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) / 2.0, id) AS i FROM bx WHERE class = 'staff'")}
SELECT page AS page_id, system_no, id AS box_id, x1, y1, x2, y2, inserted FROM cs""")
def gap_interpolate(spark, sf_dir):
    """Boxes of a page, duplicates and all, with boxes put in where corners are far apart."""
    out = boxes.interpolate_boxes(boxes.staves(detections(spark, sf_dir)))
    return out.select("page_id", long("system_no").alias("system_no"), "box_id", *(long(c).alias(c) for c in ("x1", "y1", "x2", "y2")), "inserted")


@both("segmented_staves", f"""
WITH {_filled("SELECT *, row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) / 2.0, pos) AS i FROM kp")},
o AS (SELECT *, lag(y2) OVER w AS b, y1 - lag(y2) OVER w AS up, lead(y1) OVER w - y2 AS down FROM cs WINDOW w AS (PARTITION BY page ORDER BY system_no)),
a AS (SELECT *, coalesce(avg(up) OVER (PARTITION BY page), 0.4 * (y2 - y1)) AS mean FROM o)
SELECT page AS page_id, id AS box_id, system_no, ((y1 + y2) / 2.0)::DOUBLE AS y_center, inserted,
       CASE WHEN b IS NULL THEN greatest(0, y1 - trunc(0.75 * mean)) ELSE b + trunc(0.25 * up) END::BIGINT AS crop_top,
       CASE WHEN down IS NULL THEN least(1000, y2 + trunc(0.25 * mean)) ELSE y2 + trunc(0.25 * down) END::BIGINT AS crop_bottom FROM a""")  # fmt: skip
def segmented_staves(spark, sf_dir):
    """From detections to the rows to crop: class, duplicates, order, missed systems, boundaries."""
    out = boxes.segment_staves(detections(spark, sf_dir))
    return out.select("page_id", "box_id", long("system_no").alias("system_no"), "y_center", "inserted", long("crop_top").alias("crop_top"), long("crop_bottom").alias("crop_bottom"))


@both("page_skews", "WITH m AS (SELECT user_id, median(value - 12) FILTER (abs(value - 12) <= 15) AS m FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN abs(m) < 0.5 THEN 0 ELSE coalesce(m, 0) END, 6)::DOUBLE AS skew FROM m")
def page_skews(spark, sf_dir):
    """The median of plausible angles of a page."""
    rows = t(spark, sf_dir, "events").select("user_id", (F.col("value") - 12).alias("angle"))
    return boxes.page_skew(rows, "user_id", "angle", 15.0, 0.5).select("user_id", r6(F.col("skew")).alias("skew"))


# --- split files and plans


@both("manifest_lines", "SELECT concat_ws(' ', 'jpg/img_' || o_custkey || '.jpg', 'gt/img_' || o_custkey || '.txt', o_orderkey % 9) AS value FROM orders")
def manifest_lines(spark, sf_dir):
    name = lambda folder, end: F.concat(F.lit(f"{folder}/img_"), "o_custkey", F.lit(end))
    rows = t(spark, sf_dir, "orders").select(name("jpg", ".jpg").alias("img"), name("gt", ".txt").alias("gt"), (F.col("o_orderkey") % 9).alias("n"))
    return assemble.manifest(rows, ["img", "gt", "n"])


_LINES = "l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'short' || o_orderkey ELSE 'data/img_' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '_syn' ELSE '' END || '.jpg' || CASE WHEN o_orderkey % 3 = 0 THEN '   ' ELSE ' ' END || 'gt/' || o_orderkey || '.txt ' || o_orderkey % 9 END AS value FROM orders)"


def manifest_text(spark, sf_dir) -> DataFrame:
    """(value, file): lines of split files, some short, some with several blanks."""
    k = F.col("o_orderkey")
    value = F.concat(F.lit("data/img_"), "o_custkey", F.when(k % 2 == 0, "_syn").otherwise(""), F.lit(".jpg"), F.when(k % 3 == 0, "   ").otherwise(" "), F.lit("gt/"), k, F.lit(".txt "), k % 9)
    return t(spark, sf_dir, "orders").select(F.when(k % 7 == 0, F.concat(F.lit("short"), k)).otherwise(value).alias("value"), F.concat(F.lit("/splits/"), F.when(k % 5 == 0, "val").otherwise("train"), F.lit("_"), k % 3, F.lit(".txt")).alias("file"))


@both("manifest_rows", f"""
WITH {_LINES} SELECT 'data/img_' || o_custkey || CASE WHEN o_orderkey % 2 = 0 THEN '_syn' ELSE '' END || '.jpg' AS img, 'gt/' || o_orderkey || '.txt' AS gt, (o_orderkey % 9)::BIGINT AS n,
       CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, (o_orderkey % 3)::BIGINT AS fold, o_orderkey % 2 = 0 AS is_synthetic FROM orders WHERE o_orderkey % 7 <> 0""")  # fmt: skip
def manifest_rows(spark, sf_dir):
    """Lines of split files with three fields or more."""
    out = scans.manifest_rows(manifest_text(spark, sf_dir))
    return out.select("img", "gt", long("n").alias("n"), "split", long("fold").alias("fold"), "is_synthetic")


@both("manifest_pairs", "SELECT count(*) AS lines, count(DISTINCT 'gt/' || o_orderkey || '.txt') AS texts FROM orders WHERE o_orderkey % 7 <> 0")
def manifest_pairs(spark, sf_dir):
    """Lines of two fields, and the texts that they name, each once."""
    rows = scans.manifest_rows(manifest_text(spark, sf_dir), with_n=False)
    return rows.agg(F.count("*").alias("lines")).crossJoin(scans.distinct_texts(rows).agg(F.count("*").alias("texts")))


@both("systems_count", f"WITH {_NOTES} SELECT page, max(sys) AS n FROM nt GROUP BY page")
def systems_count(spark, sf_dir):
    """The number of systems of a text, by its markers."""
    return scans.with_systems_count(page_texts(notes(spark, sf_dir)), "text").select("page", long("n").alias("n"))


@both("split_rewrite", """
WITH c AS (SELECT o_orderkey % 9 AS n, o_orderkey FROM orders), r AS (SELECT * FROM c WHERE n <> 4 UNION ALL SELECT 4, c_custkey FROM customer)
SELECT n::BIGINT AS n, count(*) AS samples FROM r GROUP BY n""")  # fmt: skip
def split_rewrite(spark, sf_dir):
    """A split with all rows of one N replaced, and how many samples each N has."""
    current = t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9).alias("n"), F.col("o_orderkey").alias("id"))
    new = t(spark, sf_dir, "customer").select(F.lit(4).cast("long").alias("n"), F.col("c_custkey").alias("id"))
    return assemble.distribution(assemble.replaced(current, "n", 4, new), "n")


@both("scaled_plan", """
WITH d AS (SELECT c_nationkey::BIGINT AS n, count(*) AS samples FROM customer GROUP BY 1), s AS (SELECT n, round_even(samples * 1872 / (sum(samples) OVER ())::DOUBLE, 0)::BIGINT AS scaled FROM d)
SELECT n, scaled, scaled // 2 AS real, scaled - scaled // 2 AS synthetic FROM s""")  # fmt: skip
def scaled_plan(spark, sf_dir):
    """A distribution scaled to a total, dealt to real and synthetic samples."""
    rows = assemble.distribution(t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("n")), "n")
    return assemble.scaled_counts(rows, "samples", 1872).select("n", *(long(c).alias(c) for c in ("scaled", "real", "synthetic")))


@both("split_composition", """
WITH s AS (SELECT 's' || o_orderkey AS img, (o_orderkey % 9 + 1)::BIGINT AS n FROM orders), i AS (SELECT 'i' || c_custkey AS img FROM customer), r AS (SELECT 'r' || s_suppkey AS img FROM supplier), y AS (SELECT 'y' || p_partkey AS img FROM part),
x AS (
  SELECT 'train' AS split, img, n FROM s WHERE n BETWEEN 2 AND 9 UNION ALL SELECT 'train', img, 1 FROM i UNION ALL SELECT 'train', img, 9 FROM r UNION ALL SELECT 'train', img, 9 FROM y
  UNION ALL SELECT 'val', img, n FROM s WHERE n BETWEEN 2 AND 8 UNION ALL SELECT 'val', img, 1 FROM i UNION ALL SELECT 'val', img, 9 FROM r UNION ALL SELECT 'test', img, 9 FROM r)
SELECT split, n::BIGINT AS n, count(*) AS samples, md5(string_agg(img, ',' ORDER BY img)) AS images FROM x GROUP BY ALL""")  # fmt: skip
def split_composition(spark, sf_dir):
    """What training, validation and test splits are put together from."""
    named = lambda table, key, letter, n: t(spark, sf_dir, table).select(F.concat(F.lit(letter), key).alias("img"), F.concat(F.lit(letter), key).alias("gt"), n.cast("int").alias("n"))
    parts = (named("orders", "o_orderkey", "s", F.col("o_orderkey") % 9 + 1), named("customer", "c_custkey", "i", F.lit(0)), named("supplier", "s_suppkey", "r", F.lit(0)), named("part", "p_partkey", "y", F.lit(0)))
    out = None
    for split in ("train", "val", "test"):
        rows = assemble.split_composition(split, *parts, 9).select(F.lit(split).alias("split"), "img", "n")
        out = rows if out is None else out.unionByName(rows)
    images = F.md5(F.array_join(F.array_sort(F.collect_list("img")), ",").cast("binary"))
    return out.groupBy("split", "n").agg(F.count("*").alias("samples"), images.alias("images")).select("split", long("n").alias("n"), "samples", "images")


def _plan(items: str, prefix: str, samples: int, before: int, both_samples: int) -> str:
    """Rows of a plan as far as the members; ``items``: rows of (id, w)."""
    drawn = "list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', md5(concat_ws(':', id, n, sample, k, 42))[i]) - 1) * (16 ** (8 - i))::BIGINT))::BIGINT"
    reach = f"{0.15 * assemble.ROOM!r}::DOUBLE * greatest(w, 1.0)"
    return f"""
SELECT (n - 2) * {both_samples} + {before} + sample AS position, '{prefix}_train_0_n' || n || '_' || lpad(sample::VARCHAR, 5, '0') AS stem, n, [any_value(id)] || list(member ORDER BY k) AS members, {str(before > 0).lower()} AS is_synthetic
FROM (SELECT *, CASE WHEN high - low < n THEN 1 + {drawn} % every ELSE low + 1 + {drawn} % (high - low) END AS rank
      FROM (SELECT *, row_number() OVER (ORDER BY md5(id || ':42'), id) AS i, least(count(*) OVER (), {samples}) AS kept, count(*) OVER () AS every,
                   (SELECT count(*) FROM ({items}) o WHERE o.w < x.w - {reach.replace('(w,', '(x.w,')}) AS low, (SELECT count(*) FROM ({items}) o WHERE o.w <= x.w + {reach.replace('(w,', '(x.w,')}) AS high
            FROM ({items}) x QUALIFY i <= {samples})
      JOIN (SELECT unnest(range(0, {samples})) AS sample) ON sample % kept = i - 1 CROSS JOIN (SELECT unnest([2, 3, 4]) AS n) CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) WHERE k < n)
JOIN (SELECT id AS member, row_number() OVER (ORDER BY w, id) AS rank FROM ({items})) USING (rank) GROUP BY n, sample"""


_SUPPLIERS, _PARTS = "SELECT s_suppkey AS id, s_acctbal AS w FROM supplier", "SELECT p_partkey AS id, p_size::DOUBLE AS w FROM part"


@both("split_plan", f"""
WITH x AS ({_plan(_SUPPLIERS, 'stacked', 40, 0, 65)} UNION ALL {_plan(_PARTS, 'syn_stacked', 25, 40, 65)})
SELECT position::BIGINT AS position, stem, 'stacks/jpg/' || stem || '.jpg' AS img, 'stacks/gt/' || stem || '.txt' AS gt, n::BIGINT AS n, array_to_string(members, ',') AS members, is_synthetic FROM x""")  # fmt: skip
def split_plan(spark, sf_dir):
    """Stacked samples of a split: real before synthetic ones for each n, with stems and members.

    Many suppliers have so few others near in width that all are drawn from.
    """
    real = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("w"))
    made = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("w"))
    out = assemble.split_plan("train", 0, real, made, "id", "w", 4, 40, 25)
    return out.select("position", "stem", "img", "gt", long("n").alias("n"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "is_synthetic")


_PAGE_WIDTHS = "SELECT l_orderkey AS id, (l_orderkey % 977 + 40)::DOUBLE AS w FROM lineitem GROUP BY ALL"


def page_stacks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The plan of stacks of pages, as if each were a system, and the pages' texts."""
    texts = page_texts(notes(spark, sf_dir)).withColumnRenamed("page", "id")
    items = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("w", F.col("id") % 977 + 40)
    return assemble.split_plan("train", 0, items, None, "id", "w", 4, 300, 0), texts


@both("stacked_split", f"""
WITH {_NOTES}, x AS ({_plan(_PAGE_WIDTHS, 'stacked', 300, 0, 300)}),
b AS (SELECT page, string_agg(CASE WHEN k % 3 = 1 THEN '=' || sys || chr(9) || '=' || sys || chr(10) ELSE '' END || kern || chr(9) || chord, chr(10) ORDER BY k) AS body FROM nt GROUP BY page),
m AS (SELECT stem, n, unnest(members) AS page, generate_subscripts(members, 1) AS pos FROM x)
SELECT stem, n::BIGINT AS n, md5({_HEAD} || string_agg(body, chr(10) || '!!linebreak:original' || chr(10) ORDER BY pos) || {_END}) AS text_md5 FROM m JOIN b USING (page) GROUP BY stem, n""")
def stacked_split(spark, sf_dir):
    """The texts of stacks: later members without header, all but the last without terminator."""
    out = assemble.stacked_texts(*page_stacks(spark, sf_dir), "id", "text")
    return out.select("stem", long("n").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@both("validation_stacks", f"""
WITH x AS ({_plan(_PAGE_WIDTHS, 'stacked', 300, 0, 300)}), c AS (SELECT 'img/' || o_orderkey AS img, 'gt/' || o_orderkey AS gt, o_orderkey % 9 AS n FROM orders)
SELECT img, gt, n::BIGINT AS n FROM c WHERE n <> 3 UNION ALL SELECT 'stacks/jpg/' || stem || '.jpg', 'stacks/gt/' || stem || '.txt', n FROM x WHERE n = 3""")
def validation_stacks(spark, sf_dir):
    """A validation split whose stacks of three are made anew."""
    name = lambda folder: F.concat(F.lit(f"{folder}/"), F.col("o_orderkey").cast("string")).alias(folder)
    current = t(spark, sf_dir, "orders").select(name("img"), name("gt"), (F.col("o_orderkey") % 9).alias("n"))
    return assemble.with_stacks_of(current, page_stacks(spark, sf_dir)[0], 3)


# --- curriculum


@both("eligible_stacks", f"WITH {_PAGES} SELECT stage::BIGINT AS stage, o_orderkey, n::BIGINT AS n FROM r, (SELECT unnest([1, 2, 4, 12]) AS stage) WHERE n = least(stage, 9)")
def eligible_stacks(spark, sf_dir):
    """Samples of exactly the stage's number of systems; the rule of validation sets too."""
    out = curriculum.eligible_stacks(order_pages(spark, sf_dir), [1, 2, 4, 12], 9)
    return out.select(long("stage").alias("stage"), "o_orderkey", long("n").alias("n"))


@both("integrity_check", f"WITH {_PAGES} SELECT o_orderkey, n::BIGINT AS n FROM pg WHERE n <> least(3, page_max) ORDER BY n, o_orderkey LIMIT 5")
def integrity_check(spark, sf_dir):
    """The first samples that don't belong to a stage."""
    rows = order_pages(spark, sf_dir).withColumn("at", F.struct("n", "o_orderkey"))
    expected = F.struct(F.least(F.lit(3), F.col("page_max_n")).alias("n"), F.col("o_orderkey"))
    return curriculum.integrity_violations(rows, "at", expected).select("o_orderkey", long("n").alias("n"))


@both("epoch_limit", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || ':3'), o_orderkey LIMIT 100")
def epoch_limit(spark, sf_dir):
    """A hundred samples of a shuffled epoch."""
    return curriculum.epoch_limit(t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 3, 100)


@both("online_epoch", "SELECT 'stack' AS kind, n::BIGINT AS n, unnest(range(1, CASE WHEN n = 3 THEN 41 ELSE 11 END)) AS draw FROM (SELECT unnest([1, 2, 3]) AS n) UNION ALL SELECT 'real', n_regionkey::BIGINT, 0 FROM nation")
def online_epoch(spark, sf_dir):
    """Stacks of a stage, a share for each earlier one, and real entries at the end."""
    real = t(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("n"))
    out = curriculum.online_epoch(spark, 40, 3, 0.25, real, 3)
    return out.select("kind", long("n").alias("n"), long("draw").alias("draw"))


@both("stage_sweep", "SELECT user_id::VARCHAR AS run_id, (event_id % 4)::BIGINT AS stage, round(avg(least(value * 2, 100)), 6)::DOUBLE AS ser FROM events GROUP BY ALL")
def stage_sweep(spark, sf_dir):
    from ..streaming.stages import sweep

    rows = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") % 4).alias("stage"), (F.col("value") * 2).alias("val_ser"))
    return sweep(rows).select("run_id", "stage", r6(F.col("ser")).alias("ser"))


# --- vocabularies, tokens and paths


@both("batch_padding", f"""
WITH {_EVENTS}, e AS (SELECT user_id, list_transform(types, lambda x: strpos('cepsv', x[1])) AS ids, (row_number() OVER (ORDER BY user_id) - 1) // 4 AS batch_id FROM s)
SELECT user_id, batch_id, max(len(ids)) OVER (PARTITION BY batch_id) AS padded, md5(array_to_string(ids || list_transform(range(0, max(len(ids)) OVER (PARTITION BY batch_id) - len(ids)), lambda i: 0), ',')) AS ids_md5 FROM e""")  # fmt: skip
def batch_padding(spark, sf_dir):
    """Sequences in batches of four, padded to the longest."""
    number = F.transform("types", lambda x: F.instr(F.lit("cepsv"), F.substring(x, 1, 1)).cast("long"))
    out = vocabulary.batches(user_sequences(spark, sf_dir).select("user_id", number.alias("ids")), "user_id", 4)
    return out.select("user_id", long("batch_id").alias("batch_id"), long(F.size("padded")).alias("padded"), F.md5(F.array_join(F.transform("padded", lambda x: x.cast("string")), ",").cast("binary")).alias("ids_md5"))


@both("longest_sequence", f"WITH {_EVENTS} SELECT trunc(max(len(types)) * 1.1::DOUBLE)::BIGINT AS max_length FROM s")
def longest_sequence(spark, sf_dir):
    return vocabulary.longest(user_sequences(spark, sf_dir), "types").select(long("max_length").alias("max_length"))


@both("truth_cut", f"""
WITH {_EVENTS} SELECT user_id, len(types[:coalesce(nullif(least(coalesce(nullif(list_position(types, 'signup'), 0), 100000), coalesce(nullif(list_position(types, 'error'), 0), 100000)), 100000) - 1, len(types))])::BIGINT AS before,
       (len(types) - coalesce(nullif(list_position(types, 'purchase'), 0), 1) + 1)::BIGINT AS after FROM s""")  # fmt: skip
def truth_cut(spark, sf_dir):
    """Tokens before the first of two ends, and from the first that passes a test."""
    rows = user_sequences(spark, sf_dir)
    return rows.select("user_id", long(F.size(text.slice_until(F.col("types"), "signup", "error"))).alias("before"), long(F.size(text.from_where(F.col("types"), lambda x: x == "purchase"))).alias("after"))


@both("path_parts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 12 END::BIGINT AS page_number, CASE WHEN o_orderkey % 4 <> 0 THEN 'd/e/' END AS prefix, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS number,
       ['word', 'character', 'character', 'medium', 'medium'][1 + o_orderkey % 5] AS kind FROM orders""")  # fmt: skip
def path_parts(spark, sf_dir):
    """Numbers of systems and identities in names of pages, and tokenisers in names of checkpoints."""
    k = F.col("o_orderkey")
    stem = F.when(k % 4 == 0, F.concat(F.lit("page"), k)).otherwise(F.concat(F.lit("img_"), "o_custkey", F.lit("_n"), k % 12, F.when(k % 3 == 0, "_x").otherwise("")))
    kind = F.concat(F.lit("run_"), F.get(F.array(*map(F.lit, ("word", "Character", "char", "medium", "bekern"))), (k % 5).cast("int")))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", text.page_number(stem).alias("n"), text.page_identity(F.concat(F.lit("d/e/"), stem)).alias("i"), text.tokenizer_kind(kind).alias("kind"))
    return rows.select("o_orderkey", long("n").alias("page_number"), F.col("i.prefix").alias("prefix"), F.col("i.number").alias("number"), "kind")


# --- paths against listings


@both("resolved_paths", """
WITH w AS (SELECT o_orderkey, 'data/x' || o_orderkey AS raw FROM orders),
f AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'data/x' || o_orderkey WHEN 1 THEN '/base/data/x' || o_orderkey WHEN 2 THEN '/base/x' || o_orderkey ELSE 'other' || o_orderkey END AS path FROM orders)
SELECT o_orderkey, CASE WHEN raw IN (SELECT path FROM f) THEN raw WHEN '/base/' || raw IN (SELECT path FROM f) THEN '/base/' || raw WHEN '/base/x' || o_orderkey IN (SELECT path FROM f) THEN '/base/x' || o_orderkey ELSE '/base/' || raw END AS path, o_orderkey % 4 = 0 AS there FROM w""")  # fmt: skip
def resolved_paths(spark, sf_dir):
    """Paths as given, below a base, and below it without their first folder: the first that a listing has."""
    k = F.col("o_orderkey")
    files = t(spark, sf_dir, "orders").select(F.when(k % 4 == 0, F.concat(F.lit("file:data/x"), k)).when(k % 4 == 1, F.concat(F.lit("file:/base/data/x"), k)).when(k % 4 == 2, F.concat(F.lit("/base/x"), k)).otherwise(F.concat(F.lit("other"), k)).alias("path"))
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("data/x"), k).alias("img"))
    there = scans.existing(rows, files, ["img"]).select("o_orderkey", F.lit(True).alias("there"))
    out = scans.resolved(rows, files, "img", ["/base"]).join(there, "o_orderkey", "left")
    return out.select("o_orderkey", F.col("img_path").alias("path"), F.coalesce("there", F.lit(False)).alias("there"))


@both("listing_checks", """
SELECT 'checkpoint' AS what, 'run/' || c_custkey || '.ckpt' AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'missing', 'p' || c_custkey FROM customer WHERE c_custkey % 3 <> 0""")
def listing_checks(spark, sf_dir):
    """Checkpoints of a listing, and images without a text of their name."""
    k = F.col("c_custkey")
    files = t(spark, sf_dir, "customer").select(F.concat(F.lit("run/"), k, F.when(k % 2 == 0, ".ckpt").otherwise(".txt")).alias("path"), F.concat(F.lit("p"), k).alias("stem"))
    missing = scans.missing_pairs(files, files.where("cast(substring(stem, 2) AS long) % 3 = 0"))
    return scans.checkpoints(files).select(F.lit("checkpoint").alias("what"), F.col("path").alias("name")).unionByName(missing.select(F.lit("missing").alias("what"), F.col("stem").alias("name")))


# --- comparisons


@both("positional_diff", """
WITH l AS (SELECT o_orderpriority AS split, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, o_orderkey % 9 AS n, o_orderstatus AS x, o_orderkey % 50 AS w FROM orders),
r AS (SELECT o_orderpriority AS split, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 9 END AS n, CASE WHEN o_orderkey % 7 = 0 THEN 'Z' ELSE o_orderstatus END AS x, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN 99 ELSE o_orderkey % 50 END AS w FROM orders),
b AS (SELECT l.split, l.i AS row, l.n <> r.n AS dn, l.x <> r.x AS dx, r.w IS NULL AS dr, coalesce(l.w <> r.w, false) AS dw FROM l JOIN r USING (split, i)),
k AS (SELECT split, row, unnest(CASE WHEN dn THEN ['n'] ELSE list_filter([CASE WHEN dx THEN 'text' END, CASE WHEN dr THEN 'unreadable' WHEN dw THEN 'shape' END], lambda x: x IS NOT NULL) END) AS kind FROM b)
SELECT split, row, kind, count(*) OVER (PARTITION BY split, kind) AS mismatches FROM k QUALIFY row_number() OVER (PARTITION BY split, kind ORDER BY row) <= 10""")  # fmt: skip
def positional_diff(spark, sf_dir):
    """The first differences of two splits, row by row."""
    k = F.col("o_orderkey")
    side = lambda n, x, w: t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), "o_orderkey", n.alias("n"), x.alias("text"), w.alias("width"), F.lit(1).alias("height"))
    left = side(k % 9, F.col("o_orderstatus"), k % 50)
    right = side(F.when(k % 11 == 0, 0).otherwise(k % 9), F.when(k % 7 == 0, "Z").otherwise(F.col("o_orderstatus")), F.when(k % 13 == 0, None).when(k % 17 == 0, 99).otherwise(k % 50))
    out = compare.positional_diff(left, right, ["split"], "o_orderkey")
    return out.select("split", long("row").alias("row"), "kind", "mismatches")


@both("size_mismatches", "WITH l AS (SELECT o_orderpriority AS split, count(*) AS left_rows FROM orders GROUP BY 1), r AS (SELECT o_orderpriority AS split, count(*) AS right_rows FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT split, left_rows, coalesce(right_rows, 0) AS right_rows FROM l LEFT JOIN r USING (split) WHERE left_rows <> coalesce(right_rows, 0)")
def size_mismatches(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("split"), "o_orderstatus")
    return compare.size_mismatches(rows, rows.where("o_orderstatus <> 'F'"), ["split"])


@both("common_units", "SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_units(spark, sf_dir):
    return compare.common_units(t(spark, sf_dir, "events"), "user_id", "event_type")


@both("long_metrics", "SELECT c_custkey, unnest(['cer', 'kern_ser']) AS metric, unnest(['base', 'r100']) AS model, unnest([c_acctbal, c_nationkey::DOUBLE]) AS value FROM customer")
def long_metrics(spark, sf_dir):
    """Columns named by metric and model, one below the other."""
    wide = t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("cer_base"), F.col("c_nationkey").cast("double").alias("kern_ser_r100"))
    return compare.long_form(wide, ["c_custkey"], ["cer_base", "kern_ser_r100"])


@both("overall_metrics", f"""
WITH {_NOTES}, m AS ({_measured(f"SELECT page, b.text AS p, a.text AS t FROM ({_texts('nt')}) a JOIN ({_texts('n1')}) b USING (page) WHERE page % 3 <> 0")})
SELECT o_orderkey AS page, {", ".join(f"round(100.0::DOUBLE * {k}_d / {k}_n, 6)::DOUBLE AS base_{k}" for k in ("cer", "ser", "ler"))} FROM orders LEFT JOIN m ON page = o_orderkey""")  # fmt: skip
def overall_metrics(spark, sf_dir):
    """A table of pages with the rates of whole texts; pages without texts keep their row."""
    table = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    texts = both_texts(spark, sf_dir).where("page % 3 <> 0").withColumnRenamed("gt_text", "gt")
    out = compare.with_overall_metrics(table, texts, {"baseline_text": "base"})
    return out.select("page", *(r6(F.col(f"base_{k}")).alias(f"base_{k}") for k in metrics.KINDS))


@both("reserved_lines", "WITH l AS (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) SELECT count(*) AS lines, count_if(regexp_matches(x, '!!linebreak|!!pagebreak|\\*I|\\*F:|!LO'))::BIGINT AS reserved, count_if(x = '')::BIGINT AS blank FROM l")
def reserved_lines(spark, sf_dir):
    """Lines of documents that the tokeniser would drop."""
    from ..functions.tokens import is_reserved

    x = t(spark, sf_dir, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("x"))
    return x.agg(F.count("*").alias("lines"), F.count_if(is_reserved(F.col("x"))).alias("reserved"), F.count_if(F.col("x") == "").alias("blank"))


# --- files


@both("appended_split", "SELECT 'a' || s_suppkey AS value FROM supplier UNION ALL SELECT 'b' || n_nationkey FROM nation")
def appended_split(spark, sf_dir):
    """A split file written, and more lines appended."""
    path = scratch(spark, "split")
    sinks.write_lines(t(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), "s_suppkey").alias("value")), path)
    sinks.append_lines(t(spark, sf_dir, "nation").select(F.concat(F.lit("b"), "n_nationkey").alias("value")), path)
    return spark.read.text(path)


@both("csv_round_trip", "SELECT c_custkey AS page, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS value, (c_nationkey % 2 = 0)::INT AS even FROM customer")
def csv_round_trip(spark, sf_dir):
    """A table of metrics as CSV and back: missing values and flags."""
    path = scratch(spark, "csv")
    rows = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"), F.when(F.col("c_custkey") % 5 == 0, float("nan")).otherwise(F.col("c_acctbal")).alias("value"), (F.col("c_nationkey") % 2 == 0).alias("even"))
    sinks.write_csv(rows, path, ["page", "value", "even"])
    return scans.metric_table(spark, path, "page long, value double, even int")


@both("stored_vocabulary", "SELECT event_type AS token, row_number() OVER (ORDER BY event_type) AS id FROM (SELECT DISTINCT event_type FROM events) UNION ALL SELECT '<pad>', 0")
def stored_vocabulary(spark, sf_dir):
    """A vocabulary built once and read afterwards."""
    path = scratch(spark, "vocabulary")
    build = lambda: vocabulary.build(user_sequences(spark, sf_dir), "types")
    sinks.stored_vocabulary(spark, path, build)
    return sinks.stored_vocabulary(spark, path, lambda: None)


@both("text_artefacts", f"WITH {_NOTES} SELECT page % 8 AS bucket, md5(string_agg(page || ' ' || x, ',' ORDER BY page)) AS texts_md5, count(*) AS texts FROM (SELECT page, string_agg(kern, ' ' ORDER BY k) AS x FROM nt GROUP BY page) GROUP BY bucket")
def text_artefacts(spark, sf_dir):
    """Texts in folders by key, and back."""
    path = scratch(spark, "texts")
    line = assemble.ordered_concat(notes(spark, sf_dir).select("page", "k", "kern"), "page", "k", "kern", " ")
    sinks.write_texts(line.select((F.col("page") % 8).alias("bucket"), F.concat("page", F.lit(" "), "text").alias("text")), path, ["bucket"])
    rows = spark.read.text(path)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.substring_index("value", " ", 1).cast("long").alias("page"), "value"))), lambda x: x["value"])
    return rows.groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.md5(F.array_join(ordered, ",").cast("binary")).alias("texts_md5"), F.count("*").alias("texts"))
