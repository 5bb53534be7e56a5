"""Boxes of staves on a page: duplicates, gaps, crop boundaries."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

_CORNERS = ("x1", "y1", "x2", "y2")


def iou_pairs(boxes: DataFrame, page: str, box: str, low: str, high: str, least: float, width: float | None = None) -> DataFrame:
    """(page, box, other, iou) of boxes of a page whose vertical extents overlap by ``least`` of their hull.

    With ``width``, boxes of a page meet only in buckets of that height.
    """
    put = lambda d, l, h, name: d if width is None else d.withColumn(name, F.explode(F.sequence(F.floor(F.col(l) / width), F.floor(F.col(h) / width))))
    a = put(boxes.select(F.col(page), F.col(box), F.col(low).alias("_l"), F.col(high).alias("_h")), "_l", "_h", "_a")
    b = put(boxes.select(F.col(page).alias("_page"), F.col(box).alias("other"), F.col(low).alias("_m"), F.col(high).alias("_i")), "_m", "_i", "_b")
    both = F.greatest(F.lit(0.0), F.least("_h", "_i") - F.greatest("_l", "_m"))
    hull = F.greatest("_h", "_i") - F.least("_l", "_m")
    on = (F.col(page) == F.col("_page")) & (F.col(box) < F.col("other")) & (F.col("_l") < F.col("_i")) & (F.col("_m") < F.col("_h"))
    if width is None:
        met = a.join(b, on)
    else:
        met = a.join(b, on & (F.col("_a") == F.col("_b"))).where(F.floor(F.greatest("_l", "_m") / width) == F.col("_a"))
    return met.withColumn("iou", F.try_divide(both, hull)).where(F.col("iou") >= least).select(page, box, "other", "iou")


def _extent_iou(a: Column, b: Column) -> Column:
    both = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    hull = F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"])
    return F.when(hull > 0, both / hull).otherwise(0.0)


def page_arrays(boxes: DataFrame) -> DataFrame:
    """(page_id, boxes): the boxes of a page as one array in the order of their centres. A page has some dozens of boxes at most."""
    center = (F.col("y1") + F.col("y2")) / 2.0
    parts = F.struct(center.alias("y_center"), "box_id", "x1", "y1", "x2", "y2")
    return boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(parts)).alias("boxes"))


def without_duplicates(boxes: Column, least: float = 0.6) -> Column:
    """Of boxes in order, one of each set that overlaps its first one: the narrowest, the earlier of equal ones.

    A fold over the array: each box joins the first set that it overlaps, or begins one.
    """
    width = lambda b: b["x2"] - b["x1"]

    def step(sets: Column, box: Column) -> Column:
        at = F.array_position(F.transform(sets, lambda s: _extent_iou(s["first"], box) >= least), True)
        joined = F.transform(sets, lambda s, i: F.when((i + 1 == at) & (width(box) < width(s["best"])), F.struct(s["first"].alias("first"), box.alias("best"))).otherwise(s))
        return F.when(at > 0, joined).otherwise(F.concat(sets, F.array(F.struct(box.alias("first"), box.alias("best")))))

    none = F.filter(F.transform(boxes, lambda b: F.struct(b.alias("first"), b.alias("best"))), lambda b: F.lit(False))
    kept = F.aggregate(boxes, none, step)
    # sets may come to stand in another order by their best boxes
    placed = F.array_sort(F.transform(kept, lambda s, i: F.struct(s["best"]["y_center"].alias("y_center"), i.alias("place"), s["best"].alias("box"))))
    return F.transform(placed, lambda s: s["box"])


def _median(values: Column) -> Column:
    """The median of a non-empty array of numbers; of two in the middle, their mean."""
    return let(F.array_sort(values), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2.0)


def with_missing(boxes: Column, factor: float = 1.8, least: int = 3) -> Column:
    """Boxes in order, with boxes put in where the upper left corners of neighbours are more than ``factor`` medians apart.

    Distances are those of the corners in two dimensions. A distance of d gets
    max(1, round(d / median) - 1) boxes of median width and height, evenly spaced, with
    coordinates cut to whole numbers; they have ``inserted`` and no box_id. Fewer than
    ``least`` boxes stay as they are.
    """
    n = F.size(boxes)
    own = F.transform(boxes, lambda b, i: F.struct(b["y_center"].alias("y_center"), i.alias("gap"), F.lit(0).alias("k"), b["box_id"].alias("box_id"), *(b[c].alias(c) for c in _CORNERS), F.lit(False).alias("inserted")))
    pairs = F.transform(F.slice(boxes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda b, i: F.struct(F.get(boxes, i).alias("a"), b.alias("b"), i.alias("gap")))
    apart = lambda p: F.sqrt(F.pow((p["b"]["x1"] - p["a"]["x1"]).cast("double"), 2.0) + F.pow((p["b"]["y1"] - p["a"]["y1"]).cast("double"), 2.0))
    size = F.struct(
        _median(F.transform(pairs, apart)).alias("apart"), _median(F.transform(boxes, lambda b: b["x2"] - b["x1"])).cast("int").alias("width"), _median(F.transform(boxes, lambda b: b["y2"] - b["y1"])).cast("int").alias("height")
    )

    def between(p: Column, m: Column) -> Column:
        missing = F.greatest(F.lit(1), F.bround(apart(p) / m["apart"], 0).cast("int") - 1)

        def put(k: Column) -> Column:
            at = lambda c: (p["a"][c] + k / (missing + 1) * (p["b"][c] - p["a"][c])).cast("int")
            x, y = at("x1"), at("y1")
            corners = (x.alias("x1"), y.alias("y1"), (x + m["width"]).alias("x2"), (y + m["height"]).alias("y2"))
            return F.struct(((y + y + m["height"]) / 2.0).alias("y_center"), p["gap"].alias("gap"), k.alias("k"), F.lit(None).cast("long").alias("box_id"), *corners, F.lit(True).alias("inserted"))

        return F.when(apart(p) > factor * m["apart"], F.transform(F.sequence(F.lit(1), missing), put))

    made = let(size, lambda m: F.when(m["apart"] > 0, F.flatten(F.filter(F.transform(pairs, lambda p: between(p, m)), lambda x: x.isNotNull()))))
    return F.array_sort(F.when(n >= least, F.concat(own, F.coalesce(made, F.filter(own, lambda b: F.lit(False))))).otherwise(own))


def merge_duplicates(boxes: DataFrame, least: float = 0.6) -> DataFrame:
    """(page_id, box_id, x1, y1, x2, y2): boxes of each page without duplicates."""
    kept = page_arrays(boxes).select("page_id", F.inline(without_duplicates(F.col("boxes"), least)))
    return kept.select("page_id", "box_id", *_CORNERS)


def interpolate_boxes(boxes: DataFrame, factor: float = 1.8, least: int = 3) -> DataFrame:
    """(page_id, system_no, box_id, x1, y1, x2, y2, inserted) of boxes of one column, missing ones put in."""
    filled = page_arrays(boxes).select("page_id", F.posexplode(with_missing(F.col("boxes"), factor, least)).alias("_i", "b"))
    return filled.select("page_id", (F.col("_i") + 1).alias("system_no"), "b.box_id", *(f"b.{c}" for c in _CORNERS), "b.inserted")


def boundaries(boxes: DataFrame, page: str, order: str, top: str, bottom: str, height: str, above: float = 0.75, below: float = 0.25, alone: float = 0.4) -> DataFrame:
    """Adds crop_top and crop_bottom: of the gap between two boxes the upper one gets ``below``, cut to a whole number, the lower one the rest.

    The first box takes ``above`` and the last one ``below`` of the mean gap, within the
    page; a single box has ``alone`` of its own height for a gap.
    """
    w = Window.partitionBy(page).orderBy(order)
    rows = boxes.withColumns({"_b": F.lag(bottom).over(w), "_t": F.lead(top).over(w)})
    rows = rows.withColumns({"_up": F.col(top) - F.col("_b"), "_down": F.col("_t") - F.col(bottom)})
    mean = F.coalesce(F.avg("_up").over(Window.partitionBy(page)), alone * (F.col(bottom) - F.col(top)))
    whole = lambda x: x.cast("int")
    first = F.greatest(F.lit(0), F.col(top) - whole(above * F.col("_mean")))
    last = F.least(F.col(height), F.col(bottom) + whole(below * F.col("_mean")))
    rows = rows.withColumn("_mean", mean).withColumns({
        "crop_top": F.when(F.col("_b").isNull(), first).otherwise(F.col("_b") + whole(below * F.col("_up"))).cast("int"),
        "crop_bottom": F.when(F.col("_t").isNull(), last).otherwise(F.col(bottom) + whole(below * F.col("_down"))).cast("int"),
    })
    return rows.drop("_b", "_t", "_mean", "_up", "_down")


def staves(detections: DataFrame, wanted: str = "staff") -> DataFrame:
    """Detections of the wanted class with their vertical centre."""
    return detections.where(F.col("class") == wanted).withColumn("y_center", (F.col("y1") + F.col("y2")) / 2.0)


def class_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("class").agg(F.count("*").alias("boxes"))


def page_skew(angles: DataFrame, page: str, angle: str, most: float = 15.0, least: float = 0.1) -> DataFrame:
    """(page, skew): median of the plausible line angles; 0 where it is too small to matter."""
    m = F.median(F.when(F.abs(F.col(angle)) <= most, F.col(angle)))
    return angles.groupBy(page).agg(m.alias("_m")).select(page, F.when(F.abs("_m") < least, 0.0).otherwise(F.coalesce("_m", F.lit(0.0))).alias("skew"))


def segment_staves(detections: DataFrame, wanted: str = "staff", least: float = 0.6, factor: float = 1.8) -> DataFrame:
    """(page_id, system_no, box_id, x1, y1, x2, y2, y_center, inserted, crop_top, crop_bottom) of the systems of each page.

    Of (page_id, box_id, class, x1, y1, x2, y2, image_height): boxes of the wanted class
    without duplicates, in the order of their centres, with boxes for systems that were
    missed, and the rows to crop. One shuffle, by page.
    """
    found = detections.where(F.col("class") == wanted)
    center = (F.col("y1") + F.col("y2")) / 2.0
    parts = F.struct(center.alias("y_center"), "box_id", *_CORNERS)
    pages = found.groupBy("page_id").agg(F.array_sort(F.collect_list(parts)).alias("boxes"), F.max("image_height").alias("image_height"))
    pages = pages.withColumn("boxes", let(without_duplicates(F.col("boxes"), least), lambda b: with_missing(b, factor)))
    rows = pages.select("page_id", "image_height", F.posexplode("boxes").alias("_i", "b"))
    rows = rows.select("page_id", (F.col("_i") + 1).alias("system_no"), "b.box_id", *(f"b.{c}" for c in _CORNERS), "b.y_center", "b.inserted", "image_height")
    return boundaries(rows, "page_id", "system_no", "y1", "y2", "image_height").drop("image_height")
