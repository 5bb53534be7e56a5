"""Pages from systems: prefixes, stacks, concatenations, manifests."""

from math import log1p

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import MARKER
from ..functions.text import let, strings
from .notation import is_marked, is_terminator, music_block, without_header, without_terminator
from .positions import positions

END = "*-\t*-"


def prefixes(blocks: DataFrame, key: str, order: str, most: int | None = None, whole_only: Column | None = None) -> DataFrame:
    """Adds n: each key's rows once for each prefix of n rows that holds them.

    n runs from 1 to the smaller of ``most`` and the key's rows; where ``whole_only``
    holds (a test split), only the whole is made. Rows grow as they must, with the
    length of prefixes, which ``most`` bounds.
    """
    w = Window.partitionBy(key)
    rows = blocks.withColumns({"place": F.row_number().over(w.orderBy(order)), "total": F.count("*").over(w).cast("int")})
    last = F.col("total") if most is None else F.least(F.col("total"), F.lit(most))
    ns = F.when(F.col("place") <= last, F.sequence(F.col("place"), last))
    if whole_only is not None:
        ns = F.when(whole_only, F.array("total")).otherwise(ns)
    return rows.withColumn("n", F.explode(ns))


def page_of_blocks(blocks: Column) -> Column:
    """The text of some systems (ARRAY<ARRAY<line>>): inner ones without terminator and blank lines, markers between.

    The last one gets a terminator if it has no line that is one and not blank.
    """
    inner = lambda b: F.filter(b, lambda x: ~is_terminator(x))
    ended = lambda b: F.exists(b, lambda x: is_terminator(x) & (x != ""))
    parts = lambda bs: F.transform(bs, lambda b, i: F.when(i < F.size(bs) - 1, F.concat(inner(b), F.array(F.lit(MARKER)))).when(ended(b), b).otherwise(F.concat(F.filter(b, lambda x: x != ""), F.array(F.lit(END)))))
    return F.array_join(F.flatten(let(blocks, parts)), "\n")


def prefix_page(blocks: Column, n: Column) -> Column:
    """The first n systems of a page; of a page with fewer, all, with a marker at the end and no terminator forced."""
    short = F.transform(blocks, lambda b: F.concat(F.filter(b, lambda x: ~is_terminator(x)), F.array(F.lit(MARKER))))
    return F.when(F.size(blocks) >= n, page_of_blocks(F.slice(blocks, F.lit(1), n))).otherwise(F.array_join(F.flatten(short), "\n"))


def page_of_systems(texts: Column) -> Column:
    """The text of a page of systems that each have a text of their own (ARRAY<text>), with header and breaks around the music."""
    return page_of_blocks(F.transform(texts, lambda t, i: music_block(t, i == 0)))


#: Why an entry of a split gives no prefixes, in the order of the tests.
SKIPS = ("image not found", "no page number", "page not annotated", "no systems", "image unreadable")


def with_skip_reason(entries: DataFrame, files: DataFrame, pages: DataFrame, image: str = "img", crops: bool = True) -> DataFrame:
    """Entries with page_no, systems (how many) and skipped: why there are no prefixes of it, null where there are.

    ``files`` (path, readable) are the images that exist; ``pages`` (page_no, systems)
    the annotated pages. Only crops need the image to be readable. Both are looked up by
    joins; an entry that several reasons hold for has the first.
    """
    number = F.nullif(F.regexp_extract(image, r"img_(\d+)\.jpg$", 1), F.lit("")).cast("long")
    found = entries.withColumn("page_no", number).join(files.select(F.col("path").alias(image), F.lit(True).alias("_there"), F.col("readable").alias("_ok")), image, "left")
    found = found.join(pages.select("page_no", F.col("systems").cast("int").alias("systems"), F.lit(True).alias("_known")), "page_no", "left")
    bad = [F.col("_there").isNull(), F.col("page_no").isNull(), F.col("_known").isNull(), F.coalesce("systems", F.lit(0)) == 0, F.lit(crops) & ~F.coalesce("_ok", F.lit(True))]
    reason = F.coalesce(*(F.when(b, name) for b, name in zip(bad, SKIPS)))
    return found.withColumn("skipped", reason).drop("_there", "_known", "_ok")


def skip_counts(entries: DataFrame, most: int, crops: bool = True) -> DataFrame:
    """(skipped, entries, prefixes): how many entries each reason holds for, and, without one, how many prefixes there are."""
    made = F.when(F.col("skipped").isNull(), F.least("systems", F.lit(most)) if crops else F.lit(1)).otherwise(0)
    return entries.groupBy("skipped").agg(F.count("*").alias("entries"), F.sum(made).alias("prefixes"))


def stacked_page(systems: Column) -> Column:
    """Systems of different pages as one: later ones from their first bar on, all but the last without terminator."""
    n = F.size(systems)
    bare = lambda s: F.filter(s, lambda x: x != MARKER)
    part = lambda s, i: F.when(i == 0, bare(s)).otherwise(F.concat(F.array(F.lit(MARKER)), without_header(bare(s))))
    parts = F.transform(systems, lambda s, i: F.when(i < n - 1, without_terminator(part(s, i))).otherwise(part(s, i)))
    return F.array_join(F.flatten(parts), "\n")


def recognised_page(systems: Column) -> Column:
    """Recognised systems (ARRAY<text>) as a page.

    Lines with ``b:none`` go. Of later systems, headers and terminators go, and
    interpretations and comments before the first other line. A terminator closes
    a page of several systems; a single system stays as it is.
    """

    def later(s: Column) -> Column:
        body = F.filter(s, lambda x: ~x.startswith("**") & ~x.startswith("*-") & (x != ""))
        begins = lambda b: F.array_position(F.transform(b, lambda x: ~is_marked(x, "*!")), True)
        return let(body, lambda b: let(begins(b), lambda at: F.filter(b, lambda x, i: ((at > 0) & (i >= at - 1)) | ~is_marked(x, "*!"))))

    def whole(lines: Column) -> Column:
        first = F.filter(F.get(lines, F.lit(0)), lambda x: ~x.startswith("*-") & (x != ""))
        rest = F.transform(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda s: F.concat(F.array(F.lit(MARKER)), later(s)))
        return F.when(F.size(lines) == 1, F.array_join(F.get(lines, F.lit(0)), "\n")).when(F.size(lines) > 1, F.array_join(F.concat(first, F.flatten(rest), F.array(F.lit(END))), "\n"))

    return let(F.transform(systems, lambda s: F.filter(F.split(s, "\n", -1), lambda x: ~F.contains(x, F.lit("b:none")))), whole)


def ordered_concat(rows: DataFrame, key: str, order: str, value: str, between: str) -> DataFrame:
    """(key, text): values of a key in their order."""
    parts = F.sort_array(F.collect_list(F.struct(order, value)))[value]
    return rows.groupBy(key).agg(F.array_join(parts, between).alias("text"), F.count("*").alias("parts"))


def crop_height(to_y: Column, pad: int, height: Column) -> Column:
    return F.least(to_y + pad, height)


def stack_size(widths: Column, n: Column, system_height: int) -> Column:
    """STRUCT<width, height> of n stacked systems."""
    return F.struct(F.array_max(widths).alias("width"), (n * system_height).alias("height"))


def scaled_size(width: Column, height: Column, target: Column) -> Column:
    """STRUCT<width, height> at the target height; halves round to even, widths are 1 at least."""
    w = F.when(height != target, F.greatest(F.lit(1), F.bround(width * target / height, 0).cast("int"))).otherwise(width)
    return F.struct(w.alias("width"), target.alias("height"))


#: Buckets are so much wider than bands that rounding leaves no pair two buckets apart.
SLACK = 1.0 + 1e-9


def width_pool(items: DataFrame, id_col: str, width: str, tolerance: float, by: tuple[str, ...] = (), shares: int = 32) -> DataFrame:
    """(id, other): items whose width differs by at most ``tolerance`` times the first one's, itself included.

    Items meet in buckets, so that only near ones are compared: of the logarithm above 1,
    and of ``tolerance`` below, where it is measured against 1. All pairs are the result;
    ``pool_sizes`` counts them without making them. The items of a bucket are dealt to
    ``shares`` and each share meets the bucket by itself, so that few buckets take many tasks.
    """
    step = log1p(tolerance) * SLACK
    w = F.col(width)
    bucket = F.when(w > 1.0, F.floor(F.log(F.greatest(w, F.lit(1.0))) / step)).otherwise(F.floor((w - 1.0) / (tolerance * SLACK)))
    keys = [*by, "_k", "_s"]
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = items.select(*by, F.col(id_col), w.alias("_w"), F.explode(F.array(bucket - 2, bucket - 1, bucket, bucket + 1)).alias("_k")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    b = items.select(*by, F.col(id_col).alias("other"), w.alias("_v"), bucket.alias("_k"), F.pmod(F.xxhash64(id_col), F.lit(shares)).cast("int").alias("_s"))
    # pairs are many where rows are few: neither a broadcast side nor merged partitions may leave all of them to one task
    near = a.repartition(tasks, *keys).join(b.repartition(tasks, *keys).hint("shuffle_hash"), keys).where(F.abs(F.col("_v") - F.col("_w")) <= tolerance * F.greatest(F.col("_w"), F.lit(1.0)))
    return near.select(*by, id_col, "other")


#: Halvings after which the end of a band lies between doubles that no widths are between.
HALVINGS = 100


def band_end(w: Column, tolerance: float, side: int) -> Column:
    """The last double on one side (-1 or 1) whose difference from ``w``, as it is computed, is within ``tolerance`` times ``w``, 1 at least.

    The sum of ``w`` and that distance may be rounded past it or short of it. The test
    only ever fails farther out, so the end is found by halving around the sum.
    """
    reach = tolerance * F.greatest(w, F.lit(1.0))
    room = (F.abs(w) + reach) * 1e-12
    within = lambda v: F.abs(v - w) <= reach

    def half(s: Column, _: Column) -> Column:
        middle = (s["a"] + s["b"]) / 2.0
        return F.when(within(middle), F.struct(middle.alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), middle.alias("b")))

    end = w + side * reach
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct((end - side * room).alias("a"), (end + side * room).alias("b")), half)["a"]


def pool_sizes(items: DataFrame, id_col: str, width: str, tolerance: float, parts: int = 256) -> DataFrame:
    """(id, pool): how many items each one's pool has, by running counts over sorted widths.

    Distinct widths are counted up to both ends of their bands. Widths are dealt to
    ``parts`` ranges, each is counted by itself, and the ranges' sums are put before it.
    """
    widths = items.where(F.col(width).isNotNull()).groupBy(F.col(width).cast("double").alias("_w")).agg(F.count("*").alias("_c"))
    cuts = widths.approxQuantile("_w", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []  # at most ``parts`` numbers
    part = lambda x: F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<double>"), lambda c: c <= x))
    # at each place first the counts below it, then its own widths, then the counts up to it
    asked = F.array(*(F.struct(x.alias("at"), F.lit(k).alias("kind"), c.alias("n")) for x, k, c in ((band_end(F.col("_w"), tolerance, -1), 0, F.lit(0)), (F.col("_w"), 1, F.col("_c")), (band_end(F.col("_w"), tolerance, 1), 2, F.lit(0)))))
    places = widths.select("_w", F.inline(asked)).withColumn("part", part(F.col("at")))
    before = places.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each part
    running = F.sum("n").over(Window.partitionBy("part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = places.withColumn("upto", running).where("kind <> 1").join(F.broadcast(before), "part")
    sizes = counted.groupBy("_w").agg(F.sum(F.when(F.col("kind") == 2, F.col("upto") + F.col("before")).otherwise(-F.col("upto") - F.col("before"))).alias("pool"))
    return items.join(sizes, items[width].cast("double") == sizes["_w"]).select(id_col, "pool")


def pool_stats(sizes: DataFrame, few: int = 5, size: str = "pool") -> DataFrame:
    """Smallest, median, mean and largest pool, and the share of pools below ``few``, in percent."""
    n = F.col(size)
    return sizes.agg(F.min(n).alias("smallest"), F.median(n).alias("median"), F.avg(n).alias("mean"), F.max(n).alias("largest"), (100.0 * F.count_if(n < few) / F.count("*")).alias("below"))


def _hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


#: Widths are compared with this much room, so that a tolerance that is reached exactly counts.
ROOM = 1.0 + 1e-12


def stack_plan(items: DataFrame, id_col: str, width: str, ns: list[int], samples: int, seed: int, tolerance: float = 0.15) -> DataFrame:
    """(n, sample, members): stacks of n items, an anchor and n - 1 draws from those near in width, by hashes.

    Anchors are the first ``samples`` items in hash order, and again from the first where
    there are fewer. An anchor's pool holds the items whose widths differ by at most
    ``tolerance`` times its own, itself included; a pool of fewer than n items is
    replaced by all items. Pools are never made: items are numbered in the order of
    their widths, together with both ends of the anchors' bands, so that a pool is an
    interval of ranks and a draw is a rank in it. Items without a width take no part.
    """
    valid = items.where(F.col(width).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id"), F.col(width).cast("double").alias("_w"))
    order = _hash_order("_id", seed)
    anchors = valid.withColumn("_o", order).orderBy("_o", "_id").limit(samples)  # at most ``samples`` rows, a parameter, from here on
    reach = tolerance * ROOM * F.greatest(F.col("_w"), F.lit(1.0))
    ends = F.array(F.struct((F.col("_w") - reach).alias("_at"), F.lit(0).alias("_kind")), F.struct((F.col("_w") + reach).alias("_at"), F.lit(2).alias("_kind")))
    # below an end of a band stand the items of smaller widths, and at its upper end those of equal widths too
    places = valid.select("_id", F.col("_w").alias("_at"), F.lit(1).alias("_kind"), F.lit(1).alias("_one")).unionByName(anchors.select("_id", F.inline(ends), F.lit(0).alias("_one")))
    ranked = positions(places, [], ["_at", "_kind", "_id"], ["_one"])
    known = ranked.where("_kind = 1").select(F.col("upto__one").alias("_rank"), F.col("_id").alias("member"))
    band = ranked.where("_kind <> 1").groupBy("_id").agg(F.min("upto__one").alias("_low"), F.max("upto__one").alias("_high"), F.max("total__one").alias("_every"))
    w = Window.orderBy(order, "_id")
    few = band.withColumns({"_i": F.row_number().over(w), "_all": F.count("*").over(Window.partitionBy())})
    plan = few.select("*", F.explode(F.array(*map(F.lit, ns))).alias("n")).withColumn("sample", F.explode(F.sequence(F.col("_i") - 1, F.lit(samples - 1), F.col("_all"))))
    small = F.col("_high") - F.col("_low") < F.col("n")
    plan = plan.withColumns({"_low": F.when(small, 0).otherwise(F.col("_low")), "_high": F.when(small, F.col("_every")).otherwise(F.col("_high"))})
    # draws by md5, which other engines have too
    number = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.col("n").cast("string"), F.col("sample").cast("string"), k.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    draws = plan.select("n", "sample", "_id", "_low", "_high", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)))).alias("k")).where("k < n")
    draws = draws.withColumn("_rank", F.col("_low") + 1 + F.pmod(number(F.col("k")), F.col("_high") - F.col("_low")))
    drawn = known.join(F.broadcast(draws), "_rank")  # samples times the sum of ns at most
    members = F.transform(F.array_sort(F.collect_list(F.struct("k", "member"))), lambda x: x["member"])
    full = drawn.groupBy("n", "sample", "_id").agg(members.alias("_rest"))
    alone = plan.where("n = 1").select("n", "sample", "_id", F.array().cast("array<bigint>").alias("_rest"))
    out = full.unionByName(alone)
    return out.select("n", F.col("sample").cast("int").alias("sample"), F.concat(F.array("_id"), "_rest").alias("members"))


def split_plan(
    split: str, fold: int, real: DataFrame, synthetic: DataFrame | None, id_col: str, width: str, max_n: int, n_real: int, n_synthetic: int,
    seed: int = 42, tolerance: float = 0.15, folder: str = "stacks",
) -> DataFrame:
    """(position, stem, img, gt, n, members, is_synthetic): the stacked samples of a split for n = 2 to ``max_n``.

    ``real`` and ``synthetic`` are items (id, width). Of each n the real samples come
    before the synthetic ones; position is the order of the split file. Images and
    texts are named below ``folder``.
    """
    ns = list(range(2, max_n + 1))
    parts = [(real, n_real, False, "stacked")] + ([(synthetic, n_synthetic, True, "syn_stacked")] if synthetic is not None and n_synthetic > 0 else [])
    out = None
    for items, samples, made, prefix in parts:
        before = F.lit(n_real if made else 0)
        rows = stack_plan(items, id_col, width, ns, samples, seed, tolerance)
        stem = F.format_string(f"{prefix}_{split}_{fold}_n%d_%05d", "n", "sample")
        position = (F.col("n") - 2) * (n_real + (n_synthetic if len(parts) > 1 else 0)) + before + F.col("sample")
        rows = rows.select(position.cast("long").alias("position"), stem.alias("stem"), "n", "members", F.lit(made).alias("is_synthetic"))
        out = rows if out is None else out.unionByName(rows)
    return out.select("position", "stem", F.concat(F.lit(f"{folder}/jpg/"), "stem", F.lit(".jpg")).alias("img"), F.concat(F.lit(f"{folder}/gt/"), "stem", F.lit(".txt")).alias("gt"), "n", "members", "is_synthetic")


def stacked_texts(plan: DataFrame, systems: DataFrame, id_col: str, text: str) -> DataFrame:
    """``plan`` with the text of each stack: members meet their systems, and are put together in the order of the plan.

    A member that is drawn twice stands twice; one without a text counts as empty.
    """
    members = plan.select("stem", F.posexplode("members").alias("_k", "_id"))
    known = systems.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lines = lambda t: F.split(F.regexp_replace(t, r"\n\z", ""), "\n", -1)
    parts = F.array_sort(F.collect_list(F.struct("_k", "_text")))
    whole = members.join(known, "_id", "left").withColumn("_text", F.coalesce("_text", F.lit(""))).groupBy("stem").agg(parts.alias("_parts"))
    return plan.join(whole.select("stem", stacked_page(F.transform("_parts", lambda p: lines(p["_text"]))).alias("text")), "stem")


def with_stacks_of(current: DataFrame, added: DataFrame, n: int) -> DataFrame:
    """(img, gt, n): a validation split with its stacks of n systems replaced by those of ``added``, a plan."""
    return replaced(current.select("img", "gt", "n"), "n", n, added.where(F.col("n") == n).select("img", "gt", F.col("n").cast(current.schema["n"].dataType).alias("n")))


def size_stats(images: DataFrame, width: str = "width", height: str = "height", headroom: float = 1.1) -> DataFrame:
    """Average, largest and smallest width, largest height, and both maxima with headroom, cut to whole numbers."""
    w, h = F.col(width), F.col(height)
    most = lambda c: (F.max(c) * headroom).cast("int")
    return images.agg(F.avg(w).alias("mean_width"), F.max(w).alias("max_width"), F.min(w).alias("min_width"), F.max(h).alias("max_height"), most(w).alias("width_limit"), most(h).alias("height_limit"))


def manifest(samples: DataFrame, parts: list[str]) -> DataFrame:
    """(value): lines of a split file, fields joined by a blank."""
    return samples.select(F.concat_ws(" ", *(F.col(p).cast("string") for p in parts)).alias("value"))


def replaced(current: DataFrame, n_col: str, n: int, new: DataFrame) -> DataFrame:
    """The split with all rows of N = n replaced by new ones."""
    return current.where(~F.col(n_col).eqNullSafe(F.lit(n))).unionByName(new)


def distribution(split: DataFrame, n_col: str) -> DataFrame:
    return split.groupBy(n_col).agg(F.count("*").alias("samples"))


def scaled_counts(plan: DataFrame, count: str, total: int) -> DataFrame:
    """Counts scaled to about ``total`` and dealt to real and synthetic ones, halves to even."""
    every = F.sum(count).over(Window.partitionBy())
    k = F.bround(F.col(count) * total / every, 0).cast("int")
    return plan.withColumn("scaled", k).withColumns({"real": F.floor(F.col("scaled") / 2).cast("int"), "synthetic": F.col("scaled") - F.floor(F.col("scaled") / 2).cast("int")})


def split_composition(split: str, stacked: DataFrame, singles: DataFrame, real_pages: DataFrame, synthetic_pages: DataFrame, most: int) -> DataFrame:
    """(img, gt, n) of a split of (img, gt[, n]) tables.

    Training has stacks of 2 to ``most``, single systems as 1, and full pages, real
    and synthetic, as ``most``; validation has stacks below ``most``, single systems
    and real pages; a test split has real pages only.
    """
    page = lambda d, n: d.select("img", "gt", F.lit(n).alias("n"))
    if split == "test":
        return page(real_pages, most)
    stacks = stacked.where(F.col("n").between(2, most if split == "train" else most - 1)).select("img", "gt", "n")
    out = stacks.unionByName(page(singles, 1)).unionByName(page(real_pages, most))
    return out.unionByName(page(synthetic_pages, most)) if split == "train" else out


def capped_width(width: Column, height: Column, target: int, most: int = 1000) -> Column:
    """Width at the target height, rounded up, at most ``most``."""
    return F.least(F.ceil(width * target / height), F.lit(most)).cast("int")
