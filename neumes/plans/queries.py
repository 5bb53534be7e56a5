"""The operators bound to the star-schema tables, one query for each."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import bag_matches, bounded, edit_distance, position_matches, precision_recall_f1, symbol_tokens
from ..operators import alignment, assemble, boxes, compare, curriculum, forensics, intervals, metrics, notation, vocabulary
from ..streaming.stages import Rules, stage_trace

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def spread(rows: DataFrame) -> DataFrame:
    """Rows for costly work over all cores where a small input came in fewer partitions."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, model, pred_text, gt_text): whole documents and two fixed corruptions of them.

    The light one misreads characters; the heavy one loses and repeats lines besides.
    """
    rows = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("gt_text"))
    light = F.replace(F.col("gt_text"), F.lit("th"), F.lit("t"))
    lines = F.transform(F.split("gt_text", "\n", -1), lambda x, i: F.when(i % 17 == 3, F.array().cast("array<string>")).when(i % 23 == 5, F.array(x, x)).otherwise(F.array(x)))
    heavy = F.replace(F.replace(F.array_join(F.flatten(lines), "\n"), F.lit("e"), F.lit("")), F.lit(", "), F.lit(",\t"))
    corrupt = F.array(F.struct(F.lit("light").alias("model"), light.alias("pred_text")), F.struct(F.lit("heavy").alias("model"), heavy.alias("pred_text")))
    return rows.select("page", "gt_text", F.inline(corrupt)).select("page", "model", "pred_text", "gt_text")


def model_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro and macro error rates of each model over whole documents: the flagship query."""
    out = metrics.micro_macro(metrics.with_text_errors(spread(predictions(spark, sf_dir))), ["model"])
    return out.select("model", long("units").alias("units"), *(r6(F.col(f"{k}_{m}")).alias(f"{k}_{m}") for k in metrics.KINDS for m in ("micro", "macro")))


def user_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, types): event types of each user in time."""
    parts = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return t(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(parts, lambda x: x["event_type"]).alias("types"))


def user_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, pred, truth): a user's sequence as prediction of that of the next user."""
    s = user_sequences(spark, sf_dir)
    other = s.select((F.col("user_id") - 1).alias("user_id"), F.col("types").alias("truth"))
    return s.withColumnRenamed("types", "pred").join(other, "user_id")


#: Beats of a bucket in which spans meet: some spans of events long.
SPAN_BUCKET = 50_000.0


def user_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of events: ``view`` prolongs the one before it, value is the duration in hundredths."""
    e = t(spark, sf_dir, "events").withColumn("_o", F.struct("ts", "event_id"))
    return intervals.spans(e, "user_id", "_o", F.col("event_type"), F.round(F.col("value") * 100), "view")


def span_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = user_spans(spark, sf_dir)
    return s, s.withColumn("user_id", F.col("user_id") - 1)


@query
def scan_project_filter(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").where("l_quantity >= 45 AND l_returnflag = 'R'")
    return rows.select("l_orderkey", "l_linenumber", r6(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


@query
def model_error_rates(spark, sf_dir):
    return model_rates(spark, sf_dir)


@query
def char_error_rate(spark, sf_dir):
    """The light corruption only loses characters, so that SQL can say how many."""
    rows = metrics.with_text_errors(spread(predictions(spark, sf_dir).where("model = 'light'")), kinds=("cer",))
    return rows.select(F.col("page").alias("doc_id"), long("cer_errors").alias("errors"), long("cer_total").alias("symbols"))


@query
def line_error_rate(spark, sf_dir):
    """Document lines against the same without those that begin with ``The``."""
    text = F.coalesce("text", F.lit(""))
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.startswith("The")), "\n")
    rows = metrics.with_text_errors(t(spark, sf_dir, "documents").select("doc_id", kept.alias("pred_text"), text.alias("gt_text")), kinds=("ler",))
    return rows.select("doc_id", long("ler_errors").alias("errors"), long("ler_total").alias("lines"))


@query
def symbol_error_rate(spark, sf_dir):
    """Words of benchmark items against the same without every seventh."""
    rows = t(spark, sf_dir, "benchmark").select("item_id", symbol_tokens(F.col("text")).alias("w"))
    rows = rows.withColumn("p", F.filter("w", lambda x, i: (i + 1) % 7 != 0))
    return rows.select("item_id", long(edit_distance(F.col("p"), F.col("w"))).alias("errors"), long(F.size("w")).alias("symbols"))


@query
def sequence_edit_distance(spark, sf_dir):
    rows = user_pairs(spark, sf_dir)
    return rows.select("user_id", long(edit_distance(F.col("pred"), F.col("truth"))).alias("distance"), long(F.size("truth")).alias("length"))


@query
def sequence_error_rate(spark, sf_dir):
    rows = metrics.with_token_errors(user_pairs(spark, sf_dir), "pred", "truth", "ser").withColumn("bucket", F.col("user_id") % 5)
    out = metrics.sequence_error_rates(rows, ["bucket"])
    return out.select("bucket", r6(F.col("ser")).alias("ser"), r6(F.col("seq_er")).alias("seq_er"))


@query
def micro_macro_rates(spark, sf_dir):
    rows = metrics.with_token_errors(user_pairs(spark, sf_dir), "pred", "truth", "ser").withColumn("bucket", F.col("user_id") % 5)
    out = metrics.micro_macro(rows, ["bucket"], ("ser",))
    return out.select("bucket", long("units").alias("units"), r6(F.col("ser_micro")).alias("ser_micro"), r6(F.col("ser_macro")).alias("ser_macro"))


@query
def spine_extract(spark, sf_dir):
    """Status and priority of each customer's orders as a two-spine text, and its second spine back."""
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat_ws("\t", "o_orderstatus", "o_orderpriority").alias("line"))
    text = assemble.ordered_concat(rows, "o_custkey", "o_orderkey", "line", "\n")
    text = text.select(F.col("o_custkey").alias("page_id"), F.concat(F.lit("**status\t**priority\n=1\t=1\n"), F.col("text"), F.lit("\n*-\t*-")).alias("text"))
    out = notation.spines(text).where("spine = '**priority'")
    return out.select(F.col("page_id").alias("o_custkey"), long("pos").alias("pos"), "token")


@query
def line_classify_filter(spark, sf_dir):
    """Kinds of lines of documents."""
    rows = notation.lines(t(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id", "text")
    return rows.groupBy("kind").agg(F.count("*").alias("lines"), F.sum(F.length("line").cast("long")).alias("characters"))


@query
def block_split(spark, sf_dir):
    """Turns of conversations in blocks that a user turn begins."""
    rows = notation.numbered_blocks(t(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return rows.groupBy("conv_id", "block_no").agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


def benchmark_words(spark, sf_dir):
    return t(spark, sf_dir, "benchmark").select("item_id", F.split("text", "[ \n]+", -1).alias("tokens"))


@query
def vocab_build(spark, sf_dir):
    return vocabulary.build(benchmark_words(spark, sf_dir))


@query
def vocab_encode_decode(spark, sf_dir):
    """Items encoded by the words of even items; words that these lack become <pad>."""
    items = benchmark_words(spark, sf_dir)
    words = vocabulary.build(items.where("item_id % 2 = 0"))
    ids = vocabulary.encode(items, words, "item_id")
    back = vocabulary.decode(ids, words, "item_id").join(ids, "item_id")
    return back.select("item_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"), F.array_join("tokens", " ").alias("decoded"))


@query
def tokenise_runs(spark, sf_dir):
    from ..functions.tokens import split_note

    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(split_note(F.col("p_name")), "|").alias("tokens"))


@query
def span_islands(spark, sf_dir):
    return user_spans(spark, sf_dir).select("user_id", "span_no", "label", r6(F.col("start_beat")).alias("start_beat"), r6(F.col("duration")).alias("duration"))


@query
def interval_overlap_match(spark, sf_dir):
    truth, pred = span_sides(spark, sf_dir)
    out = intervals.symbol_recall(truth, pred, "user_id", lambda c: F.when(c != "error", c), SPAN_BUCKET)
    return out.select("user_id", r6(F.col("compared")).alias("compared"), r6(F.col("total")).alias("total"), long("excluded").alias("excluded"), r6(F.col("csr")).alias("csr"))


@query
def max_overlap_hamming(spark, sf_dir):
    out = intervals.segmentation_quality(*span_sides(spark, sf_dir), "user_id", SPAN_BUCKET)
    return out.select("user_id", *(r6(F.col(c)).alias(c) for c in ("over", "under", "quality")))


@query
def bag_match(spark, sf_dir):
    rows = user_pairs(spark, sf_dir)
    return rows.select("user_id", long(bag_matches(F.col("pred"), F.col("truth"))).alias("matches"))


@query
def position_match_prf(spark, sf_dir):
    rows = user_pairs(spark, sf_dir).withColumn("m", position_matches(F.col("pred"), F.col("truth")))
    p, r, f = precision_recall_f1(F.col("m"), F.size("pred"), F.size("truth"))
    return rows.select("user_id", long("m").alias("matches"), r6(p).alias("precision"), r6(r).alias("recall"), r6(f).alias("f1"))


@query
def lcs_match(spark, sf_dir):
    rows = user_pairs(spark, sf_dir)
    return rows.select("user_id", long(alignment.common_subsequence(F.col("pred"), F.col("truth"))).alias("matches"))


@query
def windowed_match(spark, sf_dir):
    rows = user_pairs(spark, sf_dir)
    return rows.select("user_id", long(alignment.windowed_matches(F.col("pred"), F.col("truth"))).alias("matches"))


@query
def align_trace_counts(spark, sf_dir):
    """Steps of the alignments by kind; their cost is the distance that the engine's own function gives."""
    rows = alignment.aligned_rows(user_pairs(spark, sf_dir), "pred", "truth")
    out = rows.select("user_id", *alignment.step_counts(F.col("aligned")), edit_distance(F.col("pred"), F.col("truth")).alias("d"))
    return out.select("user_id", *(long(c).alias(c) for c in ("edit_distance", "n_match", "n_substitute", "n_insert", "n_delete")), (F.col("edit_distance") == F.col("d")).alias("sound"))


def event_order(spark, sf_dir):
    return t(spark, sf_dir, "events").withColumn("_o", F.struct("ts", "event_id"))


@query
def boundary_distance(spark, sf_dir):
    """Distance of each event to the nearest ``error`` of its user."""
    out = forensics.boundary_distance(event_order(spark, sf_dir), ["user_id"], "_o", F.col("event_type") == "error")
    return out.select("event_id", long("distance").alias("distance"), long("position").alias("position"))


@query
def distance_gradient(spark, sf_dir):
    near = forensics.boundary_distance(event_order(spark, sf_dir), ["user_id"], "_o", F.col("event_type") == "error")
    out = forensics.distance_gradient(near, [], "distance", F.col("event_type") == "purchase")
    return out.select("bucket", "n", "errors", r6(F.col("error_rate")).alias("error_rate"))


@query
def width_band_pool(spark, sf_dir):
    return assemble.pool_sizes(t(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 0.15)


@query
def pool_stats(spark, sf_dir):
    out = assemble.pool_stats(assemble.pool_sizes(t(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 0.15))
    return out.select(long("smallest").alias("smallest"), r6(F.col("median")).alias("median"), r6(F.col("mean")).alias("mean"), long("largest").alias("largest"), r6(F.col("below")).alias("below"))


@query
def width_pairs(spark, sf_dir):
    """The pairs themselves, as stacks are drawn from them."""
    return assemble.width_pool(t(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", 0.15)


@query
def iou_dedup_pairs(spark, sf_dir):
    """Events of a user as intervals of their day: overlapping ones."""
    e = t(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_timestamp("ts") / 60.0).alias("low"), (F.unix_timestamp("ts") / 60.0 + 600 + F.col("value")).alias("high"))
    out = boxes.iou_pairs(e, "user_id", "event_id", "low", "high", 0.3, 2000.0)
    return out.select("user_id", "event_id", "other", r6(F.col("iou")).alias("iou"))


@query
def gap_boundaries(spark, sf_dir):
    """Days between orders of a customer, dealt to both sides."""
    day = F.datediff("o_orderdate", F.lit("1970-01-01").cast("date"))
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day.alias("top"), (day + 1).alias("bottom"), F.struct(day, "o_orderkey").alias("_o"), F.lit(1_000_000).alias("h"))
    out = boxes.boundaries(rows, "o_custkey", "_o", "top", "bottom", "h")
    return out.select("o_orderkey", long("crop_top").alias("crop_top"), long("crop_bottom").alias("crop_bottom"))


@query
def prefix_fanout(spark, sf_dir):
    """Prefixes of orders of up to five lines; returned orders only as a whole."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("_o"), "l_quantity")
    out = assemble.prefixes(rows, "l_orderkey", "_o", 5, F.col("l_orderkey") % 10 == 0)
    return out.groupBy("l_orderkey", F.col("n").cast("long").alias("n")).agg(F.count("*").alias("lines"), r6(F.sum("l_quantity")).alias("quantity"))


@query
def ordered_concat(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(": ", "role", "text").alias("line"))
    out = assemble.ordered_concat(rows, "conv_id", "turn", "line", "\n!!linebreak:original\n")
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "parts")


def order_pages(spark, sf_dir):
    """Orders of a customer as prefixes of a page: n is the ordinal."""
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", n.alias("n"))
    return curriculum.page_maxima(rows, "o_custkey", "n")


@query
def stage_eligibility(spark, sf_dir):
    out = curriculum.eligible_prefixes(order_pages(spark, sf_dir), [1, 2, 3, 9], 9)
    return out.select(long("stage").alias("stage"), "o_orderkey", long("n").alias("n"))


@query
def replay_sample(spark, sf_dir):
    """A quarter of the lines of each number, by hash of order and line."""
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return curriculum.hash_sample(rows, ["l_linenumber"], "id", 0.25, 42).select("l_orderkey", "l_linenumber")


@query
def curriculum_epoch(spark, sf_dir):
    """Stage 3 with a tenth of the earlier stages' pools."""
    out = curriculum.epoch(curriculum.eligible_prefixes(order_pages(spark, sf_dir), [1, 2, 3], 9), 3, 0.1, "o_orderkey", 7)
    return out.select(long("stage").alias("stage"), "o_orderkey", "origin")


@query
def union_intersect_except(spark, sf_dir):
    a = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    b = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, ("union", "intersect", "except")))).alias("op"))
    return every.join(compare.key_sets(a, b, "k"), "op", "left").groupBy("op").agg(F.count("k").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total"))


@query
def left_anti_missing(spark, sf_dir):
    return compare.missing_units(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), "doc_id")


@query
def left_join_metrics(spark, sf_dir):
    rows = compare.with_columns_of(t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels"), ["doc_id"])
    return rows.select("doc_id", "n_chars", long("quality").alias("quality"), long("toxic").alias("toxic"))


@query
def pivot_wide(spark, sf_dir):
    names = ["click", "error", "purchase", "signup", "view"]
    means = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(r6(F.avg("value")).alias("v"))
    return compare.wide_form(means, ["user_id"], "event_type", names, "v")


def customer_metrics(spark, sf_dir):
    """Largest price of a customer's orders in two halves of the keys, by priority."""
    o = t(spark, sf_dir, "orders")
    half = lambda k: F.max(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice")))
    return o.groupBy("o_orderpriority", "o_custkey").agg(half(0).alias("base"), half(1).alias("other"))


@query
def paired_stats(spark, sf_dir):
    out = compare.paired_stats(customer_metrics(spark, sf_dir), ["o_orderpriority"], "base", "other")
    doubles = ("base_median", "other_median", "median_diff", "mean_diff")
    return out.select("o_orderpriority", *(F.round(c, 2).alias(c) for c in doubles), *(long(c).alias(c) for c in ("n", "wins", "ties", "losses")))


@query
def holm_adjust(spark, sf_dir):
    """Shares of nations among customers, in thousandths, as p-values."""
    n = t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()) / 10)
    out = compare.holm(p, "p", [], ["c_nationkey"])
    from ..functions.text import stars

    return out.select("c_nationkey", r6(F.col("p")).alias("p"), r6(F.col("p_adj")).alias("p_adj"), stars(F.col("p_adj")).alias("sig"))


@query
def wilcoxon_rank_sum(spark, sf_dir):
    out = compare.signed_ranks(customer_metrics(spark, sf_dir), ["o_orderpriority"], "base", "other")
    return out.select("o_orderpriority", long("n").alias("n"), r6(F.col("w_plus")).alias("w_plus"), r6(F.col("w_minus")).alias("w_minus"))


@query
def significance_report(spark, sf_dir):
    """Two halves of orders as models, over customers and priorities."""
    pairs = customer_metrics(spark, sf_dir).select(F.concat_ws("-", "o_custkey", "o_orderpriority").alias("unit"), F.col("o_orderpriority").alias("metric"), F.inline(F.array(F.struct(F.lit("base").alias("model"), F.col("base").alias("value")), F.struct(F.lit("other").alias("model"), F.col("other").alias("value")))))
    out = compare.significance(pairs, "unit", "base", ["other"])
    return out.select("metric", "model", "n", "wins", "ties", "losses", r6(F.col("p_raw")).alias("p_raw"), r6(F.col("p_adj")).alias("p_adj"), "sig")


@query
def confusion_topk(spark, sf_dir):
    """Commonest pairs of status and priority, by year."""
    o = t(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), "o_orderstatus", "o_orderpriority")
    counted = o.groupBy("year", "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("count"))
    return forensics.top_by_count(counted, ["year"], 3, ["o_orderstatus", "o_orderpriority"]).withColumn("place", long("place"))


@query
def confusion_labels(spark, sf_dir):
    """Event types mistaken for others when a user stands for the next one."""
    rows = alignment.aligned_rows(user_pairs(spark, sf_dir), "pred", "truth")
    flat = rows.select("user_id", "pred", "truth", F.explode("aligned").alias("s")).where("s.op IN ('substitute', 'delete')")
    label = F.when(F.col("s.op") == "delete", "deleted").otherwise("wrong")
    flat = flat.select(F.lit("types").alias("level"), label.alias("label"), F.get("truth", F.col("s.truth_index")).alias("gt_token"), F.get("pred", F.col("s.pred_index")).alias("pred_token"), F.col("s.truth_index").alias("gt_index"), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("model"))
    return forensics.confusions(flat, ["level"]).drop("first")


@query
def outcome_categories(spark, sf_dir):
    rows = t(spark, sf_dir, "labels").withColumn("outcome", forensics.outcome(F.col("quality"), F.col("toxic"), 1))
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


@query
def bucket_mean_cap(spark, sf_dir):
    """Mean price of orders by their number of lines, six and more together."""
    n = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("price"))
    out = metrics.bucket_means(n, "n", ["price"], [], 6)
    return out.select(long("bucket").alias("bucket"), "units", F.round("mean_price", 2).alias("mean_price"))


@query
def dataset_diff(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    left, right = p.where("p_partkey % 11 <> 0"), p.where("p_partkey % 13 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 17 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    out = compare.dataset_diff(left, right, ["p_partkey"], ["p_brand", "p_size"])
    return out.select("p_partkey", "status", F.array_join("differing", ",").alias("differing"))


@query
def best_worst_pages(spark, sf_dir):
    """Nations with the largest and smallest mean balance of customers less suppliers."""
    c = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n")).agg(F.avg("c_acctbal").alias("c"))
    s = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n")).agg(F.avg("s_acctbal").alias("s"))
    rows = c.join(s, "n").select(long("n").alias("nation"), F.round(F.col("c") - F.col("s"), 4).alias("delta"))
    return forensics.extremes(rows, "delta", "nation", 5)


SCORES = Rules(threshold=60.0, patience=2, stages=4, final_patience=3)


def score_rows(spark, sf_dir):
    e = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), e.alias("epoch"), F.round("value", 2).alias("val_ser"))


@query
def stage_machine(spark, sf_dir):
    out = stage_trace(score_rows(spark, sf_dir), SCORES)
    best = F.when(F.col("best") < 1e300, F.col("best"))
    return out.select("run_id", long("epoch").alias("epoch"), *(long(c).alias(c) for c in ("stage", "below", "no_improve")), r6(best).alias("best"), "at_final", "stop")


@query
def early_stop(spark, sf_dir):
    """The final branch alone: first epoch at which a run has waited long enough."""
    out = stage_trace(score_rows(spark, sf_dir), Rules(threshold=0.0, stages=1, final_patience=4))
    return out.where("stop").groupBy("run_id").agg(F.min("epoch").cast("long").alias("stopped_at"), r6(F.min("best")).alias("best"))


@query
def clipped_rates(spark, sf_dir):
    rows = t(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("v"))
    return rows.select("user_id", r6(bounded(F.col("v"))).alias("rate"))
