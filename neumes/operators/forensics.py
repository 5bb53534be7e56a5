"""Where and how predictions fail: labels by position, confusions, distances to breaks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chords import chord_error, note_error
from ..functions.batches import streams
from .alignment import aligned_levels, truth_matches
from .alignment import insertions as inserted
from .notation import FAR

DELETED = "<DEL>"


def position_labels(pairs: DataFrame, keys: list[str], pred: str, truth: str, level: str) -> DataFrame:
    """(keys, gt_index, gt_token, label, pred_token), a row for each truth token; level: chord or kern."""
    rows = pairs.withColumn("_m", truth_matches(F.col(pred), F.col(truth)))
    found = F.zip_with(truth, "_m", lambda t, at: F.struct(t.alias("gt_token"), F.get(F.col(pred), at).alias("pred_token")))
    flat = rows.select(*keys, F.posexplode(found).alias("gt_index", "s")).select(*keys, "gt_index", "s.*")
    return flat.select(*keys, "gt_index", "gt_token", REFINE[level](F.col("gt_token"), F.col("pred_token")).alias("label"), "pred_token")


#: What tells two tokens of a level apart.
REFINE = {"chord": chord_error, "kern": note_error}


def insertions(pairs: DataFrame, keys: list[str], pred: str, truth: str) -> DataFrame:
    """(keys, after_gt_index, pred_token): predicted tokens without a truth token, -1 before the first one."""
    rows = pairs.withColumn("_new", inserted(F.col(pred), F.col(truth))).select(*keys, pred, F.inline("_new"))
    return rows.select(*keys, "after_gt_index", F.get(F.col(pred), F.col("at")).alias("pred_token"))


def two_model_positions(base: DataFrame, replay: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Truth tokens with the labels of both models; a missing one counts as deleted."""
    on = [*keys, "gt_index"]
    take = lambda d, n: d.select(*on, F.col("label").alias(f"{n}_label"), F.col("pred_token").alias(f"{n}_pred"))
    out = truth.join(take(base, "baseline"), on, "left").join(take(replay, "replay"), on, "left")
    out = out.withColumns({f"{n}_label": F.coalesce(f"{n}_label", F.lit("deleted")) for n in ("baseline", "replay")})
    return out.withColumn("outcome", outcome(F.col("baseline_label"), F.col("replay_label")))


def outcome(base: Column, other: Column, correct: str = "correct") -> Column:
    b, o = base == correct, other == correct
    return F.when(b & o, "both_correct").when(~b & ~o, "both_wrong").when(o, "only_baseline_wrong").otherwise("only_replay_wrong")


def confusions(labels: DataFrame, by: list[str], model: str = "model") -> DataFrame:
    """(by, model, gt, pred, count, also_in_other_model) of wrong predictions and, as <DEL>, of missing ones."""
    wrong = labels.where((F.col("label") == "deleted") | ((F.col("label") != "correct") & (F.coalesce("pred_token", F.lit("")) != "")))
    counted = wrong.groupBy(*by, F.col("gt_token").alias("gt"), F.when(F.col("label") == "deleted", DELETED).otherwise(F.col("pred_token")).alias("pred"), model).agg(F.count("*").alias("count"), F.min("gt_index").alias("first"))
    pair = Window.partitionBy(*by, "gt", "pred")
    return counted.withColumn("also_in_other_model", F.count("*").over(pair) > 1)


def top_by_count(counted: DataFrame, by: list[str], k: int, ties: list[str], count: str = "count") -> DataFrame:
    """The k largest counts of each group; equal counts in the order of ``ties``."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(count), *ties))
    return counted.withColumn("place", place).where(F.col("place") <= k)


def joint_confusions(wide: DataFrame, first: str, second: str, k: int) -> DataFrame:
    """Confusions that both models make, by the smaller of both counts."""
    both = wide.where((F.col(first) > 0) & (F.col(second) > 0)).withColumn("joint", F.least(first, second))
    return both.orderBy(F.desc("joint"), "gt", "pred").limit(k)


def boundary_distance(rows: DataFrame, keys: list[str], order: str, is_boundary: Column) -> DataFrame:
    """Tokens with ``distance`` to the nearest boundary, tokens next to one having 0; FAR without any.

    ``rows`` has tokens and boundaries in one order. Two windows, no join: of the
    tokens so far at the boundary before, and at the one after.
    """
    up_to = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    marked = rows.withColumn("_b", is_boundary)
    marked = marked.withColumn("_n", F.coalesce(F.sum((~F.col("_b")).cast("int")).over(up_to), F.lit(0)))
    at = F.when(F.col("_b"), F.col("_n"))
    back, ahead = F.col("_n") - F.last(at, True).over(up_to), F.first(at, True).over(after) - F.col("_n") - 1
    found = marked.withColumn("distance", F.coalesce(F.least(back, ahead), F.lit(FAR)))
    return found.where("NOT _b").withColumn("position", F.col("_n")).drop("_b", "_n")


def distance_gradient(positions: DataFrame, by: list[str], distance: str, is_error: Column, cap: int = 7) -> DataFrame:
    """Numbers and error rate by distance, ``cap`` and more together; empty distances are left out."""
    rows = positions.withColumn("bucket", F.least(F.col(distance), F.lit(cap)).cast("long"))
    return rows.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"), (100.0 * F.count_if(is_error) / F.count("*")).alias("error_rate"))


def extremes(pages: DataFrame, delta: str, tie: str, k: int) -> DataFrame:
    """The k largest and the k smallest differences, marked by side; pages may come twice if there are few."""
    best = pages.orderBy(F.desc(delta), tie).limit(k).withColumn("side", F.lit("best"))
    worst = pages.orderBy(F.asc(delta), tie).limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst)


def hotspots(positions: DataFrame, keys: list[str], breaks: DataFrame | None = None, begins: Column | None = None) -> DataFrame:
    """(keys, gt_index, kind, gt_token, baseline_pred, replay_pred, flag): the listing of a page.

    Rows of kind token have what both models made of it, <DEL> where it is lost, and a
    flag for each model that is wrong: B! and R!. Rows of kind break, one before the
    token that begins a system, come of ``breaks`` (keys, gt_index); a break behind the
    last token has none. Or ``begins`` tells of each position whether it begins a
    system: nothing is joined then. Rows go by (gt_index, kind), breaks first.
    """
    b, r = F.col("baseline_label") != "correct", F.col("replay_label") != "correct"
    made = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(DELETED)).alias(c)
    tokens = positions.select(*keys, "gt_index", F.lit("token").alias("kind"), "gt_token", made("baseline_pred"), made("replay_pred"), F.concat_ws(" ", F.when(b, "B!"), F.when(r, "R!")).alias("flag"))
    none = F.lit(None).cast("string")
    if begins is not None:
        shown = ("kind", "gt_token", "baseline_pred", "replay_pred", "flag")
        rows = positions.withColumn("_begins", F.coalesce(begins, F.lit(False))).select("_begins", *keys, "gt_index", F.lit("token").alias("kind"), "gt_token", made("baseline_pred"), made("replay_pred"), F.concat_ws(" ", F.when(b, "B!"), F.when(r, "R!")).alias("flag"))
        token = F.struct(*shown)
        start = F.struct(F.lit("break").alias("kind"), *(none.alias(c) for c in shown[1:4]), F.lit("").alias("flag"))
        return rows.select(*keys, "gt_index", F.inline(F.when(F.col("_begins"), F.array(start, token)).otherwise(F.array(token))))
    if breaks is None:
        return tokens
    starts = breaks.join(positions.select(*keys, "gt_index"), [*keys, "gt_index"], "left_semi")
    return tokens.unionByName(starts.select(*keys, "gt_index", F.lit("break").alias("kind"), none.alias("gt_token"), none.alias("baseline_pred"), none.alias("replay_pred"), F.lit("").alias("flag")))


#: Width of the columns of a level's listing.
WIDTHS = {"chord": 14, "kern": 18}


def hotspot_texts(listing: DataFrame, page: str = "page") -> DataFrame:
    """(page, text): listings of both levels as text, below each other; a page's rows in one ordered merge."""
    line = lambda width: F.format_string(f"%4d %-{width}s %-{width}s %-{width}s  %s", "gt_index", "gt_token", "baseline_pred", "replay_pred", "flag")
    shown = F.when(F.col("kind") == "break", "  " + "-" * 60 + "  --- linebreak ---")
    for level, width in WIDTHS.items():
        shown = shown.when(F.col("level") == level, line(width))
    rows = listing.groupBy(page, "level").agg(F.sort_array(F.collect_list(F.struct("gt_index", "kind", shown.alias("x")))).alias("rows"))
    pages = rows.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("level", "rows"))).alias("of"))
    head = lambda w: "%4s %-{0}s %-{0}s %-{0}s  flags".format(w) % ("idx", "GT", "baseline", "replay")
    lines = lambda level: F.coalesce(F.try_element_at("of", F.lit(level))["x"], F.array().cast("array<string>"))
    parts = [F.array(F.concat(F.lit("=== "), F.col(page).cast("string"), F.lit(" ===")), F.lit(""))]
    for level, width in WIDTHS.items():
        parts += [F.array(F.lit(f"{level.upper()} STREAM"), F.lit(head(width))), lines(level), *([F.array(F.lit(""))] if level == "chord" else [])]
    return pages.select(page, F.concat(F.array_join(F.concat(*parts), "\n"), F.lit("\n")).alias("text"))


def page_streams(texts: DataFrame, page: str, truth: str, models: dict[str, str], kept: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(page, kept, level, truth, <model>...) token arrays of chords and notes; dots are no chords."""
    sides = {"truth": truth, **models}
    rows = texts.select(F.col(page).alias("page"), *kept, *(streams(F.col(c)).alias(f"_{n}") for n, c in sides.items()))
    level = lambda name: F.struct(F.lit(name).alias("level"), *(F.col(f"_{n}")[name].alias(n) for n in sides))
    return rows.select("page", *kept, F.inline(F.array(level("chord"), level("kern"))))


def process_pages(texts: DataFrame, page: str = "page", truth: str = "gt_text", models: dict[str, str] | None = None, near: int = 2) -> DataFrame:
    """Positions of all pages: (page, level, gt_index, gt_token, lb_dist, begins, near_lb, <model>_label, <model>_pred, outcome).

    ``models``: columns of texts by name (baseline and replay), both aligned with the
    truth at two levels, with the distance of each token to the nearest system break.
    """
    models = models or {"baseline": "baseline_text", "replay": "replay_text"}
    # a page is cut into streams, tokens and breaks, and aligned, in one pass over its texts: nothing is joined
    rows = texts.select(F.col(page).alias("page"), aligned_levels(F.col(truth), [F.col(c) for c in models.values()], FAR).alias("_levels"))
    rows = rows.select("page", F.inline(F.array(*(F.struct(F.lit(n).alias("level"), F.col("_levels")[n].alias("_tokens")) for n in ("chord", "kern")))))
    flat = rows.select("page", "level", F.inline("_tokens")).withColumnsRenamed({f"m{k}": n for k, n in enumerate(models)})
    label = lambda n: F.when(F.col("level") == "chord", chord_error(F.col("truth"), F.col(n))).otherwise(note_error(F.col("truth"), F.col(n)))
    sides = [c for n in models for c in (label(n).alias(f"{n}_label"), F.coalesce(n, F.lit("")).alias(f"{n}_pred"))]
    out = flat.select("page", "level", F.col("position").alias("gt_index"), F.col("token").alias("gt_token"), F.col("distance").alias("lb_dist"), "begins", *sides)
    return out.withColumns({"outcome": outcome(F.col("baseline_label"), F.col("replay_label")), "near_lb": F.col("lb_dist") <= near})


def model_labels(positions: DataFrame) -> DataFrame:
    """(level, model, gt_index, gt_token, label, pred_token): positions of two models one below the other."""
    one = lambda n: F.struct(F.lit(n).alias("model"), F.col(f"{n}_label").alias("label"), F.col(f"{n}_pred").alias("pred_token"))
    return positions.select("page", "level", "gt_index", "gt_token", F.inline(F.array(one("baseline"), one("replay"))))


def shared_errors(positions: DataFrame) -> DataFrame:
    """(level, positions, both_wrong, same_pred, divergent_pred) of tokens that both models miss."""
    wrong = F.col("outcome") == "both_wrong"
    same = F.col("baseline_pred") == F.col("replay_pred")
    return positions.groupBy("level").agg(F.count("*").alias("positions"), F.count_if(wrong).alias("both_wrong"), F.count_if(wrong & same).alias("same_pred"), F.count_if(wrong & ~same).alias("divergent_pred"))


def win_report(positions: DataFrame, winner: str, cap: int = 7) -> DataFrame:
    """(level, bucket, n, errors, error_rate, only, only_rate): the loser's errors by distance to a break, ``cap`` and more together."""
    loser = {"replay": "baseline", "baseline": "replay"}[winner]
    wrong, only = F.col(f"{loser}_label") != "correct", F.col("outcome") == f"only_{loser}_wrong"
    rows = positions.withColumn("bucket", F.least("lb_dist", F.lit(cap)).cast("long"))
    share = lambda c: 100.0 * F.count_if(c) / F.count("*")
    return rows.groupBy("level", "bucket").agg(F.count("*").alias("n"), F.count_if(wrong).alias("errors"), share(wrong).alias("error_rate"), F.count_if(only).alias("only"), share(only).alias("only_rate"))


def error_types(positions: DataFrame, winner: str) -> DataFrame:
    """(level, label, count) of the loser's errors where the winner is right."""
    loser = {"replay": "baseline", "baseline": "replay"}[winner]
    return positions.where(F.col("outcome") == f"only_{loser}_wrong").groupBy("level", F.col(f"{loser}_label").alias("label")).agg(F.count("*").alias("count"))
