"""Goldens, identities and brute force for the operators."""

import random

import pytest
from pyspark.sql import functions as F

from neumes.functions.text import edit_distance
from neumes.operators import alignment, assemble, boxes, compare, curriculum, forensics, intervals, metrics, notation, vocabulary
from neumes.streaming.stages import Rules, stage_trace, trace

PAGE = "**kern\t**mxhm\n*clefG2\t*\n*M4/4\t*\n=1\t=1\n4c\tC:maj7\n4d\t.\n2e\tG:7\n!!linebreak:original\n=2\t=2\n4.f\tD-:min7\n8g\t.\n2r\t.\n*-\t*-"


def test_spines_and_spans(spark):
    page = spark.createDataFrame([(1, PAGE), (2, "<bos>**kern\n4c\t9\n\n8d")], "page_id long, text string")
    rows = notation.spines(page).orderBy("page_id", "spine", "pos").collect()
    found = {}
    for r in rows:
        found.setdefault((r.page_id, r.spine), []).append(r.token)
    assert found == {(1, "**kern"): ["4c", "4d", "2e", "4.f", "8g", "2r"], (1, "**mxhm"): ["C:maj7", ".", "G:7", "D-:min7", ".", "."], (2, "**kern"): ["4c", "", "8d"]}
    from neumes.functions.chords import beats

    data = notation.lines(page.where("page_id = 1")).where("kind = 'data'").withColumn("k", F.get("fields", F.lit(0)))
    spans = intervals.spans(data, "page_id", "line_no", F.get("fields", F.lit(1)), beats(F.col("k"))).orderBy("span_no").collect()
    assert [(s.label, s.start_beat, s.duration) for s in spans] == [("C:maj7", 0, 2), ("G:7", 2, 2), ("D-:min7", 4, 4)]
    assert notation.systems(page.where("page_id = 1")).count() == 2


def test_edit_distance_agrees_with_traceback_and_brute_force(spark):
    rng = random.Random(5)
    pairs = [([rng.choice("abcde") for _ in range(rng.randrange(9))], [rng.choice("abcdf") for _ in range(rng.randrange(9))]) for _ in range(80)]

    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        return row[-1]

    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, p array<string>, t array<string>")
    out = alignment.aligned_rows(rows, "p", "t").select("i", *alignment.step_counts(F.col("aligned")), edit_distance(F.col("p"), F.col("t")).alias("d")).collect()
    for r in out:
        p, t = pairs[r.i]
        assert r.d == r.edit_distance == brute(p, t)
        assert r.n_match + r.n_substitute + r.n_delete == len(t) and r.n_match + r.n_substitute + r.n_insert == len(p)


def test_root_matches(spark):
    cases = [("C G Db A F", "C G Db A F", 5, 5, 5, 5), ("C G G A F", "C G A F", 2, 4, 4, 4), ("Bb Eb C G A F", "C G A F D E", 0, 4, 4, 4)]
    rows = spark.createDataFrame([(i, c[0].split(), c[1].split()) for i, c in enumerate(cases)], "i int, p array<string>, t array<string>")
    for r in metrics.root_scores(rows, "p", "t").collect():
        assert (r.position_matches, r.bag_matches, r.lcs_matches, r.window_matches) == cases[r.i][2:]


def test_chord_metrics(spark):
    rows = spark.createDataFrame([("a", ["C:7", ".", "G:7"], ["C:7", ".", "G:maj7"]), ("b", [], [])], "page string, p array<string>, t array<string>")
    pages = {r.page: r for r in metrics.page_chord_metrics(rows, "p", "t").collect()}
    assert pages["a"].token_ser == pytest.approx(100 / 3) and pages["a"].chord_ser == 50 and pages["a"].root_ser == 0 and pages["b"].root_ser == 100
    pooled = metrics.pooled_chord_metrics(metrics.page_chord_metrics(rows, "p", "t"), []).first()
    assert pooled.token_ser == pytest.approx(100 / 3) and pooled.chord_matches == 1
    places = metrics.position_pairs(rows, "p", "t")
    q = metrics.part_accuracy(places, "quality", ["page"]).first()
    assert (q.compared, q.equal, q.errors[0].t, q.errors[0].p) == (2, 1, "maj", "dom")
    full = metrics.full_chord_scores(places, spark.createDataFrame([("a", 2, 2)], "page string, n_pred int, n_truth int"), ["page"]).first()
    assert full.matches == 1 and full.f1 == 0.5


def test_intervals_with_themselves(spark):
    spans = spark.createDataFrame([(1, 1, "C:maj7", 0.0, 2.0), (1, 2, "G:7", 2.0, 2.0), (1, 3, "E:aug", 4.0, 1.0)], "k int, span_no long, label string, start_beat double, duration double")
    assert {r.vocabulary: r.csr for r in intervals.vocabulary_recalls(spans, spans, "k").collect()} == {"root": 100, "majmin": 100, "sevenths": 100, "full": 100}
    assert intervals.segmentation_quality(spans, spans, "k").first().quality == 100
    recall = intervals.symbol_recall(spans, spans.where("span_no = 1"), "k").first()
    assert recall.csr == pytest.approx(40.0)
    a = intervals.overlaps(spans, spans, "k").agg(F.sum("overlap")).first()[0]
    assert a == intervals.overlaps(spans, spans, "k", 1.5).agg(F.sum("overlap")).first()[0] == 5.0
    assert intervals.interval_report(spans, spans, "k").first().truth_spans == 3


def test_wilcoxon_by_enumeration():
    from itertools import product

    for n in range(1, 9):
        sums = [sum(r for r, s in zip(range(1, n + 1), signs) if s) for signs in product((0, 1), repeat=n)]
        for w in range(n * (n + 1) // 2 + 1):
            assert compare.upper_tail(n, w, 0, 50) == pytest.approx(sum(s >= w for s in sums) / 2**n)
    assert compare.upper_tail(0, 0, 0, 50) == 1 and abs(compare.upper_tail(60, 915, 0, 50) - 0.5) < 0.01


def test_significance_and_holm(spark):
    values = [(str(u), "base", m, 10.0 + u) for u in range(12) for m in ("ser", "cer")] + [(str(u), "x", "ser", 9.0 + 0.9 * u) for u in range(12)] + [(str(u), "x", "cer", 10.0 + u) for u in range(12)]
    out = {r.metric: r for r in compare.significance(spark.createDataFrame(values, "page string, model string, metric string, value double"), "page", "base", ["x"]).collect()}
    assert out["ser"].wins == 12 and out["ser"].p_raw == pytest.approx(2**-12) and out["ser"].p_adj == pytest.approx(2**-11) and out["ser"].sig == "***"
    assert out["cer"].ties == 12 and out["cer"].p_raw == 1 and out["cer"].sig == ""


def test_forensics(spark):
    rows = spark.createDataFrame([("a", ["C:7", "D:7"], ["C:7", "E:7", "D:7"])], "page string, p array<string>, t array<string>")
    base = forensics.position_labels(rows, ["page"], "p", "t", "chord")
    assert [r.label for r in base.orderBy("gt_index").collect()] == ["correct", "deleted", "correct"]
    truth = base.select("page", "gt_index", "gt_token")
    both = forensics.two_model_positions(base, base.where("gt_index = 0"), truth, ["page"])
    assert {r.gt_index: r.outcome for r in both.collect()} == {0: "both_correct", 1: "both_wrong", 2: "only_replay_wrong"}
    more = spark.createDataFrame([("a", ["x", "C:7", "y"], ["C:7"])], "page string, p array<string>, t array<string>")
    assert sorted((r.after_gt_index, r.pred_token) for r in forensics.insertions(more, ["page"], "p", "t").collect()) == [(-1, "x"), (0, "y")]
    line = spark.createDataFrame([(1, i, k) for i, k in enumerate("tt|ttt|t")], "page int, i int, k string")
    near = forensics.boundary_distance(line, ["page"], "i", F.col("k") == "|").orderBy("position").collect()
    assert [r.distance for r in near] == [1, 0, 0, 1, 0, 0]
    assert forensics.boundary_distance(line.where("k = 't'"), ["page"], "i", F.col("k") == "|").first().distance == forensics.FAR


def test_pages(spark):
    blocks = [["**kern\t**mxhm", "=1\t=1", "4c\tC:7", "*-\t*-"], ["=2\t=2", "", "4d\tD:7"]]
    rows = spark.createDataFrame([(blocks,)], "b array<array<string>>")
    pick = lambda c: rows.select(c.alias("x")).first().x
    assert pick(assemble.prefix_page(F.col("b"), F.lit(2))).split("\n") == ["**kern\t**mxhm", "=1\t=1", "4c\tC:7", "!!linebreak:original", "=2\t=2", "4d\tD:7", "*-\t*-"]
    assert pick(assemble.prefix_page(F.col("b"), F.lit(3))).endswith("!!linebreak:original")
    stacked = pick(assemble.stacked_page(F.array(F.get("b", F.lit(0)), F.get("b", F.lit(0))))).split("\n")
    assert stacked == ["**kern\t**mxhm", "=1\t=1", "4c\tC:7", "!!linebreak:original", "=1\t=1", "4c\tC:7", "*-\t*-"]
    texts = rows.select(F.transform("b", lambda b: F.array_join(b, "\n")).alias("s"))
    page = texts.select(assemble.recognised_page(F.col("s")).alias("x")).first().x.split("\n")
    assert page == ["**kern\t**mxhm", "=1\t=1", "4c\tC:7", "!!linebreak:original", "=2\t=2", "4d\tD:7", "*-\t*-"]


def test_width_pool_is_the_band(spark):
    rng = random.Random(1)
    widths = [(i, rng.choice([rng.uniform(-50, 3000), 0.5, 0.0, 1.0])) for i in range(150)]
    got = {(r.i, r.other) for r in assemble.width_pool(spark.createDataFrame(widths, "i int, w double"), "i", "w", 0.15).collect()}
    assert got == {(i, j) for i, w in widths for j, v in widths if abs(v - w) <= 0.15 * max(w, 1.0)}


def test_curriculum(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 2)], "page string, n int")
    pages = curriculum.page_maxima(rows, "page", "n")
    got = sorted((r.stage, r.page or "", r.n) for r in curriculum.eligible_prefixes(pages, [1, 2, 3, 9], 9).collect())
    assert got == [(1, "a", 1), (1, "b", 1), (2, "", 2), (2, "a", 2), (2, "b", 1), (3, "", 2), (3, "a", 3), (3, "b", 1), (9, "", 2), (9, "a", 3), (9, "b", 1)]
    pool = spark.range(50).select("id", F.lit(1).alias("stage")).union(spark.range(50, 60).select("id", F.lit(2).alias("stage")))
    epoch = curriculum.epoch(pool, 2, 0.25, "id", 42)
    assert {r.origin: r.n for r in epoch.groupBy("origin").agg(F.count("*").alias("n")).collect()} == {"current": 10, "replay": 12}
    assert curriculum.online_epoch(spark, 20, 3, 0.25).groupBy("n").count().orderBy("n").collect() == [(1, 5), (2, 5), (3, 20)]


BOX = "page_id long, box_id long, x1 int, y1 int, x2 int, y2 int"


def plain_boxes(rows, factor=1.8, least=0.6):
    """Boxes (id, x1, y1, x2, y2) of a page by the rule: duplicates, then missing ones; (id or None, x1, y1, x2, y2)."""
    import statistics

    def iou(a, b):
        hull = max(a[4], b[4]) - min(a[2], b[2])
        return max(0, min(a[4], b[4]) - max(a[2], b[2])) / hull if hull > 0 else 0.0

    center = lambda b: (b[2] + b[4]) / 2
    rest, used, keep = sorted(rows, key=lambda b: (center(b), b[0])), set(), []
    for i, head in enumerate(rest):
        if i in used:
            continue
        best = i
        for j in range(i + 1, len(rest)):
            if j not in used and iou(head, rest[j]) >= least:
                narrower = rest[j][3] - rest[j][1] < rest[best][3] - rest[best][1]
                used.add(best if narrower else j)
                best = j if narrower else best
        keep.append(rest[best])
        used.add(best)
    keep.sort(key=center)
    if len(keep) < 3:
        return keep, keep
    apart = [((b[1] - a[1]) ** 2 + (b[2] - a[2]) ** 2) ** 0.5 for a, b in zip(keep, keep[1:])]
    m, w, h = statistics.median(apart), int(statistics.median(b[3] - b[1] for b in keep)), int(statistics.median(b[4] - b[2] for b in keep))
    out = [keep[0]]
    for a, b, d in zip(keep, keep[1:], apart):
        if m > 0 and d > factor * m:
            n = max(1, round(d / m) - 1)
            for k in range(1, n + 1):
                x, y = int(a[1] + k / (n + 1) * (b[1] - a[1])), int(a[2] + k / (n + 1) * (b[2] - a[2]))
                out.append((None, x, y, x + w, y + h))
        out.append(b)
    return keep, sorted(out, key=center)


def plain_crops(found, height):
    n, out = len(found), []
    gaps = [b[2] - a[4] for a, b in zip(found, found[1:])]
    mean = sum(gaps) / len(gaps) if gaps else (found[0][4] - found[0][2]) * 0.4
    for i, b in enumerate(found):
        top = max(0, b[2] - int(mean * 0.75)) if i == 0 else found[i - 1][4] + int((b[2] - found[i - 1][4]) * 0.25)
        bottom = min(height, b[4] + int(mean * 0.25)) if i == n - 1 else b[4] + int((found[i + 1][2] - b[4]) * 0.25)
        out.append((top, bottom))
    return out


def test_boxes_of_pages(spark):
    """Duplicates, missed systems, overlapping neighbours, single boxes and equal centres, by the plain rule."""
    rng, pages = random.Random(9), {}
    for page in range(150):
        y, own = rng.randrange(40), []
        for k in range(rng.choice((1, 2, 3, 5, 9))):
            h = rng.randrange(40, 70)
            own.append((len(own), x := rng.randrange(-5, 60), y, x + rng.randrange(400, 500), y + h))
            if rng.random() < 0.3:
                own.append((len(own), x, y + rng.choice((0, 2, -2)), x + rng.randrange(300, 500), y + h + rng.choice((0, -2, 2))))
            y += rng.choice((100, 103, 110, 45, 230, 320))
        pages[page] = own
    rows = spark.createDataFrame([(p, *b) for p, own in pages.items() for b in own], BOX).withColumns({"class": F.lit("staff"), "image_height": F.lit(1500)})
    noise = rows.where("box_id = 0").withColumns({"class": F.lit("title"), "box_id": F.lit(99).cast("long")})
    kept, filled, cut = {}, {}, {}
    for r in boxes.merge_duplicates(rows).collect():
        kept.setdefault(r.page_id, set()).add(r.box_id)
    for r in boxes.segment_staves(rows.union(noise)).orderBy("page_id", "system_no").collect():
        filled.setdefault(r.page_id, []).append((r.box_id, r.x1, r.y1, r.x2, r.y2))
        cut.setdefault(r.page_id, []).append((r.crop_top, r.crop_bottom))
        assert r.inserted == (r.box_id is None) and r.y_center == (r.y1 + r.y2) / 2
    for page, own in pages.items():
        want_kept, want = plain_boxes(own)
        assert kept[page] == {b[0] for b in want_kept}
        assert filled[page] == want and cut[page] == plain_crops(want, 1500)
    assert boxes.segment_staves(noise).count() == 0


GOLDEN = [25, 19, 18, 18, 19, 18.5, 17, 18, 18]
RULES = Rules(threshold=20, patience=3, stages=2, final_patience=2)


def test_stage_machine(spark):
    steps = trace(list(enumerate(GOLDEN, 1)), RULES)
    assert [s[3] for s in steps] == [0, 0, 0, 1, 2, 0, 0, 0, 0] and [s[2] for s in steps] == [1] * 5 + [2] * 4
    assert steps[5][4] == 18.5 and steps[6][4] == 17 and [s[7] for s in steps] == [False] * 8 + [True]
    rows = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(GOLDEN, 1)], "run_id string, epoch int, val_ser double")
    assert [r.stage for r in stage_trace(rows, RULES).orderBy("epoch").collect()] == [s[2] for s in steps]


def test_vocabulary(spark):
    rows = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c"])], "i int, tokens array<string>")
    words = vocabulary.build(rows.where("i = 1"))
    assert {r.token: r.id for r in words.collect()} == {"<pad>": 0, "a": 1, "b": 2}
    ids = vocabulary.encode(rows, words, "i")
    assert {r.i: r.ids for r in ids.collect()} == {1: [2, 1, 2], 2: [0]}
    assert {r.i: r.tokens for r in vocabulary.decode(ids, words, "i").collect()} == {1: ["b", "a", "b"], 2: ["<pad>"]}
    assert {r.i: r.padded for r in vocabulary.batches(ids, "i", 2).collect()} == {1: [2, 1, 2], 2: [0, 0, 0]}
    noisy = ids.select(vocabulary.with_noise(F.col("ids"), F.col("i"), 3, 1.0).alias("x")).collect()
    assert all(len(r.x) in (1, 3) for r in noisy)


def test_streams_and_small_extractors(spark):
    page = spark.createDataFrame([(1, PAGE)], "page_id long, text string")
    pick = lambda c: page.select(c.alias("x")).first().x
    assert pick(notation.spine_tokens(F.col("text"))) == ["4c", "4d", "2e", "4.f", "8g", "2r"]
    assert pick(notation.chord_tokens(F.lit("*\nC:7\n.\n!x\n=1\n"))) == ["C:7", "."] and pick(notation.chord_tokens(F.lit("C:7\n.\n!x"), False)) == ["C:7", "!x"]
    assert pick(notation.without_dots(F.lit("4.c\t.\n.\nx"))) == "4c\t\nx"
    assert [tuple(x) for x in pick(notation.paired_systems(F.lit("a!!linebreak:originalb"), F.lit("c")))] == [("a", "c")]
    assert tuple(pick(notation.music_fields(F.lit("h\tx\na\tb \nc")))) == (["a"], ["b"], "b")
    assert pick(notation.music_symbols(F.lit("a\tbc<d\nx"))) == [["a", "<t>", "b", "c", "<b>"], []]
    assert pick(notation.last_fields(F.lit("a\tb\n*\t*\nx"))) == ["b"] and pick(notation.first_spine_text(F.lit("x\ty\n**k\t**kern\n1\t2\n3"))) == "x\n**kern\n2\n3"
    rows = notation.token_streams(page).orderBy("level", "position").collect()
    assert [(r.level, r.token, r.distance) for r in rows] == [("chord", "C:maj7", 1), ("chord", "G:7", 0), ("chord", "D-:min7", 0), ("kern", "4c", 2), ("kern", "4d", 1), ("kern", "2e", 0), ("kern", "4.f", 0), ("kern", "8g", 1), ("kern", "2r", 2)]


def test_stacked_tokens(spark):
    from neumes.functions.tokens import music_part, stacked_tokens

    s = ["<bos>", "**kern", "<n>", "=1", "<n>", "4c", "<n>", "*-", "<n>", "<eos>"]
    rows = spark.createDataFrame([([s, s],)], "s array<array<string>>")
    two = rows.select(stacked_tokens(F.col("s"), F.lit(2)).alias("x"), stacked_tokens(F.col("s"), F.lit(3)).alias("y"), music_part(F.lit([]).cast("array<string>")).alias("z")).first()
    assert two.x == s[:7] + ["<linebreak>"] + s[3:] and two.y == s[:7] + ["<linebreak>"] + s[3:7] + ["<eos>"] and two.z == []


def test_page_records(spark):
    rows = spark.createDataFrame([("a", "m", PAGE, PAGE), ("b", "m", "**kern\n4c", "**kern\n4d")], "page string, model string, pred_text string, gt_text string")
    got = {(r.page, r.metric): r.value for r in metrics.page_records(rows, ["page", "model"]).collect()}
    assert len(got) == 16 and all(got["a", m] == 0 for m in ("cer", "ser", "ler", "kern_cer", "kern_ser", "kern_ler", "chord_ser", "root_ser"))
    assert got["b", "ler"] == 50 and got["b", "chord_ser"] == 100
    none = {(r.page, r.metric): r.value for r in metrics.page_records(rows, ["page", "model"], missing=None).collect()}
    assert none["b", "root_ser"] is None and none["a", "root_ser"] == 0


def test_positional_diff_and_composition(spark):
    schema = "split string, o int, n int, text string, width int, height int"
    left = spark.createDataFrame([("t", 1, 1, "a", 5, 5), ("t", 2, 2, "b", 5, 5), ("t", 3, 3, "c", None, None), ("t", 4, 1, "d", 1, 1)], schema)
    right = spark.createDataFrame([("t", 1, 1, "x", 5, 6), ("t", 2, 1, "y", 5, 5), ("t", 3, 3, "c", 5, 5)], schema)
    assert sorted((r.row, r.kind) for r in compare.positional_diff(left, right, ["split"], "o").collect()) == [(0, "shape"), (0, "text"), (1, "n"), (2, "unreadable")]
    assert compare.size_mismatches(left, right, ["split"]).first().right_rows == 3
    t = lambda *rows: spark.createDataFrame(rows, "img string, gt string, n int")
    args = (t(("s", "s", 2), ("s9", "s9", 9)), t(("i", "i", 0)), t(("r", "r", 0)), t(("y", "y", 0)), 9)
    counts = {s: sorted((r.img, r.n) for r in assemble.split_composition(s, *args).collect()) for s in ("train", "val", "test")}
    assert counts == {"train": [("i", 1), ("r", 9), ("s", 2), ("s9", 9), ("y", 9)], "val": [("i", 1), ("r", 9), ("s", 2)], "test": [("r", 9)]}


def test_pool_sizes_count_the_band(spark):
    rng = random.Random(9)
    widths = [(i, rng.choice([rng.uniform(-50, 3000), 0.5, 0.0, 1.0, 1.1, 700.0])) for i in range(400)]
    rows = spark.createDataFrame(widths, "i int, w double")
    want = {i: sum(abs(v - w) <= 0.15 * max(w, 1.0) for _, v in widths) for i, w in widths}
    for parts in (1, 7, 256):
        assert {r.i: r.pool for r in assemble.pool_sizes(rows, "i", "w", 0.15, parts).collect()} == want


def test_hash_samples_are_the_first_in_hash_order(spark):
    import hashlib

    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(500)]
    frame = spark.createDataFrame(rows, "i int, g int")
    for share, digits in ((0.25, 1), (0.25, 4), (0.001, 2), (1.0, 4)):
        want = set()
        for g in (None, 0, 1, 2):
            own = sorted((i for i, h in rows if h == g), key=lambda i: (hashlib.md5(f"{i}:5".encode()).hexdigest(), i))
            want |= set(own[: max(1, round(share * len(own)))])
        out = curriculum.hash_sample(frame, ["g"], "i", share, 5, digits)
        assert out.columns == frame.columns and {r.i for r in out.collect()} == want


def test_split_plan(spark):
    items = spark.createDataFrame([(1, 100.0), (2, 110.0), (3, 115.0), (4, None)], "id long, w double")
    out = assemble.split_plan("val", 2, items, spark.createDataFrame([(9, 5)], "id long, w int"), "id", "w", 3, 6, 2).orderBy("position").collect()
    assert [r.position for r in out] == list(range(16)) and [r.is_synthetic for r in out] == ([False] * 6 + [True] * 2) * 2
    assert out[0].stem == "stacked_val_2_n2_00000" and out[0].img == "stacks/jpg/stacked_val_2_n2_00000.jpg" and out[15].stem == "syn_stacked_val_2_n3_00001" and out[6].members == [9, 9]
    assert all(len(r.members) == r.n for r in out) and {r.members[0] for r in out[:6]} == {1, 2, 3}


def test_draws_stay_near_in_width_but_for_small_pools(spark):
    """Members differ by the tolerance at most; an anchor with fewer than n near ones draws from all."""
    rng = random.Random(3)
    widths = {i: float(rng.choice((rng.randrange(200, 260), 60 * 2**i % 100_000))) for i in range(80)} | {100: 20.0, 101: 23.0, 102: 1_000_000.0}
    plan = assemble.stack_plan(spark.createDataFrame(list(widths.items()), "i long, w double"), "i", "w", [1, 2, 4], 200, 5).collect()
    assert len(plan) == 600
    far = 0
    for r in plan:
        anchor = widths[r.members[0]]
        near = [i for i, w in widths.items() if abs(w - anchor) / max(anchor, 1.0) <= 0.15]
        if len(near) >= r.n:
            assert set(r.members) <= set(near)
        else:
            far += any(m not in near for m in r.members)
    assert far and any(101 in r.members for r in plan if r.members[0] == 100 and r.n == 2)
    assert len({m for r in plan for m in r.members}) > 70


def test_plans_make_no_pairs(spark):
    items = spark.range(1000).selectExpr("id", "cast(id % 300 as double) as w")
    text = assemble.stack_plan(items, "id", "w", [2, 3], 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_stacks_of_texts(spark):
    head, mark = "**kern\t**mxhm\n*clefG2\t*\n", "!!linebreak:original\n"
    texts = spark.createDataFrame([(1, head + "=1\t=1\n4c\tC\n" + mark + "=2\t=2\n4d\t.\n*-\t*-\n"), (2, head + "=7\t=7\n4e\tG:7\n*-\t*-"), (3, None)], "id long, text string")
    plan = spark.createDataFrame([("a", [1, 2]), ("b", [2, 2, 1]), ("c", [2])], "stem string, members array<long>")
    got = {r.stem: r.text for r in assemble.stacked_texts(plan, texts, "id", "text").collect()}
    one, two = "=1\t=1\n4c\tC\n=2\t=2\n4d\t.\n", "=7\t=7\n4e\tG:7\n"
    assert got == {"a": head + one + mark + two + "*-\t*-", "b": head + two + mark + two + mark + one + "*-\t*-", "c": head + two + "*-\t*-"}


def test_a_split_gets_new_stacks_of_one_size(spark):
    current = spark.createDataFrame([("a", "x", 8), ("b", "y", 9), ("c", "z", 9)], "img string, gt string, n int")
    new = spark.createDataFrame([("d", "w", 9), ("e", "v", 3)], "img string, gt string, n long")
    assert sorted(tuple(r) for r in assemble.with_stacks_of(current, new, 9).collect()) == [("a", "x", 8), ("d", "w", 9)]


def test_segmentation_counts_spans_without_a_partner(spark):
    """A span that no other one meets is uncovered."""
    schema = "k int, span_no long, label string, start_beat double, duration double"
    truth = spark.createDataFrame([(1, 1, "a", 0.0, 4.0), (1, 2, "b", 4.0, 4.0)], schema)
    pred = spark.createDataFrame([(1, 1, "a", 0.0, 4.0)], schema)
    for width in (None, 1.5):
        out = intervals.segmentation_quality(truth, pred, "k", width).first()
        assert (out.over, out.under, out.quality) == (4.0, 0.0, 50.0)


def test_hotspots_list_lost_tokens_and_breaks(spark):
    base, replay = PAGE.replace("G:7", "G:9"), PAGE.replace("4d\t.\n2e\tG:7\n", "")
    texts = spark.createDataFrame([("p", PAGE, base, replay)], "page string, gt_text string, baseline_text string, replay_text string")
    breaks = notation.system_breaks(texts, "page", "gt_text").withColumnRenamed("page_id", "page")
    assert [tuple(r) for r in breaks.collect()] == [("p", "chord", 2)]
    out = forensics.hotspots(forensics.process_pages(texts), ["page", "level"], breaks)
    rows = sorted((r.level, r.gt_index, r.kind, r.gt_token or "", r.baseline_pred or "", r.replay_pred or "", r.flag) for r in out.collect())
    assert rows == [
        ("chord", 0, "token", "C:maj7", "C:maj7", "C:maj7", ""), ("chord", 1, "token", "G:7", "G:9", "<DEL>", "B! R!"), ("chord", 2, "break", "", "", "", ""), ("chord", 2, "token", "D-:min7", "D-:min7", "D-:min7", ""),
        ("kern", 0, "token", "4c", "4c", "4c", ""), ("kern", 1, "token", "4d", "4d", "<DEL>", "R!"), ("kern", 2, "token", "2e", "2e", "<DEL>", "R!"), ("kern", 3, "token", "4.f", "4.f", "4.f", ""), ("kern", 4, "token", "8g", "8g", "8g", ""), ("kern", 5, "token", "2r", "2r", "2r", ""),
    ]
    text = forensics.hotspot_texts(out).first().text.split("\n")
    assert text[:4] == ["=== p ===", "", "CHORD STREAM", " idx GT             baseline       replay          flags"] and text[4] == "   0 C:maj7         C:maj7         C:maj7          "
    assert text[6] == "  " + "-" * 60 + "  --- linebreak ---" and text[8:10] == ["", "KERN STREAM"] and text[12] == "   1 4d                 4d                 <DEL>               R!" and text[-1] == ""


def test_model_evaluation_keeps_failed_pages(spark):
    rows = spark.createDataFrame([("a", "m", "x y", "x y", None), ("b", "m", None, "x", "failed"), ("c", "n", None, "x", "failed")], "page string, model string, pred_text string, gt_text string, error string")
    got = {r.model: (r.pages, r.failed, r.cer_micro) for r in metrics.model_evaluation(rows).collect()}
    assert got == {"m": (2, 1, 0.0), "n": (1, 1, None)}
