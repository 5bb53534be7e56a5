"""Queries over whole texts, against brute force on a small fixture."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from neumes.functions import distance as whole
from neumes.functions.text import bag_matches
from neumes.operators.metrics import with_text_errors
from neumes.plans import QUERIES

TEXTS = ["the other path " * 30 + "\nThe end, there", "", None, "e", "x" * 230 + " then\nthe seventh thing\n" + "the deep sea " * 9, "no line\nno word\n" * 40, "Là-bas, thé épais\t<b> <t>\nпуть, дальний\n\n😀 the, e", "word, " * 300 + "e" * 500]


def distance(p, q):
    row = list(range(len(q) + 1))
    for i, a in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(q, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def symbols(text, kind):
    if kind == "ler":
        return text.replace("\t", " <t> ").split("\n")
    words = text.replace("\n", " <b> ").replace("\t", " <t> ").split(" ")
    return words if kind == "ser" else [c for w in words for c in ([w] if w in ("<b>", "<t>") else w)]


def corrupted(text, model):
    """What the queries make of a text: the heavy one loses and repeats lines."""
    if model == "light":
        return text.replace("th", "t")
    lines = [x for i, line in enumerate(text.split("\n")) for x in [line] * (0 if i % 17 == 3 else 2 if i % 23 == 5 else 1)]
    return "\n".join(lines).replace("e", "").replace(", ", ",\t")


def errors(text, model, kind):
    truth = symbols(text, kind)
    return distance(symbols(corrupted(text, model), kind), truth), len(truth)


@pytest.fixture()
def folder(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_character_errors_of_whole_documents(spark, folder):
    want = {i: errors(x or "", "light", "cer") for i, x in enumerate(TEXTS)}
    assert {r.doc_id: (r.errors, r.symbols) for r in QUERIES["char_error_rate"](spark, folder).collect()} == want


def test_model_rates_of_whole_documents(spark, folder):
    got = {r.model: r for r in QUERIES["model_error_rates"](spark, folder).collect()}
    for model in ("light", "heavy"):
        assert got[model].units == len(TEXTS)
        for kind in ("cer", "ser", "ler"):
            each = [errors(x or "", model, kind) for x in TEXTS]
            rates = [100 * d / n for d, n in each if n]
            assert got[model][f"{kind}_micro"] == pytest.approx(100 * sum(d for d, _ in each) / sum(n for _, n in each), abs=1e-5)
            assert got[model][f"{kind}_macro"] == pytest.approx(sum(rates) / len(rates), abs=1e-5)


def changed(rng, text, alphabet):
    """Some pieces of a text lost, put in or exchanged."""
    out = list(text)
    for _ in range(rng.randrange(12)):
        at, n = rng.randrange(len(out) + 1), rng.randrange(6)
        out[at : at + rng.choice((0, n))] = rng.choices(alphabet, k=rng.choice((0, n)))
    return "".join(out)


@pytest.mark.parametrize("most", [0, 3000])
def test_distance_equals_the_table(monkeypatch, most):
    """By bands and by whole columns."""
    monkeypatch.setattr(whole, "WHOLE", most)
    rng = random.Random(4)
    for k in range(1500):
        alphabet = ("ab", "abc é\t\n", "a")[k % 3]
        a = "".join(rng.choices(alphabet, k=rng.choice((0, 1, 3, 20, 120))))
        b = changed(rng, a, alphabet) if k % 4 else "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert whole.distance(a, b) == whole.distance(list(b), list(a)) == distance(a, b)


def test_a_band_never_underestimates():
    rng = random.Random(5)
    for _ in range(400):
        a, b = sorted(("".join(rng.choices("abc", k=rng.randrange(1, 40))) for _ in range(2)), key=len)
        true = distance(a, b)
        for below in range(len(a) + 1):
            found = whole._within_band(a, b, below)
            assert found >= true and (found == true or true > len(b) - len(a) + 2 * below + 1)


def test_a_lost_line_is_lost_once(spark):
    lines = [f"line {k} of a text\twith a tab" for k in range(3000)]
    rows = [(1, "\n".join(lines[:5] + lines[6:]), "\n".join(lines)), (2, "\n".join(lines[:5] + ["new"] + lines[5:]), "\n".join(lines)), (3, None, "x"), (4, "", ""), (5, "a\nb", "a b")]
    got = {r.page: r for r in with_text_errors(spark.createDataFrame(rows, "page int, pred_text string, gt_text string")).collect()}
    assert got[1].ler_errors == 1 and got[1].ler_total == 3000
    assert got[1].ser_errors == len(symbols(lines[5], "ser")) + 1 and got[1].cer_errors == len(symbols(lines[5], "cer")) + 1
    assert (got[2].ler_errors, got[2].ser_errors, got[2].cer_errors) == (1, 2, 4)
    assert got[3].cer_errors is None and got[3].ler_total is None
    assert [got[4][f"{k}_{p}"] for k in ("cer", "ser", "ler") for p in ("errors", "total")] == [0, 0, 0, 1, 0, 1]
    assert (got[5].cer_errors, got[5].ser_errors, got[5].ler_errors) == (1, 1, 2)


def test_bags(spark):
    rng = random.Random(6)
    rows = [([rng.choice("abcd") if rng.random() > 0.1 else None for _ in range(rng.randrange(9))], rng.choices("abc", k=rng.randrange(9))) for _ in range(60)]
    df = spark.createDataFrame([*rows, ([], []), (["x"] * 5000, ["x"] * 4000)], "a array<string>, b array<string>")
    count = lambda x: Counter(y for y in x if y is not None)
    assert all(r.n == sum((count(r.a) & count(r.b)).values()) for r in df.select("a", "b", bag_matches(F.col("a"), F.col("b")).alias("n")).collect())


def _page(n: int, lost: int = 0) -> str:
    """A page of n notes with chords, three to a system; every ``lost``-th note is missing."""
    rows = [f"{'!!linebreak:original' + chr(10) if k and k % 3 == 0 else ''}{'=' + str(k) + chr(9) + '=' + str(k) + chr(10) if k % 3 == 0 else ''}{4 if k % 5 else 8}c\t{'CDE'[k % 3]}:maj" for k in range(n) if not lost or k % lost]
    return "**kern\t**mxhm\n*clefG2\t*\n" + "\n".join(rows) + "\n*-\t*-"


def test_long_pages_take_time_by_their_lines(spark):
    """Spines, systems, tokens and breaks of a page of 20,000 lines: nothing is looked up anew for each line."""
    import time

    from neumes.functions import tokens
    from neumes.operators import notation

    page = spark.createDataFrame([("p", _page(15_000))], "page_id string, text string")
    x = F.col("text")
    begin = time.monotonic()
    row = page.select(
        F.size(notation.spine_tokens(x)).alias("notes"), F.size(notation.chord_tokens(notation.chord_column(x))).alias("chords"), F.length(notation.first_spine_text(x)).alias("first"),
        F.size(notation.system_lines(x)).alias("systems"), F.size(tokens.token_lines(tokens.tokenize(x, "word"))).alias("lines"),
    ).first()
    assert (row.notes, row.chords, row.systems, row.lines) == (15_000, 15_000, 5_000, 20_003)
    assert notation.token_streams(page).where("distance = 0").count() == 2 * 9_998
    assert time.monotonic() - begin < 60


def test_positions_of_pages_are_found_without_a_join(spark):
    """Labels and breaks stay on the page's row: the plan has neither a join nor a shuffle."""
    from neumes.operators import forensics

    texts = spark.createDataFrame([(1, _page(7), _page(7, 3), _page(7, 4))], "page int, gt_text string, baseline_text string, replay_text string")
    out = forensics.process_pages(texts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    rows = {(r.level, r.gt_index): r for r in out.collect()}
    assert len(rows) == 14 and {i for (level, i), r in rows.items() if r.begins} == {3, 6}
    assert [rows["kern", i].lb_dist for i in range(7)] == [2, 1, 0, 0, 1, 0, 0]
    assert rows["kern", 0].baseline_label == "deleted" and rows["chord", 1].outcome == "both_correct"


def test_page_scores_without_a_join(spark):
    """Records, chord scores and spine rates of a page come from one row of it."""
    from neumes.operators import metrics

    texts = spark.createDataFrame([(1, _page(7, 3), _page(7)), (2, _page(4), _page(4)), (3, "", _page(2))], "page int, p string, t string")
    records = metrics.page_records(texts, ["page"], "p", "t")
    assert "Join" not in records._jdf.queryExecution().executedPlan().toString()
    found = {(r.page, r.metric): r.value for r in records.collect()}
    assert len(found) == 24 and found[2, "cer"] == found[2, "chord_ser"] == 0 and found[3, "chord_ser"] == 100
    assert round(found[1, "chord_ser"], 6) == round(300 / 7, 6)
    spines = metrics.spine_report(texts, ["page"], "p", "t")
    assert "Join" not in spines._jdf.queryExecution().executedPlan().toString()
    assert {(r.spine, r.ler) for r in spines.where("page = 3").collect()} >= {("**kern", 100.0), ("**mxhm", 100.0)}


def test_short_alignments_are_those_of_the_table():
    """Lists of numbers take the same way, ties included, as whole tables do; nulls equal nothing."""
    import random

    import pyarrow as pa

    from neumes.operators import alignment

    draw = random.Random(5)
    for _ in range(300):
        p, t = ([draw.randrange(3) for _ in range(draw.randrange(9))] for _ in "ab")
        assert alignment.short_steps(p, t) == alignment.steps(p, t)
        assert alignment.common_length(p, t) == alignment.common_length([*p, *[7] * 40], [*t, *[8] * 40])
    lists = [["a", None, "b"], [], None], [["b", None], ["a"], ["a", "a"]]
    (sign, pairs) = alignment.coded(*(pa.array(x, pa.list_(pa.string())) for x in lists), "b")
    pairs = list(pairs)
    assert pairs[0][0][2] == pairs[0][1][0] == sign and pairs[0][0][1] != pairs[0][1][1]
    assert [list(map(len, x)) for x in pairs] == [[3, 2], [0, 1], [0, 2]]


def test_distances_side_by_side_are_those_of_single_pairs():
    draw = random.Random(11)
    pairs = [("", ""), ("", "a" * 99), ("ab" * 40, "ab" * 40), ("\ud800a" * 60, "b\ud800" * 70)]
    for _ in range(300):
        letters = draw.choice(["ab", "abcdefghij", "abcdefghijklmnopqrstuvwxyz é😀"])
        b = "".join(draw.choices(letters, k=draw.choice([40, 50, 63, 64, 65, 128, 129, 300, 700])))
        lost = draw.choice([0.02, 0.1, 0.4])
        a = "".join(draw.choice(letters) if draw.random() < 0.1 else c for c in b if draw.random() > lost) + "".join(draw.choices(letters, k=draw.choice([0, 5, 90])))
        a = draw.choice([a, b[len(b) // 3 :] + b[: len(b) // 3], a + b])
        a, b = draw.choice([(a, b), (b, a), (list(a), list(b))])
        pairs.append((a, b))
    want = [whole.distance(a, b) for a, b in pairs]
    assert whole.distances(iter(pairs)) == want
    coded = [(whole._coded(*sorted(p, key=len)), w) for p, w in zip(pairs, want) if p[0] and p[1]]
    assert whole._side_by_side([c for c, _ in coded], [len(c[0]) for c, _ in coded]) == [w for _, w in coded]
    narrow = [min(16, len(c[0])) for c, _ in coded]
    found = whole._side_by_side([c for c, _ in coded], narrow)
    assert all(w <= f <= whole._within_band(c[0].tolist(), c[1].tolist(), low) for f, low, (c, w) in zip(found, narrow, coded))


def test_long_texts_wait_to_be_measured_together(monkeypatch):
    """Pairs held and measured in several turns keep their keys."""
    monkeypatch.setattr(whole, "HELD", 3000)
    draw = random.Random(2)
    texts = ["".join(draw.choices("abcdef", k=400)) for _ in range(60)]
    pairs = [(x, y.replace("a", "")) for x, y in zip(texts, texts[1:])]
    assert whole.distances(pairs) == [whole.distance(x, y) for x, y in pairs]
