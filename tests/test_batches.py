"""Tokens cut by whole Arrow batches, against the rules for one page as Columns."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neumes.functions import batches, tokens
from neumes.functions.chords import chord_root
from neumes.functions.text import strip
from neumes.operators import alignment, notation
from neumes.plans import QUERIES

SF = "/root/testdata/sf0.001"
LINES = ["**kern\t**mxhm", "**mxhm\t**kern", " **kern \t**mxhm ", "**dyn", "*clefG2\t*", "=1\t=1", "4c\tC:maj", "8d\t.", ".\tD:7/G", "4e", "\t", "", "  ", " 4c 　\t E:min ", "!!linebreak:original", " !!linebreak", "! note\tx", "*-\t*-", "<bos> **kern\t**mxhm", "<bos>4c\tC:7", "<eos>\n4d\tA:min", "<eos>  =2", "4f\t=A", "4g\t*x", "r\t!y", "\x0b4a\tB:7\x0c", "<bos>"]


def odd_texts(n=300):
    draw = random.Random(3)
    heads = ["**kern\t**mxhm", "**mxhm\t**kern", "<bos>**kern\t**mxhm", "4c\tC:maj", "**x\n**kern\t**mxhm"]
    return [None, "", " \n ", "**kern\t**mxhm", *("\n".join([draw.choice(heads), *draw.choices(LINES, k=draw.randint(0, 14))]) for _ in range(n))]


def test_streams_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(odd_texts())), "id long, text string")
    chords = lambda dots: F.filter(notation.chord_tokens(notation.chord_column(F.col("text"))), lambda t: F.lit(dots) | (t != "."))
    found = rows.select("text", chords(False).alias("chord"), chords(True).alias("dots"), notation.spine_tokens(F.col("text")).alias("kern"), batches.streams(F.col("text")).alias("s"), batches.chord_list(F.col("text")).alias("d")).collect()
    for r in found:
        assert (r.s.chord, r.s.kern, r.d) == (r.chord, r.kern, r.dots), repr(r.text)


def test_levels_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(odd_texts())), "id long, text string")
    got = rows.select("text", notation.level_tokens(F.col("text")).alias("want"), alignment.aligned_levels(F.col("text"), [F.col("text")], notation.FAR).alias("x")).collect()
    for r in got:
        want = {level.level: [tuple(t) for t in level.tokens or []] for level in r.want or []}
        for name in batches.LEVELS:
            assert [tuple(t)[:4] for t in r.x[name]] == want.get(name, []), (name, repr(r.text))


def test_white_space_of_any_kind_is_stripped(spark):
    texts = ["", " ", "a", "a ", "　a", "é", " é ", "\x1fa", "a\x7f", " ", "~", "!a!", "\x0bx y\x0c", None]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select("x", strip(F.col("x")).alias("y")).collect()
    assert all(r.y == (None if r.x is None else r.x.strip("\t\n\x0b\f\r \x85\xa0                　")) for r in got)


def test_pairs_aligned_together_go_the_same_way():
    draw = random.Random(7)
    some = lambda most: [draw.choice(["a", "b", "c", ".", None]) for _ in range(draw.randint(0, most))]
    pairs = [(some(n), some(n)) for n in [3] * 200 + [7] * 200 + [20] * 60 + [31, 32, 33] * 8 + [60] * 6] + [(None, ["a"]), (["a"], None), ([None], [None])]
    p, t = (pa.array(side, pa.list_(pa.string())) for side in zip(*pairs))
    numbers, (ps, ts), _ = alignment.numbers_of(p, t)
    found = alignment.places(numbers, ps, ts)
    for k, (a, b) in enumerate(pairs):
        want = [i for op, j, i in alignment.steps(a or [], b or []) if j is not None]
        assert [None if i < 0 else i for i in found[ts[k] - ts[0] : ts[k + 1] - ts[0]]] == want, (a, b)


def test_inserted_tokens_are_those_of_the_steps(spark):
    draw = random.Random(9)
    some = lambda most: [draw.choice("abc") for _ in range(draw.randint(0, most))]
    pairs = [(k, some(n), some(n)) for k, n in enumerate([3] * 100 + [8] * 100 + [40] * 10)]
    got = {r.id: [tuple(x) for x in r.new] for r in spark.createDataFrame(pairs, "id long, p array<string>, t array<string>").select("id", alignment.insertions(F.col("p"), F.col("t")).alias("new")).collect()}
    for k, p, t in pairs:
        want, after = [], -1
        for op, j, i in alignment.steps(p, t):
            after += op != "insert"
            want += [(after, i)] if op == "insert" else []
        assert got[k] == want, (p, t)


@pytest.mark.parametrize("name", ["process_pages", "insertions", "page_chord_metrics"])
def test_lines_are_cut_by_batches(spark, name):
    """No function goes through the lines of one page after another."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.replace("split(lambda", "").split("ArrowEvalPython")[-1], name



def test_first_spines_and_roots_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(odd_texts())), "id long, text string")
    found = rows.select("text", notation.first_spine_text(F.col("text")).alias("want"), batches.first_spine(F.col("text")).alias("got"), notation.chord_tokens(F.coalesce(notation.spine_text(F.col("text"), "**mxhm"), F.lit(""))).alias("tokens"), batches.chord_list(F.col("text")).alias("list"), notation.spine_tokens(F.col("text")).alias("kern"), batches.note_list(F.col("text")).alias("notes")).collect()
    for r in found:
        assert (r.got, r.list, r.notes) == (r.want, r.tokens, r.kern), repr(r.text)
    signs = ["C", "C:maj", " g# :min/B", "Bb", "b-:7", "BB:7", "", ".", "N.C.", " NC ", "H:maj", ":maj", "/G", "#", "eb#", "　f:6", "é:7", None]
    got = spark.createDataFrame([(signs,), (None,), ([],)], "t array<string>").select(F.transform("t", chord_root).alias("want"), batches.roots(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


@pytest.mark.parametrize("name", ["page_records", "spine_rates"])
def test_texts_of_pages_are_cut_by_batches(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "btrim(" not in plan, name


def test_models_are_evaluated_in_one_pass(spark):
    """Texts of both models come of one pass over the notes: lineitem is read once for each of both sides of the result's join."""
    assert QUERIES["model_evaluation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number()") <= 2


def test_characters_without_signs_are_those_of_the_words():
    from neumes.functions.distance import symbols

    for text in ["", " ", "a b", "a\tb\nc  d", "\n\n\t", "é 😀\n", "x<b>y", "a <t> b\n"]:
        words = text.replace("\n", " <b> ").replace("\t", " <t> ").split(" ")
        want = [c for w in words for c in ([w] if w in ("<b>", "<t>") else w)]
        assert [{"\U0010fffe": "<b>", "\U0010ffff": "<t>"}.get(c, c) for c in symbols(text, "cer")] == want


def test_pairs_of_spans_carry_labels_that_were_read_before(spark):
    """Labels are not read anew for each pair of spans and vocabulary, nor pairs dealt to vocabularies before they are summed up."""
    assert "zip_with" not in QUERIES["vocabulary_csr"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


FIELDS = ["", ".", "*", "*v", "4.cc#X", "8d 音😀", "C:maj7(9,#11)/G", "D-:7", "C", "A/B-:7", "C:7(addb9)", "C:7(9#)(b5)", "G:7/none", "C:7()", "::x/", "#-b", "=3", "a=b", "!LO:x", "*Ix", "*F:2", " 5", "7XX", "N.C."]


def token_texts(n=400):
    draw = random.Random(5)
    line = lambda: "\t".join(draw.choices(FIELDS, k=draw.choice([1, 2, 2, 2, 3])))
    some = lambda: [draw.choice([line(), line(), line(), "!!linebreak:original", "!!linebreak:original", "X", "!!pagebreak:x", "**kern\t**mxhm"]) for _ in range(draw.randint(0, 9))]
    ends = ["", "\n", "\r", "\n\n", " ", "\n!!linebreak:original\r", "\n!!linebreak:original"]
    return [None, "", "\n", "!!linebreak:original", *("\n".join(some()) + draw.choice(ends) for _ in range(n))]


def test_tokens_of_all_levels_are_those_of_the_rules(spark):
    rows = spark.createDataFrame(list(enumerate(token_texts())), "id long, text string")
    x, levels = F.col("text"), ("word", "character", "medium")
    want = [F.array_join(tokens.tokenize(x, n), " ").alias(n) for n in levels] + [F.array_join(tokens.page_tokens(x, "medium"), " ").alias("page")]
    got = rows.select("text", F.struct(*want).alias("w"), batches.token_texts(x).alias("g"), *(tokens.tokenize(x, n).alias(f"w_{n}") for n in levels), *(batches.tokenize(x, n).alias(f"g_{n}") for n in levels)).collect()
    for r in got:
        assert r.g == r.w, repr(r.text)
        for n in levels:
            assert r[f"g_{n}"] == r[f"w_{n}"], (n, repr(r.text))


def test_levels_and_round_trips_of_pages_are_cut_by_batches(spark):
    for name in ("token_levels", "token_round_trip"):
        assert "ArrowEvalPython" in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_spines_of_odd_texts(spark):
    texts = [*odd_texts(), "**a\t**a\t**b\n1\t2\t3\n4", "**b\t**a\n**a\t**c\n1\t2\n3", "**a\t x\t**\n\n1\t2\t3\n!c\t1\n <eos>\n<eos>5\t6"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in rows.select("text", notation.spine_columns(F.col("text")).alias("want"), batches.spines(F.col("text")).alias("got")).collect():
        assert r.got == r.want, repr(r.text)
    ordered = lambda f: sorted(map(tuple, f(rows, "id").collect()))
    assert ordered(notation.batch_spines) == ordered(notation.spines)


def test_blocks_of_pages_are_cut_once(spark):
    for name, function in (("system_pages", "inline"), ("spine_tokens_long", "ArrowEvalPython")):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert function in plan, name


def test_words_go_back_to_the_text_of_the_rules(spark):
    odd = ["a<t>b\t<n>c", "<s>\t<\tt>", "<chord-pitch>C<chord-ex<chord-pitch>tension>9\t=12=3 =x4", "a<linebreak>b\n=7\t=07", "=\t==5\n\n=٣", "<<t>n>\t<"]
    rows = spark.createDataFrame(list(enumerate([*token_texts(), *odd])), "id long, text string")
    w = tokens.tokenize(F.col("text"), "word")
    bars = F.array_join(F.transform(F.filter(w, lambda x: x.startswith("=")), tokens.without_bar_numbers), " ")
    for r in rows.select("text", F.struct(tokens.detokenize(w).alias("text"), bars.alias("bars")).alias("want"), batches.word_round_trip(F.col("text")).alias("got")).collect():
        want = None if r.text is None else r.want
        assert (r.got.text, r.got.bars) == ((None, None) if want is None else (want.text, want.bars)), repr(r.text)


def test_round_trips_make_no_lists_of_words_and_shuffle_notes_once(spark):
    plan = QUERIES["token_round_trip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "transform(" not in plan and plan.count("ArrowEvalPython") == 1
