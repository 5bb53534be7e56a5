"""Hand-derived cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from neumes.functions import chords, text, tokens


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first().y


def each(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expression(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_symbols(spark):
    texts = ["ab\tc\nd", "a\n\nb", "a  b", "", "x <b> y", "x<b>"]
    assert each(spark, texts, text.char_tokens) == [["a", "b", "<t>", "c", "<b>", "d"], ["a", "<b>", "<b>", "b"], ["a", "b"], [], ["x", "<b>", "y"], ["x", "<", "b", ">"]]
    assert each(spark, texts[:4], text.symbol_tokens) == [["ab", "<t>", "c", "<b>", "d"], ["a", "<b>", "", "<b>", "b"], ["a", "", "b"], [""]]
    assert each(spark, texts[:4], lambda c: F.size(text.line_tokens(c))) == [2, 3, 1, 1]


def test_chords(spark):
    known = {
        "C:maj7": ("C", "maj", "7", [], None, "C:maj", "C:maj7", "C:maj:7"), "G:7": ("G", "", "7", [], None, "G:maj", "G:7", "G:7"),
        "D-:min7": ("Db", "min", "7", [], None, "Db:min", "Db:min7", "Db:min:7"), "A:min7(b5)": ("A", "min", "7", ["b5"], None, "A:min", "A:min7", "A:min:7"),
        "F:maj7(9,13)": ("F", "maj", "7", ["9", "13"], None, "F:maj", "F:maj7", "F:maj:7"), "C:7/G": ("C", "", "7", [], "G", "C:maj", "C:7", "C:7"),
        "Bb:dim7": ("Bb", "dim", "7", [], None, "Bb:min", "Bb:min7", "Bb:dim:7"), "E:aug": ("E", "aug", None, [], None, None, None, "E:aug"),
        "F#:sus4": ("F#", "sus4", None, [], None, None, None, "F#:sus4"), ".": (None, None, None, [], None, None, None, None),
        "C:6": ("C", "", "6", [], None, "C:maj", "C:maj", "C:6"), "C": ("C", None, None, [], None, "C:maj", "C:maj", "C"),
    }
    rows = spark.createDataFrame([(k,) for k in known], "x string").withColumn("c", chords.parse_chord(F.col("x")))
    got = rows.select("x", "c.root", "c.quality", "c.extension", "c.modifiers", "c.bass", chords.as_major_minor(F.col("c")), chords.as_sevenths(F.col("c")), chords.as_full(F.col("c"))).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == known


def test_durations(spark):
    values = {"4c": 1, "8d": 0.5, "2e": 2, "1f": 4, "16g": 0.25, "4.a": 1.5, "4..a": 1.75, "[4b": 1, "12c": 1 / 3, "6d": 2 / 3, "8cL": 0.5, "=1": 0, "r": 0, "0c": 0, ".": 0}
    assert each(spark, list(values), chords.beats) == pytest.approx(list(values.values()))


def test_error_labels(spark):
    cases = [("C:maj7", "C:maj7", "correct"), ("C:maj7", None, "deleted"), ("C:maj7", ".", "sub_total"), ("C:maj7", "D:maj7", "sub_root"), ("C:maj7", "C:min7", "sub_qual"), ("C:maj7", "C:maj9", "sub_ext"), ("C:maj7(9)", "C:maj7", "sub_total")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p string, want string")
    assert all(r.want == r.got for r in rows.select("want", chords.chord_error(F.col("t"), F.col("p")).alias("got")).collect())
    cases = [("4c", "4c", "correct"), ("4c", None, "deleted"), ("4c", "4r", "sub_rest"), ("4c", "4d", "sub_pitch"), ("4c", "8c", "sub_duration"), ("4c", "4.c", "sub_duration"), ("4c", "4c#", "sub_accidental"), ("8cL", "8cJ", "sub_articulation"), ("4c", "4c;", "sub_other")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, p string, want string")
    assert all(r.want == r.got for r in rows.select("want", chords.note_error(F.col("t"), F.col("p")).alias("got")).collect())


def test_token_levels(spark):
    assert each(spark, ["4.cc#", ".", "*^"], tokens.split_note) == [["4", ".", "cc", "#"], ["."], ["*^"]]
    want = ["<chord-pitch>C", ":", "maj7", "(", "<chord-extension>9", ",", "#", "<chord-extension>11", ")", "/", "<chord-pitch>G"]
    assert each(spark, ["C:maj7(9,#11)/G", "D-:7", "C", "."], tokens.split_chord) == [want, ["D", "b", ":", "7"], ["<chord-pitch>C", ":", "none"], ["."]]
    page = "**kern\t**mxhm\n*clefG2\t*\n4c\tC:7\n=2\t=2\n!!linebreak:x\n8d\t."
    assert one(spark, page, lambda c: tokens.tokenize(c, "word")) == ["**kern", "<t>", "**mxhm", "<n>", "*clefG2", "<t>", "*", "<n>", "4c", "<t>", "C:7", "<n>", "=2", "<t>", "=2", "<n>", "8d", "<t>", ".", "<n>"]
    medium = one(spark, page, lambda c: tokens.tokenize(c, "medium"))
    assert medium[8:17] == ["4", "c", "<t>", "<chord-pitch>C", ":", "7", "<n>", "=2", "<t>"]
    assert one(spark, page, lambda c: tokens.detokenize(tokens.tokenize(c, "medium"))).splitlines()[2] == "4c\tC:7"
    with pytest.raises(ValueError):
        tokens.tokenize(F.col("x"), "other")


def test_small_helpers(spark):
    assert each(spark, ["img_1_n3", "img_1_n12_x", "img_1"], text.page_number) == [3, 12, None]
    assert each(spark, ["ckpt_medium", "a_word", "b_char", "c"], text.tokenizer_kind) == ["medium", "word", "character", "medium"]
    assert one(spark, "x", lambda c: text.slice_until(F.array(c, F.lit("y"), F.lit("<eos>"), F.lit("z")), "<eos>", "<pad>")) == ["x", "y"]
    assert one(spark, "x", lambda c: text.from_where(F.array(c, F.lit("=1"), F.lit("z")), lambda v: v.startswith("="))) == ["=1", "z"]
    assert [one(spark, "x", lambda c, v=v: text.half_even(F.lit(v))) for v in (2.5, 3.5)] == [2, 4]
    assert each(spark, ["a/img_7_n2.jpg", "other"], lambda c: text.page_identity(c)["number"]) == [7, None]


def test_chord_tokens_follow_the_first_signs(spark):
    """Goldens: what stands before the first colon, slash and sign decides."""
    from neumes.functions.tokens import split_chord

    p, e = "<chord-pitch>", "<chord-extension>"
    cases = {
        "C": [p + "C", ":", "none"], "C/E": [p + "C/E", ":", "none", "/", p + "E"], "C:maj/E/G": [p + "C", ":", "maj", "/", p + "E"], "A/B-:7": ["A/B", "b", ":", "7", "/", "B", "b"],
        "C:7(addb9)": [p + "C", ":", "7", "(", "b", e + "add9", ")"], "C:7(9#)": [p + "C", ":", "7", "(", "#", e + "9", ")"], "C:maj7(9,#11)/G": [p + "C", ":", "maj7", "(", e + "9", ",", "#", e + "11", ")", "/", p + "G"],
        "D-:7": ["D", "b", ":", "7"], "F#:min:x": [p + "F", "#", ":", "min"], ".": ["."], "*v": ["*v"], "C:7()": [p + "C", ":", "7", "(", e, ")"], "G:7/none": [p + "G", ":", "7"],
    }
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", split_chord(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in rows} == cases
