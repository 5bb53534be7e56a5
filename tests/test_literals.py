"""Python literals read in Columns, against ``ast.literal_eval``."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from neumes.functions.literals import literal, literal_json

HARD = [
    {"systems": [{"bounding_box": {"fromX": 1, "toX": 2.5, "fromY": -3, "toY": 4}, "**kern": "**kern\t**mxhm\n*clefG2\t*\n4c\tC:maj7\n*-\t*-"}]},
    ["it's", 'say "x"', "both ' and \"", "back\\slash", "tab\there", "\\n", "end\\", "", " None True ", "a, ]", "{'a': 1,}", "é ü 音 😀", "\x00\x07\x0b\x1f\x7f\r"],
    {"None": None, "True": True, "False": False, "nested": {"a": [], "b": {}, "c": [None, [True, [False]]]}},
    (1, 2, ("a", None)), [1e10, -0.5, 1.5e-7, 0, -1, 123456789012], "just text", "None", 7, None, {}, {1: "a", -2: "b"}, [[]],
]


def plain(value):
    """As JSON has it: tuples are lists, keys text."""
    return json.loads(json.dumps(value))


def read(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.to_json(literal(F.col("t"))).alias("v"), literal(F.col("t")).isNull().alias("bad"))
    return {r.i: None if r.bad else (json.loads(r.v),) for r in rows.collect()}


def test_values_equal_those_of_the_language(spark):
    texts = [repr(x) for x in HARD] + [json.dumps(x) for x in HARD if x is not None and not isinstance(x, tuple)]
    texts += [r"'\x41é\U0001f600\101\0\a\v\q\'\"'", "['a',\n 'b' , ]", "(1, 2, )", "{'a': (1,)}", "[1., .5, -.5]", "'a\\\nb'"]
    got = read(spark, texts)
    for i, text in enumerate(texts):
        try:
            want = plain(ast.literal_eval(text))
        except ValueError:
            want = json.loads(text)
        assert got[i] == (want,), text


def test_random_values(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(6 if depth else 4)
        if kind == 0:
            return "".join(rng.choices("ab'\"\\\n\t{}[](),:é0N", k=rng.randrange(8)))
        if kind in (1, 2):
            return rng.choice((rng.randrange(-99, 99), rng.random(), True, False))
        if kind == 3:
            return None
        if kind == 4:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {value(0) if rng.random() < 0 else f"k'{k}\"": value(depth - 1) for k in range(rng.randrange(4))}

    values = [value(3) for _ in range(300)]
    got = read(spark, [repr(v) for v in values])
    assert all(got[i] == (plain(v),) for i, v in enumerate(values))


@pytest.mark.parametrize("text", ["", "not one", "{'a': ", "['a", "__import__('os')", "{'a' 1}", "[1, 2"])
def test_no_literals(spark, text):
    assert read(spark, [text])[0] is None


def test_nulls(spark):
    assert spark.createDataFrame([(None,)], "t string").select(literal_json(F.col("t")), literal(F.col("t"))).first() == (None, None)


def test_the_short_way_gives_what_the_pieces_give(spark):
    """Texts without rare signs are read at once, and as piece by piece."""
    from neumes.functions import literals

    rng = random.Random(9)
    parts = ["'a'", "'it\\'s'", '"say \\"x\\""', "'\"'", "'\\\\'", "'\\\\\\'\"'", "'\\n\\t'", "None", "True", "xNone", "(1, )", "{1: 'a', }", "-2 :", ".5", "5.", "1.5", ", ]", ",}", " : ", "[", "]", "{", "}", ", ", "''", "'$1\\\\n'", "é音😀", "'é'", "\\n", "\\x41", "'\\x41'", "\n", "\0", "'\0'", "\\", "'"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(1500)]
    pieces = F.regexp_extract_all("t", F.lit(literals._PIECES), F.lit(1))
    slow = F.when(F.length(F.array_join(pieces, "")) == F.length("t"), literals._by_pieces(pieces))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", slow.alias("want"), literal_json(F.col("t")).alias("got"), F.col("t").rlike(literals._RARE).alias("rare")).collect()
    assert all(r.want == r.got for r in rows), [r for r in rows if r.want != r.got][:3]
    assert sum(not r.rare and r.got is not None for r in rows) > 100


def test_annotations_are_read_once(spark):
    """No filter before the systems are unfolded reads the annotation as well."""
    from neumes.plans import QUERIES

    plan = QUERIES["annotation_decode"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") == 1
