"""Chord symbols and note durations as Columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strings, strip

#: What is no chord; the quality prefixes in the order of their tests; sevenths.
NO_CHORD = ("", ".", "*", "N.C.", "NC", "N.C", "rest")
QUALITIES = ("maj", "min", "m", "dim", "aug", "sus4", "sus2", "hdim")
SEVENTHS = ("7", "9", "11", "13")
ATOMS = (".", "*v", "*^", "*")


def pitch(text: Column) -> Column:
    """A letter A-G with # or b after it; null for anything else."""

    def found(text: Column) -> Column:
        letter, rest = F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30)
        has = lambda sign: F.contains(rest, F.lit(sign))
        sign = F.when(has("#"), "#").when(has("-") | has("b") | has("B"), "b").otherwise("")
        return F.when(letter.isin(*"ABCDEFG"), F.concat(letter, sign))

    return let(let(text, strip), found)


def kind_of(text: Column) -> tuple[Column, Column]:
    """(quality, extension) of a chord type; both null if it is empty or ``none``.

    Without a known prefix the quality is empty; ``m`` counts as min, and the
    extension is the first run of digits after the prefix.
    """
    kind = let(let(text, lambda x: F.lower(strip(x))), kind_parts)
    return kind["quality"], kind["extension"]


def kind_parts(text: Column) -> Column:
    """STRUCT<quality, extension> of a chord type in lower case without white space around it."""
    none = text.isNull() | text.isin("", "none")
    quality, rest = F.lit(""), text
    for q in reversed(QUALITIES):
        begins = text.startswith(q)
        quality = F.when(begins, F.lit("min" if q == "m" else q)).otherwise(quality)
        rest = F.when(begins, F.substring(text, len(q) + 1, 1 << 30)).otherwise(rest)
    digits = F.nullif(F.regexp_extract(rest, r"(\d+)", 1), F.lit(""))
    return F.struct(F.when(~none, quality).alias("quality"), F.when(~none, digits).alias("extension"))


def chord_root(text: Column) -> Column:
    """The root alone of ``parse_chord``."""
    return let(let(text, strip), lambda s: F.when(~(s.isNull() | s.isin(*NO_CHORD)), pitch(F.substring_index(F.substring_index(s, "/", 1), ":", 1))))


def parse_chord(text: Column) -> Column:
    """STRUCT<original, root, quality, extension, modifiers, bass, is_valid>.

    ``original`` is the text before ``/``. What is no chord has null parts.
    """
    return let(let(text, strip), lambda s: let(F.split(s, "/", -1), lambda parts: _parsed(s, parts)))


def _parsed(text: Column, parts: Column) -> Column:
    invalid = text.isNull() | text.isin(*NO_CHORD)
    head = F.get(parts, F.lit(0))
    kind = F.when(F.contains(head, F.lit(":")), F.substring(head, F.instr(head, F.lit(":")) + 1, F.lit(1 << 30)))
    inside = F.regexp_extract(kind, r"\(([^)]*)\)", 1)
    modifiers = F.when(F.coalesce(inside, F.lit("")) != "", F.transform(F.split(inside, ",", -1), strip)).otherwise(strings())
    root = pitch(F.substring_index(head, ":", 1))
    field = lambda value, name, kind="string": F.when(~invalid, value).cast(kind).alias(name)
    made = lambda kind, root: F.struct(
        F.when(invalid, text).otherwise(head).alias("original"), field(root, "root"), field(kind["quality"], "quality"), field(kind["extension"], "extension"),
        F.when(~invalid, modifiers).otherwise(strings()).alias("modifiers"), field(pitch(F.get(parts, F.lit(1))), "bass"), (~invalid & root.isNotNull()).alias("is_valid"),
    )
    type_ = let(let(F.substring_index(kind, "(", 1), lambda x: F.lower(strip(x))), kind_parts)
    return let(type_, lambda k: let(root, lambda r: made(k, r)))


def as_root(chord: Column) -> Column:
    return chord["root"]


def as_major_minor(chord: Column) -> Column:
    """root:maj or root:min; null for other qualities."""
    q = chord["quality"]
    side = F.when(q.isNull() | q.isin("", "maj", "dom"), "maj").when(q.isin("min", "m", "dim", "hdim"), "min")
    return F.when(chord["root"].isNotNull() & side.isNotNull(), F.concat_ws(":", chord["root"], side))


def as_sevenths(chord: Column) -> Column:
    """root:maj, maj7, 7, min or min7; null for other qualities. A half-diminished chord is always min7."""
    q, seventh = chord["quality"], F.coalesce(chord["extension"].isin(*SEVENTHS), F.lit(False))
    kind = F.when(q == "maj", F.when(seventh, "maj7").otherwise("maj")).when(q.isNull() | q.isin("", "dom"), F.when(seventh, "7").otherwise("maj"))
    kind = kind.when(q.isin("min", "m", "dim"), F.when(seventh, "min7").otherwise("min")).when(q == "hdim", "min7")
    return F.when(chord["root"].isNotNull() & kind.isNotNull(), F.concat_ws(":", chord["root"], kind))


def as_full(chord: Column) -> Column:
    """root, quality and extension as far as there are any; modifiers and bass don't count."""
    return F.when(chord["root"].isNotNull(), F.concat_ws(":", chord["root"], F.nullif(chord["quality"], F.lit("")), chord["extension"]))


VOCABULARIES = {"root": as_root, "majmin": as_major_minor, "sevenths": as_sevenths, "full": as_full}


def beats(token: Column) -> Column:
    """Quarter notes of a note token: 4/n with its dots; 0 for what has no duration."""
    bare = F.regexp_replace(strip(token), r"[\[\]LJkK]", "")
    n = F.regexp_extract(bare, r"^(\d+)", 1)
    dots = F.length(F.regexp_replace(F.regexp_replace(bare, r"^\d+", ""), r"[^.]", ""))
    value = F.try_divide(F.lit(4.0), F.nullif(n, F.lit("")).cast("double")) * (2.0 - F.pow(F.lit(2.0), -dots.cast("double")))
    return F.coalesce(F.when(bare.rlike("^[=*!]") | (bare == ""), 0.0).otherwise(value), F.lit(0.0))


def note_parts(token: Column) -> Column:
    """STRUCT<rest, meta, duration, dots, pitch, accidental, beams> of a note token, brackets aside."""
    bare = F.regexp_replace(strip(token), r"[\[\]]", "")
    part = lambda pattern, group: F.regexp_extract(bare, pattern, group)
    accidental = part(r"([#\-]+|n)", 1)
    beams = F.array_join(F.array_sort(F.filter(F.split(bare, "", -1), lambda c: c.rlike("[LJkK]"))), "")
    return F.struct(F.contains(bare, F.lit("r")).alias("rest"), bare.rlike("^[=*!.]").alias("meta"), part(r"^(\d+)(\.*)", 1).alias("duration"), part(r"^(\d+)(\.*)", 2).alias("dots"), part("([a-gA-G]+)", 1).alias("pitch"), accidental.alias("accidental"), beams.alias("beams"))


def chord_error(truth: Column, pred: Column) -> Column:
    """What differs between two chord tokens: correct, deleted, sub_root, sub_qual, sub_ext or sub_total."""
    value = lambda c: F.coalesce(c, F.lit(""))

    def kind(a: Column, b: Column) -> Column:
        return (
            F.when(~a["is_valid"] | ~b["is_valid"], "sub_total").when(~a["root"].eqNullSafe(b["root"]), "sub_root")
            .when(value(a["quality"]) != value(b["quality"]), "sub_qual").when(value(a["extension"]) != value(b["extension"]), "sub_ext").otherwise("sub_total")
        )

    # each side is parsed once: written out in every branch, the code would be too long to compile
    parsed = let(parse_chord(truth), lambda a: let(parse_chord(pred), lambda b: kind(a, b)))
    return F.when(pred.isNull(), "deleted").when(truth == pred, "correct").otherwise(parsed)


def note_error(truth: Column, pred: Column) -> Column:
    """What differs between two note tokens, by the first part that does."""
    kind = lambda a, b: (
        F.when(a["rest"] != b["rest"], "sub_rest").when(a["pitch"] != b["pitch"], "sub_pitch")
        .when((a["duration"] != b["duration"]) | (a["dots"] != b["dots"]), "sub_duration").when(a["accidental"] != b["accidental"], "sub_accidental")
        .when(a["beams"] != b["beams"], "sub_articulation").otherwise("sub_other")
    )
    parsed = let(note_parts(truth), lambda a: let(note_parts(pred), lambda b: kind(a, b)))
    return F.when(pred.isNull(), "deleted").when(truth == pred, "correct").otherwise(parsed)
