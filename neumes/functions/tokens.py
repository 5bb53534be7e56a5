"""Tokens of notation text, at word, character and medium level, and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chords import ATOMS
from .text import let, strings

#: Lines that hold one of these are dropped; prefixes of chord tokens.
RESERVED = ("!!linebreak", "!!pagebreak", "*I", "*F:", "!LO")
PITCH, EXTENSION = "<chord-pitch>", "<chord-extension>"
FIELD_END, LINE_END, SYSTEM_END, BLANK = "<t>", "<n>", "<linebreak>", "<s>"
MARKER = "!!linebreak:original"


def is_reserved(line: Column) -> Column:
    test = F.lit(False)
    for word in RESERVED:
        test = test | F.contains(line, F.lit(word))
    return test


def music_lines(text: Column) -> Column:
    """Lines without X and without reserved ones, as STRUCT<line, music>.

    ``music`` is true from the first line that starts with a digit or holds a bar (=).
    """
    kept = F.filter(F.split(F.replace(text, F.lit("X"), F.lit("")), "\n", -1), lambda x: (x != "") & ~is_reserved(x))
    begins = lambda lines: F.array_position(F.transform(lines, lambda x: F.substring(x, 1, 1).isin(*"0123456789") | F.contains(x, F.lit("="))), True)
    marked = lambda lines, at: F.transform(lines, lambda x, i: F.struct(x.alias("line"), ((at > 0) & (i >= at - 1)).alias("music")))
    return let(kept, lambda lines: let(begins(lines), lambda at: marked(lines, at)))


def split_note(field: Column) -> Column:
    """Runs of a-g letters and single other characters; atoms stay whole."""
    return F.when(field.isin(*ATOMS), F.array(field)).otherwise(F.regexp_extract_all(field, F.lit("(?s)([a-gA-G]+|[^a-gA-G])"), 1))


def split_pitch(text: Column) -> Column:
    """What stands before the first sign, and the sign; before a flat without the prefix of pitches."""
    before = lambda sign: F.substring_index(text, sign, 1)
    sharp, flat = F.array(F.concat(F.lit(PITCH), before("#")), F.lit("#")), F.array(before("-"), F.lit("b"))
    return F.when(F.contains(text, F.lit("#")), sharp).when(F.contains(text, F.lit("-")), flat).otherwise(F.array(F.concat(F.lit(PITCH), text)))


def split_extension(text: Column) -> Column:
    """A sharp or a flat, wherever it stands, and the rest."""
    apart = lambda sign: F.array(F.lit(sign), F.concat(F.lit(EXTENSION), F.replace(text, F.lit(sign), F.lit(""))))
    return F.when(F.contains(text, F.lit("#")), apart("#")).when(F.contains(text, F.lit("b")), apart("b")).otherwise(F.array(F.concat(F.lit(EXTENSION), text)))


def split_chord(field: Column) -> Column:
    """Root, colon, type, extensions in brackets and bass of a chord.

    The root is all before the first colon, the type what stands between it and the
    next colon or slash (none without a colon), the bass what follows the first slash
    up to another.
    """
    sides = F.split(field, ":", -1)
    kind = F.coalesce(F.substring_index(F.get(sides, F.lit(1)), "/", 1), F.lit("none"))
    inside = F.regexp_extract(kind, r"\(([^()]*)", 1)
    listed = joined(F.transform(F.split(inside, ",", -1), split_extension), ",")
    brackets = F.when(F.contains(kind, F.lit("(")), F.concat(F.array(F.lit("(")), listed, F.array(F.lit(")")))).otherwise(strings())
    bass = F.get(F.split(field, "/", -1), F.lit(1))
    below = F.when(bass.isNotNull() & (bass != "none"), F.concat(F.array(F.lit("/")), split_pitch(bass))).otherwise(strings())
    whole = F.concat(split_pitch(F.get(sides, F.lit(0))), F.array(F.lit(":"), F.substring_index(kind, "(", 1)), brackets, below)
    return F.when(field.isin(*ATOMS), F.array(field)).otherwise(whole)


def line_fields(line: Column) -> Column:
    return F.split(line, "\t", -1)


def joined(parts: Column, between: str) -> Column:
    """The arrays of an array, with a token between each two."""
    return F.flatten(F.transform(parts, lambda p, i: F.concat(F.when(i > 0, F.array(F.lit(between))).otherwise(strings()), p)))


def tokenize(text: Column, level: str) -> Column:
    """Tokens of a notation text; fields end in <t> but for the last, lines in <n>.

    level: word (fields), character (their characters, blanks too) or medium (notes
    and chords split, once music has begun; lines before it and bars as words).
    """
    words = lambda line: F.transform(line_fields(line), lambda f: F.array(f))
    chars = lambda line: F.transform(line_fields(line), lambda f: F.filter(F.split(f, "", -1), lambda c: c != ""))

    def medium(item: Column) -> Column:
        split = lambda fields, last: F.transform(fields, lambda f, i: F.when((last > 0) & (i == last), split_chord(f)).otherwise(split_note(f)))
        return F.when(~item["music"] | F.contains(item["line"], F.lit("=")), words(item["line"])).otherwise(let(line_fields(item["line"]), lambda fields: split(fields, F.size(fields) - 1)))

    kinds = {"word": lambda x: words(x["line"]), "character": lambda x: chars(x["line"]), "medium": medium}
    if level not in kinds:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(kinds)}")
    return F.flatten(F.transform(music_lines(text), lambda x: F.concat(joined(kinds[level](x), FIELD_END), F.array(F.lit(LINE_END)))))


def page_systems(text: Column, marker: str = MARKER) -> Column:
    """The texts between marker lines."""
    return F.split(text, rf"(?:^|\n)\Q{marker}\E(?:\n|$)", -1)


def page_tokens(text: Column, level: str, marker: str = MARKER) -> Column:
    """Tokens of each system by itself, with <linebreak> between systems."""
    return F.concat(F.array(F.lit("<bos>")), joined(F.transform(page_systems(text, marker), lambda s: tokenize(s, level)), SYSTEM_END), F.array(F.lit("<eos>")))


def token_values(marker: str = MARKER) -> tuple[tuple[str, str], ...]:
    """What stands for each mark in the text of tokens, in the order in which they are replaced."""
    return ((FIELD_END, "\t"), (LINE_END, "\n"), (SYSTEM_END, f"{marker}\n"), (BLANK, " "), (PITCH, ""), (EXTENSION, ""))


def detokenize(tokens: Column, marker: str = MARKER) -> Column:
    """The text of tokens. Not an inverse: flats stay b, reserved lines and X are gone."""
    text = F.array_join(tokens, "")
    for token, value in token_values(marker):
        text = F.replace(text, F.lit(token), F.lit(value))
    return text


def without_bar_numbers(token: Column) -> Column:
    return F.regexp_replace(token, r"(?<==)\d+", "")


def token_lines(tokens: Column) -> Column:
    """Tokens cut after each <n>."""

    def cut(ts: Column) -> Column:
        ends = F.filter(F.transform(ts, lambda t, i: F.when(t == LINE_END, i + 1)), lambda i: i.isNotNull())
        edges = F.array_distinct(F.concat(F.array(F.lit(0)), ends, F.array(F.size(ts))))
        pieces = lambda e: F.zip_with(e, F.slice(e, F.lit(2), F.size(e)), lambda a, b: F.when(b.isNotNull(), F.slice(ts, a + 1, b - a)))
        return F.when(F.size(ts) > 0, F.filter(let(edges, pieces), lambda x: x.isNotNull())).otherwise(F.array().cast("array<array<string>>"))

    return let(tokens, cut)


def music_part(tokens: Column) -> Column:
    """Tokens up to the last line with one that begins with a digit or a bar; all if there is none."""

    def kept(lines: Column) -> Column:
        hits = F.transform(lines, lambda line: F.exists(line, lambda t: F.substring(t, 1, 1).isin(*"0123456789=")))
        n = lambda after: F.when(after > 0, F.size(lines) - after + 1).otherwise(F.size(lines)).cast("int")
        return let(F.array_position(F.reverse(hits), True), lambda after: F.flatten(F.slice(lines, F.lit(1), n(after))))

    return let(token_lines(tokens), kept)


def stacked_tokens(systems: Column, n: Column) -> Column:
    """Token sequences (<bos> ... <eos>) as one: later ones from their first bar, only the n-th with what follows its music.

    Where there are fewer than n sequences, none counts as the last.
    """
    inner = F.transform(systems, lambda s: F.slice(s, F.lit(2), F.greatest(F.size(s) - 2, F.lit(0))))

    def part(s: Column, i: Column, last: Column) -> Column:
        bar = F.array_position(F.transform(s, lambda t: t.startswith("=")), True)
        body = F.when(i > 0, F.slice(s, F.greatest(bar, F.lit(1)).cast("int"), F.size(s))).otherwise(s)
        ended = let(body, lambda b: F.when(i == last - 1, b).otherwise(music_part(b)))
        return F.concat(F.when(i > 0, F.array(F.lit(SYSTEM_END))).otherwise(strings()), ended)

    return F.concat(F.array(F.lit("<bos>")), F.flatten(let(n, lambda last: F.transform(inner, lambda s, i: part(s, i, last)))), F.array(F.lit("<eos>")))
