"""Symbols of transcriptions and distances between token arrays, as Columns.

Tokens of a pair of arrays are numbered within the row and written as one
character each, so that Spark's own ``levenshtein`` measures token distance. Whole
texts are measured by ``functions.distance``.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols that stand for a line break and a tab.
BREAK, TAB = "<b>", "<t>"
#: The first of the characters that stand for tokens, and how many there are before the surrogates.
FIRST_SYMBOL, SYMBOLS = 0x4E01, 0xD7FF - 0x4E01 + 1


#: The characters of Unicode's property White_Space.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space at both ends, of any kind.

    Texts that begin and end with printed ASCII stay as they are without a search for each
    kind of white space. ``text`` is used several times: ``let`` a costly one.
    """
    plain = lambda c: (c >= "!") & (c <= "~")
    return F.when(plain(F.substring(text, 1, 1)) & plain(F.substring(text, -1, 1)), text).otherwise(F.btrim(text, F.lit(WHITE)))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strings() -> Column:
    return F.array().cast("array<string>")


def marked(text: Column) -> Column:
    """Line breaks and tabs as words of their own."""
    return F.replace(F.replace(text, F.lit("\n"), F.lit(f" {BREAK} ")), F.lit("\t"), F.lit(f" {TAB} "))


def symbol_tokens(text: Column) -> Column:
    """Blank-separated words with break and tab symbols; empty words count."""
    return F.split(marked(text), " ", -1)


def char_tokens(text: Column) -> Column:
    """Characters, but for break and tab symbols, which stay whole; blanks vanish."""
    words = F.filter(symbol_tokens(text), lambda w: w != "")
    return F.flatten(F.transform(words, lambda w: F.when(w.isin(BREAK, TAB), F.array(w)).otherwise(F.filter(F.split(w, "", -1), lambda c: c != ""))))


def line_tokens(text: Column) -> Column:
    """Lines, with tabs as words inside them."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.replace(x, F.lit("\t"), F.lit(f" {TAB} ")))


def as_symbols(tokens: Column, alphabet: Column) -> Column:
    """One character for each token: its place in the alphabet of the row.

    A row with more than ``SYMBOLS`` different tokens raises an error: characters
    would come to stand for several tokens.
    """
    place = F.when(F.size(alphabet) <= SYMBOLS, F.lit(True)).otherwise(F.raise_error(F.lit("too many different tokens in a row")).cast("boolean"))
    code = F.transform(tokens, lambda t: F.lpad(F.hex(F.lit(FIRST_SYMBOL - 1) + F.array_position(alphabet, t)), 4, "0"))
    return F.when(place, F.coalesce(F.decode(F.unhex(F.array_join(code, "")), "UTF-16BE"), F.lit("")))


def edit_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of two token arrays, with unit costs; INT."""
    measured = lambda p, q: let(F.array_distinct(F.concat(p, q)), lambda a: F.levenshtein(as_symbols(p, a), as_symbols(q, a)).cast("int"))
    return let(left, lambda p: let(right, lambda q: measured(p, q)))


def rate(errors: Column, total: Column, empty: float | None = None) -> Column:
    """100 * errors / total; ``empty`` (or null) where the total is 0."""
    share = F.try_divide(100.0 * errors, total)
    return share if empty is None else F.coalesce(share, F.lit(float(empty)))


def bag_matches(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings, nulls aside: one fold over both, sorted together."""
    side = lambda a, k: F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: F.struct(x.alias("x"), F.lit(k).alias("right")))
    met = lambda s: s["total"] + F.least(s["l"], s["r"])

    def step(s: Column, e: Column) -> Column:
        same, r = s["x"].eqNullSafe(e["x"]), e["right"]
        state = lambda n, l, m: F.struct(e["x"].alias("x"), l.alias("l"), m.alias("r"), n.alias("total"))
        return F.when(same, state(s["total"], s["l"] + 1 - r, s["r"] + r)).otherwise(state(met(s), 1 - r, r))

    none = F.struct(F.lit(None).cast("string").alias("x"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("total"))
    return F.aggregate(F.sort_array(F.concat(side(left, 0), side(right, 1))), none, step, met)


def position_matches(left: Column, right: Column) -> Column:
    """How many places of both arrays hold the same value, null excepted."""
    n = F.least(F.size(left), F.size(right))
    same = F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1), n), lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x)


def precision_recall_f1(matches: Column, predicted: Column, truth: Column) -> tuple[Column, Column, Column]:
    """Each 0 where its denominator is."""
    p = F.coalesce(F.try_divide(matches.cast("double"), predicted), F.lit(0.0))
    r = F.coalesce(F.try_divide(matches.cast("double"), truth), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2.0 * p * r, p + r), F.lit(0.0))


def bounded(value: Column, most: float = 100.0) -> Column:
    return F.least(value, F.lit(most))


def half_even(value: Column, digits: int = 0) -> Column:
    """Rounding of halves to the even neighbour."""
    return F.bround(value, digits)


def stars(p: Column) -> Column:
    """Marks of significance at .001, .01 and .05."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def slice_until(tokens: Column, *ends: str) -> Column:
    """Tokens before the first of ``ends``."""
    places = F.array_compact(F.array(*(F.nullif(F.array_position(tokens, e), F.lit(0)) for e in ends)))
    return F.slice(tokens, F.lit(1), F.coalesce(F.array_min(places) - 1, F.size(tokens)).cast("int"))


def from_where(values: Column, test) -> Column:
    """Values from the first that passes the test; all if none does."""
    place = F.array_position(F.transform(values, lambda v: F.coalesce(test(v), F.lit(False))), True)
    return F.slice(values, F.greatest(place, F.lit(1)).cast("int"), F.size(values))


def page_number(stem: Column) -> Column:
    """The number of systems in a page's name (``_n3``), or null."""
    return F.nullif(F.regexp_extract(stem, r"_n(\d+)(?:_|$)", 1), F.lit("")).cast("int")


def page_identity(path: Column) -> Column:
    """(prefix, number) of ``.../img_<number>_n...``; null if the name is another."""
    found = F.regexp_extract(path, r"(.*/)img_(\d+)_n", 2)
    return F.when(found != "", F.struct(F.regexp_extract(path, r"(.*/)img_(\d+)_n", 1).alias("prefix"), found.cast("long").alias("number")))


def tokenizer_kind(stem: Column) -> Column:
    """word, character or medium, by the last part of a checkpoint's name; medium if unknown."""
    last = F.element_at(F.split(F.lower(stem), "_"), -1)
    return F.when(last == "word", "word").when(last.isin("character", "char"), "character").otherwise("medium")
