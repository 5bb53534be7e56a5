"""Python literals (dicts, lists, strings, numbers, None) as JSON and as VARIANT, in Columns.

A literal is cut into strings and what stands between them; strings get JSON's
quotes and escapes, the rest JSON's names and brackets. Nothing is evaluated.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

_STRING = r"'(?:[^'\\\n]|\\[\s\S])*+'" + "|" + r'"(?:[^"\\\n]|\\[\s\S])*+"'
_PIECES = rf"""({_STRING}|[^'"]++)"""
#: An escape with its digits, a quote or control character, or anything else up to the next of these.
_UNITS = r"""(\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\[0-7]{1,3}|\\[\s\S]|["\x00-\x1F]|[^\\"\x00-\x1F]++)"""

#: What the short way does not read: control characters, and escapes that JSON has not.
_RARE = r"""[\x00-\x1F]|\\[^nrtbf\\'"]"""


def _hex4(code: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.hex(code), 4, "0"))


def _escape(unit: Column) -> Column:
    """One unit of a string's inside as JSON writes it."""
    second, code = F.substring(unit, 2, 1), lambda base: F.conv(F.substring(unit, 2 if base == 8 else 3, 10), base, 10).cast("long")
    pair = code(16) - 0x10000
    wide = F.when(code(16) < 0x10000, _hex4(code(16))).otherwise(F.concat(_hex4(0xD800 + F.floor(pair / 1024)), _hex4(0xDC00 + pair % 1024)))
    escaped = (
        F.when(second == "'", "'")
        .when(second.isin('"', "\\", "n", "r", "t", "b", "f"), unit)
        .when(second == "\n", "")
        .when((second == "x") & (F.length(unit) == 4), _hex4(code(16)))
        .when((second == "u") & (F.length(unit) == 6), unit)
        .when((second == "U") & (F.length(unit) == 10), wide)
        .when(second.between("0", "7"), _hex4(code(8)))
        .when(second == "a", "\\u0007")
        .when(second == "v", "\\u000B")
        .otherwise(F.concat(F.lit("\\\\"), F.substring(unit, 2, 1)))
    )
    return F.when(unit == '"', '\\"').when(unit.startswith("\\"), escaped).when(unit < " ", _hex4(F.ascii(unit))).otherwise(unit)


def _string(piece: Column) -> Column:
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(inner, F.lit(_UNITS), F.lit(1)), _escape), ""), F.lit('"'))


def _between(piece: Column) -> Column:
    """Names, brackets, commas and number keys between strings."""
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        piece = F.regexp_replace(piece, rf"\b{word}\b", json)
    piece = F.regexp_replace(piece, r"([{,]\s*)(-?\d+)(\s*:)", '$1"$2"$3')
    piece = F.regexp_replace(F.translate(piece, "()", "[]"), r",\s*([\]}])", "$1")
    return F.regexp_replace(F.regexp_replace(piece, r"(?<![\w.])\.(\d)", "0.$1"), r"(\d)\.(?![\d])", "$1.0")


def literal_json(text: Column) -> Column:
    """A Python literal as JSON text; null for null, and for text whose quotes don't close.

    JSON itself passes through. Tuples become arrays, number keys text. Not read:
    prefixed and triple-quoted strings, sets, complex numbers and single values in
    brackets; what comes of them may be no JSON, which ``literal`` gives null for.
    """
    return let(text, lambda whole: let(F.regexp_extract_all(whole, F.lit(_PIECES), F.lit(1)), lambda pieces: F.when(F.length(F.array_join(pieces, "")) == F.length(whole), F.when(whole.rlike(_RARE), _by_pieces(pieces)).otherwise(_at_once(pieces)))))


def _is_string(piece: Column) -> Column:
    return F.substring(piece, 1, 1).isin("'", '"')


def _by_pieces(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.when(_is_string(p), _string(p)).otherwise(_between(p))), "")


def _at_once(pieces: Column) -> Column:
    """As ``_by_pieces`` without rare signs: what stands between strings is read in one go, with a NUL for each string, which no rule takes for a part of anything."""
    between = _between(F.array_join(F.transform(pieces, lambda p: F.when(_is_string(p), "\0").otherwise(p)), ""))
    strings = F.concat(F.transform(F.filter(pieces, _is_string), _common_string), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(between, "\0", -1), strings, lambda b, s: F.concat(b, s)), "")


def _common_string(piece: Column) -> Column:
    """As ``_string`` where all escapes are JSON's, or those of quotes."""
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    bare = F.when(F.contains(inner, F.lit("\\")), F.regexp_replace(inner, r"""(\\[^'"])|\\(['"])""", "$1$2")).otherwise(inner)
    return F.concat(F.lit('"'), F.replace(bare, F.lit('"'), F.lit('\\"')), F.lit('"'))


def literal(text: Column) -> Column:
    """A Python literal or JSON as VARIANT; null for what is neither."""
    return F.try_parse_json(literal_json(text))
