"""Chord and note tokens, and tokens at all levels, of notation texts, of all lines of an Arrow batch at once.

The rules are those of ``operators.notation`` (``chord_column`` with ``chord_tokens``,
``spine_tokens``, ``level_tokens``) and of ``tokens`` (``tokenize``, ``page_tokens``); here each rule is one pass of Arrow over the lines
of all pages of a batch, where a Column goes through a page's lines one by one.
"""

import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chords import ATOMS, NO_CHORD
from .text import WHITE
from .tokens import EXTENSION, FIELD_END, LINE_END, MARKER, PITCH, RESERVED, SYSTEM_END, page_systems, token_values

LEVELS = ("chord", "kern")
#: Tokens of a note; what stands in the first brackets of a chord's type.
NOTE, INSIDE = re.compile(r"[a-gA-G]+|[^a-gA-G]"), re.compile(r"\(([^()]*)")
#: Any of the reserved words; the number of a bar.
ANY_RESERVED, BAR_NUMBER = "|".join(map(re.escape, RESERVED)), re.compile(r"(?<==)[0-9]+")


def strip(values: pa.Array) -> pa.Array:
    return pc.utf8_trim(values, characters=WHITE)


def starts(values: pa.Array, marks) -> np.ndarray:
    """Whether values begin with one of the marks."""
    out = np.zeros(len(values), bool)
    for mark in marks:
        out |= pc.fill_null(pc.starts_with(values, pattern=mark), False).to_numpy(zero_copy_only=False)
    return out


def holds(values: pa.Array, word: str) -> np.ndarray:
    """Whether values hold a word."""
    return pc.fill_null(pc.match_substring(values, pattern=word), False).to_numpy(zero_copy_only=False)


def filled(values: pa.Array) -> np.ndarray:
    """Whether values are neither null nor empty."""
    return pc.fill_null(pc.not_equal(values, ""), False).to_numpy(zero_copy_only=False)


def lists(values: pa.Array, row: np.ndarray, n: int) -> pa.ListArray:
    """Values, in the order of their rows, as a list for each of n rows."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


class Pages:
    """The lines of a batch of texts, without white space around the text and <bos> before a line."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        parts = pc.split_pattern(strip(texts.cast(pa.string())), pattern="\n")
        self.lines = self._without(parts.flatten(), "<bos>")
        self.row = np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
        heads = np.flatnonzero(starts(self.lines, ["**"]))
        fields, at = self._fields(self.lines.take(pa.array(heads)))
        self.heads, self.names, self.line_of = heads, strip(fields), np.repeat(np.arange(len(heads)), np.diff(at))
        self.place_of = np.arange(len(fields)) - at[self.line_of]
        # what <eos> stands before is a line too
        self.data = self._without(self.lines, "<eos>")
        self.fields, self.at = self._fields(self.data)

    @staticmethod
    def _without(lines: pa.Array, mark: str) -> pa.Array:
        return pc.replace_substring_regex(lines, pattern=rf"\A{mark}[ \t\n\x0B\f\r]*", replacement="") if starts(lines, [mark]).any() else lines

    @staticmethod
    def _fields(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All fields, and where those of each line begin."""
        split = pc.split_pattern(lines, pattern="\t")
        return split.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def places(self, spine: str, any_header: bool) -> np.ndarray:
        """Place of a spine (from 0) for each text: in the first header line, or in the first one that has it; -1 without."""
        out = np.full(self.n, -1, np.int64)
        hits = np.flatnonzero(pc.fill_null(pc.equal(self.names, spine), False).to_numpy(zero_copy_only=False))
        line, first = np.unique(self.line_of[hits], return_index=True)
        place, rows = self.place_of[hits[first]], self.row[self.heads[line]]
        if not any_header:
            _, firsts = np.unique(self.row[self.heads], return_index=True)
            own = np.isin(line, firsts)
            place, rows = place[own], rows[own]
        row, at = np.unique(rows, return_index=True)
        out[row] = place[at]
        return out

    def values(self, chosen: np.ndarray, place: np.ndarray) -> pa.Array:
        """The field of each chosen line at the place of its text, stripped; null where there is none."""
        at, want = self.at[chosen], place[self.row[chosen]]
        there = (want >= 0) & (want < self.at[chosen + 1] - at)
        return strip(self.fields.take(pa.array(np.where(there, at + want, 0), mask=~there)))

    def chords(self, dots: bool) -> pa.ListArray:
        """As ``chord_tokens`` of the ``chord_column``."""
        chosen = np.flatnonzero(~starts(self.data, "*=!"))
        found = self.values(chosen, self.places("**mxhm", True))
        kept = filled(found) & ~starts(found, "=*!")
        if not dots:
            kept &= pc.fill_null(pc.not_equal(found, "."), False).to_numpy(zero_copy_only=False)
        return lists(found.filter(pa.array(kept)), self.row[chosen[kept]], self.n)

    def notes(self) -> pa.ListArray:
        """As ``spine_tokens``."""
        bare = strip(self.data)
        chosen = np.flatnonzero(filled(bare) & ~starts(bare, "*!"))
        found = self.values(chosen, self.places("**kern", False))
        kept = filled(found) & ~starts(found, "=")
        return lists(found.filter(pa.array(kept)), self.row[chosen[kept]], self.n)

    def streams(self) -> dict[str, pa.ListArray]:
        return {"chord": self.chords(False), "kern": self.notes()}

    def level(self, name: str, marker: str, far: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As ``level_tokens``: (token, row, position, distance, begins) of the tokens of a level."""
        bare = strip(self.data)
        chosen = np.flatnonzero(filled(bare) & ~starts(bare, "*"))
        stop = starts(bare.take(pa.array(chosen)), [marker])
        place = self.places("**kern" if name == "kern" else "**mxhm", False)
        # without a header the first field is the kern field
        found = self.values(chosen, np.maximum(place, 0) if name == "kern" else place)
        real = filled(found) & ~starts(found, "=!")
        if name != "kern":
            real &= pc.fill_null(pc.not_equal(found, "."), False).to_numpy(zero_copy_only=False)
        kept = stop | real
        row, stop, found = self.row[chosen[kept]], stop[kept], found.filter(pa.array(kept))
        before = np.cumsum(~stop) - ~stop
        first = np.searchsorted(row, row)
        number = before - before[first] if len(row) else before
        places = np.arange(len(row))
        last = np.maximum.accumulate(np.where(stop, places, -1)) if len(row) else places
        after = np.minimum.accumulate(np.where(stop, places, len(row))[::-1])[::-1] if len(row) else places
        back = last >= first
        ahead = after < len(row)
        ahead[ahead] = row[after[ahead]] == row[ahead]
        low = np.where(back, number[np.maximum(last, 0)], 0) if len(row) else number
        high = np.where(ahead, number[np.minimum(after, len(row) - 1)], 0) if len(row) else number
        distance = np.minimum(np.where(back, number - low, far), np.where(ahead, high - 1 - number, far))
        t = ~stop
        return found.filter(pa.array(t)), row[t], number[t], distance[t], (back & (number == low))[t]


def streams(text: Column) -> Column:
    """STRUCT<chord, kern> of the tokens of a text; dots are no chords."""

    @F.arrow_udf("struct<chord:array<string>,kern:array<string>>")
    def run(t: pa.Array) -> pa.Array:
        made = Pages(t).streams()
        return pa.StructArray.from_arrays([made[level] for level in LEVELS], list(LEVELS))

    return run(text)


def spines(text: Column) -> Column:
    """As ``notation.spine_columns``."""
    kind = pa.struct([("spine", pa.string()), ("tokens", pa.list_(pa.string()))])

    @F.arrow_udf("array<struct<spine:string,tokens:array<string>>>")
    def run(t: pa.Array) -> pa.Array:
        pages = Pages(t)
        # the first place of each name of a page, in the order of the headers
        named = np.flatnonzero(starts(pages.names, ["**"]))
        row = pages.row[pages.heads[pages.line_of[named]]]
        names = pages.names.take(pa.array(named)).dictionary_encode()
        _, first = np.unique(row * (len(names.dictionary) + 1) + names.indices.to_numpy(zero_copy_only=False), return_index=True)
        first = np.sort(first)
        row, place, names = row[first], pages.place_of[named[first]], names.take(pa.array(first)).cast(pa.string())
        # each spine meets the data lines of its page
        data = np.flatnonzero(~starts(pages.data, "*=!"))
        ends = np.concatenate([[0], np.cumsum(np.bincount(pages.row[data], minlength=pages.n))])
        size = ends[row + 1] - ends[row]
        spine = np.repeat(np.arange(len(row)), size)
        line = data[np.repeat(ends[row], size) + np.arange(len(spine)) - np.repeat(np.cumsum(size) - size, size)]
        there = place[spine] < pages.at[line + 1] - pages.at[line]
        spine, line = spine[there], line[there]
        tokens = lists(pages.fields.take(pa.array(pages.at[line] + place[spine])), spine, len(row))
        found = pa.StructArray.from_arrays([names, tokens], fields=list(kind))
        all_ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=pages.n))])
        return pa.ListArray.from_arrays(pa.array(all_ends, pa.int32(), mask=np.append(pc.is_null(t).to_numpy(zero_copy_only=False), False)), found)

    return run(text)


def chord_list(text: Column) -> Column:
    """Chord tokens of a text, dots too."""

    @F.arrow_udf("array<string>")
    def run(t: pa.Array) -> pa.Array:
        return Pages(t).chords(True)

    return run(text)


def note_list(text: Column) -> Column:
    """Note tokens of a text."""

    @F.arrow_udf("array<string>")
    def run(t: pa.Array) -> pa.Array:
        return Pages(t).notes()

    return run(text)


def first_spine(text: Column, spine: str = "**kern") -> Column:
    """As ``notation.first_spine_text``."""

    @F.arrow_udf("string")
    def run(t: pa.Array) -> pa.Array:
        parts = pc.split_pattern(t.cast(pa.string()), pattern="\n")
        row = np.repeat(np.arange(len(t)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
        lines = parts.flatten()
        kept = filled(strip(lines))
        row = row[kept]
        split = pc.split_pattern(lines.filter(pa.array(kept)), pattern="\t")
        fields, size = split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(size) - size
        line_of = np.repeat(np.arange(len(row)), size)
        hits = np.flatnonzero(starts(fields, [spine]))
        # the first field that begins so, of each text: its line, and its place there
        page, first = np.unique(row[line_of[hits]], return_index=True)
        head, place = np.full(len(t), len(row), np.int64), np.zeros(len(t), np.int64)
        head[page], place[page] = line_of[hits[first]], hits[first] - at[line_of[hits[first]]]
        there = (np.arange(len(row)) >= head[row]) & (place[row] < size)
        found = fields.take(pa.array(at + np.where(there, place[row], 0), pa.int64()))
        joined = pc.binary_join(lists(found, row, len(t)), "\n")
        return pc.if_else(pc.is_null(t), pa.scalar(None, pa.string()), joined)

    return run(text)


def root(token: str | None) -> str | None:
    """As ``chords.chord_root``."""
    token = token.strip(WHITE) if token is not None else ""
    name = token.split("/", 1)[0].split(":", 1)[0].strip(WHITE)
    letter, rest = name[:1].upper(), name[1:]
    if token in NO_CHORD or letter not in set("ABCDEFG"):
        return None
    return letter + ("#" if "#" in rest else "b" if any(x in rest for x in "-bB") else "")


def roots(tokens: Column) -> Column:
    """The root of each chord token, null for what is no chord; each different token of a batch is read once."""

    @F.arrow_udf("array<string>")
    def run(t: pa.Array) -> pa.Array:
        values = t.flatten().cast(pa.string()).dictionary_encode()
        names = pa.array([root(x) for x in values.dictionary.to_pylist()], pa.string())
        size = pc.fill_null(pc.list_value_length(t), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(pc.is_null(t).to_numpy(zero_copy_only=False), False)), names.take(values.indices))

    return run(tokens)


def split_note(field: str) -> list[str]:
    """As ``tokens.split_note``."""
    return [field] if field in ATOMS else NOTE.findall(field)


def _split_pitch(text: str) -> list[str]:
    if "#" in text:
        return [PITCH + text.split("#", 1)[0], "#"]
    return [text.split("-", 1)[0], "b"] if "-" in text else [PITCH + text]


def _split_extension(text: str) -> list[str]:
    sign = "#" if "#" in text else "b" if "b" in text else None
    return [EXTENSION + text] if sign is None else [sign, EXTENSION + text.replace(sign, "")]


def split_chord(field: str) -> list[str]:
    """As ``tokens.split_chord``."""
    if field in ATOMS:
        return [field]
    sides, bass = field.split(":"), field.split("/")[1:2]
    kind = sides[1].split("/", 1)[0] if len(sides) > 1 else "none"
    out = [*_split_pitch(sides[0]), ":", kind.split("(", 1)[0]]
    if "(" in kind:
        out.append("(")
        for i, part in enumerate(INSIDE.search(kind)[1].split(",")):
            out += [*([","] if i else []), *_split_extension(part)]
        out.append(")")
    return [*out, "/", *_split_pitch(bass[0])] if bass and bass[0] != "none" else out


#: What becomes of a field, by level; medium takes the first three.
SPLITS = (lambda f: [f], split_note, split_chord, list)
WORD, NOTE_FIELD, CHORD_FIELD, CHARACTERS = range(4)


class Fields:
    """The fields of a batch of texts, as ``tokens.music_lines`` has their lines; each different field is cut once."""

    def __init__(self, texts: pa.Array):
        self.n, self.null = len(texts), pc.is_null(texts)
        parts = pc.split_pattern(pc.replace_substring(texts.cast(pa.string()), pattern="X", replacement=""), pattern="\n")
        lines, row = parts.flatten(), np.repeat(np.arange(self.n), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
        kept = filled(lines) & ~pc.fill_null(pc.match_substring_regex(lines, pattern=ANY_RESERVED), False).to_numpy(zero_copy_only=False)
        self.lines, self.line_row = lines.filter(pa.array(kept)), row[kept]
        split = pc.split_pattern(self.lines, pattern="\t")
        self.size = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        self.row, self.values = np.repeat(self.line_row, self.size), split.flatten().dictionary_encode()
        self.last = np.zeros(len(self.row), bool)
        self.last[np.cumsum(self.size) - 1] = True

    @cached_property
    def medium(self) -> np.ndarray:
        """How each field is cut at medium level: fields of music, but for bars; the last of several is a chord."""
        bar, row = holds(self.lines, "="), self.line_row
        begins = np.flatnonzero(bar | starts(self.lines, "0123456789"))
        first = np.full(self.n, len(row))
        page, at = np.unique(row[begins], return_index=True)
        first[page] = begins[at]
        music = (np.arange(len(row)) >= first[row]) & ~bar
        several = np.repeat(self.size > 1, self.size)
        return np.where(~np.repeat(music, self.size), WORD, np.where(self.last & several, CHORD_FIELD, NOTE_FIELD))

    def _cut(self, level: str) -> tuple[list[list[str]], pa.Array]:
        """The tokens of each different field, what follows it too, and which of them each field has."""
        how = self.medium if level == "medium" else {"word": WORD, "character": CHARACTERS}[level]
        different = len(self.values.dictionary)
        codes = (np.asarray(how) * 2 + self.last) * different + self.values.indices.to_numpy(zero_copy_only=False)
        used = np.flatnonzero(np.bincount(codes, minlength=8 * different)) if len(codes) else codes
        names, ends = self.values.dictionary.to_pylist(), ([FIELD_END], [LINE_END])
        number = np.zeros(8 * different, np.int32)
        number[used] = np.arange(len(used))
        return [SPLITS[c // different // 2](names[c % different]) + ends[c // different % 2] for c in used.tolist()], pa.array(number[codes])

    def tokens(self, level: str) -> pa.ListArray:
        """As ``tokens.tokenize``."""
        cut, number = self._cut(level)
        found = pa.array(cut, pa.list_(pa.string())).take(number)
        size = np.bincount(self.row, pc.list_value_length(found).to_numpy(zero_copy_only=False), self.n)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(self.null.to_numpy(zero_copy_only=False), False)), found.flatten())

    def text(self, level: str) -> pa.Array:
        """The tokens of a text with a blank after each, null for null."""
        cut, number = self._cut(level)
        found = pa.array([" ".join(c) + " " for c in cut], pa.string()).take(number)
        return self._joined(found, self.row, "")

    def back(self, level: str) -> pa.Array:
        """As ``tokens.detokenize`` of the tokens. No mark goes over the end of a field, so each different field is put back once."""
        cut, number = self._cut(level)
        return self._joined(pa.array([back("".join(c)) for c in cut], pa.string()).take(number), self.row, "")

    def bars(self) -> pa.Array:
        """The words that begin with a bar, without its number, with blanks between."""
        names = self.values.dictionary
        bar = starts(names, "=")
        bare = pa.array([BAR_NUMBER.sub("", x) if b else None for x, b in zip(names.to_pylist(), bar)], pa.string())
        which = self.values.indices.to_numpy(zero_copy_only=False)
        kept = bar[which]
        return self._joined(bare.take(pa.array(which[kept])), self.row[kept], " ")

    def _joined(self, values: pa.Array, row: np.ndarray, between: str) -> pa.Array:
        return pc.if_else(self.null, pa.scalar(None, pa.string()), pc.binary_join(lists(values, row, self.n), between))


def back(text: str, marker: str = MARKER) -> str:
    """As ``tokens.detokenize``, of the joined tokens."""
    for token, value in token_values(marker):
        text = text.replace(token, value)
    return text


def word_round_trip(text: Column) -> Column:
    """STRUCT<text, bars>: a text's words back to text, and those of bars without their numbers."""

    @F.arrow_udf("struct<text:string,bars:string>")
    def run(t: pa.Array) -> pa.Array:
        fields = Fields(t)
        return pa.StructArray.from_arrays([fields.back("word"), fields.bars()], ["text", "bars"])

    return run(text)


def tokenize(text: Column, level: str) -> Column:
    """As ``tokens.tokenize``."""
    if level not in ("word", "character", "medium"):
        raise ValueError(f"unknown level {level!r}; one of word, character, medium")

    @F.arrow_udf("array<string>")
    def run(t: pa.Array) -> pa.Array:
        return Fields(t).tokens(level)

    return run(text)


def token_texts(text: Column, marker: str = MARKER) -> Column:
    """STRUCT<word, character, medium, page> of a text's tokens with blanks between; page as ``tokens.page_tokens`` at medium level."""
    levels = ("word", "character", "medium")

    @F.arrow_udf("struct<" + ",".join(f"{n}:string" for n in (*levels, "page")) + ">")
    def run(t: pa.Array, systems: pa.Array) -> pa.Array:
        fields = Fields(t)
        made = [pc.utf8_slice_codeunits(x, 0, -1) for x in map(fields.text, levels)]
        size = pc.fill_null(pc.list_value_length(systems), 0).to_numpy(zero_copy_only=False)
        each = lists(Fields(systems.flatten()).text("medium"), np.repeat(np.arange(len(t)), size), len(t))
        page = pc.binary_join_element_wise("<bos> ", pc.binary_join(each, f"{SYSTEM_END} "), "<eos>", "")
        made.append(pc.if_else(pc.is_null(systems), pa.scalar(None, pa.string()), page))
        return pa.StructArray.from_arrays(made, [*levels, "page"])

    return run(text, page_systems(text, marker))
