"""Lines, spines, tokens and systems of notation text."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import batches
from ..functions.text import let, strings, strip
from ..functions.tokens import MARKER

#: The distance to a break where there is none.
FAR = 1_000_000_000


def lines(texts: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(page_id, line_no, line, fields, kind) of each line; kind by its first characters."""
    rows = texts.select(F.col(id_col).alias("page_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("fields", F.split("line", "\t", -1)).withColumn("kind", line_kind(F.col("line")))


def line_kind(line: Column) -> Column:
    return F.when(line == "", "blank").when(line.startswith("**"), "header").when(line.startswith("*"), "interpretation").when(line.startswith("="), "bar").when(line.startswith("!"), "comment").otherwise("data")


def spines(texts: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """(page_id, spine, pos, token): data fields by the column of the spine's first header.

    ``<bos>`` and ``<eos>`` before a line are ignored; lines too short for a spine
    give it nothing. Rows are per page only: no shuffle, no order needed.
    """
    return texts.select(F.col(id_col).alias("page_id"), F.inline(spine_columns(F.col(text_col)))).select("page_id", "spine", F.posexplode("tokens").alias("pos", "token"))


def batch_spines(texts: DataFrame, id_col: str = "page_id", text_col: str = "text") -> DataFrame:
    """As ``spines``, of whole Arrow batches: for many texts."""
    return texts.select(F.col(id_col).alias("page_id"), F.inline_outer(batches.spines(F.col(text_col)))).select("page_id", "spine", F.posexplode("tokens").alias("pos", "token"))


def spine_columns(text: Column) -> Column:
    """ARRAY<STRUCT<spine, tokens>>: the data fields of each spine, by the column of its first header."""

    def columns(clean: Column) -> Column:
        headers = F.filter(clean, lambda x: x.startswith("**"))
        names = F.flatten(F.transform(headers, lambda h: F.transform(F.split(h, "\t", -1), lambda f, i: F.struct(strip(f).alias("spine"), i.alias("at")))))
        names = F.filter(names, lambda n: n["spine"].startswith("**"))
        # the first place of each name
        places = lambda ns: F.transform(F.array_distinct(F.transform(ns, lambda n: n["spine"])), lambda s: F.get(F.filter(ns, lambda n: n["spine"] == s), F.lit(0)))
        data = F.transform(F.filter(without_mark(clean, "<eos>"), lambda x: ~is_marked(x)), lambda x: F.split(x, "\t", -1))
        picked = lambda fields, n: F.filter(F.transform(fields, lambda f: F.get(f, n["at"])), lambda x: x.isNotNull())
        return let(data, lambda fields: F.transform(let(names, places), lambda n: F.struct(n["spine"].alias("spine"), picked(fields, n).alias("tokens"))))

    return let(without_mark(F.split(strip(text), "\n", -1), "<bos>"), columns)


def spine_text(text: Column, spine: str) -> Column:
    """Data fields of a spine as ``spines`` has them, lines joined; null without its header or without any field."""
    found = lambda columns: F.get(F.filter(columns, lambda c: (c["spine"] == spine) & (F.size(c["tokens"]) > 0)), F.lit(0))
    return F.array_join(let(spine_columns(text), found)["tokens"], "\n")


def without_mark(lines: Column, mark: str) -> Column:
    """Lines without a mark, and blanks after it, at their beginning."""
    return F.transform(lines, lambda x: F.when(x.startswith(mark), F.regexp_replace(x, rf"^{mark}\s*", "")).otherwise(x))


def is_marked(line: Column, marks: str = "*=!") -> Column:
    """Whether the line begins with one of these characters."""
    return F.substring(line, 1, 1).isin(*marks)


def first_spine_text(text: Column, spine: str = "**kern") -> Column:
    """Fields of one spine, lines joined; lines before its header, or too short, give their first field."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: strip(x) != "")

    def picked(rows: Column) -> Column:
        """The first field of each row; from the header on, that of its place where the row has one."""
        at = F.transform(rows, lambda f: F.array_position(F.transform(f, lambda x: x.startswith(spine)), True))
        head = lambda places: let(F.array_position(F.transform(places, lambda i: i > 0), True), lambda h: F.struct(h.alias("row"), (F.get(places, (h - 1).cast("int")) - 1).cast("int").alias("field")))
        field = lambda f, i, h: F.coalesce(F.when((h["row"] > 0) & (i >= h["row"] - 1), F.get(f, h["field"])), F.get(f, F.lit(0)))
        return let(let(at, head), lambda h: F.transform(rows, lambda f, i: field(f, i, h)))

    return F.array_join(let(F.transform(lines, lambda x: F.split(x, "\t", -1)), picked), "\n")


def chord_tokens(column_text: Column, dots: bool = True) -> Column:
    """Tokens of a chord column: with dots and without comments, or without dots and with them."""
    kept = F.transform(F.split(column_text, "\n", -1), strip)
    skip = "=*!" if dots else "=*"
    return F.filter(kept, lambda x: (x != "") & ~is_marked(x, skip) & (F.lit(dots) | (x != ".")))


def chord_column(text: Column, spine: str = "**mxhm") -> Column:
    """Data fields of a spine, lines joined; empty without its header. As ``spines``, in one column."""

    def column(lines: Column) -> Column:
        heads = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("**")), lambda x: F.array_position(F.transform(F.split(x, "\t", -1), strip), spine)), lambda i: i > 0)
        data = F.filter(without_mark(lines, "<eos>"), lambda x: ~is_marked(x))
        fields = lambda at: F.filter(F.transform(data, lambda x: F.get(F.split(x, "\t", -1), at)), lambda x: x.isNotNull())
        return let((F.get(heads, F.lit(0)) - 1).cast("int"), lambda at: F.when(at.isNotNull(), F.array_join(fields(at), "\n")).otherwise(F.lit("")))

    return F.when(text.isNotNull(), let(without_mark(F.split(strip(text), "\n", -1), "<bos>"), column)).otherwise(F.lit(""))


def last_fields(text: Column) -> Column:
    """Last field of lines of two fields or more, but for interpretations, bars and comments."""
    fields = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.split(x, "\t", -1)), lambda f: F.size(f) >= 2)
    return F.filter(F.transform(fields, lambda f: strip(F.element_at(f, -1))), lambda x: (x != "") & ~is_marked(x))


def systems(texts: DataFrame, id_col: str = "page_id", text_col: str = "text", marker: str = MARKER) -> DataFrame:
    """(page_id, block_no, lines) of the blocks between marker lines; an empty last block is dropped."""
    return texts.select(F.col(id_col).alias("page_id"), F.posexplode(system_lines(F.col(text_col), marker)).alias("block", "lines")).select("page_id", (F.col("block") + 1).alias("block_no"), "lines")


def system_lines(text: Column, marker: str = MARKER) -> Column:
    """ARRAY<ARRAY<line>> of the blocks between marker lines; an empty last block is dropped."""

    def cut(parts: Column) -> Column:
        marks = F.filter(F.transform(parts, lambda x, i: F.when(x == marker, i)), lambda i: i.isNotNull())
        edges = F.concat(F.array(F.lit(-1)), marks, F.array(F.size(parts)))
        pieces = lambda e: F.zip_with(e, F.slice(e, F.lit(2), F.size(e)), lambda a, b: F.when(b.isNotNull(), F.slice(parts, a + 2, b - a - 1)))
        return F.transform(F.filter(let(edges, pieces), lambda b: b.isNotNull()), lambda b: F.when(F.forall(b, lambda x: x == ""), strings()).otherwise(b))

    return let(let(F.split(text, "\n", -1), cut), lambda blocks: F.when(F.size(F.element_at(blocks, -1)) == 0, F.slice(blocks, F.lit(1), F.size(blocks) - 1)).otherwise(blocks))


def numbered_blocks(rows: DataFrame, keys: list[str], order: str, begins: Column) -> DataFrame:
    """Adds block_no: how many rows of the key that begin a block have come so far."""
    running = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("block_no", F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(running).cast("long"))


def is_terminator(line: Column) -> Column:
    """Whether all fields are ``*-`` or empty; blank lines are."""
    return F.forall(F.split(line, "\t", -1), lambda f: f.isin("*-", ""))


def without_header(lines: Column) -> Column:
    """Lines from the first bar on; all if there is none."""
    place = lambda x: F.array_position(F.transform(x, lambda line: line.startswith("=")), True)
    return let(lines, lambda x: F.slice(x, F.greatest(place(x), F.lit(1)).cast("int"), F.size(x)))


def without_terminator(lines: Column) -> Column:
    """Lines without those at the end whose fields are all ``*-``."""

    def kept(x: Column) -> Column:
        ends = F.reverse(F.transform(x, lambda line: F.forall(F.split(line, "\t", -1), lambda f: f == "*-")))
        trailing = F.coalesce(F.nullif(F.array_position(ends, False), F.lit(0)) - 1, F.size(x)).cast("int")
        return F.slice(x, F.lit(1), F.size(x) - trailing)

    return let(lines, kept)


def split_music_tail(lines: Column) -> Column:
    """STRUCT<music, tail>: lines up to the last that starts with a digit or a bar, and those after it."""

    def parts(x: Column) -> Column:
        hits = F.transform(x, lambda line: F.exists(F.split(line, "\t", -1), lambda f: is_marked(f, "0123456789=")))
        last = F.coalesce(F.nullif(F.size(x) - F.array_position(F.reverse(hits), True) + 1, F.size(x) + 1), F.size(x)).cast("int")
        return let(last, lambda n: F.struct(F.slice(x, F.lit(1), n).alias("music"), F.slice(x, n + 1, F.size(x)).alias("tail")))

    return let(lines, parts)


def clean_lines(text: Column) -> Column:
    """Lines without the start and end marks before them."""
    return without_mark(without_mark(F.split(strip(text), "\n", -1), "<bos>"), "<eos>")


def header_place(lines: Column, spine: str) -> Column:
    """Place of a spine (from 1) in the first header line; 0 if it is not there."""
    head = F.get(F.filter(lines, lambda x: x.startswith("**")), F.lit(0))
    return F.coalesce(F.array_position(F.transform(F.split(head, "\t", -1), strip), spine), F.lit(0)).cast("int")


def spine_tokens(text: Column, spine: str = "**kern") -> Column:
    """Tokens of a spine of the first header line, without interpretations, comment lines, bars and empty fields."""

    def picked(lines: Column) -> Column:
        rows = F.filter(lines, lambda x: let(strip(x), lambda s: (s != "") & ~is_marked(s, "*!")))
        fields = lambda at: F.transform(rows, lambda x: let(F.get(F.split(x, "\t", -1), at - 1), strip))
        return let(header_place(lines, spine), lambda at: F.when(at > 0, F.filter(fields(at), lambda f: f.isNotNull() & (f != "") & ~f.startswith("="))).otherwise(strings()))

    return F.when(text.isNotNull(), let(clean_lines(text), picked)).otherwise(strings())


def token_streams(texts: DataFrame, id_col: str = "page_id", text_col: str = "text", marker: str = "!!linebreak") -> DataFrame:
    """(page_id, level, position, token, distance) of chord and kern tokens, with the distance to the nearest system break.

    A break after the last token counts.
    """
    rows = texts.select(F.col(id_col).alias("page_id"), F.inline(level_tokens(F.col(text_col), marker)))
    return rows.select("page_id", "level", F.inline("tokens")).select("page_id", "level", "position", "token", "distance")


def level_tokens(text: Column, marker: str = "!!linebreak") -> Column:
    """ARRAY<STRUCT<level, tokens, breaks>> of a page, chord and kern; a level without its header is left out.

    ``tokens`` are STRUCT<position, token, distance, begins>, ``breaks`` the numbers of
    tokens before each break. Dots, bars and comment fields are no tokens. Distances run
    along the tokens between two breaks, so a page costs as many steps as it has lines;
    the first token behind a break ``begins`` a system.
    """
    far, kind = F.lit(FAR).cast("long"), "array<struct<position:bigint,token:string,distance:bigint,begins:boolean>>"

    def part(tokens: Column, low: Column, high: Column, first: Column, last: Column) -> Column:
        """Tokens from ``low`` to before ``high``, with a break at either end unless the page begins or ends there."""
        near = lambda n: F.coalesce(F.least(F.when(~first, n - low), F.when(~last, high - 1 - n)).cast("long"), far)
        return F.transform(F.slice(tokens, (low + 1).cast("int"), (high - low).cast("int")), lambda t, i: F.struct((low + i).cast("long").alias("position"), t.alias("token"), near(low + i).alias("distance"), (~first & (i == 0)).alias("begins")))

    def placed(items: Column) -> Column:
        tokens = F.transform(F.filter(items, lambda x: ~x["is_break"]), lambda x: x["token"])
        at = F.filter(F.transform(items, lambda x, i: F.when(x["is_break"], i)), lambda i: i.isNotNull())
        ends = lambda ts, breaks: F.zip_with(F.concat(F.array(F.lit(0)), breaks), F.concat(breaks, F.array(F.size(ts))), lambda a, b: F.struct(a.alias("low"), b.alias("high")))
        parts = lambda ts, breaks: F.transform(ends(ts, breaks), lambda e, i: part(ts, e["low"], e["high"], i == 0, i == F.size(breaks)))
        both = lambda breaks: let(tokens, lambda ts: F.struct(F.flatten(parts(ts, breaks)).cast(kind).alias("tokens"), F.array_distinct(breaks).alias("breaks")))
        return let(F.transform(at, lambda x, i: x - i), both)

    def level(rows: Column, name: str, at: Column) -> Column:
        token = lambda f: F.get(f, at - 1)
        real = lambda x: F.coalesce((x != "") & ~is_marked(x, "=!") & (F.lit(name == "kern") | (x != ".")), F.lit(False))
        items = F.transform(rows, lambda r: F.struct(r["is_break"].alias("is_break"), F.when(~r["is_break"], let(token(r["fields"]), strip)).alias("token")))
        found = placed(F.filter(items, lambda x: x["is_break"] | real(x["token"])))
        return F.when(at > 0, let(found, lambda p: F.struct(F.lit(name).alias("level"), p["tokens"].alias("tokens"), p["breaks"].alias("breaks"))))

    def both(lines: Column) -> Column:
        kept = F.filter(lines, lambda x: let(strip(x), lambda s: (s != "") & ~s.startswith("*")))
        rows = F.transform(kept, lambda x: F.struct(strip(x).startswith(marker).alias("is_break"), F.split(x, "\t", -1).alias("fields")))
        # without a header the first field is the kern field
        kern, chord = F.greatest(header_place(lines, "**kern"), F.lit(1)), header_place(lines, "**mxhm")
        return let(rows, lambda rs: let(kern, lambda k: let(chord, lambda c: F.array_compact(F.array(level(rs, "kern", k), level(rs, "chord", c))))))

    return let(clean_lines(text), both)


def music_block(text: Column, first: Column) -> Column:
    """ARRAY<line> of the music of a system's own text: of the first one all before its first break, header too; of others what lies between the first two breaks.

    Blank lines are left out; a later system without a break has no music.
    """

    def cut(lines: Column) -> Column:
        breaks = F.filter(F.transform(lines, lambda x, i: F.when(strip(x) == MARKER, i)), lambda i: i.isNotNull())
        begin = F.when(first, 0).otherwise(F.coalesce(F.get(breaks, F.lit(0)) + 1, F.size(lines)))
        end = F.coalesce(F.get(breaks, F.when(first, 0).otherwise(1)), F.size(lines))
        return F.slice(lines, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))

    return let(F.filter(F.split(text, "\n", -1), lambda x: strip(x) != ""), cut)


def system_breaks(texts: DataFrame, id_col: str = "page_id", text_col: str = "text", levels: tuple[str, ...] = ("chord",)) -> DataFrame:
    """(page_id, level, gt_index): before which token of a level a system begins; several breaks at one place count once."""
    rows = texts.select(F.col(id_col).alias("page_id"), F.inline(level_tokens(F.col(text_col)))).where(F.col("level").isin(*levels))
    return rows.select("page_id", "level", F.explode("breaks").alias("gt_index")).select("page_id", "level", F.col("gt_index").cast("int").alias("gt_index"))


def without_dots(text: Column) -> Column:
    """Every dot deleted, and lines that are blank without it."""
    return F.array_join(F.filter(F.split(F.replace(text, F.lit("."), F.lit("")), "\n", -1), lambda x: strip(x) != ""), "\n")


def paired_systems(pred: Column, truth: Column, marker: str = MARKER) -> Column:
    """ARRAY<STRUCT<pred, truth>> of the systems that both texts have."""
    a, b = (F.split(x, rf"\Q{marker}\E", -1) for x in (pred, truth))
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("pred"), F.slice(b, F.lit(1), n).alias("truth"))


def music_fields(text: Column) -> Column:
    """STRUCT<first, second, joined> of the fields of lines of two fields or more, but for the first line."""
    rows = F.filter(F.transform(F.split(text, "\n", -1), lambda x, i: F.when(i > 0, F.split(F.regexp_replace(x, r"\s+$", ""), "\t", -1))), lambda f: F.size(f) > 1)
    second = F.transform(rows, lambda f: F.get(f, F.lit(1)))
    return F.struct(F.transform(rows, lambda f: F.get(f, F.lit(0))).alias("first"), second.alias("second"), F.array_join(second, " ").alias("joined"))


def music_symbols(text: Column) -> Column:
    """ARRAY of lines: first field, <t>, and the characters of the second one up to a ``<``, which stands for <b>."""

    def symbols(line: Column) -> Column:
        fields = F.split(line, "\t", -1)
        chars = F.filter(F.split(F.get(fields, F.lit(1)), "", -1), lambda c: c != "")
        end = F.array_position(chars, "<")
        part = F.when(end > 0, F.concat(F.slice(chars, F.lit(1), F.greatest(end - 1, F.lit(0)).cast("int")), F.array(F.lit("<b>")))).otherwise(chars)
        return F.when(F.size(fields) > 1, F.concat(F.array(F.get(fields, F.lit(0)), F.lit("<t>")), part)).otherwise(strings())

    return F.transform(F.split(text, "\n", -1), symbols)
