"""Order-dependent comparisons of two token arrays, in Arrow batches.

Distances alone are Column expressions (``functions.text.edit_distance``). What is
here needs a traceback or a greedy choice: alignment, longest common subsequence,
windowed matches. Pairs are independent, so any partitioning of rows will do.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import LEVELS, Pages, lists

STEP = "struct<op:string,truth_index:int,pred_index:int>"


def numbered(left: list, right: list) -> tuple[np.ndarray, np.ndarray]:
    """Tokens as numbers; null tokens are unequal to all others."""
    seen: dict = {}
    number = lambda t, i: seen.setdefault(t, len(seen)) if t is not None else -1 - i
    return np.array([number(t, 2 * i) for i, t in enumerate(left)], np.int64), np.array([number(t, 2 * i + 1) for i, t in enumerate(right)], np.int64)


def distance_rows(pred: np.ndarray, truth: np.ndarray, above: np.ndarray, first: int):
    """The rows of prefix distances below ``above``, for tokens of ``pred`` from number ``first``; a row is one running minimum."""
    ramp = np.arange(len(truth) + 1, dtype=np.int32)
    for i, token in enumerate(pred, first + 1):
        best = np.empty(len(truth) + 1, np.int32)
        best[0] = i
        np.minimum(above[:-1] + (truth != token), above[1:] + 1, out=best[1:])
        above = np.minimum.accumulate(best - ramp) + ramp
        yield above


#: Entries of the table of distances that are held at once where it is smaller; else some rows.
TABLE = 1 << 20


def steps(pred: list, truth: list) -> list[tuple[str, int | None, int | None]]:
    """(op, truth index, pred index) from the front; of equal costs match, substitute, insert, delete in turn.

    The way back reads the table of distances from its end. Of a large table only
    every so many rows are kept; the rows between two of them are made again when
    the way gets there, up to its column only. So two sequences of n tokens take
    memory for 2 n sqrt(n) distances, and the way is the same as in the whole table.
    """
    p, t = numbered(pred, truth)
    if np.array_equal(p, t):
        return [("match", k, k) for k in range(len(p))]
    every = len(p) + 1 if (len(p) + 1) * (len(t) + 1) <= TABLE else math.isqrt(len(p)) + 1
    kept = [np.arange(len(t) + 1, dtype=np.int32)]
    if every <= len(p):
        for i, row in enumerate(distance_rows(p, t, kept[0], 0), 1):
            if i % every == 0:
                kept.append(row)
    i, j, out = len(p), len(t), []
    for block in range(len(kept) - 1, -1, -1):
        low = block * every
        if i < low or (i == low and block):
            continue  # the block ends where it begins
        table = [kept[block][: j + 1]]
        table += distance_rows(p[low:i], t[:j], table[0], low)
        while i > low or (j and not block):
            here = table[i - low][j]
            if i > low and j and p[i - 1] == t[j - 1] and here == table[i - low - 1][j - 1]:
                i, j = i - 1, j - 1
                out.append(("match", j, i))
            elif i > low and j and here == table[i - low - 1][j - 1] + 1:
                i, j = i - 1, j - 1
                out.append(("substitute", j, i))
            elif i > low and here == table[i - low - 1][j] + 1:
                i -= 1
                out.append(("insert", None, i))
            else:
                j -= 1
                out.append(("delete", j, None))
    return out[::-1]


#: Tables of so many entries are made entry by entry: arrays cost more than they save there.
SMALL = 1 << 10


def short_steps(pred: list, truth: list) -> list[tuple[str, int | None, int | None]]:
    """As ``steps``, for short sequences of numbers."""
    i, j, out = len(pred), len(truth), []
    while i and j and pred[i - 1] == truth[j - 1]:  # the way back begins with equal tokens
        i, j = i - 1, j - 1
        out.append(("match", j, i))
    above = list(range(j + 1))
    table = [above]
    for a in range(1, i + 1):
        token, left, row = pred[a - 1], a, [a]
        for b in range(1, j + 1):
            best = above[b - 1] if token == truth[b - 1] else above[b - 1] + 1
            up = above[b] + 1
            if up < best:
                best = up
            left += 1
            if left < best:
                best = left
            left = best
            row.append(best)
        table.append(row)
        above = row
    while i or j:
        here = table[i][j]
        if i and j and pred[i - 1] == truth[j - 1] and here == table[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append(("match", j, i))
        elif i and j and here == table[i - 1][j - 1] + 1:
            i, j = i - 1, j - 1
            out.append(("substitute", j, i))
        elif i and here == table[i - 1][j] + 1:
            i -= 1
            out.append(("insert", None, i))
        else:
            j -= 1
            out.append(("delete", j, None))
    return out[::-1]


def numbers_of(pred: pa.Array, truth: pa.Array):
    """(numbers, first, dictionary) of the token lists of a batch: one number for a token, negative ones for null tokens; ``first`` has where each list of either side begins, and the end."""
    sides = [a if len(a) else a.cast(pa.list_(pa.string())) for a in (pred, truth)]
    values = [s.flatten() for s in sides]
    codes = pa.chunked_array(values).combine_chunks().dictionary_encode()
    numbers = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    lost = np.flatnonzero(numbers < 0)
    numbers[lost] = -1 - lost
    firsts = [np.concatenate([[0], np.cumsum(s.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64) + at for s, at in zip(sides, (0, len(values[0])))]
    return numbers, firsts, codes.dictionary


#: Pairs of up to so many tokens a side are aligned many at once.
TOGETHER = 32


def _places_together(p: np.ndarray, t: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places in rows of ``p`` of the tokens of rows of ``t``, -1 where deleted: the way of ``steps``, of all rows at once.

    Rows are filled up at their end; ``m`` and ``n`` are their lengths.
    """
    rows, width, height = len(p), p.shape[1], t.shape[1]
    table = np.zeros((width + 1, height + 1, rows), np.int16)
    table[:, 0], table[0] = np.arange(width + 1)[:, None], np.arange(height + 1)[:, None]
    pt, tt = np.ascontiguousarray(p.T), np.ascontiguousarray(t.T)
    for i in range(1, width + 1):
        for j in range(1, height + 1):
            table[i, j] = np.minimum(np.minimum(table[i - 1, j], table[i, j - 1]) + 1, table[i - 1, j - 1] + (pt[i - 1] != tt[j - 1]))
    out, at, i, j = np.full((rows, height), -1, np.int64), np.arange(rows), m.copy(), n.copy()
    while len(at):
        i0, j0 = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        here, corner = table[i, j, at], table[i0, j0, at]
        inside = (i > 0) & (j > 0)
        both = inside & (here == corner + (pt[i0, at] != tt[j0, at]))
        insert = ~both & (i > 0) & (here == table[i0, j, at] + 1)
        out[at[both], j0[both]] = i0[both]
        i, j = i - (both | insert), j - (both | ~insert)
        on = (i > 0) & (j > 0)  # what is left of one side alone is deleted or inserted
        at, i, j = at[on], i[on], j[on]
    return out


def places(numbers: np.ndarray, p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each token of the lists of ``t``, one after the other, its place in its list of ``p``, -1 where it is deleted."""
    m, n = np.diff(p), np.diff(t)
    out = np.full(int(n.sum()), -1, np.int64)
    size = np.maximum(m, n)
    base = t[0]
    low = 0
    for high in (4, 8, 16, TOGETHER):
        chosen = np.flatnonzero((size > low) & (size <= high) & (m > 0) & (n > 0))
        low = high
        for part in np.array_split(chosen, len(chosen) * (high + 1) ** 2 // (1 << 22) + 1) if len(chosen) else ():
            a, b = m[part].max(), n[part].max()
            of = lambda first, most: numbers[np.minimum(first[part][:, None] + np.arange(most), len(numbers) - 1)]
            found = _places_together(of(p, a), of(t, b), m[part], n[part])
            there = np.arange(b) < n[part][:, None]
            out[(t[part][:, None] - base + np.arange(b))[there]] = found[there]
    for k in np.flatnonzero((size > TOGETHER) & (m > 0) & (n > 0)):
        a, b = numbers[p[k] : p[k + 1]].tolist(), numbers[t[k] : t[k + 1]].tolist()
        out[t[k] - base : t[k + 1] - base] = range(len(b)) if a == b else [-1 if i is None else i for _, j, i in way(a, b) if j is not None]
    return out


def coded(pred: pa.Array, truth: pa.Array, value: str | None = None):
    """Pairs of token lists of a batch, as lists of numbers, the same number for the same token; null tokens are unequal to all others.

    With a ``value``, its number comes first (None if it does not occur), then the pairs.
    """
    sides = [a if len(a) else a.cast(pa.list_(pa.string())) for a in (pred, truth)]
    values = [s.flatten() for s in sides]
    codes = pa.chunked_array(values).combine_chunks().dictionary_encode()
    numbers = codes.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    lost = np.flatnonzero(numbers < 0)
    numbers[lost] = -1 - lost
    numbers, cut = numbers.tolist(), len(values[0])
    lists = []
    for side, first in zip(sides, (0, cut)):
        ends = np.concatenate([[0], np.cumsum(side.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]) + first
        ends = ends.tolist()
        lists.append([numbers[a:b] for a, b in zip(ends, ends[1:])])
    if value is None:
        return zip(*lists)
    at = codes.dictionary.index(pa.scalar(value, codes.dictionary.type)).as_py()
    return (None if at < 0 else at), zip(*lists)


def way(p: list, t: list) -> list[tuple[str, int | None, int | None]]:
    """Steps of two lists of numbers."""
    if p == t:
        return [("match", k, k) for k in range(len(p))]
    return short_steps(p, t) if (len(p) + 1) * (len(t) + 1) <= SMALL else steps(p, t)


def truth_matches(pred: Column, truth: Column) -> Column:
    """ARRAY with the place in ``pred`` of what stands for each token of ``truth`` in an alignment; null if it is deleted."""

    @F.arrow_udf("array<int>")
    def run(p: pa.Array, t: pa.Array) -> pa.Array:
        numbers, (ps, ts), _ = numbers_of(p, t)
        at = places(numbers, ps, ts)
        return pa.ListArray.from_arrays(pa.array(ts - ts[0], pa.int32()), pa.array(at, pa.int32(), mask=at < 0))

    return run(pred, truth)


def aligned_levels(truth: Column, models: list[Column], far: int, marker: str = "!!linebreak") -> Column:
    """STRUCT<chord, kern> of a page's tokens with what each model made of them.

    Of each level ARRAY<STRUCT<position, token, distance, begins, truth, m0, m1...>>: tokens as
    ``level_tokens`` has them, that of the same number among the truth's stream, and the models'
    tokens (null where lost). Texts are cut and aligned by whole batches.
    """
    names = ["position", "token", "distance", "begins", "truth", *(f"m{k}" for k in range(len(models)))]
    kinds = ["int", "string", "bigint", "boolean"] + ["string"] * (1 + len(models))
    kind = "array<struct<" + ",".join(f"{n}:{k}" for n, k in zip(names, kinds)) + ">>"

    @F.arrow_udf("struct<" + ",".join(f"{level}:{kind}" for level in LEVELS) + ">")
    def run(t: pa.Array, *others: pa.Array) -> pa.Array:
        pages = Pages(t)
        made, theirs, out = pages.streams(), [Pages(m).streams() for m in others], []
        for level in LEVELS:
            token, row, number, distance, begins = pages.level(level, marker, far)
            own = made[level]
            first, size = own.offsets.to_numpy()[:-1].astype(np.int64), own.value_lengths().to_numpy(zero_copy_only=False)
            there = number < size[row]
            at = np.where(there, first[row] + number, 0)
            columns = [pa.array(number, pa.int32()), token, pa.array(distance, pa.int64()), pa.array(begins), own.values.take(pa.array(at, mask=~there))]
            for side in theirs:
                numbers, (ps, ts), _ = numbers_of(side[level], own)
                found = places(numbers, ps, ts)
                got = np.where(there, found[at], -1) if len(found) else np.full(len(at), -1)
                columns.append(side[level].values.take(pa.array(np.where(got >= 0, ps[row] + got, 0), mask=got < 0)))
            out.append(lists(pa.StructArray.from_arrays(columns, names), row, len(t)))
        return pa.StructArray.from_arrays(out, list(LEVELS))

    return run(truth, *models)


def insertions(pred: Column, truth: Column) -> Column:
    """ARRAY<STRUCT<after_gt_index, at>>: places in ``pred`` of tokens that stand for none of ``truth``, and the truth token before them, -1 before the first.

    Between two tokens that stand for each other an alignment of least cost inserts or deletes, never both.
    """

    @F.arrow_udf("array<struct<after_gt_index:int,at:int>>")
    def run(p: pa.Array, t: pa.Array) -> pa.Array:
        numbers, (ps, ts), _ = numbers_of(p, t)
        found, m, n = places(numbers, ps, ts), np.diff(ps), np.diff(ts)
        row = np.repeat(np.arange(len(m)), m)
        after = np.full(len(row), -1, np.int64)
        met = found >= 0
        index = np.arange(len(found)) - np.repeat(ts[:-1] - ts[0], n)
        after[(ps[np.repeat(np.arange(len(n)), n)] + found)[met]] = index[met]
        new = after < 0
        # tokens grow along a page: the largest so far is the last, if the page's own
        offset = row * (int(n.max(initial=0)) + 1)
        last = np.maximum.accumulate(after + 1 + offset) - offset - 1 if len(row) else after
        at = np.arange(len(row)) - ps[row]
        rows = pa.StructArray.from_arrays([pa.array(last[new], pa.int32()), pa.array(at[new], pa.int32())], ["after_gt_index", "at"])
        return lists(rows, row[new], len(m))

    return run(pred, truth)


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    if (len(a) + 1) * (len(b) + 1) <= SMALL:
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                above = row[j]
                row[j] = before + 1 if x == y and x is not None else above if above > row[j - 1] else row[j - 1]
                before = above
        return row[-1]
    p, t = numbered(a, b)
    row = np.zeros(len(t) + 1, np.int32)
    for token in p:
        new = row.copy()
        np.maximum(new[1:], row[:-1] + (t == token), out=new[1:])
        row = np.maximum.accumulate(new)
    return int(row[-1])


def window_count(pred: list, truth: list, reach: int) -> int:
    """Pairs of equal tokens at most ``reach`` apart: each truth token takes the nearest free one, earlier before later."""
    taken: set[int] = set()
    shifts = sorted(range(-reach, reach + 1), key=lambda d: (abs(d), d))
    for i, token in enumerate(truth):
        free = (i + d for d in shifts if 0 <= i + d < len(pred) and i + d not in taken)
        taken.update([k for k in free if token is not None and pred[k] == token][:1])
    return len(taken)


def alignment(pred: Column, truth: Column) -> Column:
    """ARRAY of steps that turn ``truth`` into ``pred`` at the least cost."""

    @F.arrow_udf(f"array<{STEP}>")
    def run(p: pa.Array, t: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("op", pa.string()), ("truth_index", pa.int32()), ("pred_index", pa.int32())]))
        return pa.array([[{"op": o, "truth_index": j, "pred_index": i} for o, j, i in way(a, b)] for a, b in coded(p, t)], kind)

    return run(pred, truth)


def common_subsequence(a: Column, b: Column) -> Column:
    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([common_length(p, q) for p, q in coded(x, y)], pa.int32())

    return run(a, b)


def windowed_matches(pred: Column, truth: Column, reach: int = 3) -> Column:
    @F.arrow_udf("int")
    def run(p: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([window_count(a, b, reach) for a, b in coded(p, t)], pa.int32())

    return run(pred, truth)


def step_counts(aligned: Column) -> list[Column]:
    """n_match, n_substitute, n_insert, n_delete and edit_distance of an alignment."""
    count = lambda op: F.size(F.filter(aligned, lambda s: s["op"] == op))
    return [*(count(op).alias(f"n_{op}") for op in ("match", "substitute", "insert", "delete")), F.size(F.filter(aligned, lambda s: s["op"] != "match")).alias("edit_distance")]


def aligned_rows(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """Adds ``aligned``; the function runs once however often the column is used."""
    return rows.withColumn("aligned", alignment(F.col(pred), F.col(truth)))


def alignment_counts(pred: Column, truth: Column, dot: str = ".") -> Column:
    """As ``chord_alignment`` of an alignment that is not asked for itself: only its counts come back."""

    counts = ("edit_distance", "matches", "chord_matches", "dot_matches", "substitutions", "insertions", "deletions")

    @F.arrow_udf("struct<" + ",".join(f"{c}:int" for c in counts) + ",alignment_score:double>")
    def run(p: pa.Array, t: pa.Array) -> pa.Array:
        numbers, (ps, ts), dictionary = numbers_of(p, t)
        at, m, n = places(numbers, ps, ts), np.diff(ps), np.diff(ts)
        row, own = np.repeat(np.arange(len(n)), n), numbers[ts[0] :]
        met = at >= 0
        same = np.zeros(len(at), bool)
        same[met] = numbers[(ps[row] + at)[met]] == own[met]
        sign = dictionary.index(pa.scalar(dot, dictionary.type)).as_py()
        count = lambda test: np.bincount(row[test], minlength=len(n))
        found, matches, dots = count(met), count(same), count(same & (own == sign) & (sign >= 0))
        substitutions, deletions, insertions, chords = found - matches, n - found, m - found, matches - dots
        errors = substitutions + deletions + insertions
        score = np.where(chords + errors > 0, 100.0 * chords / np.maximum(chords + errors, 1), 0.0)
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int32()) for c in (errors, matches, chords, dots, substitutions, insertions, deletions)), pa.array(score, pa.float64())], [*counts, "alignment_score"])

    return run(pred, truth)


def chord_alignment(pred: Column, truth: Column, aligned: Column, dot: str = ".") -> Column:
    """STRUCT of matches by kind, S, I, D and the score 100 * chord matches / (chord matches + S + I + D)."""
    of = lambda op: F.filter(aligned, lambda s: s["op"] == op)
    dots = F.size(F.filter(of("match"), lambda s: F.get(truth, s["truth_index"]) == dot))
    chords = F.size(of("match")) - dots
    s, i, d = (F.size(of(op)) for op in ("substitute", "insert", "delete"))
    score = F.coalesce(F.try_divide(100.0 * chords, chords + s + i + d), F.lit(0.0))
    return F.struct((s + i + d).alias("edit_distance"), (chords + dots).alias("matches"), chords.alias("chord_matches"), dots.alias("dot_matches"), s.alias("substitutions"), i.alias("insertions"), d.alias("deletions"), score.alias("alignment_score"))
