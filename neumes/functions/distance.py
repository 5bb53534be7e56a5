"""Levenshtein distance of whole texts by character, word or line, in Arrow batches.

A column of the table of distances is kept as two whole numbers, one bit for each
row (Myers), and in long texts only for the rows within a band around the diagonal
(Hyyrö). The band is widened until the distance that it gives proves that no better
path leaves it. So a text of n symbols and d errors costs n steps on numbers
of about d bits, whether errors shift all that follows or not, and memory is linear.
Texts of a batch go through their bands side by side, 64 rows to a word (``_side_by_side``).
"""

from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that no text has: they stand for a line break and a tab among characters.
_BREAK_SIGN, _TAB_SIGN = "\U0010fffe", "\U0010ffff"


def symbols(text: str, kind: str) -> Sequence:
    """Symbols of a text: cer (characters but blanks), ser (words, empty ones too), ler (lines); breaks and tabs are symbols in the first two."""
    if kind == "ler":
        return text.replace("\t", " <t> ").split("\n")
    if kind == "cer" and "<b>" not in text and "<t>" not in text:  # no word can be taken for a sign
        return text.replace("\n", _BREAK_SIGN).replace("\t", _TAB_SIGN).replace(" ", "")
    words = text.replace("\n", " <b> ").replace("\t", " <t> ").split(" ")
    if kind == "ser":
        return words
    return "".join(_BREAK_SIGN if w == "<b>" else _TAB_SIGN if w == "<t>" else w for w in words)


def _common_start(a: Sequence, b: Sequence) -> int:
    """Length of the common beginning, by halving: slices are compared at once."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _contains_in_order(small: Sequence, large: Sequence) -> bool:
    rest = iter(large)
    return all(x in rest for x in small)


#: Columns of up to so many rows are kept whole: their numbers cost less than a band's upkeep.
WHOLE = 3000


def _whole(a: Sequence, b: Sequence) -> int:
    """Distance by whole columns of the table."""
    place: dict = {}
    for at, x in enumerate(a):
        place[x] = place.get(x, 0) | (1 << at)
    mask, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    vp, vn, seen = mask, 0, place.get
    for y in b:
        x = seen(y, 0)
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp, hn = vn | (mask ^ (d0 | vp)), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = ((hp << 1) | 1) & mask
        vp, vn = ((hn << 1) & mask) | (mask ^ (d0 | hp)), hp & d0
    return score


def _at_least(a: Sequence, b: Sequence) -> int:
    """No distance is smaller: symbols that one side has more of."""
    left, right = Counter(a), Counter(b)
    return max((left - right).total(), (right - left).total())


def _within_band(a: Sequence, b: Sequence, below: int) -> int:
    """Distance along paths that stay at most ``below`` rows below the diagonal, below <= len(a) <= len(b); never too small.

    Bit k of the numbers in column j stands for row j - above + k of the table.
    """
    m, n = len(a), len(b)
    above = n - m + below
    width = above + below + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)
    vp, vn, score = mask ^ ((1 << above) - 1), 0, below
    last, stride = top, max(width, 256)
    place: dict = {}
    for j in range(n):
        k = j % stride
        if k == 0:  # where each symbol stands among the rows that the next columns see
            first, place = j - above, {}
            for at in range(max(first, 0), min(first + width + stride, m)):
                place[a[at]] = place.get(a[at], 0) | (1 << (at - first))
        x = (place.get(b[j], 0) >> k) & mask
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & mask
        hp, hn = vn | (mask ^ (d0 | vp)), d0 & vp
        if j + below < m:  # the lowest row of the band still moves down
            score += not d0 & top
        else:
            last >>= 1
            score += bool(hp & last)
            score -= bool(hn & last)
        d0 >>= 1
        vp, vn = hn | (mask ^ (d0 | hp)), d0 & hp
    return score


def distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two strings or two lists, with unit costs."""
    if a == b:
        return 0
    start = _common_start(a, b)
    a, b = a[start:], b[start:]
    end = _common_start(a[::-1], b[::-1])
    a, b = (a[: len(a) - end], b[: len(b) - end]) if end else (a, b)
    if len(a) > len(b):
        a, b = b, a
    if not a or _contains_in_order(a, b):
        return len(b) - len(a)
    if len(a) <= WHOLE:
        return _whole(a, b)
    below = 16 + len(b) // 64 + (5 * _at_least(a, b) // 4 - (len(b) - len(a))) // 2
    while True:
        below = min(max(below, 16), len(a))
        found = _within_band(a, b, below)
        # a path that leaves the band goes ``below`` + 1 rows down and comes back
        if below == len(a) or found <= len(b) - len(a) + 2 * below + 1:
            return found
        below *= 2


#: Pairs of fewer symbols are measured one by one; so many symbols of pairs are held, and so many words go side by side.
SHORT, HELD, WORDS = 48, 1 << 24, 6144
#: Words begin and end at every so many steps. A pair whose table of symbols would have more entries is measured alone.
STRIDE, ENTRIES = 16, 1 << 20
_code = np.zeros(0)


def _coded(a: Sequence, b: Sequence) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols as numbers: those of ``a`` from 0, all others of ``b`` as the number behind them."""
    global _code
    if isinstance(a, str):
        if not len(_code):
            _code = np.full(0x110000, -1, np.int32)
        p, t = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
        names = np.unique(p)
        _code[names] = np.arange(len(names))
        p, t = _code[p], _code[t]
        _code[names] = -1
        t[t < 0], different = len(names), len(names)
    else:
        seen: dict = {}
        p = np.array([seen.setdefault(x, len(seen)) for x in a], np.int32)
        t, different = np.array([seen.get(x, len(seen)) for x in b], np.int32), len(seen)
    return (p, t, different) if different > 0xFFFF else (p.astype(np.uint16), t.astype(np.uint16), different)


def _side_by_side(pairs: list[tuple[np.ndarray, np.ndarray, int]], below: list[int]) -> list[int]:
    """As ``_within_band`` for many pairs of numbered symbols (a, b, different ones of a); never too small.

    Word w of a pair stands for 64 rows of its table and does column j at step j + w: it
    takes over what word w - 1 gave at the step before. Only words that the band meets take
    part, in turn in the same places.
    """
    m, n, k = (np.array(x, np.int64) for x in ([len(a) for a, _, _ in pairs], [len(b) for _, b, _ in pairs], [s + 1 for _, _, s in pairs]))
    low = np.array(below, np.int64)
    above, words = n - m + low, (m + 63) // 64
    room = np.minimum(words, (above + low + 64 + 2 * STRIDE) // 65 + 1)
    first, many = np.cumsum(room) - room, int(room.sum())
    table_at, b_at = np.cumsum(words * k) - words * k, np.cumsum(n) - n
    # where each symbol stands, a bit for each row
    pair_of = np.repeat(np.arange(len(pairs)), m)
    row = np.arange(len(pair_of)) - np.repeat(np.cumsum(m) - m, m)
    entry, bit = table_at[pair_of] + row // 64 * k[pair_of] + np.concatenate([a for a, _, _ in pairs]), row % 64
    table = np.zeros(int((words * k).sum()), np.uint64)
    for half in (0, 32):
        there = bit // 32 * 32 == half
        bits = np.bincount(entry[there], np.exp2(bit[there] - half), len(table)).astype(np.uint64)
        table |= bits << np.uint64(half)
    symbols_b = np.concatenate([b for _, b, _ in pairs]).astype(np.int64)
    # each word: its columns, its place, what stands above it
    d = np.repeat(np.arange(len(pairs)), words)
    w = np.arange(len(d)) - np.repeat(np.cumsum(words) - words, words)
    begin, end = 64 * w + 1 - low[d], 64 * w + 64 + above[d]
    begin, end = np.maximum(begin - (begin + w - 1) % STRIDE, 1), end + -(end + w + 1) % STRIDE
    place, over = first[d] + w % room[d], np.where(w > 0, first[d] + (w - 1) % room[d], many)
    steps = int((n + words).max())

    def by_step(at: np.ndarray) -> tuple[np.ndarray, list[int]]:
        return np.argsort(at, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(at, minlength=steps + 1))]).tolist()

    starts, starts_at = by_step(begin + w)
    later = np.flatnonzero((w < words[d] - 1) & (end < n[d]))
    ends, ends_at = by_step(end[later] + w[later] + 2)
    ends = place[later[ends] + 1]
    done, done_at = by_step(n + words - 1)
    found, fresh = np.zeros(len(pairs), np.int64), begin == 1
    u = lambda: np.zeros(many, np.uint64)
    vp, vn, eq, xv, x, ph, mh, hpi, hni = u(), u(), u(), u(), u(), u(), u(), u(), u()
    hp, hn, one, top = np.zeros(many + 1, np.uint64), np.zeros(many + 1, np.uint64), np.uint64(1), np.uint64(63)
    hp[many] = 1  # above the first row, and above the band, each column costs one
    # of each pair the last row of its lowest word so far: the place, and the distance there
    lowest, value, up = first.copy(), np.zeros(len(pairs), np.int64), np.full(many, many, np.int64)
    at, base, symbol = np.zeros(many, np.int64), np.zeros(many, np.int64), np.zeros(many, np.int64)
    last_p, last_n, ones = hp[:many], hn[:many], ~np.uint64(0)
    hp_signed, hn_signed = hp.view(np.int64), hn.view(np.int64)
    for step in range(1, steps):
        i, j = starts_at[step], starts_at[step + 1]
        if i < j:
            s = starts[i:j]
            to, of, before = place[s], d[s], lowest[d[s]]
            value[of] = np.where(fresh[s], 64 * w[s], value[of] - hp[before].astype(np.int64) + hn[before].astype(np.int64)) + 64
            vp[to], vn[to], up[to], lowest[of] = ones, 0, over[s], to
            at[to], base[to] = b_at[of] + begin[s] - 1, table_at[of] + w[s] * k[of]
        i, j = ends_at[step], ends_at[step + 1]
        if i < j:
            up[ends[i:j]] = many
        np.take(symbols_b, at, out=symbol, mode="clip")
        at += 1
        symbol += base
        np.take(table, symbol, out=eq, mode="clip")
        np.take(hp, up, out=hpi, mode="clip")
        np.take(hn, up, out=hni, mode="clip")
        np.bitwise_or(eq, vn, out=xv)
        eq |= hni
        np.bitwise_and(eq, vp, out=x)
        x += vp
        x ^= vp
        x |= eq
        np.bitwise_or(x, vp, out=ph)
        np.invert(ph, out=ph)
        ph |= vn
        np.bitwise_and(vp, x, out=mh)
        np.right_shift(ph, top, out=last_p)
        np.right_shift(mh, top, out=last_n)
        value += hp_signed[lowest]
        value -= hn_signed[lowest]
        ph <<= one
        ph |= hpi
        mh <<= one
        mh |= hni
        np.bitwise_or(xv, ph, out=vp)
        np.invert(vp, out=vp)
        vp |= mh
        np.bitwise_and(ph, xv, out=vn)
        i, j = done_at[step], done_at[step + 1]
        if i < j:
            # rows behind the last symbol count out again
            s = done[i:j]
            behind = np.where(m[s] % 64 > 0, ones << (m[s] % 64).astype(np.uint64), 0)
            found[s] = value[s] - np.bitwise_count(vp[lowest[s]] & behind) + np.bitwise_count(vn[lowest[s]] & behind).astype(np.int64)
    return found.tolist()


class Distances:
    """Distances of many pairs, each given to ``found`` with its key; longer pairs wait, as numbers, to go side by side with others of about their length."""

    def __init__(self, found: Callable):
        self.found, self.waiting, self.held = found, [], 0

    def add(self, key, a: Sequence, b: Sequence) -> None:
        if a == b or max(len(a), len(b)) < SHORT:
            return self.found(key, 0 if a == b else distance(a, b))
        start = _common_start(a, b)
        a, b = a[start:], b[start:]
        end = _common_start(a[::-1], b[::-1])
        a, b = (a[: len(a) - end], b[: len(b) - end]) if end else (a, b)
        if len(a) > len(b):
            a, b = b, a
        if not a:
            return self.found(key, len(b))
        p, t, different = _coded(a, b)
        common = int(np.minimum(np.bincount(p, minlength=different + 1), np.bincount(t, minlength=different + 1))[:different].sum())
        if common == len(a) and _contains_in_order(a, b):
            return self.found(key, len(b) - len(a))
        if (len(a) // 64 + 1) * (different + 1) > ENTRIES:
            return self.found(key, distance(a, b))
        below = 16 + len(b) // 50 + (4 * (len(b) - common) // 3 - (len(b) - len(a))) // 2
        self.waiting.append((key, p, t, different, min(max(below, 16), len(a))))
        self.held += len(a) + len(b)
        if self.held > HELD:
            self.flush()

    def flush(self) -> None:
        """Measures what waits."""
        waiting, self.waiting, self.held = self.waiting, [], 0
        while waiting:
            waiting.sort(key=lambda x: len(x[2]))
            again = []
            while waiting:
                group, words, longest = [], 0, len(waiting[-1][2])
                while waiting and words < WORDS and (words < WORDS // 8 or 4 * len(waiting[-1][2]) > 3 * longest):
                    key, p, t, different, below = waiting.pop()
                    words += min(len(p) // 64 + 1, (len(t) - len(p) + 2 * below) // 64 + 2)
                    group.append((key, p, t, different, below))
                # a step of few words costs more than their numbers one by one
                if 30 * words + 1000 * len(group) < 45000:
                    for key, p, t, *_ in group:
                        self.found(key, distance(p.tolist(), t.tolist()))
                    continue
                found = _side_by_side([x[1:4] for x in group], [x[4] for x in group])
                for (key, p, t, different, below), f in zip(group, found):
                    # a path that leaves the band goes ``below`` + 1 rows down and comes back
                    if below == len(p) or f <= len(t) - len(p) + 2 * below + 1:
                        self.found(key, f)
                    else:
                        # no path that is shorter than the one found leaves this band
                        again.append((key, p, t, different, min(2 * below, (f - len(t) + len(p)) // 2 + 1, len(p))))
            waiting = again


def distances(pairs: Iterable[tuple[Sequence, Sequence]]) -> list[int]:
    """``distance`` of each pair."""
    out: dict = {}
    measure = Distances(out.__setitem__)
    for i, (a, b) in enumerate(pairs):
        measure.add(i, a, b)
    measure.flush()
    return [out[i] for i in range(len(out))]


def text_errors(pred: Column, truth: Column, kinds: Sequence[str]) -> Column:
    """STRUCT of <kind>_errors and <kind>_total (symbols of ``truth``) of two texts; null if one is."""
    kinds = tuple(kinds)
    names = [f"{k}_{part}" for k in kinds for part in ("errors", "total")]

    @F.arrow_udf("struct<" + ",".join(f"{n}:int" for n in names) + ">")
    def run(p: pa.Array, t: pa.Array) -> pa.Array:
        rows: list = [None] * len(p)
        measure = Distances(lambda key, errors: rows[key[0]].__setitem__(key[1], errors))
        for i, (a, b) in enumerate(zip(p, t)):
            a, b = a.as_py(), b.as_py()
            if a is None or b is None:
                continue
            rows[i] = {}
            for kind in kinds:
                of = symbols(b, kind)
                rows[i][f"{kind}_errors"], rows[i][f"{kind}_total"] = 0, len(of)
                if a != b:
                    measure.add((i, f"{kind}_errors"), symbols(a, kind), of)
        measure.flush()
        return pa.array(rows, pa.struct([(n, pa.int32()) for n in names]))

    return run(pred, truth)
