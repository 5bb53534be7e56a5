"""Alignment by kept rows against the whole table, and its memory."""

import random
import tracemalloc

from neumes.operators import alignment


def plain_steps(pred, truth):
    p, t = alignment.numbered(pred, truth)
    table = [[0] * (len(t) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) + 1):
        for j in range(len(t) + 1):
            table[i][j] = max(i, j) if not (i and j) else min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (p[i - 1] != t[j - 1]))
    i, j, out = len(p), len(t), []
    while i or j:
        here = table[i][j]
        if i and j and p[i - 1] == t[j - 1] and here == table[i - 1][j - 1]:
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


def test_the_way_is_that_of_the_whole_table(monkeypatch):
    rng = random.Random(1)
    for table in (0, 100, 1 << 20):
        monkeypatch.setattr(alignment, "TABLE", table)
        for _ in range(400):
            a = [rng.choice("abc") if rng.random() > 0.05 else None for _ in range(rng.randrange(25))]
            b = rng.choices("abc", k=rng.randrange(25)) if rng.random() < 0.5 else [x for x in a if rng.random() > 0.2]
            assert alignment.steps(a, b) == plain_steps(a, b)


def test_long_sequences_take_little_memory():
    rng = random.Random(2)
    truth = rng.choices("abcdefgh", k=20_000)
    pred = [x if rng.random() > 0.1 else "z" for x in truth[:9_000] + truth[9_300:]]
    tracemalloc.start()
    try:
        found = alignment.steps(pred, truth)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100e6
    assert sum(op != "insert" for op, _, _ in found) == len(truth) and sum(op != "delete" for op, _, _ in found) == len(pred)
    assert sum(op != "match" for op, _, _ in found) <= 300 + sum(x == "z" for x in pred)
