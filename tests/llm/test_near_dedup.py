import random

import numpy as np

from neumes.llm.near_dedup import common_counts, near_dedup, signatures


def brute(rows):
    """n_shingles and component of each document, from all pairs."""
    space = " \t\n\x0b\x0c\r"
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in rows:
        words, word = [], ""
        for c in (text or "").translate(fold) + " ":
            if c not in space:
                word += c
            elif word:
                words.append(word)
                word = ""
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, i in enumerate(ids):
        for j in ids[p + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def chains(rng, n):
    """Texts that differ from the one before in some words: links without a common centre."""
    words = [f"w{k}" for k in range(400)]
    text = rng.choices(words, k=120)
    out = []
    for _ in range(n):
        text = list(text)
        for _ in range(rng.choice((1, 2, 3))):
            text[rng.randrange(len(text))] = rng.choice(words)
        out.append(" ".join(text))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t ", "one two", "One  two", "one\x1ctwo", "É é " * 3, "é é " * 3, "a b c d e", "A b\x0bc d e"] + sum((chains(rng, 40) for _ in range(4)), [])
    texts += [chains(rng, 1)[0]] * 30
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, bucket int")
    want = brute(rows)
    for block, per_task in ((512, 256), (5, 3)):  # also with families of many blocks and dealt partners
        got = {r.doc_id: r for r in near_dedup(docs, block=block, per_task=per_task).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_no_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")]
    got = sorted((r.doc_id is None, r.doc_id, r.component_id, r.kept) for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 3, 3, True), (False, 3, 3, True), (False, 4, 3, False), (True, None, None, True), (True, None, None, True)]
    assert near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_coordinates_agree_as_often_as_the_sets():
    rng = np.random.default_rng(1)
    shared = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 400).astype(np.uint64)
        p, q = np.unique(x[:350]), np.unique(x[50:])
        s = signatures([p, q], 128)
        shared.append((s[0] == s[1]).mean())
    assert abs(np.mean(shared) - 0.75) < 0.02 and np.std(shared) < 0.07


def test_common_counts_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 200, rng.integers(0, 150)).astype(np.uint64)) for _ in range(40)] + [np.unique(rng.integers(0, 10**6, 50).astype(np.uint64)) for _ in range(20)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for dense, columns in ((16, 4096), (2, 7)):
        assert (common_counts(sets, dense, columns) == want).all()
