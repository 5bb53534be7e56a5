import hashlib
import random

import numpy as np

from neumes.llm import exact_dedup as exact
from neumes.llm.line_dedup import line_dedup
from neumes.llm.perfect_hash import LineIndex, PerfectHash

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_perfect_hash_places_all_keys_and_rejects_others():
    rng = np.random.default_rng(1)
    for n, levels in ((0, 24), (1, 24), (5000, 24), (3000, 1)):  # one level: the rest is listed
        a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        keys = PerfectHash.build(a, b, levels)
        keys, used = PerfectHash.from_bytes(keys.to_bytes())
        assert len(keys) == n and used == len(keys.to_bytes()) and sorted(keys.slots(a, b).tolist()) == list(range(n))
        index = LineIndex.from_bytes(LineIndex.build(a, b, np.arange(n) + 2, np.arange(n)).to_bytes())
        held, count, first = index.probe(a, b)
        assert held.all() and (first == np.arange(n)).all() and (count == np.arange(n) + 2).all()
        assert not index.probe(b, a)[0].any() or n == 0


def brute_lines(rows):
    holders = {}
    key = lambda x: x.strip(SPACE).translate(FOLD)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(2)
    some = ["A common Line here", "a common line HERE \t", "short", "ÄÖÜäöü Zeile", "äöüäöü zeile", "nine char", "ééééééééé", "éééééééééé", "\x1cwith a separator", "with a separator", "", "  "] + [f"line number {i} of all" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(some, k=rng.randrange(12)))) for i in range(2500)] + [(2500, None), (2501, ""), (2502, "x" * 200_000 + "\n" + some[0])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, line string")
    want = brute_lines(rows)
    for size in (500_000, 3):  # some lines are so frequent that they are broadcast
        got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup(docs, shard_lines=size).collect()}
        assert got == want


def test_lines_without_ids_and_repeated_rows(spark):
    rows = [(None, "a line of some length"), (1, "a line of some length"), (1, "a line of some length"), (2, "A line of some length")]
    got = sorted((r.doc_id or 0, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 1)]
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_misra_gries_keeps_all_frequent_keys():
    rng = random.Random(4)
    keys = [rng.choice("ab") if rng.random() < 0.6 else rng.randrange(10**6) for _ in range(5000)]
    held = exact.misra_gries(((k, 1) for k in keys), 8)
    assert {"a", "b"} <= set(held) and len(held) <= 8


def test_exact_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a b", "ab", "a\tb ", "a\xa0b", "ab\x1c"] + ["copy of a hot text" + " " * rng.randrange(3) for _ in range(300)] + [f"text {rng.randrange(60)}" + "\n" * rng.randrange(3) for _ in range(300)]
    rng.shuffle(texts)
    groups = {}
    bare = lambda t: "".join(c for c in t or "" if c not in SPACE)
    for i, t in enumerate(texts):
        groups.setdefault(bare(t), []).append((-len(t or ""), i))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, digest string, kept int")
    for counters in (256, 1):
        got = exact.exact_dedup(docs, counters=counters).collect()
        assert len(got) == len(texts)
        for r in got:
            key = bare(texts[r.doc_id])
            assert (r.keep_id, r.group_size, r.kept) == (min(groups[key])[1], len(groups[key]), min(groups[key])[1] == r.doc_id)
            assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()
    assert exact.exact_dedup(docs.limit(0)).count() == 0


def test_drop_copies_keeps_one_row_of_each_group(spark):
    plain = spark.createDataFrame([(1, "a b", "x"), (2, "ab", "y"), (3, "c", "z")], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in exact.drop_copies(plain).collect()) == [1, 3]
    mixed = spark.createDataFrame([(None, "ab"), (None, "c"), (5, "a b"), (5, "a b"), (5, "d"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text or "") for r in exact.drop_copies(mixed).collect()) == [(0, ""), (0, "c"), (5, "a b"), (5, "d")]
    clashing = spark.createDataFrame([(1, "a b", "s1", 1, 2, 3), (1, "ab", "s2", 1, 2, 3), (2, "c", "s3", 1, 2, 3)], "doc_id long, text string, __sha string, __chars int, row int, kept int")
    kept = exact.drop_copies(clashing)
    assert kept.columns == clashing.columns and sorted(r["__sha"] for r in kept.collect()) == ["s1", "s3"]
    assert exact.drop_copies(clashing.where("doc_id = 2").unionAll(clashing.where("__sha = 's1'"))).columns == clashing.columns


def test_index_decides_by_its_counts(spark):
    """All distinct lines are indexed; one of a single document has a count of 1 and stays."""
    from neumes.llm.line_dedup import halves

    import xxhash

    a, b = halves([xxhash.xxh3_128_digest(k) for k in (b"a line of one", b"a line of two")])
    index = LineIndex.build(a, b, np.array([1, 2]), np.array([4, 4]))
    held, count, first = index.probe(a, b)
    assert held.all() and count.tolist() == [1, 2] and first.tolist() == [4, 4]
    rows = [(9, "only in this document\nin both of them"), (4, "in both of them")]
    got = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: (1, "only in this document"), 4: (0, "in both of them")}


def test_ids_are_whole_numbers(spark):
    """Ids of documents that are text raise an error; numbers in text are read as such."""
    import pytest

    assert exact.exact_dedup(spark.createDataFrame([("12", "a")], "doc_id string, text string")).first().doc_id == 12
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        exact.exact_dedup(spark.createDataFrame([("urn:x", "a")], "doc_id string, text string")).collect()
