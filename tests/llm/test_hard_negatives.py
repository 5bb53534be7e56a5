"""Hard negatives against all scores; bounds of the codes; odd rows."""

import math

import numpy as np
import pytest

import neumes.llm.hard_negatives as module
from neumes.llm.hard_negatives import Block, _packer, fit_codebook, hard_negatives, whole_vectors


def plain(rows, anchors_of=50, positives=5, negatives=3):
    """The rows of the result, from all scores."""
    known = {}
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
        known[vec_id] = min(known.get(vec_id, row), row)
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1]))
    out = set()
    for i, a in known.items():
        if i % anchors_of:
            continue
        order = sorted(((-score(a, b), j, b[0]) for j, b in known.items() if j != i))
        for s, p in [(-s, j) for s, j, label in order if label == a[0]][:positives]:
            found = [(j, -n) for n, j, label in order if label != a[0] and 50 * s <= -100 * n <= 95 * s]
            out |= {(i, p, rank, j, s, n) for rank, (j, n) in enumerate(found[:negatives], 1)}
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, label int, embedding array<float>, x string, slot int")


def result(out):
    rows = out.collect()
    got = {(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("dims", [64, 7, 1])
def test_equal_to_all_scores(spark, dims):
    """Clusters, a third of the rows with one vector, ties, negative scores; several blocks and a tiny codebook's sample."""
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(12, dims))
    rows = []
    for i in range(900):
        v = centres[0] if i % 3 == 0 else centres[rng.integers(12)] + 0.5 * rng.normal(size=dims)
        rows.append((i - 20, int(rng.integers(10)), [float(x) for x in np.round(v / (1 + np.abs(v).max()), 2)]))
    got = result(hard_negatives(table(spark, rows), block_rows=100, block_anchors=4, sample=40))
    assert got == plain(rows) and (got or dims == 1)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, i % 3, [0.1 * (i % 7), 0.5, -0.2 * (i % 5)]) for i in range(120)]
    rows += [rows[3], rows[50], (50, 0, [0.0, 0.0, 0.0]), (None, 1, [1.0]), (200, None, [1.0, 1.0, 1.0]), (201, 1, None), (202, 1, [nan, 1.0, 1.0]), (250, 1, [inf, 1.0, 1.0]), (203, 1, [None, 1.0, 1.0]), (300, 2, []), (301, 2, [0.5]), (302, 11, [0.5, 0.5, 0.5, 0.5])]
    assert result(hard_negatives(table(spark, rows), block_rows=16, block_anchors=2)) == plain(rows)
    assert hard_negatives(table(spark, rows[:0])).count() == 0
    alone = [(0, 1, [0.5, 0.5]), (1, 2, [0.5, 0.5])]
    assert hard_negatives(table(spark, alone)).count() == 0
    with pytest.raises(Exception, match="too large"):
        hard_negatives(table(spark, [(0, 1, [1e9, 1.0])])).collect()


def test_bounds_hold_and_prune():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    vectors = np.floor(256 * rng.normal(size=(500, 32)) / 6).astype(np.int64)
    book = fit_codebook(vectors[:200])
    packed = _packer(book, 32)(pa.table({"slot": np.zeros(500, np.int64), "vec_id": np.arange(500), "label": np.zeros(500, np.int64), "x": pa.array(vectors.tolist(), pa.list_(pa.int32()))}))
    block = Block(packed.to_pylist()[0], 32)
    assert (block.vectors == vectors).all() and (block.ids == np.arange(500)).all()
    low, high = block.bounds(vectors[:20], book)
    true = vectors[:20] @ vectors.T
    assert (low <= true).all() and (true <= high).all()
    assert np.median(high - low) < np.std(true)  # tight enough to leave most rows out


def test_labels_move_and_one_row_stays_of_each_id(spark):
    rows = table(spark, [(7, 9, [0.5]), (8, 9, [0.999]), (8, 9, [-0.001]), (9, 3, None)])
    assert sorted((r.vec_id, r.label, r.x) for r in whole_vectors(rows).collect()) == [(7, 0, [128]), (8, 9, [-1])]


def test_copies_of_anchors_never_pass_the_driver(spark, monkeypatch):
    """Joins that Spark deems small enough to broadcast held a copy of every anchor for each block of rows."""
    made, write = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name: (made.append(df), write(df, name))[1])
    rows = [(i, i % 3, [0.1 * (i % 7), 0.5, -0.2 * (i % 5)]) for i in range(300)]
    out = hard_negatives(table(spark, rows), anchors_of=5, block_rows=16, block_anchors=8)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*made, out)]
    assert len(plans) == 4 and not [p for p in plans if "Broadcast" in p]
    assert result(out) == plain(rows, 5)


@pytest.mark.parametrize("group_bytes", [1, 12000])
def test_groups_of_anchors(spark, group_bytes):
    """Anchors in more than one group, with questions that several blocks answer."""
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(3)), [float(x) for x in np.round(np.abs(rng.normal(size=6)), 1)]) for i in range(400)]
    got = result(hard_negatives(table(spark, rows), anchors_of=10, block_rows=30, block_anchors=8, group_bytes=group_bytes))
    assert got == plain(rows, 10) and got
