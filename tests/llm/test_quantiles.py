"""Bucket histograms against sorted rows: contract of the query, merging, odd rows."""

import bisect
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from neumes.llm.quantiles import answers, click_counts, merged, price_counts, quantile_report, summaries
from neumes.llm.queries import QUERIES
from neumes.operators.positions import positions


def x_of(money, batch):
    return math.floor(100 * money + 0.5) + 1000 * batch


def groups_of(clicks, lines, items):
    """Sorted x of each (stream, grp, batch), -1 being all batches, from plain rows."""
    out: dict = {}

    def add(stream, grp, some_id, money):
        batch = zlib.crc32(str(some_id).encode()) % 16
        for b in (batch, -1):
            out.setdefault((stream, grp, b), []).append(x_of(money, batch))

    for c in {c["click_id"]: c for c in clicks}.values():
        if None not in (c["click_id"], c["client_id"], c["value"]) and math.isfinite(c["value"]):
            add("value", str(c["client_id"]), c["click_id"], c["value"])
    known = {i["item_id"]: i for i in items}
    for r in lines:
        item = known.get(r["item_id"])
        if r["item_id"] is not None and r["vendor_id"] is not None and item and None not in (item["brand"], item["price"]):
            add("price", item["brand"], r["vendor_id"], item["price"])
    return {k: sorted(v) for k, v in out.items()}


def check(rows, groups, steps=20):
    assert sorted((r.stream, r.grp, r.batch, r.i) for r in rows) == sorted((*k, i) for k, g in groups.items() if len(g) >= steps for i in range(1, steps))
    last = {}
    for r in sorted(rows, key=lambda r: (r.stream, r.grp, r.batch, r.i)):
        key = (r.stream, r.grp, r.batch)
        g = groups[key]
        n, target = len(g), -(-r.i * len(g) // steps)
        below, upto = bisect.bisect_left(g, r.answer), bisect.bisect_right(g, r.answer)
        error = max(0, below + 1 - target, target - upto)
        assert (r.n, r.target, r.exact_x, r.n_below, r.n_upto, r.rank_error, r.within) == (n, target, g[target - 1], below, upto, error, 1000 * error <= 10 * n)
        assert r.within and g[0] <= r.answer <= g[-1] and r.answer >= last.get(key, g[0])
        assert min(20, len(set(g))) <= r.points <= min(n, 2000)
        last[key] = r.answer


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_sorted_rows(spark, sf):
    folder = f"/root/testdata/{sf}"
    plain = [[r.asDict() for r in spark.read.parquet(f"{folder}/{t}.parquet").collect()] for t in ("clicks", "sale_lines", "items")]
    out = QUERIES["op12_quantiles"](spark, folder)
    assert dict(out.dtypes) | {} == {
        "stream": "string", "grp": "string", "batch": "int", "i": "int", "n": "bigint", "target": "bigint", "exact_x": "bigint", "points": "bigint", "answer": "bigint", "n_below": "bigint", "n_upto": "bigint", "rank_error": "bigint", "within": "boolean",
    }
    check(out.collect(), groups_of(*plain))


def shapes():
    rng = random.Random(4)
    return {
        "one value": [7.0] * 3000,
        "one heavy": [1.0] * 20_000 + [2.0 + k for k in range(30)],
        "spread": [rng.uniform(-500, 9e6) for _ in range(12_000)],
        "long tail": [min(round(rng.paretovariate(0.4), 2), 9e12) for _ in range(9000)],
        "near each other": [rng.randrange(300) / 100 for _ in range(8000)],
        "some heavy": [float(rng.choice((1, 2, 3, 900))) if rng.random() < 0.6 else rng.uniform(0, 1000) for _ in range(9000)],
        "few": [float(k) for k in range(19)],
        "enough": [float(k) for k in range(20)],
    }


def test_shapes_of_values(spark):
    """Heavy values, gaps, long tails, small groups; batches of unequal sizes."""
    rng, rows = random.Random(5), []
    for name, values in shapes().items():
        for v in values:
            rows.append((name, min(int(rng.expovariate(0.5)), 15), v))
    counts = spark.createDataFrame(rows, "grp string, batch int, v double").select(F.lit("s").alias("stream"), "grp", "batch", (F.floor(100 * F.col("v") + 0.5) + 1000 * F.col("batch")).alias("x"))
    groups: dict = {}
    for grp, batch, v in rows:
        for b in (batch, -1):
            groups.setdefault(("s", grp, b), []).append(x_of(v, batch))
    check(quantile_report(counts.groupBy("stream", "grp", "batch", "x").agg(F.count("*").alias("rows"))).collect(), {k: sorted(v) for k, v in groups.items()})


def test_buckets_are_disjoint_and_whole(spark):
    rows = [("a" if k % 3 else "b", (k * k) % 977, 1 + (k % 11 == 0) * 400) for k in range(3000)]
    counts = spark.createDataFrame(rows, "grp string, x long, rows long").groupBy("grp", "x").agg(F.sum("rows").alias("rows"))
    found = summaries(positions(counts, ["grp"], ["x"], ["rows"]), ["grp"], cells=50)
    again = merged(found.withColumn("batch", F.lit(0)), ["grp"], numbers=[0], cells=50)
    total = {g: sum(r[2] for r in rows if r[0] == g) for g in "ab"}
    for table in (found, again):
        for g in "ab":
            own = sorted((r.low, r.high, r.rows, r.before) for r in table.where(F.col("grp") == g).collect())
            assert sum(r[2] for r in own) == total[g] and all(p[1] < q[0] and p[3] + p[2] == q[3] for p, q in zip(own, own[1:]))
            assert all(low == high or n < 2 * total[g] / 50 + 1 for low, high, n, _ in own)
    # a summary that is merged alone stays nearly what it was
    ranks = {r.i: r.answer for r in answers(again.where("grp = 'a'"), ["grp"]).collect()}
    assert all(abs(ranks[r.i] - r.answer) <= 977 // 20 for r in answers(found.where("grp = 'a'"), ["grp"]).collect())


def test_odd_rows(spark):
    """Nulls in any column, repeats, ties, values that are no numbers, other columns, empty tables."""
    inf, nan = float("inf"), float("nan")
    clicks = [(k, 1, 0.005 * k) for k in range(200)] * 2 + [(None, 1, 1.0), (900, None, 1.0), (901, 1, None), (902, 1, inf), (903, 1, nan), (904, 1, -inf), (905, 2, -3.25)]
    items = [(1, "B", 2.5), (2, "B", None), (3, None, 1.0), (None, "B", 1.0), (4, "C", -0.005)]
    lines = [(1, v) for v in range(60)] * 3 + [(2, 1), (3, 1), (None, 1), (1, None), (77, 1)] + [(4, 5)] * 25
    c = spark.createDataFrame([(*r, "clash", 0, 1) for r in clicks], "click_id long, client_id long, value double, stream string, batch int, x int")
    i = spark.createDataFrame([(*r, 5) for r in items], "item_id long, brand string, price double, vendor_id int")
    s = spark.createDataFrame([(*r, "q", 1.0) for r in lines], "item_id long, vendor_id long, brand string, price double")
    named = lambda rows, *names: [dict(zip(names, r)) for r in rows]
    groups = groups_of(named(clicks, "click_id", "client_id", "value"), named(lines, "item_id", "vendor_id"), named(items, "item_id", "brand", "price"))
    both = click_counts(c).unionByName(price_counts(s, i))
    check(quantile_report(both).collect(), groups)
    assert quantile_report(both.limit(0)).count() == 0
