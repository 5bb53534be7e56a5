"""Numbering by ranges: against plain counting, and what the plans look like."""

import random

from pyspark.sql import functions as F

from neumes.operators import compare, vocabulary
from neumes.operators.positions import positions


def test_positions_and_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.choice([1, None]), i, rng.choice([None, 0, 3, -2]), rng.random()) for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h int, k long, v int, d double")
    for ranges in (1, 3, 40):
        got = {r.k: r for r in positions(df, ["g", "h"], ["k"], ["v", "d"], ranges).collect()}
        assert len(got) == len(rows)
        groups = {}
        for r in sorted(rows, key=lambda r: r[2]):
            groups.setdefault(r[:2], []).append(r)
        for own in groups.values():
            v, d = 0, 0.0
            for place, r in enumerate(own, 1):
                v, d = v + (r[3] or 0), d + r[4]
                x = got[r[2]]
                assert (x.position, x.group_rows, x.upto_v, x.total_v, x.v) == (place, len(own), v, sum(y[3] or 0 for y in own), r[3])
                assert abs(x.upto_d - d) < 1e-9 and abs(x.total_d - sum(y[4] for y in own)) < 1e-9


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, "x", [1, 2]), (1, "x", None)], "k int, s string, a array<int>")
    assert [r.position for r in positions(df, [], ["k"]).orderBy("position").collect()] == [1, 2]
    assert positions(df.where("k > 1"), ["s"], ["k"]).collect() == [] and positions(df.where("k > 1"), [], ["k"], ["k"]).columns == ["k", "s", "a", "position", "group_rows", "upto_k", "total_k"]


def test_one_group_takes_many_tasks(spark):
    rows = spark.range(0, 10_000, 1, 4).select("id", F.lit("all").alias("g"), (F.col("id") % 7).alias("v"))
    numbered = positions(rows, ["g"], ["id"], ["v"], 16)
    # written by as many tasks as ranges: one group, no window over it
    assert len([f for f in numbered.inputFiles() if f.endswith(".parquet")]) == 16
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
    for out in (vocabulary.batches(rows.select("id", F.array(F.col("v")).alias("ids")), "id", 4), compare.signed_ranks(rows.withColumns({"a": F.col("v") * 1.0, "b": F.lit(3.0)}), ["g"], "a", "b")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan.replace("BroadcastExchange", "")


def test_batches_of_one_group(spark):
    rows = spark.createDataFrame([(i, list(range(i % 5))) for i in range(50)], "i long, ids array<long>")
    got = {r.i: (r.batch_id, r.padded) for r in vocabulary.batches(rows, "i", 4).collect()}
    assert all(got[i] == (i // 4, list(range(i % 5)) + [0] * (max(j % 5 for j in range(i // 4 * 4, min(50, i // 4 * 4 + 4))) - i % 5)) for i in range(50))
