"""The stage machine as a stream: shuffled epochs over micro-batches, gaps, repeats."""

import random
import time

from neumes.streaming.stages import Rules, stage_stream, stage_trace

GOLDEN = [25, 19, 18, 18, 19, 18.5, 17, 18, 18]
RULES = Rules(threshold=20, patience=3, stages=2, final_patience=2)
SCHEMA = "run_id string, epoch int, val_ser double"


def states(rows):
    return sorted((r.run_id, r.epoch, r.val_ser, r.stage, r.below, r.best, r.at_final, r.no_improve, r.stop) for r in rows)


def written(spark, folder, batches):
    """A file for each micro-batch, in their order."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").json(str(folder / "in"))
        time.sleep(1.1 if k + 1 < len(batches) else 0)  # files are taken by their age, in seconds


def test_stream_equals_batch_whatever_the_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(r, i, v + k) for k, r in enumerate("abcd") for i, v in enumerate(map(float, GOLDEN), 1)]
    shuffled = rng.sample(rows, len(rows))
    shuffled[5:5] = [shuffled[0], ("a", None, 1.0)]  # a repeated score, and one without an epoch
    written(spark, tmp_path, [shuffled[:10], shuffled[10:17], shuffled[17:30], shuffled[30:]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stage_stream(stream, RULES).writeStream.format("memory").queryName("shuffled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(100) and len([p for p in query.recentProgress if p["numInputRows"]]) >= 4
    assert states(spark.table("shuffled").collect()) == states(stage_trace(spark.createDataFrame(rows, SCHEMA), RULES).collect())


def test_a_lost_epoch_is_waited_for_only_so_long(spark, tmp_path):
    rows = [("a", 1, 25.0), ("a", 3, 19.0), ("a", 4, 18.0)]
    written(spark, tmp_path, [rows])
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    query = stage_stream(stream, RULES, wait=2_000).writeStream.format("memory").queryName("gap").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        seen = []
        while time.time() < until and len(seen) < 3:
            seen.append(spark.table("gap").count()) if not seen or spark.table("gap").count() > seen[-1] else None
            if seen and seen[-1] == 3:
                break
            time.sleep(0.2)
        got = states(spark.table("gap").collect())
    finally:
        query.stop()
    assert seen[-1] == 3 and got == states(stage_trace(spark.createDataFrame(rows, SCHEMA), RULES).collect())
