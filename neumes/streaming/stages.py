"""The stage of a staged training run, advanced by its validation scores.

One transition function serves batch tables and Structured Streaming; the stream
form is an extension. Scores of a run come in the order of their epochs.
"""

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "run_id string, epoch int, val_ser double, stage int, below int, best double, at_final boolean, no_improve int, stop boolean"
STATE = "stage int, below int, best double, at_final boolean, no_improve int, stop boolean"
NONE_YET = float("inf")
_OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]


@dataclass(frozen=True)
class Rules:
    """``threshold`` is on the scale of the scores (0 to 100)."""

    threshold: float
    patience: int = 3
    stages: int = 9
    final_patience: int = 10
    first_stage: int = 1


@dataclass(frozen=True)
class State:
    stage: int
    below: int = 0
    best: float = NONE_YET
    at_final: bool = False
    no_improve: int = 0
    stop: bool = False


def initial(rules: Rules, resumed_best: float = NONE_YET) -> State:
    """The state before the first score; a run resumed at the final stage may bring its best score."""
    final = rules.first_stage >= rules.stages
    return State(rules.first_stage, best=resumed_best if final else NONE_YET, at_final=final)


def advance(state: State, score: float, rules: Rules) -> State:
    """The state after one score. A stopped run stays as it is; a missing score changes nothing."""
    if state.stop or score is None or score != score:
        return state
    better = score < state.best
    if state.at_final:
        waited = 0 if better else state.no_improve + 1
        return State(state.stage, state.below, min(score, state.best), True, waited, waited >= rules.final_patience)
    if score >= rules.threshold:
        return State(state.stage, 0, state.best)
    if better:
        return State(state.stage, 0, score)
    if state.below + 1 < rules.patience:
        return State(state.stage, state.below + 1, state.best)
    stage = min(state.stage + 1, rules.stages)
    return State(stage, best=score, at_final=True) if stage == rules.stages else State(stage)


def trace(scores: list[tuple], rules: Rules, state: State | None = None) -> list[tuple]:
    """(epoch, score, state fields) after each of (epoch, score), in the order of epochs."""
    state, out = state or initial(rules), []
    for epoch, score in sorted(scores, key=lambda x: x[0]):
        state = advance(state, score, rules)
        out.append((epoch, score, *astuple(state)))
    return out


def stage_trace(scores: DataFrame, rules: Rules) -> DataFrame:
    """The state after each score of (run_id, epoch, val_ser); a run's epochs are its group."""

    def run(table: pa.Table) -> pa.Table:
        rows = trace(list(zip(table["epoch"].to_pylist(), table["val_ser"].to_pylist())), rules)
        names = ("epoch", "val_ser", "stage", "below", "best", "at_final", "no_improve", "stop")
        kinds = (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.bool_())
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        return pa.table([pa.array([table["run_id"][0].as_py()] * len(rows), pa.string()), *columns], names=["run_id", *names])

    clean = scores.select(F.col("run_id").cast("string").alias("run_id"), F.col("epoch").cast("int").alias("epoch"), F.col("val_ser").cast("double").alias("val_ser"))
    return clean.groupBy("run_id").applyInArrow(run, OUT)


class StageProcessor(StatefulProcessor):
    """A run's state, and the scores that came before their turn.

    Scores advance the state in the order of their epochs, whatever the order in which
    they come. One that is ahead waits until the epochs before it are there; if they
    aren't after ``wait`` milliseconds of processing time, if given, those that wait are
    taken as they are. An epoch that comes a second time, or after its turn, changes nothing.
    """

    def __init__(self, rules: Rules, first_epoch: int = 1, wait: int | None = None):
        self.rules, self.first_epoch, self.wait = rules, first_epoch, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"{STATE}, next int")
        self.ahead = handle.getMapState("ahead", "epoch int", "val_ser double")

    def _known(self) -> tuple[State, int]:
        if not self.state.exists():
            return initial(self.rules), self.first_epoch
        *fields, following = self.state.get()
        return State(*fields), following

    def _advance(self, key, state: State, epochs: list[tuple[int, float | None]], following: int) -> Iterator[Row]:
        made = trace(epochs, self.rules, state)
        for row in made:
            yield Row(**dict(zip(_OUT_NAMES, (key[0], *row))))
        self.state.update((*(made[-1][2:] if made else astuple(state)), following))

    def _waiting(self) -> dict[int, float | None]:
        return {k[0]: v[0] for k, v in self.ahead.iterator()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, following = self._known()
        waiting = self._waiting() if self.ahead.exists() else {}
        before = set(waiting)
        for row in rows:
            if row.epoch is not None and row.epoch >= following:
                waiting.setdefault(row.epoch, row.val_ser)
        ready = []
        while following in waiting:
            ready.append((following, waiting.pop(following)))
            following += 1
        for epoch in before - set(waiting):
            self.ahead.removeKey((epoch,))
        for epoch in set(waiting) - before:
            self.ahead.updateValue((epoch,), (waiting[epoch],))
        if waiting and self.wait is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        yield from self._advance(key, state, ready, following)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, following = self._known()
        waiting = self._waiting() if self.ahead.exists() else {}
        if waiting:
            self.ahead.clear()
            yield from self._advance(key, state, sorted(waiting.items()), max(waiting) + 1)


def stage_stream(scores: DataFrame, rules: Rules, first_epoch: int = 1, wait: int | None = None) -> DataFrame:
    """As ``stage_trace`` for a streaming table whose epochs may come in any order; runs count their epochs from ``first_epoch``.

    State is kept by run, in RocksDB. Rows without an epoch are left out, and of rows
    that repeat one the first that comes counts. ``wait`` (milliseconds) sets timers for
    lost epochs; it is for streams that go on, as one with timers never counts as read
    to its end.
    """
    clean = scores.select(F.col("run_id").cast("string").alias("run_id"), F.col("epoch").cast("int").alias("epoch"), F.col("val_ser").cast("double").alias("val_ser"))
    scores.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return clean.groupBy("run_id").transformWithState(StageProcessor(rules, first_epoch, wait), OUT, "append", "none" if wait is None else "processingTime")


def sweep(scores: DataFrame) -> DataFrame:
    """(run_id, stage, ser): mean score of each stage, at most 100."""
    return scores.groupBy("run_id", "stage").agg(F.avg(F.least("val_ser", F.lit(100.0))).alias("ser"))
