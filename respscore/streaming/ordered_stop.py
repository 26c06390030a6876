"""E7 on a stream whose events arrive in any order (``transformWithState``).

A run keeps two states: the rule folded over all events up to the watermark (four numbers), and the list of later events, which may
still be joined by earlier ones.  Every micro-batch that brings events of a run emits the answer for all events seen so far, in
event order; it also sets a timer at the latest event.  When the watermark passes a timer, the events up to it are final: they are folded,
in order, and leave the list.  So the list holds no more than the events of the allowed delay, and the last answer of a run is that of a batch
over the same events, whatever the order of arrival.  Events behind the watermark are dropped by Spark, as everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..session import conf_set, scratch_path

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = (float("inf"), 0, 0, 0)


def fold(state: tuple, events, patience: int, delta: float) -> tuple:
    """(best, counter, steps, stop step or 0) after some more (time, id, value) in order; a missing value is a step without a loss."""
    best, counter, steps, stop = state
    for _, _, value in events:
        steps += 1
        if stop or value is None or value != value:
            continue
        improved, worse = value < best, value > best + delta
        best, counter = (value, 0) if improved else (best, counter + worse)
        if counter >= patience:
            stop = steps
    return best, counter, steps, stop


class OrderedStop(StatefulProcessor):
    def __init__(self, patience: int, delta: float):
        self.patience, self.delta = patience, delta

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "best double, counter long, steps long, stop long")
        self.pending = handle.getListState("pending", "at long, event_id long, value double")

    def _state(self) -> tuple:
        return tuple(self.done.get()) if self.done.exists() else START

    def handleInputRows(self, key, rows, timerValues):
        new = [(r.at, r.event_id, r.value) for r in rows]
        self.pending.appendList(new)
        self.handle.registerTimer(-(-max(at for at, _, _ in new) // 1000))
        state = fold(self._state(), sorted((tuple(x) for x in self.pending.get()), key=lambda x: x[:2]), self.patience, self.delta)
        yield Row(run_id=key[0], n_events=state[2], stop_step=state[3] or None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        final = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted((tuple(x) for x in self.pending.get()), key=lambda x: x[:2])
        done = [x for x in events if x[0] <= final]
        if done:
            self.done.update(fold(self._state(), done, self.patience, self.delta))
            if len(done) < len(events):
                self.pending.put(events[len(done):])
            else:
                self.pending.clear()
        return iter([])

    def close(self) -> None:
        pass


def stop_steps(spark: SparkSession, events: DataFrame, patience: int = 8, delta: float = 0.003, delay: str = "7 days") -> DataFrame:
    """(run_id, n_events, stop_step) once the stream ``events`` (event_id, ts, run_id, value) is worked off; null: not stopped."""
    out, ckpt = scratch_path(spark, "ordered-stop"), scratch_path(spark, "ordered-stop-ckpt")
    if events.schema["ts"].dataType.typeName() == "timestamp_ntz":  # as UTC, whatever the session's time zone
        events = events.withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"))
    rows = events.withWatermark("ts", delay).select("run_id", "event_id", "ts", F.unix_micros("ts").alias("at"), F.col("value").cast("double").alias("value"))
    answers = rows.groupBy("run_id").transformWithState(
        OrderedStop(patience, delta), "run_id long, n_events long, stop_step long", "Append", "EventTime")
    with conf_set(spark, "spark.sql.streaming.stateStore.providerClass", ROCKS):
        answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(out).groupBy("run_id").agg(F.max(F.struct("n_events", "stop_step")).alias("x"))
    return last.select("run_id", "x.n_events", "x.stop_step")
