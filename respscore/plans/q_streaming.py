"""Streaming queries: run to completion (availableNow) and read the sink back."""

from __future__ import annotations

from ..operators import scale as SC
from ..streaming import features_stream as ST
from ..streaming import ordered_stop as OS
from ..streaming import scaler_stream as SS
from .q_metrics import _plateau_sql
from .q_profile import BASIC, BASIC_SQL, basic_features
from .registry import register, rounded


@register("stream_basic_features", BASIC_SQL + "SELECT response_id, prompt_id, " +
          ", ".join(f"round({c}, 6) AS {c}" for c in BASIC) + " FROM basic")
def q_stream_basic_features(spark, sf):
    """Row-local counts and ratios computed on a file stream of responses."""
    return rounded(ST.stream_basic_features(spark, sf))


@register("stream_plateau", _plateau_sql(8, 0.003))
def q_stream_plateau(spark, sf):
    """E7 with per-run state over a stream of loss events."""
    return ST.stream_plateau(spark, sf, patience=8, delta=0.003)


@register("stream_plateau_ordered", _plateau_sql(8, 0.003))
def q_stream_plateau_ordered(spark, sf):
    """E7 over a stream of loss events in any order, with event-time state."""
    events = ST._file_stream(spark, sf, "events").selectExpr("event_id", "ts", "user_id AS run_id", "value")
    runs = spark.read.parquet(f"{sf}/events.parquet").selectExpr("user_id AS run_id").distinct()
    return runs.join(OS.stop_steps(spark, events).select("run_id", "stop_step"), "run_id", "left")


_SCALED = ", ".join(f"round(CASE WHEN max({c}) OVER p > min({c}) OVER p THEN ({c} - min({c}) OVER p) / (max({c}) OVER p - min({c}) OVER p) ELSE 0.0 END, 6) AS {c}"
                    for c in BASIC)


@register("stream_minmax", BASIC_SQL + f"SELECT response_id, prompt_id, {_SCALED} FROM basic WINDOW p AS (PARTITION BY prompt_id)")
def q_stream_minmax(spark, sf):
    """E1 as fit and transform: the scaler's state is fitted on the stream of responses and applied to the table."""
    state = SS.fit_stream(spark, ST.basic_features(spark, sf), BASIC)
    return rounded(SC.apply_minmax(basic_features(spark, sf), state, BASIC))
