"""Stream operators next to their batch versions: files in any order, and batches that come twice."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from respscore.operators import metrics, scale
from respscore.session import scratch_path
from respscore.sources import fixtures as FX
from respscore.streaming import features_stream, ordered_stop, scaler_stream


def in_files(spark, rows, folder, n=3):
    """The rows of each of ``n`` parts as one file."""
    for part in range(n):
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("deal, delay", [("pmod(hash(event_id), 3)", "400 days"), ("least(2, floor(rank / 350))", "1 second")])
def test_ordered_stop_is_the_batch_answer(spark, deal, delay):
    """Events dealt out at random need a long delay; files in event order need none and leave little in the state."""
    events = spark.read.parquet(f"{SF001}/events.parquet")
    order = events.selectExpr("event_id", "row_number() OVER (ORDER BY ts, event_id) - 1 AS rank")
    events = events.join(order, "event_id").withColumn("user_id", F.col("user_id") % 7)
    folder = scratch_path(spark, "test-events")
    in_files(spark, events.withColumn("part", F.expr(deal)).drop("rank"), folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = ordered_stop.stop_steps(spark, stream.withColumnRenamed("user_id", "run_id"), patience=3, delta=0.003, delay=delay)
    log = events.selectExpr("user_id AS run_id", "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step", "value AS loss")
    want = {r["run_id"]: r["stop_step"] for r in metrics.plateau_stop(log, 3, 0.003).collect()}
    sizes = {r["run_id"]: r["n"] for r in log.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert {r["run_id"]: r["stop_step"] for r in got.collect()} == want and any(want.values())
    assert {r["run_id"]: r["n_events"] for r in got.collect()} == sizes


def test_ordered_fold_hand_case():
    values = [1.0, 1.05, 1.2, 0.9, 1.1, 1.2]  # 1.05 is in the band, 0.9 resets the counter, the rule fires at 6
    assert ordered_stop.fold(ordered_stop.START, [(i, i, v) for i, v in enumerate(values)], 2, 0.1)[3] == 6
    assert ordered_stop.fold(ordered_stop.START, [(0, 0, None), (1, 1, 1.0), (2, 2, float("nan")), (3, 3, 2.0)], 1, 0.1)[3] == 4


COLS = ["x", "y"]


def test_scaler_state_of_a_stream(spark):
    rng = random.Random(1)
    rows = [(i, None if i % 50 == 7 else i % 4, rng.random() * 10, None if i % 9 == 0 else float(i % 5), i % 3) for i in range(300)]
    table = spark.createDataFrame(rows + [(1000, 99, 1.0, 1.0, 0)], "id long, prompt_id long, x double, y double, part int")
    folder, state_folder = scratch_path(spark, "test-scaler"), scratch_path(spark, "test-state")
    in_files(spark, table, folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    state = scaler_stream.fit_stream(spark, stream, COLS, folder=state_folder)
    rows_of = lambda df: sorted(map(tuple, df.select("prompt_id", "n_rows", "mn_x", "mx_x", "mn_y", "mx_y").collect()), key=repr)
    want = rows_of(scale.fit_minmax(table, COLS))
    assert rows_of(state) == want and len(scaler_stream.versions(spark, state_folder)) == 2
    # the last batch once more, as after a failure between its write and its commit
    last = scaler_stream.versions(spark, state_folder)[-1]
    files = sorted(r["f"] for r in spark.read.parquet(folder).select(F.input_file_name().alias("f")).distinct().collect())
    before = scaler_stream.saved_state(spark, state_folder, last)
    replayed = None
    for f in files:  # whichever file was last
        scaler_stream.merge_batch(scratch_path(spark, "test-other"), COLS)(spark.read.parquet(f), 0)
        part = scale.merge_minmax(before.unionByName(scale.fit_minmax(spark.read.parquet(f), COLS)), COLS)
        if rows_of(part) == want:
            replayed = f
    scaler_stream.merge_batch(state_folder, COLS)(spark.read.parquet(replayed), last)
    scaler_stream.merge_batch(state_folder, COLS)(spark.read.parquet(replayed), last)
    assert rows_of(scaler_stream.saved_state(spark, state_folder)) == want
    state = scaler_stream.saved_state(spark, state_folder)
    # transform: equal to the one-shot operator on the fitted rows, defined for others
    key = lambda df: sorted(((r["id"], round(r["x"], 9), None if r["y"] is None else round(r["y"], 9)) for r in df.collect()))
    fitted = table.where("prompt_id is not null")
    assert key(scale.apply_minmax(fitted, state, COLS).fillna(0.0)) == key(scale.minmax_by_group(fitted, COLS).fillna(0.0))
    new = spark.createDataFrame([(1, 77, 5.0, 5.0), (2, 99, 9.0, 9.0), (3, 0, 1000.0, 2.0)], "id long, prompt_id long, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in scale.apply_minmax(new, state, COLS).collect()}
    assert got[1] == (0.0, 0.0) and got[2] == (0.0, 0.0) and got[3][0] > 1


def test_feature_stream_state_is_the_tables(spark):
    state = scaler_stream.fit_stream(spark, features_stream.basic_features(spark, SF001), features_stream.BASIC)
    from respscore.plans.q_profile import basic_features
    want = scale.fit_minmax(basic_features(spark, SF001), features_stream.BASIC)
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, want.select(*state.columns).collect()))
    assert FX.table(spark, SF001, "documents").count() == sum(r["n_rows"] for r in state.collect())
