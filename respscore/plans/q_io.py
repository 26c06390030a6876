"""Queries for sources and sinks: each writes with Spark, reads back, and returns what it read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as SA
from ..session import scratch_path
from ..sources import fixtures as FX
from ..sources import io as IO
from .q_metrics import LL
from .q_profile import BASIC, BASIC_SQL, basic_features
from .q_sampling import LAB, labelled_ids
from .registry import register, rounded
from ..operators import metrics as ME


@register("csv_roundtrip", FX.with_views("prompts") + """
SELECT prompt_id, prompt_text, prompt_title, prompt_question FROM prompts""")
def q_csv_roundtrip(spark, sf):
    """A1: prompts (multi-line, quoted text) -> CSV -> read back with a declared schema."""
    path = scratch_path(spark, "prompts_csv")
    IO.write_csv(FX.prompts(spark, sf), path)
    return IO.read_csv(spark, path, IO.PROMPT_SCHEMA)


@register("feature_table_roundtrip", BASIC_SQL + "SELECT response_id, prompt_id, " +
          ", ".join(f"round({c}, 6) AS {c}" for c in BASIC) + " FROM basic")
def q_feature_table_roundtrip(spark, sf):
    """A2 / A4: feature table -> Parquet partitioned by prompt -> read back."""
    path = scratch_path(spark, "features")
    IO.write_table(rounded(basic_features(spark, sf)), path)
    back = spark.read.parquet(path)
    return back.select("response_id", F.col("prompt_id").cast("long").alias("prompt_id"), *BASIC)


@register("runs_append", LL + """
SELECT run_id, round(arg_max(loss, step), 6) AS last_loss, round(min(loss), 6) AS best_loss,
       max(step) AS epochs FROM loss_log GROUP BY run_id""")
def q_runs_append(spark, sf):
    """Result rows appended in two writes to one CSV folder, read back whole."""
    s = rounded(ME.run_summary(FX.loss_log(spark, sf)).drop("best_step"))
    path = scratch_path(spark, "runs_csv")
    IO.write_csv(s.where(F.col("run_id") % 2 == 0), path, mode="append")
    IO.write_csv(s.where(F.col("run_id") % 2 == 1), path, mode="append")
    schema = "run_id bigint, last_loss double, best_loss double, epochs int"
    return spark.read.schema(schema).options(**IO.CSV_OPTS).csv(path)


@register("runs_json", LAB + """
SELECT CAST(dense_rank() OVER (ORDER BY prompt_id) AS BIGINT) AS fold, prompt_id, count(*) AS n_valid,
       CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train FROM lab GROUP BY prompt_id""")
def q_runs_json(spark, sf):
    """Fold records appended as JSON lines in two writes, read back whole."""
    f = SA.logo_folds(labelled_ids(spark, sf))
    path = scratch_path(spark, "folds_json")
    IO.append_json(f.where(F.col("fold") <= 20), path)
    IO.append_json(f.where(F.col("fold") > 20), path)
    return spark.read.schema("fold bigint, prompt_id bigint, n_valid bigint, n_train bigint").json(path)


@register("submission", FX.with_views("predictions") + """
SELECT response_id, round(p_content, 6) AS content, round(p_wording, 6) AS wording FROM predictions""")
def q_submission(spark, sf):
    """(id, content, wording) written as CSV and read back."""
    p = rounded(FX.predictions(spark, sf)).select(
        "response_id", F.col("p_content").alias("content"), F.col("p_wording").alias("wording"))
    path = scratch_path(spark, "submission")
    IO.write_csv(IO.submission(p), path)
    return spark.read.schema("response_id bigint, content double, wording double").options(**IO.CSV_OPTS).csv(path)
