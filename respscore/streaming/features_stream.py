"""Structured Streaming use of the library.

* ``stream_basic_features``: responses arriving as Parquet files get their
  row-local counts and ratios against a static prompt table (stream-static
  join); nothing is kept in state.
* ``stream_plateau``: loss events arriving per run feed the early-stop rule
  (E7) through ``applyInPandasWithState``; the state per run is four numbers
  (best loss, counter, steps seen, fired), and a run emits one row when the
  rule fires.  Events are put in order inside a micro-batch; between micro-batches
  the files have to arrive in event order.

Both write to a sink under the shared checkpoint folder with their own
streaming checkpoint, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators import features as FE
from ..session import scratch_path
from ..sources import fixtures as FX


def _file_stream(spark: SparkSession, sf_dir: str, name: str, files_at_once: int | None = None) -> DataFrame:
    """All files of a table as one stream: the part files of a folder, or the one file of that name.

    What is there when the query starts comes in one micro-batch; files that come later follow in the order of
    their arrival.
    """
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _run_to_table(spark: SparkSession, df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    out, ckpt = scratch_path(spark, name), scratch_path(spark, name + "-ckpt")
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
           .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out)


BASIC = ["text_word_cnt", "text_length", "text_stopword_cnt", "text_punct_cnt", "text_different_word_cnt",
         "text_word_ratio", "text_length_ratio", "text_stopword_ratio", "text_punct_ratio",
         "text_different_word_ratio"]


def basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature stream: response_id, prompt_id and the counts and ratios of each response that arrives."""
    docs = _file_stream(spark, sf_dir, "documents")
    n_prompts = FX.table(spark, sf_dir, "benchmark").count()
    r = docs.select(F.col("doc_id").alias("response_id"), (F.col("doc_id") % n_prompts).alias("prompt_id"),
                    "text")
    p = FE.prompt_features(FX.prompts(spark, sf_dir), grams=(), keep_text=False).drop("prompt_text_nostop")
    j = FE.ratios(FE.join_prompts(FE.response_counts(r), p))
    return j.select("response_id", "prompt_id", *[F.col(c).cast("double").alias(c) for c in BASIC])


def stream_basic_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_to_table(spark, basic_features(spark, sf_dir), "stream-features")


STATE_SCHEMA = "best double, cnt long, steps long, fired boolean"
OUT_SCHEMA = "run_id long, stop_step long"


def plateau_state_fn(patience: int, delta: float):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, cnt, steps, fired = state.get if state.exists else (float("inf"), 0, 0, False)
        batch = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        out = []
        for v in batch["value"].tolist():
            steps += 1
            if fired or v is None or v != v:   # NaN / missing losses do not count as steps of the rule
                continue
            if v < best:
                best, cnt = v, 0
            elif v > best + delta:
                cnt += 1
                if cnt >= patience:
                    fired = True
                    out.append((int(key[0]), steps))
        state.update((float(best), int(cnt), int(steps), bool(fired)))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "stop_step"])

    return fn


def stream_plateau(spark: SparkSession, sf_dir: str, patience: int = 8, delta: float = 0.003) -> DataFrame:
    ev = _file_stream(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run_id"), "value")
    fired = ev.groupBy("run_id").applyInPandasWithState(
        plateau_state_fn(patience, delta), OUT_SCHEMA, STATE_SCHEMA, "append", "NoTimeout")
    stops = _run_to_table(spark, fired, "stream-plateau")
    runs = FX.table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id")).distinct()
    return runs.join(stops, "run_id", "left")
