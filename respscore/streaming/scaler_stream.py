"""The min-max scaler (E1) fitted on a stream, and applied to other rows.

Each micro-batch writes one version of the state: the state before it, merged with the minima, maxima and row counts of its own
rows.  A version is named by its batch id and written as a whole, and it starts from the newest version with a smaller id, so a
batch that is run again after a failure writes the same table again: counts do not grow twice.  The two newest versions stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import scale as SC
from ..session import remove_folder, scratch_path, subfolders

VERSION = "version="


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[len(VERSION):]) for n in subfolders(spark, folder) if n.startswith(VERSION))


def saved_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest version (older than ``before``), or None."""
    found = [v for v in versions(spark, folder) if before is None or v < before]
    return spark.read.parquet(f"{folder}/{VERSION}{found[-1]}") if found else None


def merge_batch(folder: str, cols, group: str = "prompt_id"):
    """The function for ``foreachBatch``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state, before = SC.fit_minmax(batch, cols, group), saved_state(spark, folder, batch_id)
        if before is not None:
            state = SC.merge_minmax(before.unionByName(state), cols, group)
        state.write.mode("overwrite").parquet(f"{folder}/{VERSION}{batch_id}")
        for old in versions(spark, folder)[:-2]:
            remove_folder(spark, f"{folder}/{VERSION}{old}")
    return run


def fit_stream(spark: SparkSession, rows: DataFrame, cols, group: str = "prompt_id", folder: str | None = None) -> DataFrame:
    """Work off the stream ``rows`` and return the state (``folder``: where its versions are kept)."""
    folder = folder or scratch_path(spark, "scaler")
    (rows.writeStream.foreachBatch(merge_batch(folder, cols, group)).option("checkpointLocation", scratch_path(spark, "scaler-ckpt"))
         .trigger(availableNow=True).start().awaitTermination())
    return saved_state(spark, folder)
