"""Readers and writers.

CSV is read with an explicit schema (no inference pass) and multi-line quoted
fields; tables are written as Parquet partitioned by prompt so a per-prompt
job reads only its folder.  Result logs are appended, never rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PROMPT_SCHEMA = T.StructType([T.StructField("prompt_id", T.LongType()),
                              T.StructField("prompt_text", T.StringType()),
                              T.StructField("prompt_title", T.StringType()),
                              T.StructField("prompt_question", T.StringType())])

RESPONSE_SCHEMA = T.StructType([T.StructField("student_id", T.StringType()),
                                T.StructField("prompt_id", T.StringType()),
                                T.StructField("text", T.StringType()),
                                T.StructField("content", T.DoubleType()),
                                T.StructField("wording", T.DoubleType())])

CSV_OPTS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: CSV with a header and ``"``-quoted fields that may span lines."""
    return spark.read.schema(schema).options(**CSV_OPTS).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header in every part file (append adds part files)."""
    df.write.mode(mode).options(**CSV_OPTS).csv(path)


def write_table(df: DataFrame, path: str, partition_by=("prompt_id",), mode: str = "errorifexists") -> None:
    """A4: Parquet, partitioned by prompt."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    """Append JSON records (one object per line)."""
    df.write.mode("append").json(path)


def submission(pred: DataFrame, key: str = "response_id") -> DataFrame:
    """The predictions file layout (id, content, wording)."""
    return pred.select(key, "content", "wording")
