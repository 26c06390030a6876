"""Token counts through a digest cache.

A count is stored under the digest of the normalised content and the digest of the tokenizer file.
A run joins its documents to the stored counts, encodes each distinct miss once, appends the new
counts, and reads every document's count from the cache.

Normalising must not change a count.  Runs of ASCII white space become one blank (the tokenizer drops white
space).  Texts of ASCII alone, without ``<|`` (which starts the special strings, matched before the tokenizer
lower-cases), are lower-cased; other texts are not, since lower-casing before composing can compose more.

Defined results: a null text counts as empty (0 bytes, 0 tokens); texts are encoded whole; copies share
one cache row; repeated rows each get their row; an empty table gives an empty result; only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respscore.llm.common import arrow_rows, shuffle_width, small_batches
from respscore.llm.tokens import tokenizer_path, worker_encoder
from respscore.session import scratch_path

CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, normalised content and its digest."""
    text = F.coalesce(docs["text"], F.lit(""))
    whole = F.col("text")
    plain = (F.octet_length(whole) == F.length(whole)) & ~whole.contains("<|")
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"),
                        F.octet_length(text).cast("long").alias("n_bytes"))
            .withColumn("content", F.regexp_replace(F.when(plain, F.lower(whole)).otherwise(whole), r"[\x20\x09-\x0D]+", " "))
            .select("doc_id", "n_bytes", "content", F.sha2("content", 256).alias("digest")))


def _first(batches):
    """Rows whose digest is new in this task, so that a text copied a million times is shuffled once for each task."""
    seen = set()
    for batch in batches:
        fresh = []
        for i, digest in enumerate(batch.column(0).to_pylist()):
            if digest not in seen:
                seen.add(digest)
                fresh.append(i)
        yield batch.take(pa.array(fresh, pa.int64()))


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """Counts of one tokenizer version, or None if nothing was ever stored."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill(docs: DataFrame, cache: str, path: str) -> None:
    """Encode the distinct contents that the cache lacks and append their counts."""
    spark, version = docs.sparkSession, file_digest(path)

    def counted(batches):
        encoder = worker_encoder(path, True)
        for batch in small_batches(_first(batches), size="content"):
            rows = list(arrow_rows(batch, "digest", "content"))
            found = encoder.encode([content.encode() for _, content in rows])
            yield pa.RecordBatch.from_pydict({
                "tokenizer": pa.array([version] * len(rows), pa.string()), "digest": pa.array([d for d, _ in rows], pa.string()),
                "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64())})

    contents = (keyed(docs).select("digest", "content").mapInArrow(_first, "digest string, content string")
                .repartition(shuffle_width(spark), "digest"))
    known = stored(spark, cache, version)
    misses = contents if known is None else contents.join(known, "digest", "left_anti")
    misses.select("digest", "content").mapInArrow(counted, CACHE_SCHEMA).write.mode("append").parquet(cache)


def token_counts(docs: DataFrame, cache: str, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every document, filling the cache first."""
    fill(docs, cache, path)
    return (keyed(docs).select("doc_id", "n_bytes", "digest")
            .join(stored(docs.sparkSession, cache, file_digest(path)), "digest").select("doc_id", "n_bytes", "n_tokens"))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts for word_bpe_49k.json over a cache that starts empty, so every run encodes all distinct texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = token_counts(docs, scratch_path(spark, "token-cache"), tokenizer_path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
