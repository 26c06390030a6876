"""A training corpus from raw documents: quality, near-duplicates, repeated passages, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns the columns of
``documents``, but for the last one, which returns the pieces of packed sequences.  Between stages the documents are
written as Parquet in the shared checkpoint folder and read again.

Defined results.  Nulls: a null text counts as empty; it has a score like any other text, is never a near-duplicate, stays null
when passages are removed, takes no part in the mix (0 words), and packs to its end token; a null ``doc_id`` is an id of its own
that sorts last; null ``lang``, ``source`` (the last source) and ``n_chars`` are kept.  Empty texts: as null ones, but empty.
Long texts are worked whole in every stage.  Ties: near-duplicates keep the smallest id, then the first digest; equal scores are
judged alike.  Repeated rows: one stays after the second stage.  Empty table: every stage returns no rows, and the last one no
pieces.  Further columns, of whatever name, are carried through unchanged by all stages but the last, which returns its own; ``n_chars``
is counted anew when a text loses passages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from respscore.llm.cover_dedup import remove_repeats
from respscore.llm.fair_mix import mixed_documents
from respscore.llm.hyperminhash import keep_one
from respscore.llm.neighbour_quality import keep_quality
from respscore.llm.packing import pack
from respscore.llm.tokens import tokenizer_path
from respscore.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes or more that occur more than once."""
    return remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, repeated as often as it takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages),
          ("source_mix", source_mix), ("packing", packing)]

#: Tokenizers, sketches and the classifier are beyond SQL; tests/llm/test_pipeline.py has the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs, f"pipeline-{name}")
    return docs
