"""Length-bucketed batches, padding and model sequences.

Sequences are arrays of token strings (token ids need a vocabulary the
reference downloads; any id lookup is a join on this column).  Ranks come from
range partitions (``ranking``), never from one global sort task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import hex_hash, rank_by_id, rank_within

CLS, SEP, PAD = "[CLS]", "[SEP]", "[PAD]"


def basic_tokens(col) -> Column:
    """Word runs and single marks (the tokenizer stand-in)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(T.TOKEN_PATTERN), 0)


def length_batches(df: DataFrame, key: str, length: str, batch_size: int = 8) -> DataFrame:
    """Global rank by (length, md5(key), key), cut into batches of ``batch_size``.

    Adds ``rank`` (1-based) and ``batch_id`` (0-based).
    """
    d = df.withColumn("_h", hex_hash(key))
    r = rank_within(d, order=[length, "_h", key], out="rank")
    return r.drop("_h").withColumn("batch_id", F.floor((F.col("rank") - 1) / batch_size).cast("long"))


def input_batches(df: DataFrame, key: str, batch_size: int = 8) -> DataFrame:
    """E2 for evaluation: batches of ``batch_size`` rows in the order of ``key``; adds ``rank`` and ``batch_id``."""
    r = rank_by_id(df, key)
    return r.withColumn("batch_id", F.floor((F.col("rank") - 1) / batch_size).cast("long"))


def shuffled_batches(batches: DataFrame, seed: int = 42) -> DataFrame:
    """Batch order shuffled by md5(batch_id#seed); the last (longest) batch stays last.

    Returns (batch_id, batch_pos) with 1-based positions.
    """
    b = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("size"))
    last = b.agg(F.max("batch_id")).scalar()  # uncorrelated scalar subquery, no join
    b = b.withColumn("_is_last", (F.col("batch_id") == last).cast("int")).withColumn(
        "_h", hex_hash("batch_id", seed=seed))
    r = rank_within(b, order=["_is_last", "_h", "batch_id"], out="batch_pos")
    return r.select("batch_id", "size", "batch_pos")


def emit_order(batched: DataFrame, order: DataFrame, batch_size: int) -> DataFrame:
    """Position of each row in the emitted stream and its input position.

    Every batch but the last has ``batch_size`` rows and the last is emitted
    last, so ``emit_pos`` is arithmetic on (batch_pos, rank).  ``input_pos`` is
    the row's rank by key; backsorting = ordering emitted rows by ``input_pos``.
    """
    e = batched.join(order.select("batch_id", "batch_pos"), "batch_id")
    emit = (F.col("batch_pos") - 1) * batch_size + (F.col("rank") - F.col("batch_id") * batch_size)
    return e.withColumn("emit_pos", emit.cast("long"))


def pad_and_mask(batched: DataFrame, tokens: str, max_len: int = 512) -> DataFrame:
    """L2: pad each sequence to min(longest in its batch, max_len), truncate, 0/1 mask."""
    w = Window.partitionBy("batch_id")  # a batch holds batch_size rows
    d = batched.withColumn("pad_len", F.least(F.max(F.size(tokens)).over(w), F.lit(max_len)))
    keep = F.least(F.size(tokens), F.col("pad_len"))
    padded = F.concat(F.slice(tokens, 1, keep), F.array_repeat(F.lit(PAD), F.col("pad_len") - keep))
    mask = F.concat(F.array_repeat(F.lit(1), keep), F.array_repeat(F.lit(0), F.col("pad_len") - keep))
    return d.withColumn("padded", padded).withColumn("mask", mask)


def padding_waste(batched: DataFrame, length: str, max_len: int = 512) -> DataFrame:
    """1 - real tokens / padded tokens per batch."""
    b = batched.groupBy("batch_id").agg(F.sum(F.least(F.col(length), F.lit(max_len))).alias("_real"),
                                        F.count(F.lit(1)).alias("_rows"),
                                        F.least(F.max(length), F.lit(max_len)).alias("_pad"))
    return b.select("batch_id", (1 - F.col("_real") / (F.col("_rows") * F.col("_pad"))).alias("waste"))


def joint_sequence(fields, max_len: int = 512, pad: bool = True) -> Column:
    """L3: [CLS] + (tokens + [SEP]) per field; padded to max_len when shorter, never cut."""
    seq = F.array(F.lit(CLS))
    for f in fields:
        seq = F.concat(seq, f, F.array(F.lit(SEP)))
    if pad:
        seq = F.when(F.size(seq) < max_len,
                     F.concat(seq, F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size(seq)))).otherwise(seq)
    return seq


def field_sequence(tokens, max_len: int = 64) -> Column:
    """L4 as written: [CLS] + tokens; shorter than max_len -> pads then [SEP]
    (length max_len + 1); otherwise cut to max_len - 1 then [SEP]."""
    t = F.concat(F.array(F.lit(CLS)), tokens)
    return F.when(F.size(t) < max_len,
                  F.concat(t, F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size(t)), F.array(F.lit(SEP)))
                  ).otherwise(F.concat(F.slice(t, 1, max_len - 1), F.array(F.lit(SEP))))


def input_positions(df: DataFrame, key: str) -> DataFrame:
    """Rank of each row by its unique key (the input order)."""
    return rank_by_id(df, key, out="input_pos")
