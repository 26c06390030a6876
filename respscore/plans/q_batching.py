"""Queries for batching and sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import batching as BA
from ..sources import fixtures as FX
from .registry import register, rounded

BS = 8
SEQ = FX.with_views("responses", "prompts") + r"""
, seqs AS (SELECT r.response_id, regexp_extract_all('[CLS] ' || p.prompt_question || ' [SEP] ' || r.text || ' [SEP]',
             '\w+|[^\w\s]') AS tok FROM responses r JOIN prompts p USING (prompt_id))
, lens AS (SELECT response_id, tok, len(tok) AS len FROM seqs)
, b AS (SELECT *, row_number() OVER (ORDER BY len, md5(CAST(response_id AS VARCHAR)), response_id) AS rank FROM lens)
, bb AS (SELECT *, (rank - 1) // 8 AS batch_id FROM b)
"""


def sequences(spark, sf):
    """(response_id, tok, len): tokens of ``[CLS] question [SEP] text [SEP]``."""
    j = FX.responses(spark, sf).select("response_id", "prompt_id", "text").join(
        FX.prompts(spark, sf).select("prompt_id", "prompt_question"), "prompt_id")
    tok = BA.basic_tokens(T.model_input(["prompt_question", "text"]))
    return j.select("response_id", tok.alias("tok")).withColumn("len", F.size("tok").cast("long"))


def batched(spark, sf):
    return BA.length_batches(sequences(spark, sf), "response_id", "len", BS)


def lengths(spark, sf):
    """(response_id, len): what ranks need, without the tokens."""
    return sequences(spark, sf).select("response_id", "len")


def batched_lengths(spark, sf):
    return BA.length_batches(lengths(spark, sf), "response_id", "len", BS)


@register("length_batches", SEQ + "SELECT response_id, CAST(len AS BIGINT) AS len, rank, batch_id FROM bb")
def q_length_batches(spark, sf):
    """Length-sorted batches via ranks over range partitions (no global single-task sort)."""
    return batched_lengths(spark, sf).select("response_id", "len", "rank", "batch_id")


@register("input_batches", SEQ + """
, ib AS (SELECT response_id, CAST(len AS BIGINT) AS len, row_number() OVER (ORDER BY response_id) AS rank FROM lens)
SELECT *, (rank - 1) // 8 AS batch_id FROM ib""")
def q_input_batches(spark, sf):
    """E2 for evaluation: batches in input order, no sorting by length."""
    return BA.input_batches(lengths(spark, sf), "response_id", BS).select("response_id", "len", "rank", "batch_id")


SHUF = SEQ + """
, bs AS (SELECT batch_id, count(*) AS size FROM bb GROUP BY batch_id)
, sh AS (SELECT batch_id, size, row_number() OVER (ORDER BY CASE WHEN batch_id = (SELECT max(batch_id) FROM bs)
           THEN 1 ELSE 0 END, md5(CAST(batch_id AS VARCHAR) || '#42'), batch_id) AS batch_pos FROM bs)
"""


@register("shuffled_batches", SHUF + "SELECT batch_id, size, batch_pos FROM sh")
def q_shuffled_batches(spark, sf):
    """Shuffled batch order, last batch kept last."""
    return BA.shuffled_batches(batched_lengths(spark, sf))


@register("backsort", SHUF + """
SELECT response_id, row_number() OVER (ORDER BY response_id) AS input_pos,
       CAST((batch_pos - 1) * 8 + (rank - batch_id * 8) AS BIGINT) AS emit_pos
FROM bb JOIN sh USING (batch_id)""")
def q_backsort(spark, sf):
    """Emitted position and input position of every row (a permutation pair)."""
    b = batched_lengths(spark, sf)
    e = BA.emit_order(b, BA.shuffled_batches(b), BS)
    return BA.input_positions(e, "response_id").select("response_id", "input_pos", "emit_pos")


@register("pad_and_mask", SEQ + """
, p AS (SELECT *, least(max(len) OVER (PARTITION BY batch_id), 512) AS pad_len FROM bb)
, k AS (SELECT *, least(len, pad_len) AS keep FROM p)
SELECT response_id, batch_id, CAST(pad_len AS INTEGER) AS pad_len,
  array_to_string(list_concat(tok[1:keep], list_transform(range(pad_len - keep), lambda x: '[PAD]')), ' ') AS padded,
  repeat('1', CAST(keep AS BIGINT)) || repeat('0', CAST(pad_len - keep AS BIGINT)) AS mask FROM k""")
def q_pad_and_mask(spark, sf):
    """L2: padded token sequences and attention masks per length batch."""
    p = BA.pad_and_mask(batched(spark, sf), "tok", 512)
    return p.select("response_id", "batch_id", F.col("pad_len").cast("int").alias("pad_len"),
                    F.array_join("padded", " ").alias("padded"),
                    F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"))


@register("padding_waste", SEQ + """
SELECT batch_id, round(1 - sum(least(len, 512)) / (count(*) * least(max(len), 512)), 6) AS waste
FROM bb GROUP BY batch_id""")
def q_padding_waste(spark, sf):
    return rounded(BA.padding_waste(batched_lengths(spark, sf), "len", 512))


@register("joint_sequence", FX.with_views("responses", "prompts") + r"""
, t AS (SELECT response_id, list_concat(['[CLS]'], regexp_extract_all(p.prompt_question, '\w+|[^\w\s]'), ['[SEP]'],
          regexp_extract_all(r.text, '\w+|[^\w\s]'), ['[SEP]']) AS s FROM responses r JOIN prompts p USING (prompt_id))
, u AS (SELECT response_id, CASE WHEN len(s) < 512 THEN list_concat(s, list_transform(range(512 - len(s)),
          lambda x: '[PAD]')) ELSE s END AS s FROM t)
SELECT response_id, CAST(len(s) AS INTEGER) AS seq_len, array_to_string(s, ' ') AS seq FROM u""")
def q_joint_sequence(spark, sf):
    """L3: [CLS] question [SEP] text [SEP], padded to 512 when shorter, never cut."""
    j = FX.responses(spark, sf).select("response_id", "prompt_id", "text").join(
        FX.prompts(spark, sf).select("prompt_id", "prompt_question"), "prompt_id")
    s = BA.joint_sequence([BA.basic_tokens("prompt_question"), BA.basic_tokens("text")], 512)
    return j.select("response_id", s.alias("s")).select(
        "response_id", F.size("s").alias("seq_len"), F.array_join("s", " ").alias("seq"))


@register("field_sequence", FX.with_views("responses") + r"""
, t AS (SELECT response_id, list_concat(['[CLS]'], regexp_extract_all(text, '\w+|[^\w\s]')) AS s FROM responses)
, u AS (SELECT response_id, CASE WHEN len(s) < 64 THEN list_concat(s, list_transform(range(64 - len(s)),
          lambda x: '[PAD]'), ['[SEP]']) ELSE list_concat(s[1:63], ['[SEP]']) END AS s FROM t)
SELECT response_id, CAST(len(s) AS INTEGER) AS seq_len, array_to_string(s, ' ') AS seq FROM u""")
def q_field_sequence(spark, sf):
    """L4 as written: per-field sequence of length 65 when padded, 64 when cut."""
    r = FX.responses(spark, sf).select("response_id", BA.field_sequence(BA.basic_tokens("text"), 64).alias("s"))
    return r.select("response_id", F.size("s").alias("seq_len"), F.array_join("s", " ").alias("seq"))


TRAIN_SQL = FX.with_views("responses", "prompts", "scores") + r"""
, lab AS (SELECT response_id, prompt_id FROM responses WHERE response_id IN (SELECT response_id FROM scores))
, rk0 AS (SELECT *, row_number() OVER (PARTITION BY prompt_id
           ORDER BY md5(CAST(response_id AS VARCHAR) || '#42'), response_id) AS r,
         count(*) OVER (PARTITION BY prompt_id) AS n FROM lab)
, k AS (SELECT *, ceil(n * CAST(0.2 AS DOUBLE)) AS k1 FROM rk0)
, tr AS (SELECT response_id, prompt_id FROM k WHERE r > k1 + ceil((n - k1) * CAST(0.2 AS DOUBLE)))
, rk AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY md5(CAST(response_id AS VARCHAR)), response_id)
           AS r FROM tr)
, sizes AS (SELECT prompt_id, count(*) AS n FROM tr GROUP BY prompt_id)
, ord AS (SELECT *, row_number() OVER (ORDER BY n DESC, prompt_id) AS pos, max(n) OVER () AS most FROM sizes)
, draws AS (SELECT prompt_id, n, unnest(range(1, most + 1)) AS draw FROM ord WHERE pos > 1)
, picked AS (SELECT prompt_id, draw, CAST(('0x' || substr(md5(CAST(prompt_id AS VARCHAR) || '#' ||
               CAST(draw AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) % n + 1 AS r FROM draws)
, os AS (SELECT p.prompt_id, rk.response_id, p.draw FROM picked p JOIN rk USING (prompt_id, r)
         UNION ALL SELECT rk.prompt_id, rk.response_id, rk.r AS draw FROM rk JOIN ord USING (prompt_id) WHERE pos = 1)
, toks AS (SELECT os.*, CAST(os.prompt_id AS VARCHAR) || '#' || CAST(os.draw AS VARCHAR) AS row_key,
             len(regexp_extract_all('[CLS] ' || p.prompt_question || ' [SEP] ' || r.text || ' [SEP]', '\w+|[^\w\s]'))
             AS len FROM os JOIN responses r USING (response_id) JOIN prompts p ON p.prompt_id = os.prompt_id)
, ranked AS (SELECT *, row_number() OVER (ORDER BY len, md5(CAST(row_key AS VARCHAR)), row_key) AS rank FROM toks)
SELECT prompt_id, draw, response_id, CAST(len AS BIGINT) AS len, rank, (rank - 1) // 8 AS batch_id FROM ranked"""


@register("training_set", TRAIN_SQL)
def q_training_set(spark, sf):
    """P1 -> P2 on the train part -> S14 -> L1: oversampled, length-batched training rows."""
    from ..operators import sampling as SA
    from .q_sampling import labelled_ids
    split = SA.stratified_split(labelled_ids(spark, sf), "response_id")
    train = split.where(F.col("part") == "train").select("response_id", "prompt_id")
    os_ = SA.oversample(train, "response_id").select("prompt_id", "response_id", "draw")
    txt = FX.responses(spark, sf).select("response_id", "text")
    q = FX.prompts(spark, sf).select("prompt_id", "prompt_question")
    rows = os_.join(txt, "response_id").join(q, "prompt_id")
    rows = rows.select("prompt_id", "draw", "response_id",
                       F.concat_ws("#", "prompt_id", "draw").alias("row_key"),
                       F.size(BA.basic_tokens(T.model_input(["prompt_question", "text"]))).cast("long").alias("len"))
    b = BA.length_batches(rows, "row_key", "len", BS)
    return b.select("prompt_id", "draw", "response_id", "len", "rank", "batch_id")
