"""Queries for the string functions (S1-S18), the join (C1) and ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as FE
from ..sources import fixtures as FX
from . import duck as D
from .registry import register, rounded

R = FX.with_views("responses")
RP = FX.with_views("responses", "prompts")


@register("join_prompts", RP + """
SELECT r.response_id, r.prompt_id, p.prompt_title, p.prompt_question,
       CAST(length(r.text) AS BIGINT) AS text_length, CAST(length(p.prompt_text) AS BIGINT) AS prompt_length
FROM responses r JOIN prompts p ON r.prompt_id = p.prompt_id""")
def q_join_prompts(spark, sf):
    j = FE.join_prompts(FX.responses(spark, sf), FX.prompts(spark, sf))
    return j.select("response_id", "prompt_id", "prompt_title", "prompt_question",
                    T.char_len("text").alias("text_length"),
                    T.char_len("prompt_text").alias("prompt_length"))


@register("clean_text", R + f"""
SELECT response_id, {D.clean('text')} AS clean, {D.clean('text', True)} AS clean_lower FROM responses""")
def q_clean_text(spark, sf):
    r = FX.responses(spark, sf)
    return r.select("response_id", T.clean("text").alias("clean"),
                    T.clean("text", lower=True).alias("clean_lower"))


@register("remove_stopwords", R + f"""
SELECT response_id, {D.preprocess('text')} AS text_nostop FROM responses""")
def q_remove_stopwords(spark, sf):
    return FX.responses(spark, sf).select("response_id", T.preprocess("text").alias("text_nostop"))


def _scalar(name, col_fn, sql_fn, out):
    register(name, R + f"SELECT response_id, {sql_fn('text')} AS {out} FROM responses")(
        lambda spark, sf: FX.responses(spark, sf).select("response_id", col_fn("text").alias(out)))


_scalar("word_cnt", T.word_cnt, D.word_cnt, "text_word_cnt")
_scalar("char_len", T.char_len, D.char_len, "text_length")
_scalar("stopword_cnt", T.stopword_cnt, D.stopword_cnt, "text_stopword_cnt")
_scalar("punct_cnt", T.punct_cnt, D.punct_cnt, "text_punct_cnt")
_scalar("token_cnt", T.token_cnt, D.token_cnt, "text_pos")
_scalar("distinct_words_v1", lambda t: T.distinct_words(T.clean(t)),
        lambda t: D.distinct_words(D.clean(t)), "text_different_word_cnt")


@register("ratios", RP + f"""
, j AS (SELECT r.response_id, r.text, p.prompt_text FROM responses r JOIN prompts p ON r.prompt_id = p.prompt_id)
SELECT response_id,
  round({D.ratio(D.word_cnt('text'), D.word_cnt('prompt_text'))}, 6) AS text_word_ratio,
  round({D.ratio(D.char_len('text'), D.char_len('prompt_text'))}, 6) AS text_length_ratio,
  round({D.ratio(D.stopword_cnt('text'), D.stopword_cnt('prompt_text'))}, 6) AS text_stopword_ratio,
  round({D.ratio(D.punct_cnt('text'), D.punct_cnt('prompt_text'))}, 6) AS text_punct_ratio,
  round({D.ratio(D.distinct_words(D.clean('text')), D.distinct_words(D.clean('prompt_text')))}, 6)
      AS text_different_word_ratio
FROM j""")
def q_ratios(spark, sf):
    p = FE.prompt_features(FX.prompts(spark, sf), grams=(), keep_text=False).drop("prompt_text_nostop")
    r = FE.response_counts(FX.responses(spark, sf).select("response_id", "prompt_id", "text"))
    j = FE.ratios(FE.join_prompts(r, p))
    return rounded(j.select("response_id", *[f"text_{n}" for _, n in FE.RATIO_PAIRS]))


@register("length_ratio_v2", RP + f"""
SELECT r.response_id, round({D.ratio(D.char_len('r.text'), D.stopword_cnt('p.prompt_text'))}, 6) AS length_ratio
FROM responses r JOIN prompts p ON r.prompt_id = p.prompt_id""")
def q_length_ratio_v2(spark, sf):
    """B10 as written: characters of the response / stopword count of the prompt."""
    p = FX.prompts(spark, sf).select("prompt_id", T.stopword_cnt("prompt_text").alias("prompt_length"))
    r = FX.responses(spark, sf).select("response_id", "prompt_id", "text")
    j = r.join(p, "prompt_id")
    return rounded(j.select("response_id", T.ratio(T.char_len("text"), "prompt_length").alias("length_ratio")))


@register("word_tokens", R + f"""
SELECT response_id, CAST(len(tok) AS BIGINT) AS n_tokens, array_to_string(tok, '|') AS tokens
FROM (SELECT response_id, {D.word_tokens(D.clean('text'))} AS tok FROM responses)""")
def q_word_tokens(spark, sf):
    r = FX.responses(spark, sf).select("response_id", T.word_tokens(T.clean("text")).alias("tok"))
    return r.select("response_id", F.size("tok").cast("long").alias("n_tokens"),
                    F.array_join("tok", "|").alias("tokens"))


@register("model_input", RP + """
SELECT r.response_id, '[CLS] ' || p.prompt_question || ' [SEP] ' || p.prompt_title || ' [SEP] ' || r.text || ' [SEP]'
       AS model_input
FROM responses r JOIN prompts p ON r.prompt_id = p.prompt_id""")
def q_model_input(spark, sf):
    j = FE.join_prompts(FX.responses(spark, sf), FX.prompts(spark, sf))
    return j.select("response_id",
                    T.model_input(["prompt_question", "prompt_title", "text"]).alias("model_input"))


@register("centre_window", R + r"""
, s AS (SELECT response_id, text, string_split(text, chr(10)) AS paras FROM responses)
, c AS (SELECT response_id, text, CASE WHEN len(paras) >= 3
          THEN instr(text, paras[len(paras) // 2 + 2]) - 1 END AS centre FROM s)
, t AS (SELECT response_id, centre,
          regexp_extract_all(substr(text, 1, centre), '\w+|[^\w\s]') AS a,
          regexp_extract_all(substr(text, centre + 1), '\w+|[^\w\s]') AS b FROM c)
SELECT response_id, CAST(centre AS BIGINT) AS centre,
       CASE WHEN centre IS NOT NULL THEN array_to_string(
         list_concat(a[greatest(len(a) - 255, 1):len(a)], b[1:256]), ' ') END AS window_text
FROM t""")
def q_centre_window(spark, sf):
    """Cut at paragraph n/2+1, keep the last 256 tokens before and 256 after."""
    r = FX.responses(spark, sf).select("response_id", "text")
    paras = F.split("text", "\n")
    c = r.withColumn("centre", F.when(F.size(paras) >= 3, F.instr(
        "text", F.element_at(paras, (F.floor(F.size(paras) / 2) + 2).cast("int"))) - 1))
    tok = F.lit(T.TOKEN_PATTERN)
    t = c.select("response_id", "centre",
                 F.regexp_extract_all(F.substring("text", F.lit(1), F.col("centre")), tok, 0).alias("a"),
                 F.regexp_extract_all(F.expr("substring(text, centre + 1)"), tok, 0).alias("b"))
    win = F.concat(F.slice("a", F.greatest(F.size("a") - 255, F.lit(1)), 256), F.slice("b", 1, 256))
    return t.select("response_id", F.col("centre").cast("long").alias("centre"),
                    F.when(F.col("centre").isNotNull(), F.array_join(win, " ")).alias("window_text"))


_scalar("entity_cnt", T.entity_cnt, D.entity_cnt, "entities")


@register("pair_features", FX.with_views("pairs") + f"""
SELECT conv_id, turn, {D.word_cnt('text')} AS text_word_cnt, {D.stopword_cnt('text')} AS text_stopword_cnt,
  round({D.ratio(D.word_cnt('text'), D.word_cnt('prompt_text'))}, 6) AS text_word_ratio,
  round({D.ratio(D.char_len('text'), D.char_len('prompt_text'))}, 6) AS text_length_ratio,
  round({D.ratio(D.punct_cnt('text'), D.punct_cnt('prompt_text'))}, 6) AS text_punct_ratio,
  round({D.ratio(D.distinct_words(D.clean('text')), D.distinct_words(D.clean('prompt_text')))}, 6)
    AS text_different_word_ratio
FROM pairs""")
def q_pair_features(spark, sf):
    """Phase-0 features on the second source: assistant turns against the latest user turn."""
    p = FX.pairs(spark, sf)
    return rounded(p.select(
        "conv_id", "turn", T.word_cnt("text").alias("text_word_cnt"),
        T.stopword_cnt("text").alias("text_stopword_cnt"),
        T.ratio(T.word_cnt("text"), T.word_cnt("prompt_text")).alias("text_word_ratio"),
        T.ratio(T.char_len("text"), T.char_len("prompt_text")).alias("text_length_ratio"),
        T.ratio(T.punct_cnt("text"), T.punct_cnt("prompt_text")).alias("text_punct_ratio"),
        T.ratio(T.distinct_words(T.clean("text")), T.distinct_words(T.clean("prompt_text")))
        .alias("text_different_word_ratio")))


SUBWORD_SQL = FX.with_views("responses", "dictionary").replace("WITH", "WITH RECURSIVE", 1) + r"""
, ch AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(word, '')) AS c FROM dictionary) WHERE c <> '')
, vb AS (SELECT word AS p FROM dictionary UNION SELECT c FROM ch)
, vc AS MATERIALIZED (SELECT p AS piece FROM vb UNION SELECT '##' || p FROM vb)
, lg AS (SELECT max(length(piece)) AS l FROM vc)
, tk AS (SELECT response_id, unnest(regexp_extract_all(text, '\w+|[^\w\s]')) AS word FROM responses)
, seg AS (SELECT DISTINCT word, 0 AS pos, 0 AS n FROM tk
    UNION ALL SELECT word, CAST(pos + max(k) AS INTEGER), n + 1 FROM (SELECT word, pos, n, unnest(range(1, least(length(word) - pos, l) + 1)) AS k
    FROM seg, lg WHERE pos < length(word)) x JOIN vc ON vc.piece = (CASE WHEN n > 0 THEN '##' ELSE '' END) || substr(word, CAST(pos + 1 AS BIGINT), k) GROUP BY word, pos, n)
, done AS (SELECT word, n FROM seg WHERE pos = length(word))
, per AS (SELECT response_id, sum(coalesce(done.n, 1)) AS c FROM tk LEFT JOIN done USING (word) GROUP BY response_id)
SELECT r.response_id, CAST(coalesce(c, 0) AS BIGINT) AS tokenized_text_len FROM responses r LEFT JOIN per USING (response_id)"""


@register("subword_len", SUBWORD_SQL)
def q_subword_len(spark, sf):
    """Sub-word length of each response by greedy longest match."""
    from ..operators import batching as BA
    from ..operators import subword as SW
    vocab = SW.wordpiece_vocab(FX.dictionary(spark, sf))
    r = FX.responses(spark, sf).select("response_id", BA.basic_tokens("text").alias("tok"))
    return SW.subword_len(r, "response_id", "tok", vocab, out="tokenized_text_len")
