"""Composite queries: the feature table (flagship), scaling, non-finite replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import scale as SC
from ..sources import fixtures as FX
from . import duck as D
from ..session import cut_lineage
from .feature_table import FEATURES, feature_table
from .feature_table_v2 import OUT_NAMES, SCALED, feature_table_v2
from .q_ngrams import _sql_grams
from .q_tfidf import TFIDF_BODY
from .q_vocab import COMPOUND_BODY, KNOWN_BODY, MISSPELLED_BODY, lemma_query
from .registry import register, rounded


def _grams(tok, n):
    return D.filter_edge_chars(D.ngrams(tok, n))


RAW_SQL = FX.with_views("responses", "prompts", "dictionary") + TFIDF_BODY + KNOWN_BODY + MISSPELLED_BODY + f"""
, pt AS (SELECT prompt_id, prompt_text, {D.word_tokens(D.clean('prompt_text'))} AS tok FROM prompts)
, pf AS (SELECT prompt_id, {D.word_cnt('prompt_text')} AS p_wc, {D.char_len('prompt_text')} AS p_len,
                {D.stopword_cnt('prompt_text')} AS p_sw, {D.punct_cnt('prompt_text')} AS p_pc,
                {D.distinct_words(D.clean('prompt_text'))} AS p_dw,
                {_grams('tok', 2)} AS pg2, {_grams('tok', 3)} AS pg3, {_grams('tok', 4)} AS pg4 FROM pt)
, rt AS (SELECT response_id, prompt_id, text, {D.word_tokens(D.clean('text'))} AS tok FROM responses)
, rf AS (SELECT response_id, prompt_id, {D.word_cnt('text')} AS text_word_cnt, {D.char_len('text')} AS text_length,
                {D.stopword_cnt('text')} AS text_stopword_cnt, {D.punct_cnt('text')} AS text_punct_cnt,
                {D.distinct_words(D.clean('text'))} AS text_different_word_cnt,
                {_grams('tok', 2)} AS rg2, {_grams('tok', 3)} AS rg3, {_grams('tok', 4)} AS rg4 FROM rt)
, raw AS (SELECT rf.response_id, rf.prompt_id,
      CAST(text_word_cnt AS DOUBLE) AS text_word_cnt, CAST(text_length AS DOUBLE) AS text_length,
      CAST(text_stopword_cnt AS DOUBLE) AS text_stopword_cnt, CAST(text_punct_cnt AS DOUBLE) AS text_punct_cnt,
      CAST(miss.text_misspelled_cnt AS DOUBLE) AS text_misspelled_cnt,
      CAST(text_different_word_cnt AS DOUBLE) AS text_different_word_cnt,
      {D.ratio('text_different_word_cnt', 'p_dw')} AS text_different_word_ratio,
      {D.ratio('text_word_cnt', 'p_wc')} AS text_word_ratio,
      {D.ratio('text_length', 'p_len')} AS text_length_ratio,
      {D.ratio('text_stopword_cnt', 'p_sw')} AS text_stopword_ratio,
      {D.ratio('text_punct_cnt', 'p_pc')} AS text_punct_ratio,
      karp_scores.karp_tfidf_scores,
      CAST(len(list_intersect(list_distinct(rg2), list_distinct(pg2))) AS DOUBLE) AS shared_2grams,
      CAST(len(list_intersect(list_distinct(rg3), list_distinct(pg3))) AS DOUBLE) AS shared_3grams,
      CAST(len(list_intersect(list_distinct(rg4), list_distinct(pg4))) AS DOUBLE) AS shared_4grams
    FROM rf JOIN pf USING (prompt_id) JOIN miss USING (response_id) JOIN karp_scores USING (response_id))
"""


def _scaled_sql(cols):
    parts = []
    for c in cols:
        mn = f"min({c}) OVER (PARTITION BY prompt_id)"
        mx = f"max({c}) OVER (PARTITION BY prompt_id)"
        parts.append(f"round(CASE WHEN {mx} > {mn} THEN ({c} - {mn}) / ({mx} - {mn}) ELSE 0.0 END, 6) AS {c}")
    return ",\n  ".join(parts)


@register("feature_table", RAW_SQL + f"SELECT response_id, prompt_id,\n  {_scaled_sql(FEATURES)}\nFROM raw")
def q_feature_table(spark, sf):
    """Flagship: pipeline #1's 15 features, min-max scaled within each prompt."""
    return rounded(feature_table(FX.responses(spark, sf), FX.prompts(spark, sf), FX.dictionary(spark, sf)))


@register("feature_table_raw", RAW_SQL + "SELECT response_id, prompt_id, " +
          ", ".join(f"round({c}, 6) AS {c}" for c in FEATURES) + " FROM raw")
def q_feature_table_raw(spark, sf):
    from .feature_table import raw_features
    raw = raw_features(FX.responses(spark, sf), FX.prompts(spark, sf), FX.dictionary(spark, sf))
    return rounded(raw.select("response_id", "prompt_id", *[F.col(c).cast("double").alias(c) for c in FEATURES]))


MM_COLS = ["text_word_cnt", "text_length", "text_punct_cnt"]


@register("minmax_by_prompt", FX.with_views("responses") + f"""
, c AS (SELECT response_id, prompt_id, CAST({D.word_cnt('text')} AS DOUBLE) AS text_word_cnt,
               CAST({D.char_len('text')} AS DOUBLE) AS text_length,
               CAST({D.punct_cnt('text')} AS DOUBLE) AS text_punct_cnt FROM responses)
SELECT response_id, prompt_id, {_scaled_sql(MM_COLS)} FROM c""")
def q_minmax_by_prompt(spark, sf):
    """Per-prompt min-max scaling via grouped min/max + join (no per-prompt window)."""
    r = FX.responses(spark, sf).select(
        "response_id", "prompt_id", T.word_cnt("text").cast("double").alias("text_word_cnt"),
        T.char_len("text").cast("double").alias("text_length"),
        T.punct_cnt("text").cast("double").alias("text_punct_cnt"))
    return rounded(SC.minmax_by_group(r, MM_COLS, "prompt_id"))


@register("nonfinite_to_zero", FX.with_views("responses", "prompts") + f"""
SELECT r.response_id,
  round(CASE WHEN {D.punct_cnt('p.prompt_title')} = 0 THEN 0.0
        ELSE {D.punct_cnt('r.text')} / CAST({D.punct_cnt('p.prompt_title')} AS DOUBLE) END, 6) AS punct_title_ratio,
  round(CASE WHEN {D.stopword_cnt('p.prompt_title')} = 0 THEN 0.0
        ELSE {D.stopword_cnt('r.text')} / CAST({D.stopword_cnt('p.prompt_title')} AS DOUBLE) END, 6)
        AS stopword_title_ratio
FROM responses r JOIN prompts p ON r.prompt_id = p.prompt_id""")
def q_nonfinite_to_zero(spark, sf):
    """Ratios over the prompt *title* (often 0 marks) with inf/NaN -> 0.

    IEEE division is used on purpose (``try_divide`` off): 0/0 gives NaN, x/0
    gives inf, and B6 maps both to 0.
    """
    r = FX.responses(spark, sf).select("response_id", "prompt_id", "text")
    p = FX.prompts(spark, sf).select("prompt_id", "prompt_title")
    j = r.join(p, "prompt_id")
    a, b = T.punct_cnt("text").cast("double"), T.punct_cnt("prompt_title").cast("double")
    c, d = T.stopword_cnt("text").cast("double"), T.stopword_cnt("prompt_title").cast("double")
    inf = F.lit(float("inf"))
    ieee = lambda x, y: (F.when(y != 0, x / F.when(y != 0, y))
                         .when(x == 0, F.lit(float("nan"))).otherwise(inf))
    raw = j.select("response_id", ieee(a, b).alias("punct_title_ratio"), ieee(c, d).alias("stopword_title_ratio"))
    return rounded(SC.nonfinite_to_zero(raw))


def _v2_sql():
    ratio = lambda x, y: D.ratio(x, y)
    t = "corrected_text"
    overlap = lambda left, right, on: (
        f"(SELECT l.response_id, l.n, sum(greatest(l.cnt, r.cnt)) AS v FROM {left} l JOIN {right} r ON l.{on} = r.{on} AND l.n = r.n AND l.rank = r.rank "
        "AND l.gram = r.gram GROUP BY l.response_id, l.n)")
    wide = lambda src, name: ", ".join(
        f"coalesce((SELECT v FROM {src} x WHERE x.response_id = d.response_id AND x.n = {n}), 0) AS n{n}grams_{name}_cnt" for n in (2, 3, 4))
    scaled = ", ".join(
        f"round(CASE WHEN max({c}) OVER p > min({c}) OVER p THEN CAST({c} - min({c}) OVER p AS DOUBLE) / CAST(max({c}) OVER p - min({c}) OVER p AS DOUBLE) "
        f"ELSE 0.0 END, 6) AS {c}" for c in (OUT_NAMES[x] for x in SCALED))
    return FX.with_views("responses", "prompts", "dictionary", "word_pairs") + KNOWN_BODY + MISSPELLED_BODY + f"""
, corrected AS MATERIALIZED (WITH {COMPOUND_BODY})
, cresp AS MATERIALIZED (SELECT r.response_id, r.prompt_id, c.corrected_text, c.distance, c.corrected_text AS text FROM responses r JOIN corrected c USING (response_id))
, tfs AS (SELECT * FROM (WITH {TFIDF_BODY.replace('responses', 'cresp').strip().lstrip(',')} SELECT response_id, tfidf_scores FROM sums))
, cpre AS (SELECT response_id, {D.preprocess('text')} AS t FROM cresp)
, ppre AS (SELECT prompt_id, {D.preprocess('prompt_text')} AS t FROM prompts)
, cl AS {lemma_query('cpre', 'response_id')}
, pl AS {lemma_query('ppre', 'prompt_id')}
, ga AS {_sql_grams('responses', 'response_id', 'text', ', prompt_id')}
, gc AS {_sql_grams('cresp', 'response_id', 'text', ', prompt_id')}
, gp AS {_sql_grams('prompts', 'prompt_id', 'prompt_text')}
, oc AS MATERIALIZED {overlap('ga', 'gc', 'response_id')}
, oo AS MATERIALIZED {overlap('gc', 'gp', 'prompt_id')}
, pn AS (SELECT prompt_id, {D.stopword_cnt('prompt_text')} AS prompt_length, {D.distinct_words("coalesce(lemmatized, '')")} AS prompt_dw
    FROM prompts LEFT JOIN pl USING (prompt_id))
, d AS (SELECT response_id, prompt_id, distance, {D.char_len(t)} AS text_length, {D.stopword_cnt(t)} AS stop_cnt, {D.punct_cnt(t)} AS punctuation_cnt,
    {D.entity_cnt(t)} AS entities, {D.token_cnt(t)} AS text_pos, {D.distinct_words("coalesce(lemmatized, '')")} AS text_dw FROM cresp LEFT JOIN cl USING (response_id))
, raw AS MATERIALIZED (SELECT d.response_id, d.prompt_id, miss.text_misspelled_cnt AS misspelled_text_cnt, tfs.tfidf_scores, text_pos, entities, distance, stop_cnt,
    punctuation_cnt, {ratio('text_dw', 'prompt_dw')} AS different_word_cnt_ratio, {ratio('text_length', 'prompt_length')} AS length_ratio,
    {wide('oc', 'correct')}, {wide('oo', 'cooccurrence')}
    FROM d JOIN pn USING (prompt_id) JOIN miss USING (response_id) JOIN tfs USING (response_id))
SELECT response_id, prompt_id, {scaled}, round(different_word_cnt_ratio, 6) AS different_word_cnt_ratio, round(length_ratio, 6) AS length_ratio
FROM raw WINDOW p AS (PARTITION BY prompt_id)"""


@register("feature_table_v2", _v2_sql())
def q_feature_table_v2(spark, sf):
    """Pipeline #2: 13 scaled + 2 raw features of the corrected responses (words split and merged too)."""
    dictionary = cut_lineage(FX.dictionary(spark, sf), "dictionary")
    pairs = cut_lineage(FX.word_pairs(spark, sf), "word-pairs")
    return rounded(feature_table_v2(FX.responses(spark, sf), FX.prompts(spark, sf), dictionary, pairs))


SCREEN_FT = RAW_SQL + f"""
, ft AS (SELECT response_id, prompt_id,
  {_scaled_sql(FEATURES).replace('round(', '(').replace(', 6) AS', ') AS')} FROM raw)
, lab AS (SELECT * FROM ft JOIN scores USING (response_id))
, corr_t AS (""" + "\nUNION ALL ".join(
    f"""SELECT '{c}' AS feature,
  CASE WHEN max({c}) > min({c}) AND max(content) > min(content) THEN corr({c}, content) END AS content,
  CASE WHEN max({c}) > min({c}) AND max(wording) > min(wording) THEN corr({c}, wording) END AS wording FROM lab"""
    for c in FEATURES) + """)
SELECT feature, round(content, 6) AS content, round(wording, 6) AS wording,
  round(round(abs(content) + abs(wording), 5), 6) AS both,
  coalesce(abs(content) > 0.3 OR abs(wording) > 0.3, false) AS keep_any,
  coalesce(round(abs(content) + abs(wording), 5) > 0.8, false) AS keep_both FROM corr_t"""


@register("screened_features", SCREEN_FT.replace(
    'WITH responses AS', 'WITH scores AS (' + FX.SQL["scores"] + '),\nresponses AS', 1))
def q_screened_features(spark, sf):
    """D7 -> B7 / B8 on the 15-feature table: correlations and both screening flags."""
    from ..operators import profile as PR
    ft = feature_table(FX.responses(spark, sf), FX.prompts(spark, sf), FX.dictionary(spark, sf))
    lab = ft.join(FX.scores(spark, sf), "response_id")
    return rounded(PR.corr_screen(PR.corr_with_targets(lab, FEATURES)))
