"""Queries for profiling and screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as FE
from ..operators import profile as PR
from ..sources import fixtures as FX
from . import duck as D
from .registry import register, rounded

BASIC = ["text_word_cnt", "text_length", "text_stopword_cnt", "text_punct_cnt", "text_different_word_cnt",
         "text_word_ratio", "text_length_ratio", "text_stopword_ratio", "text_punct_ratio",
         "text_different_word_ratio"]


def basic_features(spark, sf):
    """(response_id, prompt_id, 5 counts + 5 ratios): the row-local feature slice."""
    p = FE.prompt_features(FX.prompts(spark, sf), grams=(), keep_text=False).drop("prompt_text_nostop")
    r = FE.response_counts(FX.responses(spark, sf).select("response_id", "prompt_id", "text"))
    j = FE.ratios(FE.join_prompts(r, p))
    return j.select("response_id", "prompt_id", *[F.col(c).cast("double").alias(c) for c in BASIC])


def labelled(spark, sf):
    return basic_features(spark, sf).join(FX.scores(spark, sf), "response_id")


BASIC_SQL = FX.with_views("responses", "prompts", "scores") + f"""
, pf AS (SELECT prompt_id, {D.word_cnt('prompt_text')} AS p_wc, {D.char_len('prompt_text')} AS p_len,
                {D.stopword_cnt('prompt_text')} AS p_sw, {D.punct_cnt('prompt_text')} AS p_pc,
                {D.distinct_words(D.clean('prompt_text'))} AS p_dw FROM prompts)
, rf AS (SELECT response_id, prompt_id, {D.word_cnt('text')} AS wc, {D.char_len('text')} AS len,
                {D.stopword_cnt('text')} AS sw, {D.punct_cnt('text')} AS pc,
                {D.distinct_words(D.clean('text'))} AS dw FROM responses)
, basic AS (SELECT response_id, prompt_id, CAST(wc AS DOUBLE) AS text_word_cnt, CAST(len AS DOUBLE) AS text_length,
      CAST(sw AS DOUBLE) AS text_stopword_cnt, CAST(pc AS DOUBLE) AS text_punct_cnt,
      CAST(dw AS DOUBLE) AS text_different_word_cnt,
      {D.ratio('wc', 'p_wc')} AS text_word_ratio, {D.ratio('len', 'p_len')} AS text_length_ratio,
      {D.ratio('sw', 'p_sw')} AS text_stopword_ratio, {D.ratio('pc', 'p_pc')} AS text_punct_ratio,
      {D.ratio('dw', 'p_dw')} AS text_different_word_ratio
    FROM rf JOIN pf USING (prompt_id))
, lab AS (SELECT * FROM basic JOIN scores USING (response_id))
"""


@register("proj_features", BASIC_SQL + "SELECT response_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in BASIC)
          + " FROM basic")
def q_proj_features(spark, sf):
    """The feature columns = all but ids, texts and targets."""
    b = basic_features(spark, sf)
    return rounded(b.select("response_id", *PR.feature_columns(b, ["response_id", "prompt_id"])))


@register("numeric_profile", FX.with_views("responses", "prompts") + """
SELECT r.response_id, r.prompt_id, CAST(length(r.text) AS BIGINT) AS text_length,
       CAST(length(p.prompt_text) AS BIGINT) AS prompt_length
FROM responses r JOIN prompts p USING (prompt_id)""")
def q_numeric_profile(spark, sf):
    """Keep only the numeric columns of the joined table (texts drop out by type)."""
    j = FE.join_prompts(FX.responses(spark, sf), FX.prompts(spark, sf)).withColumn(
        "text_length", T.char_len("text")).withColumn("prompt_length", T.char_len("prompt_text"))
    return j.select(*PR.numeric_columns(j))


@register("group_counts", FX.with_views("responses") + """
SELECT prompt_id, count(*) AS n FROM responses GROUP BY prompt_id""")
def q_group_counts(spark, sf):
    return PR.group_counts(FX.responses(spark, sf))


def _describe_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,
  round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75,
  round(max({c}), 6) AS max FROM {src}""")
    return "\nUNION ALL ".join(parts)


@register("describe_features", BASIC_SQL + _describe_sql(BASIC, "basic"))
def q_describe_features(spark, sf):
    return rounded(PR.describe(basic_features(spark, sf), BASIC))


@register("info_features", BASIC_SQL + "\nUNION ALL ".join(
    [f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS non_null FROM basic"""
     for c, t in [("response_id", "bigint"), ("prompt_id", "bigint")] + [(c, "double") for c in BASIC]]))
def q_info_features(spark, sf):
    return PR.info(basic_features(spark, sf))


def _corr_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS feature,
  CASE WHEN max({c}) > min({c}) AND max(content) > min(content) THEN corr({c}, content) END AS content,
  CASE WHEN max({c}) > min({c}) AND max(wording) > min(wording) THEN corr({c}, wording) END AS wording FROM {src}""")
    return "\nUNION ALL ".join(parts)


CORR_SQL = BASIC_SQL + f", corr_t AS ({_corr_sql(BASIC, 'lab')})\n"


@register("corr_with_targets", CORR_SQL + "SELECT feature, round(content, 6) AS content, "
          "round(wording, 6) AS wording FROM corr_t")
def q_corr_with_targets(spark, sf):
    return rounded(PR.corr_with_targets(labelled(spark, sf), BASIC))


SCREEN_SQL = CORR_SQL + """
SELECT feature, round(content, 6) AS content, round(wording, 6) AS wording,
  round(round(abs(content) + abs(wording), 5), 6) AS both,
  coalesce(abs(content) > 0.3 OR abs(wording) > 0.3, false) AS keep_any,
  coalesce(round(abs(content) + abs(wording), 5) > 0.8, false) AS keep_both FROM corr_t"""


@register("corr_screen_any", SCREEN_SQL)
def q_corr_screen_any(spark, sf):
    """|corr| > 0.3 on either target (flag per feature)."""
    return rounded(PR.corr_screen(PR.corr_with_targets(labelled(spark, sf), BASIC)))


@register("corr_screen_both", SCREEN_SQL)
def q_corr_screen_both(spark, sf):
    """|c| + |w| (rounded to 5) > 0.8 (flag per feature)."""
    return rounded(PR.corr_screen(PR.corr_with_targets(labelled(spark, sf), BASIC)))


def _kept_sql(rule):
    return CORR_SQL + f"""
, scr AS ({SCREEN_SQL[len(CORR_SQL):]})
SELECT feature, content, wording, "both" FROM scr WHERE keep_{rule}"""


@register("kept_features_any", _kept_sql("any"))
def q_kept_features_any(spark, sf):
    """The features kept because one target's correlation is above 0.3."""
    return rounded(PR.kept_features(PR.corr_with_targets(labelled(spark, sf), BASIC), "any"))


@register("kept_features_both", _kept_sql("both"))
def q_kept_features_both(spark, sf):
    """The features kept because the sum of both correlations is above 0.8."""
    return rounded(PR.kept_features(PR.corr_with_targets(labelled(spark, sf), BASIC), "both"))


@register("corr_matrix", CORR_SQL + """
SELECT feature, round(content, 6) AS content, round(wording, 6) AS wording,
       round(abs(content) + abs(wording), 6) AS both FROM corr_t""")
def q_corr_matrix(spark, sf):
    """Heat-map data, feature x {content, wording, both}; the targets themselves excluded."""
    c = PR.corr_with_targets(labelled(spark, sf), BASIC)
    return rounded(c.select("feature", "content", "wording",
                            (F.abs("content") + F.abs("wording")).alias("both")))


@register("length_histogram", FX.with_views("responses") + """
, l AS (SELECT CAST(length(text) AS DOUBLE) AS x FROM responses)
, s AS (SELECT min(x) AS mn, max(x) AS mx FROM l)
, b AS (SELECT CAST(CASE WHEN mx > mn THEN least(floor((x - mn) * 10 / (mx - mn)), 9) ELSE 0 END AS INTEGER) AS bin
        FROM l, s)
, c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin)
, e AS (SELECT CAST(i AS INTEGER) AS bin, mn + i * (mx - mn) / 10 AS lo, mn + (i + 1) * (mx - mn) / 10 AS hi
        FROM s, range(0, 10) t(i))
SELECT e.bin, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM e LEFT JOIN c USING (bin)""")
def q_length_histogram(spark, sf):
    r = FX.responses(spark, sf).select(T.char_len("text").alias("text_length"))
    return rounded(PR.histogram(r, "text_length", 10))


@register("head_features", BASIC_SQL + "SELECT response_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in BASIC)
          + " FROM basic ORDER BY response_id LIMIT 5")
def q_head_features(spark, sf):
    """E5: first rows by id (a top-k report; the limit is the feature)."""
    return rounded(basic_features(spark, sf).orderBy("response_id").limit(5).drop("prompt_id"))
