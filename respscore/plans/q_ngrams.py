"""Queries for n-grams (N1-N10, D16) and the prompt vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as FE
from ..operators import ngrams as NG
from ..sources import fixtures as FX
from . import duck as D
from .registry import register

R = FX.with_views("responses")
RP = FX.with_views("responses", "prompts")


def _tokens(spark, sf):
    r = FX.responses(spark, sf).select("response_id", "prompt_id", "text")
    return r.withColumn("tok", T.word_tokens(T.clean("text")))


for _n in (2, 3, 4):
    register(f"ngrams_{_n}", R + f"""
SELECT response_id, CAST(len(g) AS BIGINT) AS n_grams, array_to_string(g, '|') AS grams FROM (
  SELECT response_id, {D.ngrams('tok', _n)} AS g FROM (
    SELECT response_id, {D.word_tokens(D.clean('text'))} AS tok FROM responses))""")(
        lambda spark, sf, n=_n: _tokens(spark, sf).select(
            "response_id", T.ngrams("tok", n).alias("g")).select(
            "response_id", F.size("g").cast("long").alias("n_grams"), F.array_join("g", "|").alias("grams")))


def _filter_query(col_filter, sql_filter, name):
    sql = R + f"""
, t AS (SELECT response_id, {D.word_tokens(D.clean('text'))} AS tok FROM responses)
, g AS (SELECT response_id, {sql_filter(D.ngrams('tok', 2))} AS g2, {sql_filter(D.ngrams('tok', 3))} AS g3,
               {sql_filter(D.ngrams('tok', 4))} AS g4 FROM t)
SELECT response_id, CAST(len(g2) AS BIGINT) AS kept_2, CAST(len(g3) AS BIGINT) AS kept_3,
       CAST(len(g4) AS BIGINT) AS kept_4, array_to_string(g2, '|') AS grams_2 FROM g"""

    def q(spark, sf):
        t = _tokens(spark, sf)
        g = t.select("response_id", *[col_filter(T.ngrams("tok", n)).alias(f"g{n}") for n in (2, 3, 4)])
        return g.select("response_id", *[F.size(f"g{n}").cast("long").alias(f"kept_{n}") for n in (2, 3, 4)],
                        F.array_join("g2", "|").alias("grams_2"))
    register(name, sql)(q)


_filter_query(T.filter_edge_chars, D.filter_edge_chars, "ngram_filter_char")
_filter_query(T.filter_edge_tokens, D.filter_edge_tokens, "ngram_filter_token")


def _shared(spark, sf, n):
    p = FE.prompt_features(FX.prompts(spark, sf), grams=(n,), keep_text=False).select(
        "prompt_id", f"prompt_text_{n}grams")
    r = FX.responses(spark, sf).select("response_id", "prompt_id", "text")
    j = FE.join_prompts(r, p)
    return FE.shared_ngrams(j, grams=(n,)).select("response_id", f"shared_{n}grams")


for _n in (2, 3, 4):
    register(f"shared_ngrams_{_n}", RP + f"""
, pt AS (SELECT prompt_id, {D.word_tokens(D.clean('prompt_text'))} AS tok FROM prompts)
, rt AS (SELECT response_id, prompt_id, {D.word_tokens(D.clean('text'))} AS tok FROM responses)
, pg AS (SELECT prompt_id, {D.filter_edge_chars(D.ngrams('tok', _n))} AS pg FROM pt)
, rg AS (SELECT response_id, prompt_id, {D.filter_edge_chars(D.ngrams('tok', _n))} AS rg FROM rt)
SELECT response_id, CAST(len(list_intersect(list_distinct(rg), list_distinct(pg))) AS BIGINT) AS shared_{_n}grams
FROM rg JOIN pg USING (prompt_id)""")(lambda spark, sf, n=_n: _shared(spark, sf, n))


# ------------------------------------------------------------- multisets
def _resp_grams(spark, sf, ns=(2, 3, 4)):
    r = FX.responses(spark, sf).select("response_id", "prompt_id", "text")
    r = r.withColumn("tok", T.word_tokens(T.preprocess("text")))
    return NG.gram_table(r, "response_id", "tok", ns, extra=("prompt_id",))


def _prompt_grams(spark, sf, ns=(2, 3, 4)):
    p = FX.prompts(spark, sf).select("prompt_id", T.word_tokens(T.preprocess("prompt_text")).alias("tok"))
    return NG.gram_table(p, "prompt_id", "tok", ns)


def _sql_grams(src, key, text, extra=""):
    tok = D.word_tokens(D.preprocess(text))
    return f"""(SELECT {key}{extra}, n, gram, count(*) AS cnt,
        row_number() OVER (PARTITION BY {key}, n ORDER BY min(pos)) AS rank FROM (
      SELECT {key}{extra}, n, unnest(g) AS gram, unnest(range(0, len(g))) AS pos FROM (
        SELECT {key}{extra}, n, list_transform(range(1, len(tok) - n + 2),
               lambda i: array_to_string(tok[i:i + n - 1], ' ')) AS g
        FROM (SELECT {key}{extra}, {tok} AS tok FROM {src}), (SELECT unnest([2, 3, 4]) AS n)))
      GROUP BY {key}{extra}, n, gram)"""


NGRAM_CTES = RP + f""", ra AS {_sql_grams('responses', 'response_id', 'text', ', prompt_id')}
, pa AS {_sql_grams('prompts', 'prompt_id', 'prompt_text')}
"""


@register("ngram_counts", NGRAM_CTES + """
SELECT response_id, n, gram, CAST(cnt AS BIGINT) AS cnt, CAST(rank AS BIGINT) AS rank FROM ra""")
def q_ngram_counts(spark, sf):
    """Multiplicity and first-appearance rank of each 2/3/4-gram of each response."""
    g = _resp_grams(spark, sf)
    return g.select("response_id", F.col("n").cast("int").alias("n"), "gram",
                    F.col("cnt").cast("long").alias("cnt"), F.col("rank").cast("long").alias("rank"))


for _n in (2, 3, 4):
    register(f"aligned_ngrams_{_n}", NGRAM_CTES + f"""
SELECT r.response_id, CAST(coalesce(sum(CASE WHEN pa.gram IS NOT NULL THEN greatest(ra.cnt, pa.cnt) END), 0) AS BIGINT)
       AS aligned_{_n}grams
FROM responses r LEFT JOIN ra ON ra.response_id = r.response_id AND ra.n = {_n}
LEFT JOIN pa ON pa.prompt_id = r.prompt_id AND pa.n = {_n} AND pa.rank = ra.rank AND pa.gram = ra.gram
GROUP BY r.response_id""")(lambda spark, sf, n=_n: _overlap(spark, sf, n, aligned=True))
    register(f"multiset_ngrams_{_n}", NGRAM_CTES + f"""
SELECT r.response_id, CAST(coalesce(sum(CASE WHEN pa.gram IS NOT NULL THEN least(ra.cnt, pa.cnt) END), 0) AS BIGINT)
       AS multiset_{_n}grams
FROM responses r LEFT JOIN ra ON ra.response_id = r.response_id AND ra.n = {_n}
LEFT JOIN pa ON pa.prompt_id = r.prompt_id AND pa.n = {_n} AND pa.gram = ra.gram
GROUP BY r.response_id""")(lambda spark, sf, n=_n: _overlap(spark, sf, n, aligned=False))


def _overlap(spark, sf, n, aligned):
    ra, pa = _resp_grams(spark, sf, (n,)), _prompt_grams(spark, sf, (n,))
    if aligned:
        o = NG.aligned_overlap(ra, pa, "response_id", "prompt_id").withColumnRenamed("aligned", "v")
        name = f"aligned_{n}grams"
    else:
        o = NG.multiset_overlap(ra, pa, "response_id").withColumnRenamed("overlap", "v")
        name = f"multiset_{n}grams"
    ids = FX.responses(spark, sf).select("response_id")
    return ids.join(o.select("response_id", "v"), "response_id", "left").select(
        "response_id", F.coalesce(F.col("v"), F.lit(0)).cast("long").alias(name))


@register("prompt_vocab", FX.with_views("prompts") + """
SELECT DISTINCT w AS word FROM (
  SELECT unnest(regexp_split_to_array(replace(prompt_text, chr(10), ' '), '\\s+')) AS w FROM prompts
  UNION ALL SELECT unnest(regexp_split_to_array(replace(prompt_question, chr(10), ' '), '\\s+')) FROM prompts
  UNION ALL SELECT unnest(regexp_split_to_array(replace(prompt_title, chr(10), ' '), '\\s+')) FROM prompts)
WHERE w <> ''""")
def q_prompt_vocab(spark, sf):
    from ..operators import vocab as V
    return V.prompt_vocab(FX.prompts(spark, sf))
