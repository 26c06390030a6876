"""Queries for splitting and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling as SA
from ..sources import fixtures as FX
from .registry import register

LAB = FX.with_views("responses", "scores") + """
, lab AS (SELECT response_id, prompt_id FROM responses WHERE response_id IN (SELECT response_id FROM scores))
"""


def labelled_ids(spark, sf):
    """Labelled responses (the training population): (response_id, prompt_id)."""
    return FX.responses(spark, sf).select("response_id", "prompt_id").join(
        FX.scores(spark, sf).select("response_id"), "response_id", "left_semi")


@register("stratified_split", LAB + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY prompt_id
           ORDER BY md5(CAST(response_id AS VARCHAR) || '#42'), response_id) AS r,
         count(*) OVER (PARTITION BY prompt_id) AS n FROM lab)
, k AS (SELECT *, ceil(n * CAST(0.2 AS DOUBLE)) AS k1 FROM rk)
SELECT response_id, prompt_id, CASE WHEN r <= k1 THEN 'valid'
  WHEN r <= k1 + ceil((n - k1) * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM k""")
def q_stratified_split(spark, sf):
    return SA.stratified_split(labelled_ids(spark, sf), "response_id").select("response_id", "prompt_id", "part")


@register("oversample", LAB + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY md5(CAST(response_id AS VARCHAR)), response_id)
           AS r FROM lab)
, sizes AS (SELECT prompt_id, count(*) AS n FROM lab GROUP BY prompt_id)
, ord AS (SELECT *, row_number() OVER (ORDER BY n DESC, prompt_id) AS pos, max(n) OVER () AS most FROM sizes)
, draws AS (SELECT prompt_id, n, unnest(range(1, most + 1)) AS draw FROM ord WHERE pos > 1)
, picked AS (SELECT prompt_id, draw, CAST(('0x' || substr(md5(CAST(prompt_id AS VARCHAR) || '#' ||
               CAST(draw AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) % n + 1 AS r FROM draws)
SELECT p.prompt_id, rk.response_id, p.draw FROM picked p JOIN rk USING (prompt_id, r)
UNION ALL SELECT rk.prompt_id, rk.response_id, rk.r AS draw FROM rk JOIN ord USING (prompt_id) WHERE pos = 1""")
def q_oversample(spark, sf):
    """P2 (with D1/D2): every prompt but the largest redrawn to the largest's size."""
    return SA.oversample(labelled_ids(spark, sf), "response_id").select("prompt_id", "response_id", "draw")


@register("oversample_sizes", LAB + """
, sizes AS (SELECT prompt_id, count(*) AS n FROM lab GROUP BY prompt_id)
SELECT prompt_id, (SELECT max(n) FROM sizes) AS n FROM sizes""")
def q_oversample_sizes(spark, sf):
    """Invariant: after oversampling every prompt has the largest prompt's size."""
    o = SA.oversample(labelled_ids(spark, sf), "response_id")
    return o.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"))


@register("logo_folds", LAB + """
SELECT CAST(dense_rank() OVER (ORDER BY prompt_id) AS BIGINT) AS fold, prompt_id, count(*) AS n_valid,
       CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train FROM lab GROUP BY prompt_id""")
def q_logo_folds(spark, sf):
    """Leave-one-prompt-out folds as (fold, prompt, sizes); rows are not replicated."""
    return SA.logo_folds(labelled_ids(spark, sf))


@register("fold_assignment", LAB + """
SELECT response_id, prompt_id, CAST(dense_rank() OVER (ORDER BY prompt_id) AS BIGINT) AS fold FROM lab""")
def q_fold_assignment(spark, sf):
    return SA.fold_assignment(labelled_ids(spark, sf), "response_id")


@register("fold_filter", LAB + """
, f AS (SELECT response_id, prompt_id, dense_rank() OVER (ORDER BY prompt_id) AS fold FROM lab)
SELECT response_id, prompt_id FROM f WHERE fold <> 1""")
def q_fold_filter(spark, sf):
    """The training rows of fold 1 (every prompt but the first)."""
    a = SA.fold_assignment(labelled_ids(spark, sf), "response_id")
    return a.where(F.col("fold") != 1).select("response_id", "prompt_id")
