"""Queries for losses, run summaries and stopping rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as ME
from ..operators.ranking import rank_by_id
from ..sources import fixtures as FX
from .registry import register, rounded

PS = FX.with_views("predictions", "scores") + """
, ps AS (SELECT * FROM predictions JOIN scores USING (response_id))
"""


def _ps(spark, sf):
    return FX.predictions(spark, sf).join(FX.scores(spark, sf), "response_id")


@register("mcrmse", PS + """
SELECT round(sqrt(avg(pow(content - p_content, 2))), 6) AS rmse_content,
       round(sqrt(avg(pow(wording - p_wording, 2))), 6) AS rmse_wording,
       round((sqrt(avg(pow(content - p_content, 2))) + sqrt(avg(pow(wording - p_wording, 2)))) / 2, 6) AS mcrmse
FROM ps""")
def q_mcrmse(spark, sf):
    return rounded(ME.mcrmse(_ps(spark, sf)))


@register("mcrmse_eps", PS + """
SELECT round(sqrt(avg(pow(content - p_content, 2)) + 1e-6), 6) AS rmse_content,
       round(sqrt(avg(pow(wording - p_wording, 2)) + 1e-6), 6) AS rmse_wording,
       round((sqrt(avg(pow(content - p_content, 2)) + 1e-6) + sqrt(avg(pow(wording - p_wording, 2)) + 1e-6)) / 2, 6)
         AS mcrmse FROM ps""")
def q_mcrmse_eps(spark, sf):
    return rounded(ME.mcrmse(_ps(spark, sf), eps=1e-6))


@register("mcrmse_batch_mean", PS + """
, b AS (SELECT *, (row_number() OVER (ORDER BY response_id) - 1) // 8 AS batch_id FROM ps)
, per AS (SELECT batch_id, sqrt(avg(pow(content - p_content, 2))) AS rc, sqrt(avg(pow(wording - p_wording, 2))) AS rw
          FROM b GROUP BY batch_id)
SELECT round(avg(rc), 6) AS rmse_content, round(avg(rw), 6) AS rmse_wording, round(avg((rc + rw) / 2), 6) AS mcrmse,
       count(*) AS batches FROM per""")
def q_mcrmse_batch_mean(spark, sf):
    """Batches of 8 in id order, MCRMSE per batch, mean over batches."""
    r = rank_by_id(_ps(spark, sf), "response_id")
    b = r.withColumn("batch_id", F.floor((F.col("rank") - 1) / 8))
    return rounded(ME.mcrmse_batch_mean(b))


@register("combine_predictions", FX.with_views("predictions") + """
SELECT a.response_id, a.p_content AS content, b.p_wording AS wording
FROM predictions a JOIN predictions b USING (response_id)""")
def q_combine_predictions(spark, sf):
    """Content from one model, wording from another, aligned on the id."""
    p = FX.predictions(spark, sf)
    return rounded(ME.combine_predictions(p.select("response_id", "p_content"),
                                          p.select("response_id", "p_wording"),
                                          "response_id", "p_content", "p_wording"))


LL = FX.with_views("loss_log")


@register("run_summary", LL + """
SELECT run_id, round(arg_max(loss, step), 6) AS last_loss, round(min(loss), 6) AS best_loss,
       arg_min(step, (loss, step)) AS best_step, max(step) AS epochs FROM loss_log GROUP BY run_id""")
def q_run_summary(spark, sf):
    return rounded(ME.run_summary(FX.loss_log(spark, sf)))


@register("running_best", LL + """
SELECT run_id, step, round(loss, 6) AS loss, round(prev_best, 6) AS prev_best,
       coalesce(loss < prev_best, true) AS improved FROM (
  SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         AS prev_best FROM loss_log)""")
def q_running_best(spark, sf):
    return rounded(ME.running_best(FX.loss_log(spark, sf)))


@register("best_across_runs", LL + """
, b AS (SELECT run_id, min(loss) AS best_loss FROM loss_log GROUP BY run_id)
, p AS (SELECT *, min(best_loss) OVER (ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM b)
SELECT run_id, round(best_loss, 6) AS best_loss, round(best_before, 6) AS best_before,
       coalesce(best_loss < best_before, true) AS improved FROM p""")
def q_best_across_runs(spark, sf):
    return rounded(ME.best_across_runs(FX.loss_log(spark, sf)))


def _plateau_sql(patience, delta):
    return LL + f"""
, x AS (SELECT *, min(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          AS prev FROM loss_log WHERE loss IS NOT NULL AND NOT isnan(loss))
, y AS (SELECT *, sum(CASE WHEN prev IS NULL OR loss < prev THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg, least(coalesce(prev, loss), loss) AS mn FROM x)
, z AS (SELECT *, sum(CASE WHEN loss > mn + {delta} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, seg ORDER BY step
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cnt FROM y)
, s AS (SELECT run_id, min(step) AS stop_step FROM z WHERE cnt >= {patience} GROUP BY run_id)
SELECT r.run_id, s.stop_step FROM (SELECT DISTINCT run_id FROM loss_log) r LEFT JOIN s USING (run_id)"""


@register("plateau_stop", _plateau_sql(8, 0.003))
def q_plateau_stop(spark, sf):
    """Early-stop step per run (patience 8, delta 0.003, the stopper's defaults)."""
    return ME.plateau_stop(FX.loss_log(spark, sf), patience=8, delta=0.003)


@register("divergence_stop", LL + """
, x AS (SELECT *, lag(loss) OVER (PARTITION BY run_id ORDER BY step) AS lg FROM loss_log)
, s AS (SELECT run_id, min(step) AS stop_step FROM x WHERE loss > lg AND train_loss < loss GROUP BY run_id)
SELECT r.run_id, s.stop_step FROM (SELECT DISTINCT run_id FROM loss_log) r LEFT JOIN s USING (run_id)""")
def q_divergence_stop(spark, sf):
    return ME.divergence_stop(FX.loss_log(spark, sf))
