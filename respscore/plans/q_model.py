"""Queries for models: Gram sums, fold fits (D11, D12, M4) and Spark ML fits (M1-M3, M5)."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..operators import metrics as ME
from ..operators import model as MO
from ..operators import sampling as SA
from ..operators import search as SE
from ..operators import scale as SC
from ..operators import wordvec as WV
from ..operators.ranking import rank_by_id
from ..session import cut_lineage
from ..sources import fixtures as FX
from .q_profile import BASIC, BASIC_SQL, basic_features
from .registry import register, rounded

TARGETS = ("content", "wording")


def model_data(spark, sf):
    """Per-prompt scaled row-local features of labelled responses, with both targets."""
    b = SC.minmax_by_group(basic_features(spark, sf), BASIC, "prompt_id")
    return b.join(FX.scores(spark, sf), "response_id")


def _scaled_expr(c):
    mn, mx = f"min({c}) OVER (PARTITION BY prompt_id)", f"max({c}) OVER (PARTITION BY prompt_id)"
    return f"CASE WHEN {mx} > {mn} THEN ({c} - {mn}) / ({mx} - {mn}) ELSE 0.0 END AS {c}"


MD_SQL = BASIC_SQL + f"""
, scaled AS (SELECT response_id, prompt_id, {', '.join(_scaled_expr(c) for c in BASIC)} FROM basic)
, md AS (SELECT s.*, sc.content, sc.wording FROM scaled s JOIN scores sc USING (response_id))
"""


def _gram_sql():
    terms = ["one", *BASIC, *TARGETS]
    ex = {t: ("1.0" if t == "one" else t) for t in terms}
    cols = [f"round(sum({ex[a]} * {ex[b]}), 6) AS s__{a}__{b}" for a, b in itertools.combinations_with_replacement(terms, 2)]
    return MD_SQL + f"SELECT prompt_id, {', '.join(cols)} FROM md GROUP BY prompt_id"


@register("gram_sums", _gram_sql())
def q_gram_sums(spark, sf):
    """Per-prompt sufficient statistics of (1, features, targets): one pass over the data."""
    return rounded(MO.gram_sums(model_data(spark, sf), BASIC, TARGETS))


def _fold_sql():
    structs = ", ".join(f"{{'feature': '{c}', 'x': {c}}}" for c in BASIC)
    sums = ["CAST(count(*) AS DOUBLE) AS n", "sum(s.x) AS sx", "sum(s.x * s.x) AS sxx"]
    for t in TARGETS:
        sums += [f"sum({t}) AS sy_{t}", f"sum(s.x * {t}) AS sxy_{t}", f"sum({t} * {t}) AS syy_{t}"]
    stat = ["n", "sx", "sxx"] + [f"{k}_{t}" for t in TARGETS for k in ("sy", "sxy", "syy")]
    tr = ", ".join(f"t_{c} - {c} AS tr_{c}" for c in stat)
    parts = []
    for t in TARGETS:
        b = (f"CASE WHEN tr_n * tr_sxx - tr_sx * tr_sx > 1e-9 * tr_n * tr_n THEN (tr_n * tr_sxy_{t} - tr_sx * tr_sy_{t}) "
             f"/ (tr_n * tr_sxx - tr_sx * tr_sx) ELSE 0.0 END")
        parts.append(f"{b} AS b_{t}")
    ab = ", ".join(f"(tr_sy_{t} - b_{t} * tr_sx) / tr_n AS a_{t}" for t in TARGETS)
    rm = ", ".join(
        f"sqrt(greatest(syy_{t} - 2 * a_{t} * sy_{t} - 2 * b_{t} * sxy_{t} + n * a_{t} * a_{t} + 2 * a_{t} * b_{t} * sx"
        f" + b_{t} * b_{t} * sxx, 0) / n) AS rmse_{t}" for t in TARGETS)
    return MD_SQL + f"""
, lg AS (SELECT prompt_id, content, wording, unnest([{structs}]) AS s FROM md)
, st AS (SELECT prompt_id, s.feature AS feature, {', '.join(sums)} FROM lg GROUP BY prompt_id, s.feature)
, tot AS (SELECT feature, {', '.join(f'sum({c}) AS t_{c}' for c in stat)} FROM st GROUP BY feature)
, j AS (SELECT st.*, {tr} FROM st JOIN tot USING (feature))
, bb AS (SELECT *, {', '.join(parts)} FROM j)
, aa AS (SELECT *, {ab} FROM bb)
, fl AS (SELECT prompt_id AS fold_prompt, feature, {rm} FROM aa)
, fl2 AS (SELECT *, (rmse_content + rmse_wording) / 2 AS valid_loss FROM fl)
"""


FOLD_SQL = _fold_sql()


def _fold_losses(spark, sf):
    return MO.single_feature_fold_losses(model_data(spark, sf), BASIC, TARGETS)


@register("fold_losses", FOLD_SQL + """
SELECT fold_prompt, feature, round(rmse_content, 6) AS rmse_content, round(rmse_wording, 6) AS rmse_wording,
       round(valid_loss, 6) AS valid_loss FROM fl2""")
def q_fold_losses(spark, sf):
    """Leave-one-prompt-out loss of each single-feature line, from per-prompt sums."""
    return rounded(_fold_losses(spark, sf))


@register("fold_means", FOLD_SQL + """
SELECT feature, round(avg(valid_loss), 6) AS valid_loss, count(*) AS folds FROM fl2 GROUP BY feature""")
def q_fold_means(spark, sf):
    """Per-fold losses averaged over folds, per candidate."""
    return rounded(ME.fold_means(_fold_losses(spark, sf), by="feature"))


@register("best_candidate", FOLD_SQL + """
, m AS (SELECT feature, avg(valid_loss) AS valid_loss FROM fl2 GROUP BY feature)
SELECT arg_min(feature, (round(valid_loss, 9), feature)) AS feature, round(min(valid_loss), 6) AS valid_loss FROM m""")
def q_best_candidate(spark, sf):
    """The candidate with the lowest mean fold loss."""
    return rounded(ME.best_candidate(ME.fold_means(_fold_losses(spark, sf), by="feature"), by="feature"))


@register("backward_elimination")
def q_backward_elimination(spark, sf):
    """M4: greedy backward removal under leave-one-prompt-out MCRMSE (Gram-sum fits)."""
    return rounded(MO.backward_elimination(model_data(spark, sf), BASIC, TARGETS, floor=6))


#: Weight of the squared coefficients.  Scaled inside a prompt, a ratio equals its count, so that plain least squares
#: over all features has no unique solution; the penalty makes it unique.
RIDGE = 0.01


def _split(spark, sf):
    """Labelled feature rows with their part, written once and read by every fit and prediction."""
    d = model_data(spark, sf)
    parts = SA.stratified_split(d.select("response_id", "prompt_id"), "response_id").select("response_id", "part")
    s = cut_lineage(d.join(parts, "response_id"), "model-split")
    return s.where(F.col("part") == "train"), s.where(F.col("part") == "valid")


SPLIT_SQL = MD_SQL + """
, rk AS (SELECT *, row_number() OVER (PARTITION BY prompt_id
           ORDER BY md5(CAST(response_id AS VARCHAR) || '#42'), response_id) AS r,
         count(*) OVER (PARTITION BY prompt_id) AS n FROM md)
, kk AS (SELECT *, ceil(n * CAST(0.2 AS DOUBLE)) AS k1 FROM rk)
, sp AS MATERIALIZED (SELECT * EXCLUDE (r, n, k1), CASE WHEN r <= k1 THEN 'valid'
  WHEN r <= k1 + ceil((n - k1) * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS part FROM kk)
, tr AS (SELECT * FROM sp WHERE part = 'train')
, va AS (SELECT * FROM sp WHERE part = 'valid')
"""


def _ridge_sql(features, target, tag):
    """CTEs that solve the ridge normal equations: one wide row, eliminated a pivot at a time.

    Features are centred, and the penalty on each is its variance times ``RIDGE`` over the target's deviation.  The last
    CTE, ``fit_<tag>``, has the coefficients b0.. and the intercept ``a``.
    """
    p = len(features)
    first = [f"avg({target}) AS my"] + [f"avg({f}) AS mx{i}" for i, f in enumerate(features)]
    for i, f in enumerate(features):
        first.append(f"covar_pop({f}, {target}) AS r{i}")
        first.append(f"var_pop({f}) * (1 + {RIDGE} / stddev_pop({target})) AS m{i}_{i}")
        first += [f"covar_pop({f}, {features[j]}) AS m{i}_{j}" for j in range(i + 1, p)]
    out, last = [f"{tag}_0 AS MATERIALIZED (SELECT {', '.join(first)} FROM tr)"], f"{tag}_0"
    for k in range(p - 1):
        down = []
        for i in range(k + 1, p):
            share = f"coalesce(m{k}_{i} / nullif(m{k}_{k}, 0), 0)"
            down.append(f"r{i} - {share} * r{k} AS r{i}")
            down += [f"m{i}_{j} - {share} * m{k}_{j} AS m{i}_{j}" for j in range(i, p)]
        out.append(f"{tag}_{k + 1} AS MATERIALIZED (SELECT * REPLACE ({', '.join(down)}) FROM {last})")
        last = f"{tag}_{k + 1}"
    for k in reversed(range(p)):
        rest = "".join(f" - m{k}_{j} * b{j}" for j in range(k + 1, p))
        out.append(f"{tag}_b{k} AS MATERIALIZED (SELECT *, coalesce((r{k}{rest}) / nullif(m{k}_{k}, 0), 0) AS b{k} FROM {last})")
        last = f"{tag}_b{k}"
    means = "".join(f" - b{i} * mx{i}" for i in range(p))
    out.append(f"fit_{tag} AS (SELECT my{means} AS a, {', '.join(f'b{i}' for i in range(p))} FROM {last})")
    return "".join(f"\n, {c}" for c in out)


def _predicted_sql(features, tag):
    return "(SELECT a FROM fit_%s)" % tag + "".join(f" + {f} * (SELECT b{i} FROM fit_{tag})" for i, f in enumerate(features))


FIT_SQL = SPLIT_SQL + "".join(_ridge_sql(BASIC, t, t) for t in TARGETS)
PREDICT_SQL = FIT_SQL + f"""
, pr AS (SELECT response_id, content, wording, {_predicted_sql(BASIC, 'content')} AS p_content,
                {_predicted_sql(BASIC, 'wording')} AS p_wording FROM va)
"""


@register("fit_two_targets", FIT_SQL + "\nUNION ALL ".join(
    f"SELECT '{t}' AS target, '{name}' AS term, round({col}, 6) AS value FROM fit_{t}"
    for t in TARGETS for name, col in [("intercept", "a")] + [(f, f"b{i}") for i, f in enumerate(BASIC)]))
def q_fit_two_targets(spark, sf):
    """M1: one ridge regressor per target on the training part; coefficient table."""
    train, _ = _split(spark, sf)
    return rounded(MO.coefficients(spark, MO.fit_two_targets(train, BASIC, TARGETS, reg=RIDGE), BASIC))


def _holdout(spark, sf):
    train, valid = _split(spark, sf)
    return MO.predict(MO.fit_two_targets(train, BASIC, TARGETS, reg=RIDGE), valid, BASIC, "response_id")


@register("evaluate_holdout", PREDICT_SQL + """
SELECT response_id, content, wording, round(p_content, 6) AS p_content, round(p_wording, 6) AS p_wording,
       round((content - p_content) * (content - p_content), 6) AS se_content,
       round((wording - p_wording) * (wording - p_wording), 6) AS se_wording FROM pr""")
def q_evaluate_holdout(spark, sf):
    """M2: predictions on the validation part and their squared errors."""
    squared = lambda t: F.pow(F.col(t) - F.col(f"p_{t}"), 2).alias(f"se_{t}")
    return rounded(_holdout(spark, sf).select("response_id", "content", "wording", "p_content", "p_wording",
                                              *[squared(t) for t in TARGETS]))


@register("evaluate_losses", PREDICT_SQL + """
, bt AS (SELECT *, (row_number() OVER (ORDER BY response_id) - 1) // 8 AS batch_id FROM pr)
, pb AS (SELECT sqrt(avg(pow(content - p_content, 2))) AS c, sqrt(avg(pow(wording - p_wording, 2))) AS w FROM bt GROUP BY batch_id)
, al AS (SELECT sqrt(avg(pow(content - p_content, 2))) AS c, sqrt(avg(pow(wording - p_wording, 2))) AS w FROM pr)
SELECT 'rows' AS over, round(c, 6) AS rmse_content, round(w, 6) AS rmse_wording, round((c + w) / 2, 6) AS mcrmse FROM al
UNION ALL SELECT 'batches' AS over, round(avg(c), 6), round(avg(w), 6), round(avg((c + w) / 2), 6) FROM pb""")
def q_evaluate_losses(spark, sf):
    """M2 with D13 and D15: the validation loss over all rows, and as the mean over batches of 8."""
    p = cut_lineage(_holdout(spark, sf), "model-predictions")
    b = rank_by_id(p, "response_id").withColumn("batch_id", F.floor((F.col("rank") - 1) / 8))
    cols = ["rmse_content", "rmse_wording", "mcrmse"]
    return rounded(ME.mcrmse(p).select(F.lit("rows").alias("over"), *cols)
                   .union(ME.mcrmse_batch_mean(b).select(F.lit("batches").alias("over"), *cols)))


@register("param_search")
def q_param_search(spark, sf, config=None, tries=150):
    """M3: random search (P4 over the C6 grid); one row per evaluated combination, two passes over the data in all."""
    config = config or {"reg": [round(0.005 * k, 3) for k in range(30)], "elastic": [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]}
    train, valid = _split(spark, sf)
    found = SE.search(train, valid, SA.param_sample(SA.param_grid(spark, config), tries), BASIC, TARGETS)
    return rounded(found.select("combo", "reg", "elastic", "rmse_content", "rmse_wording", "valid_mcrmse", "n_used"))


COUNTS, RATIOS = BASIC[:5], BASIC[5:]


@register("two_model_combine", SPLIT_SQL + _ridge_sql(COUNTS, "content", "content") + _ridge_sql(RATIOS, "wording", "wording")
          + f"""
SELECT response_id, round({_predicted_sql(COUNTS, 'content')}, 6) AS content,
       round({_predicted_sql(RATIOS, 'wording')}, 6) AS wording FROM va""")
def q_two_model_combine(spark, sf):
    """M5: content model on counts, wording model on ratios; predictions joined on the id."""
    train, valid = _split(spark, sf)
    mc = MO.fit_two_targets(train, COUNTS, ("content",), reg=RIDGE)
    mw = MO.fit_two_targets(train, RATIOS, ("wording",), reg=RIDGE)
    pc = MO.predict(mc, valid, COUNTS, "response_id")
    pw = MO.predict(mw, valid, RATIOS, "response_id")
    return rounded(ME.combine_predictions(pc, pw, "response_id", "p_content", "p_wording"))


def _tree_rows(spark, sf):
    """Labelled rows with scaled features, the response's mean word vector and its prompt's, and their part."""
    d = model_data(spark, sf)
    parts = SA.stratified_split(d.select("response_id", "prompt_id"), "response_id").select("response_id", "part")
    dims = 8
    mine = cut_lineage(WV.tokens(FX.responses(spark, sf), "response_id", "text"), "trees-words")
    theirs = WV.tokens(FX.prompts(spark, sf), "prompt_id", "prompt_text")
    vectors = WV.corpus_vectors(mine.select("words").union(theirs.select("words")), dims=dims)
    none = F.array_repeat(F.lit(0.0), dims)
    a = WV.text_vectors(mine, "response_id", vectors, dims)
    b = WV.text_vectors(theirs, "prompt_id", vectors, dims).withColumnRenamed("vector", "prompt_vector")
    d = (d.join(parts, "response_id").join(a, "response_id", "left").join(b, "prompt_id", "left")
         .withColumn("vector", F.coalesce("vector", none)).withColumn("prompt_vector", F.coalesce("prompt_vector", none)))
    return cut_lineage(d, "trees-rows")


@register("fit_trees")
def q_fit_trees(spark, sf):
    """M1, not linear: boosted trees on features || response vector || prompt vector, next to the ridge on the same held-out rows."""
    rows = _tree_rows(spark, sf)
    train, valid = rows.where("part = 'train'"), rows.where("part = 'valid'")
    trees = MO.predict_trees(MO.fit_trees(train, BASIC, ("vector", "prompt_vector"), TARGETS), valid, BASIC, ("vector", "prompt_vector"), "response_id")
    ridge = MO.predict(MO.fit_two_targets(train, BASIC, TARGETS, reg=RIDGE), valid, BASIC, "response_id")
    cols = ["rmse_content", "rmse_wording", "mcrmse"]
    return rounded(ME.mcrmse(trees).select(F.lit("trees").alias("model"), *cols).union(ME.mcrmse(ridge).select(F.lit("ridge").alias("model"), *cols)))
