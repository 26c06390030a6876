"""Model queries against closed forms and refits on collected rows."""

import numpy as np
import pytest

from conftest import SF001
from respscore.operators import model as MO
from respscore.operators import profile as PR
from respscore.plans import q_model as Q


@pytest.fixture(scope="module")
def parts(spark):
    train, valid = Q._split(spark, SF001)
    return train.toPandas(), valid.toPandas()


def ridge(x, y, reg):
    """Coefficients and intercept with a penalty of reg / std(y) on each standardised coefficient."""
    cx, cy = x - x.mean(0), y - y.mean()
    a = cx.T @ cx / len(y)
    a += np.diag(np.diag(a)) * reg / y.std()
    b = np.linalg.lstsq(a, cx.T @ cy / len(y), rcond=None)[0]
    return b, y.mean() - b @ x.mean(0)


def test_fit_is_the_closed_form(spark, parts):
    train, _ = parts
    got = {(r["target"], r["term"]): r["value"] for r in Q.q_fit_two_targets(spark, SF001).collect()}
    for t in Q.TARGETS:
        b, a = ridge(train[Q.BASIC].to_numpy(), train[t].to_numpy(), Q.RIDGE)
        assert got[t, "intercept"] == pytest.approx(a, abs=2e-6)
        assert [got[t, f] for f in Q.BASIC] == pytest.approx(list(b), abs=2e-6)


def test_param_search_losses(spark, parts):
    train, valid = parts
    rows = Q.q_param_search(spark, SF001).collect()
    assert len(rows) == 150 and len({r["combo"] for r in rows}) == 150
    for r in rows:
        if r["elastic"] or not r["reg"]:
            continue
        each = []
        for t in Q.TARGETS:
            b, a = ridge(train[Q.BASIC].to_numpy(), train[t].to_numpy(), r["reg"])
            each.append(np.sqrt(np.mean((valid[t].to_numpy() - a - valid[Q.BASIC].to_numpy() @ b) ** 2)))
        assert r["valid_mcrmse"] == pytest.approx(np.mean(each), abs=2e-6)


def test_backward_elimination_against_refits(spark):
    rnd = np.random.default_rng(5)
    feats = ["f0", "f1", "f2", "f3"]
    x = rnd.normal(size=(90, 4))
    y = np.stack([2 * x[:, 0] - x[:, 1] + rnd.normal(size=90), x[:, 1] + 0.05 * x[:, 2] + rnd.normal(size=90)], 1)
    group = np.arange(90) % 3
    df = spark.createDataFrame([(int(g), *map(float, r), *map(float, t)) for g, r, t in zip(group, x, y)],
                               "prompt_id long, f0 double, f1 double, f2 double, f3 double, content double, wording double")

    def loss(cols):
        per = []
        for g in range(3):
            a = np.c_[np.ones(90), x[:, cols]]
            b = np.linalg.lstsq(a[group != g], y[group != g], rcond=None)[0]
            per.append(np.sqrt(np.mean((y - a @ b)[group == g] ** 2, axis=0)).mean())
        return np.mean(per)

    current, want = list(range(4)), []
    for turn in range(1, 4):
        tried = {f"f{c}": loss([k for k in current if k != c]) for c in current}
        best = min(tried, key=tried.get)
        good = tried[best] < loss(current)
        want += [(turn, f, v, good and f == best) for f, v in sorted(tried.items())]
        if not good:
            break
        current.remove(int(best[1]))
    got = [tuple(r) for r in MO.backward_elimination(df, feats, floor=1).collect()]
    assert [(a, b, d) for a, b, _, d in got] == [(a, b, d) for a, b, _, d in want]
    assert [c for *_, c, _ in got] == pytest.approx([c for *_, c, _ in want], abs=1e-6)


def test_kept_features(spark):
    corr = spark.createDataFrame([("a", 0.5, 0.4), ("b", -0.31, 0.0), ("c", 0.1, 0.2), ("d", None, 0.9)],
                                 "feature string, content double, wording double")
    kept = lambda rule: {r["feature"] for r in PR.kept_features(corr, rule).collect()}
    assert kept("any") == {"a", "b", "d"} and kept("both") == {"a"}


@pytest.mark.parametrize("reg, elastic", [(0.0, 0.0), (0.02, 0.0), (0.02, 0.5), (0.05, 1.0), (5.0, 1.0)])
def test_elastic_net_is_spark_ml(spark, reg, elastic):
    """Coordinate descent on Gram sums next to Spark ML's own solver on the rows, a constant feature included."""
    from respscore.operators import search as SE
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 4)) * [1, 10, 0.1, 1] + [0, 5, 0, 1]
    x[:, 3] = 0.5 * x[:, 0] + 0.3 * x[:, 3]
    y = x @ [1.0, -0.2, 3.0, 0.5] + rng.standard_normal(300)
    rows = [(*map(float, r), 2.0, float(v), float(-v * v)) for r, v in zip(x, y)]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, [*names, "content", "wording"])
    gram = SE.whole_sums(df, names, ("content", "wording"))
    from pyspark.ml.regression import LinearRegression
    a = MO.assemble(df, names)
    models = {t: LinearRegression(featuresCol="features", labelCol=t, predictionCol=f"p_{t}", regParam=reg, elasticNetParam=elastic, maxIter=10_000,
                                  tol=1e-13).fit(a) for t in ("content", "wording")}
    for i, t in enumerate(("content", "wording")):
        got = SE.elastic_net(gram, 6 + i, 5, reg, elastic)
        assert got[0] == pytest.approx(models[t].intercept, abs=1e-6)
        assert got[1:] == pytest.approx(models[t].coefficients.toArray(), abs=1e-6)
        pred = models[t].transform(MO.assemble(df, names)).toPandas()
        assert SE.rmse(gram, 6 + i, got) == pytest.approx(np.sqrt(np.mean((pred[t] - pred[f"p_{t}"]) ** 2)), abs=1e-6)


def test_trees_beat_the_line_where_the_data_bend(spark):
    """On a target that no line fits the trees' held-out loss is lower, and a rerun gives the same predictions."""
    rng = np.random.default_rng(2)
    rows = [(i, float(a), [float(b), float(c)], float(np.sin(2 * a) + (b > 0) * (c > 0)), float(a * b)) for i, (a, b, c) in enumerate(rng.standard_normal((600, 3)))]
    df = spark.createDataFrame(rows, "id long, a double, v array<double>, content double, wording double").repartition(3, "id")
    train, valid = df.where("id < 450"), df.where("id >= 450")
    runs = []
    for _ in range(2):
        got = MO.predict_trees(MO.fit_trees(train, ["a"], ["v"], rounds=30, depth=3, step=0.3), valid, ["a"], ["v"], "id").orderBy("id").toPandas()
        runs.append(got)
    assert runs[0].equals(runs[1]) and len(runs[0]) == 150
    line = MO.predict(MO.fit_two_targets(train, ["a"]), valid, ["a"], "id").toPandas()
    loss = lambda p: sum(np.sqrt(np.mean((p[t] - p[f"p_{t}"]) ** 2)) for t in ("content", "wording")) / 2
    assert loss(runs[0]) < 0.8 * loss(line)
