"""Parameter search for linear models without a pass over the data for each combination (M3).

One pass adds up the products of features and targets (Gram sums) of the training rows and one those of the held-out rows.  An elastic
net depends on its rows through these sums alone, and so does its held-out loss, so every combination is solved in a task of
its own by coordinate descent with covariance updates.  The combinations are a table; Spark deals them out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import _matrix, _terms, gram_sums


def whole_sums(df: DataFrame, features, targets) -> np.ndarray:
    """Gram matrix of (1, features, targets) over all rows: terms x terms numbers."""
    return _matrix(gram_sums(df.withColumn("_all", F.lit(0)), features, targets, "_all").first(), _terms(list(features), targets))


def elastic_net(gram: np.ndarray, y: int, n_features: int, reg: float, elastic: float, tol: float = 1e-12, rounds: int = 100_000) -> np.ndarray:
    """Intercept and coefficients that minimise the mean squared error / 2 with the penalty ``reg`` on standardised coefficients.

    The penalty is ``elastic`` parts absolute and the rest half squared, relative to the target's deviation.  Features
    that don't vary get 0.
    """
    n = gram[0, 0]
    x = np.arange(1, n_features + 1)
    mean = gram[0] / n
    cov = gram / n - np.outer(mean, mean)
    dev = np.sqrt(np.maximum(np.diag(cov), 0))
    vary = dev[x] > 1e-12 * np.maximum(1, np.abs(mean[x]))
    out = np.zeros(n_features + 1)
    if dev[y] > 0 and vary.any():
        live = x[vary]
        r = cov[np.ix_(live, live)] / np.outer(dev[live], dev[live])
        c = cov[live, y] / (dev[live] * dev[y])
        l1, l2 = reg / dev[y] * elastic, reg / dev[y] * (1 - elastic)
        beta, left = np.zeros(len(live)), c.copy()  # left: what is not explained yet, as covariances
        if l1 == 0:
            beta = np.linalg.lstsq(r + l2 * np.eye(len(live)), c, rcond=None)[0]
            rounds = 0
        for _ in range(rounds):
            widest = 0.0
            for j in range(len(live)):
                z = left[j] + r[j, j] * beta[j]
                new = np.sign(z) * max(abs(z) - l1, 0) / (r[j, j] + l2)
                step = new - beta[j]
                if step:
                    left -= r[:, j] * step
                    beta[j], widest = new, max(widest, abs(step))
            if widest < tol:
                break
        out[live] = beta * dev[y] / dev[live]
    out[0] = mean[y] - out[x] @ mean[x]
    return out


def rmse(gram: np.ndarray, y: int, coefficients: np.ndarray) -> float:
    """Loss of a linear model on the rows behind the Gram sums."""
    x = np.arange(len(coefficients))
    square = gram[y, y] - 2 * coefficients @ gram[x, y] + coefficients @ gram[np.ix_(x, x)] @ coefficients
    return float(np.sqrt(max(square, 0.0) / gram[0, 0])) if gram[0, 0] else float("nan")


def search(train: DataFrame, valid: DataFrame, combos: DataFrame, features, targets=("content", "wording")) -> DataFrame:
    """Every row of ``combos`` (combo, reg, elastic) with its held-out loss for each target, their mean, and the features used."""
    features, targets = list(features), list(targets)
    fit_sums, held_sums = whole_sums(train, features, targets), whole_sums(valid, features, targets)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c in pdf.itertuples(index=False):
                models = [elastic_net(fit_sums, 1 + len(features) + i, len(features), c.reg, c.elastic) for i in range(len(targets))]
                losses = [rmse(held_sums, 1 + len(features) + i, m) for i, m in enumerate(models)]
                rows.append((c.combo, c.reg, c.elastic, *losses, float(np.mean(losses)), int(sum((m[1:] != 0).sum() for m in models))))
            yield pd.DataFrame(rows, columns=names)

    names = ["combo", "reg", "elastic", *[f"rmse_{t}" for t in targets], "valid_mcrmse", "n_used"]
    schema = "combo string, reg double, elastic double, " + ", ".join(f"rmse_{t} double" for t in targets) + ", valid_mcrmse double, n_used long"
    # a few combinations to a task; how many there are is the search's own parameter
    rows = combos.select("combo", F.col("reg").cast("double").alias("reg"), F.col("elastic").cast("double").alias("elastic"))
    return rows.repartition("combo").mapInPandas(solve, schema)
