"""Per-group min-max scaling (E1) and non-finite replacement.

Scaling uses a grouped min/max (partial aggregation on the map side, so a
prompt holding a third of all rows costs one row per task) joined back on the
group key.  The statistics table has one row per group; Spark broadcasts it
when its measured size is under the threshold.  A window partitioned by the
group would instead put a whole hot prompt into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def minmax_by_group(df: DataFrame, cols, group: str = "prompt_id") -> DataFrame:
    """(x - min) / (max - min) within each group; a constant group -> 0."""
    cols = list(cols)
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"_mn_{c}"), F.max(c).alias(f"_mx_{c}")]
    stats = df.groupBy(group).agg(*aggs)
    j = df.join(stats, group)
    out = []
    for f in df.columns:
        if f in cols:
            mn, mx = F.col(f"_mn_{f}"), F.col(f"_mx_{f}")
            out.append(F.when(mx > mn, (F.col(f).cast("double") - mn) / (mx - mn).cast("double"))
                        .otherwise(F.lit(0.0)).alias(f))
        else:
            out.append(F.col(f))
    return j.select(*out)


def fit_minmax(df: DataFrame, cols, group: str = "prompt_id") -> DataFrame:
    """State of a scaler: one row for each group with its rows and each column's minimum and maximum."""
    bounds = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in cols for n, f in (("mn", F.min), ("mx", F.max))]
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), *bounds)


def merge_minmax(states: DataFrame, cols, group: str = "prompt_id") -> DataFrame:
    """One state out of the states of several parts of the rows, in any order."""
    bounds = [f(f"{n}_{c}").alias(f"{n}_{c}") for c in cols for n, f in (("mn", F.min), ("mx", F.max))]
    return states.groupBy(group).agg(F.sum("n_rows").alias("n_rows"), *bounds)


def apply_minmax(df: DataFrame, state: DataFrame, cols, group: str = "prompt_id") -> DataFrame:
    """E1 with a fitted state: values outside the fitted range fall outside [0, 1]; a constant column and a group that the
    state does not know become 0."""
    cols = list(cols)
    known = state.select(F.col(group).alias("_g"), *[F.col(f"{n}_{c}").alias(f"_{n}_{c}") for c in cols for n in ("mn", "mx")])
    j = df.join(known, df[group].eqNullSafe(F.col("_g")), "left")
    scaled = lambda c: F.when(F.col(f"_mx_{c}") > F.col(f"_mn_{c}"), (F.col(c).cast("double") - F.col(f"_mn_{c}")) / (F.col(f"_mx_{c}") - F.col(f"_mn_{c}"))).otherwise(F.lit(0.0))
    return j.select(*[scaled(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def nonfinite_to_zero(df: DataFrame, cols=None) -> DataFrame:
    """NULL, NaN, +inf and -inf -> 0 in the given (default: all double) columns."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    cols = set(cols)
    inf = float("inf")
    out = []
    for f in df.columns:
        if f in cols:
            c = F.col(f)
            out.append(F.when(c.isNull() | F.isnan(c) | c.isin(inf, -inf), F.lit(0.0))
                        .otherwise(c).alias(f))
        else:
            out.append(F.col(f))
    return df.select(*out)
