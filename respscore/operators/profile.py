"""Profiling and screening.

Every profile is one aggregate over the table (all columns in one ``agg``, so
one scan and one tiny shuffle) followed by an unpivot of the single result
row into a long table.  Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .ranking import running_sum


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Names of numeric columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def feature_columns(df: DataFrame, exclude) -> list[str]:
    """Every column except the given ids, texts and targets."""
    return [c for c in df.columns if c not in set(exclude)]


def group_counts(df: DataFrame, group: str = "prompt_id") -> DataFrame:
    """Rows per group, largest first."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), group)


def _unpivot(row: DataFrame, cols, stats) -> DataFrame:
    """One-row frame with ``{stat}__{col}`` fields -> (column, *stats)."""
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def exact_quantiles(df: DataFrame, cols, qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact quantiles with linear interpolation (position q * (n - 1)), per column.

    Equal values are counted first (on the map side), so a value that a third of the rows share is one row.  The distinct
    values are ranked over range partitions, whose borders Spark draws from the data: neither outliers nor heavy tails
    crowd a task.  Returns (column, q, value).
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"))
                                          for c in cols])).alias("s")).select("s.*").where(F.col("x").isNotNull())
    values = running_sum(long.groupBy("column", "x").agg(F.count(F.lit(1)).alias("c")), ["column"], ["x"], "c", "upto")
    totals = values.groupBy("column").agg(F.max("upto").alias("n"))
    need = totals.select("column", "n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
    need = need.withColumn("pos", F.col("q") * (F.col("n") - 1))
    need = need.select("column", "q", "pos", F.explode(F.array(
        F.floor("pos").cast("long"), F.ceil("pos").cast("long"))).alias("k")).distinct()
    # at most 2 * len(qs) wanted ranks for each column
    hit = values.join(need, "column").where((F.col("k") + 1 <= F.col("upto")) & (F.col("k") + 1 > F.col("upto") - F.col("c")))
    lo = hit.groupBy("column", "q", "pos").agg(F.min_by("x", "k").alias("v_lo"), F.max_by("x", "k").alias("v_hi"))
    return lo.select("column", "q", (F.col("v_lo") + (F.col("pos") - F.floor("pos")) *
                                     (F.col("v_hi") - F.col("v_lo"))).alias("value"))


def describe(df: DataFrame, cols=None) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear interpolation), max.

    The input is read by several branches (moments, histogram, bucket values),
    so its lineage is cut once first (reliable checkpoint of the projected columns).
    """
    from ..session import cut_lineage
    cols = cols or numeric_columns(df)
    df = cut_lineage(df.select(*cols))
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).cast("double").alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"),
                 F.stddev_samp(x).alias(f"std__{c}"), F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}")]
    base = _unpivot(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"])
    q = exact_quantiles(df, cols).groupBy("column").agg(
        *[F.max(F.when(F.col("q") == v, F.col("value"))).alias(n) for v, n in [(0.25, "p25"), (0.5, "p50"),
                                                                              (0.75, "p75")]])
    return base.join(q, "column", "left").select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def info(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null) for every column."""
    row = df.agg(*[F.count(F.col(f.name)).alias(f"nn__{f.name}") for f in df.schema.fields])
    for f in df.schema.fields:
        row = row.withColumn(f"dt__{f.name}", F.lit(f.dataType.simpleString()))
    out = _unpivot(row, df.columns, ["dt", "nn"])
    return out.select("column", F.col("dt").alias("dtype"), F.col("nn").cast("long").alias("non_null"))


def corr_with_targets(df: DataFrame, cols, targets=("content", "wording")) -> DataFrame:
    """Pearson correlation of every column with every target, long by column.

    A constant column (or target) has no correlation: NULL.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        for t in targets:
            y = F.col(t).cast("double")
            # Pearson as covariance / (std * std); try_divide keeps ANSI mode from
            # raising on a constant column, which has no correlation
            r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
            aggs.append(F.when((F.max(c) > F.min(c)) & (F.max(t) > F.min(t)), r).alias(f"{t}__{c}"))
    return _unpivot(df.agg(*aggs), cols, list(targets)).withColumnRenamed("column", "feature")


def corr_screen(corr: DataFrame, any_threshold: float = 0.3, both_threshold: float = 0.8) -> DataFrame:
    """Combined score and both screening decisions per feature."""
    c, w = F.abs("content"), F.abs("wording")
    both = F.round(c + w, 5)
    return corr.select("feature", "content", "wording", both.alias("both"),
                       F.coalesce((c > any_threshold) | (w > any_threshold), F.lit(False)).alias("keep_any"),
                       F.coalesce(both > both_threshold, F.lit(False)).alias("keep_both"))


def kept_features(corr: DataFrame, rule: str, **thresholds) -> DataFrame:
    """B7 / B8 as a filter: the features that the rule ``any`` or ``both`` keeps, with their correlations."""
    return corr_screen(corr, **thresholds).where(F.col(f"keep_{rule}")).select("feature", "content", "wording", "both")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins between min and max (max falls in the last bin).

    Every bin is reported, empty ones with count 0.
    """
    # global min / max as uncorrelated scalar subqueries (computed once, no join)
    mn = df.agg(F.min(col).cast("double")).scalar()
    mx = df.agg(F.max(col).cast("double")).scalar()
    width = (mx - mn) / bins
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    edges = edges.select("bin", (mn + F.col("bin") * width).alias("lo"), (mn + (F.col("bin") + 1) * width).alias("hi"))
    x = F.col(col).cast("double")
    b = F.when(mx > mn, F.least(F.floor((x - mn) * bins / (mx - mn)), F.lit(bins - 1))).otherwise(F.lit(0))
    counts = (df.where(F.col(col).isNotNull()).select(b.cast("int").alias("bin"))
                .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    return (edges.join(counts, "bin", "left")
                 .select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).cast("long").alias("count")))
