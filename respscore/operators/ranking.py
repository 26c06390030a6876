"""Exact ranks and running sums without a single-task window.

``row_number().over(partitionBy(g).orderBy(k))`` sorts a whole group in one
task, and ``orderBy(k)`` without a partition sorts everything in one task.
Here Spark draws the borders from the data: rows are range-partitioned by (group, order) once and written; each
partition holds a stretch of the whole order, of about equal size whatever the groups' sizes are.

1. ``repartitionByRange``, sorted inside, written with each row's place   -- one shuffle, borders sampled by Spark
2. rows (or sums) of each (group, partition)                              -- partial aggregate of the written table
3. offsets of a group's partitions before this one                        -- windows over one row for each of them
4. rank = offset + place inside the partition

A group holding a third of all rows is spread over a third of the partitions, and a group smaller than a partition
costs one row in step 3.  Nothing depends on a number of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: bits of the row's place inside its partition in ``monotonically_increasing_id``
PLACE_BITS = 33


def hex_hash(*cols, seed: str | None = None) -> Column:
    """md5 hex of the columns joined by '#', optionally with a seed: a
    deterministic, uniformly spread order that DuckDB can restate."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    if seed is not None:
        parts.append(F.lit(str(seed)))
    return F.md5(F.concat_ws("#", *parts))


def hash_int(h: Column) -> Column:
    """First 32 bits of a hex hash as a non-negative bigint."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def _before(parts: DataFrame, group, value: str) -> Column:
    """Sum of ``value`` over a group's earlier partitions."""
    w = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _joined(rows: DataFrame, parts: DataFrame, group) -> DataFrame:
    """Rows with the figures of their (group, partition); a null is a group like any other."""
    named = parts.select(*[F.col(c).alias(f"_of_{c}") for c in ("_p", *group)], *[c for c in parts.columns if c not in ("_p", *group)])
    same = rows["_p"] == named["_of__p"]
    for c in group:
        same = same & rows[c].eqNullSafe(named[f"_of_{c}"])
    return rows.join(named, same).drop(*[f"_of_{c}" for c in ("_p", *group)])


def rank_within(df: DataFrame, group=(), order=(), out: str = "rank") -> DataFrame:
    """1-based rank of every row by ``order`` inside ``group`` (``order`` should be unique in a group).

    All columns are written once; callers pass what they need.
    """
    g, keys = list(group), [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(placed, "ranked").withColumn("_p", F.shiftright("_at", PLACE_BITS))
    parts = placed.groupBy(*g, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    parts = parts.withColumn("_off", _before(parts, g, "_n")).select(*g, "_p", "_first", "_off")
    d = _joined(placed, parts, g)
    return d.withColumn(out, (F.col("_off") + F.col("_at") - F.col("_first") + 1).cast("long")).drop("_at", "_p", "_first", "_off")


def stretches(df: DataFrame, group, order, name: str = "running") -> DataFrame:
    """``df`` written in the order of (group, order); ``_p`` numbers the partitions, which follow one another in that order."""
    return cut_lineage(df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id()), name)


def scan_stretches(placed: DataFrame, group, order, value: Column, kind: str, out: str, inclusive: bool = True) -> DataFrame:
    """Running min, max or sum of ``value`` over a table of ``stretches``, which keeps its ``_p``.

    One row of each (group, partition) says what the stretch adds; a scan over those rows, at most one for each
    partition, says what was there before it; a window inside the stretch does the rest.  Nulls count as nothing; a sum
    of nothing is 0, a minimum or maximum of nothing null.
    """
    fn = {"min": F.min, "max": F.max, "sum": F.sum}[kind]
    both = {"min": F.least, "max": F.greatest, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}[kind]
    g = list(group)
    d = placed.withColumn("_v", value)
    earlier = Window.partitionBy(*g).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy(*g, "_p").agg(fn("_v").alias("_all")).select(*g, "_p", fn("_all").over(earlier).alias("_before"))
    inside = Window.partitionBy(*g, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = _joined(d.withColumn("_in", fn("_v").over(inside)), parts, g)
    return d.withColumn(out, both(F.col("_before"), F.col("_in"))).drop("_v", "_in", "_before")


def running(df: DataFrame, group, order, value: Column, kind: str, out: str, inclusive: bool = True) -> DataFrame:
    """Running min, max or sum of ``value`` in ``order`` inside ``group``; exclusive scans leave the row itself out."""
    return scan_stretches(stretches(df, group, order), group, order, value, kind, out, inclusive).drop("_p")


def running_sum(df: DataFrame, group, order, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows up to this one in ``order`` inside ``group``."""
    return running(df, group, order, F.col(value), "sum", out)


def previous_value(df: DataFrame, group, order, value: str, out: str) -> DataFrame:
    """``value`` of the row before, in ``order`` inside ``group``; null for a group's first row."""
    g = list(group)
    placed = stretches(df, g, order)
    last = placed.groupBy(*g, "_p").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    parts = last.select(*g, "_p", F.lag("_last").over(Window.partitionBy(*g).orderBy("_p")).alias("_before"))
    inside = Window.partitionBy(*g, "_p").orderBy(*order)
    d = _joined(placed.withColumn("_in", F.lag(F.struct(F.col(value).alias("v"))).over(inside)), parts, g)
    return d.withColumn(out, F.coalesce("_in", "_before")["v"]).drop("_p", "_in", "_before")


def rank_by_hash(df: DataFrame, h: str, key: str, group=(), out: str = "rank") -> DataFrame:
    """Rank inside ``group`` by (hash column ``h``, ``key``)."""
    return rank_within(df, group=group, order=[h, key], out=out)


def rank_by_id(df: DataFrame, key: str, group=(), out: str = "rank") -> DataFrame:
    """Rank inside ``group`` by a unique key."""
    return rank_within(df, group=group, order=[key], out=out)


def by_repeated_key(df: DataFrame, key: str):
    """(rows whose key is theirs alone, rows that share a key or None): only the keys are grouped."""
    repeated = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(F.col(key).alias("_key")), "repeated-keys")
    if repeated.isEmpty():
        return df, None
    same = F.col(key).eqNullSafe(F.col("_key"))
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")
