"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are shuffled by a hash.  In the queue of its source, a document's virtual finish time is the
running number of the source's words up to its end, divided by the source's target; repeats
of a source follow as further epochs.  All queues are served together in the order of virtual
finish times, and the mix ends at the total budget.  A queue ends at its target: its last document is
taken in part and finishes at time 1.

Targets share the budget (100 % of all sizes) by weight; a target stops at three times its source's size and
the excess is shared again by weight until none is above.

Running sums are taken in two levels: inside buckets of about ``BUCKET`` documents, over hash ranges
of one source or over ranges of finish times, and over the bucket totals.  A source with a third of all
rows is spread over as many buckets as its rows need.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of its own,
the last one; ties in the shuffle order are broken by ``doc_id``, and repeated rows keep their number in an
arbitrary order among themselves; if all sizes are 0 all targets are 0; an empty table gives an empty
result; only ``doc_id``, ``text`` and ``source`` are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respscore.llm.common import WORD, free_names, own_columns
from respscore.session import cut_lineage

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
BUCKET = 2000
SEED = "mix-1"


def shuffle_key(docs: DataFrame):
    """Hash of seed, id and whole text as 32 hex digits: the shuffled order."""
    return F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(docs["doc_id"].cast("string"), F.lit("")),
                             F.coalesce(docs["text"], F.lit(""))))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
                       F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       shuffle_key(docs).alias("h"))


def targets(sized: DataFrame) -> DataFrame:
    """One row for each source: number, documents, size, weight, and target.

    Sources that reach their limit first are those with the smallest limit for each unit of weight.  In that
    order, the share of the others is the budget left over the weight left, and the first source whose
    share is within its limit ends the row of limited ones.
    """
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.array(*map(F.lit, WEIGHTS))
    each = (each.withColumn("source_no", rank)
            .withColumn("weight", F.element_at(weight, ((F.col("source_no") - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
            .withColumn("most", (F.col("source_size") * MOST_EPOCHS).cast("double")))
    by_limit = W.orderBy(F.col("most") / F.col("weight"), "source_no")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * MOST_EPOCHS
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    each = each.withColumn("share", left / weight_left).withColumn("place", F.row_number().over(by_limit))
    within = F.when(F.col("share") * F.col("weight") <= F.col("most"), F.struct("place", "share"))
    each = each.withColumn("share", F.min(within).over(every)["share"])
    target = F.coalesce(F.least(F.col("share") * F.col("weight"), F.col("most")), F.col("most"))
    return each.select("source", "source_no", "source_size", "n_docs", target.alias("target"))


def placed(sized: DataFrame) -> DataFrame:
    """Each document with its source's figures, its place (bucket, rn) and the words before it in its queue."""
    of = targets(sized).withColumnRenamed("source", "of_source")
    rows = sized.join(of, sized["source"].eqNullSafe(of["of_source"])).drop("of_source")
    n_buckets = F.ceil(F.col("n_docs") / BUCKET)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n_buckets / F.lit(1 << 32)))
    totals = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    totals = totals.select("source_no", "bucket", (F.sum("n").over(W.partitionBy("source_no").orderBy("bucket")) - F.col("n")).alias("offset"))
    inside = W.partitionBy("source_no", "bucket").orderBy("h", "doc_id")
    rows = (rows.withColumn("rn", F.row_number().over(inside))
            .withColumn("run", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0))))
    return (rows.join(totals, ["source_no", "bucket"])
            .withColumn("words_before", F.col("offset") + F.col("run") - F.col("size")).drop("offset", "run"))


def mix(placed_docs: DataFrame) -> DataFrame:
    """The mix: one row for each taking of a document, with ``finish`` and its ``position`` in words."""
    epoch = F.explode(F.sequence(F.lit(0), F.lit(MOST_EPOCHS - 1))).alias("epoch")
    start = F.col("epoch") * F.col("source_size") + F.col("words_before")
    target = F.floor("target")
    items = (placed_docs.select("*", epoch)
             .withColumn("words", F.least(target - start, F.col("size")))
             .where("words > 0")
             .withColumn("finish", (start + F.col("words")) / target))
    n_buckets, budget = (placed_docs.agg(F.ceil(F.count("*") / BUCKET).alias("n"), F.sum("size").alias("budget"))
                         .select(F.struct("n", "budget").alias("x")).scalar()[f] for f in ("n", "budget"))
    items = items.withColumn("range", F.floor(F.col("finish") * n_buckets))
    totals = items.groupBy("range").agg(F.sum("words").alias("n"))
    totals = totals.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("offset"))
    order = W.partitionBy("range").orderBy("finish", "source_no", "epoch", "bucket", "rn").rowsBetween(W.unboundedPreceding, 0)
    items = (items.withColumn("run", F.sum("words").over(order)).join(totals, "range")
             .withColumn("position", F.col("offset") + F.col("run") - F.col("words"))
             .where(F.col("position") < budget)
             .withColumn("words", F.least(F.col("words"), budget - F.col("position"))))
    return items.select("doc_id", "source", "source_no", "bucket", "rn", "h", "epoch", "words", "finish", "position")


def fair_mix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with their place and target, the mix in order of ``position``)."""
    rows = cut_lineage(placed(cut_lineage(sizes(docs), "mix-sizes")), "mix-placed")
    return rows, mix(rows)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their columns: a row for each taking, so repeats of a source are repeated rows.  A
    document that its source's target cuts stays whole."""
    rows, mixed = fair_mix(docs)
    takes = mixed.groupBy("h").agg(F.count("*").alias("n"))
    alike = rows.groupBy("h").agg(F.count("*").alias("k"))
    key, h, n, taking = free_names(docs, "key", "h", "n", "taking")
    takes = takes.join(alike, "h").select(F.col("h").alias(h), F.ceil(F.col("n") / F.col("k")).cast("int").alias(n))
    keyed = docs.withColumn(key, shuffle_key(docs))
    return (keyed.join(takes, F.col(key) == F.col(h))
            .withColumn(taking, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*own_columns(docs)))


def op4_fair_mix(spark, sf_dir: str) -> DataFrame:
    rows, mixed = fair_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    key = ["source_no", "bucket", "rn"]
    taken = mixed.groupBy(*key).agg(F.sum("words").alias("taken"))
    return (rows.join(taken, key, "left")
            .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


OP4_SQL = rf"""
WITH z AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM z GROUP BY source),
w AS (SELECT *, (1 + (source_no - 1) % 3)::DOUBLE AS weight, (3 * source_size)::DOUBLE AS most FROM s),
o AS (SELECT *, row_number() OVER l AS place,
  ((sum(source_size) OVER () - coalesce(sum(source_size) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 3)::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS share
  FROM w WINDOW l AS (ORDER BY most / weight, source_no)),
x AS (SELECT arg_min(share, place) AS share FROM o WHERE share * weight <= most),
t AS (SELECT source, source_no, source_size, coalesce(least(x.share * weight, most), most) AS target FROM o CROSS JOIN x),
q AS (SELECT z.doc_id, z.size, t.source_size, t.target,
  sum(z.size) OVER (PARTITION BY t.source_no ORDER BY z.h, z.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - z.size AS b
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(least(floor(target) - b, size), 0) + greatest(least(floor(target) - source_size - b, size), 0)
   + greatest(least(floor(target) - 2 * source_size - b, size), 0))::BIGINT AS taken FROM q
"""
