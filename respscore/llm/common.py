"""Helpers that several training-data operators share."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from respscore.session import cut_lineage, release  # noqa: F401

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for; callers size it to their data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the whole text as UTF-8 bytes (null text: empty); other columns are left out."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))


def free_names(table: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened where ``table`` has a column of that name; Spark compares names without their case."""
    taken, out = {c.lower() for c in table.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def own_columns(table: DataFrame) -> list[Column]:
    """All columns of a table under their own names, odd ones (dots, back-ticks) included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in table.columns]


def arrow_rows(batch: pa.RecordBatch, *names: str):
    """Tuples of the named columns of one Arrow batch."""
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names))


def small_batches(batches, max_bytes: int = 4 << 20, max_rows: int = 2000, size: str = "text"):
    """Slices of Arrow batches of about ``max_bytes`` of the column ``size``, one longer text at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(size))).to_pylist()
        begin = total = 0
        for i, n in enumerate(lengths):
            if i > begin and (total + (n or 0) > max_bytes or i - begin >= max_rows):
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n or 0
        if begin < len(lengths):
            yield batch.slice(begin)


def grouped(run, *keys: str):
    """Function for mapInArrow that calls ``run`` on the rows of each group, one table at a time.

    For rows that are partitioned and sorted by ``keys``.  Where groups are many and small this spares the stream that
    applyInArrow opens for each of them.  Results go out together.
    """
    def groups(batches):
        now, parts = None, []
        for batch in batches:
            rows = list(arrow_rows(batch, *keys))
            begin = 0
            for i in range(1, len(rows) + 1):
                if i == len(rows) or rows[i] != rows[begin]:
                    if rows[begin] != now and parts:
                        yield pa.Table.from_batches(parts)
                        parts = []
                    now = rows[begin]
                    parts.append(batch.slice(begin, i - begin))
                    begin = i
        if parts:
            yield pa.Table.from_batches(parts)

    def each(batches):
        out, n = [], 0
        for group in groups(batches):
            found = run(group)
            if found.num_rows:
                out.append(found)
                n += found.num_rows
            if n >= 10_000:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, n = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return each


@contextmanager
def arrow_rows_at_once(spark: SparkSession, rows: int):
    """While a step with wide rows runs, pass them to Python in Arrow batches of so many rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, root) for each node of an edge.

    Random-order contraction.  In each round every node points to the neighbour (or itself) that comes
    first in a hash order drawn for the round, pointers are followed once more, and edges are
    rewritten to the nodes pointed to; the number of edges falls by a constant factor in
    expectation, also on long chains.  Neighbour minima are aggregated on the map side, so a node
    with millions of edges is no hot task.  Each round is a written table.  ``root`` is some
    node of the component; callers take the minimum they need.
    """
    spark = edges.sparkSession
    live = cut_lineage(edges.select("a", "b").where("a <> b").distinct(), f"{name}-edges")
    mapping = None
    turn = 0
    while not live.isEmpty():
        order = lambda c, t=turn: F.struct(F.xxhash64(F.col(c), F.lit(t)).alias("h"), F.col(c).alias("id"))
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = (both.groupBy("a").agg(F.min(order("b")).alias("m"))
                 .select(F.col("a").alias("node"), F.least(F.col("m"), order("a"))["id"].alias("up")))
        first = cut_lineage(first, f"{name}-up{turn}")
        again = first.select(F.col("node").alias("up"), F.col("up").alias("root"))
        jump = cut_lineage(first.join(again, "up").select("node", "root"), f"{name}-jump{turn}")
        if mapping is None:
            mapping = jump
        else:
            moved = jump.select(F.col("node").alias("root"), F.col("root").alias("to"))
            mapping = (mapping.join(moved, "root", "left")
                       .select("node", F.coalesce("to", "root").alias("root")))
        to_a = jump.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = jump.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = cut_lineage(live.join(to_a, "a").join(to_b, "b").where("ra <> rb")
                           .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
                           f"{name}-edges{turn}")
        turn += 1
    if mapping is None:
        return live.select(F.col("a").alias("node"), F.col("a").alias("root"))
    return cut_lineage(mapping, f"{name}-roots")
