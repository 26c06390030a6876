"""N-gram multisets and their overlaps.

A text's n-gram multiset is kept as a long table ``(key, gram, cnt, rank)``
where ``rank`` is the order of first appearance (the key order of the
original's counters).  A text lies in one row, so its grams are counted and
ranked inside the row (a counter in a task) and nothing is shuffled.  Only texts
that share their key with another row are merged by an aggregate keyed by
``(key, gram)`` and a window for the rank.
Overlaps are equi-joins on ``(prompt_id, gram)`` or ``(prompt_id, rank, gram)``:
no per-row quadratic array scans, no cross products.  Two texts of one row are
compared inside it.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranking import by_repeated_key


#: grams that a task holds before it hands them on
_CHUNK = 1 << 16


def _token_rows(batch, *columns):
    """(row, tokens of each column) of a batch, some rows at a time; null arrays are empty."""
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        lists = []
        for c in columns:
            col = part.column(part.schema.get_field_index(c))
            flat = iter(col.flatten().to_pylist())
            lists.append([list(islice(flat, size or 0)) for size in pc.list_value_length(col).to_pylist()])
        yield from ((start + i, *words) for i, words in enumerate(zip(*lists)))


def _counter(words: list, n: int) -> Counter:
    """Grams with their counts, in order of first appearance."""
    return Counter(map(" ".join, zip(*(words[k:] for k in range(n)))))


def gram_table(df: DataFrame, key: str, tokens: str, ns=(2, 3, 4), extra=()) -> DataFrame:
    """(key, *extra, n, gram, cnt, rank) for each n in ``ns``; rows with equal keys count as one text."""
    single, shared = by_repeated_key(df, key)
    kept = [key, *extra]

    def run(batches):
        for batch in batches:
            out = [], [], [], [], []

            def flushed():
                at = pa.array(out[0], pa.int32())
                found = pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index(k)).take(at) for k in kept]
                    + [pa.array(v, t) for v, t in zip(out[1:], (pa.int32(), pa.string(), pa.int64(), pa.int32()))], names=[*kept, "n", "gram", "cnt", "rank"])
                for v in out:
                    v.clear()
                return found

            for row, words in _token_rows(batch, tokens):
                for n in ns:
                    grams = _counter(words, n)
                    for v, more in zip(out, ([row] * len(grams), [n] * len(grams), grams, grams.values(), range(1, len(grams) + 1))):
                        v.extend(more)
                if len(out[0]) >= _CHUNK:
                    yield flushed()
            if out[0]:
                yield flushed()

    schema = df.select(*kept).schema.add("n", "integer").add("gram", "string").add("cnt", "long").add("rank", "integer")
    counted = single.select(*kept, tokens).mapInArrow(run, schema)
    return counted if shared is None else counted.unionByName(merged_gram_table(shared, key, tokens, ns, extra))


def merged_gram_table(df: DataFrame, key: str, tokens: str, ns=(2, 3, 4), extra=()) -> DataFrame:
    """The same over rows that share keys, by aggregates."""
    parts = []
    for n in ns:
        g = df.select(key, *extra, F.lit(n).alias("n"),
                      F.posexplode(T.ngrams(tokens, n)).alias("pos", "gram"))
        parts.append(g)
    g = parts[0]
    for p in parts[1:]:
        g = g.unionByName(p)
    agg = g.groupBy(key, *extra, "n", "gram").agg(F.count(F.lit(1)).alias("cnt"),
                                                  F.min("pos").alias("first"))
    w = Window.partitionBy(key, "n").orderBy("first")
    return agg.withColumn("rank", F.row_number().over(w)).drop("first")


def aligned_overlap(a: DataFrame, b: DataFrame, key_a: str, key_b: str,
                    on=("prompt_id",)) -> DataFrame:
    """N9 as written: i-th distinct gram of A equals i-th of B -> add max(countA, countB).

    ``a`` has (key_a, *on, n, gram, cnt, rank); ``b`` has (key_b or on-keys, n, gram, cnt, rank).
    Returns (key_a, n, aligned).
    """
    bb = b.select(*on, "n", "gram", "rank", F.col("cnt").alias("cnt_b"))
    j = a.join(bb, [*on, "n", "rank", "gram"])
    return j.groupBy(key_a, "n").agg(F.sum(F.greatest("cnt", "cnt_b")).alias("aligned"))


def aligned_texts(df: DataFrame, key: str, a: str, b: str, ns=(2, 3, 4)) -> DataFrame:
    """N9 between two token columns of a table: (key, n, aligned) where grams of equal rank are equal."""
    single, shared = by_repeated_key(df, key)

    def run(batches):
        for batch in batches:
            rows, sizes, sums = [], [], []
            for row, x, y in _token_rows(batch, a, b):
                for n in ns:
                    met = [max(c, d) for (g, c), (h, d) in zip(_counter(x, n).items(), _counter(y, n).items()) if g == h]
                    if met:
                        rows.append(row), sizes.append(n), sums.append(sum(met))
            keys = batch.column(batch.schema.get_field_index(key)).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int32()), pa.array(sums, pa.int64())], names=[key, "n", "aligned"])

    out = single.select(key, a, b).mapInArrow(run, df.select(key).schema.add("n", "integer").add("aligned", "long"))
    if shared is None:
        return out
    left, right = (merged_gram_table(shared, key, x, ns) for x in (a, b))
    return out.unionByName(aligned_overlap(left, right, key, key, on=(key,)))


def multiset_overlap(a: DataFrame, b: DataFrame, key_a: str, on=("prompt_id",)) -> DataFrame:
    """Conventional multiset intersection size, sum(min(countA, countB))."""
    bb = b.select(*on, "n", "gram", F.col("cnt").alias("cnt_b"))
    j = a.join(bb, [*on, "n", "gram"])
    return j.groupBy(key_a, "n").agg(F.sum(F.least("cnt", "cnt_b")).alias("overlap"))


def per_n_columns(df: DataFrame, key: str, value: str, prefix: str, ns=(2, 3, 4)) -> DataFrame:
    """Long (key, n, value) -> wide (key, {prefix}_{n}) via conditional aggregation."""
    return df.groupBy(key).agg(*[F.sum(F.when(F.col("n") == n, F.col(value))).alias(f"{prefix}_{n}")
                                 for n in ns])
