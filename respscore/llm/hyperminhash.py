"""Near-duplicate documents by HyperMinHash sketches.

A document's set is its distinct five-word shingles, hashed to 64 bits.  A sketch has ``REGISTERS`` registers;
each keeps the smallest value of one seeded hash over the set, compressed to its number of leading zeros and its next
``MANTISSA`` bits.  (Every register hashes the whole set, instead of a share of it, so that texts with few shingles
have no empty registers.)  Bands of compressed registers meet by hash; ``BANDS`` bands of ``ROWS``
registers find a pair at the threshold 0.75 with probability 1 - (1 - 0.75 ** 6) ** 40 > 0.9995.

Candidates are verified on full sets in two rounds, so that neither round emits the pairs of a group:

1. each member of a band's bucket against the bucket's smallest member; links give components;
2. in buckets whose members still belong to several components, pairs across components, in blocks of bounded size:
   pairs whose collision-corrected estimate is well below the threshold are left out, the others are
   verified, the most similar first, unless earlier links have joined them.

Documents with equal sets are one node from the start, however many there are.

Defined results: null and empty texts have no set, link with nothing and stand alone (their component is their own id);
texts with fewer than five words have their whole word sequence as the only shingle; texts are read whole;
repeated rows (same id) belong to one component and all have its result; a null ``doc_id`` takes part in links but
never names a component, unless nothing else is in it (then null); an empty table gives an empty result; only
``doc_id`` and ``text`` are read.  Sets and nodes are 64-bit hashes: a chance collision is of the order
of (documents ** 2) / 2 ** 65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respscore.llm.common import (WORD, arrow_rows, arrow_rows_at_once, components, free_names, grouped, own_columns, release, shuffle_width,
                                  small_batches)
from respscore.session import cut_lineage

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Two different values fall on the same register: both in the same octave and the same of its 2 ** MANTISSA steps.
CHANCE = 2.0 ** -MANTISSA / 3
#: An estimate this far below the threshold (4.5 standard deviations) rules a pair out.
LEAST_ESTIMATE = PERCENT / 100 - 4.5 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
BLOCK = 1000
#: Rows with whole sets that pass to Python at once.
WIDE_ROWS = 256

_rng = np.random.default_rng(20)
_PLACE = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """Sorted hashes of the distinct shingles; bytes.lower() lower-cases A-Z, split() splits at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64)
    n = len(words) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += mixed(hashes[k:k + n]) * _PLACE[k]
    return np.unique(mixed(total))


def smallest(values: np.ndarray) -> np.ndarray:
    """The smallest value of each seeded hash over a set."""
    out = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 256):
        np.minimum(out, np.multiply.outer(values[i:i + 256], _SEEDS).min(axis=0), out=out)
    return out


def registers(smallest_values: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits in 16 bits; a float64 holds both as exponent and mantissa."""
    bits = np.maximum(smallest_values, 1).astype(np.float64).view(np.uint64)
    zeros = 63 - np.minimum((bits >> np.uint64(52)).astype(np.int64) - 1023, 63)
    return (zeros << MANTISSA | ((bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of one sketch and rows of sketches, corrected for chance collisions."""
    return ((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets reach the threshold, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _sketched(batches):
    for batch in small_batches(batches):
        ids, digests, sizes, nodes, lows = [], [], [], [], []
        for doc_id, digest, text in arrow_rows(batch, "doc_id", "digest", "text"):
            found = shingles(text)
            ids.append(doc_id)
            digests.append(digest)
            sizes.append(len(found))
            nodes.append(int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(found.tobytes())))) if len(found) else None)
            lows.append(smallest(found))
        sketch = registers(np.array(lows, np.uint64).reshape(-1, REGISTERS))
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.binary()), "n_shingles": pa.array(sizes, pa.int64()),
            "node": pa.array(nodes, pa.int64()), "sketch": pa.array([r.tobytes() for r in sketch], pa.binary())})


def _sets(batches):
    """(node, set) once for each node in this task."""
    seen = set()
    for batch in small_batches(batches):
        rows = []
        for node, text in arrow_rows(batch, "node", "text"):
            if node not in seen:
                seen.add(node)
                rows.append((node, shingles(text).tobytes()))
        yield pa.RecordBatch.from_pydict({"node": pa.array([r[0] for r in rows], pa.int64()),
                                          "shingles": pa.array([r[1] for r in rows], pa.binary())})


def _verified(batches):
    """Links (a, b) among rows with both sets."""
    as_set = lambda x: np.frombuffer(x, np.uint64)
    for batch in batches:
        for part in small_batches([batch], size="set_b"):
            rows = [(a, b) for a, b, x, y in arrow_rows(part, "a", "b", "set_a", "set_b") if similar(as_set(x), as_set(y))]
            yield pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in rows], pa.int64()),
                                              "b": pa.array([r[1] for r in rows], pa.int64())})


def _across(group: pa.Table) -> pa.Table:
    """Links between members of different components in one block or pair of blocks of a bucket."""
    data = group.to_pydict()
    lo, hi = data["lo"][0], data["hi"][0]
    n, nodes, block = group.num_rows, data["node"], np.array(data["block"])
    sketch = np.frombuffer(b"".join(data["sketch"]), "<u2").reshape(n, REGISTERS)
    root = {r: r for r in data["root"]}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    number = {r: i for i, r in enumerate(root)}
    part = np.array([number[r] for r in data["root"]])
    near = []
    for i in range(n - 1):
        other = np.flatnonzero((part[i + 1:] != part[i]) & ((block[i + 1:] != block[i]) if lo != hi else True)) + i + 1
        if len(other):
            value = estimate(sketch[i], sketch[other])
            near.extend((-v, i, j) for v, j in zip(value.tolist(), other.tolist()) if v >= LEAST_ESTIMATE)
    links = []
    for _, i, j in sorted(near):
        a, b = find(data["root"][i]), find(data["root"][j])
        if a != b and similar(*(np.frombuffer(data["shingles"][k], np.uint64) for k in (i, j))):
            root[a] = b
            links.append((nodes[i], nodes[j]))
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n_shingles, component (a number; null: no set) and component_id of every document."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                        F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    texts = texts.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")
    sketches = cut_lineage(texts.mapInArrow(_sketched, "doc_id long, digest binary, n_shingles long, node long, sketch binary"), "hmh-sketch")
    nodes = cut_lineage(sketches.where("node is not null").groupBy("node")
                        .agg(F.min("sketch").alias("sketch"), F.min("digest").alias("digest"), F.min("doc_id").alias("doc_id")), "hmh-node")

    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    keys = nodes.select("node", "sketch", band.alias("band")).select(
        "node", F.xxhash64("band", F.expr(f"substring(sketch, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("center")).where("n > 1")
    members = cut_lineage(keys.join(buckets, "key").select("key", "n", "node", "center"), "hmh-member")
    release(spark)

    # sets of the nodes that met another one, from one of the texts of each
    wanted = members.select("node").distinct().join(nodes, "node").select("node", "digest")
    sets = (texts.select("digest", "text").join(wanted, "digest").select("node", "text")
            .mapInArrow(_sets, "node long, shingles binary").groupBy("node").agg(F.min("shingles").alias("shingles")))
    with arrow_rows_at_once(spark, WIDE_ROWS):
        sets = cut_lineage(sets.join(nodes.select("node", "sketch"), "node"), "hmh-set")
    release(spark)

    pairs = members.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    side = lambda k: sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}"))
    with arrow_rows_at_once(spark, WIDE_ROWS):
        links = cut_lineage(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
                            .mapInArrow(_verified, "a long, b long"), "hmh-link")
    release(spark)
    first = components(links, "hmh-first")

    placed = members.join(first, "node", "left").select("key", "n", "node", F.coalesce("root", "node").alias("root"))
    open_keys = (placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max("n").alias("n"),
                                           F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("content")).where("r <> s")
                 # buckets with the same members are one
                 .groupBy("n", "content").agg(F.min("key").alias("key")).select("key"))
    n_blocks = F.ceil(F.col("n") / BLOCK)
    rows = (placed.join(open_keys, "key")
            .withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), n_blocks))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
            .select("key", "node", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    more = (rows.join(sets, "node").repartition(shuffle_width(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(grouped(_across, "key", "lo", "hi"), "a long, b long"))
    with arrow_rows_at_once(spark, WIDE_ROWS):
        links = links.union(cut_lineage(more, "hmh-more"))
    final = components(links, "hmh-final")

    roots = nodes.select("node", "doc_id").join(final, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(least, "root").select("node", F.col("root").alias("component"), "component_id")
    return (sketches.select("doc_id", "digest", "n_shingles", "node").join(named, "node", "left")
            .select("doc_id", "digest", "n_shingles", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def op10_hyperminhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest id (null last) and, among equal ids, the first digest; and all
    documents without words.  Columns as they were; of rows that repeat each other one stays."""
    found = near_duplicates(docs).where("component is not null")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("x"))
    mark, words, n, best_id, best_digest = free_names(docs, "mark", "words", "n", "best_id", "best_digest")
    best = best.select(F.col("x.doc_id").alias(best_id), F.col("x.digest").alias(best_digest))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(mark, F.unhex(F.md5(text.cast("binary")))).withColumn(words, text.rlike(WORD))
    same = (F.col(mark) == F.col(best_digest)) & F.col("doc_id").cast("long").eqNullSafe(F.col(best_id))
    one = F.row_number().over(W.partitionBy(mark, F.col("doc_id").cast("long")).orderBy(mark))
    columns = own_columns(docs)
    kept = rows.where(F.col(words)).join(best, same, "left_semi").withColumn(n, one).where(F.col(n) == 1).select(*columns)
    return kept.union(rows.where(~F.col(words)).select(*columns))
