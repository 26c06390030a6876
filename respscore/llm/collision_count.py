"""Near-duplicate embeddings by collision-counting projections.

A unit vector is projected on ``PROJECTIONS`` random directions.  Two vectors at the threshold are DELTA apart, and
on each direction their difference is normal with deviation DELTA, so they fall in each other's window of
half-width WIDTH with the known probability P_NEAR, independently on each direction.  From this follows
the number of collisions a pair must have (``least_collisions``), passed by 99.99 % of the pairs at the threshold.

Windows over one projection hold a fixed share of a label's vectors, so pairs are not counted over whole labels.  A table deals the
vectors of a label to cells: k further projections, each cut into steps of CELL with a random offset.  Pairs at the
threshold share a cell with probability ``same_cell(DELTA) ** k``, and there are as many tables as let 99.99 % of them share
one (``tables``).  k grows with the logarithm of the label's vectors, so that a cell holds about MATES vectors
of no likeness (``key_length``), and the share of pairs that meet falls as a label grows.

In a cell each projection is sorted, every vector is a query whose window is a stretch of the sorted list, the collisions of each
pair are counted over all projections, and pairs that pass are verified by their cosine in double precision.  A pair that has met
in an earlier table is left to it.  Cells are cut into blocks of bounded size and blocks meet in pairs, so neither a crowded cell nor
a large group of near copies comes to one task.  What leaves a task is no pair but, for each vector, its number of links and one link
of a spanning forest.  Equal vectors of a label are one node with a count from the start.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null
label, link with nothing (0 links, component = own id, kept); vectors of different lengths don't link; repeated rows are
vectors of their own; a null ``vec_id`` never names a component unless nothing else is in it; an empty table
gives an empty result; only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respscore.llm.common import arrow_rows, arrow_rows_at_once, components, grouped, release
from respscore.session import cut_lineage

COSINE = 0.93
PROJECTIONS = 16
DELTA = math.sqrt(2 - 2 * COSINE)
WIDTH = 1.5 * DELTA
P_NEAR = math.erf(WIDTH / DELTA / math.sqrt(2))
RECALL = 0.9999
CELL = 6 * DELTA
MATES = 128
BLOCK = 1000
WIDE_ROWS = 4000


def least_collisions(recall: float = RECALL) -> int:
    """The largest count that pairs at the threshold reach with probability ``recall``."""
    tail = 0.0
    for k in range(PROJECTIONS, 0, -1):
        tail += math.comb(PROJECTIONS, k) * P_NEAR ** k * (1 - P_NEAR) ** (PROJECTIONS - k)
        if tail >= recall:
            return k
    return 0


LEAST = least_collisions()


def same_cell(distance: float) -> float:
    """Probability that one projection puts two vectors of this distance in the same step of CELL."""
    x = CELL / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def key_length(vectors: int) -> int:
    """Projections in a key: about MATES of so many vectors at right angles share a cell.

    A key whose tables together let more pairs meet than a label has is none (a label below about 1000 vectors is one cell).
    """
    far = same_cell(math.sqrt(2))
    length = max(0, math.ceil(math.log(max(vectors, 1) / MATES) / -math.log(far)))
    return length if tables(length) * far ** length < 1 else 0


def tables(length: int, recall: float = RECALL) -> int:
    """Tables in which pairs at the threshold share at least one cell with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log1p(-same_cell(DELTA) ** length)) if length else 1


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng([11, dim]).standard_normal((dim, PROJECTIONS))


@lru_cache(maxsize=8)
def _key_directions(dim: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    rng, n = np.random.default_rng([13, dim, length]), length * tables(length)
    return rng.standard_normal((dim, n)), rng.uniform(0, CELL, n)


def cells_of(units: np.ndarray, vectors: int) -> np.ndarray:
    """Cell of each unit vector in each table, for a label of so many vectors: a hash of the steps of its key."""
    length = key_length(vectors)
    ways, offsets = _key_directions(units.shape[1], length)
    steps = np.floor((units @ ways + offsets) / CELL).astype(np.int64).view(np.uint64).reshape(len(units), tables(length), length)
    mixed = np.zeros(steps.shape[:2], np.uint64)
    for j in range(length):
        mixed = (mixed ^ steps[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed & np.uint64(0x7FFFFFFF)).astype(np.int32)


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    found = np.frombuffer(b"".join(vectors), kind).astype(np.float64).reshape(len(vectors), -1)
    found = found / np.abs(found).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _celled(kind: str):
    """Rows with their vector's bytes and its cells."""
    def run(batches):
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            vectors = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in column("embedding")]
            shapes = list(arrow_rows(batch, "dim", "n"))
            cells = [None] * len(vectors)
            for shape in set(shapes):
                at = [i for i, s in enumerate(shapes) if s == shape]
                for i, found in zip(at, cells_of(_units([vectors[i] for i in at], kind), shape[1])):
                    cells[i] = found
            yield pa.RecordBatch.from_arrays(
                [*(column(n) for n in ("node", "label", "members", "dim")), pa.array(vectors, pa.binary()), pa.array(cells, pa.list_(pa.int32()))],
                names=["node", "label", "members", "dim", "vector", "cells"])
    return run


def windows(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each sorted projection (row): the rank of every vector, and begin and length of the window around it, as ranks."""
    kind, order = np.min_scalar_type(places.shape[1]), np.argsort(places, axis=1)
    rank = np.empty(places.shape, kind)
    np.put_along_axis(rank, order, np.arange(places.shape[1], dtype=kind)[None], axis=1)
    ranked = np.take_along_axis(places, order, axis=1)
    begin = np.stack([np.searchsorted(r, p - WIDTH, "left") for r, p in zip(ranked, places)])
    end = np.stack([np.searchsorted(r, p + WIDTH, "right") for r, p in zip(ranked, places)])
    return rank, begin.astype(kind), (end - begin).astype(kind)


def window_collisions(ranks: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """In how many projections each vector (``ranks``) lies in each query's window; ranks before a window wrap around and lie behind it."""
    count = np.zeros((begins.shape[1], ranks.shape[1]), np.uint8)
    for rank, begin, length in zip(ranks, begins, lengths):
        count += ((rank - begin[:, None]) < length[:, None]).view(np.uint8)
    return count


def _met(kind: str):
    """Links of one block or pair of blocks of a cell: (node, number of linked vectors, root in a forest)."""
    def run(group: pa.Table) -> pa.Table:
        first, n = group.select(["tab", "lo", "hi", "dim"]).slice(0, 1).to_pylist()[0], group.num_rows
        cells = group.column("cells").combine_chunks().flatten().to_numpy().reshape(n, -1).T
        order = np.argsort(cells[0], kind="stable")  # rows that met in the first table lie together
        cells = np.ascontiguousarray(cells[:, order])
        column = lambda name: group.column(name).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)[order]
        nodes, members, block = column("node"), column("members"), column("block")
        units = _units(group.column("vector").to_pylist(), kind)[order]
        ranks, begins, lengths = windows(np.ascontiguousarray((units @ directions(first["dim"])).T))
        links, label = np.zeros(n, np.int64), np.arange(n)
        for i in range(0, n, 128):
            rows = np.arange(i, min(n, i + 128))
            fresh = rows[:, None] < np.arange(n)
            if first["lo"] != first["hi"]:
                fresh &= block[rows, None] != block
            if first["tab"]:
                fresh &= cells[0, rows, None] != cells[0]
            others = np.flatnonzero(fresh.any(axis=0))
            if not len(others):
                continue
            found = fresh[:, others] & (window_collisions(ranks[:, others], begins[:, rows], lengths[:, rows]) >= LEAST)
            if not found.any():
                continue
            found &= units[rows] @ units[others].T >= COSINE
            for t in range(1, first["tab"]):  # met in an earlier table already
                if not found.any():
                    break
                found &= cells[t, rows, None] != cells[t, others]
            links[rows] += found @ members[others]
            links[others] += members[rows] @ found
            for k in np.flatnonzero(found.any(axis=1)):
                joined = np.unique(np.append(label[others[found[k]]], label[i + k]))
                if len(joined) > 1:
                    label[np.isin(label, joined)] = joined[0]
        has = np.flatnonzero(links)
        return pa.table({"node": pa.array(nodes[has]), "links": pa.array(links[has]), "root": pa.array(nodes[label[has]])})
    return run


def similar_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links and component_id of every vector."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"),
                          vectors["embedding"].cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("node", F.when(usable, F.xxhash64("label", "embedding")))
    nodes = (rows.where("node is not null").groupBy("node", "label", "embedding")
             .agg(F.count("*").alias("members"), F.min("vec_id").alias("vec_id")).withColumn("dim", F.size("embedding")))
    nodes = cut_lineage(nodes, "cc-node")
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"  # floats travel as they are
    sizes = nodes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    data = cut_lineage(nodes.join(sizes, ["label", "dim"]).select("node", "label", "members", "dim", "n", "embedding")
                       .mapInArrow(_celled(kind), "node long, label string, members long, dim int, vector binary, cells array<int>"), "cc-data")

    cell = ["label", "dim", "tab", "cell"]
    visits = data.select("node", "label", "dim", F.posexplode("cells").alias("tab", "cell"))
    crowds = visits.groupBy(*cell).agg(F.count("*").alias("n")).where("n > 1")
    n_blocks = F.ceil(F.col("n") / BLOCK)
    placed = (visits.join(crowds, cell).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), n_blocks))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
              .select("node", *cell, "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    payload = data.select("node", "members", "vector", "cells")
    keys = [*cell, "lo", "hi"]
    with arrow_rows_at_once(spark, WIDE_ROWS):
        met = cut_lineage(placed.join(payload, "node").repartition(*keys).sortWithinPartitions(*keys)
                          .mapInArrow(grouped(_met(kind), *keys), "node long, links long, root long"), "cc-met")
    release(spark)
    roots = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")), "cc")
    links = met.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "members", "vec_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = (named.join(least, "root").join(links, "node", "left")
             .select("node", "component_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    return (rows.select("vec_id", "node").join(named, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")))


def op3_collision_count(spark, sf_dir: str) -> DataFrame:
    found = similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
