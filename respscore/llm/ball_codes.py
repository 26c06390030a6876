"""Vector codes by product quantisation with ball k-means.

Vectors become integers (floor(1024 * x)) and are cut into PARTS parts; each part position has a codebook of up to ENTRIES
entries, refined for ROUNDS rounds and used once more for the codes.  All arithmetic is exact, so the result is
that of plain Lloyd rounds with ties to the lower index, but most distances are never computed:

* every entry is the centre of a ball, whose radius bounds its members' distances: the farthest member of the last
  round, plus the way the entry has moved since;
* an entry's neighbours are the entries within twice the radius; no other can be nearest to a member;
* a ball whose entry and neighbours have not moved keeps its members without a look;
* a member nearer to its entry than half the way to the closest neighbour is in the stable core and stays;
* around the core, neighbours in order of distance bound rings: a member at distance d is compared with the
  neighbours within 2 d alone.

A round is one pass: a task assigns its rows block by block and, at its end, emits for each entry the count, the
sums and the farthest member.  Rows and sums are one written table, so both come from the same run of a task.  Only
the sums of PARTS * ENTRIES entries reach the driver, and only the codebooks are broadcast; both are of fixed size.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped; so are vectors
shorter or longer than most (of equally frequent lengths the longer counts).  Lengths that PARTS does not divide are filled up
with zeros.  Integers beyond +-2^27 (less for parts of over 16 components, see ``limit``) count as that, so that distances
fit 64 bits.  Repeated rows are rows of their
own; seeds with equal ``vec_id`` are ordered by their vectors, a null ``vec_id`` comes last; rows with a null label are
together in ``label_error``; an empty table gives an empty result; only ``vec_id``, ``embedding`` and ``label`` are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respscore.session import cut_lineage, discard

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Rows that are assigned together.
BLOCK = 16_384
#: Integers up to this one give products and sums that doubles hold exactly (parts of up to 256 components).
EXACT = 1 << 22


def limit(width: int) -> int:
    """The largest integer with which four times a distance of parts of this width fits 64 bits."""
    return 1 << 27 - (max(0, (width - 1).bit_length() - 4) + 1) // 2


def integers(values: np.ndarray, length: int) -> np.ndarray:
    """Integer parts of vectors: (rows, PARTS, width)."""
    width = -(-length // PARTS)
    found = np.zeros((len(values), PARTS * width), np.int64)
    found[:, :length] = np.clip(np.floor(values.astype(np.float64) * SCALE), -limit(width), limit(width))
    return found.reshape(len(values), PARTS, width)


class Balls:
    """The entries of one part position, their neighbours in order of distance, and which balls need no look."""

    def __init__(self, entries: np.ndarray, radius: np.ndarray | None = None, moved: np.ndarray | None = None):
        self.entries = entries
        self.norms = (entries * entries).sum(1)
        self.small = not len(entries) or int(np.abs(entries).max()) <= EXACT
        n = len(entries)
        self.between = np.stack([((entries - e) ** 2).sum(1) for e in entries]) if n else np.zeros((0, 0), np.int64)
        reach = np.full(n, np.inf) if radius is None else 4 * radius * radius
        self.neighbours, self.ways = [], []
        self.still = np.zeros(n, bool)
        for i, row in enumerate(self.between):
            near = np.flatnonzero(row <= reach[i])
            near = near[near != i]
            near = near[np.argsort(row[near], kind="stable")]
            self.neighbours.append(near)
            self.ways.append(row[near])
            if moved is not None:
                self.still[i] = not moved[i] and not moved[near].any()
        self.core = np.array([w[0] if len(w) else np.iinfo(np.int64).max for w in self.ways], np.int64)

    def distances(self, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Exact squared distance of each row to its entry."""
        return ((rows - self.entries[codes]) ** 2).sum(1)

    def nearest(self, rows: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The nearest of the entries ``among`` (ascending, so that ties go to the lower index)."""
        found = self.entries[among]
        if self.small and int(np.abs(rows).max(initial=0)) <= EXACT:
            far = self.norms[among].astype(np.float64) - 2 * (rows.astype(np.float64) @ found.T.astype(np.float64))
        else:
            far = np.stack([((rows - e) ** 2).sum(1) for e in found], 1)
        return among[far.argmin(1)]

    def assign(self, rows: np.ndarray, codes: np.ndarray | None) -> np.ndarray:
        """The nearest entry of each row; ``codes`` are the entries whose balls the rows are in."""
        if codes is None:
            return self.nearest(rows, np.arange(len(self.entries)))
        out = codes.copy()
        open_rows = np.flatnonzero(~self.still[codes])
        way = 4 * self.distances(rows[open_rows], codes[open_rows])
        ring = way >= self.core[codes[open_rows]]
        open_rows, way = open_rows[ring], way[ring]
        order = np.lexsort((way, codes[open_rows]))  # by ball and, inside it, from the core outwards
        open_rows, way = open_rows[order], way[order]
        balls = codes[open_rows]
        starts = np.flatnonzero(np.diff(balls, prepend=-1))
        for begin, end in zip(starts, [*starts[1:], len(balls)]):
            ball = int(balls[begin])
            upto = np.searchsorted(self.ways[ball], way[begin:end], side="right")
            while begin < end:  # rings are taken together while their candidates no more than double
                last = begin + int(np.searchsorted(upto, 2 * upto[0], side="right"))
                n = int(upto[last - begin - 1])
                among = np.sort(np.append(self.neighbours[ball][:n], ball))
                out[open_rows[begin:last]] = self.nearest(rows[open_rows[begin:last]], among)
                upto, begin = upto[last - begin:], last
        return out


ROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("parts", pa.binary()), ("codes", pa.binary()), ("error", pa.int64()),
                 ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("far", pa.int64()), ("sums", pa.list_(pa.int64()))])
ROW_SQL = ("vec_id long, label string, parts binary, codes binary, error long, part int, entry int, n long, far long, sums array<long>")


def _table(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in ROW], schema=ROW)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _as_integers(length: int):
    def run(batches):
        for batch in batches:
            vectors = _column(batch, "embedding")
            parts = integers(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), length), length)
            yield _table(vec_id=_column(batch, "vec_id"), label=_column(batch, "label"),
                         parts=pa.array([p.astype("<i4").tobytes() for p in parts], pa.binary()))
    return run


def _round(shared, width: int, last: bool):
    """Assign all rows; at the end the sums of each entry, or in the ``last`` round no sums but errors."""
    def run(batches):
        balls = shared.value
        n_entries = len(balls[0].entries)
        counts = np.zeros((PARTS, n_entries), np.int64)
        sums, far = np.zeros((PARTS, n_entries, width), np.int64), np.zeros((PARTS, n_entries), np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                block = batch.slice(begin, BLOCK)
                data, before = _column(block, "parts"), _column(block, "codes")
                parts = np.frombuffer(b"".join(data.to_pylist()), "<i4").reshape(-1, PARTS, width).astype(np.int64)
                old = None if before.null_count else np.frombuffer(b"".join(before.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)
                codes, error = np.empty((len(parts), PARTS), np.uint8), np.zeros(len(parts), np.int64)
                for p, ball in enumerate(balls):
                    rows = parts[:, p]
                    found = ball.assign(rows, None if old is None else old[:, p])
                    distance = ball.distances(rows, found)
                    codes[:, p] = found
                    if last:
                        error += distance
                        continue
                    counts[p] += np.bincount(found, minlength=n_entries)
                    np.maximum.at(far[p], found, distance)
                    for i in range(width):
                        sums[p, :, i] += np.bincount(found, rows[:, i].astype(np.float64), n_entries).astype(np.int64)
                known = {"vec_id": _column(block, "vec_id"), "label": _column(block, "label"),
                         "codes": pa.array([c.tobytes() for c in codes], pa.binary())}
                yield _table(**known, error=pa.array(error)) if last else _table(**known, parts=data)
        part, entry = np.nonzero(counts)
        if len(part):
            yield _table(part=pa.array(part, pa.int32()), entry=pa.array(entry, pa.int32()), n=pa.array(counts[part, entry]),
                         far=pa.array(far[part, entry]), sums=pa.array(list(sums[part, entry]), pa.list_(pa.int64())))
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and embedding of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("string").alias("label"),
                          vectors["embedding"].cast("array<double>").alias("embedding"))
    return rows.where(F.coalesce(~bad & (F.size("embedding") > 0), F.lit(False)))


def ball_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of the rows that take part, and the final codebooks."""
    spark, rows = vectors.sparkSession, usable(vectors)
    most = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    length = most["length"] if most else PARTS
    width = -(-length // PARTS)
    rows = rows.where(F.size("embedding") == length)
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    books = integers(np.array([r["embedding"] for r in seeds]).reshape(-1, length), length)
    balls = [Balls(books[:, p]) for p in range(PARTS)]
    table = cut_lineage(rows.mapInArrow(_as_integers(length), ROW_SQL), "ball-parts")
    for turn in range(rounds + 1):
        last, before = turn == rounds, table
        rows = before.where("parts is not null").select("vec_id", "label", "parts", "codes")
        shared = spark.sparkContext.broadcast(balls)
        table = cut_lineage(rows.mapInArrow(_round(shared, width, last), ROW_SQL), "ball-codes" if last else f"ball-round{turn}")
        discard(before)
        shared.unpersist()
        if not last:
            found = (table.where("part is not null").groupBy("part", "entry")
                     .agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))
                     .collect())  # at most PARTS * ENTRIES rows
            balls = _moved(balls, found)
    code = F.lower(F.hex("codes"))
    return table.select("vec_id", "label", code.alias("code"), "error"), [b.entries for b in balls]


def _moved(balls: list[Balls], found) -> list[Balls]:
    """Entries at the floors of their members' means, with radii that hold for the members."""
    out = []
    for p, ball in enumerate(balls):
        entries, far = ball.entries.copy(), np.zeros(len(ball.entries), np.float64)
        for r in found:
            if r["part"] == p:
                entries[r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
                far[r["entry"]] = r["far"]
        way = np.sqrt(((entries - ball.entries) ** 2).sum(1).astype(np.float64))
        out.append(Balls(entries, (np.sqrt(far) + way) * (1 + 1e-9) + 1e-6, way > 0))
    return out


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in order of part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def op11_ball_codes(spark, sf_dir: str) -> DataFrame:
    found, books = ball_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    # written, so that Spark knows its size and joins it without a shuffle of the rows where it is small
    totals = cut_lineage(found.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error")), "ball-labels")
    return (found.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
            .select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def _sql() -> str:
    """Plain rounds over all entries; doubles hold the integers exactly."""
    parts = ["k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings "
             "WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
             f"p AS MATERIALIZED (SELECT vec_id, j, v[j * len(v) // {PARTS} + 1:(j + 1) * len(v) // {PARTS}] AS x FROM k, range({PARTS}) AS t(j))",
             f"b0 AS MATERIALIZED (SELECT * FROM (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, x AS c FROM p) WHERE e < {ENTRIES})"]
    for t in range(ROUNDS + 1):
        parts.append(f"d{t} AS MATERIALIZED (SELECT vec_id, j, x, min({{'d': list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c), "
                     f"'e': e}}) AS m FROM p JOIN b{t} USING (j) GROUP BY vec_id, j, x)")
        if t < ROUNDS:
            parts.append(f"s{t} AS (SELECT j, m.e AS e, i, floor(sum(x[i]) / count(*)) AS c FROM (SELECT j, m, x, unnest(range(1, len(x) + 1)) AS i FROM d{t}) "
                         "GROUP BY j, m.e, i)")
            parts.append(f"n{t} AS (SELECT j, e, list(c ORDER BY i) AS c FROM s{t} GROUP BY j, e)")
            parts.append(f"b{t + 1} AS MATERIALIZED (SELECT b.j, b.e, coalesce(n.c, b.c) AS c FROM b{t} b LEFT JOIN n{t} n USING (j, e))")
    parts.append(f"h AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY j, e, i)) AS sha FROM "
                 f"(SELECT j, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{ROUNDS}))")
    parts.append(f"r AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(m.e AS INTEGER))), '' ORDER BY j) AS code, CAST(sum(m.d) AS BIGINT) AS error "
                 f"FROM d{ROUNDS} GROUP BY vec_id)")
    return ("WITH " + ",\n".join(parts) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
            "sha AS codebooks_sha256 FROM r JOIN k USING (vec_id), h")


OP11_SQL = _sql()
