"""Removal of repeated byte strings: suffixes sorted bucket by bucket with a difference-cover sample.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts elsewhere, in another document or in
the same one.  Only the order of suffixes up to depth LENGTH matters, and of it only which suffixes are equal, so
suffixes are ordered by fingerprints of their prefixes: equal prefixes become neighbours as in lexical order.

1. Cover sample.  Positions whose remainder modulo PERIOD is in COVER are sampled.  The differences of COVER give
   every remainder, so for any two places with equal strings of LENGTH bytes there is a shift below PERIOD that brings both to
   sampled positions, where they still agree for SAMPLE = LENGTH - PERIOD + 1 bytes.  The sampled suffixes are ranked to that
   depth, one bucket of fingerprints at a time; what matters of a rank is whether it is shared.
2. Suffixes.  A suffix can only be repeated to the full depth if a sampled position with a shared rank
   lies in its first PERIOD bytes.  All others are settled by the sample; these long ties are sorted to
   the full depth, again one bucket at a time.
3. Each document's repeated starts become removed spans.

Equal documents are one text from the start.  Inside a block of texts equal fingerprints are found before anything is
shuffled, and one of them goes on, so the rows of a fingerprint are at most the number of blocks, however common
its string is.  Memory is bounded by a block of texts and by a bucket, whose size the number of buckets holds steady.

Defined results: a null text is empty; texts below LENGTH bytes keep all, but count in ``n_bytes``; texts of any length are
read whole, in segments; copies of a text of at least LENGTH bytes lose everything; repeated rows are copies; an empty
table gives an empty result; only ``doc_id`` and ``text`` are read.  What goes is decided on two independent fingerprints,
one modulo 2 ** 64 and one modulo a prime: all 64 bits of the first and 16 bits of the second are compared whatever the
number of buckets, and the bucket, which depends on both, adds up to 15 bits of the second.  Chance collisions are of the
order of (tied suffixes ** 2) / 2 ** 81 or fewer; the bytes themselves are not compared.  In the sample, where a
collision only adds work, 48 bits are compared at least.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from respscore.llm.common import arrow_rows, arrow_rows_at_once, free_names, grouped, own_columns, release, shuffle_width, small_batches
from respscore.session import cut_lineage, discard

LENGTH = 200
PERIOD = 133
#: A perfect difference set of order 11.
COVER = (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109)
SAMPLE = LENGTH - PERIOD + 1
#: Bytes that travel of the fingerprints of a sampled position, and of a tied suffix (8 of the first, 2 of the second).
SAMPLE_WIDTH, WIDTH = 6, 10
assert len({(a - b) % PERIOD for a in COVER for b in COVER}) == PERIOD

#: Bytes of text in a block, in a segment that is fingerprinted at once, and for each bucket.
BLOCK_BYTES = 1 << 20
SEGMENT = 1 << 18
BUCKET_BYTES = 8 << 20

_rng = np.random.default_rng(6)
_LETTER = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(SEGMENT + LENGTH, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))

#: The second fingerprint is a residue modulo this prime, with letters and a base of its own.
_PRIME = (1 << 31) - 1
_LETTER2 = _rng.integers(1, _PRIME, 256, dtype=np.uint64)
_BASE2 = 0x2545F491


def _residues(base: int) -> np.ndarray:
    out, n = np.ones(SEGMENT + LENGTH, np.uint64), 1
    while n < len(out):
        more = out[n:2 * n]
        more[:] = out[:len(more)] * np.uint64(pow(base, n, _PRIME)) % np.uint64(_PRIME)
        n *= 2
    return out


_POWER2, _INVERSE2 = _residues(_BASE2), _residues(pow(_BASE2, -1, _PRIME))
_COVERED = np.isin(np.arange(PERIOD), COVER)


def fingerprints(text: bytes, depth: int, chosen: np.ndarray) -> np.ndarray:
    """Fingerprints of the strings of ``depth`` bytes at the chosen (ascending) positions."""
    out = [np.empty(0, np.uint64)]
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - depth + 1, SEGMENT):
        a, b = np.searchsorted(chosen, [start, start + SEGMENT])
        if a == b:
            continue
        part = data[start:start + SEGMENT + depth - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTER[part] * _POWER[:len(part)], out=total[1:])
        at = chosen[a:b] - start
        x = (total[at + depth] - total[at]) * _INVERSE[at]
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(x ^ (x >> np.uint64(32)))
    return np.concatenate(out)


def second_fingerprints(text: bytes, depth: int, chosen: np.ndarray) -> np.ndarray:
    """Fingerprints of 31 bits, independent of the first, of the same strings."""
    out, prime = [np.empty(0, np.uint32)], np.uint64(_PRIME)
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - depth + 1, SEGMENT):
        a, b = np.searchsorted(chosen, [start, start + SEGMENT])
        if a == b:
            continue
        part = data[start:start + SEGMENT + depth - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_LETTER2[part] * _POWER2[:len(part)] % prime, out=total[1:])
        at = chosen[a:b] - start
        out.append(((total[at + depth] - total[at]) % prime * _INVERSE2[at] % prime).astype(np.uint32))
    return np.concatenate(out)


def in_order(marks: np.ndarray, checks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A stable order in which equal fingerprints are neighbours, and which of them equal the one before."""
    order = np.argsort(marks, kind="stable")
    ordered = marks[order]
    same = ordered[1:] == ordered[:-1]
    if checks is not None and (checks[order][1:] != checks[order][:-1])[same].any():
        order = np.lexsort((checks, marks))
        same &= checks[order][1:] == checks[order][:-1]
    return order, same


def sampled(n: int) -> np.ndarray:
    """Cover positions of a text of ``n`` bytes at which SAMPLE bytes follow."""
    return np.flatnonzero(np.resize(_COVERED, max(0, n - SAMPLE + 1)))


def tied(n: int, shared: np.ndarray) -> np.ndarray:
    """Starts with a shared sampled position in their first PERIOD bytes."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, np.maximum(shared - PERIOD + 1, 0), 1)
    np.add.at(mark, shared + 1, -1)
    return np.flatnonzero(np.cumsum(mark)[:max(0, n - LENGTH + 1)])


def spans(n: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [begin, end) covered by the strings that start at ``starts`` (ascending)."""
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.flatnonzero(np.diff(starts) > LENGTH) + 1
    return starts[np.concatenate(([0], new))], starts[np.concatenate((new - 1, [len(starts) - 1]))] + LENGTH


def kept_bytes(text: bytes, begin: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *np.stack((begin, end), 1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))


def packed(places: np.ndarray) -> bytes:
    """Ascending places as steps, byte by byte of equal weight: the upper ones are mostly zero, and compress."""
    step = np.diff(places, prepend=0)
    size = 2 if not len(step) or step.max() < 1 << 16 else 8
    return bytes([size]) + step.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    size = data[0]
    step = np.frombuffer(data, np.uint8, offset=1).reshape(size, -1).T.copy().view(f"<u{size}")
    return np.cumsum(step.ravel().astype(np.int64))


def as_runs(places: np.ndarray) -> bytes:
    """Ascending distinct places as pairs of first place and length of each run of neighbours."""
    first = np.flatnonzero(np.diff(places, prepend=places[0] - 2) > 1)
    return np.stack((places[first], np.diff(np.append(first, len(places)))), 1).astype("<i8").tobytes()


def from_runs(data: bytes) -> np.ndarray:
    first, size = np.frombuffer(data, "<i8").reshape(-1, 2).T
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def _distinct(batches):
    """Each text once, with its block and its place in it; ``starts`` stay beside it."""
    part, seen = TaskContext.get().partitionId() << 32, set()
    block = place = 0
    for batch in small_batches(batches):
        rows = []
        for digest, text, starts in arrow_rows(batch, "digest", "text", "starts"):
            if digest in seen:
                continue
            seen.add(digest)
            if place and place + len(text) > BLOCK_BYTES:
                block, place = block + 1, 0
            rows.append((digest, part + block, place, text, starts))
            place += len(text)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         names=["digest", "block", "place", "text", "starts"])


def _first_in_task(batches):
    seen = set()
    for batch in small_batches(batches):
        fresh = []
        for i, digest in enumerate(batch.column(0).to_pylist()):
            if digest not in seen:
                seen.add(digest)
                fresh.append(i)
        yield batch.take(pa.array(fresh, pa.int64()))


#: Fingerprints on the way to their bucket, or (without any) places that are known to be repeated.
RECORDS = "bucket long, block long, marks binary, places binary"
_RECORDS = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("marks", pa.binary()), ("places", pa.binary())])


def records(n_buckets: int, width: int, depth: int, choose):
    """Function for mapInArrow: fingerprints of the chosen positions of each text, by bucket.

    ``choose`` gives the positions from the text and the column ``starts``; ``width`` bytes of the fingerprints travel, those
    beyond 8 are of the second one, which is then part of the bucket too.
    """
    def block_rows(block, marks, checks, places):
        marks, places = np.concatenate(marks), np.concatenate(places)
        checks = np.concatenate(checks) if checks else None
        order, same = in_order(marks, checks)
        first = np.append(True, ~same)
        size = np.diff(np.append(np.flatnonzero(first), len(order)))
        repeated = np.repeat(size > 1, size)
        if repeated.any():
            yield block % n_buckets, block, b"", packed(np.sort(places[order[repeated]]))
        one = np.sort(order[first])
        marks, places = marks[one], places[one]
        if checks is None:
            bucket = marks >> np.uint64(44)
        else:
            checks = checks[one]
            bucket = (marks + checks.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(20)
        bucket = (bucket % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, ends):
            if len(part):
                data = marks[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
                if checks is not None:
                    data = np.hstack((data, checks[part].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width - 8]))
                yield int(bucket[part[0]]), block, data.tobytes(), packed(places[part])

    def run(batches):
        now, marks, checks, places = None, [], [], []
        out = lambda rows: pa.RecordBatch.from_pylist([dict(zip(_RECORDS.names, r)) for r in rows], schema=_RECORDS)
        for batch in small_batches(batches):
            for block, place, text, starts in arrow_rows(batch, "block", "place", "text", "starts"):
                if block != now and marks:
                    yield out(block_rows(now, marks, checks, places))
                    marks, checks, places = [], [], []
                now = block
                chosen = choose(len(text), None if starts is None else from_runs(starts))
                if len(chosen):
                    marks.append(fingerprints(text, depth, chosen))
                    if width > 8:
                        checks.append(second_fingerprints(text, depth, chosen))
                    places.append(chosen + place)
        if marks:
            yield out(block_rows(now, marks, checks, places))

    return run


def _bucket(width: int):
    """Function of one bucket's rows: sort them, and return the places of fingerprints that several blocks have."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["block", "marks", "places"]).to_pylist()
        known = [(r["block"], r["places"]) for r in rows if not r["marks"]]
        rows = [r for r in rows if r["marks"]]
        data = np.frombuffer(b"".join(r["marks"] for r in rows), np.uint8).reshape(-1, width)
        padded = lambda part, size: np.pad(part, ((0, 0), (0, size - part.shape[1]))).view(f"<u{size}")[:, 0]
        marks, checks = padded(data[:, :8], 8), padded(data[:, 8:], 4) if width > 8 else None
        del data
        places = np.concatenate([np.empty(0, np.int64)] + [unpacked(r["places"]) for r in rows])
        order, same = in_order(marks, checks)
        shared = np.zeros(len(marks), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        ends = np.cumsum([0] + [len(r["marks"]) // width for r in rows])
        found = [(r["block"], places[a:b][shared[a:b]]) for r, a, b in zip(rows, ends[:-1], ends[1:])]
        found = known + [(block, packed(x)) for block, x in found if len(x)]
        return pa.table({"block": pa.array([x for x, _ in found], pa.int64()), "places": pa.array([x for _, x in found], pa.binary())})

    return run


def _by_text(block: pa.Table) -> pa.Table:
    """The repeated places of one block, by text; its rows are those places (no digest) and the directory of its texts."""
    places, texts = block.filter(pc.is_null(block.column("digest"))), block.filter(pc.is_valid(block.column("digest")))
    found = np.unique(np.concatenate([np.empty(0, np.int64)] + [unpacked(x) for x in places.column("places").to_pylist()]))
    rows = []
    for digest, place, n in zip(*(texts.column(c).to_pylist() for c in ("digest", "place", "n"))):
        a, b = np.searchsorted(found, [place, place + n])
        if a < b:
            rows.append((digest, as_runs(found[a:b] - place)))
    return pa.table({"digest": pa.array([d for d, _ in rows], pa.binary()), "starts": pa.array([s for _, s in rows], pa.binary())})


def repeated_starts(texts: DataFrame, n_buckets: int, width: int, depth: int, choose) -> DataFrame:
    """(digest, starts) of the chosen positions whose strings of ``depth`` bytes occur more than once."""
    places = cut_lineage(texts.mapInArrow(records(n_buckets, width, depth, choose), RECORDS)
                         .repartition(n_buckets, "bucket").sortWithinPartitions("bucket")
                         .mapInArrow(grouped(_bucket(width), "bucket"), "block long, places binary"), "cover-places")
    release(texts.sparkSession)
    directory = texts.select("digest", "block", "place", F.octet_length("text").cast("long").alias("n"))
    both = places.select("block", "places").unionByName(directory, allowMissingColumns=True)
    return cut_lineage(both.repartition(shuffle_width(texts.sparkSession), "block").sortWithinPartitions("block")
                       .mapInArrow(grouped(_by_text, "block"), "digest binary, starts binary"), "cover-starts")


def _removed(batches):
    for batch in small_batches(batches):
        rows = []
        for digest, text, starts in arrow_rows(batch, "digest", "text", "starts"):
            begin, end = spans(len(text), from_runs(starts))
            rows.append((digest, int((end - begin).sum()), len(begin), hashlib.sha256(kept_bytes(text, begin, end)).hexdigest(),
                         np.stack((begin, end), 1).astype("<i8").tobytes()))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         names=["digest", "n_removed", "n_spans", "kept_sha256", "spans"])


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("digest"),
                       F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def removals(docs: DataFrame) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256, spans) of the texts that lose something, copies left aside."""
    spark = docs.sparkSession
    long = keyed(docs).where(F.col("n_bytes") >= LENGTH)
    schema = "digest binary, block long, place long, text binary, starts binary"
    texts = (long.select("digest", "text").mapInArrow(_first_in_task, "digest binary, text binary")
             .repartition(shuffle_width(spark), "digest").withColumn("starts", F.lit(None).cast("binary")).mapInArrow(_distinct, schema))
    texts = cut_lineage(texts, "cover-texts")
    release(spark)
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    n_buckets = max(shuffle_width(spark), -(-total // BUCKET_BYTES))
    with arrow_rows_at_once(spark, 2000):
        sample = repeated_starts(texts, n_buckets, SAMPLE_WIDTH, SAMPLE, lambda n, _: sampled(n))
        # the texts that are left get new blocks, so that the rows of a block stand together
        open_texts = cut_lineage(texts.drop("starts").join(sample, "digest").select("digest", "text", "starts").mapInArrow(_distinct, schema),
                                 "cover-open")
        discard(texts, sample)
        release(spark)
        starts = repeated_starts(open_texts, n_buckets, WIDTH, LENGTH, tied)
        found = open_texts.select("digest", "text").join(starts, "digest").mapInArrow(
            _removed, "digest binary, n_removed long, n_spans long, kept_sha256 string, spans binary")
        return cut_lineage(found, "cover-removed")


def copies(docs: DataFrame) -> DataFrame:
    """Digests of texts of at least LENGTH bytes that several documents have."""
    return (keyed(docs).where(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.count("*").alias("n_copies")).where("n_copies > 1"))


def op6_cover_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = removals(docs).drop("spans")
    rows = keyed(docs).select("doc_id", "digest", "n_bytes", F.sha2("text", 256).alias("whole"))
    copied = F.col("n_copies").isNotNull()
    return rows.join(copies(docs), "digest", "left").join(found, "digest", "left").select(
        "doc_id", "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))


@F.pandas_udf(StringType())
def _without(text: pd.Series, cuts: pd.Series) -> pd.Series:
    """Texts without their removed spans; a character that a span cuts goes with it."""
    def one(data, spans):
        if data is None or spans is None:
            return (data or b"").decode("utf-8", "replace")
        begin, end = np.frombuffer(spans, "<i8").reshape(-1, 2).T
        return kept_bytes(data, begin, end).decode("utf-8", "ignore")

    return pd.Series([one(t, c) for t, c in zip(text, cuts)], dtype=object)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """All documents, with the text that is left (copies of long texts: none) and ``n_chars``, if there, counted anew."""
    mark, digest, spans, copy = free_names(docs, "mark", "digest", "spans", "copy")
    found = removals(docs).select(F.col("digest").alias(digest), F.col("spans").alias(spans))
    copied = copies(docs).select(F.col("digest").alias(copy))
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.withColumn(mark, F.unhex(F.md5(text)))
    rows = rows.join(found, F.col(mark) == F.col(digest), "left").join(copied, F.col(mark) == F.col(copy), "left")
    left = F.when(F.col(copy).isNotNull(), F.lit("")).otherwise(_without(F.col("text").cast("binary"), F.col(spans)))
    rows = rows.withColumn("text", F.when(F.col("text").isNotNull(), left))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*own_columns(docs))
