"""Packing documents into token windows with a bounded number of open windows.

Each partition packs its documents online.  A document's ids are cut into full windows, which
leave at once, and a rest, which goes to the open window where it fits best (smallest gap that holds it).  When none
holds it and the fixed number of windows is open, the fullest one is emitted.  Windows still open at the
end of a partition are the leftovers: of neighbouring partitions they are merged, whole windows first
(best fit, longest first), and what is still far from full is strung together and cut anew.

Padding: a sequence is padded to the window unless its length is a power of two.

Defined results: a null text is empty and holds the end id alone; a text of any length is cut, each id in
exactly one piece; repeated rows and rows with a null ``doc_id`` are packed like any other; an empty table
gives no piece; only ``doc_id`` and ``text`` are read.  A task holds one small batch and the open windows; a
merge holds the open windows of ``MERGED`` partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respscore.llm.common import arrow_rows, id_text, small_batches
from respscore.llm.tokens import tokenizer_path, worker_encoder
from respscore.session import cut_lineage

WINDOW = 1024
OPEN_WINDOWS = 256
MERGED = 16
#: Pieces that a Python worker remembers; they stay in its memory beside later stages.
CACHED_PIECES = 400_000
#: Leftover windows with a gap above this are strung together and cut anew.
SLACK = 16

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
#: Of a leftover piece the ids are kept too, until it has its place.
OPEN = ARROW.append(pa.field("part", pa.int32())).append(pa.field("ids", pa.binary()))
OPEN_SQL = f"{PIECE}, part int, ids binary"


class Packer:
    """Best-fit packing of pieces (doc_id, start, ids, doc_tokens); finished windows are lists of pieces."""

    def __init__(self, window: int, n_open: int):
        self.window, self.n_open = window, n_open
        self.gaps: list[tuple[int, int]] = []  # (gap, slot) in ascending order
        self.slots: dict[int, list] = {}
        self.next = 0

    def place(self, piece) -> list | None:
        """Put a piece of at most a window's length; returns a window that has left, if any."""
        n = len(piece[2]) // 4
        at = bisect_left(self.gaps, (n, -1))
        out = None
        if at < len(self.gaps):
            gap, slot = self.gaps.pop(at)
        else:
            if len(self.gaps) == self.n_open:
                out = self.slots.pop(self.gaps.pop(0)[1])  # the fullest
            gap, slot = self.window, self.next
            self.next += 1
            self.slots[slot] = []
        self.slots[slot].append(piece)
        if gap > n:
            insort(self.gaps, (gap - n, slot))
            return out
        return self.slots.pop(slot)  # filled to the brim: a new window can't be, so ``out`` is None or it is this one's

    def rest(self) -> list[list]:
        found = [self.slots[s] for _, s in self.gaps]
        self.gaps, self.slots = [], {}
        return found


def cut(doc_id, ids: bytes, window: int):
    """Full windows of one document, then its rest (None if nothing is left)."""
    n = len(ids) // 4
    full = n - n % window
    return ([(doc_id, s, ids[4 * s:4 * (s + window)], n) for s in range(0, full, window)],
            (doc_id, full, ids[4 * full:], n) if full < n else None)


def numbered(window: list, sequence: int):
    """Output rows of one window."""
    offset = 0
    for doc_id, start, ids, n in window:
        yield {"doc_id": doc_id, "start": start, "length": len(ids) // 4, "ids_crc32": zlib.crc32(ids), "doc_tokens": n,
               "sequence_id": sequence, "offset": offset}
        offset += len(ids) // 4


def merge(windows: list[list], window: int) -> list[list]:
    """Leftover windows, merged: best fit of whole windows, then the rest strung together and cut."""
    width = lambda w: sum(len(p[2]) // 4 for p in w)
    gaps: list[tuple[int, int]] = []
    bins: list[list] = []
    for w in sorted(windows, key=width, reverse=True):
        n = width(w)
        at = bisect_left(gaps, (n, -1))
        if at < len(gaps):
            gap, b = gaps.pop(at)
        else:
            gap, b = window, len(bins)
            bins.append([])
        bins[b].extend(w)
        insort(gaps, (gap - n, b))
    done = [bins[b] for gap, b in gaps if gap <= SLACK]
    last, room = [], window
    for doc_id, start, ids, n in (p for gap, b in gaps if gap > SLACK for p in bins[b]):
        while ids:
            part, ids = ids[:4 * room], ids[4 * room:]
            last.append((doc_id, start, part, n))
            start += len(part) // 4
            room -= len(part) // 4
            if not room:
                done.append(last)
                last, room = [], window
    return done + [last] * bool(last)


def pack(docs: DataFrame, path: str, window: int = WINDOW, n_open: int = OPEN_WINDOWS, end: int = 0) -> DataFrame:
    """One row for each piece of each document."""

    def partition(batches):
        encoder, part = worker_encoder(path, False, CACHED_PIECES), TaskContext.get().partitionId()
        packer, tail, count = Packer(window, n_open), end.to_bytes(4, "little"), 0
        for batch in small_batches(batches):
            rows, out = list(arrow_rows(batch, "doc_id", "text")), []
            for (doc_id, _), found in zip(rows, encoder.encode([t for _, t in rows])):
                full, rest = cut(doc_id, found + tail, window)
                left = packer.place(rest) if rest else None
                for w in [[p] for p in full] + [left] * bool(left):
                    out.extend(numbered(w, (part << 32) + count))
                    count += 1
            yield pa.RecordBatch.from_pylist([r | {"part": part, "ids": None} for r in out], schema=OPEN)
        for slot, w in enumerate(packer.rest()):
            rows = [r | {"part": part, "ids": p[2]} for r, p in zip(numbered(w, slot), w)]
            yield pa.RecordBatch.from_pylist(rows, schema=OPEN)

    def merged(group: pa.Table) -> pa.Table:
        windows: dict[tuple, list] = {}
        rows = sorted(group.to_pylist(), key=lambda r: (r["part"], r["sequence_id"], r["offset"]))
        for r in rows:
            windows.setdefault((r["part"], r["sequence_id"]), []).append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        first = (1 << 61) + (rows[0]["part"] // MERGED << 32)
        return pa.Table.from_pylist([r for i, w in enumerate(merge(list(windows.values()), window)) for r in numbered(w, first + i)],
                                    schema=ARROW)

    # written, so that the windows that have left and the leftovers come from the same run of each task
    rows = cut_lineage(id_text(docs).mapInArrow(partition, OPEN_SQL), "packing")
    columns = ARROW.names
    leftovers = rows.where("ids is not null").withColumn("grp", F.floor(F.col("part") / MERGED))
    late = leftovers.groupBy("grp").applyInArrow(merged, PIECE)
    return rows.where("ids is null").select(*columns).union(late.select(*columns))


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row: sequences, tokens, and padded places (none for a length that is a power of two)."""
    each = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return each.agg(F.count("*").alias("n_sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"),
                    F.coalesce(F.sum(F.when(power, F.lit(0)).otherwise(window - F.col("n"))), F.lit(0)).alias("n_padding"))


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
