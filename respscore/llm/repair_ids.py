"""Token ids in files under Re-Pair grammar compression.

Documents are range-partitioned by ``doc_id``; each partition is a shard, written as blocks of about a quarter
million ids.  In a block, pairs of neighbouring ids that occur often are replaced by a new id (a
nonterminal), again and again until none occurs 8 times; the rules and the length of each nonterminal's expansion are
stored beside the shortened sequence, so a reader finds any document by the running sum of
lengths and expands only its part.

A file is a Parquet file of the Spark writer (committed as a whole, so a lost executor leaves nothing half
written) with one row for each block: shard, block, first (ids of the shard before it), n_ids, doc_ids (int64),
doc_null (bytes 0/1), doc_lengths (uint64), base (first nonterminal), rules (pairs of uint32), lengths (uint32 for
each rule), sequence (uint16 or uint32), all little-endian.

Defined results: a null text is empty and holds the end id alone; a document of any length lies
in one block; rows with a null ``doc_id`` come first; equal ``doc_id`` are ordered by text and repeated rows follow
each other; an empty table gives no block; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respscore.llm.common import arrow_rows, id_text, shuffle_width, small_batches
from respscore.llm.tokens import tokenizer_path, worker_encoder
from respscore.session import scratch_path

END_ID = 2
BLOCK_IDS = 1 << 18
SCHEMA = ("shard int, block int, first long, n_ids long, doc_ids binary, doc_null binary, doc_lengths binary, "
          "base long, rules binary, lengths binary, sequence binary")


def sorted_pairs(pairs: np.ndarray, pair_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and sorted values.  Pair and place are sorted as one number where they fit, which is faster."""
    bits = len(pairs).bit_length()
    if pair_bits + bits > 62:
        order = np.argsort(pairs, kind="stable")
        return order, pairs[order]
    packed = np.sort(pairs << bits | np.arange(len(pairs)))
    return packed & ((1 << bits) - 1), packed >> bits


def compress(ids: np.ndarray, base: int, end: int, at_least: int = 8):
    """Re-Pair: (sequence, rules, lengths).  Nonterminal ``base + k`` stands for the pair ``rules[k]``.

    Rounds go on until no pair stands ``at_least`` times without overlap.  A round counts the pairs; at each
    place the pair yields to a neighbour that is more frequent, of a run of equal pairs every other one counts, and
    pairs that keep ``at_least`` places are replaced there.  The most frequent pair keeps all its places, so every round
    replaces some.  Pairs that would cross a document's end are left alone.

    Symbols are linked to their neighbours, and ``live`` lists the places whose pair may still be replaced: after a round,
    those of frequent pairs that stayed and those beside a new symbol.  A pair that is not frequent never becomes so, as only pairs
    with a new symbol gain places; so later rounds look at few places.
    """
    symbol = np.append(ids.astype(np.int64), -1)  # the last place is the end of the linked symbols
    after, before = np.arange(1, len(symbol) + 1, dtype=np.int32), np.arange(-1, len(symbol) - 1, dtype=np.int32)
    stands, marked = np.ones(len(symbol), bool), np.zeros(len(symbol), bool)
    stands[-1] = False
    rules, lengths = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    shift = (base + len(ids)).bit_length()  # a pair is one number; there are fewer rules than ids, as each takes places away
    size, closed = np.ones(base, np.int64), np.zeros(base, bool)  # closed: symbols whose expansion ends a document
    closed[end] = True
    live = np.flatnonzero(ids[:-1] != end).astype(np.int32)
    while len(live) >= at_least:
        pairs = symbol[live] << shift | symbol[after[live]]
        beside = after[live[:-1]] == live[1:]  # neighbours among the live places
        again = np.flatnonzero(beside & (pairs[1:] == pairs[:-1])) + 1
        odd = np.empty(0, np.int64)
        if len(again):
            first = np.flatnonzero(np.diff(again, prepend=-1) > 1)
            offset = np.arange(len(again)) - np.repeat(first, np.diff(np.append(first, len(again))))
            odd = again[offset % 2 == 0]
            pairs[odd] = -1
        order, ordered = sorted_pairs(pairs, 2 * shift)
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero((counts >= at_least) & (ordered[starts] >= 0))
        if not len(often):
            break
        often = often[np.argsort(-counts[often], kind="stable")]
        values, none = ordered[starts[often]], len(often)
        rank_of = np.full(len(starts), none, np.int32)
        rank_of[often] = np.arange(none, dtype=np.int32)
        rank = np.empty(len(live), np.int32)  # of pairs that share a place the most frequent one is replaced in this round
        rank[order] = np.repeat(rank_of, counts)
        wins = rank < none
        wins[1:] &= ~beside | (rank[1:] < rank[:-1])
        wins[:-1] &= ~beside | (rank[:-1] < rank[1:])
        at = np.flatnonzero(wins)
        used = np.bincount(rank[at], minlength=none) >= at_least
        at = at[used[rank[at]]]
        chosen, used = rank[at], np.flatnonzero(used)
        number = np.zeros(none, np.int64)
        number[used] = len(size) + np.arange(len(used))

        new = np.stack((values[used] >> shift, values[used] & ((1 << shift) - 1)), 1)
        rules.append(new)
        lengths.append(size[new[:, 0]] + size[new[:, 1]])
        closed = np.concatenate((closed, closed[new[:, 1]]))
        size = np.concatenate((size, lengths[-1]))

        p = live[at]
        gone = after[p]
        symbol[p] = number[chosen]
        stands[gone] = False
        after[p] = after[gone]
        before[after[p]] = p
        marked[live[rank < none]] = True
        marked[live[odd]] = True
        marked[p] = True
        marked[before[p][before[p] >= 0]] = True
        marked &= stands
        live = np.flatnonzero(marked).astype(np.int32)
        marked[live] = False
        live = live[~closed[symbol[live]] & (symbol[after[live]] >= 0)]
    return symbol[stands], np.concatenate(rules), np.concatenate(lengths)


def expansions(base: int, rules: np.ndarray) -> np.ndarray:
    """All nonterminals' expansions one after the other; a rule only uses earlier ones."""
    done: list[bytes] = []
    for a, b in rules.tolist():
        done.append((a.to_bytes(4, "little") if a < base else done[a - base])
                    + (b.to_bytes(4, "little") if b < base else done[b - base]))
    return np.frombuffer(b"".join(done), "<u4")


class Block:
    """One block as read from a file."""

    def __init__(self, row: dict):
        self.base = row["base"]
        rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
        lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int32)
        self.sequence = np.frombuffer(row["sequence"], "<u2" if self.base + len(rules) <= 1 << 16 else "<u4").astype(np.int32)
        self.flat = expansions(self.base, rules)
        self.starts = np.cumsum(lengths, dtype=np.int32) - lengths
        long = self.sequence >= self.base
        self.size = np.ones(len(self.sequence), np.int32)
        self.size[long] = lengths[self.sequence[long] - self.base]
        self.end = np.cumsum(self.size, dtype=np.int64)

    def ids(self, start: int, length: int) -> np.ndarray:
        """``length`` ids from position ``start``, expanding only the symbols that cover them."""
        if length <= 0:
            return np.empty(0, np.uint32)
        i, j = np.searchsorted(self.end, [start, start + length - 1], side="right")
        part, size = self.sequence[i:j + 1], self.size[i:j + 1]
        out = np.repeat(part, size).view(np.uint32)
        long = np.flatnonzero(part >= self.base)
        size_long, before = size[long], (np.cumsum(size, dtype=np.int32) - size)[long]
        step = np.arange(size_long.sum(), dtype=np.int32) - np.repeat(np.cumsum(size_long, dtype=np.int32) - size_long, size_long)
        out[np.repeat(before, size_long) + step] = self.flat[np.repeat(self.starts[part[long] - self.base], size_long) + step]
        skip = start - (self.end[i] - self.size[i])
        return out[skip:skip + length]


def write_ids(docs: DataFrame, folder: str, path: str, end: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts, append ``end`` to each, and write the shards in ascending ``doc_id`` order."""

    def shard_rows(batches):
        encoder = worker_encoder(path, True)
        base, shard = encoder.library.get_vocab_size(), TaskContext.get().partitionId()
        state = {"block": 0, "first": 0}
        ids, parts, total = [], [], 0
        tail = np.array([end], "<u4").tobytes()

        def flush():
            data = np.frombuffer(b"".join(parts), "<u4")
            sequence, rules, lengths = compress(data, base, end)
            row = {"shard": shard, "block": state["block"], "first": state["first"], "n_ids": len(data),
                   "doc_ids": np.array([x or 0 for x in ids], "<i8").tobytes(),
                   "doc_null": bytes(x is None for x in ids),
                   "doc_lengths": np.array([len(p) // 4 for p in parts], "<u8").tobytes(), "base": base,
                   "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
                   "sequence": sequence.astype("<u2" if base + len(rules) <= 1 << 16 else "<u4").tobytes()}
            state["block"] += 1
            state["first"] += len(data)
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in small_batches(batches):
            rows = list(arrow_rows(batch, "doc_id", "text"))
            for (doc_id, _), found in zip(rows, encoder.encode([t for _, t in rows])):
                ids.append(doc_id)
                parts.append(found + tail)
                total += len(found) // 4 + 1
                if total >= block_ids:
                    yield flush()
                    ids, parts, total = [], [], 0
        if ids:
            yield flush()

    rows = (id_text(docs).repartitionByRange(shuffle_width(docs.sparkSession), "doc_id")
            .sortWithinPartitions("doc_id", "text"))
    rows.mapInArrow(shard_rows, SCHEMA).write.mode("errorifexists").parquet(folder)


ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t])
                   for n, t in (c.split() for c in SCHEMA.split(", "))])


def _documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            lengths = np.frombuffer(row["doc_lengths"], "<u8").astype(np.int64)
            ids, null = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["doc_null"], np.uint8)
            starts = np.cumsum(lengths) - lengths
            data = memoryview(Block(row).ids(0, row["n_ids"]).astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * s:4 * (s + n)]) for s, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "shard": pa.array([row["shard"]] * len(ids), pa.int32()),
                "start": pa.array(row["first"] + starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64())})


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(folder)
    # one row for each shard, and a shard is a shuffle partition: a table of proven size
    shards = (blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
              .select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before")))
    rows = (blocks.select("shard", "first", "n_ids", "doc_ids", "doc_null", "doc_lengths", "base", "rules", "lengths", "sequence")
            .mapInArrow(_documents, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long"))
    return (rows.join(F.broadcast(shards), "shard")
            .select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "repair-ids")
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer_path("word_bpe_49k.json"))
    return read_documents(spark, folder)
