"""Collocations, mined level by level with double-array tries.

Level 1 are words, level k phrases of k words.  A level has two steps.

* Candidates.  A task names the phrases it met whose two parts (without the first and without the last word) are frequent, and
  only those: no other phrase can be frequent (Apriori).  With each goes how often the task met it, up to ``least``; a sum
  that stays below ``least`` proves a phrase infrequent, so no frequent one is lost.
* Counts.  The candidates become double-array tries, which are broadcast.  Numpy walks all text positions
  of a block down the trie at once, a byte of the key each step; positions whose next node does not exist drop out, and the
  accepting nodes of those that arrive are counted with ``bincount``.  A task sums its blocks and emits its counts once, as
  vectors of SLICE numbers, and the tasks' vectors are summed slice by slice.  The same walk writes, for each position, the number of the phrase that starts there (0 for none);
  such a sequence is what the next level reads: its phrases are pairs of neighbouring numbers.

A trie holds at most SHARD keys and SHARD_BYTES bytes of them, so a broadcast has a fixed bound; more candidates
make more tries, each walked in a pass of its own over the same positions.  Text is read for level 1 alone.  A pass keeps its
counts, and what it read goes once it is written, so that the disk holds two passes at most, however many tries there are.

Counts are longs; scores are exact integers out of decimals of 38 digits.

Defined results: a null text is empty; a null ``lang`` counts as the language ``und``; empty texts hold no word; texts and words are
whole, however long; words of over LONG bytes are looked up as a whole beside the trie; repeated rows count each time; ties
in the report go by score, occurrences and the phrase's bytes; an empty table gives an empty result; only ``text`` and ``lang``
are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from respscore.llm.common import arrow_rows, arrow_rows_at_once, release, shuffle_width, small_batches
from respscore.session import conf_set, cut_lineage, discard

LEAST = 10
MAX_WORDS = 3
TOP = 2000
#: Parts of a language that are ranked on their own before they meet.
DEALS = 64
#: Percent of a phrase's occurrences inside one longer phrase from which on it is dropped.
INSIDE = 50

SHARD = 1 << 20
SLICE = 4096
SHARD_BYTES = 32 << 20
#: Words of more bytes are kept out of the trie, whose walk takes a step for each byte.
LONG = 64
#: Text that is walked together; distinct words that a task remembers, and pairs that it sorts together.
BLOCK_BYTES = 1 << 20
REMEMBERED = 200_000
SORTED = 1_000_000
#: Numbers in a row of a sequence, about: rows end where a zero stands.
ROW_NUMBERS = 2048
#: Rows of texts and of sequences that pass to Python at once.
TEXT_ROWS, SEQUENCE_ROWS = 1000, 250
#: Session setting: how tables are packed.
CODEC = "spark.sql.parquet.compression.codec"

BLANK, BREAK = 0x20, 0x0A
#: A-Z in lower case, tabs as blanks, and every mark that ends a piece as a line feed.
TRANSLATED = bytes(b + 32 if 65 <= b <= 90 else BLANK if b == 9 else BREAK if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class Trie:
    """A double-array trie: the child of slot s by byte b is slot ``base[s] + b`` if ``check`` of that is s."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray):
        """From keys that are sorted and distinct, given as places in ``data``; key number i is accepted as i."""
        node = np.zeros(len(start), np.int64)
        parents, symbols, n_nodes = [], [], 1
        active, level = np.arange(len(start)), 0
        while len(active):
            active = active[length[active] > level]
            edge = node[active] << 8 | data[start[active] + level]
            new = np.diff(edge, prepend=-1) != 0
            node[active] = n_nodes - 1 + np.cumsum(new)
            parents.append(edge[new] >> 8)
            symbols.append(edge[new] & 255)
            n_nodes += int(new.sum())
            level += 1
        parent = np.concatenate(parents) if parents else np.empty(0, np.int64)
        symbol = np.concatenate(symbols) if symbols else np.empty(0, np.int64)
        base, slot, size = place_children(parent, symbol, n_nodes)
        self.base, self.check, self.accept = (np.full(size + 256, x, np.int32) for x in (0, -1, -1))
        self.base[slot] = base
        self.check[slot[1:]] = slot[parent]
        self.accept[slot[node]] = np.arange(len(start))

    def step(self, state: int, symbols: bytes) -> int:
        """The slot after some more bytes, or -1."""
        for b in symbols:
            following = int(self.base[state]) + b
            if state < 0 or self.check[following] != state:
                return -1
            state = following
        return state

    def walk(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray) -> np.ndarray:
        """For each position the number of the key that its bytes spell from slot ``state`` on, or -1."""
        out = np.full(len(start), -1, np.int32)
        order = np.argsort(-length, kind="stable")
        order = order[state[order] >= 0].astype(np.int32)
        at, left, state, level = start[order], length[order], state[order], 0
        while len(order):
            n = int(np.searchsorted(-left, -level, side="left"))  # those from n on are at their end
            out[order[n:]] = self.accept[state[n:]]
            following = self.base[state[:n]] + data[at[:n] + level]
            alive = self.check[following] == state[:n]
            order, at, left, state = order[:n][alive], at[:n][alive], left[:n][alive], following[alive]
            level += 1
        return out


def place_children(parent: np.ndarray, symbol: np.ndarray, n_nodes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bases and slots of all nodes, given the parent and the byte of each but the root; children of a node are neighbours.

    Nodes with many children draw places first, all of a size at once; those whose children all fall on free slots stay there
    and the others draw again, at last in room of their own.  Only children then fill the free slots one by one.
    """
    rng = np.random.default_rng(5)
    size = n_nodes * 3 // 2 + 4096
    first = np.flatnonzero(np.diff(parent, prepend=-1))
    many = np.diff(np.append(first, len(parent)))
    base, slot = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
    used = np.zeros(size, bool)
    used[:256] = True
    for most, least in ((256, 33), (32, 9), (8, 4), (3, 3), (2, 2)):
        left = np.flatnonzero((many <= most) & (many >= least))
        for turn in range(60):
            if not len(left):
                break
            if turn == 59:  # crowded: a stretch of 256 slots for each
                draw = len(used) + 256 * np.arange(len(left))
                used = np.concatenate((used, np.zeros(256 * len(left) + 256, bool)))
            else:
                draw = rng.integers(1, len(used) - 256, len(left))
            begin = np.cumsum(many[left]) - many[left]
            child = np.repeat(first[left] - begin, many[left]) + np.arange(int(many[left].sum()))
            slots = np.repeat(draw, many[left]) + symbol[child]
            owner = np.repeat(np.arange(len(left)), many[left])
            claims = np.zeros(len(used), np.int32)
            claims[slots[::-1]] = owner[::-1]
            good = np.logical_and.reduceat(~used[slots] & (claims[slots] == owner), begin)
            base[parent[first[left[good]]]] = draw[good]
            taken = good[owner]
            slot[1 + child[taken]] = slots[taken]
            used[slots[taken]] = True
            left = left[~good]
    single = first[many == 1]
    free = np.flatnonzero(~used)[:len(single)]
    if len(free) < len(single):
        free = np.concatenate((free, len(used) + np.arange(len(single) - len(free))))
    slot[1 + single] = free
    base[parent[single]] = free - symbol[single]
    return base, slot, max(len(used), int(free.max(initial=0)) + 1)


class Shard:
    """A trie of some numbered keys, and the long words beside it."""

    def __init__(self, keys: list[bytes], ids: np.ndarray):
        is_long = np.array([len(k) - k.rfind(b" ") - 1 > LONG for k in keys], bool)
        self.long = {keys[i]: int(ids[i]) for i in np.flatnonzero(is_long)}
        short = np.flatnonzero(~is_long)
        lengths = np.array([len(keys[i]) for i in short], np.int64)
        self.trie = Trie(np.frombuffer(b"".join(keys[i] for i in short), np.uint8), np.cumsum(lengths) - lengths, lengths)
        self.first, self.size = (int(ids[0]), len(ids)) if len(ids) else (0, 0)
        self.ids = np.asarray(ids, np.int64)[short]


class Tally:
    """What a task has met of a shard's keys."""

    def __init__(self, shard: Shard):
        self.shard, self.met, self.long = shard, np.zeros(len(shard.ids), np.int64), Counter()

    def add(self, accepted: np.ndarray) -> None:
        self.met += np.bincount(accepted, minlength=len(self.met))

    def rows(self):
        """The counts in vectors of SLICE numbers each, those without a hit left out."""
        counts = np.zeros(self.shard.size, np.int64)
        counts[self.shard.ids - self.shard.first] = self.met
        for i, n in self.long.items():
            counts[i - self.shard.first] = n
        for at in range(0, len(counts), SLICE):
            if counts[at:at + SLICE].any():
                yield _walked(1, id=[self.shard.first + at], counts=[packed_counts(counts[at:at + SLICE])])


def packed_counts(counts: np.ndarray) -> bytes:
    """A vector of counts in numbers as narrow as the largest allows, after a byte with their width."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max(initial=0)) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def summed(batches):
    """Sums of the vectors of each slice, for rows that stand together by slice: one vector is in memory at a time."""
    now, total = None, None

    def emitted():
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(now + at), pa.array(total[at])], names=["id", "n"])

    for batch in batches:
        for i, counts in arrow_rows(batch, "id", "counts"):
            counts = unpacked_counts(counts)
            if i != now and now is not None:
                yield emitted()
            now, total = i, counts if i != now else total + counts
    if now is not None:
        yield emitted()


def words_of(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one run of bytes, and of each word: start, length, number of its piece and of its text."""
    data = b"\n".join(texts).translate(TRANSLATED)
    codes = np.frombuffer(data, np.uint8)
    stop = codes == BREAK
    gap = stop | (codes == BLANK)
    edges = np.flatnonzero(np.diff(gap.view(np.int8), prepend=1, append=1))
    start, length = edges[::2], edges[1::2] - edges[::2]
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    return data, start, length, np.searchsorted(np.flatnonzero(stop), start), np.searchsorted(np.cumsum(sizes), start, side="right")


def numbers_of_words(shard: Shard, texts: list[bytes], langs: list[bytes], tally: Tally) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word in the texts its number (0: none in this shard), its piece and its text; the tally counts them."""
    data, start, length, piece, text = words_of(texts)
    roots = {lang: shard.trie.step(0, lang + b" ") for lang in set(langs)}
    state = np.array([roots[lang] for lang in langs], np.int64)[text]
    state[length > LONG] = -1
    found = shard.trie.walk(np.frombuffer(data, np.uint8), start, length, state)
    numbers, hit = np.zeros(len(start), np.int64), found >= 0
    numbers[hit] = shard.ids[found[hit]]
    tally.add(found[hit])
    for i in np.flatnonzero(length > LONG) if shard.long else ():
        numbers[i] = shard.long.get(langs[text[i]] + b" " + data[start[i]:start[i] + length[i]], 0)
        if numbers[i]:
            tally.long[int(numbers[i])] += 1
    return numbers, piece, text


def numbers_of_pairs(shard: Shard, sequence: np.ndarray, width: int, tally: Tally) -> np.ndarray:
    """For each position of a sequence the number of the pair that starts there (0: none in this shard)."""
    out = np.zeros(len(sequence), np.int64)
    at = np.flatnonzero((sequence[:-1] > 0) & (sequence[1:] > 0))
    data = np.ascontiguousarray(sequence.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - width:]).ravel()
    found = shard.trie.walk(data, at * width, np.full(len(at), 2 * width), np.zeros(len(at), np.int64))
    hit = found >= 0
    out[at[hit]] = shard.ids[found[hit]]
    tally.add(found[hit])
    return out


def without_runs(numbers: np.ndarray) -> np.ndarray:
    """Runs of zeros shortened to one."""
    return numbers[(numbers > 0) | (np.append(0, numbers[:-1]) > 0)]


def in_rows(numbers: np.ndarray) -> list[bytes]:
    """A sequence in rows of about ROW_NUMBERS, cut at zeros, so that no phrase is cut."""
    numbers = without_runs(numbers)
    zeros = np.flatnonzero(numbers == 0)
    at = np.searchsorted(zeros, np.arange(ROW_NUMBERS, len(numbers), ROW_NUMBERS))
    return [_packed(x) for x in np.split(numbers, zeros[np.unique(at[at < len(zeros)])]) if len(x)]


def joined(rows: list[bytes]) -> np.ndarray:
    """Rows of a sequence one after the other, zeros between them."""
    return np.frombuffer(b"\0\0\0\0".join(rows), "<u4")


def with_breaks(numbers: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Numbers of words with a zero wherever a new piece begins."""
    after = np.diff(piece, prepend=piece[:1]) > 0
    out = np.zeros(len(numbers) + int(after.sum()), np.int64)
    out[np.arange(len(numbers)) + np.cumsum(after)] = numbers
    return out


WALKED = "lang binary, text binary, numbers binary, sequence binary, id long, counts binary, n long"
WALKED_ARROW = pa.schema([("lang", pa.binary()), ("text", pa.binary()), ("numbers", pa.binary()), ("sequence", pa.binary()),
                          ("id", pa.int64()), ("counts", pa.binary()), ("n", pa.int64())])


def _walked(n_rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n_rows, f.type) for f in WALKED_ARROW],
                                      schema=WALKED_ARROW)


def _packed(x: np.ndarray) -> bytes:
    return x.astype("<u4").tobytes()


def _merged(numbers: np.ndarray, before: bytes | None) -> np.ndarray:
    """Numbers of this shard on top of those of the shards before."""
    return numbers if before is None else np.maximum(numbers, np.frombuffer(before, "<u4"))


def walk_texts(shared, first: bool, last: bool):
    """Pass over texts (lang, text, numbers of earlier shards): counts, and numbers or, in the last pass, sequences."""
    def run(batches):
        shard, totals = shared.value, Counter()
        tally = Tally(shard)
        for batch in small_batches(batches, BLOCK_BYTES):
            langs, texts, before = map(list, zip(*arrow_rows(batch, "lang", "text", "numbers")))
            numbers, piece, text = numbers_of_words(shard, texts, langs, tally)
            if first:
                for lang, n in zip(langs, np.bincount(text, minlength=len(texts)).tolist()):
                    totals[lang] += n
            else:
                numbers = _merged(numbers, b"".join(before))
            if last:
                rows = in_rows(with_breaks(numbers, piece))
                yield _walked(len(rows), sequence=rows)
            else:
                ends = np.searchsorted(text, np.arange(1, len(texts)))
                yield _walked(len(texts), lang=langs, text=texts, numbers=[_packed(x) for x in np.split(numbers, ends)])
        yield from tally.rows()
        if totals:
            yield _walked(len(totals), lang=list(totals), n=list(totals.values()))
    return run


def walk_sequences(shared, width: int, last: bool, wanted: bool):
    """The same over sequences: counts of pairs and, if ``wanted``, numbers or the sequences of the next level."""
    def run(batches):
        shard = shared.value
        tally = Tally(shard)
        for batch in batches:
            rows, before = map(list, zip(*arrow_rows(batch, "sequence", "numbers"))) if batch.num_rows else ([], [])
            numbers = numbers_of_pairs(shard, joined(rows), width, tally)
            if wanted and rows:
                numbers = _merged(numbers, None if before[0] is None else b"\0\0\0\0".join(before))
                if last:
                    rows = in_rows(numbers)
                    yield _walked(len(rows), sequence=rows)
                else:
                    ends = np.cumsum([len(x) // 4 + 1 for x in rows])
                    yield _walked(len(rows), text=rows, numbers=[_packed(x[:-1]) for x in np.split(np.append(numbers, 0), ends[:-1])])
        yield from tally.rows()
    return run


def _seen_words(least: int):
    """Distinct (lang, word) of a task, each with its count up to ``least``; a full memory is emitted and begun anew."""
    def run(batches):
        seen: dict[bytes, Counter] = {}

        def emitted():
            for lang, words in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.binary()), pa.array(list(words), pa.binary()),
                                                  pa.array(np.minimum(np.fromiter(words.values(), np.int64, len(words)), least))],
                                                 names=["lang", "word", "seen"])
            seen.clear()

        for batch in small_batches(batches, BLOCK_BYTES):
            texts: dict[bytes, list[bytes]] = {}
            for lang, text in arrow_rows(batch, "lang", "text"):
                texts.setdefault(lang, []).append(text)
            for lang, found in texts.items():
                seen.setdefault(lang, Counter()).update(b"\n".join(found).translate(TRANSLATED).split())
            if sum(map(len, seen.values())) > REMEMBERED:
                yield from emitted()
        yield from emitted()
    return run


def _seen_pairs(least: int):
    """Distinct pairs of neighbouring numbers in a task's sequences, each with its count up to ``least``."""
    def emitted(parts):
        pairs, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(np.minimum(n, least).astype(np.int64))], names=["pair", "seen"])

    def run(batches):
        parts = []
        for batch in batches:
            x = joined(batch.column(batch.schema.get_field_index("sequence")).to_pylist()).astype(np.int64)
            parts.append((x[:-1] << 32 | x[1:])[(x[:-1] > 0) & (x[1:] > 0)])
            if sum(map(len, parts)) > SORTED:
                yield emitted(parts)
                parts = []
        if parts:
            yield emitted(parts)
    return run


def numbered(candidates: DataFrame, key, size, name: str) -> tuple[DataFrame, list[int]]:
    """Candidates with their shard and number (from 1 on, by shard and key), and the shards' sizes."""
    total, n_bytes = candidates.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n_shards = max(1, -(-total // SHARD), -(-n_bytes // SHARD_BYTES))
    rows = candidates.withColumn("shard", F.pmod(F.xxhash64(*key), F.lit(n_shards)).cast("int"))
    # hashing deals them out evenly, so a window holds about SHARD rows
    rows = cut_lineage(rows.withColumn("place", F.row_number().over(W.partitionBy("shard").orderBy(*key))), name)
    sizes = dict(rows.groupBy("shard").count().collect())
    sizes = [sizes.get(s, 0) for s in range(n_shards)]
    before = F.lit(0)
    for s, n in enumerate(np.cumsum(sizes) - sizes):
        before = F.when(F.col("shard") == s, F.lit(int(n))).otherwise(before) if n else before
    return rows.withColumn("id", (F.col("place") + before).cast("long")), sizes


def _shards(rows: DataFrame, sizes: list[int], as_key):
    """One Shard after the other; the driver holds one at a time."""
    for s in range(len(sizes)):
        found = rows.where(F.col("shard") == s).select("id", as_key.alias("key")).orderBy("id").toArrow()
        yield Shard(found.column("key").to_pylist(), found.column("id").to_numpy())


def _level(rows: DataFrame, numbers: DataFrame, sizes: list[int], as_key, walk, name: str, wanted: bool = True) -> tuple[DataFrame, list[DataFrame]]:
    """Walk all shards: the sequences of the last table, if wanted, and all tables, which hold the counts."""
    spark, tables, before = rows.sparkSession, [], None
    for s, shard in enumerate(_shards(numbers, sizes, as_key)):
        last = s == len(sizes) - 1
        shared = spark.sparkContext.broadcast(shard)
        with arrow_rows_at_once(spark, TEXT_ROWS if "lang" in rows.columns else SEQUENCE_ROWS), conf_set(spark, CODEC, "zstd"):
            walked = cut_lineage(rows.mapInArrow(walk(shared, s == 0, last), WALKED), f"{name}-{s}")
        shared.unpersist()
        if before is not None:
            discard(before)
        if last or not wanted:
            tables.append(walked)
        else:
            tables.append(cut_lineage(walked.where("n is not null or counts is not null"), f"{name}-counts{s}"))
            rows, before = walked.where("numbers is not null").select("lang", "text", F.col("text").alias("sequence"), "numbers"), walked
    return tables[-1].where("sequence is not null").select("sequence", F.lit(None).cast("binary").alias("numbers")), tables


def _with_counts(numbers: DataFrame, tables: list[DataFrame], least: int, name: str) -> DataFrame:
    """Candidates with their exact counts ``f``."""
    counts = None
    for t in tables:
        part = t.where("counts is not null").select("id", "counts")
        counts = part if counts is None else counts.union(part)
    spark = numbers.sparkSession
    with arrow_rows_at_once(spark, SEQUENCE_ROWS):
        counts = (counts.repartition(shuffle_width(spark), "id").sortWithinPartitions("id").mapInArrow(summed, "id long, n long")
                  .where(F.col("n") >= least).withColumnRenamed("n", "f"))
        return cut_lineage(numbers.join(counts, "id").drop("shard", "place"), name)


def frequent_phrases(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n words) and, for each level, (id, lang, phrase, last, f, prefixes, suffixes, a, b).

    ``prefixes`` and ``suffixes`` are the counts of the phrase's first and last 1, 2, ... words; ``a`` and ``b`` number its
    parts of the level before.
    """
    # read once for the candidate words and once for the walk; all else reads what the walk has written
    rows = docs.select(F.coalesce(docs["lang"].cast("string"), F.lit("und")).cast("binary").alias("lang"),
                       F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"), F.lit(None).cast("binary").alias("numbers"))
    words = (rows.select("lang", "text").mapInArrow(_seen_words(least), "lang binary, word binary, seen long")
             .groupBy("lang", "word").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).drop("seen"))
    key = F.concat("lang", F.lit(b" "), "word")
    spark = docs.sparkSession
    with arrow_rows_at_once(spark, TEXT_ROWS):
        words = cut_lineage(words, "phrase-seen1")
    release(spark)
    words, sizes = numbered(words.withColumn("key", key), ["key"], F.octet_length("key"), "phrase-level1")
    sequences, tables = _level(rows, words, sizes, F.col("key"), walk_texts, "phrase-walk1")
    totals = cut_lineage(tables[0].where("id is null and n is not null").groupBy(F.col("lang").cast("string").alias("lang"))
                         .agg(F.sum("n").alias("n")), "phrase-totals")
    text = F.col("word").cast("string")
    found = _with_counts(words, tables, least, "phrase-found1")
    levels = [found.select("id", F.col("lang").cast("string").alias("lang"), text.alias("phrase"), text.alias("last"), "f",
                           F.array("f").alias("prefixes"), F.array("f").alias("suffixes"))]
    for k in range(2, max_words + 1):
        before, n_ids = tables, sum(sizes)
        if n_ids >= 1 << 31:
            raise ValueError(f"more than {1 << 31} frequent phrases of {k - 1} words")
        width = next(w for w in (1, 2, 3, 4) if n_ids < 1 << 8 * w)
        with arrow_rows_at_once(spark, SEQUENCE_ROWS):
            pairs = cut_lineage(sequences.select("sequence").mapInArrow(_seen_pairs(least), "pair long, seen long").groupBy("pair")
                                .agg(F.sum("seen").alias("seen")).where(F.col("seen") >= least).select("pair"), f"phrase-seen{k}")
        release(spark)
        numbers, sizes = numbered(pairs, ["pair"], F.lit(2 * width), f"phrase-level{k}")
        a, b = F.shiftrightunsigned("pair", 32), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
        as_key = F.unhex(F.concat(*(F.lpad(F.hex(x), 2 * width, "0") for x in (a, b))))
        wanted = k < max_words
        sequences, tables = _level(sequences, numbers, sizes, as_key, lambda shared, first, last, w=width, more=wanted: walk_sequences(shared, w, last, more),
                                   f"phrase-walk{k}", wanted)
        discard(*before)
        release(spark)
        found = _with_counts(numbers, tables, least, f"phrase-found{k}").select("id", a.alias("a"), b.alias("b"), "f")
        shorter = levels[-1]
        head = shorter.select(F.col("id").alias("a"), "lang", F.col("phrase").alias("head"), "prefixes")
        tail = shorter.select(F.col("id").alias("b"), "last", "suffixes")
        levels.append(cut_lineage(found.join(head, "a").join(tail, "b").select(
            "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", F.concat("prefixes", F.array("f")).alias("prefixes"),
            F.concat("suffixes", F.array("f")).alias("suffixes"), "a", "b"), f"phrase-named{k}"))
    discard(*tables)
    return totals, levels


def score_of(a, l, r):
    """floor(10^6 a^2 / (l r)), exact."""
    wide = lambda x: x.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1_000_000)) * wide(a) * wide(a), wide(l) * wide(r))


def collocations(docs: DataFrame, least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    totals, levels = frequent_phrases(docs, least, max_words)
    scored = None
    for k, level in enumerate(levels[1:], 2):
        def cut(j):
            l, r = F.element_at("prefixes", F.lit(j)), F.element_at("suffixes", F.lit(k - j))
            return F.struct(score_of(F.col("f"), l, r).alias("score"), F.lit(j).alias("k"), l.alias("l"), r.alias("r"))

        rows = level.withColumn("cut", F.array_min(F.array(*(cut(j) for j in range(1, k)))))
        if k < max_words:  # the phrases one word longer tell of all longer ones: those are no more frequent
            longer = (levels[k].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("most"))
                      .groupBy("id").agg(F.max("most").alias("most")))
            rows = rows.join(longer, "id", "left").where(F.coalesce(100 * F.col("most") < INSIDE * F.col("f"), F.lit(True)))
        rows = rows.select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "cut.score")
        scored = rows if scored is None else scored.union(rows)
    order = (F.desc("score"), F.desc("a"), "phrase")
    dealt = scored.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALS)))
    # the best of each deal first, so that no task sorts a whole language
    best = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_tries(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, id, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS MATERIALIZED (SELECT lang, id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM q),
g AS (SELECT lang, w, lead(w) OVER o AS x, lead(w, 2) OVER o AS y FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, w, count(*) AS f FROM g GROUP BY lang, w),
f2 AS MATERIALIZED (SELECT lang, w, x, count(*) AS f FROM g WHERE x IS NOT NULL GROUP BY lang, w, x),
f3 AS MATERIALIZED (SELECT lang, w, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY lang, w, x, y HAVING count(*) >= {LEAST}),
s2 AS (SELECT c.lang, c.w || ' ' || c.x AS phrase, c.f AS a, l.f AS l, r.f AS r FROM f2 c JOIN f1 l ON l.lang = c.lang AND l.w = c.w
      JOIN f1 r ON r.lang = c.lang AND r.w = c.x
      LEFT JOIN (SELECT lang, w, x, max(f) AS m FROM (SELECT lang, w, x, f FROM f3 UNION ALL SELECT lang, x, y, f FROM f3) GROUP BY lang, w, x) t
      ON t.lang = c.lang AND t.w = c.w AND t.x = c.x WHERE c.f >= {LEAST} AND (t.m IS NULL OR 100 * t.m < {INSIDE} * c.f)),
s3 AS (SELECT c.lang, c.w || ' ' || c.x || ' ' || c.y AS phrase, c.f AS a, l1.f AS l1, r2.f AS r2, l2.f AS l2, r1.f AS r1 FROM f3 c
      JOIN f1 l1 ON l1.lang = c.lang AND l1.w = c.w JOIN f2 r2 ON r2.lang = c.lang AND r2.w = c.x AND r2.x = c.y
      JOIN f2 l2 ON l2.lang = c.lang AND l2.w = c.w AND l2.x = c.x JOIN f1 r1 ON r1.lang = c.lang AND r1.w = c.y),
k3 AS (SELECT *, 1000000::HUGEINT * a * a // (l1::HUGEINT * r2) AS k1, 1000000::HUGEINT * a * a // (l2::HUGEINT * r1) AS k2 FROM s3),
u AS (SELECT lang, phrase, a, l, r, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM s2 UNION ALL
      SELECT lang, phrase, a, CASE WHEN k1 <= k2 THEN l1 ELSE l2 END, CASE WHEN k1 <= k2 THEN r2 ELSE r1 END, least(k1, k2) FROM k3)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase,
       CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM u JOIN n USING (lang) QUALIFY rank <= {TOP}
"""
