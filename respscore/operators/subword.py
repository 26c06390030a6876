"""Sub-word token length (S13) by greedy longest match, in one join.

The vocabulary is a table of pieces: whole words, ``##``-continuations and
single characters.  Only *distinct* words are segmented.  Every stretch of a word, up to the longest piece, is looked up in a
sketch of the vocabulary, and what may be a piece is joined with it once; the longest hit at each position is what greedy matching would take there, and a fold over a
word's positions follows the hits from its begin.  A word that is not covered to its end counts as one unknown token.
Work is linear in a word's length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .presence import maybe, maybe_at, presence
from .wordvec import word_chunks


def wordpiece_vocab(words: DataFrame) -> DataFrame:
    """(piece): words, ##words, their characters and ##characters."""
    w = words.select(F.col("word").alias("piece")).distinct()
    chars = w.select(F.explode(F.split("piece", "")).alias("piece")).where(F.col("piece") != "").distinct()
    cont = lambda d: d.select(F.concat(F.lit("##"), "piece").alias("piece"))
    return w.unionByName(cont(w)).unionByName(chars).unionByName(cont(chars)).distinct()


def segment_counts(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, pieces) for distinct ``words`` against ``vocab``."""
    longest = vocab.agg(F.max(F.length("piece"))).scalar()
    vocab = cut_lineage(vocab, "subword-pieces")
    longest = vocab.agg(F.max(F.length("piece"))).scalar()
    distinct = cut_lineage(words.select("word").distinct(), "subword-words")
    sketch = presence(vocab, "piece")

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                found, most = [], part.column(1)[0].as_py() or 0
                rows, places, sizes, pieces, hashes = [], [], [], [], []
                for row, word in enumerate(part.column(0).to_pylist()):
                    for i in range(len(word)):
                        h = zlib.crc32(b"##") if i else 0
                        for k, c in enumerate(word[i:i + most], 1):
                            h = zlib.crc32(c.encode(), h)
                            rows.append(row), places.append(i), sizes.append(k), hashes.append(h)
                found = np.flatnonzero(maybe_at(sketch, hashes)).tolist() if hashes else []
                names = part.column(0).to_pylist()
                for f in found:
                    i, k = places[f], sizes[f]
                    pieces.append(("##" if i else "") + names[rows[f]][i:i + k])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([rows[f] for f in found], pa.int64())), pa.array([places[f] + 1 for f in found], pa.int32()),
                                                  pa.array([sizes[f] for f in found], pa.int32()), pa.array(pieces, pa.string())], names=["word", "pos", "k", "piece"])

    stretches = (distinct.where(F.length("word") > 0).select("word", longest.alias("most"))
                 .mapInArrow(run, "word string, pos int, k int, piece string"))
    hits = stretches.join(vocab, "piece", "left_semi").groupBy("word", "pos").agg(F.max("k").alias("k"))
    per = hits.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("hits"))
    begin = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"))
    step = lambda s, h: F.when(h["pos"] == s["at"], F.struct((s["at"] + h["k"]).alias("at"), (s["n"] + 1).alias("n"))).otherwise(s)
    walked = per.select("word", F.aggregate("hits", begin, step).alias("s"))
    covered = F.col("s.at") == F.length("word") + 1
    found = walked.select("word", F.when(covered, F.col("s.n")).otherwise(F.lit(1)).alias("pieces"))
    return distinct.join(found, "word", "left").select(
        "word", F.when(F.length("word") == 0, F.lit(0)).otherwise(F.coalesce("pieces", F.lit(1))).alias("pieces"))


def subword_len(df: DataFrame, key: str, tokens: str, vocab: DataFrame, out: str = "subword_len") -> DataFrame:
    """Sum of pieces over the basic tokens of each row.

    A row's tokens count one each where they stand; only words of another number of pieces are shuffled, once for each row
    that has them and with how often it does.
    """
    rows = cut_lineage(df.select(key, F.col(tokens).alias("_w")), "subword-tokens")
    counts = segment_counts(rows.select(F.explode("_w").alias("word")), vocab)
    other = cut_lineage(counts.where("pieces <> 1").select("word", (F.col("pieces") - 1).alias("more")), "subword-counts")
    sketch = presence(other, "word")

    def run(batches):
        for batch in batches:
            for (keys,), sizes, flat in word_chunks(batch, key, name="_w"):
                coded = flat.dictionary_encode()
                held, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.flatnonzero(maybe(sketch, held.to_pylist())[code]) if len(held) else np.zeros(0, np.int64)
                met, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[at] * max(len(held), 1) + code[at], return_counts=True)
                row, word = np.divmod(met, max(len(held), 1))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), held.take(pa.array(word)), pa.array(n, pa.int64())], names=[key, "word", "n"])

    words = rows.where(F.col(key).isNotNull()).mapInArrow(run, rows.select(key).schema.add("word", "string").add("n", "long"))
    more = words.join(other, "word").groupBy(key).agg(F.sum(F.col("n") * F.col("more")).alias("more"))
    sizes = rows.groupBy(key).agg(F.sum(F.greatest(F.size("_w"), F.lit(0))).alias("all"))
    per = sizes.join(more, key, "left").select(key, (F.col("all") + F.coalesce("more", F.lit(0))).cast("long").alias(out))
    return rows.select(key).join(per, key, "left").select(key, F.coalesce(out, F.lit(0)).cast("long").alias(out))
