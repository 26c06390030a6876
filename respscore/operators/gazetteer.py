"""Named entities by a gazetteer (S12): leftmost-longest matching of multi-word phrases.

The phrase table is keyed by head (a phrase's first two words, or its only one) and length.  A text is searched in its row with a
sketch of the heads, and only positions that may begin a phrase leave it.  They meet the table on their head; what comes
out are the lengths that phrases with that head have, and only for these is the n-gram of that length built and
joined to the phrase of equal words.  Nothing is compared with all phrases, and a head with many phrases
adds one row for each length, not for each phrase.

Overlaps: of the matches that begin at a word the longest counts; then, from the left, a match is kept if it begins
at or behind the end of the last one kept.  A running maximum of ends cuts a text's matches into islands that do not overlap; the
left-to-right choice is a fold inside each island.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..session import cut_lineage
from .presence import maybe, presence
from .wordvec import word_chunks

#: fixed value: a word of texts and phrases, in lower case
WORD_PATTERN = r"[\p{L}\p{N}]+"
#: words that a task hands on at a time
_CHUNK = 1 << 20


def words(text):
    return F.regexp_extract_all(F.lower(T._c(text)), F.lit(WORD_PATTERN), 0)


def phrase_table(gazetteer: DataFrame, phrase: str = "phrase", label: str = "label") -> DataFrame:
    """(phrase, first, size, label): phrases as their words; of several labels the first by code point."""
    w = gazetteer.select(words(phrase).alias("_w"), label).where(F.size("_w") > 0)
    w = w.select(F.array_join("_w", " ").alias("phrase"), F.get("_w", F.lit(0)).alias("first"), F.size("_w").alias("size"), F.col(label).alias("label"))
    return w.groupBy("phrase", "first", "size").agg(F.min("label").alias("label"))


def phrase_matches(df: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, start, end, phrase, label): every place where a phrase's words stand, starts counted in words from 0."""
    head = F.when(F.col("size") > 1, F.substring_index("phrase", " ", 2)).otherwise(F.col("phrase"))
    phrases = phrases.select("phrase", "size", "label", head.alias("head"))
    lengths = phrases.select("head", "size").distinct()
    longest = phrases.agg(F.max("size")).scalar()
    tokens = df.select(key, words(F.coalesce(text, F.lit(""))).alias("_a"), longest.alias("_m"))
    sketch = presence(phrases.select("head").distinct(), "head")

    def run(batches):
        for batch in batches:
            most = batch.column(batch.schema.get_field_index("_m"))[0].as_py() if batch.num_rows else 0
            for (keys,), sizes, flat in word_chunks(batch, key, name="_a"):
                hits, size = _heads(flat, sizes, sketch), max(most or 0, 0)
                ends, starts = np.cumsum(sizes), np.cumsum(sizes) - sizes
                for part in np.array_split(hits, len(hits) * size // _CHUNK + 1):
                    row = np.searchsorted(ends, part, "right")
                    n = np.minimum(size, ends[row] - part)
                    at = np.repeat(part - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    tails = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), flat.take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(part - starts[row], pa.int64()), tails], names=[key, "start", "tail"])

    places = tokens.mapInArrow(run, df.select(key).schema.add("start", "long").add("tail", ArrayType(StringType())))
    one, two = F.get("tail", F.lit(0)), F.array_join(F.slice("tail", 1, 2), " ")
    heads = places.select(key, "start", "tail", F.explode(F.array_distinct(F.array(one, two))).alias("head"))
    grams = (heads.join(lengths, "head").where(F.size("tail") >= F.col("size"))
             .select(key, "start", (F.col("start") + F.col("size")).cast("long").alias("end"),
                     F.array_join(F.slice("tail", F.lit(1), F.col("size")), " ").alias("phrase")))
    return grams.join(phrases.select("phrase", "label"), "phrase").select(key, "start", "end", "phrase", "label")


def _heads(flat, sizes, sketch: np.ndarray) -> np.ndarray:
    """Places of words that may be a phrase of one word, or begin a longer one together with the next word of their text."""
    coded = flat.dictionary_encode()
    held, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    alone = maybe(sketch, held)[code] if len(held) else np.zeros(0, bool)
    text = np.repeat(np.arange(len(sizes)), sizes)
    pairs, place = np.unique(code[:-1] * (len(held) + 1) + code[1:], return_inverse=True)
    first, second = np.divmod(pairs, len(held) + 1)
    met = maybe(sketch, [f"{held[i]} {held[j]}" for i, j in zip(first.tolist(), second.tolist())])[place] & (text[:-1] == text[1:])
    return np.flatnonzero(alone | np.append(met, np.zeros(len(code) - len(met), bool)))


def leftmost_longest(matches: DataFrame, key: str) -> DataFrame:
    """The matches that are kept, without overlaps."""
    longest = (matches.groupBy(key, "start").agg(F.max(F.struct("end", "phrase", "label")).alias("m"))
               .select(key, "start", "m.end", "m.phrase", "m.label"))
    in_text = W.partitionBy(key).orderBy("start")
    reach = F.max("end").over(in_text.rowsBetween(W.unboundedPreceding, -1))
    rows = longest.withColumn("_new", (F.col("start") >= F.coalesce(reach, F.lit(0))).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(in_text.rowsBetween(W.unboundedPreceding, W.currentRow)))
    islands = rows.groupBy(key, "_island").agg(F.array_sort(F.collect_list(F.struct("start", "end", "phrase", "label"))).alias("_m"))
    begin = F.struct(F.lit(-1).cast("long").alias("last"), F.slice("_m", F.lit(1), F.lit(0)).alias("kept"))
    keep = lambda s, m: F.when(m["start"] >= s["last"], F.struct(m["end"].alias("last"), F.concat(s["kept"], F.array(m)).alias("kept"))).otherwise(s)
    return islands.select(key, F.explode(F.aggregate("_m", begin, keep)["kept"]).alias("m")).select(key, "m.*")


def gazetteer_entities(df: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """(key, entity_cnt, entities) of every row: ``label:phrase`` in order of place, joined by '|'."""
    phrases = cut_lineage(phrase_table(gazetteer), "gazetteer")
    kept = leftmost_longest(phrase_matches(df, key, text, phrases), key)
    named = F.struct("start", F.concat_ws(":", "label", "phrase").alias("name"))
    per = kept.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(named)), lambda s: s["name"]), "|").alias("_e"))
    return df.select(key).join(per, key, "left").select(
        key, F.coalesce("_n", F.lit(0)).cast("long").alias("entity_cnt"), F.coalesce("_e", F.lit("")).alias("entities"))
