"""Language identification by error-correcting output codes.

Every language has a codeword of +-1 bits; up to five languages take all distinct splits, more take the random code with
the largest least distance of CODES drawn.  Each bit has a binary classifier, which tells languages with +1 from
those with -1 by hashed byte n-grams: the log odds of each n-gram between the mean distributions of the two sides, averaged
over the n-grams of a text.  Decoding is loss-weighted: a language's loss is the sum over bits of exp(-bit * margin),
weighted by how often that bit's classifier is right on the language's own learning documents; the smallest loss is
the prediction, and a runner-up close behind it makes it ambiguous.

Texts are read twice: n-grams of the learning documents are counted by language (all of them, no sample; the counts of LANGUAGES *
SLOTS n-grams are the model, of fixed size), then every document's margins are written, a few numbers each, from which both the
weights and the predictions come.

Only the text enters a prediction.  Learning documents have a language and crc32(doc_id as text) mod 4 other than 2.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing was
learnt; with one language learnt every other text has it, with score 1; texts are read whole; equal losses go to the
language first by code point; beyond LANGUAGES languages, those with the most learning documents are learnt (ties by code
point); a null ``doc_id`` is held out (it has no remainder); repeated rows each get their row; an empty table gives an empty
result; only ``doc_id``, ``text`` and ``lang`` are read.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respscore.llm.common import arrow_rows, small_batches
from respscore.session import cut_lineage

LANGUAGES = 64
#: Lengths of the n-grams in bytes, and the slots that each length is hashed to (a power of two).
ORDERS = (2, 3, 4)
SLOT_BITS = 12
SLOTS = len(ORDERS) << SLOT_BITS
#: Added to every n-gram's count.
PRIOR = 0.5
#: Margins are in units of their mean size and cut off here.
FARTHEST = 3.0
CODES = 200
#: A runner-up whose loss is within this factor makes a prediction ambiguous.
CLOSE = 1.2
SHARPNESS = 4

LETTER = regex.compile(r"\p{L}")
#: Bytes that are no part of a letter end a word.
LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else 0x20 for b in range(256))
PAD = b" " * (max(ORDERS) - 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def ngram_counts(texts: list[str]) -> np.ndarray:
    """Counts (texts, SLOTS) of the hashed n-grams of the lower-cased words, a blank before and behind each."""
    parts = [b" " + b" ".join(t.lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" " for t in texts]
    data = np.frombuffer(b"".join(p + PAD for p in parts), np.uint8).astype(np.uint32)
    sizes = np.array([(len(p), len(PAD)) for p in parts], np.int64).ravel()
    owner = np.repeat(np.array([(i, len(parts)) for i in range(len(parts))]).ravel(), sizes)[:len(data) - len(PAD)]
    gram, out = np.zeros(len(owner), np.uint32), []
    for k in range(max(ORDERS)):
        gram |= data[k:len(owner) + k] << np.uint32(8 * k)
        if k + 1 in ORDERS:
            slot = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - SLOT_BITS)
            found = np.bincount(owner << SLOT_BITS | slot, minlength=(len(parts) + 1) << SLOT_BITS)
            out.append(found.reshape(-1, 1 << SLOT_BITS)[:len(parts)])
    return np.concatenate(out, 1)


def codewords(n: int) -> np.ndarray:
    """One row of +-1 bits for each of n languages."""
    if n <= 5:
        sides = [(1, *s) for s in itertools.product((1, -1), repeat=max(0, n - 1)) if -1 in s]
        return np.array(sides, np.int8).reshape(len(sides), n).T
    bits, rng, best = math.ceil(10 * math.log2(n)), np.random.default_rng(13), None
    for _ in range(CODES):
        code = rng.choice(np.array([1, -1], np.int8), (n, bits))
        code[0, np.abs(code.sum(0)) == n] *= -1  # no bit without two sides
        apart = (bits - code.astype(np.int32) @ code.T) // 2
        least = apart[~np.eye(n, dtype=bool)].min()
        if best is None or least > best[0]:
            best = least, code
    return best[1]


class Model:
    """Codewords and the bits' n-gram weights."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        shares = np.array([(counts[x] + PRIOR) / (counts[x].sum() + PRIOR * SLOTS) for x in self.languages]).reshape(-1, SLOTS)
        bits = self.code.T
        odds = [np.log(shares[b > 0].mean(0)) - np.log(shares[b < 0].mean(0)) for b in bits]
        self.weights = np.array(odds, np.float32).reshape(len(bits), SLOTS).T

    def margins(self, texts: list[str]) -> np.ndarray:
        counts = ngram_counts(texts)
        return (counts.astype(np.float32) @ self.weights) / np.maximum(counts.sum(1, keepdims=True), 1)


class Decoder:
    """Losses of all languages from a document's margins."""

    def __init__(self, model: Model, right: np.ndarray, size: np.ndarray):
        self.languages, self.code = model.languages, model.code.astype(np.float64)
        self.size = np.maximum(size, 1e-9)
        self.trust = (right + 1e-6) / (right + 1e-6).sum(1, keepdims=True)  # of each language and bit

    def losses(self, margins: np.ndarray) -> np.ndarray:
        scaled = np.clip(margins / self.size, -FARTHEST, FARTHEST)
        up, down = np.exp(-scaled), np.exp(scaled)
        return up @ (self.trust * (self.code > 0)).T + down @ (self.trust * (self.code < 0)).T

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Predictions, scores (the share of the best in the sum of inverse losses to the power SHARPNESS) and ambiguity."""
        if len(self.languages) == 1:
            return self.languages * len(margins), np.ones(len(margins)), np.zeros(len(margins), bool)
        losses = self.losses(margins)
        ordered = np.sort(losses, 1)
        score = 1 / ((ordered[:, :1] / losses) ** SHARPNESS).sum(1)
        return [self.languages[i] for i in losses.argmin(1)], score, ordered[:, 1] <= CLOSE * ordered[:, 0]


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, lang (null unless the row is for learning) and the whole text."""
    doc_id = docs["doc_id"].cast("long")
    return docs.select(doc_id.alias("doc_id"), F.when(~held_out(doc_id), docs["lang"].cast("string")).alias("lang"),
                       F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))


def _decoded(texts: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts]


def fit(rows: DataFrame) -> Model:
    """Count n-grams by language over all learning rows."""
    learnt = [r["lang"] for r in rows.where("lang is not null").groupBy("lang").count()
              .orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]

    def counted(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in small_batches(batches, 1 << 20, 256):
            langs, texts = map(list, zip(*arrow_rows(batch, "lang", "text")))
            found = ngram_counts(_decoded(texts))
            for lang in set(langs):
                mine = [i for i, x in enumerate(langs) if x == lang]
                totals[lang] = totals.get(lang, 0) + found[mine].sum(0)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "slot", "n"])

    table = (rows.where(F.col("lang").isin(learnt)).select("lang", "text").mapInArrow(counted, "lang string, slot int, n long")
             .groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    # a row for each language: at most SLOTS pairs in a group, at most LANGUAGES groups
    found = table.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("x")).select("lang", "x.slot", "x.n")
    return Model({r["lang"]: np.bincount(r["slot"], r["n"], SLOTS) for r in found.collect()})


def margins_of(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, whether the text has a letter, and the margin of each bit."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in small_batches(batches, 1 << 20, 256):
            texts = _decoded(batch.column(batch.schema.get_field_index("text")).to_pylist())
            found = model.margins(texts).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("lang")),
                 pa.array([LETTER.search(t) is not None for t in texts]), pa.array(list(found), pa.list_(pa.float64()))],
                names=["doc_id", "lang", "letters", "margins"])

    return rows.mapInArrow(run, "doc_id long, lang string, letters boolean, margins array<double>")


def decoder_of(margins: DataFrame, model: Model) -> Decoder:
    """Share of right bits for each language, and the mean size of each bit's margin, over all learning rows with a letter."""
    bits = range(model.code.shape[1])
    rows = margins.where(F.col("lang").isin(model.languages) & F.col("letters"))
    found = (rows.groupBy("lang").agg(F.count("*").alias("n"),
                                      F.array(*(F.avg((F.get("margins", F.lit(b)) > 0).cast("int")) for b in bits)).alias("up"),
                                      F.array(*(F.avg(F.abs(F.get("margins", F.lit(b)))) for b in bits)).alias("size")).collect() if bits else [])
    right, size = np.full(model.code.shape, 0.5), np.ones((len(model.languages), len(bits)))
    for r in found:  # one row for each language
        i = model.languages.index(r["lang"])
        up = np.array(r["up"])
        right[i], size[i] = np.where(model.code[i] > 0, up, 1 - up), r["size"]
    return Decoder(model, right, size.mean(0) if len(size) else size)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of every document."""
    rows = texts_of(docs)
    model = fit(rows)
    margins = cut_lineage(margins_of(rows, model), "language-margins")
    shared = docs.sparkSession.sparkContext.broadcast(decoder_of(margins, model))

    def decided(batches):
        decoder = shared.value
        for batch in batches:
            letters = batch.column(batch.schema.get_field_index("letters")).to_numpy(zero_copy_only=False).astype(bool)
            found = batch.column(batch.schema.get_field_index("margins")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(decoder.size))
            pred, score, close = (["und"] * batch.num_rows, np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool))
            if decoder.languages and batch.num_rows:
                best, score, close = decoder.decide(found)
                pred = [p if x else "und" for p, x in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(pred, pa.string()),
                                              pa.array(np.where(letters, score, 0.0)), pa.array(close & letters)],
                                             names=["doc_id", "lang_pred", "score", "ambiguous"])

    return margins.select("doc_id", "letters", "margins").mapInArrow(decided, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op12_output_codes(spark, sf_dir: str) -> DataFrame:
    found = languages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
