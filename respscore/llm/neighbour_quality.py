"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

A document's terms are its hashed words, the pairs of neighbouring character classes, and coarse figures of
length, repetition and compressibility.  Weighted by inverse document frequency and projected on the leading
singular directions of the labelled documents they give a short vector.  The labelled vectors are broadcast
(at most ``PER_CLASS`` of each label, a bound that does not grow with the data); each block of documents
is multiplied with all of them, and the ``NEIGHBOURS`` most similar vote with a power of their cosine.

Only the text enters a score.  Labels are taken from rows whose crc32(doc_id as text) mod 5 is not 0.

Defined results: null and empty texts have a vector (of their length alone) and a score like any other; texts are
read whole; repeated rows each get their row; without labelled documents every score is 0.5; a null ``doc_id`` is
held out (it has no remainder); of several labels for a document the highest counts; an empty table gives an
empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respscore.llm.common import arrow_rows, id_text, small_batches

#: Labelled documents of each label that may be used, the dimensions kept, and the voters.
PER_CLASS = 2048
RANK = 48
NEIGHBOURS = 32
POWER = 8
#: Documents whose cosines are in memory at once.
ROWS = 200
KEPT_FROM = 0.3

WORD_TERMS = 4096
CLASSES = 16
BINS = 16
TERMS = WORD_TERMS + CLASSES * CLASSES + 4 * BINS
#: Weight of words, of character classes, and of each coarse figure in a document's terms.
BLOCKS = (0.5, 1.0, 0.35)

_CLASS = bytearray(CLASSES - 1 for _ in range(256))
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n",
                             b".,;:", b"!?", b"'\"", b"()[]{}", b"-_", b"|", b"<>", b"#*", b"$%&", b"/\\@=+~^`")):
    for _c in _chars:
        _CLASS[_c] = _i
CLASS_OF = bytes(_CLASS)


def _bin(x: float) -> int:
    return min(BINS - 1, max(0, int(x)))


def terms(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and values of one text."""
    words = text.lower().split()
    counts = Counter(words)
    crc = zlib.crc32
    word_at = np.fromiter((crc(w) for w in counts), np.int64, len(counts)) % WORD_TERMS
    dense = np.bincount(word_at, np.fromiter(counts.values(), np.float64, len(counts)), WORD_TERMS) if counts else np.zeros(WORD_TERMS)
    at = np.flatnonzero(dense)
    value = 1 + np.log(dense[at])
    value *= BLOCKS[0] / max(1e-9, math.sqrt(float(value @ value)))
    classes = np.frombuffer(text.translate(CLASS_OF), np.uint8)
    pairs = np.bincount(classes[:-1].astype(np.int64) * CLASSES + classes[1:], minlength=CLASSES * CLASSES) if len(classes) > 1 else np.zeros(CLASSES * CLASSES)
    pair_at = np.flatnonzero(pairs)
    pair = np.sqrt(pairs[pair_at] / max(1, len(classes) - 1)) * BLOCKS[1]
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    figures = (_bin(math.log2(len(words) + 1)), _bin(BINS * len(zlib.compress(text, 1)) / (len(text) + 12)),
               _bin(BINS * (1 - len(set(lines)) / max(1, len(lines)))), _bin(BINS * len(counts) / max(1, len(words))))
    figure_at = WORD_TERMS + CLASSES * CLASSES + np.arange(4) * BINS + np.array(figures)
    return (np.concatenate((at, WORD_TERMS + pair_at, figure_at)).astype(np.int32),
            np.concatenate((value, pair, np.full(4, BLOCKS[2]))).astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


class Model:
    """Projection of terms, and the labelled vectors."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray):
        found = np.zeros((len(rows), TERMS), np.float32)
        for i, (at, value) in enumerate(rows):
            found[i, at] = value
        df = (found > 0).sum(0)
        self.idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
        found *= self.idf
        rng = np.random.default_rng(7)
        basis = found @ rng.standard_normal((TERMS, min(RANK + 8, len(rows))), dtype=np.float32)
        for _ in range(3):
            basis = found @ (found.T @ np.linalg.qr(basis)[0])
        basis = np.linalg.qr(basis)[0]
        self.directions = np.linalg.svd(basis.T @ found, full_matrices=False)[2][:RANK].T.astype(np.float32)
        self.voters, self.labels = self.unit(found @ self.directions), labels.astype(np.float32)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def vectors(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return self.unit(np.stack([(value * self.idf[at]) @ self.directions[at] for at, value in rows]))

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Weighted vote of the nearest; neighbours as near as the last of them vote too, so ties don't depend on order."""
        cosine = self.vectors(rows) @ self.voters.T
        k = min(NEIGHBOURS, cosine.shape[1])
        least = np.partition(cosine, -k, axis=1)[:, -k:].min(axis=1, keepdims=True) - 1e-5
        weight = np.where(cosine >= least, np.maximum(cosine, 0), 0).astype(np.float64) ** POWER
        total = weight.sum(axis=1)
        return np.clip(np.where(total > 0, (weight @ self.labels) / np.maximum(total, 1e-30), 0.5), 0, 1)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from at most PER_CLASS labelled documents of each label, those first in a hash order of their ids."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    chosen = None
    for label in (0, 1):
        part = (known.where(F.col("quality") == label).orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(PER_CLASS))
        chosen = part if chosen is None else chosen.union(part)

    # repeated documents: one row for each id, so the bound holds
    rows = (id_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")
            .mapInArrow(_listed, "doc_id long, quality int, at binary, value binary")
            .groupBy("doc_id").agg(F.min(F.struct("at", "value", "quality")).alias("x")).select("doc_id", "x.*").orderBy("doc_id").collect())
    if not rows:
        return None
    return Model([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in rows],
                 np.array([r["quality"] for r in rows]))


def _listed(batches):
    for batch in small_batches(batches):
        rows = [(i, q, *terms(t)) for i, q, t in arrow_rows(batch, "doc_id", "quality", "text")]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.array([r[0] for r in rows], pa.int64()), "quality": pa.array([r[1] for r in rows], pa.int32()),
            "at": pa.array([r[2].tobytes() for r in rows], pa.binary()), "value": pa.array([r[3].tobytes() for r in rows], pa.binary())})


def scored(rows: DataFrame, model: Model | None, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``rows`` and the score of the column ``text`` (string or its UTF-8 bytes)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in small_batches(batches, size=text):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [terms(t.encode() if isinstance(t, str) else t or b"") for t in texts]
            scores = (np.concatenate([model.scores(found[i:i + ROWS]) for i in range(0, len(found), ROWS)]) if model
                      else np.full(len(found), 0.5))
            yield batch.append_column(score, pa.array(scores, pa.float64()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType())]))


def op7_neighbour_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(id_text(docs), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEPT_FROM).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # so that no name clashes or needs quotes
    text = plain.columns[[c.lower() for c in docs.columns].index("text")]
    kept = scored(plain, fit(docs, labels), text=text).where(F.col("score") >= KEPT_FROM)
    return kept.select(*plain.columns).toDF(*docs.columns)
