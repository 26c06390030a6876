"""Licence scan with a positional index of rare licence words, in DataFrame operations only.

Templates are short licence notices.  The index holds, for each template, its words of highest inverse
document frequency over all documents, and the one of its key phrase, with their positions.  A file's words are looked up in it; each hit
votes for a template and for the place in the file where the template would start, so hits agree if
their relative positions do.  All these places are verified: the template's key phrase must stand there word by
word.  As a word of it is in the index, a template is a label wherever its key phrase stands, whatever the table's
frequencies; the score is the share of the template's index weight that agrees.

Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing A-Z.  Everything
but the document frequencies of the (few, fixed) template words is local to a row: no shuffle, no key that
could be hot.

Defined results: null and empty texts have no words and no labels, score 0; texts are scanned whole;
repeated rows each get their row; an empty table gives an empty result (all frequencies are 0); only
``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that make a base label wherever their words stand consecutively.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label -> (words of the notice, its key phrase).
TEMPLATES = {
    "agpl": ("the terms of the gnu affero general public license as published by the free software foundation",
             "affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted",
            "redistribution and use in source and binary forms"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-nd": ("licensed under cc by nd 4 0", "cc by nd"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "gpl-2": ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "lgpl": ("the terms of the gnu lesser general public license as published by the free software foundation",
             "lesser general public license"),
    "mit-notice": ("permission is hereby granted free of charge to any person obtaining a copy of this software",
                   "permission is hereby granted free of charge"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
}

#: Words of a template that the index holds, besides the rarest of its key phrase.
INDEXED = 4


def document_words(docs: DataFrame) -> DataFrame:
    """doc_id and the lower-cased words.

    Only A-Z are lower-cased.  ``lower`` does the same, but for two characters that it turns into ASCII letters;
    texts with these are translated letter by letter.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    ascii_lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    low = F.when(text.contains("\u212a") | text.contains("\u0130"), ascii_lower).otherwise(F.lower(text))
    # explode of one element keeps the optimizer from evaluating the words once for each use
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"),
                       F.explode(F.array(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)))).alias("words"))


def template_idf(words: DataFrame) -> dict[str, float]:
    """Inverse document frequency of every template word over all documents; at most as many rows as template words."""
    vocabulary = sorted({w for notice, _ in TEMPLATES.values() for w in notice.split()})
    found = words.select(F.explode(F.array_append(F.array_intersect("words", F.array(*map(F.lit, vocabulary))), F.lit(""))).alias("w"))
    df = {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}
    n = df.get("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in vocabulary}


def rare_index(idf: dict[str, float]) -> dict[str, dict[int, float]]:
    """Template -> position -> weight of its INDEXED words of highest weight and that of its key phrase; ties go to the earlier word."""
    index = {}
    for label, (notice, key) in TEMPLATES.items():
        words, at, n = notice.split(), key_start(label), len(key.split())
        best = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))
        of_key = next(i for i in best if at <= i < at + n)
        index[label] = {i: idf[words[i]] for i in sorted({*best[:INDEXED], of_key})}
    return index


def key_start(label: str) -> int:
    """Position of the key phrase in its template."""
    notice, key = (x.split() for x in TEMPLATES[label])
    return next(i for i in range(len(notice)) if notice[i:i + len(key)] == key)


def phrase_starts(words: Column, phrase: str) -> Column:
    """Array of the word positions at which the phrase's words stand consecutively."""
    *rest, last = phrase.split()
    n = len(rest)

    def start(w: Column, i: Column) -> Column:
        here = w == last
        for k, x in enumerate(rest):
            here = here & (F.get(words, i - (n - k)) == x)
        return F.when(here, i - n)

    places = F.filter(F.transform(words, start), lambda x: x.isNotNull())
    present = F.array_contains(words, last)
    for x in rest:
        present = present & F.array_contains(words, x)
    return F.when(present, places).otherwise(F.array().cast("array<int>"))


def candidates(words: Column, index: dict[str, dict[int, float]]) -> Column:
    """Array of (label, start) for which some rare word of the file votes."""
    postings: dict[str, list[tuple[str, int]]] = {}
    for label, places in index.items():
        for i in places:
            postings.setdefault(TEMPLATES[label][0].split()[i], []).append((label, i))
    table = F.create_map(*(x for w, found in postings.items() for x in (
        F.lit(w), F.array(*(F.struct(F.lit(label).alias("label"), F.lit(i).alias("at")) for label, i in found)))))
    listed = F.array(*map(F.lit, postings))
    hits = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(postings)), F.struct(w.alias("w"), i.alias("i")))),
                    lambda h: h.isNotNull())
    votes = F.flatten(F.transform(hits, lambda h: F.transform(
        F.try_element_at(table, h["w"]), lambda p: F.struct(p["label"].alias("label"), (h["i"] - p["at"]).alias("start")))))
    return F.when(F.arrays_overlap(words, listed), F.array_distinct(votes))


def verified(words: Column, found: Column, index: dict[str, dict[int, float]]) -> Column:
    """Array of (label, score) of the candidates that hold: the key phrase stands in its place."""
    def score(c: Column) -> Column:
        value = F.lit(None).cast("double")
        for label, places in index.items():
            notice, key = (x.split() for x in TEMPLATES[label])
            total = sum(places.values())
            agreed = sum((F.when(F.get(words, c["start"] + i) == notice[i], F.lit(weight)).otherwise(F.lit(0.0))
                          for i, weight in places.items()), F.lit(0.0))
            at = key_start(label)
            stands = F.lit(True)
            for k, w in enumerate(key):
                stands = stands & F.coalesce(F.get(words, c["start"] + at + k) == w, F.lit(False))
            value = F.when(c["label"] == label, F.when(stands, F.least(agreed / total, F.lit(1.0)))).otherwise(value)
        return value

    scored = F.transform(found, lambda c: F.struct(c["label"].alias("label"), score(c).alias("score")))
    return F.coalesce(F.filter(scored, lambda c: c["score"].isNotNull()), F.array().cast("array<struct<label:string,score:double>>"))


def license_scan(docs: DataFrame) -> DataFrame:
    words = document_words(docs)
    index = rare_index(template_idf(words))
    barrier = lambda df, name, column: df.select("*", F.explode(F.array(column)).alias(name))
    column = F.col("words")
    rows = words.select("doc_id", "words", *(phrase_starts(column, p).alias(f"p{i}") for i, p in enumerate(PHRASES)),
                        candidates(column, index).alias("found"))
    rows = barrier(rows, "templates", verified(column, F.col("found"), index))
    places = [F.col(f"p{i}") for i in range(len(PHRASES))]
    starts = F.concat(*places)
    base = F.filter(F.array(*(F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, PHRASES.values()))),
                    lambda x: x.isNotNull())
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("templates", lambda c: c["score"])), F.lit(0.0))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
                       F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                       joined(base).alias("base_labels"),
                       joined(F.concat(base, F.transform("templates", lambda c: c["label"]))).alias("labels"),
                       F.when(F.size(starts) > 0, F.lit(1.0)).otherwise(best).alias("score"))


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
