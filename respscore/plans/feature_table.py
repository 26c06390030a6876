"""Feature pipeline #1: response ⋈ prompt -> 15 features scaled within prompt.

Plan shape: prompt features on the prompt table (one row per prompt), one
equi-join into the responses, one pass over the joined rows that makes all counts of a
text in its row (``text_rows``), and the TF-IDF rolling score by blocks of a prompt's
documents, joined back on the response id.  Scaling is a grouped min/max joined on ``prompt_id``.
Where ids repeat, rows of an id meet in aggregates and joins (``_by_aggregates``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import ranking as RK
from ..operators import scale as SC
from ..operators import text_rows as TR
from ..operators import tfidf as TF
from ..operators import vocab as V
from ..session import cut_lineage, kept, temporary

FEATURES = [
    "text_word_cnt", "text_length", "text_stopword_cnt", "text_punct_cnt",
    "text_misspelled_cnt", "text_different_word_cnt", "text_different_word_ratio",
    "text_word_ratio", "text_length_ratio", "text_stopword_ratio", "text_punct_ratio",
    "karp_tfidf_scores", "shared_2grams", "shared_3grams", "shared_4grams",
]


def raw_features(responses: DataFrame, prompts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(response_id, prompt_id, 15 unscaled features)."""
    r = responses.select("response_id", "prompt_id", "text")
    used = TF.used_prompts(r, prompts)
    ids = r.select(F.col("response_id").alias("id")).unionByName(used.select(F.col("doc_id").alias("id")))
    if RK.by_repeated_key(ids, "id")[1] is not None:
        return _by_aggregates(responses, prompts, dictionary)
    p = FE.prompt_features(prompts, keep_text=False).drop("prompt_text_nostop")
    lines = [F.array_join(f"prompt_text_{n}grams", "\n").alias(f"g{n}") for n in (2, 3, 4)]
    j = r.join(p.select("prompt_id", *lines), "prompt_id")
    rows = TR.counted_texts(j, V.lexicon(dictionary, prompts), ["g2", "g3", "g4"], TR.feature_counts, TR.COUNTS, TR.BAG, ["prompt_id"], "text-rows")
    bags = rows.select("prompt_id", F.col("response_id").alias("doc_id"), "terms", "tfs", "n_terms")
    used = cut_lineage(TR.term_bags(used, "prompt_id", "doc_id"), "prompt-terms").select(*bags.columns)
    with temporary() as made:
        scores = TF.bag_scores(bags.unionByName(used))
        kept(made, scores)
    karp = scores.select(F.col("doc_id").alias("response_id"), F.col("rolling").alias("karp_tfidf_scores"))
    j = FE.ratios(rows.where("response_id is not null").drop("terms", "tfs", "n_terms").join(p.select("prompt_id", *[f"prompt_text_{c}" for c, _ in FE.RATIO_PAIRS]), "prompt_id"))
    out = j.join(karp, "response_id", "left").withColumn("karp_tfidf_scores", F.coalesce("karp_tfidf_scores", F.lit(0.0)))
    return out.select("response_id", "prompt_id", *FEATURES)


def _by_aggregates(responses: DataFrame, prompts: DataFrame, dictionary: DataFrame) -> DataFrame:
    r = responses.select("response_id", "prompt_id", "text")
    p = FE.prompt_features(prompts, keep_text=False).drop("prompt_text_nostop")
    j = FE.ratios(FE.join_prompts(FE.response_counts(r, keep_clean=True), p))
    j = FE.shared_ngrams(j)
    known = cut_lineage(V.lexicon(dictionary, prompts), "lexicon")  # read for its longest word and for the unknown ones
    mis = V.misspelled_cnt(r, "response_id", "text", known)
    weights, vocab = TF.tfidf_parts(TF.corpus_with_prompts(r, prompts))
    karp = TF.tfidf_rolling(weights, r, vocab=vocab)
    out = j.join(mis, "response_id").join(karp, "response_id")
    return out.select("response_id", "prompt_id", *FEATURES)


def feature_table(responses: DataFrame, prompts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """B6 then E1 over the 15 features.

    The raw features are checkpointed to the shared folder first: scaling reads
    them twice (group min/max, then the rows), and the text work behind them
    must run once, and must not rerun from the text after a lost executor.
    """
    raw = cut_lineage(raw_features(responses, prompts, dictionary))
    raw = raw.select("response_id", "prompt_id", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    return SC.minmax_by_group(SC.nonfinite_to_zero(raw, FEATURES), FEATURES, "prompt_id")
