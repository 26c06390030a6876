"""Per-response and per-prompt count features and the response ⋈ prompt join.

Prompt features are computed on the prompt table *before* the join (one row
per prompt instead of one per response), then joined on ``prompt_id``.  The
join is a plain equi-join: Spark broadcasts the prompt side only when its
measured size is under the broadcast threshold (static file statistics or,
with AQE, the runtime size of the shuffled side), and otherwise keeps a
sort-merge join whose hot ``prompt_id`` partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def prompt_features(prompts: DataFrame, feature: str = "prompt_text",
                    grams=(2, 3, 4), keep_text: bool = True) -> DataFrame:
    """Counts, stopword-free text and filtered n-grams of each prompt."""
    base = prompts.withColumn("_clean", T.clean(feature))
    cols = [F.col(c) for c in prompts.columns] if keep_text else [F.col("prompt_id")]
    out = base.select(
        *cols,
        T.word_cnt(feature).alias(f"{feature}_word_cnt"),
        T.char_len(feature).alias(f"{feature}_length"),
        T.stopword_cnt(feature).alias(f"{feature}_stopword_cnt"),
        T.punct_cnt(feature).alias(f"{feature}_punct_cnt"),
        T.distinct_words("_clean").alias(f"{feature}_different_word_cnt"),
        T.preprocess(feature).alias(f"{feature}_nostop"),
        T.word_tokens("_clean").alias("_tok"),
    )
    for n in grams:
        out = out.withColumn(f"{feature}_{n}grams", T.filter_edge_chars(T.ngrams("_tok", n)))
    return out.drop("_tok")


def response_counts(df: DataFrame, feature: str = "text", keep_clean: bool = False) -> DataFrame:
    """S4-S8 on the response text: words, chars, stopwords, marks, distinct words.

    The cleaned text is computed once as a column (``_clean``); pass
    ``keep_clean`` to let the n-gram step reuse it.
    """
    out = (df.withColumn("_clean", T.clean(feature))
              .withColumn(f"{feature}_word_cnt", T.word_cnt(feature))
              .withColumn(f"{feature}_length", T.char_len(feature))
              .withColumn(f"{feature}_stopword_cnt", T.stopword_cnt(feature))
              .withColumn(f"{feature}_punct_cnt", T.punct_cnt(feature))
              .withColumn(f"{feature}_different_word_cnt", T.distinct_words("_clean")))
    return out if keep_clean else out.drop("_clean")


def join_prompts(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """Inner equi-join of responses with (pre-featurised) prompts."""
    return responses.join(prompts, "prompt_id")


RATIO_PAIRS = [
    ("word_cnt", "word_ratio"),
    ("length", "length_ratio"),
    ("stopword_cnt", "stopword_ratio"),
    ("punct_cnt", "punct_ratio"),
    ("different_word_cnt", "different_word_ratio"),
]


def ratios(df: DataFrame, feature: str = "text", prompt: str = "prompt_text",
           drop_prompt_side: bool = True) -> DataFrame:
    """Response count / prompt count, 0 when the prompt count is 0."""
    out = df
    for cnt, name in RATIO_PAIRS:
        out = out.withColumn(f"{feature}_{name}", T.ratio(f"{feature}_{cnt}", f"{prompt}_{cnt}"))
    if drop_prompt_side:
        out = out.drop(*[f"{prompt}_{cnt}" for cnt, _ in RATIO_PAIRS])
    return out


def shared_ngrams(df: DataFrame, feature: str = "text", prompt: str = "prompt_text",
                  grams=(2, 3, 4)) -> DataFrame:
    """Distinct filtered n-grams shared by response and prompt, n = 2..4.

    The prompt's gram arrays arrive with the (broadcast-sized) prompt row, so
    the overlap is a per-row hash intersection; nothing is exploded or
    shuffled per gram.  The prompt's grams are filtered already, so a gram in
    both passes the filter: the response's grams need none of their own.
    """
    cleaned = F.col("_clean") if "_clean" in df.columns else T.clean(feature)
    out = df.withColumn("_tok", T.word_tokens(cleaned))
    for n in grams:
        out = out.withColumn(
            f"shared_{n}grams",
            T.shared_count(T.ngrams("_tok", n), f"{prompt}_{n}grams"))
    return out.drop("_tok", "_clean", *[f"{prompt}_{n}grams" for n in grams])
