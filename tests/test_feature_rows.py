"""Counts made in a text's row next to the expressions and aggregates that say the same."""

import random

import pytest

from respscore.operators import presence, ranking, vocab
from respscore.operators import tfidf as TF
from respscore.plans import feature_table as FT

ODD = ["", None, " ", "a", "!", "a  b", "don't can't CANNOT cannot gonna wanna go'", "it's 'quoted' o'clock '", "Kelvin İstanbul ΟΔΟΣ",
       "1.5 12 1_0 +nan nan inf 3e5 12  x ", "café naïve über!", "tab\tand\nline\r\x0bvt\x0cff\x1cfs\x85nel nbsp", "The THE the ... ?!", "word " * 40]
WORDS = ["alpha", "beta", "Gamma", "the", "of", "it's", "don't", "delta,", "42", "été", "zeta-eta", "theta", "longestwordofall"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(40)]
    rows = [(i, rng.choice([0, 1, 2, 7, None]), t) for i, t in enumerate(texts)] + [(None, 1, "alpha beta"), (-50, 1, "beta gamma the")]
    prompts = [(0, "The alpha beta gamma, don't you? It's 42 cannot delta", "The alpha", "The alpha beta?"), (1, None, None, None), (2, "", "", ""),
               (3, "nobody answers", "nobody", "nobody")]
    return (spark.createDataFrame(rows, "response_id long, prompt_id long, text string").repartition(3),
            spark.createDataFrame(prompts, "prompt_id long, prompt_text string, prompt_title string, prompt_question string"),
            spark.createDataFrame([("alpha", 30), ("beta", 20), ("theta", 20), ("the", 90)], "word string, freq long"))


def rounded(df):
    return sorted(([round(x, 6) if isinstance(x, float) else x for x in r] for r in df.collect()), key=repr)


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_rows_equal_aggregates(spark, tables, monkeypatch, bits):
    """Also with a sketch that takes most words for known ones, and in blocks of few terms."""
    want = rounded(FT._by_aggregates(*tables))
    monkeypatch.setattr(presence, "BITS", bits)
    monkeypatch.setattr(TF, "BLOCK_TERMS", 100)
    monkeypatch.setattr(vocab, "misspelled_cnt", None)  # no row for each word, nor for each term
    monkeypatch.setattr(TF, "gram_table", None)
    assert rounded(FT.raw_features(*tables)) == want and len(want) > 20


def test_repeated_ids_meet_in_aggregates(spark, tables, monkeypatch):
    responses, prompts, dictionary = tables
    twice = responses.unionByName(responses.where("response_id = 3"))
    assert ranking.by_repeated_key(twice, "response_id")[1] is not None
    assert rounded(FT.raw_features(twice, prompts, dictionary)) == rounded(FT._by_aggregates(twice, prompts, dictionary))
    more = prompts.unionByName(prompts.where("prompt_id = 0"))
    assert rounded(FT.raw_features(responses, more, dictionary)) == rounded(FT._by_aggregates(responses, more, dictionary))


def test_no_known_words(spark, tables):
    responses, prompts, dictionary = tables
    none = dictionary.limit(0), prompts.where("prompt_id > 0 and prompt_id < 3")
    assert rounded(FT.raw_features(responses, none[1], none[0])) == rounded(FT._by_aggregates(responses, none[1], none[0]))
