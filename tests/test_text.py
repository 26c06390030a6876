"""Text functions against values worked out by hand, and counts over documents."""

import string

import pytest
from pyspark.sql import functions as F

from respscore.functions import text as T


def one(spark, text, col):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text,words,chars,distinct", [
    ("", 1, 0, 1),              # empty text: one empty piece
    ("a  b", 3, 4, 2),          # double space gives an empty piece
    ("a\nb", 1, 3, 2),          # newline does not split on ' '
    ("!?,", 1, 3, 1),           # only marks
    ("The the", 2, 7, 2),       # case-sensitive distinct words
])
def test_counts(spark, text, words, chars, distinct):
    assert one(spark, text, T.word_cnt("text")) == words
    assert one(spark, text, T.char_len("text")) == chars
    assert one(spark, text, T.distinct_words(T.clean("text"))) == distinct


def test_stopwords_and_marks(spark):
    assert one(spark, "a\nb", T.stopword_cnt("text")) == 1          # 'a' after a newline split
    assert one(spark, "The cat. IS here!", T.stopword_cnt("text")) == 2   # "here!" keeps its mark
    assert one(spark, "!?,", T.punct_cnt("text")) == 3
    assert one(spark, "don’t", T.clean("text")) == "don t"     # curly apostrophe is dropped
    assert one(spark, "don't", T.clean("text")) == "don't"


def test_tokenizer_clitics(spark):
    toks = one(spark, "don't it's they'll cannot gonna", T.word_tokens(F.col("text")))
    assert toks == ["do", "n't", "it", "'s", "they", "'ll", "can", "not", "gon", "na"]


def test_ngrams_and_filters(spark):
    df = spark.createDataFrame([("a s",), ("a big s",), ("i run",), ("the dog",), ("the cat",)], "text string")
    rows = df.select("text", T.ngrams(T.word_tokens("text"), 2).alias("g2"),
                     T.ngrams(T.word_tokens("text"), 3).alias("g3")).collect()
    by = {r["text"]: r for r in rows}
    assert by["a s"]["g2"] == ["a s"] and by["a s"]["g3"] == []
    keep = lambda g, f: one(spark, "", f(F.array(*[F.lit(x) for x in g])))
    assert keep(["a s"], T.filter_edge_chars) == []
    assert keep(["a big s"], T.filter_edge_chars) == []
    assert keep(["i run"], T.filter_edge_chars) == ["i run"]
    assert keep(["the dog"], T.filter_edge_chars) == ["the dog"]
    assert keep(["the dog"], T.filter_edge_tokens) == []
    assert keep(["the cat"], T.filter_edge_chars) == []


@pytest.mark.parametrize("text,clean,prepared", [
    ("The cat's\nhat -- 3 Times!", "The cat's hat 3 Times", "cat's hat 3 times"),
    ("  (a) b_c\r\nD.E ", "a b c D E", "b c d e"),
    ("Ünder the blue sky", "nder the blue sky", "nder blue sky"),
    ("", "", ""),
])
def test_clean_and_prepare(spark, text, clean, prepared):
    assert one(spark, text, T.clean("text")) == clean
    assert one(spark, text, T.preprocess("text")) == prepared


def test_counts_on_documents(spark):
    from conftest import SF001
    from respscore.sources import fixtures as FX
    kept = set(string.ascii_letters + string.digits + "'")
    rows = FX.responses(spark, SF001).select(
        "text", T.clean("text").alias("c"), T.word_cnt("text").alias("w"), T.punct_cnt("text").alias("pc")).collect()
    for r in rows:
        words, now = [], ""
        for ch in r["text"] + " ":  # runs of kept characters
            if ch in kept:
                now += ch
            elif now:
                words.append(now)
                now = ""
        assert r["c"].split() == words
        assert r["w"] == r["text"].count(" ") + 1
        assert r["pc"] == sum(r["text"].count(ch) for ch in string.punctuation)
