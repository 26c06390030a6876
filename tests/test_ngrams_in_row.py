"""N-grams are counted inside a text's row: no gram is shuffled, and rows that share a key count as one text."""

import contextlib
import io

from pyspark.sql import functions as F

from respscore.operators import ngrams as NG

ROWS = [(1, 7, "a b a b a"), (2, 7, "a"), (3, 8, None), (4, 8, ""), (None, 8, "x y"), (5, 9, "b c b"), (5, 9, "b c d")]


def _rows(spark, rows):
    return spark.createDataFrame(rows, "k long, p long, t string").withColumn("tok", F.split("t", " "))


def test_no_exchange_of_grams(spark):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        NG.gram_table(_rows(spark, ROWS[:5]), "k", "tok", extra=("p",)).explain()
    assert "Exchange" not in buf.getvalue()


def test_counts_ranks_and_shared_keys(spark):
    got = {(r["k"], r["p"], r["n"], r["gram"], r["cnt"], r["rank"]) for r in NG.gram_table(_rows(spark, ROWS), "k", "tok", ns=(2, 3), extra=("p",)).collect()}
    assert {g for g in got if g[0] != 5} == {(1, 7, 2, "a b", 2, 1), (1, 7, 2, "b a", 2, 2), (1, 7, 3, "a b a", 2, 1), (1, 7, 3, "b a b", 1, 2), (None, 8, 2, "x y", 1, 1)}
    assert {(g[2:5]) for g in got if g[0] == 5} == {(2, "b c", 2), (2, "c b", 1), (2, "c d", 1), (3, "b c b", 1), (3, "b c d", 1)}


def test_aligned_texts_equals_the_join(spark):
    rows = [(1, "a b a b", "a b a c"), (2, "x y z", "x y z"), (3, None, "a b"), (4, "a b", "c d"), (5, "a b", "a b"), (5, "a b", "q r")]
    df = spark.createDataFrame(rows, "k long, a string, b string").select("k", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    joined = NG.aligned_overlap(NG.merged_gram_table(df.where("k < 5"), "k", "a"), NG.merged_gram_table(df.where("k < 5"), "k", "b"), "k", "k", on=("k",))
    got = [tuple(r) for r in NG.aligned_texts(df, "k", "a", "b").collect()]
    assert sorted(g for g in got if g[0] < 5) == sorted(tuple(r) for r in joined.collect())
    assert (1, 2, 3) in got and (2, 3, 1) in got and (5, 2, 2) in got


def test_term_counts_are_not_shuffled(spark, monkeypatch):
    from respscore.operators import tfidf
    plans, cut = {}, tfidf.cut_lineage

    def noted(df, name="stage"):
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
        plans[name] = buf.getvalue()
        return cut(df, name)

    monkeypatch.setattr(tfidf, "cut_lineage", noted)
    corpus = spark.createDataFrame([(1, 1, "aa bb aa"), (1, 2, None), (1, -4, "bb cc")], "prompt_id long, doc_id long, text string")
    weights, _ = tfidf.tfidf_parts(corpus)
    assert {(r["doc_id"], r["term"], r["tf"]) for r in weights.collect()} == {(1, "aa", 2), (1, "bb", 1), (-4, "bb", 1), (-4, "cc", 1)}
    assert "Exchange" not in plans["tf"]
