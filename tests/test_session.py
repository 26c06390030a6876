"""Shared folder, written tables, and the operators that had caps."""

import pytest

from respscore import session


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.local_folder(master)
    assert session.local_folder("local[4]")


def test_tables_can_be_discarded(spark):
    table = session.cut_lineage(spark.range(5), "discarded")
    assert table.count() == 5
    session.discard(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_folder)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_long_words_keep_their_pieces(spark):
    from respscore.operators import subword
    words = spark.createDataFrame([("a" * 70,), ("aaa",), ("b",), ("a" * 20_000,), ("aab",), ("",)], "word string")
    vocab = spark.createDataFrame([("a",), ("##a",)], "piece string")
    assert {r["word"]: r["pieces"] for r in subword.segment_counts(words, vocab).collect()} == {
        "a" * 70: 70, "aaa": 3, "b": 1, "a" * 20_000: 20_000, "aab": 1, "": 0}


def test_correction_keeps_case_marks_and_digits(spark):
    from respscore.operators import vocab
    known = spark.createDataFrame([("house", 30), ("garden", 20)], "word string, freq long")
    texts = spark.createDataFrame([(1, "Hause, HOUZE & 12 gardn\nhouse? xyzzyx"), (2, "")], "id long, text string")
    got = {r["id"]: (r["corrected_text"], r["distance"]) for r in vocab.spell_correct(texts, "id", "text", known).collect()}
    assert got == {1: ("House, HOUSE & 12 garden\nhouse? xyzzyx", 3), 2: ("", 0)}


def test_streams_read_folder_tables(spark, tmp_path):
    from conftest import SF001
    from respscore.streaming import features_stream
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF001}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    assert features_stream.stream_basic_features(spark, str(tmp_path)).count() == 200
