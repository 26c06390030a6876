"""Compound correction, gazetteer entities and the lemma relation on hand cases."""

import pytest

from respscore.operators import compound, gazetteer, vocab

KNOWN = [("house", 90), ("garden", 80), ("the", 500), ("green", 70), ("great", 60), ("in", 300), ("to", 200), ("together", 40), ("bar", 30), ("car", 30), ("gardens", 5)]
PAIRS = [("the", "house", 50), ("in", "the", 40), ("great", "garden", 9), ("red", "car", 7), ("car", "park", 3)]


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.createDataFrame(KNOWN, "word string, freq long"),
            spark.createDataFrame(PAIRS, "first string, second string, freq long"))


@pytest.mark.parametrize("text, corrected, distance", [
    ("the house", "the house", 0),
    ("thehouse in thegarden", "the house in the garden", 2),          # splits
    ("THEHOUSE Thehouse", "THE HOUSE The house", 2),                  # their casing
    ("hou se, gar den", "house, garden", 2),                          # merges; the comma stays
    ("Hou se HOU SE", "House HOUSE", 2),                              # their casing
    ("gard-enxyzxyz gard enxyzxyz", "garden-enxyzxyz garden enxyzxyz", 4),
    ("to gether", "together", 1),
    ("gardeen  12\tgreeen!", "garden  12\tgreen!", 2),                # single words, all else as it was
    ("gerat", "great", 2),
    ("zzzzzzzz qqqqqqqq", "zzzzzzzz qqqqqqqq", 0),                    # nothing near
    ("the par", "the bar", 1),                                        # equally near: bar before car
    ("red par park", "red car park", 1),                              # but its neighbours say car
    ("\n 12 hous", "\n 12 house", 1),
    ("", "", 0), (None, "", 0), ("123 !?", "123 !?", 0),
])
def test_compound_hand_cases(spark, tables, text, corrected, distance):
    dictionary, pairs = tables
    known = dictionary.union(spark.createDataFrame([("red", 20), ("park", 20)], "word string, freq long"))
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    got = compound.compound_correct(rows, "id", "text", known, pairs).first()
    assert (got["corrected_text"], got["distance"]) == (corrected, distance)


def test_compound_run_of_merges_takes_every_other(spark):
    dictionary = spark.createDataFrame([("abab", 9), ("zzzzzzzzzzzz", 9)], "word string, freq long")
    pairs = spark.createDataFrame([], "first string, second string, freq long")
    rows = spark.createDataFrame([(1, "ab ab ab ab ab"), (2, "ab ab")], "id long, text string")
    got = {r["id"]: r["corrected_text"] for r in compound.compound_correct(rows, "id", "text", dictionary, pairs).collect()}
    assert got == {1: "abab abab abab", 2: "abab"}  # the last ab, alone, is two edits from abab


def test_word_pairs(spark):
    rows = spark.createDataFrame([("The red car, the red bus",), ("THE RED",), ("one",), ("",), (None,)], "text string")
    got = {(r["first"], r["second"]): r["freq"] for r in compound.word_pairs(rows, "text", 2).collect()}
    assert got == {("the", "red"): 3}


PHRASES = [("New York", "place"), ("new york city", "place"), ("York City Hall", "place"), ("city hall square", "place"), ("hall", "room"),
           ("  ", "none"), ("Old   Town", "b"), ("old town", "a"), ("a b c", "x"), ("b c d e", "x"), ("d e f", "x"), ("été", "season")]


@pytest.mark.parametrize("text, entities", [
    ("in NEW-YORK, there", "place:new york"),
    ("new york city hall square", "place:new york city|room:hall"),   # longest at the leftmost place; what overlaps it goes
    ("york city hall", "place:york city hall"),
    ("old town hall", "a:old town|room:hall"),                         # one label for one phrase
    ("a b c d e f", "x:a b c|x:d e f"),                                # b c d e overlaps the first, and d e f stands again
    ("ÉTÉ halls", "season:été"),
    ("hall hall", "room:hall|room:hall"), ("", ""), (None, ""), ("nothing here", ""),
])
def test_gazetteer_hand_cases(spark, text, entities):
    names = spark.createDataFrame(PHRASES, "phrase string, label string")
    got = gazetteer.gazetteer_entities(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text", names).first()
    assert (got["entities"], got["entity_cnt"]) == (entities, len(entities.split("|")) if entities else 0)


def test_gazetteer_without_phrases(spark):
    names = spark.createDataFrame([], "phrase string, label string")
    rows = spark.createDataFrame([(1, "some text")], "id long, text string")
    assert [tuple(r) for r in gazetteer.gazetteer_entities(rows, "id", "text", names).collect()] == [(1, 0, "")]


def test_lemma_relation(spark):
    dictionary = spark.createDataFrame([("dog", 50), ("dogs", 20), ("new", 5), ("news", 90), ("box", 9), ("boxes", 4), ("bus", 8), ("city", 7), ("child", 3),
                                        ("woman", 4), ("as", 900), ("a", 1000), ("classe", 1), ("class", 9)], "word string, freq long")
    words = ["dogs", "dog", "news", "boxes", "buses", "cities", "men", "feet", "children", "women", "firemen", "zebras", "as", "classes"]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r["form"]: (r["lemma"], r["kind"]) for r in vocab.lemma_table(rows, dictionary, vocab.exceptions_table(spark)).collect()}
    assert got == {"dogs": ("dog", "rule"), "dog": ("dog", "itself"), "news": ("news", "itself"),  # far more frequent than "new"
                   "boxes": ("box", "rule"), "buses": ("bus", "rule"), "cities": ("city", "rule"), "men": ("man", "exception"),
                   "feet": ("foot", "exception"), "children": ("child", "exception"), "women": ("woman", "exception"), "firemen": ("firemen", "itself"),
                   "zebras": ("zebras", "itself"), "as": ("a", "rule"), "classes": ("class", "rule")}
    texts = spark.createDataFrame([(1, "dogs chase children"), (2, "")], "id long, t string")
    out = vocab.lemmatize_by_table(texts, "id", "t", dictionary, vocab.exceptions_table(spark)).collect()
    assert {r["id"]: r["lemmatized"] for r in out} == {1: "dog chase child", 2: ""}
