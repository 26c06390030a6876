"""Column -> Column text expressions.

Everything here is a built-in Spark expression (regexp, split, higher-order
array functions), so it runs inside whole-stage code generation with no Python
on the executors.  Functions that feed several later expressions (tokens,
cleaned text) should be materialised as a column first; Catalyst then keeps
them as one evaluation per row instead of re-running them inside lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stopwords import ENGLISH_STOPWORDS, ONE_LETTER_STOPWORDS

# fixed values: the 32 ASCII punctuation marks (Python's string.punctuation)
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"
# fixed values: characters kept by the cleaner; everything else becomes a space
KEEP_CLASS = r"[^A-Za-z0-9']"
# fixed values: a term of the TF-IDF vectorizer (two or more word characters)
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
# fixed values: a token of the language tokenizer stand-in (word run or one mark)
TOKEN_PATTERN = r"\w+|[^\w\s]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(text, lower: bool = False) -> Column:
    """Keep [A-Za-z0-9'], every other run of characters -> one space, trim."""
    # a run of dropped characters (spaces included) becomes one space: one pass
    t = F.trim(F.regexp_replace(_c(text), KEEP_CLASS + "+", " "))
    return F.lower(t) if lower else t


def remove_stopwords(cleaned, stopwords=ENGLISH_STOPWORDS) -> Column:
    """Drop stopwords from an already cleaned, lower-cased text."""
    words = F.split(_c(cleaned), " ")
    kept = F.filter(words, lambda w: (w != F.lit("")) & ~w.isin(list(stopwords)))
    return F.array_join(kept, " ")


def preprocess(text, stopwords=ENGLISH_STOPWORDS) -> Column:
    """pre(text, removal=True): clean, lower-case, drop stopwords."""
    return remove_stopwords(clean(text, lower=True), stopwords)


def word_cnt(text) -> Column:
    """Pieces of a split on single spaces (double spaces give empty pieces)."""
    return F.size(F.split(_c(text), " ")).cast("long")


def char_len(text) -> Column:
    """Length in code points."""
    return F.length(_c(text)).cast("long")


def whitespace_words(text) -> Column:
    """Split on runs of white space, empty pieces dropped."""
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != F.lit(""))


def stopword_cnt(text, stopwords=ENGLISH_STOPWORDS) -> Column:
    """White-space words whose lower case is a stopword."""
    words = F.split(_c(text), r"\s+")
    return F.size(F.filter(words, lambda w: F.lower(w).isin(list(stopwords)))).cast("long")


def punct_cnt(text) -> Column:
    """Number of ASCII punctuation marks."""
    return F.regexp_count(_c(text), F.lit(PUNCT_CLASS)).cast("long")


def distinct_words(cleaned) -> Column:
    """Distinct pieces of a split on single spaces; '' counts as one piece."""
    return F.size(F.array_distinct(F.split(_c(cleaned), " "))).cast("long")


def token_cnt(text) -> Column:
    """Tokens of the tokenizer stand-in: word runs and single marks."""
    return F.size(F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), 0)).cast("long")


def word_tokens(cleaned) -> Column:
    """Word tokenizer over cleaned text.

    Cleaned text only holds letters, digits, apostrophes and single spaces, so
    the treebank rules that matter are the clitic splits (``don't`` ->
    ``do n't``, ``it's`` -> ``it 's``) and the fused forms (``cannot`` ->
    ``can not``).
    """
    # Each pass reads the previous result once, so the cleaned text is
    # evaluated once per row (no repeated sub-expressions).
    t = F.concat(F.lit(" "), _c(cleaned), F.lit(" "))
    # fixed values: fused forms split by the treebank tokenizer
    # (cannot, gimme, gonna, gotta, lemme, wanna -> two tokens)
    t = F.regexp_replace(t, r"(?i)\b(can(?=not\b)|gim(?=me\b)|gon(?=na\b)|got(?=ta\b)|lem(?=me\b)|wan(?=na\s))",
                         "$1 ")
    # fixed values: clitics split off the end of a word
    t = F.regexp_replace(t, r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T|'[sSmMdD]|') ", "$1 $2 ")
    return F.filter(F.split(t, " "), lambda w: w != F.lit(""))


def ngrams(tokens, n: int) -> Column:
    """Word n-grams joined by a space; fewer than n tokens -> [].

    Built from n shifted slices combined pairwise with ``zip_with`` (linear in
    the token count; no per-element re-slicing).
    """
    t = _c(tokens)
    m = F.size(t) - n + 1
    g = F.slice(t, 1, m)
    for k in range(1, n):
        g = F.zip_with(g, F.slice(t, k + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(t) >= n, g).otherwise(F.array().cast("array<string>"))


def filter_edge_chars(grams, one_letter=ONE_LETTER_STOPWORDS) -> Column:
    """N4 (as written): drop a gram only if its first *and* last character are
    one-letter stopwords."""
    one = list(one_letter)
    return F.filter(_c(grams), lambda x: ~(F.substring(x, 1, 1).isin(one)
                                           & F.substring(x, -1, 1).isin(one)))


def filter_edge_tokens(grams, stopwords=ENGLISH_STOPWORDS) -> Column:
    """N5 (as documented): drop a gram whose first or last word is a stopword."""
    sw = list(stopwords)
    return F.filter(_c(grams), lambda x: ~(F.lower(F.substring_index(x, " ", 1)).isin(sw)
                                           | F.lower(F.substring_index(x, " ", -1)).isin(sw)))


def shared_count(a, b) -> Column:
    """Size of the set intersection of two arrays."""
    return F.size(F.array_intersect(_c(a), _c(b))).cast("long")


def terms(text) -> Column:
    """T2 analyzer: lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TERM_PATTERN), 0)


def model_input(cols, cls: str = "[CLS]", sep: str = "[SEP]") -> Column:
    """``[CLS] a [SEP] b [SEP]``."""
    return F.concat(F.lit(cls + " "), F.concat_ws(f" {sep} ", *[_c(c) for c in cols]),
                    F.lit(f" {sep}"))


def ratio(a, b) -> Column:
    """A / b as double, 0 where b is 0 (the original's inf/NaN -> 0)."""
    return F.coalesce(F.try_divide(_c(a).cast("double"), _c(b).cast("double")), F.lit(0.0))


# fixed values: rule-based entity patterns (the stand-in for a trained recogniser)
CAPS_RUN = r"[A-Z][a-z]+( [A-Z][a-z]+)*"
CAPS_AT_START = r"(^|[.!?]\s+)[A-Z][a-z]+"
NUMBER_RUN = r"[0-9]+([.,][0-9]+)*"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"
URL = r"https?://[^\s]+"


def entity_cnt(text) -> Column:
    """S12 (re-aimed): capitalised word runs not opening a sentence, numbers,
    e-mail addresses and URLs."""
    t = _c(text)
    n = lambda p: F.size(F.regexp_extract_all(t, F.lit(p), 0))
    return (n(CAPS_RUN) - n(CAPS_AT_START) + n(NUMBER_RUN) + n(EMAIL) + n(URL)).cast("long")
