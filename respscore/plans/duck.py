"""DuckDB SQL fragments that restate the Column functions for the oracles.

Only used to build ``oracle_sql()`` strings; nothing here runs on Spark.
"""

from __future__ import annotations

from ..functions.stopwords import ENGLISH_STOPWORDS, ONE_LETTER_STOPWORDS, sql_list

STOP = sql_list(ENGLISH_STOPWORDS)
ONE = sql_list(ONE_LETTER_STOPWORDS)
PUNCT = r"[!-/:-@\[-`{-~]"
NUMBER = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|nan|inf|infinity)$"


def clean(t: str, lower: bool = False) -> str:
    e = f"trim(regexp_replace(regexp_replace({t}, '[^A-Za-z0-9'']', ' ', 'g'), ' +', ' ', 'g'))"
    return f"lower({e})" if lower else e


def remove_stopwords(c: str) -> str:
    return (f"array_to_string(list_filter(string_split({c}, ' '), "
            f"lambda w: w <> '' AND w NOT IN {STOP}), ' ')")


def preprocess(t: str) -> str:
    return remove_stopwords(clean(t, lower=True))


def word_cnt(t: str) -> str:
    return f"CAST(len(string_split({t}, ' ')) AS BIGINT)"


def char_len(t: str) -> str:
    return f"CAST(length({t}) AS BIGINT)"


def stopword_cnt(t: str) -> str:
    return (f"CAST(len(list_filter(regexp_split_to_array({t}, '\\s+'), "
            f"lambda w: lower(w) IN {STOP})) AS BIGINT)")


def punct_cnt(t: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '{PUNCT}')) AS BIGINT)"


def distinct_words(c: str) -> str:
    return f"CAST(len(list_distinct(string_split({c}, ' '))) AS BIGINT)"


def token_cnt(t: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, '\\w+|[^\\w\\s]')) AS BIGINT)"


def word_tokens(c: str) -> str:
    t = f"(' ' || {c} || ' ')"
    for pat, rep in [(r"(?i)\b(can)(not)\b", r"\1 \2"), (r"(?i)\b(gim)(me)\b", r"\1 \2"),
                     (r"(?i)\b(gon)(na)\b", r"\1 \2"), (r"(?i)\b(got)(ta)\b", r"\1 \2"),
                     (r"(?i)\b(lem)(me)\b", r"\1 \2"), (r"(?i)\b(wan)(na)(\s)", r"\1 \2\3"),
                     (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
                     (r"([^' ])('[sSmMdD]|') ", r"\1 \2 ")]:
        t = f"regexp_replace({t}, '{pat.replace(chr(39), chr(39) * 2)}', '{rep}', 'g')"
    t = f"trim(regexp_replace({t}, ' +', ' ', 'g'))"
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def ngrams(tok: str, n: int) -> str:
    return (f"list_transform(range(1, len({tok}) - {n} + 2), "
            f"lambda i: array_to_string({tok}[i:i + {n - 1}], ' '))")


def filter_edge_chars(g: str) -> str:
    return f"list_filter({g}, lambda x: NOT (left(x, 1) IN {ONE} AND right(x, 1) IN {ONE}))"


def filter_edge_tokens(g: str) -> str:
    return (f"list_filter({g}, lambda x: NOT (lower(split_part(x, ' ', 1)) IN {STOP} "
            f"OR lower(string_split(x, ' ')[-1]) IN {STOP}))")


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN CAST({b} AS DOUBLE) = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"


def terms(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def entity_cnt(t: str) -> str:
    from ..functions import text as T
    n = lambda p: f"len(regexp_extract_all({t}, '{p}'))"
    return (f"CAST({n(T.CAPS_RUN)} - {n(T.CAPS_AT_START)} + {n(T.NUMBER_RUN)} + {n(T.EMAIL)} + {n(T.URL)} "
            f"AS BIGINT)")
