"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps the measurements and one failure
bit for each rule; policies are versioned masks over these bits, so a new policy or an ablation is
bit arithmetic on the ledger and never reads a text again.

Defined results: null and empty texts have no words, so all measurements are 0 and the rule
``few_words`` fails; texts are measured whole, however long; repeated rows and rows with a null
``doc_id`` each get their own row; an empty table gives an empty ledger; columns other than
``doc_id`` and ``text`` are left out, so their names cannot clash.
"""

from __future__ import annotations


from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respscore.llm.common import arrow_rows, id_text, small_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper")

#: Rule name -> SQL condition under which a document fails it; the position is the bit.  Bits are
#: never reused: a changed rule gets a new name and the next bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "upper_case": "n_letters > 0 and 100 * n_upper > 50 * n_letters",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}

#: Policy and version -> rules that reject.
POLICIES = {
    ("base", 1): ("few_words", "repeated_words"),
    ("web", 1): ("few_words", "repeated_words", "symbols", "dup_lines"),
    ("web", 2): ("few_words", "repeated_words", "symbols", "dup_lines", "upper_case", "word_length"),
}


def _symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, b"#*$%&|<>"))


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES; bytes.split() splits at ASCII white space."""
    words = text.split()
    lines = Counter(x for x in text.split(b"\n") if x and not x.isspace())
    n_lines = sum(lines.values())
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(windows) < len(words) - 2:
        covered = -1  # the last position that counts already
        for i, w in enumerate(zip(words, words[1:], words[2:])):
            if windows[w] > 1:
                repeated += i + 2 - max(covered, i - 1)
                covered = i + 2
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = upper + len(text) - len(text.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return len(words), chars, _symbols(text), n_lines, n_lines - len(lines), repeated, letters, upper


def _measured(batches):
    for batch in small_batches(batches):
        ids, found = [], []
        for doc_id, text in arrow_rows(batch, "doc_id", "text"):
            ids.append(doc_id)
            found.append(measure(text))
        columns = zip(*found) if found else [[] for _ in MEASURES]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns)],
                                         names=["doc_id", *MEASURES])


def mask_of(rules) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame) -> DataFrame:
    """One row for each document: measurements and ``fail_bits``; one pass, no shuffle."""
    measured = id_text(docs).mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: str, version: int) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy, version]))) == 0


def ablations(rows: DataFrame) -> DataFrame:
    """For each policy and each of its rules: documents rejected, by this rule, and by this rule alone.

    The ledger is first counted by bitmask (at most 2 ** rules rows, summed on the map side);
    everything else is bit arithmetic on that table.
    """
    masks = rows.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(v).alias("version"), F.lit(r).alias("rule"),
                               F.lit(mask_of(rules)).cast("long").alias("mask"), F.lit(mask_of([r])).cast("long").alias("bit"))
                      for (p, v), rules in POLICIES.items() for r in rules))
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    count = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    return (masks.select("fail_bits", "n", F.inline(cases)).groupBy("policy", "version", "rule")
            .agg(count(failed != 0).alias("n_rejected"), count(failed.bitwiseAND(F.col("bit")) != 0).alias("n_by_rule"),
                 count(failed == F.col("bit")).alias("n_only_by_rule")))


def op1_rule_ledger(spark, sf_dir: str) -> DataFrame:
    """The ledger with the verdicts of the policies base 1 and web 2."""
    return ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes("base", 1)).alias("base_failed"), passes("web", 2).alias("kept"),
        "n_lines", "n_letters", "n_upper", "fail_bits")


_BITS = " | ".join(f"(CASE WHEN {rule} THEN {1 << i} ELSE 0 END)" for i, rule in enumerate(RULES.values()))

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
w AS (SELECT r, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM t),
g AS (SELECT r, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i FROM g WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) AS s(k) GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
n AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
      length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))::BIGINT AS n_letters,
      length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper
      FROM t LEFT JOIN n USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & {mask_of(POLICIES["base", 1])} <> 0 AS base_failed, fail_bits & {mask_of(POLICIES["web", 2])} = 0 AS kept,
       n_lines, n_letters, n_upper, fail_bits FROM b
"""
