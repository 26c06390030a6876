"""Fixture views over the given tables (see FIXTURES.md).

Each view reads only the columns it needs, so the parquet scan prunes columns
and any later filter reaches the scan.  The SQL text of the same views is kept
in ``SQL`` for the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Session setting: "true" deals the documents out by id before any text work.
SPREAD = "spark.respscore.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-distribute rows by ``key`` if the session asks for it (``SPREAD``), else leave them as scanned.

    A table that arrives as thousands of splits needs no shuffle.  For one stored as a few large row groups, whose row-local
    text work would run in a few tasks, the setting deals the rows out by the key that later aggregates use.
    """
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(key)


def prompt_of(spark, sf_dir, doc_id: str = "doc_id") -> Column:
    """The prompt that a document answers: documents are dealt out over all prompts of the prompt table in turn."""
    return F.try_mod(F.col(doc_id), table(spark, sf_dir, "benchmark").agg(F.count("*")).scalar())


def responses(spark, sf_dir) -> DataFrame:
    """response_id, prompt_id, text, lang, source."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return d.select(F.col("doc_id").alias("response_id"),
                    prompt_of(spark, sf_dir).alias("prompt_id"),
                    "text", "lang", "source")


def prompts(spark, sf_dir) -> DataFrame:
    """prompt_id, prompt_text, prompt_title, prompt_question."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("prompt_id"),
                    F.col("text").alias("prompt_text"),
                    F.regexp_extract("text", r"^[^ ]+( [^ ]+){0,2}", 0).alias("prompt_title"),
                    F.regexp_extract("text", r"^[^.]*[.]?", 0).alias("prompt_question"))


def scores(spark, sf_dir) -> DataFrame:
    """response_id, content, wording (labelled responses only)."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("doc_id").alias("response_id"),
                      F.col("quality").cast("double").alias("content"),
                      F.col("toxic").cast("double").alias("wording"))


def pairs(spark, sf_dir) -> DataFrame:
    """conv_id, turn, text, prompt_text: assistant turn with latest earlier user turn."""
    from ..operators.ranking import running
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # latest earlier user turn = running max before the turn
    a = running(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "max", "uturn",
                inclusive=False).where(F.col("role") == "assistant")
    u = c.where(F.col("role") == "user").select("conv_id", F.col("turn").alias("uturn"),
                                                F.col("text").alias("prompt_text"))
    return a.join(u, ["conv_id", "uturn"]).select("conv_id", "turn", "text", "prompt_text")


def loss_log(spark, sf_dir) -> DataFrame:
    """run_id, step, loss, train_loss: ordered loss series per run."""
    from ..operators.ranking import rank_within
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    r = rank_within(e, group=["user_id"], order=["ts", "event_id"], out="step")
    return r.select(F.col("user_id").alias("run_id"), "step",
                    F.col("value").alias("loss"),
                    (F.col("event_id") % 20).cast("double").alias("train_loss"))


def token_vectors(spark, sf_dir) -> DataFrame:
    """seq_id, pos, mask, embedding: runs of ten vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 10).cast("long").alias("seq_id"),
                    (F.col("vec_id") % 10).alias("pos"),
                    F.when(F.col("label") % 5 == 0, 0).otherwise(1).alias("mask"),
                    "embedding")


def predictions(spark, sf_dir) -> DataFrame:
    """response_id, p_content, p_wording: fixed predictions, no model needed."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.select(F.col("doc_id").alias("response_id"),
                    (F.lit(0.5) + (F.col("doc_id") % 7).cast("double") / 20.0).alias("p_content"),
                    ((F.col("doc_id") % 5).cast("double") / 10.0).alias("p_wording"))


def dictionary(spark, sf_dir, min_freq: int = 20) -> DataFrame:
    """word, freq: lower-cased [a-z]+ words of English documents, freq >= min_freq.

    Word frequencies are a partial (map-side) aggregate, so a hot word costs
    one row per task before the shuffle.
    """
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    d = d.where(F.col("lang") == "en").select("text")
    words = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word"))
    return (words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
                 .where(F.col("freq") >= min_freq))


def gazetteer(spark, sf_dir) -> DataFrame:
    """phrase, label: titles, openings and first sentences of the prompts, and the names of nations and regions."""
    p = prompts(spark, sf_dir)
    opening = F.regexp_extract("prompt_text", r"^[^ ]+( [^ ]+)?", 0)
    parts = [p.select(F.col("prompt_title").alias("phrase"), F.lit("title").alias("label")), p.select(opening, F.lit("opening")),
             p.select("prompt_question", F.lit("sentence")), table(spark, sf_dir, "nation").select("n_name", F.lit("nation")),
             table(spark, sf_dir, "region").select("r_name", F.lit("region"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def word_pairs(spark, sf_dir, min_freq: int = 2) -> DataFrame:
    """first, second, freq: neighbouring [a-z]+ words of English documents."""
    from ..operators.compound import word_pairs as pairs_of
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return pairs_of(d.where(F.col("lang") == "en"), "text", min_freq)


# ---------------------------------------------------------------- SQL text
SQL = {
    "responses": "SELECT doc_id AS response_id, doc_id % (SELECT count(*) FROM benchmark) AS prompt_id, text, lang, source FROM documents",
    "prompts": (
        "SELECT item_id AS prompt_id, text AS prompt_text, "
        "regexp_extract(text, '^[^ ]+( [^ ]+){0,2}', 0) AS prompt_title, "
        "regexp_extract(text, '^[^.]*[.]?', 0) AS prompt_question FROM benchmark"),
    "scores": ("SELECT doc_id AS response_id, CAST(quality AS DOUBLE) AS content, "
               "CAST(toxic AS DOUBLE) AS wording FROM labels"),
    "pairs": (
        "SELECT a.conv_id, a.turn, a.text, u.text AS prompt_text FROM ("
        " SELECT *, max(CASE WHEN role = 'user' THEN turn END) OVER ("
        "  PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS uturn"
        " FROM conversations) a "
        "JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.uturn AND u.role = 'user' "
        "WHERE a.role = 'assistant'"),
    "loss_log": (
        "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, "
        "value AS loss, CAST(event_id % 20 AS DOUBLE) AS train_loss FROM events"),
    "token_vectors": (
        "SELECT CAST(floor(vec_id / 10) AS BIGINT) AS seq_id, vec_id % 10 AS pos, "
        "CASE WHEN label % 5 = 0 THEN 0 ELSE 1 END AS mask, embedding FROM embeddings"),
    "predictions": (
        "SELECT doc_id AS response_id, 0.5 + (doc_id % 7) / CAST(20 AS DOUBLE) AS p_content, "
        "(doc_id % 5) / CAST(10 AS DOUBLE) AS p_wording FROM documents"),
    "dictionary": (
        "SELECT word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word "
        "FROM documents WHERE lang = 'en') GROUP BY word HAVING count(*) >= 20"),
    "gazetteer": (
        "SELECT prompt_title AS phrase, 'title' AS label FROM prompts UNION ALL "
        "SELECT regexp_extract(prompt_text, '^[^ ]+( [^ ]+)?', 0), 'opening' FROM prompts UNION ALL "
        "SELECT prompt_question, 'sentence' FROM prompts UNION ALL SELECT n_name, 'nation' FROM nation UNION ALL SELECT r_name, 'region' FROM region"),
    "word_pairs": (
        "SELECT first, second, count(*) AS freq FROM (SELECT unnest(a[:-2]) AS first, unnest(a[2:]) AS second FROM ("
        "SELECT regexp_extract_all(lower(text), '[a-z]+') AS a FROM documents WHERE lang = 'en') WHERE len(a) > 1) "
        "GROUP BY first, second HAVING count(*) >= 2"),
}


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` prefix for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"
