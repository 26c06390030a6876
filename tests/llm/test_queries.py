"""The numbered queries' own columns on whole small tables next to plain restatements."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from respscore.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    """Rows of a query, run once."""
    rows = {}

    def run(name):
        if name not in rows:
            rows[name] = [r.asDict() for r in registry.QUERIES[name](spark, SF).collect()]
        return rows[name]
    return run


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_cover_dedup_query(found, texts):
    """Removed bytes, spans and what is left, copies of whole texts included."""
    length = 200
    counts = collections.Counter(t[k:k + length] for t in texts.values() for k in range(len(t) - length + 1))
    want = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if counts[t[k:k + length]] > 1:
                gone[k:k + length] = b"\x01" * length
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        left = bytes(x for x, g in zip(t, gone) if not g)
        want[i] = (len(t), sum(gone), spans, hashlib.sha256(left).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found("op6_cover_dedup")}
    assert got == want and any(x[1] for x in want.values())


def test_kept_flags(found):
    for name, key in (("op3_collision_count", "vec_id"), ("op10_hyperminhash", "doc_id")):
        rows = found(name)
        assert all(r["kept"] == (r[key] == r["component_id"]) for r in rows)
        ids = {r[key] for r in rows}
        assert all(r["component_id"] in ids and r["component_id"] <= r[key] for r in rows)
    assert not all(r["kept"] for r in found("op10_hyperminhash"))


def test_token_count_query(found, texts):
    rows = found("op8_token_counts")
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == {i: len(t) for i, t in texts.items()}
    assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows) and len({r["over_limit"] for r in rows}) == 2


def test_quality_and_language_queries(found, texts):
    rows = found("op7_neighbour_quality")
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    rows = found("op12_output_codes")
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_language_of_held_out_documents(spark, found):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in found("op12_output_codes") if r["held_out"] and lang[r["doc_id"]] is not None]
    assert len(held) > 30 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_quality_of_held_out_documents(spark, found):
    """Area under the curve on held-out labels."""
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in registry.QUERIES["op7_neighbour_quality"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in label]
    good, bad = ([r["score"] for r in rows if label[r["doc_id"]] == x] for x in (1, 0))
    assert good and bad
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.85
