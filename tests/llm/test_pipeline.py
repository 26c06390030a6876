"""The pipeline's stages on a small table next to brute force."""

import collections

import corpus_pipeline
import pytest
from respscore.llm import cover_dedup, hyperminhash

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, found = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found.append(stage(spark, found[-1], SF).persist())
        assert found[-1].columns == columns
    raw, good, single, clean, mixed = [[(r["doc_id"], r["text"]) for r in x.collect()] for x in found]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    dropped = {i for i, _ in raw} - {i for i, _ in good}
    assert not any(labels.get(i) == 1 for i in dropped)

    sets = [set(hyperminhash.shingles(t.encode()).tolist()) for _, t in good]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(good):
        groups[find(k)].append(i)
    assert sorted(i for i, _ in single) == sorted(map(min, groups.values()))

    data = [t.encode() for _, t in single]
    counts = collections.Counter(b[k:k + cover_dedup.LENGTH] for b in data for k in range(len(b) - cover_dedup.LENGTH + 1))
    want = {}
    for (i, _), b in zip(single, data):
        mark = bytearray(len(b))
        for k in range(len(b) - cover_dedup.LENGTH + 1):
            if counts[b[k:k + cover_dedup.LENGTH]] > 1:
                mark[k:k + cover_dedup.LENGTH] = b"\x01" * cover_dedup.LENGTH
        want[i] = bytes(x for x, m in zip(b, mark) if not m).decode("utf-8", "ignore")
    assert dict(clean) == want
    assert {i for i, _ in mixed} <= set(want) and all(want[i] == t for i, t in mixed)
    assert max(collections.Counter(i for i, _ in mixed).values()) <= 3


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF).collect()
    used = collections.Counter()
    for p in pieces:
        used[p["sequence_id"]] += p["length"]
    assert max(used.values()) <= 1024 and sum(used.values()) == sum(p["length"] for p in pieces)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "source_mix", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


ODD = ("doc_id long, text string, lang string, source string, n_chars long, mark string, __mark string, key string, KEY_ string, SCORE string, "
       "h string, N string, taking string, digest string, words string, best_id string, copy string, spans string, `a.b` string")


def odd_rows():
    """Nulls, an empty text, a repeated row, a copy under another id, a long text; and columns named like the stages' own."""
    words = lambda seed, n: " ".join(f"w{(i * seed) % 977}" for i in range(n))
    rows = [(1, words(3, 90)), (2, words(5, 80)), (2, words(5, 80)), (3, words(3, 90)), (4, None), (5, ""), (None, words(7, 70)), (6, words(11, 30_000)), (7, "the end")]
    return [(i, t, None, None if i == 2 else f"s{(i or 0) % 3}", None if t is None else len(t)) + tuple(f"keep{k}" for k in range(14)) for i, t in rows]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_of_any_name(spark, name):
    docs = spark.createDataFrame(odd_rows(), ODD)
    stage = dict(corpus_pipeline.STAGES)[name]
    found = stage(spark, docs, SF)
    assert found.schema.names == docs.schema.names
    given = collections.Counter(odd_rows())
    for r in found.collect():
        assert tuple(r)[5:] == tuple(f"keep{k}" for k in range(14))
        if name in ("quality", "near_duplicates"):
            assert given[tuple(r)] > 0
    ids = collections.Counter(r["doc_id"] for r in found.collect())
    if name == "near_duplicates":  # 1 and 3 are copies, 2 repeats itself; texts without words stay
        assert ids == {1: 1, 2: 1, 4: 1, 5: 1, None: 1, 6: 1, 7: 1}
    if name == "repeated_passages":  # no row goes; copies of long texts lose them whole
        assert ids == collections.Counter(r[0] for r in odd_rows())
        texts = {r["doc_id"]: r["text"] for r in found.collect()}
        assert texts[1] == texts[2] == texts[3] == texts[5] == "" and texts[4] is None and texts[7] == "the end"
    if name == "source_mix":
        assert max(ids.values()) <= 6 and 4 not in ids and 5 not in ids
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(odd_rows(), ODD)
    found = corpus_pipeline.packing(spark, docs, SF).collect()
    assert {r["doc_id"] for r in found} == {1, 2, 3, 4, 5, 6, 7, None}
    assert corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0
