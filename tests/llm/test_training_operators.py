"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, next to
brute force; and on empty tables."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from tokenizers import Tokenizer

from respscore.llm import (ball_codes, collision_count, cover_dedup, fair_mix, hyperminhash, license_scan, neighbour_quality, output_codes,
                           packing, phrase_tries, repair_ids, rule_ledger, token_cache, tokens)
from respscore.session import cut_lineage, scratch_path

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, digest string, node string, h string, "
          "bucket string, score string, words string, start string, block string, n string, key string")
SPACE = " \t\n\r\x0b\x0c"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 9))) for _ in range(n))


def texts():
    rng = random.Random(5)
    base = prose(rng, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    passage = prose(rng, 60)
    rows = [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"), (9, "One TWO"),
            (10, prose(rng, 80) + "\n" + passage + "\nünï çødé"), (11, prose(rng, 90) + "\n" + passage + "\n" + passage),
            (12, "GNU General Public License and mit license cc by nc 4 0"), (13, "a b c " * 40), (14, "x### y$$$ " * 40),
            (15, "line\nline\nline\nother words here"), (16, prose(rng, 40_000)), (None, base), (None, "null id text " + prose(rng, 70)),
            (17, "Licensed under the Apache License, Version 2.0"), (17, "Licensed under the Apache License, Version 2.0"),
            (18, "a<|endoftext|> b  c\n\n d   e"), (19, "ü" * 150), (20, "MKİT MİT license")]
    return [(i, t) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if k % 5 == 0 else f"s{k % 4}", None if t is None else len(t), None, "d", "e", "f", "g", "s", "w", "t", "b", "n", "k")
            for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def word_list(text):
    return (text or "").encode().split()


def test_rule_ledger(docs, empty):
    def brute(doc_id, text):
        words, t = word_list(text), text or ""
        g = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        seen = collections.Counter(g)
        covered = {i + k for i, x in enumerate(g) if seen[x] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        n, rep = len(words), len(covered)
        return (doc_id, n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep,
                n >= 50 and 100 * rep <= 50 * n)

    found = rule_ledger.ledger(docs).withColumn("ok", rule_ledger.passes("base", 1))
    assert ordered(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ok") == sorted(
        (brute(*r) for r in texts()), key=repr)
    rows = rule_ledger.ledger(docs)
    bits = [r["fail_bits"] for r in rows.collect()]
    for r in rule_ledger.ablations(rows).collect():
        mask = rule_ledger.mask_of(rule_ledger.POLICIES[r["policy"], r["version"]])
        bit = rule_ledger.mask_of([r["rule"]])
        assert (r["n_rejected"], r["n_by_rule"], r["n_only_by_rule"]) == (
            sum(b & mask != 0 for b in bits), sum(b & bit != 0 for b in bits), sum(b & mask == bit for b in bits))
    assert rule_ledger.ledger(empty).count() == 0


@pytest.mark.parametrize("name, drops", [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_pieces_equal_the_library(name, drops):
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", ".", ",", "'s", "é", "<|endoftext|>", "<|", "\t", " ", "　", "1", "\x00", "\x1c", "\r\n",
             "!!", "The", "́", "İ", "K", "don't", "  \n", "ß", "×", "J", "J̌"]
    found = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))).encode() for _ in range(5000)] + [(t or "").encode() for _, t in texts()]
    encoder = tokens.PieceEncoder(tokens.tokenizer_path(name), drops, cache_size=200)
    for i in range(0, len(found), 700):
        assert encoder.encode(found[i:i + 700]) == encoder.whole(found[i:i + 700])


def ids_of(name, text, end):
    t = Tokenizer.from_file(tokens.tokenizer_path(name))
    return np.array(t.encode(text or "", add_special_tokens=False).ids + end, "<u4")


def test_repair_files(spark, docs, empty):
    folder = scratch_path(spark, "test-ids")
    repair_ids.write_ids(docs, folder, tokens.tokenizer_path("word_bpe_49k.json"), block_ids=500)
    found = sorted(repair_ids.read_documents(spark, folder).collect(), key=lambda r: r["start"])
    want = sorted(((i, t, ids_of("word_bpe_49k.json", t, [2])) for i, t in texts()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc_id, _, ids) in zip(found, want, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = scratch_path(spark, "test-ids")
    repair_ids.write_ids(empty, folder, tokens.tokenizer_path("word_bpe_49k.json"))
    assert repair_ids.read_documents(spark, folder).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(1)
    data = np.repeat(rng.integers(0, 30, (60, 20)), 3, axis=0).ravel().astype(np.uint32)
    sequence, rules, lengths = repair_ids.compress(data, 50, 2)
    assert len(sequence) < 0.9 * len(data)
    row = {"base": 50, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(), "sequence": sequence.astype("<u2").tobytes()}
    block = repair_ids.Block(row)
    for a, n in [(0, len(data)), (17, 5), (100, 333), (len(data) - 1, 1), (5, 0)]:
        assert (block.ids(a, n) == data[a:a + n]).all()


@pytest.mark.parametrize("kind", ["passage", "run", "many"])
def test_repair_until_no_pair_is_frequent(kind):
    """A long passage is one symbol, a run of one id is halved each round, and no number of frequent pairs is too large."""
    rng = np.random.default_rng(2)
    if kind == "passage":
        passage = rng.integers(3, 1000, 50)
        data = np.concatenate([np.append(passage, rng.integers(1000, 60000, 1)) for _ in range(500)])
    elif kind == "run":
        data = np.concatenate((np.full(5001, 7), [2], np.full(5000, 7), [2]))
    else:
        data = np.repeat(np.stack((np.arange(3, 9003), np.arange(10003, 19003)), 1)[:, None], 9, axis=1)
        data = data.reshape(-1, 2)[rng.permutation(9 * 9000)].ravel()
    base = 60000
    sequence, rules, lengths = repair_ids.compress(data.astype(np.uint32), base, 2)
    left = collections.Counter()
    last = None
    for i, pair in enumerate(zip(sequence.tolist(), sequence[1:].tolist())):
        if last is not None and last == (i - 1, pair):  # overlaps the one before
            last = None
            continue
        last = (i, pair)
        left[pair] += 1
    ends = {2}
    for k, (_, b) in enumerate(rules.tolist()):
        ends |= {base + k} if b in ends else set()
    assert max([n for (a, _), n in left.items() if a not in ends], default=0) < 8
    assert len(sequence) <= {"passage": 1000, "run": 40, "many": 81000}[kind]
    row = {"base": base, "rules": rules.astype("<u4").tobytes(), "lengths": lengths.astype("<u4").tobytes(),
           "sequence": sequence.astype("<u2" if base + len(rules) <= 1 << 16 else "<u4").tobytes()}
    assert (repair_ids.Block(row).ids(0, len(data)) == data).all()


def brute_links(sets, similar):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def least_ids(ids, roots, alone):
    groups = collections.defaultdict(list)
    for i, r in zip(ids, roots):
        groups[r].append(i)
    return [i if a else min((x for x in groups[r] if x is not None), default=None) for i, r, a in zip(ids, roots, alone)]


def test_collision_count(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((30, 32))
    near = base[:12] + 0.05 * rng.standard_normal((12, 32))
    vectors = [*base, *near, *base[:3], base[0] * 7, np.zeros(32), np.full(32, np.nan), np.full(32, np.inf)]
    vectors = [v.astype(np.float32).tolist() for v in vectors] + [None, [], [1.0, None], [1.0, 2.0], [2.0, 4.0]]
    ids = [*range(len(vectors) - 1), None]
    label = [None if i % 11 == 10 else i % 2 if i < 30 else (i - 30) % 2 for i in range(len(vectors))]
    rows = [(i, v, c, "x", "y") for i, v, c in zip(ids, vectors, label)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, dim string")
    good = [c is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for v, c in zip(vectors, label)]

    def linked(a, b):
        (v, c, x), (w, d, y) = a, b
        return x and y and c == d and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93

    items = list(zip(vectors, label, good))
    roots = brute_links(items, linked)
    links = [sum(i != j and linked(a, b) for j, b in enumerate(items)) for i, a in enumerate(items)]
    want = sorted(zip(ids, [int(x) for x in links], least_ids(ids, roots, [not g for g in good])), key=repr)
    assert ordered(collision_count.similar_vectors(table), "vec_id", "n_links", "component_id") == want
    assert collision_count.similar_vectors(table.limit(0)).count() == 0


def pairs_at(rng, n, dim, cosine):
    u, v = rng.standard_normal((2, n, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v -= (v * u).sum(1)[:, None] * u
    v /= np.linalg.norm(v, axis=1)[:, None]
    return u, cosine * u + math.sqrt(1 - cosine ** 2) * v


def test_collision_count_of_crowded_cells(spark):
    """Labels long enough for keys; a group of near copies larger than a block, pairs around the threshold, a label of one vector."""
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(24)
    group = centre + 0.12 * np.linalg.norm(centre) / math.sqrt(24) * rng.standard_normal((1300, 24))
    near = np.concatenate(pairs_at(rng, 300, 24, 0.935))
    far = np.concatenate(pairs_at(rng, 300, 24, 0.925))
    first = np.concatenate([group, near, far, rng.standard_normal((300, 24))]).astype(np.float32)
    second = np.concatenate([*pairs_at(rng, 700, 24, 0.95), first[:5]]).astype(np.float32)
    assert collision_count.key_length(len(first)) > 3 and collision_count.key_length(len(second)) > 3
    rows, want, at = [], {}, 0
    for name, vectors in (("a", first), ("b", second), ("c", first[:1])):
        units = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
        linked = units @ units.T >= 0.93
        np.fill_diagonal(linked, True)
        root = np.arange(len(vectors))
        while True:
            least = np.array([root[x].min() for x in linked])
            if (least == root).all():
                break
            root = least
        for i, v in enumerate(vectors):
            rows.append((at + i, v.tolist(), name))
            want[at + i] = (int(linked[i].sum()) - 1, at + int(root[i]))
        at += len(vectors)
    assert max(n for n, _ in want.values()) >= 1000
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(5)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collision_count.similar_vectors(table).collect()}
    assert got == want
    doubles = table.withColumn("embedding", table["embedding"].cast("array<double>"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in collision_count.similar_vectors(doubles).collect()} == want


def test_collision_keys_and_windows():
    """Pairs at the threshold share a cell as often as the formulas say, the share of pairs that meet falls, windows are exact."""
    rng = np.random.default_rng(4)
    u, v = pairs_at(rng, 4000, 48, 0.93)
    shares = []
    for n in (2000, 8000, 32000):
        a, b = collision_count.cells_of(u, n), collision_count.cells_of(v, n)
        assert abs((a == b)[:, 0].mean() - collision_count.same_cell(collision_count.DELTA) ** collision_count.key_length(n)) < 0.04
        assert (a == b).any(axis=1).mean() > 0.999
        others = collision_count.cells_of(pairs_at(rng, n, 48, 0.0)[0], n)
        met = sum(int((c * (c - 1)).sum()) for c in (np.unique(t, return_counts=True)[1] for t in others.T))
        shares.append(met / (n * (n - 1)))
        print(f"{n} vectors: pairs met, summed over tables, to all pairs {shares[-1]:.3f}")
    assert shares[0] < 0.9 and shares[1] < 0.6 * shares[0] and shares[2] < 0.6 * shares[1]
    for n in (1, 90, 255, 256, 700):
        places = np.round(rng.standard_normal((collision_count.PROJECTIONS, n)), 1)
        want = (np.abs(places[:, :40, None] - places[:, None]) <= collision_count.WIDTH).sum(axis=0)
        ranks, begins, lengths = collision_count.windows(places)
        assert (collision_count.window_collisions(ranks, begins[:, :40], lengths[:, :40]) == want).all()
    near = np.abs((u - v) @ collision_count.directions(48)) <= collision_count.WIDTH
    assert (near.sum(axis=1) >= collision_count.LEAST).mean() > 0.999


def plain_codes(rows, entries, rounds):
    """Lloyd rounds by comparing everything with everything: {vec_id: (code, error)} and the codebooks."""
    width = len(rows[0][1]) // 4
    parts = [[[math.floor(1024 * x) for x in v[p * width:(p + 1) * width]] for _, v in rows] for p in range(4)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    books = [[parts[p][i] for i in first] for p in range(4)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda p: [min((far(x, c), e) for e, c in enumerate(books[p])) for x in parts[p]]
    for _ in range(rounds):
        for p in range(4):
            members = collections.defaultdict(list)
            for x, (_, e) in zip(parts[p], nearest(p)):
                members[e].append(x)
            for e, m in members.items():
                books[p][e] = [sum(c) // len(m) for c in zip(*m)]
    last = [nearest(p) for p in range(4)]
    return [("".join("%02x" % last[p][i][1] for p in range(4)), sum(last[p][i][0] for p in range(4))) for i in range(len(rows))], books


@pytest.mark.parametrize("kind", ["spread", "tight", "large"])
def test_ball_codes(spark, kind):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((6, 16))
    noise, scale = {"spread": (1.0, 1), "tight": (0.02, 1), "large": (1.0, 20_000)}[kind]
    vectors = (centres[rng.integers(0, 6, 150)] + noise * rng.standard_normal((150, 16))) * scale
    vectors = [*vectors, *vectors[:9], vectors[0] * 0]
    vectors = [v.astype(np.float32).tolist() for v in vectors]
    ids = [*range(len(vectors) - 2), 3, None]
    odd = [(900, None), (901, []), (902, [None] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [0.0] * 15), (905, [1.0, 2.0])]
    label = lambda i: None if i is None or i % 7 == 0 else i % 3
    table = spark.createDataFrame([(i, v, label(i), "x", 1) for i, v in [*zip(ids, vectors), *odd]],
                                  "vec_id long, embedding array<float>, label int, part string, n int").repartition(3)
    found, books = ball_codes.ball_codes(table, entries=20)
    want, want_books = plain_codes(list(zip(ids, vectors)), 20, 4)
    assert [b.tolist() for b in books] == want_books
    assert ordered(found, "vec_id", "code", "error") == sorted(((i, *w) for i, w in zip(ids, want)), key=repr)
    empty, none = ball_codes.ball_codes(table.limit(0))
    assert empty.count() == 0 and sum(map(len, none)) == 0


def test_ball_codes_query(spark, monkeypatch):
    """The columns of the query, next to plain rounds over the whole table."""
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want, books = plain_codes([(r["vec_id"], r["embedding"]) for r in rows], 256, 4)
    totals = collections.Counter()
    for r, (_, error) in zip(rows, want):
        totals[r["label"]] += error
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = ball_codes.op11_ball_codes(spark, "/root/testdata/sf0.001")
    assert ordered(found, "vec_id", "code", "error", "label_error", "codebooks_sha256") == sorted(
        ((r["vec_id"], *w, totals[r["label"]], sha) for r, w in zip(rows, want)), key=repr)


def test_balls_skip_work_but_not_results():
    """Unmoved balls, stable cores and rings leave most distances out and change no assignment."""
    rng = np.random.default_rng(3)
    entries = rng.integers(-3000, 3000, (64, 4))
    rows = entries[rng.integers(0, 64, 5000)] + rng.integers(-300, 300, (5000, 4))
    codes = ball_codes.Balls(entries).assign(rows, None)
    moved = entries.copy()
    moved[::9] += rng.integers(-40, 40, (len(moved[::9]), 4))
    far = np.zeros(64)
    np.maximum.at(far, codes, np.sqrt(((rows - entries[codes]) ** 2).sum(1)))
    way = np.sqrt(((moved - entries) ** 2).sum(1))
    balls = ball_codes.Balls(moved, far + way + 1e-6, way > 0)
    assert balls.still.any() and not balls.still.all()
    compared = []
    whole = ball_codes.Balls.nearest
    balls.nearest = lambda r, among: compared.append(len(r) * len(among)) or whole(balls, r, among)
    assert (balls.assign(rows, codes) == ball_codes.Balls(moved).assign(rows, None)).all()
    assert sum(compared) < 0.2 * rows.shape[0] * len(entries)


def test_fair_mix(docs, empty):
    rows, mixed = fair_mix.fair_mix(docs)
    per = collections.defaultdict(list)
    sized = rows.collect()
    assert sorted(r["size"] for r in sized) == sorted(len(word_list(t)) for _, t in texts())
    for r in sized:
        per[r["source"]].append(r)
    total = sum(r["size"] for r in sized)
    names = sorted((s for s in per if s is not None)) + [None] * (None in per)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    size = {s: sum(r["size"] for r in per[s]) for s in names}
    target, open_ = {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * size[s]]
        if not above:
            break
        target.update({s: 3.0 * size[s] for s in above})
        open_ -= set(above)
    target.update(share)
    taken = collections.Counter()
    items = sorted(mixed.collect(), key=lambda r: r["position"])
    position = 0
    for r in items:
        assert r["position"] == position and r["words"] > 0
        position += r["words"]
        taken[r["source"]] += r["words"]
    assert [r["finish"] for r in items] == sorted(r["finish"] for r in items)
    for s in names:
        assert {round(r["target"], 6) for r in per[s]} == {round(target[s], 6)}
        assert abs(taken[s] - target[s]) < 1 + 1e-6
    each = collections.Counter()
    for r in items:
        each[r["source_no"], r["bucket"], r["rn"]] += r["words"]
    assert all(each[r["source_no"], r["bucket"], r["rn"]] <= 3 * r["size"] for r in sized)
    assert fair_mix.mixed_documents(docs).columns == docs.columns
    a, b = fair_mix.fair_mix(empty)
    assert a.count() == 0 and b.count() == 0


def test_packing(docs, empty):
    pieces = packing.pack(docs, tokens.tokenizer_path("byte_bpe_50k.json"), window=64, n_open=4).collect()
    want = collections.Counter()
    for i, t in texts():
        want[i, ids_of("byte_bpe_50k.json", t, [0]).tobytes()] += 1
    found = collections.Counter()
    by_id = collections.defaultdict(list)
    for i, ids in want:
        by_id[i].append(np.frombuffer(ids, "<u4"))
    for p in pieces:
        match = [x for x in by_id[p["doc_id"]] if len(x) == p["doc_tokens"]
                 and zlib.crc32(x[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"]]
        assert match and p["length"] > 0
        found[p["doc_id"], match[0].tobytes()] += p["length"]
    assert found == {k: n * (len(k[1]) // 4) for k, n in want.items()}
    rows = collections.defaultdict(list)
    for p in pieces:
        rows[p["sequence_id"]].append((p["offset"], p["length"]))
    fill = []
    for r in rows.values():
        r.sort()
        assert [o for o, _ in r] == [sum(n for _, n in r[:k]) for k in range(len(r))]
        fill.append(sum(n for _, n in r))
    assert max(fill) <= 64 and sum(fill) >= 0.95 * 64 * len(fill)
    assert packing.pack(empty, tokens.tokenizer_path("byte_bpe_50k.json")).count() == 0


def brute_spans(all_texts, length=cover_dedup.LENGTH):
    counts = collections.Counter(b[k:k + length] for b in all_texts for k in range(len(b) - length + 1))
    out = []
    for b in all_texts:
        mark = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k:k + length]] > 1:
                mark[k:k + length] = b"\x01" * length
        out.append(mark)
    return out


def test_cover_dedup(spark, docs, empty):
    found = cover_dedup.removals(docs).collect()
    data = [(t or "").encode() for _, t in texts()]
    marks = dict(zip(data, brute_spans(data)))
    copied = {b for b, n in collections.Counter(data).items() if n > 1 and len(b) >= 200}
    got = {bytes(r["digest"]): r for r in found}
    for b, mark in marks.items():
        if b in copied:
            assert all(mark)
            continue
        r = got.get(hashlib.md5(b).digest())
        kept = bytes(x for x, m in zip(b, mark) if not m)
        if not any(mark):
            assert r is None
        else:
            assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == (
                sum(mark), len([x for x in bytes(mark).split(b"\x00") if x]), hashlib.sha256(kept).hexdigest())
    assert any(any(m) for b, m in marks.items() if b not in copied)
    assert {bytes(r["digest"]) for r in cover_dedup.copies(docs).collect()} == {hashlib.md5(b).digest() for b in copied}
    left = cover_dedup.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(data)
    assert cover_dedup.removals(empty).count() == 0 and cover_dedup.remove_repeats(empty).count() == 0


def test_cover_dedup_across_segments(monkeypatch):
    rng = random.Random(9)
    text = bytes(rng.choice(b"ab") for _ in range(3000))
    chosen = cover_dedup.sampled(len(text))
    whole = cover_dedup.fingerprints(text, cover_dedup.SAMPLE, chosen)
    monkeypatch.setattr(cover_dedup, "SEGMENT", 257)
    assert (cover_dedup.fingerprints(text, cover_dedup.SAMPLE, chosen) == whole).all()
    same = {text[p:p + cover_dedup.SAMPLE] for p in chosen.tolist()}
    assert len(same) == len(set(whole.tolist()))
    places = np.array([3, 4, 5, 9, 70000, 70001])
    assert (cover_dedup.unpacked(cover_dedup.packed(places)) == places).all()
    assert (cover_dedup.from_runs(cover_dedup.as_runs(places)) == places).all()


@pytest.mark.parametrize("weak", [lambda text, n: np.zeros(n, np.uint64), lambda text, n: np.full(n, text[0], np.uint64) << np.uint64(56)])
def test_cover_dedup_when_fingerprints_agree(monkeypatch, weak):
    """Equal first fingerprints, or such as differ in their last byte only, in a number of buckets that divides 4096."""
    rng = random.Random(11)
    monkeypatch.setattr(cover_dedup, "fingerprints", lambda text, depth, chosen: weak(text, len(chosen)))
    repeated = bytes(rng.choice(b"abcdef") for _ in range(cover_dedup.LENGTH))
    blocks = [[repeated, b"x" + repeated[1:]], [b"y" + repeated[1:], repeated], [b"z" + repeated[1:]]]
    rows = [(b, k * 1000, text, None) for b, block in enumerate(blocks) for k, text in enumerate(block)]
    batch = pa.table({"block": [r[0] for r in rows], "place": [r[1] for r in rows], "text": pa.array([r[2] for r in rows], pa.binary()),
                      "starts": pa.array([r[3] for r in rows], pa.binary())}).to_batches()
    width = getattr(cover_dedup, "WIDTH", 7)
    sent = pa.Table.from_batches(cover_dedup.records(64, width, cover_dedup.LENGTH, lambda n, _: np.arange(n - cover_dedup.LENGTH + 1))(batch))
    found = set()
    for bucket in set(sent.column("bucket").to_pylist()):
        group = cover_dedup._bucket(width)(sent.filter(pa.compute.equal(sent.column("bucket"), bucket)))
        found |= {(r["block"], int(p)) for r in group.to_pylist() for p in cover_dedup.unpacked(r["places"])}
    assert found == {(0, 0), (1, 1000)}


def test_cover_dedup_second_fingerprints(monkeypatch):
    rng = random.Random(12)
    text = bytes(rng.choice(b"ab") for _ in range(2000)) * 2
    chosen = np.arange(len(text) - cover_dedup.LENGTH + 1)
    whole = cover_dedup.second_fingerprints(text, cover_dedup.LENGTH, chosen)
    assert len(set(whole.tolist())) == 2000 and (whole[:1801] == whole[2000:]).all()
    monkeypatch.setattr(cover_dedup, "SEGMENT", 257)
    assert (cover_dedup.second_fingerprints(text, cover_dedup.LENGTH, chosen) == whole).all()
    order, same = cover_dedup.in_order(np.array([5, 3, 5, 5], np.uint64), np.array([1, 0, 2, 1], np.uint32))
    assert order.tolist() == [1, 0, 3, 2] and same.tolist() == [False, True, False]


def test_neighbour_quality(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, 60) if i % 3 else " | ".join(prose(rng, 60).split()), "x") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(1, 0, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = neighbour_quality.fit(table, labels)
    found = neighbour_quality.scored(table, model, score="vote").collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 40 and all((r["vote"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in held)
    some = [neighbour_quality.terms(r["text"].encode()) for r in found[:20]]
    cosine = model.vectors(some) @ model.voters.T  # brute force of the vote
    for k, row in enumerate(cosine):
        kth = np.sort(row)[-neighbour_quality.NEIGHBOURS] - 1e-5
        w = np.where(row >= kth, np.maximum(row, 0).astype(float) ** neighbour_quality.POWER, 0)
        assert abs((w @ model.labels) / w.sum() - found[k]["vote"]) < 1e-3
    kept = neighbour_quality.keep_quality(table, labels)
    assert kept.columns == table.columns and {r["doc_id"] % 3 > 0 for r in kept.collect()} == {True}
    every = neighbour_quality.scored(docs, model, score="vote").collect()
    assert len(every) == len(texts()) and all(0 <= r["vote"] <= 1 for r in every)
    none = neighbour_quality.fit(table, labels.limit(0))
    assert none is None and {r["vote"] for r in neighbour_quality.scored(docs, none, score="vote").collect()} == {0.5}
    assert neighbour_quality.scored(empty, model, score="vote").count() == 0


def test_token_cache(spark, docs, empty):
    cache, path = scratch_path(spark, "test-cache"), tokens.tokenizer_path("word_bpe_49k.json")
    want = sorted(((i, len((t or "").encode()), len(ids_of("word_bpe_49k.json", t, []))) for i, t in texts()), key=repr)
    assert ordered(token_cache.token_counts(docs, cache, path), "doc_id", "n_bytes", "n_tokens") == want
    before = spark.read.parquet(cache).count()
    assert ordered(token_cache.token_counts(docs, cache, path), "doc_id", "n_bytes", "n_tokens") == want
    assert spark.read.parquet(cache).count() == before == spark.read.parquet(cache).select("digest").distinct().count()
    assert token_cache.token_counts(empty, scratch_path(spark, "test-cache"), path).count() == 0


def test_license_scan(docs, empty):
    def words(text):
        out, now = [], ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalnum():
                out += [now] * bool(now)
                now = ""
            else:
                now += c.lower() if c.isascii() else c
        return out

    got = {(r["doc_id"], r["n_words"]): r for r in license_scan.license_scan(docs).collect()}
    for i, t in texts():
        w = words(t)
        r = got[i, len(w)]
        places = sorted((k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split())
        assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
        own = {label for label, (_, key) in license_scan.TEMPLATES.items() for k in range(len(w)) if w[k:k + len(key.split())] == key.split()}
        assert set(filter(None, r["labels"].split(","))) == {x for _, x in places} | own
    assert license_scan.license_scan(empty).count() == 0


def test_license_scan_of_key_phrases_alone(spark):
    """A key phrase is a label in any wording around it, whatever the table's frequencies."""
    rows = [(i, f"See the {key}, here.") for i, (_, key) in enumerate(license_scan.TEMPLATES.values())]
    common = [(100, " ".join(key for _, key in license_scan.TEMPLATES.values()))] * 30
    rest = [(101, " ".join(notice for notice, _ in license_scan.TEMPLATES.values()))] * 30
    for more in ([], common, rest):
        got = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(rows + more, "doc_id long, text string")).collect()}
        for i, label in enumerate(license_scan.TEMPLATES):
            assert label in got[i]["labels"].split(",") and 0 < got[i]["score"] <= 1, label
        for i, _ in more[:1]:
            assert set(license_scan.TEMPLATES) <= set(got[i]["labels"].split(","))


def test_hyperminhash(docs, empty):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, ids = [shingles(t) for _, t in texts()], [i for i, _ in texts()]
    roots = brute_links(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b))
    want = sorted(zip(ids, map(len, sets), least_ids(ids, roots, [not s for s in sets])), key=repr)
    assert ordered(hyperminhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == want
    kept = hyperminhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r for r, s in zip(roots, sets) if s}) + sum(not s for s in sets)
    assert hyperminhash.near_duplicates(empty).count() == 0 and hyperminhash.keep_one(empty).count() == 0


def test_hyperminhash_across_blocks():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    sets = [np.unique(base[:200]), np.unique(base[:210]), np.unique(base[190:])]
    table = pa.table({"lo": [0] * 3, "hi": [0] * 3, "block": [0] * 3, "node": [1, 2, 3], "root": [1, 2, 3],
                      "sketch": [hyperminhash.registers(hyperminhash.smallest(s)).tobytes() for s in sets], "shingles": [s.tobytes() for s in sets]})
    assert hyperminhash._across(table).to_pylist() == [{"a": 1, "b": 2}]
    sketch = [hyperminhash.registers(hyperminhash.smallest(s)) for s in sets]
    assert abs(hyperminhash.estimate(sketch[0], sketch[1]) - 200 / 210) < 0.06
    assert hyperminhash.CHANCE < 0.001


def test_components_of_a_chain(spark):
    from respscore.llm.common import components
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000 + i, 1000) for i in range(1, 50)], "a long, b long")
    roots = collections.defaultdict(set)
    for r in components(edges).collect():
        roots[r["root"]].add(r["node"])
    assert sorted(map(sorted, roots.values())) == [list(range(n + 1)), list(range(1000, 1050))]
    assert components(edges.limit(0)).count() == 0


SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ber ung zen ich", "cc": "oux eau ille ent oir", "dd": "dad cion osa ell ija", "ee": "wy prz szcz owa nik",
             "ff": "qua uum ibus orum ae", "gg": "éà çü öß ñí łó"}


def tongue(rng, lang, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("n_langs", [1, 2, 4, 7])
def test_output_codes(spark, n_langs):
    """Held-out documents get their language; codewords differ; rows without letters or a language have defined results."""
    rng, langs = random.Random(4), list(SYLLABLES)[:n_langs]
    rows = [(i, tongue(rng, langs[i % n_langs], rng.randint(1, 60) if i % 9 else 4000 if i == 0 else 3), langs[i % n_langs], "x", "y", "z") for i in range(400)]
    rows += [(1000, None, "aa", "x", "y", "z"), (1001, "", None, "x", "y", "z"), (1002, " 12 # ²", "aa", "x", "y", "z"), (None, rows[0][1], "wrong", "x", "y", "z"),
             (1003, rows[1][1], None, "x", "y", "z"), (3, rows[3][1], rows[3][2], "x", "y", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, letters string, margins string").repartition(3)
    found = [(r["doc_id"], r["lang_pred"], r["score"], r["ambiguous"]) for r in output_codes.languages(table).collect()]
    assert len(found) == len(rows) and all(0 <= x[2] <= 1 for x in found)
    pred = {x[0]: x for x in found}
    assert [pred[i][1:3] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert pred[None][1] == pred[0][1] and pred[1003][1] == pred[1][1]
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    right = [pred[r[0]][1] == r[2] for r in held]
    assert len(held) > 60 and sum(right) >= 0.97 * len(held)
    assert all(pred[r[0]][1] == r[2] for r in held if len(r[1].split()) > 10)
    code = output_codes.codewords(n_langs)
    assert len({tuple(c) for c in code.tolist()}) == n_langs and all(set(b) == {1, -1} for b in code.T.tolist())
    assert output_codes.languages(table.limit(0)).count() == 0
    unknown = output_codes.languages(table.withColumn("lang", output_codes.F.lit(None).cast("string")).where("doc_id < 9")).collect()
    assert {(r["lang_pred"], r["score"]) for r in unknown} == {("und", 0.0)}


def test_output_codes_margins():
    """Counts, margins and losses next to plain Python."""
    texts = ["Éa b-c", "", "ab" * 700, "x y z"]
    found = output_codes.ngram_counts(texts)
    for text, row in zip(texts, found):
        data = (" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode()
        want = collections.Counter()
        for k, n in enumerate(output_codes.ORDERS):
            for i in range(len(data)):
                gram = int.from_bytes((data + output_codes.PAD)[i:i + n], "little")
                want[k << 12 | (gram * 0x9E3779B1 % 2**32) >> 20] += 1
        assert dict(want) == {int(i): int(row[i]) for i in np.flatnonzero(row)}
    model = output_codes.Model({"a": found[0] + found[2], "b": found[3], "c": found[1] + 1})
    share = {x: (c + 0.5) / (c + 0.5).sum() for x, c in (("a", found[0] + found[2]), ("b", found[3]), ("c", found[1] + 1))}
    for b, bits in enumerate(model.code.T):
        side = lambda s: np.mean([share[x] for x, y in zip("abc", bits) if y == s], axis=0)
        odds = np.log(side(1)) - np.log(side(-1))
        for t, (row, got) in enumerate(zip(found, model.margins(texts)[:, b])):
            assert abs(got - (row * odds).sum() / max(1, row.sum())) < 1e-4
    right = np.random.default_rng(1).random(model.code.shape)
    decoder = output_codes.Decoder(model, right, np.array([1.0, 2.0, 0.5]))
    margins = np.random.default_rng(2).standard_normal((20, 3))
    for m, row in zip(margins, decoder.losses(margins)):
        for i in range(3):
            trust = (right[i] + 1e-6) / (right[i] + 1e-6).sum()
            assert abs(row[i] - sum(trust[b] * math.exp(-model.code[i, b] * max(-3, min(3, m[b] / [1.0, 2.0, 0.5][b]))) for b in range(3))) < 1e-9


def plain_collocations(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in (1, 2, 3):
                count[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        known = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        found = []
        for p, a in known.items():
            if any(len(q) > len(p) and 100 * n >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, n in known.items()):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("shard", [1 << 20, 7])
def test_phrase_tries(spark, empty, monkeypatch, shard):
    """Whole reports next to counting everything, with one trie a level and with many."""
    rng = random.Random(6)
    words = ["Kar", "lo", "\u00e9t\u00e9", "New", "york", "city", "a" * 90, "x#y", "b"]
    weights = [9, 7, 5, 4, 4, 4, 1, 2, 3]
    text = lambda n: "".join(rng.choices(words, weights)[0] + rng.choice(["  ", " ", "\t", ". ", "\n", " "]) for _ in range(n))
    rows = [(rng.choice(["en", None, "a b"]), text(rng.randint(0, 60))) for _ in range(80)] + [("en", "New York city " * 900), ("en", None), ("zz", ""), ("und", "lo kar lo")]
    rows += [("en", "Long " + "q" * 5000 + " word")] * 12
    table = spark.createDataFrame([(lang, t, 1, 2, "n") for lang, t in rows], "lang string, text string, id int, n int, phrase string").repartition(3)
    monkeypatch.setattr(phrase_tries, "SHARD", shard)
    got = phrase_tries.collocations(table, least=5, top=30)
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert got.columns == list(names)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 5, 30)
    assert phrase_tries.collocations(empty).count() == 0


def test_phrase_tries_keep_two_passes_at_most(spark, monkeypatch):
    """However many tries a level has, the rows that its passes hand on are on disk twice at most."""
    walked, most = [], []

    def watched(df, name="stage"):
        table = cut_lineage(df, name)
        if "-walk" in name and "counts" not in name:
            walked.append(table.scratch_folder.removeprefix("file:"))
            most.append(sum(map(os.path.exists, walked)))
        return table

    words = [a + b for a in "abcd" for b in "xyz"]
    rows = [("en", " ".join(random.Random(i).choices(words, k=200))) for i in range(4)]
    monkeypatch.setattr(phrase_tries, "SHARD", 3)
    monkeypatch.setattr(phrase_tries, "cut_lineage", watched)
    totals, levels = phrase_tries.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), 5, 1)
    assert len(walked) == 4 and max(most) == 2
    assert totals.first()["n"] == 800 and levels[0].agg({"f": "sum"}).first()[0] == 800


@pytest.mark.parametrize("most", [0, 255, 256, 65_535, 65_536, 1 << 32, (1 << 63) - 1])
def test_packed_counts(most):
    counts = np.array([0, 1, most], np.int64)
    assert phrase_tries.unpacked_counts(phrase_tries.packed_counts(counts)).tolist() == counts.tolist()


def test_trie_of_many_keys():
    rng = random.Random(1)
    key = lambda: bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz\xc3\xa9") for _ in range(rng.randint(1, 7)))
    keys = sorted({key() for _ in range(30_000)} | {bytes([b]) + bytes([c]) for b in range(0x21, 256) for c in range(256)})
    shard = phrase_tries.Shard(keys, np.arange(1, len(keys) + 1))
    probe = [rng.choice(keys) for _ in range(5000)] + [key() for _ in range(5000)] + [b""]
    length = np.array([len(k) for k in probe])
    at = {k: i for i, k in enumerate(keys)}
    found = shard.trie.walk(np.frombuffer(b"".join(probe), np.uint8), np.cumsum(length) - length, length, np.zeros(len(probe), np.int64))
    assert found.tolist() == [at.get(k, -1) for k in probe]
    assert len(shard.trie.base) < 3 * (shard.trie.check >= 0).sum()


def test_scores_beyond_64_bits(spark):
    level = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_000)], "f long, l long, r long")
    score = phrase_tries.score_of(phrase_tries.F.col("f"), phrase_tries.F.col("l"), phrase_tries.F.col("r"))
    assert level.select(score.alias("s")).first()["s"] == 10**6 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_000)
