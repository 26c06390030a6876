"""Operators against hand fixtures, invariants and brute force."""

import math

import pytest

from pyspark.sql import functions as F

from conftest import SF001
from respscore.operators import metrics as ME
from respscore.operators import ngrams as NG
from respscore.operators import ranking as RK
from respscore.operators import sampling as SA
from respscore.operators import scale as SC
from respscore.operators import vocab as V


def test_minmax_constant_and_zero(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (1, 3.0), (2, 1.0), (2, 3.0)], "prompt_id long, x double")
    out = sorted(r["x"] for r in SC.minmax_by_group(df, ["x"]).where("prompt_id = 1").collect())
    assert out == [0.0, 0.0, 0.0]
    out = sorted(r["x"] for r in SC.minmax_by_group(df, ["x"]).where("prompt_id = 2").collect())
    assert out == [0.0, 1.0]


def test_nonfinite(spark):
    df = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (2.0,)], "x double")
    assert sorted(r["x"] for r in SC.nonfinite_to_zero(df).collect()) == [0.0, 0.0, 0.0, 2.0]


def test_plateau_fixture(spark):
    vals = [1.0, 1.05, 1.2, 0.9, 1.1, 1.2]
    log = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(vals)], "run_id long, step long, loss double")
    assert ME.plateau_stop(log, patience=2, delta=0.1).first()["stop_step"] == 6


def first_stop(vals, patience, delta):
    """The definition: since the first place of the minimum so far, ``patience`` values lie above it by more than delta."""
    for i in range(len(vals)):
        m = vals.index(min(vals[:i + 1]))
        if sum(v > vals[m] + delta for v in vals[m + 1:i + 1]) >= patience:
            return i + 1
    return None


def test_plateau_matches_simulation(spark):
    import random
    rnd = random.Random(7)
    rows, want = [], {}
    for run in range(60):
        vals = [rnd.random() for _ in range(40)]
        rows += [(run, i + 1, v) for i, v in enumerate(vals)]
        want[run] = first_stop(vals, 5, 0.004)
    log = spark.createDataFrame(rows, "run_id long, step long, loss double")
    got = {r["run_id"]: r["stop_step"] for r in ME.plateau_stop(log, patience=5, delta=0.004).collect()}
    assert got == want


def test_aligned_vs_multiset(spark):
    a = spark.createDataFrame([(1, 0, ["x", "y", "z"])], "rid long, prompt_id long, tok array<string>")
    b = spark.createDataFrame([(0, ["q", "x", "y", "z"])], "prompt_id long, tok array<string>")
    ga = NG.gram_table(a, "rid", "tok", ns=(2,), extra=("prompt_id",))
    gb = NG.gram_table(b, "prompt_id", "tok", ns=(2,))
    assert NG.aligned_overlap(ga, gb, "rid", "prompt_id").count() == 0
    assert NG.multiset_overlap(ga, gb, "rid").first()["overlap"] == 2


def test_rank_within_matches_row_number(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"),
                                     (F.col("id") % 17).alias("len"))
    h = df.withColumn("h", RK.hex_hash("k"))
    got = RK.rank_within(h, group=["g"], order=["len", "h", "k"])
    from pyspark.sql import Window
    want = h.withColumn("want", F.row_number().over(Window.partitionBy("g").orderBy("len", "h", "k")))
    j = got.join(want.select("k", "want"), "k")
    assert j.where(F.col("rank") != F.col("want")).count() == 0


def test_split_and_oversample_invariants(spark):
    df = spark.range(0, 500).select(F.col("id").alias("rid"), (F.col("id") % 7 % 4).alias("prompt_id"))
    s = SA.stratified_split(df, "rid")
    assert s.count() == 500 and s.select("rid").distinct().count() == 500
    per = {(r["prompt_id"], r["part"]): r["n"] for r in s.groupBy("prompt_id", "part").agg(F.count("*").alias("n")).collect()}
    sizes = {r["prompt_id"]: r["n"] for r in df.groupBy("prompt_id").agg(F.count("*").alias("n")).collect()}
    for g, n in sizes.items():
        assert per[(g, "valid")] == math.ceil(n * 0.2)
    o = SA.oversample(df, "rid")
    counts = {r["prompt_id"]: r["n"] for r in o.groupBy("prompt_id").agg(F.count("*").alias("n")).collect()}
    assert set(counts.values()) == {max(sizes.values())}
    one = SA.oversample(df.where("prompt_id = 0"), "rid")
    assert one.count() == sizes[0]


def test_param_grid(spark):
    g = SA.param_grid(spark, {"a": [1, 2, 3], "b": [0.1, 0.2]})
    assert g.count() == 6 == SA.grid_size({"a": [1, 2, 3], "b": [0.1, 0.2]})
    assert SA.param_sample(g, 4).count() == 4
    assert SA.loo_feature_sets(["x", "y", "z"])[0] == ("x", ["y", "z"])


def test_spell_candidates_brute_force(spark):
    from respscore.sources import fixtures as FX
    d = FX.dictionary(spark, SF001, min_freq=5)
    # small fixture: the words of the first 25 documents (brute force is quadratic)
    words = FX.responses(spark, SF001).where("response_id < 25").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    unk = words.join(d.select("word"), "word", "left_anti")
    got = {r["word"]: (r["correction"], r["distance"]) for r in V.spell_candidates(unk, d).collect()}
    dic = [(r["word"], r["freq"]) for r in d.collect()]

    def lev(a, b):
        prev = list(range(len(b) + 1))
        for i, ca in enumerate(a, 1):
            cur = [i]
            for j, cb in enumerate(b, 1):
                cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
            prev = cur
        return prev[-1]

    want = {}
    for (u,) in [(r["word"],) for r in unk.collect()]:
        best = None
        for w, f in dic:
            if abs(len(w) - len(u)) > 2:
                continue
            dd = lev(u, w)
            if dd <= 2 and (best is None or (dd, -f, w) < best):
                best = (dd, -f, w)
        if best:
            want[u] = (best[2], best[0])
    assert got == want


def test_gram_sums_match_refit(spark):
    import numpy as np
    from respscore.operators import model as MO
    rnd = np.random.default_rng(3)
    rows = [(int(g), float(a), float(b), float(a * 0.5 + b * 0.2 + rnd.normal() * 0.1), float(rnd.random()))
            for g in range(4) for a, b in rnd.random((30, 2))]
    df = spark.createDataFrame(rows, "prompt_id long, x1 double, x2 double, content double, wording double")
    sums = MO.gram_sums(df, ["x1", "x2"])
    total = MO.total_sums(sums, ["x1", "x2"])
    got = {r[0]: r[3] for r in MO.fold_losses_pdf(sums.toPandas(), total, ["x1", "x2"], ["x1", "x2"], ["content", "wording"],
                                                  "prompt_id", 0.0)}
    data = np.array([r[1:] for r in rows]); grp = np.array([r[0] for r in rows])
    for g in range(4):
        tr, va = data[grp != g], data[grp == g]
        X = np.c_[np.ones(len(tr)), tr[:, :2]]; Xv = np.c_[np.ones(len(va)), va[:, :2]]
        rm = [np.sqrt(np.mean((va[:, k] - Xv @ np.linalg.lstsq(X, tr[:, k], rcond=None)[0]) ** 2)) for k in (2, 3)]
        assert abs(got[g] - np.mean(rm)) < 1e-8


def test_subword_greedy(spark):
    from respscore.operators import subword as SW
    vocab = spark.createDataFrame([(p,) for p in ["un", "##aff", "##able", "u", "##n", "##a", "##f", "##b",
                                                   "##l", "##e", "a", "b"]], "piece string")
    words = spark.createDataFrame([("unaffable",), ("ab",), ("zz",)], "word string")
    got = {r["word"]: r["pieces"] for r in SW.segment_counts(words, vocab).collect()}
    # un ##aff ##able = 3; a ##b = 2; no piece covers "z" -> one unknown token
    assert got == {"unaffable": 3, "ab": 2, "zz": 1}


def many_stretches(spark):
    """Small tables stay in several range partitions."""
    from respscore.session import conf_set
    return conf_set(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false")


def test_scans_over_empty_stretches_nulls_and_null_groups(spark):
    rows = [(None, 1, 5.0), (None, 2, None), (None, 3, 1.0), (1, 1, None), (1, 2, None), (1, 3, 2.0), (1, 4, None), (2, 9, 7.0)]
    df = spark.createDataFrame(rows, "run long, step long, v double")
    with many_stretches(spark):
        low = {(r["run"], r["step"]): r["x"] for r in RK.running(df, ["run"], ["step"], F.col("v"), "min", "x").collect()}
        sums = {(r["run"], r["step"]): r["x"] for r in RK.running(df, ["run"], ["step"], F.col("v"), "sum", "x", inclusive=False).collect()}
        before = {(r["run"], r["step"]): r["x"] for r in RK.previous_value(df, ["run"], ["step"], "v", "x").collect()}
        assert RK.running(df.limit(0), ["run"], ["step"], F.col("v"), "max", "x").count() == 0
    keys = [(r, s) for r, s, _ in rows]
    assert [low[k] for k in keys] == [5.0, 5.0, 1.0, None, None, 2.0, 2.0, 7.0]
    assert [sums[k] for k in keys] == [0.0, 5.0, 5.0, 0.0, 0.0, 0.0, 2.0, 0.0]
    assert [before[k] for k in keys] == [None, 5.0, None, None, None, None, 2.0, None]


def test_plateau_goes_on_over_stretches(spark):
    """One run holds most rows and improves seldom, so its counter runs through many stretches; one improves always; one never."""
    import random
    rnd = random.Random(3)
    runs = {0: [1 - i / 4000 if i % 130 == 0 else 1 + 0.01 * rnd.random() for i in range(900)],
            1: [1 - i / 100 for i in range(50)], 2: [0.0] + [0.001] * 40, 3: [0.5, None, 0.6, float("nan"), 0.7], 4: [None]}
    for patience, delta in ((3, 0.009), (40, 0.003), (70, 0.004), (90, 0.0), (2, 0.05)):
        rows = [(r, i + 1, v) for r, vals in runs.items() for i, v in enumerate(vals)]
        want = {}
        for r, vals in runs.items():
            known = [(i + 1, v) for i, v in enumerate(vals) if v is not None and v == v]
            at = first_stop([v for _, v in known], patience, delta)
            want[r] = at and known[at - 1][0]
        with many_stretches(spark):
            log = spark.createDataFrame(rows, "run_id long, step long, loss double")
            got = {r["run_id"]: r["stop_step"] for r in ME.plateau_stop(log, patience, delta).collect()}
        assert got == want, (patience, delta)
    assert ME.plateau_stop(log.limit(0)).count() == 0


def test_bucketed_scans_match_windows(spark):
    import random
    from pyspark.sql import Window
    rnd = random.Random(11)
    rows = [(r, s, rnd.random()) for r in range(5) for s in range(1, 60)]
    df = spark.createDataFrame(rows, "run long, step long, v double")
    w = Window.partitionBy("run").orderBy("step")
    want = df.select("run", "step",
                     F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mn"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sm"),
                     F.lag("v").over(w).alias("lg"))
    with many_stretches(spark):
        got = RK.running(df, ["run"], ["step"], F.col("v"), "min", "mn", inclusive=False)
        got = RK.running(got, ["run"], ["step"], F.col("v"), "sum", "sm")
        got = RK.previous_value(got, ["run"], ["step"], "v", "lg")
        assert RK.stretches(df, ["run"], ["step"]).groupBy("run", "_p").count().count() > 8
    a = {(r["run"], r["step"]): (r["mn"], round(r["sm"], 9), r["lg"]) for r in got.collect()}
    b = {(r["run"], r["step"]): (r["mn"], round(r["sm"], 9), r["lg"]) for r in want.collect()}
    assert a == b


def test_exact_quantiles(spark):
    import numpy as np
    from respscore.operators import profile as PR
    rnd = np.random.default_rng(5)
    vals = list(rnd.normal(size=500)) + [3.0] * 200 + [float(i) for i in range(40)]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = {r["q"]: r["value"] for r in PR.exact_quantiles(df, ["x"], (0.1, 0.25, 0.5, 0.75, 0.99)).collect()}
    for q, v in got.items():
        assert abs(v - float(np.quantile(vals, q))) < 1e-9


def test_exact_quantiles_of_heavy_tails(spark):
    """Values over twenty orders of magnitude, one value in a third of the rows, a constant and an empty column."""
    import numpy as np
    from respscore.operators import profile as PR
    rnd = np.random.default_rng(9)
    heavy = np.concatenate([np.exp(rnd.normal(size=3000) * 8), np.zeros(1500)])
    df = spark.createDataFrame([(float(v), 7.0, None) for v in heavy], "x double, c double, e double").repartition(5)
    got = {(r["column"], r["q"]): r["value"] for r in PR.exact_quantiles(df, ["x", "c", "e"], (0.0, 0.2, 0.5, 0.9, 1.0)).collect()}
    assert {k for k, _ in got} == {"x", "c"}
    for (c, q), v in got.items():
        assert v == (7.0 if c == "c" else pytest.approx(float(np.quantile(heavy, q)), rel=1e-9))


def test_ranks_of_a_hot_group(spark):
    """A group with a third of the rows, a null group and an ungrouped rank; partitions stay even."""
    from pyspark.sql import Window
    df = spark.range(0, 30_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 1000 == 1, None)
                                       .otherwise((F.col("id") % 200).cast("int")).alias("g")).repartition(4)
    for group in (["g"], []):
        want = df.withColumn("want", F.row_number().over(Window.partitionBy(*group).orderBy("k")))
        got = RK.rank_within(df, group=group, order=["k"])
        assert got.count() == 30_000
        assert got.join(want.select("k", "want"), "k").where("rank <> want").count() == 0
        sums = RK.running_sum(df.withColumn("v", F.col("k") % 5), group, ["k"], "v", "upto")
        want = df.withColumn("want", F.sum(F.col("k") % 5).over(Window.partitionBy(*group).orderBy("k")))
        assert sums.join(want.select("k", "want"), "k").where("upto <> want").count() == 0
    sizes = [r["n"] for r in df.repartitionByRange("g", "k").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2 * 30_000 / len(sizes)
    assert RK.rank_within(df.limit(0), order=["k"]).count() == 0


def test_v2_features_vary(spark):
    """Marks, capitals and digits of the original text survive the correction."""
    from respscore.plans.feature_table_v2 import raw_features_v2
    from respscore.sources import fixtures as FX
    raw = raw_features_v2(FX.responses(spark, SF001), FX.prompts(spark, SF001), FX.dictionary(spark, SF001))
    r = raw.agg(*[F.count_distinct(c).alias(c) for c in ("entities", "punctuation_cnt", "text_pos", "distance")]).first()
    assert all(n > 1 for n in r), r
