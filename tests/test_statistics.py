from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from framewright.functions import statistics as S
from framewright.operators import codec as C
from framewright.operators import frames as B
from framewright.operators import pairing as P
from framewright.operators import sequence as SQ

R = random.Random(21)


def test_kappa_with_null_as_a_category(spark):
    rows = [(R.choice(["a", "b", None]), R.choice(["a", "b", None])) for _ in range(120)]
    n = len(rows)
    o = sum(x == y for x, y in rows) / n
    ca, cb = Counter(x for x, _ in rows), Counter(y for _, y in rows)
    e = sum(ca[k] * cb[k] for k in ca) / n / n
    got = S.kappa(spark.createDataFrame([("g", *r) for r in rows], "g string, x string, y string"), ["g"], "x", "y").first().kappa
    assert abs(got - (o - e) / (1 - e)) < 1e-12
    same = spark.createDataFrame([("g", "a", "a")] * 3, "g string, x string, y string")
    assert S.kappa(same, ["g"], "x", "y").first().kappa == 1.0


def test_bins_round_half_to_even(spark):
    d = spark.createDataFrame([("g", i) for i in range(10)], "g string, v int")
    n = {r.bin: r.n for r in S.equal_count_bins(d, ["g"], "v", [], 4).groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 2, 1: 3, 2: 3, 3: 2}  # edges 2.5 -> 2, 5, 7.5 -> 8


def test_index_percentile_is_no_built_in(spark):
    v = [R.random() for _ in range(37)]
    d = spark.createDataFrame([("g", x) for x in v] + [("g", None), ("n", None)], "g string, v double")
    got = {r.g: (r.p50, r.p90) for r in S.index_percentile(d, ["g"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert got == {"g": (sorted(v)[int(0.5 * 36)], sorted(v)[int(0.9 * 36)])}


def test_safe_filter_against_all_thresholds(spark):
    rows = [("g", float(R.randint(0, 9)), R.choice([0, 0, 1])) for _ in range(150)]
    best = None
    for t in sorted({s for _, s, _ in rows}):
        kept = [y for _, s, y in rows if s >= t]
        if kept.count(0) / len(kept) >= 0.65 and (best is None or len(kept) > best[1]):
            best = (t, len(kept))
    got = S.safe_filter(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y", 0.65).collect()
    assert [(r.threshold, round(r.coverage * len(rows))) for r in got] == ([best] if best else [])


def test_wilson_without_trials(spark):
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    clo, _ = S.wilson(F.col("k"), F.col("n"), clamp=True)
    a, b = spark.createDataFrame([(0, 0), (3, 10)], "k int, n int").select(lo.alias("lo"), hi.alias("hi"), clo.alias("c")).collect()
    assert (a.lo, a.hi, a.c) == (0.0, 0.0, None) and 0 < b.lo < 0.3 < b.hi < 1


def test_logistic_fit_separates(spark):
    rows = [(x, y := R.gauss(0, 1), 1 if x + 0.1 * y > 0 else 0) for x in (R.gauss(0, 1) for _ in range(300))]
    d = spark.createDataFrame(rows, "a double, b double, y int")
    w = S.logistic_fit(d, ["a", "b"], "y", steps=25, rate=2.0)
    right = d.select((S.logistic_score(["a", "b"], w) > 0.5).cast("int").alias("p"), "y").filter("p = y").count()
    assert right > 280
    assert S.logistic_fit(d.limit(0), ["a"], "y") == [0.0, 0.0]


def test_logistic_query_is_at_the_optimum(spark, monkeypatch):
    import numpy as np

    from framewright.plans import runs

    raw = [(i, R.random() < 0.2 + 0.6 * (i % 7 > 3), R.uniform(10, 5000) * (1 + i % 7), R.randint(100, 900)) for i in range(300)]
    d = spark.createDataFrame(raw, "result_id int, correct boolean, generate_ms double, prompt_tokens int")
    monkeypatch.setattr(runs, "_results", lambda *_: d)
    got = {r.result_id: r.p for r in runs.logistic_drift(spark, "").collect()}
    f = np.array([(math.log(m + 1), t) for _, _, m, t in raw])
    x = np.concatenate([np.ones((300, 1)), (f - f.mean(axis=0)) / f.std(axis=0)], axis=1)
    y, w = np.array([float(c) for _, c, _, _ in raw]), np.zeros(3)
    for _ in range(5000):  # the reference's rate and l2
        w -= 0.05 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / 300 + np.array([0, 0.01, 0.01]) * w)
    assert max(abs(got[i] - 1 / (1 + math.exp(-x[i] @ w))) for i in range(300)) < 2e-6
    assert S.logistic_optimum(d.limit(0), ["generate_ms"], "correct") == [0.0, 0.0]


def test_bootstrap_query_has_the_replicates_of_the_reference(spark, monkeypatch):
    from framewright.plans import runs

    d = spark.createDataFrame([("a", "x", f"i{i}", i % 4 == 0) for i in range(400)] + [("b", None, "i", True)], "arm string, benchmark string, item_id string, correct boolean")
    asked = []
    real = S.bootstrap
    monkeypatch.setattr(runs, "_results", lambda *_: d)
    monkeypatch.setattr(S, "bootstrap", lambda *a, **k: asked.append(a[4]) or real(*a, **k))
    got = {r.arm: r for r in runs.bootstrap_accuracy(spark, "").collect()}
    half = 1.96 * math.sqrt(0.25 * 0.75 / 400)
    assert asked == [10_000] and got["b"].low == got["b"].high == 1.0 and got["b"].benchmark is None
    assert abs(got["a"].mean - 0.25) < 1e-12 and abs(got["a"].low - 0.25 + half) < 0.004 and abs(got["a"].high - 0.25 - half) < 0.004


def test_as_of_floor_against_brute_force(spark):
    curve = {(g, k): R.random() for g in "ab" for k in R.sample(range(20), 6)}
    left = [(i, R.choice("abc"), R.randint(-3, 25)) for i in range(60)]
    want = {}
    for i, g, at in left:
        keys = sorted(k for h, k in curve if h == g)
        low = [k for k in keys if k <= at]
        want[i] = curve[g, low[-1] if low else keys[0]] if keys else None
    d = P.as_of_floor(spark.createDataFrame(left, "i int, g string, at int"), spark.createDataFrame([(g, k, v) for (g, k), v in curve.items()], "g string, k int, v double"), "at", "k", "v", ["g"])
    assert {r.i: r.v for r in d.collect()} == want


def test_digest_depends_on_order_not_on_chunks(spark):
    rows = [(1, i, str(i)) for i in range(10)] + [(2, i, str(9 - i)) for i in range(10)]
    d = spark.createDataFrame(rows, "k int, i int, v string")
    a, b = (r.digest for r in SQ.sequence_digest(d, ["k"], "i", F.col("v"), 4).orderBy("k").collect())
    again = {r.digest for r in SQ.sequence_digest(d.repartition(3), ["k"], "i", F.col("v"), 4).collect()}
    assert a != b and again == {a, b}


def test_components_and_bicubic(spark):
    grid = [True, True, False, False, False, True, True, False, True]
    d = spark.createDataFrame([(1, 0, grid), (1, 1, [False] * 9)], "clip int, t bigint, m array<boolean>")
    got = {r.t: (r.n_components, round(r.largest_share, 6)) for r in C.components(d, "m", 3).collect()}
    assert got == {0: (3, 0.4), 1: (0, 0.0)}
    flat = spark.createDataFrame([(1, 0, [2.5] * 16)], "clip int, t bigint, g array<double>")
    out = B.bicubic(flat, "g", (4, 4), (6, 6)).first().plane
    assert len(out) == 36 and all(math.isclose(x, 2.5) for x in out)


def test_macroblock_rules(spark):
    d = spark.createDataFrame([(1, 2.0, 0.0, 16, 8), (1, 0.0, 2.0, 16, 8), (2, 1.0, 1.0, 0, 0)], "mb int, dx double, dy double, w int, h int")
    got = {r.mb: (r.mv_x, r.mv_y, r.partition_type) for r in C.macroblocks(d, ["mb"]).collect()}
    assert got == {1: (1.0, 1.0, 1), 2: (None, None, 4)}
    f = spark.createDataFrame([(10.0, "P", False), (100.0, "P", False), (10.0, "I", False), (None, "P", False)], "s double, k string, key boolean")
    assert [r.x for r in f.select(C.early_exit(F.col("s"), F.col("key"), F.col("k"), F.lit(1000.0)).alias("x")).collect()] == ["ALL_STATIC", None, None, None]
