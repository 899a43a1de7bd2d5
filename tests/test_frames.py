from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import frames as B
from framewright.operators import reuse as R
from framewright.operators import selection as L
from framewright.streaming import stateful


def one(spark, **arrays):
    d = spark.range(1)
    for k, v in arrays.items():
        d = d.withColumn(k, F.array(*[F.lit(float(x)) for x in v]))
    return d


def test_block_classes(spark):
    plane = [0.0] * 16
    for y in (0, 1):
        for x in (2, 3):
            plane[y * 4 + x] = 5.0
    for y in (2, 3):
        for x in (0, 1):
            plane[y * 4 + x] = 20.0
    d = one(spark, p=plane).select(B.classify(B.block_scores(F.col("p"), B.mean, 4, 4, 2), 3.0, 8.0).alias("c"))
    assert d.first().c == [0, 1, 2, 0]
    with pytest.raises(ValueError):
        B.classify(F.col("p"), 8.0, 3.0)


def test_neighbours_stop_at_the_border(spark):
    ring = one(spark, g=[0, 0, 0, 0, 5, 0, 0, 0, 0]).select(B.neighbour_max(F.col("g"), 3, 3).alias("n")).first().n
    assert ring == [5, 5, 5, 5, 0, 5, 5, 5, 5]
    edge = one(spark, g=[0, 0, 0, 0, 0, 0, 0, 0, 10]).select(B.neighbour_max(F.col("g"), 3, 3).alias("n")).first().n
    assert edge[8] == 0 and edge[4] == 10 and edge[0] == 0


def test_summary_of_nothing_and_cosine(spark):
    d = spark.range(1).select(F.array().cast("array<int>").alias("c")).select(*B.class_summary(F.col("c"))).first()
    assert d.reused_ratio == 0.0 and d.novel_ratio == 0.0
    c = one(spark, a=[1, 2], b=[1, 2], n=[-1, -2], z=[0, 0]).select(B.cosine(F.col("a"), F.col("b")).alias("x"), B.cosine(F.col("a"), F.col("n")).alias("y"), B.cosine(F.col("a"), F.col("z")).alias("w")).first()
    assert (round(c.x, 9), round(c.y, 9), c.w) == (1.0, -1.0, None)


def test_previous_frame_over_chunks(spark):
    rows = [(c, t, [float(t)]) for c in (1, 2) for t in range(11)]
    d = B.with_previous(spark.createDataFrame(rows, "clip int, t bigint, plane array<double>"), chunk=3).collect()
    assert len(d) == 22 and all((r.prev is None) == (r.t == 0) and (r.t == 0 or r.prev == [r.t - 1.0]) for r in d)


def simulate(rs, sticky, refresh, max_age):
    age = src = 0
    latched, win, out = False, 0, []
    epoch = 0
    for t, r in enumerate(rs, 1):
        e, w = (t // refresh if refresh else 0), (t // sticky if sticky else 0)
        if e != epoch:
            age, latched = 0, False
        if w != win:
            latched = False
        epoch, win = e, w
        now = bool(refresh) and t % refresh == 0
        eff = r and not now
        if sticky and not now:
            latched = latched or not r
            eff = eff and not latched
        ok = eff and (max_age is None or age < max_age)
        age = age + 1 if ok else 0
        src = src if ok else t
        out.append((eff, ok, src))
    return out


@pytest.mark.parametrize(("sticky", "refresh", "max_age"), [(None, None, None), (3, None, 1), (2, 5, 2), (None, 3, 2), (4, None, None)])
def test_reuse_closed_form_and_stream(spark, sticky, refresh, max_age, tmp_path):
    r = random.Random(5)
    traces = {b: [r.random() < 0.75 for _ in range(25)] for b in range(8)}
    d = spark.createDataFrame([(1, t, b, x) for b, xs in traces.items() for t, x in enumerate(xs, 1)], "clip int, t bigint, b int, r boolean")
    want = {(b, t): v for b, xs in traces.items() for t, v in enumerate(simulate(xs, sticky, refresh, max_age), 1)}
    got = {(x.b, x.t): (x.eff, x.allowed, x.src) for x in R.reuse_states(d, sticky, refresh, max_age).collect()}
    assert got == want
    if sticky == 2:
        d.write.parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        assert {(x.b, x.t): (x.eff, x.allowed, x.src) for x in stateful.drain(stateful.reuse_stream(s, sticky, refresh, max_age)).collect()} == want


def test_ties_and_indices(spark):
    d = spark.createDataFrame([(1, i, 1.0) for i in range(4)], "f int, k int, s double")
    low = L.top_k(d, ["f"], [F.desc("s"), F.col("k")], 2).filter("keep").collect()
    high = L.top_k(d, ["f"], [F.desc("s"), F.desc("k")], 2).filter("keep").collect()
    assert {r.k for r in low} == {0, 1} and {r.k for r in high} == {2, 3}
    assert L.top_k(d, ["f"], [F.col("k")], 0).filter("keep").count() == 0
    assert spark.range(1).select(L.uniform_indices(F.lit(10), 4).alias("i")).first().i == [0, 3, 6, 9]


def test_farthest_first_against_brute_force(spark):
    r = random.Random(2)
    x = {k: [r.random(), r.random()] for k in range(9)}
    d = spark.createDataFrame([(1, k, v) for k, v in x.items()], "f int, k int, e array<double>")
    got = [row.k for row in L.farthest_first(d, ["f"], "k", "e", 4).orderBy("pick").collect()]
    want = [max(x, key=lambda k: (sum(map(abs, x[k])), -k))]
    while len(want) < 4:
        want.append(max((k for k in x if k not in want), key=lambda k: (min(sum((a - b) ** 2 for a, b in zip(x[k], x[w])) for w in want), -k)))
    assert got == want


def test_blocks_must_fill_the_plane():
    with pytest.raises(ValueError):
        B.block_values(F.col("plane"), 9, 8, 2)
