from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from framewright.llm import packing, percentiles as P, queries


def exact(values, permille):
    v = sorted(values)
    return v[max(1, (len(v) * permille + 999) // 1000) - 1]


def data(spark, rows):
    return spark.createDataFrame(rows, "g string, day int, metric_a double, value string, lo int, metric string")


def test_bisection_and_summaries(spark):
    r = random.Random(6)
    pool = [0.0, -0.0, 1e-300, -1e300, 1e300, 5e-324, float("nan"), float("inf"), float("-inf"), None, -3.5, 7.25, 7.25]
    rows = [(r.choice(["a", "a", "b", None]), r.randint(0, 3), r.choice([*pool, r.lognormvariate(5, 3), -r.random()]), "x", 1, "m") for _ in range(3000)]
    d = data(spark, rows)
    long = P.to_long(d.select("g", "day", "metric_a"), ["g"], ["metric_a"], extra=["day"])
    want = {}
    for g in ("a", "b", None):
        v = [x for h, _, x, *_ in rows if h == g and x is not None and math.isfinite(x)]
        want |= {(g, q): (exact(v, q), len(v)) for q in (0, 1, 500, 900, 999, 1000)}
    got = {(x.g, x.permille): (x.value, x.n_values) for x in P.bisect_percentiles(long, ["g"], (0, 1, 500, 900, 999, 1000)).collect()}
    assert got == want
    daily = P.summarize(long, ["g", "day"])
    est = {(x.g, x.permille): x.value for x in P.estimate(P.merge(daily, ["g"]), ["g"], (0, 1, 500, 900, 999, 1000)).collect()}
    assert est.keys() == want.keys()
    for k, v in est.items():
        assert abs(v - want[k][0]) <= P.error_bound() * abs(want[k][0]) + 5e-324
    again = {(x.g, x.permille): x.value for x in P.bisect_percentiles(long, ["g"], (500,), P.merge(daily, ["g"])).collect()}
    assert again == {k: v[0] for k, v in want.items() if k[1] == 500}


def test_ties_empty_and_null_only(spark):
    d = data(spark, [("a", 1, 2.0, "x", 1, "m")] * 9 + [("n", 1, None, "x", 1, "m")])
    long = P.to_long(d.select("g", "metric_a"), ["g"], ["metric_a"])
    assert [(x.g, x.value, x.n_values) for x in P.bisect_percentiles(long, ["g"], (500,)).collect()] == [("a", 2.0, 9)]
    assert P.bisect_percentiles(long.limit(0), ["g"], (500,)).count() == 0


def reference(sizes, capacity, open_bins):
    free: list[list[int]] = []  # [free, container], open
    out, made = [], 0
    for s in sizes:
        fits = [b for b in free if b[0] >= s]
        if fits:
            b = min(fits, key=lambda x: x[0])
        else:
            if len(free) == open_bins:
                free.remove(min(free, key=lambda x: x[0]))
            b = [capacity, made]
            made += 1
            free.append(b)
        out.append(capacity - b[0])
        b[0] -= s
        if b[0] == 0:
            free.remove(b)
    return out, made


def test_best_fit_against_plain_lists():
    r = random.Random(3)
    for _ in range(30):
        sizes = [r.randint(0, 50) for _ in range(200)]
        bins, offsets, _ = packing.best_fit(sizes, 50, 5)
        used: dict[int, int] = {}
        for b, o, s in zip(bins, offsets, sizes):
            assert used.get(b, 0) == o
            used[b] = o + s
        assert max(used.values()) <= 50
        assert len(used) == reference(sizes, 50, 5)[1]


def place(spark, docs, specs, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, spec_id int, n_tokens int, _row int")
    s = spark.createDataFrame(specs, "spec_id int, spec_name string, capacity_tokens int")
    return packing.pack(d, s, **kw).collect()


def test_pack_places_every_text(spark, monkeypatch):
    monkeypatch.setattr(packing, "TOKENS_PER_SHARD", 400)
    r = random.Random(1)
    docs = [(i if i % 9 else None, " ".join(["word"] * r.randint(1, 60)), 7, 7, 7) for i in range(120)] + [(5, None, 0, 0, 0), (6, "", 0, 0, 0), (777, "long " * 5000, 0, 0, 0), (777, "long " * 5000, 0, 0, 0)]
    out = place(spark, docs, [(1, "a", 64), (2, "b", 200), (3, "zero", 0), (4, "null", None)])
    size = {1: 64, 2: 200}
    assert {x.spec_id for x in out} == {1, 2}
    enc = packing.encoder(packing.TOKENIZER)
    total = sum(len(enc.encode_ordinary(t)) for _, t, *_ in docs if t)
    for s, cap in size.items():
        rows = [x for x in out if x.spec_id == s]
        assert sum(x.n_tokens for x in rows) == total
        whole = [x for x in rows if x.piece_no == 0]
        assert len(whole) == len(docs)
        by: dict[str, list] = {}
        for x in rows:
            by.setdefault(x.container_id, []).append((x.offset_tokens, x.n_tokens))
        for parts in by.values():
            end = 0
            for o, n in sorted(parts):
                assert o == end
                end += n
            assert end <= cap
        assert all(x.n_tokens == cap for x in rows if any(y.piece_no == x.piece_no + 1 and y.doc_id == x.doc_id and x.doc_id == 777 for y in rows))
        assert len(by) <= math.ceil(total / cap) * 1.1 + 2


def test_pack_nothing(spark):
    assert place(spark, [], [(1, "a", 64)]) == []
    assert place(spark, [(1, "x", 0, 0, 0)], []) == []


def test_many_intervals_are_joined_over_salts(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_INTERVALS", 0)
    r = random.Random(8)
    rows = [("hot" if i % 3 else "cold", 1, r.choice([r.lognormvariate(5, 2), 4.5, -2.0]), "x", 1, "m") for i in range(2000)]
    long = P.to_long(data(spark, rows).select("g", "metric_a"), ["g"], ["metric_a"])
    got = {(x.g, x.permille): x.value for x in P.bisect_percentiles(long, ["g"], (100, 500, 990)).collect()}
    assert got == {(g, q): exact([x for h, _, x, *_ in rows if h == g], q) for g in ("hot", "cold") for q in (100, 500, 990)}


def test_neighbouring_subnormals_are_told_apart(spark):
    v = [n * 5e-324 for n in range(180, 400)]
    long = P.to_long(data(spark, [("a", 1, s * x, "x", 1, "m") for x in v for s in (1, -1)]).select("g", "metric_a"), ["g"], ["metric_a"])
    got = {x.permille: x.value for x in P.bisect_percentiles(long, ["g"], (10, 250, 500, 900, 999)).collect()}
    assert got == {q: exact([s * x for x in v for s in (1, -1)], q) for q in (10, 250, 500, 900, 999)}


def test_query_counts_nan_and_infinite_timings(spark, tmp_path):
    r = random.Random(9)
    pool = [float("inf"), float("-inf"), float("nan"), None]
    rows = [(i, ("a", None)[i % 2], "g", "dense", r.choice([*pool, r.lognormvariate(5, 2), r.lognormvariate(5, 2)]), float("nan") if i % 2 else 1.5) for i in range(400)]
    d = spark.createDataFrame(rows, "result_id bigint, benchmark string, item_group string, arm string, end_to_end_ms double, generate_ms double")
    d.selectExpr("*", "timestamp'2026-01-01' AS finished_at", "timestamp'2026-01-02' AS ingested_at").write.parquet(f"{tmp_path}/item_results.parquet")

    def key(x):  # NaN is the greatest value
        return (math.isnan(x), 0 if math.isnan(x) else x)

    want = {}
    for b in ("a", None):
        for at, metric in ((4, "end_to_end_ms"), (5, "generate_ms")):
            v = sorted(key(x[at]) for x in rows if x[1] == b and x[at] is not None)
            want |= {(b, metric, q): (len(v), exact(v, q)) for q in queries.PERMILLE}
    assert {v for _, v in want.values()} >= {key(x) for x in pool[:3]}
    got = {(x.benchmark, x.metric, x.permille): (x.n_values, key(x.value)) for x in queries.p5_percentiles(spark, str(tmp_path)).collect()}
    assert got == want
    merged = {(x.benchmark, x.metric, x.permille): (x.n_values, key(x.value)) for x in queries.p5_merged(spark, str(tmp_path)).collect()}
    assert merged.keys() == want.keys()
    for k, (n, (nan, x)) in want.items():
        assert merged[k][0] == n and merged[k][1][0] == nan
        assert merged[k][1][1] == x or abs(merged[k][1][1] - x) <= P.error_bound() * abs(x)
