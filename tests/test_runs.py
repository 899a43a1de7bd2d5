from __future__ import annotations

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from framewright.functions import answers as A
from framewright.functions import statistics as S
from framewright.operators import frontier as FR
from framewright.operators import pairing as P
from framewright.operators import quality, sequence
from framewright.sources import files


def test_strict_pairs_refuse(spark):
    a = spark.createDataFrame([(1, 2), (2, 3)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    assert {tuple(r) for r in P.strict_pairs(a, b, ["k"]).collect()} == {(1, 2, 5), (2, 3, 6)}
    with pytest.raises(ValueError):
        P.strict_pairs(a.union(a), b, ["k"])
    with pytest.raises(ValueError):
        P.strict_pairs(a, b.filter("k = 1"), ["k"])


def test_overlap_of_empty_sets(spark):
    e = spark.createDataFrame([], "k int")
    assert P.overlap_stats(e, e, ["k"]).first().jaccard == 1.0


def test_auc_against_pairs(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), float(r.randint(0, 6)), r.choice([0, 1, 1, None])) for _ in range(200)]
    got = {x.g: x.auc for x in S.auc(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect()}
    for g in "ab":
        p, n = ([s for h, s, y in rows if h == g and y == v] for v in (1, 0))
        assert abs(got[g] - sum((a > b) + (a == b) / 2 for a in p for b in n) / len(p) / len(n)) < 1e-12
    assert S.auc(spark.createDataFrame([("a", 1.0, 1)], "g string, s double, y int"), ["g"], "s", "y").first().auc is None


def test_bootstrap_covers_the_mean(spark):
    r = random.Random(1)
    d = spark.createDataFrame([("g", i // 4, float(r.random() < 0.6)) for i in range(2000)], "g string, c int, v double")
    b = S.bootstrap(d, ["g"], "c", "v", 200).first()
    assert b.low < b["mean"] < b.high and 0.02 < b.high - b.low < 0.08


def test_frontier_against_all_choices(spark, monkeypatch):
    r = random.Random(9)
    rows = []
    arms = []
    for s in range(7):
        pair = []
        for a in ("pruned_q0", "dense_q0"):
            sc, cc, sm, cm = r.randint(0, 3), r.randint(0, 3), r.uniform(1, 5), r.uniform(5, 20)
            pf = r.randint(0, 2)
            rows.append((s, a, "short", "dev", sc, cc, r.randint(0, 1), sm, cm, pf, 0, datetime(2031, 1, 1)))
            pair.append((sc - cc, cm - 3 * sm, sm, cm, int(a == "dense_q0"), pf))
        arms.append(pair)
    d = spark.createDataFrame(rows, "session_key int, arm_name string, duration string, split string, stream_correct int, cold_correct int, q0_stream_correct int, stream_total_ms double, cold_total_ms double, parse_failures int, degenerates int, ingested_at timestamp")
    want: dict[int, tuple] = {}
    for choice in itertools.product(*arms):
        k, *v = (sum(c[i] for c in choice) for i in range(6))
        want[k] = max(want.get(k, (float("-inf"),)), tuple(v))
    for part, fan in ((400, 8), (2, 2)):
        monkeypatch.setattr(FR, "PART", part)
        monkeypatch.setattr(FR, "FAN", fan)
        f = FR.admission_frontier(FR.session_pairs(d))
        got = {x.delta: (x.slack, x.stream_ms, x.cold_ms, x.n_dense, x.parse_failures) for x in f.collect()}
        assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))
    points = FR.frontier_points(f, spark.createDataFrame([("dev", 7)], "split string, n_sessions int"))
    picks = {x.pick: x.delta for x in FR.best_points(points).collect()}
    ok = [k for k, v in want.items() if abs(k / 21) <= 0.05 and v[2] / v[1] >= 3]
    assert len(picks) == 6 and picks["best_strict"] == max(ok, default=None)
    assert picks["best_accuracy_at_or_above_3x"] == max((k for k, v in want.items() if v[2] / v[1] >= 3), default=None)
    assert FR.admission_frontier(FR.session_pairs(d.limit(0))).count() == 0


def test_extract_choice(spark):
    c = ["a red cup", "a blue cup", "no cup"]
    cases = {"B": "B", "because": "B", "I think C is right. A": "C", "it was a blue cup, surely": "B", "nothing": None, "": None, "(A) or (B)": None, "<|im_end|>": None, "D": None}
    d = spark.createDataFrame([(t, c) for t in cases], "t string, c array<string>")
    assert {r.t: r.x for r in d.select("t", A.extract_choice(F.col("t"), F.col("c")).alias("x")).collect()} == cases
    n = spark.createDataFrame([(None, None), ("A", []), ("x", None)], "t string, c array<string>")
    assert [r.x for r in n.select(A.extract_choice(F.col("t"), F.col("c")).alias("x")).collect()] == [None, None, None]


def test_prefixes_and_windows(spark):
    d = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([], [1]), ([1], [1, 2]), (None, [1])], "a array<int>, b array<int>")
    assert [r.n for r in d.select(sequence.common_prefix(F.col("a"), F.col("b")).alias("n")).collect()] == [2, 0, 1, None]
    e = spark.createDataFrame([("u", float(i)) for i in range(30)], "k string, s double")
    p = spark.createDataFrame([("u", 10.0), ("u", 3.0), ("v", 1.0)], "k string, at double")
    got = {r["at"]: r.n for r in sequence.window_join(e, p, ["k"], "s", "at", 5.0).groupBy("at").agg(F.count("*").alias("n")).collect()}
    assert got == {10.0: 5, 3.0: 4}


def test_files_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("b", 2), ("a", 1)], "item_id string, n int")
    files.append_json_lines(d, str(tmp_path / "j"))
    files.append_json_lines(d, str(tmp_path / "j"))
    assert files.json_lines(spark, str(tmp_path / "j"), d.schema).count() == 4
    files.write_csv(d, str(tmp_path / "c"), ["n", "item_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["n", "item_id"]
    files.write_parquet(d, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    files.write_manifest(d, str(tmp_path / "m.toml"), "bench")
    m = files.toml_manifest(spark, str(tmp_path / "m.toml"))
    assert [r.item_id for r in files.items_by_id(d, m).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        files.items_by_id(d.filter("n = 1"), m)
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    assert [(r.line_no, r.payload) for r in files.numbered_lines(spark, str(tmp_path / "x.jsonl")).orderBy("line_no").collect()] == [(1, '{"a": 1}'), (4, '{"a": 2}')]


def test_json_schema_errors(spark):
    d = spark.createDataFrame([(1, '{"a": "x", "b": 1}'), (2, '{"a": 1}'), (3, "[]"), (4, None), (5, "{")], "k int, payload string")
    got = {tuple(r) for r in quality.json_schema_errors(d, "payload", ["k"], {"a": "string", "b": "number"}).collect()}
    assert got == {(2, "a", "type"), (2, "b", "missing"), (3, "", "no object"), (4, "", "no object"), (5, "", "no object")}


def test_skyline_ties_survive(spark):
    r = random.Random(8)
    pts = [(i, r.randint(0, 8), r.randint(0, 8), r.randint(0, 8)) for i in range(80)]
    d = spark.createDataFrame(pts, "i int, c int, s int, t int")
    two = {p[0] for p in pts if not any(q[1] <= p[1] and q[2] >= p[2] and (q[1] < p[1] or q[2] > p[2]) for q in pts)}
    three = {p[0] for p in pts if not any(q[1] <= p[1] and q[2] >= p[2] and q[3] >= p[3] and q[1:] != p[1:] for q in pts)}
    assert {x.i for x in FR.skyline(d, "c", "s").collect()} == two
    assert {x.i for x in FR.skyline_3d(d, "c", "s", "t").collect()} == three
