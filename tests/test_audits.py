from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import functions as F

from framewright.functions import answers as A
from framewright.functions import statistics as S
from framewright.operators import frontier as FR
from framewright.operators import quality
from framewright.operators import sequence as SQ
from framewright.sources import files


def rows(n=400, seed=3):
    r = random.Random(seed)
    return [("ab"[i % 2], f"c{r.randint(0, 40)}", r.choice([1.0, 2.0, 3.0, 4.0, 5.0, 7.5]), r.randint(0, 1), "clash") for i in range(n)] + [("a", "c1", None, 1, "x"), ("b", None, 2.0, None, "x"), (None, "c2", 3.0, 1, "x"), (None, "c3", 1.0, 0, "x")]


def auc(s, y, w):
    p = n = won = 0.0
    for a, b, u in zip(s, y, w):
        if b:
            p += u
            won += u * sum(v * (1 if c < a else 0.5 if c == a else 0) for c, d, v in zip(s, y, w) if not d)
        else:
            n += u
    return won / (p * n) if p * n else None


def test_bootstrap_of_auc_against_brute_force(spark):
    d = spark.createDataFrame(rows(120), "g string, c string, s double, y int, auc string").drop("auc")
    got = {r.g: r for r in S.bootstrap_auc(d, ["g"], "c", "s", "y", 40, seed=9).collect()}
    kept = d.filter("s IS NOT NULL AND y IS NOT NULL").withColumn("h", F.xxhash64(F.lit(9), "g", "c")).collect()
    draw = S._poisson(40, 9)
    for g in ("a", "b", None):
        mine = [r for r in kept if r.g == g]
        s, y = [r.s for r in mine], [r.y for r in mine]
        w = draw(np.array([r.h for r in mine], np.int64).astype(np.uint64))
        drawn = sorted(x for x in (auc(s, y, w[:, k]) for k in range(40)) if x is not None)
        assert abs(got[g].auc - auc(s, y, [1] * len(s))) < 1e-9
        assert abs(got[g].low - drawn[int(0.025 * (len(drawn) - 1))]) < 1e-9 and abs(got[g].high - drawn[int(0.975 * (len(drawn) - 1))]) < 1e-9
    assert S.bootstrap_auc(d.limit(0), ["g"], "c", "s", "y", 5).count() == 0


def test_index_rules_of_the_bootstrap(spark):
    d = spark.createDataFrame(rows(), "g string, c string, s double, y int, x string")
    a = {r.g: r for r in S.bootstrap(d, ["g"], "c", "s", 200, rule="A").collect()}
    b = {r.g: r for r in S.bootstrap(d, ["g"], "c", "s", 200).collect()}
    c = d.filter("g = 'a' AND s IS NOT NULL").groupBy("c").agg(F.sum("s").alias("s"), F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(20260427), F.lit("a"), "c")).collect()
    w = S._poisson(200, 20260427)(np.array([r.h for r in c], np.int64).astype(np.uint64))
    m = np.sort(np.array([r.s for r in c]) @ w / (np.array([r.n for r in c]) @ w))
    assert abs(a["a"].low - m[5]) < 1e-9 and abs(a["a"].high - m[194]) < 1e-9
    assert abs(b["a"].low - m[4]) < 1e-9 and abs(b["a"].high - m[194]) < 1e-9


def test_ranks_of_awkward_values(spark):
    vals = [0.0, -0.0, 1e-300, -1e300, 5.0, 5.0, float("inf"), float("-inf"), float("nan"), None, 2.5, 2.4999999, -3.0]
    d = spark.createDataFrame([("g", v, "x") for v in vals] + [("one", 7.0, "x"), ("none", None, "x"), (None, 1.0, "x"), (None, 3.0, "x")], "g string, v double, _cell2 string")
    n = 12
    got = {r.g: r for r in S.select_ranks(d, ["g"], "v", {"lo": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "hi": lambda n: n - 1}).collect()}
    order = [float("-inf"), -1e300, -3.0, 0.0, 0.0, 1e-300, 2.4999999, 2.5, 5.0, 5.0, float("inf")]
    assert got["g"].lo == float("-inf") and got["g"].mid == order[n // 2] and got["g"].hi != got["g"].hi
    assert got["one"].lo == got["one"].hi == 7.0 and "none" not in got and got[None].hi == 3.0
    p = {r.g: r.m for r in S.percentile(d.filter("g IS NULL OR g = 'one'"), ["g"], "v", {"m": 0.5}).collect()}
    assert p == {None: 2.0, "one": 7.0}
    ranks = {(r.g, r.v): r.rank for r in S.average_rank(d.filter("v = 5.0 OR v = 2.5 OR v = -3.0"), ["g"], "v").collect()}
    assert ranks == {("g", -3.0): 1.0, ("g", 2.5): 2.0, ("g", 5.0): 3.5}


def test_numbers_and_spans_over_stretches(spark):
    ids = [0, 3, 4, 9, 10, 11, 25, 26, 40]
    d = spark.createDataFrame([("k", i, "x") for i in ids] + [(None, 7, "y"), (None, 2, "z")], "k string, i bigint, t string")
    got = {(r.k, r.i): r.n for r in SQ.numbered(d, ["k"], "i", "n", stretch=5).collect()}
    assert got == {**{("k", i): n for n, i in enumerate(ids)}, (None, 2): 0, (None, 7): 1}
    spans = {(r.k, r.i): (r.span_from, r.span_to) for r in SQ.spans(d, ["k"], "i", stretch=5).collect()}
    assert spans == {**{("k", i): (p + 1, i) for p, i in zip(ids, ids[1:])}, ("k", 0): (0, 0), (None, 2): (2, 2), (None, 7): (3, 7)}
    assert SQ.numbered(d.limit(0), ["k"], "i", "n").count() == 0


def test_skylines_against_brute_force(spark):
    r = random.Random(4)
    pts = [(i, float(r.randint(0, 30)), float(r.randint(0, 30)), float(r.randint(0, 5))) for i in range(300)] + [(900, None, 1.0, 1.0), (901, -5.0, -5.0, 5.0), (902, 0.0, 30.0, 5.0)]
    d = spark.createDataFrame(pts, "id int, c double, s double, t double")
    full = [p for p in pts if None not in p]
    two = {p[0] for p in full if not any(q[1] <= p[1] and q[2] >= p[2] and (q[1] < p[1] or q[2] > p[2]) for q in full)}
    three = {p[0] for p in full if not any(q[1] <= p[1] and q[2] >= p[2] and q[3] >= p[3] and q[1:] != p[1:] for q in full)}
    assert {x.id for x in FR.skyline(d, "c", "s").collect()} == two
    assert {x.id for x in FR.skyline_3d(d, "c", "s", "t").collect()} == three
    assert FR.skyline_3d(d.limit(0), "c", "s", "t").count() == 0 and FR.skyline(d.limit(0), "c", "s").count() == 0


def test_letters_classes_and_paths(spark):
    lines = [json.dumps({"v": x}) for x in (3, 25, 26, "b", " C ", "4", "99", True, None, 1.5, [1])] + ["{}"]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, p string").select("i", A.normalised_letter(F.try_variant_get(F.try_parse_json("p"), "$.v", "variant")).alias("l"))
    assert [r.l for r in d.orderBy("i").collect()] == ["D", "Z", None, "B", "C", "E"] + [None] * 6
    paths = spark.createDataFrame([(None,), ("/x",), ("~/x",), ("results/x",), ("other/x",), ("data/x",)], "p string")
    assert [r.x for r in paths.select(quality.path_problem(F.col("p"), ("data",)).alias("x")).collect()] == ["missing", "absolute", "home", "generated", "unknown root", None]


def test_files_are_replaced_whole_and_hashed(spark, tmp_path):
    at = f"{tmp_path}/out"
    files.write_json(spark.range(3), at)
    files.write_json(spark.range(5), at)
    assert spark.read.json(at).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["out"]
    for d in ("a", "b"):
        (tmp_path / d / "sub").mkdir(parents=True)
        (tmp_path / d / "x.bin").write_bytes(b"one")
        (tmp_path / d / "sub" / "y.bin").write_bytes(b"two")
    one, two = (files.directory_hash(spark, f"{tmp_path}/{d}") for d in ("a", "b"))
    (tmp_path / "b" / "x.bin").write_bytes(b"One")
    assert one == two != files.directory_hash(spark, f"{tmp_path}/b")
