from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from framewright.operators import copydiff

SCHEMA = "k string, q int, x int, y string, at timestamp, difference string, _b int"
T0 = datetime(2031, 1, 1)


def table(spark, rows):
    return copydiff.latest(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), {"k": F.lower("k"), "q": F.col("q")}, {"x": F.col("x"), "y": F.col("y")}, "at")


def diff(spark, a, b, rows=(256, 4)):
    d = copydiff.copy_differences(table(spark, a), table(spark, b), ("k", "q"), ("x", "y"), ("p", "m"), rows)
    return [tuple(r) for r in d.collect()], d


def brute(a, b):
    def held(rows):
        out = {}
        for k, q, x, y, at in sorted(rows, key=lambda r: (r[4] is not None, r[4] or T0)):
            out[(k.lower() if k is not None else None, q)] = (x, y)
        return out

    p, m = held(a), held(b)
    res = [(*k, "missing_in_m") for k in p if k not in m] + [(*k, "missing_in_p") for k in m if k not in p]
    return res + [(*k, c) for k in p if k in m for i, c in enumerate("xy") if p[k][i] != m[k][i]]


@pytest.mark.parametrize("sizes", [(256, 4), (1, 1), (40, 7)])
def test_against_brute_force(spark, sizes):
    r = random.Random(3)
    rows = [(r.choice("abcdefgh") + str(i % 40), r.choice([0, 1, None]), r.choice([1, 2, None]), r.choice(["u", "v", None]), T0 + timedelta(seconds=i)) for i in range(300)]
    other = [(k, q, x if r.random() < 0.9 else 9, y, at) for k, q, x, y, at in rows if r.random() < 0.97] + [("only", 1, 1, "z", T0)]
    got, _ = diff(spark, rows + rows[:40], other, sizes)
    assert sorted(got, key=str) == sorted(brute(rows, other), key=str)


def test_nulls_long_values_and_empty_copies(spark):
    long = "w" * 200_000
    a = [(None, None, None, None, None), ("A", 1, 1, long, T0)]
    assert diff(spark, a, a)[0] == []
    changed = [(None, None, 1, None, None), ("a", 1, 1, long + "!", T0)]
    assert set(diff(spark, a, changed)[0]) == {(None, None, "x"), ("a", 1, "y")}
    assert {r[2] for r in diff(spark, a, [])[0]} == {"missing_in_m"} and len(diff(spark, [], a)[0]) == 2
    assert diff(spark, [], [])[0] == []


def test_few_differences_are_found_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(copydiff, "COARSE", 8)
    seen = []
    real = copydiff.unequal_buckets
    monkeypatch.setattr(copydiff, "unequal_buckets", lambda *a: seen.append(a[-1]) or real(*a))
    rows = [(f"k{i}", i % 3, i, "v", T0) for i in range(400)]
    other = [(k, q, -1 if k == "k77" else x, y, at) for k, q, x, y, at in rows if k != "k5"]
    got, _ = diff(spark, rows, other, (8, 2))
    assert sorted(got) == [("k5", 2, "missing_in_m"), ("k77", 2, "x")] and seen == [50, 200]
