from __future__ import annotations

import json
import random
from datetime import datetime

from framewright.operators import drift

LINES = "path string, line_no int, payload string, label string, field string, _rescued_x string"
SPECS = "label string, path string, file_no int, written_at timestamp, declared_rows int, field string"
T0 = datetime(2031, 1, 1)


def lines(spark, rows):
    return spark.createDataFrame([(p, n, x if x is None or isinstance(x, str) else json.dumps(x), "l", "f", None) for p, n, x in rows], LINES)


def report(spark, rows, specs):
    leaves = drift.rescued_leaves(lines(spark, rows), {"item_id": "string", "q_index": "integer"}, keep=("path",)).filter("field NOT IN ('item_id', 'q_index')")
    seq = drift.file_sequence(spark.createDataFrame([(*s, T0, None, "x") for s in specs], SPECS))
    return {tuple(r) for r in drift.drift_report(leaves, seq, ("item_id", "q_index")).collect()}


def rec(i, **kw):
    return {"item_id": f"i{i}", "q_index": 0, **kw}


def test_ingest_keeps_what_does_not_fit(spark):
    rows = [("a", 1, rec(1, x=5, y="7", z=[1], n=None)), ("a", 2, '{"item_id": ["odd"], "q_index": "2", "x": "no"}'), ("a", 3, "  "), ("a", 4, None), ("a", 5, "{broken"), ("a", 6, "[1]"), ("a", 7, rec(1, u={"v": {"w": "t" * 100_000}, "e": {}}))]
    out = drift.rescue_ingest(lines(spark, rows), {"item_id": "string", "q_index": "integer", "x": "integer", "y": "integer"}, keep=("line_no",)).collect()
    got = {r.line_no: r for r in out}
    assert set(got) == {1, 2, 7}
    assert (got[1].x, got[1].y) == (5, 7) and json.loads(got[1]._rescued) == {"z": [1], "n": None}
    assert got[2].item_id is None and got[2].q_index == 2 and json.loads(got[2]._rescued) == {"item_id": ["odd"], "x": "no"}
    assert json.loads(got[7]._rescued) == {"u.v.w": "t" * 100_000}


def test_promotion_replays_and_loses_nothing(spark):
    rows = [("a", 1, rec(1, old=1.5, c=True)), ("a", 2, rec(2, new="2.5", c="maybe")), ("a", 3, rec(3, old=1, new=2))]
    ing = drift.rescue_ingest(lines(spark, rows), {"item_id": "string", "q_index": "integer"}, keep=("line_no",))
    out = {r.line_no: r for r in drift.promote(ing, {"v": ("double", ["old", "new"]), "flag": ("boolean", ["c"])}).collect()}
    assert [out[i].v for i in (1, 2, 3)] == [1.5, 2.5, 1.0] and [out[i].flag for i in (1, 2, 3)] == [True, None, None]
    assert [json.loads(out[i]._rescued) for i in (1, 2, 3)] == [{}, {"c": "maybe"}, {"new": 2}]


def test_promotion_by_label(spark):
    rows = [("a", 1, rec(1, old=1.5, c=3)), ("b", 2, rec(2, old="x", c=4)), ("c", 3, rec(3, old=5))]
    src = lines(spark, rows).drop("label").withColumnRenamed("path", "label")
    ing = drift.rescue_ingest(src, {"item_id": "string"}, keep=("line_no", "label"))
    out = {r.line_no: r for r in drift.promote(ing, {"v": ("double", {"a": ["old"], "b": ["c"]})}, by="label").collect()}
    assert [out[i].v for i in (1, 2, 3)] == [1.5, 4.0, None]
    assert json.loads(out[2]._rescued) == {"q_index": 0, "old": "x"} and json.loads(out[3]._rescued) == {"q_index": 0, "old": 5}


def test_report_of_every_kind(spark):
    r = random.Random(1)
    v = {i: r.randint(1, 10**6) for i in range(20)}
    a = [("a", i, rec(i, ms=v[i] / 7, gone="x", kind=i, same=None, flag=i % 2 == 0)) for i in v]
    b = [("b", i, rec(i, t={"ms": v[i] / 7 * 1.01}, kind=float(i) + 0.5 if i else "odd", came=[i], same=None, flag=i % 3 == 0)) for i in v]
    b += b[:5] + [("b", 99, "{cut"), ("b", 98, None)]
    c = [("c", i, rec(i, came=None, kind=None)) for i in v]
    got = report(spark, a + b + c, [("l", "b", 2), ("l", "a", 1), ("l", "c", 3), ("m", "empty", 1)])
    assert got == {
        ("b", "ms", "renamed", "t.ms"), ("b", "gone", "removed", ""), ("b", "kind", "retyped", ""), ("b", "came", "added", ""),
        ("c", "t.ms", "removed", ""), ("c", "same", "removed", ""), ("c", "flag", "removed", ""),
    }


def test_type_without_values_is_the_last_one(spark):
    rows = [("a", 1, rec(1, k=1)), ("b", 1, rec(1, k=None)), ("c", 1, rec(1, k=2)), ("d", 1, rec(1, k="s"))]
    assert report(spark, rows, [("l", p, i) for i, p in enumerate("abcd")]) == {("d", "k", "retyped", "")}


def test_empty_tables(spark):
    assert report(spark, [], []) == set()
    assert report(spark, [("a", 1, rec(1, k=1))], []) == set()


def test_consistent_table_loses_no_value(spark):
    from framewright.plans import general

    sf = "/root/testdata/sf0.001"
    table = general.p1_table(spark, sf)
    assert not any("." in c for c in table.columns)
    got = 0
    for r in table.collect():
        rest = json.loads(r._rescued)
        got += sum(r[c] is not None for c in table.columns if c not in ("path", "line_no", "item_id", "q_index", "_rescued"))
        got += sum(v is not None for v in rest.values())
    seen, want = set(), 0
    for p, n, text in spark.read.parquet(f"{sf}/raw_records.parquet").select("path", "line_no", "payload").collect():
        o = drift.parse_object(text)
        if o is None or (p, n, text) in seen:
            continue
        seen.add((p, n, text))
        want += sum(v is not None for k, v in drift.leaves(o) if k not in ("item_id", "q_index"))
    assert got == want


def test_consistent_table_keeps_labels_off_the_driver(spark, tmp_path, monkeypatch):
    from framewright.plans import general

    sent = []
    frame = type(spark.range(1))
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    rows = {}
    for n in (4, 40):
        recs, specs = [], []
        for k in range(n):
            # old becomes new in every label, but the first never has new
            specs += [(f"l{k}", f"{k}a", 1, T0, None, "x"), (f"l{k}", f"{k}b", 2, T0, None, "x")]
            recs += [(f"{k}a", i, json.dumps(rec(i, old=i * 7 + k, t={"u": "w"}))) for i in range(5)]
            recs += [(f"{k}b", i, json.dumps(rec(i, **{"new" if k else "old": i * 7 + k, "extra": True}))) for i in range(5)]
        recs.append(("unlisted", 1, json.dumps(rec(1, old=1))))
        sf = f"{tmp_path}/{n}"
        spark.createDataFrame(recs, "path string, line_no int, payload string").write.parquet(f"{sf}/raw_records.parquet")
        spark.createDataFrame(specs, SPECS).write.parquet(f"{sf}/source_specs.parquet")
        sent.clear()
        table = general.p1_table(spark, sf)
        rows[n] = sum(map(len, sent))
        assert table.columns == ["path", "line_no", "item_id", "q_index", "extra", "old", "t__u", "_rescued"]
        got = {(r.path, r.line_no): r for r in table.toLocalIterator()}
        assert len(got) == len(recs)
        for k in range(n):
            assert all(got[f"{k}{x}", i].old == i * 7 + k for x in "ab" for i in range(5))
        assert all(r._rescued == "{}" for p, r in got.items() if p[0] != "unlisted") and json.loads(got["unlisted", 1]._rescued) == {"old": 1}
    assert rows[4] == rows[40] > 0


def test_renames_are_united_by_the_name_of_most_files():
    files = {"a": 1, "b": 5, "c": 5, "d": 9}
    assert drift.united([("a", "b"), ("c", "b"), ("x", "d")], files) == {"a": "b", "b": "b", "c": "b", "x": "d", "d": "d"}
    assert drift.united([], files) == {}
