from __future__ import annotations

import pytest

from framewright.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {"p3_found": ["result_id", "defect"], "p4_found": ["level", "key_a", "key_b"], "p6_found": ["result_id"], "p8_found": ["doc_id", "passage_id"], "p9_found": ["doc_id", "segment", "lang"]}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found_has_the_fixed_columns_and_distinct_rows(spark, name):
    d = queries.QUERIES[name](spark, SF)
    assert d.columns == COLUMNS[name]
    rows = [tuple(r) for r in d.collect()]
    assert rows and len(rows) == len(set(rows))


def test_truncated_are_the_cut_results(spark):
    cut = {r.result_id for r in queries.p6_found(spark, SF).collect()}
    assert cut == {r.result_id for r in queries.p3_found(spark, SF).collect() if r.defect == "truncated"}


def test_containers_are_well_filled(spark):
    rows = queries.p7_fill(spark, SF).collect()
    assert len(rows) == 4 and all(0.9 < r.fill <= 1 for r in rows)
