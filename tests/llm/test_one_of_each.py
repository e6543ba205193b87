"""Rows that stay do not depend on the size of the filter that spares them a shuffle."""

from collections import Counter

import pytest

from hostlens.llm import jaccard

BASE = [f"word{i} " * 1 for i in range(60)]
COPY = "".join(BASE)
NEAR = "".join([*BASE[:-1], "other "])
ROWS = [(1, COPY, "x"), (2, NEAR, "x"), (3, COPY, "x"), (3, COPY, "x"), (4, "quite another text of seven words", "x"),
        (4, "quite another text of seven words", "x"), (5, None, "x"), (6, "", "x"), (None, "a row that has no id", "x")]


@pytest.mark.parametrize("bits", [8, 1 << 23])
def test_filter_size(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)
    documents = spark.createDataFrame(ROWS, "doc_id long, text string, bit string")
    got = Counter(tuple(r) for r in jaccard.one_of_each(documents).collect())
    assert got == Counter([ROWS[0], ROWS[4], ROWS[6], ROWS[7], ROWS[8]])


def test_passed_rows_are_not_joined(spark):
    documents = spark.createDataFrame(ROWS, "doc_id long, text string, bit string")
    plan = jaccard.one_of_each(documents)._jdf.queryExecution().optimizedPlan().toString()
    first, *_ = plan.split("Join")
    assert "Union" in first and "ArrowEvalPython" in first
