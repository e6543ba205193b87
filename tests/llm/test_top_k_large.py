"""Vectors too long for products in doubles are scored as whole numbers; empty tables and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hostlens.llm import top_k


def test_large_components(spark):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) * (10**5 if i % 7 == 0 else 1) for _ in range(64)], i, "c") for i in range(400)]
    rows += [(1000 + i, [2.0**15] * 63 + [i / 1024], i, "c") for i in range(15)]  # scores that differ by less than a double tells
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int, rank string")
    got = {}
    for row in top_k.search(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.vec_id, row.score)
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v, _, _ in rows}
    assert set(got) == {i for i in ints if i % 50 == 0}
    for q, found in got.items():
        wanted = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:10]
        assert [found[k + 1] for k in range(10)] == [(i, -s) for s, i in wanted]
    assert top_k.search(table.filter("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        top_k.search(spark.createDataFrame([(0, [4e6])], "vec_id long, embedding array<double>"), F.lit(True))
