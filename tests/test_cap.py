"""First rows of a load without one task for all of them."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from rentlens.operators import sampling


@pytest.mark.parametrize("n", [1, 50_000, 99_999, 200_000])
def test_first_rows_equal_a_sort(spark, monkeypatch, n):
    monkeypatch.setattr(sampling, "RANGE_ROWS", 3000)
    monkeypatch.setattr(sampling, "SAMPLE_ROWS", 2000)
    df = spark.range(0, 100_000, 1, 8).select(
        (F.col("id") * 7919 % 100_003).alias("k"), F.struct((F.col("id") % 3).alias("f"), "id").alias("at"), "id"
    )
    for order in (["k"], ["at"]):
        got = sampling.cap_rows(df, n, order)
        # Only rows of the last range are put in order.
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert all(int(k) <= sampling.RANGE_ROWS for k in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.orderBy(*order).limit(n).collect()))


def test_equal_keys_and_small_loads(spark):
    same = spark.range(5000).select(F.lit(1).alias("k"))
    assert sampling.cap_rows(same, 1234, ["k"]).count() == 1234
    assert sampling.cap_rows(same, None, ["k"]).count() == 5000
    assert sampling.cap_rows(same.where("k > 1"), 5, ["k"]).count() == 0
    nulls = spark.range(100).select(F.when(F.col("id") > 9, F.col("id")).alias("k"))
    assert {r["k"] for r in sampling.cap_rows(nulls, 15, ["k"]).collect()} == {None, 10, 11, 12, 13, 14}
