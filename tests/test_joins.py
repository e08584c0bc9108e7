from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rentlens.operators import joins
from rentlens.operators.resolve import duplicate_flag, duplicate_keys


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    # One key holds a third of all rows, another third has no key.
    keys = ["hot"] * 700 + [None] * 700 + [f"k{rng.randrange(400)}" for _ in range(700)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    right = spark.createDataFrame(
        [("hot", 1.0), (None, 9.0), *[(f"k{i}", float(i)) for i in range(0, 400, 2)]],
        "k string, v double",
    )
    return left, right


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [False, True])
def test_salted_equals_broadcast(sides, how, null_safe):
    left, right = sides
    small = joins.lookup_join(left, right, ["k"], how, null_safe=null_safe)
    large = joins.lookup_join(left, right, ["k"], how, null_safe=null_safe, limit=0, rows_per_task=50)
    order = sorted(small.columns)
    assert rows(small.select(order)) == rows(large.select(order))


def test_null_keys_never_match_by_default(sides):
    left, right = sides
    joined = joins.lookup_join(left, right, ["k"])
    assert joined.where("k is null and v is not null").count() == 0
    safe = joins.lookup_join(left, right, ["k"], null_safe=True)
    assert safe.where("k is null and v = 9.0").count() == 700


def test_lookup_measures_before_broadcasting(sides):
    left, right = sides
    plan = joins.lookup_join(left, right, ["k"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan
    salted = joins.lookup_join(left, right, ["k"], limit=0)._jdf.queryExecution()
    assert "__salt" in salted.toString()


def test_salts_follow_the_counted_rows(spark):
    """One key with 30 % of the rows, one just below the threshold: no task gets much more."""
    keys = ["hot"] * 3000 + ["warm"] * 199 + [f"k{i}" for i in range(6801)]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id long, k string")
    hot = {r["k"]: r["__salts"] for r in joins.hot_keys(df, [["k"]], 200)[0].collect()}
    assert hot == {"hot": 15}
    salt = F.pmod(F.xxhash64("id", "k"), F.lit(15))
    largest = df.where("k = 'hot'").groupBy(salt.alias("s")).count().agg(F.max("count")).first()[0]
    assert largest <= 300


def test_hot_keys_of_several_lookups_come_from_one_pass(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 600, F.lit("a")).alias("k"), (F.col("id") % 2).alias("g.x"), F.lit(1).alias("one")
    )
    first, second, third = joins.hot_keys(df, [["k"], ["k", "g.x"], ["one"]], 250)
    assert {(r[0], r[1]) for r in first.collect()} == {("a", 3), (None, 2)}
    assert {tuple(r) for r in second.collect()} == {("a", 0, 2), ("a", 1, 2)}
    assert [tuple(r) for r in third.collect()] == [(1, 4)]


def test_sizes_are_those_of_the_rows(spark):
    df = spark.createDataFrame([("ab", 1, [1, 2]), (None, 2, None)], "t string, n int, a array<int>")
    assert joins.measured_bytes([df.select("n"), df.select("t", "n"), df.where("false")]) == [16, 34, 0]
    assert joins.measured_bytes([df])[0] > 48


def test_by_distinct_keeps_rows(spark, sides):
    left, _ = sides
    seen = joins.by_distinct(left, ["k"], lambda d: d.withColumn("up", F.upper("k")))
    assert seen.count() == left.count()
    assert seen.where("up <=> upper(k)").count() == left.count()


def test_first_row_takes_smallest_order(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, n int, v string")
    assert rows(joins.first_row(df, ["k"], ["n"])) == ["('a', 1, 'y')", "('b', 3, 'z')"]


def test_duplicates_count_null_keys_together(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "id int, k string")
    assert {r.id for r in duplicate_keys(df, ["k"]).collect()} == {1, 2, 3, 4}
    assert {r.id for r in duplicate_keys(df, ["k"], keep=False).collect()} == {5}
    assert {r.id for r in duplicate_flag(df, ["k"]).where("is_duplicate").collect()} == {1, 2, 3, 4}
