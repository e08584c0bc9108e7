from __future__ import annotations

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentlens.operators import frames, quantiles

ODD = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1e308, 1.0, 0.1,
       -0.1, 2.0**52 + 1, 3.0, 7.999999999999999, 8.0, 1e-300, float("inf"), float("-inf")]


def data(spark, n_hot=30000):
    rng = random.Random(3)
    out = [("hot", rng.gauss(10, 3)) for _ in range(n_hot)]
    out += [("ties", float(rng.randrange(4))) for _ in range(12000)]
    out += [("wide", rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300)) for _ in range(3000)]
    out += [("same", 3.25)] * 500
    out += [(None, rng.random()) for _ in range(501)]
    out += [("two", 1.0), ("two", 2.0), ("one", 5.0), ("none", None), ("nan", float("nan"))]
    return out, spark.createDataFrame(out, "g string, x double").repartition(6)


def bits(x: float) -> int:
    """The definition, by the machine's own layout of a double."""
    own = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
    return -own if x < 0 else own


def test_bits_are_those_of_the_double_and_sort_like_it(spark):
    rng = random.Random(1)
    xs = ODD + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(4000)]
    xs += [2.0**e * s for e in range(-1074, 1024) for s in (1, -1)]
    xs += [np.nextafter(2.0**e, 0).item() for e in range(-1021, 1024)]
    xs = [x for x in xs if x == x]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    got = [(r["x"], r["b"]) for r in quantiles.with_ordered_bits(df, "x", "b").collect()]
    assert all(b == (None if x is None else bits(x)) for x, b in got)


@pytest.mark.parametrize("digit,few", [(16, 1 << 16), (16, 5), (8, 40), (4, 1)])
def test_exact_quantiles_match_numpy(spark, monkeypatch, digit, few):
    monkeypatch.setattr(quantiles, "DIGIT", digit)
    monkeypatch.setattr(quantiles, "FEW", few)
    raw, df = data(spark)
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    with frames.owned():
        got = {r["g"]: r for r in quantiles.exact_quantiles(df, "x", probs, ["g"]).collect()}
    assert len(got) == 9
    for g in ("hot", "ties", "wide", "same", None, "two", "one"):
        xs = [x for k, x in raw if k == g]
        assert got[g]["n"] == len(xs) and got[g]["rows"] == len(xs)
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(float(np.quantile(xs, p)), rel=1e-12)
    assert got["none"]["n"] == 0 and got["none"]["p50"] is None and got["none"]["rows"] == 1
    assert got["nan"]["n"] == 0 and got["nan"]["rows"] == 1


@pytest.mark.parametrize("few", [1 << 16, 3])
def test_global_median_and_empty_frames(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    raw, df = data(spark)
    xs = [x for _, x in raw if x is not None and x == x]
    row = quantiles.exact_median(df, "x").first()
    assert row["median"] == pytest.approx(float(np.median(xs)), rel=1e-12)
    assert row["n"] == len(xs)
    none = quantiles.exact_median(df.where("false"), "x").collect()
    assert [tuple(r) for r in none] == [(0, 0, None)]
    assert quantiles.exact_median(df.where("false"), "x", ["g"]).count() == 0


def test_medians_of_several_columns(spark):
    df = spark.range(1001).select(
        (F.col("id") % 3).alias("g"), (F.col("id") * 1.0).alias("a.b"), (-F.col("id")).alias("c"), F.lit(None).cast("int").alias("d")
    )
    rows = {r["g"]: r for r in quantiles.exact_medians(df, ["a.b", "c", "d"], ["g"]).collect()}
    for g in range(3):
        xs = np.arange(g, 1001, 3)
        assert rows[g]["a.b"] == np.median(xs) and rows[g]["c"] == -np.median(xs) and rows[g]["d"] is None


@pytest.mark.parametrize("n", [10**5, 10**6, 10**7])
def test_last_step_stays_bounded_as_distinct_values_grow(spark, n):
    """Whatever the number of distinct values, no group orders more than a constant of them."""
    x = F.pow(F.rand(3) * 40, F.lit(3)) + F.col("id") * 1e-9
    df = spark.range(n).select((F.col("id") % 2).alias("g"), x.alias("__v"))
    with frames.owned() as owner:
        rows = owner.keep(quantiles.with_ordered_bits(df, "__v", "__bits"))
        state, shift, _ = quantiles.narrowed(rows, [0.1, 0.5], ["g"])
        left = quantiles.remaining(rows, state, shift, ["g"]).groupBy("g", "__parent").count()
        most = left.agg(F.max("count")).first()[0]
        assert most <= quantiles.FEW
        digits = rows.groupBy("g", F.shiftright("__bits", 64 - quantiles.DIGIT)).count().groupBy("g").count()
        assert digits.agg(F.max("count")).first()[0] <= 1 << quantiles.DIGIT
    assert shift >= 16


def test_plans_have_no_counting_median(spark):
    from rentlens.operators import impute

    df = spark.createDataFrame([("a", 1.0, None), ("a", None, 2.0)], "g string, x double, y double")
    filled = impute.fill_group_median(df, ["x", "y"], "g")
    plan = filled._jdf.queryExecution().toString()
    assert "median(" not in plan and "percentile(" not in plan
    assert sorted(map(tuple, filled.collect())) == [("a", 1.0, 2.0), ("a", 1.0, 2.0)]


def test_digits_are_counted_without_sorting_the_rows(spark):
    """The state of a group joins the counts; an array in the aggregate would sort every row."""
    _, df = data(spark, 500)
    rows = quantiles.with_ordered_bits(df.select("g", F.col("x").alias("__v")), "__v", "__bits")
    state, shift, _ = quantiles.narrowed(rows, [0.5], ["g"])
    assert "SortAggregate" not in quantiles.remaining(rows, state, shift, ["g"])._jdf.queryExecution().toString()
