from __future__ import annotations

import functools

import pytest
from pyspark.sql import functions as F

from rentlens.catalog import models
from rentlens.catalog.fixtures import Tables
from rentlens.operators import frames, joins, sampling
from rentlens.plans import encoding, pricing
from rentlens.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    """Rents that follow from area, period and a wide place label."""
    i = F.col("id")
    area = 20.0 + (i * 37) % 120
    period = F.when(i % 3 == 0, "vor_1919").when(i % 3 == 1, "2016_plus")
    rate = F.when(i % 3 == 1, 14.0).otherwise(8.0) + (i % 100) / 50.0
    return spark.range(3000).select(
        i.alias("listing_id"),
        F.when(i % 11 != 0, area).alias("area_sqm"),
        F.lit(2.0).alias("rooms"),
        (i % 5).cast("double").alias("floor"),
        F.lit(None).cast("double").alias("pricetrend"),
        F.lit(100.0).alias("serviceCharge"),
        *[F.lit(0).alias(c) for c in ("garden", "lift", "hasKitchen")],
        F.concat(F.lit("o'type "), i % 100).alias("typeOfFlat"),
        F.lit("other").alias("heatingType_clean"),
        period.alias("periode_0005"),
        (area * rate).alias("rent_cold"),
    )


@pytest.fixture(scope="module")
def fitted(rows):
    train, test = sampling.split(rows, "listing_id")
    return pricing.fit_rich(train, trees=10, max_depth=10), test


def test_model_beats_the_mean(spark, fitted, tmp_path_factory):
    model, test = fitted
    path = str(tmp_path_factory.mktemp("scored") / "p")
    row = pricing.evaluate(model, test, path).first()
    assert row["r2"] > 0.7 and row["n"] == test.count()
    assert row["mdae"] <= row["mae"] * 1.5


def test_saved_model_scores_alike_and_takes_unknown_labels(fitted, tmp_path):
    model, test = fitted
    tables.save_model(model, str(tmp_path / "m"))
    again = tables.load_model(str(tmp_path / "m"))
    new = test.withColumn("typeOfFlat", F.lit("never seen")).drop("pricetrend")
    a = {r.listing_id: r.pred for r in pricing.score_batch(model, new).collect()}
    b = {r.listing_id: r.pred for r in pricing.score_batch(again, new).collect()}
    assert a == b and len(a) == test.count()
    assert all(v > 0 for v in a.values())


def test_importances(fitted):
    model, test = fitted
    table = pricing.feature_importance(model, pricing.transformed(model, test), k=1000).collect()
    assert table[0]["feature"] == "area_sqm__in"
    assert sum(r["importance"] for r in table) == pytest.approx(1.0, abs=1e-6)


def places(spark, n=6000, cities=1500):
    """Rents that follow from the city; most cities have four rows."""
    i = F.col("id")
    city = F.pmod(F.xxhash64(i), F.lit(cities))
    return spark.range(n).select(
        i.alias("listing_id"),
        F.concat(F.lit("city "), city).alias("city"),
        (300.0 + F.pmod(F.xxhash64(city), F.lit(1000)) + F.pmod(F.xxhash64(i, F.lit(3)), F.lit(40))).alias("rent_cold"),
        F.lit(60.0).alias("area_sqm"),
    )


def prepared(df, by_target=("city",), **more):
    stage = encoding.FeaturePreparation(
        numeric=["area_sqm"], one_hot=[], by_target=list(by_target), target="rent_cold", **more
    )
    return stage.fit(df)


def test_target_statistics_come_from_other_folds(spark):
    df = spark.createDataFrame(
        [("a", 100.0 + i, 1.0 * i) for i in range(40)] + [("b", 500.0, 0.0), (None, 7.0, 1.0), ("a", 100.0, 0.0)],
        "city string, rent_cold double, area_sqm double",
    )
    model = prepared(df, folds=4, prior=3.0)
    rows = df.collect()
    mean = sum(r.rent_cold for r in rows) / len(rows)
    fold = encoding._fold(["area_sqm", "city", "rent_cold"], 4)
    folds = {tuple(r)[:3]: r["f"] for r in df.withColumn("f", fold).collect()}
    got = {(r.city, r.rent_cold, r.area_sqm): r["city__in"] for r in model.out_of_fold(df).collect()}
    fill = "a"
    for r in rows:
        others = [o.rent_cold for o in rows if (o.city or fill) == (r.city or fill) and folds[tuple(o)] != folds[tuple(r)]]
        assert got[tuple(r)] == pytest.approx((sum(others) + 3.0 * mean) / (len(others) + 3.0))
    new = spark.createDataFrame([("a",), ("b",), ("never seen",)], "city string").withColumn("area_sqm", F.lit(None).cast("double"))
    scored = {r.city: r for r in model.transform(new).collect()}
    whole = [r.rent_cold for r in rows if r.city in ("a", None)]
    assert scored["a"]["city__in"] == pytest.approx((sum(whole) + 3.0 * mean) / (len(whole) + 3.0))
    assert scored["never seen"]["city__in"] == pytest.approx(mean)
    assert scored["b"]["area_sqm__in"] == model.getOrDefault(model.fills)["area_sqm"]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_labels_of_any_number_are_told_apart(spark, monkeypatch, limit):
    """1,500 cities: no list of labels in the driver, and the model knows each of them."""
    monkeypatch.setattr(encoding, "lookup_join", functools.partial(joins.lookup_join, limit=limit))
    train, test = sampling.split(places(spark), "listing_id")
    model = pricing.fit_forest(train, ["area_sqm"], ["city"], 10, 2, 8)
    assert not any("StringIndexer" in type(s).__name__ for s in model.stages)
    scored = pricing.score_batch(model, test).select(F.col("rent_cold").alias("y"), "pred")
    assert pricing.regression_metrics(scored).first()["r2"] > 0.5


def test_no_row_learns_from_its_own_rent(spark):
    """Labels that occur once say nothing: out of fold they all have the overall mean."""
    df = places(spark, 2000, 1 << 40)
    values = prepared(df).out_of_fold(df).agg(F.count_distinct("city__in")).first()[0]
    assert values == 1


def test_encoding_is_what_the_caller_says(spark, rows):
    train = rows.where("area_sqm is not null")
    for kind, name in (("one_hot", "typeOfFlat__oh"), ("target", "typeOfFlat__in")):
        model = pricing.fit_forest(train, ["area_sqm"], ["typeOfFlat"], 2, 2, 3, encoding={"typeOfFlat": kind})
        assembler = next(s for s in model.stages if "VectorAssembler" in type(s).__name__)
        assert assembler.getInputCols() == ["area_sqm__in", name]


def test_missing_features_warn_and_none_is_an_error(spark, rows):
    with pytest.warns(UserWarning, match="pricetrend"):
        pricing.fit_rich(rows.drop("pricetrend"), 1, 2)
    with pytest.raises(ValueError):
        pricing.fit_rich(rows.select("listing_id", "rent_cold"), 1, 2)
    census = rows.withColumn("zensus_miete_total", F.lit(8.0))
    assert "zensus_miete_total" in pricing.rich_features(census)["numeric"]


def test_training_job_at_its_own_size(spark, rows, tmp_path):
    """200 trees of depth 30; the saved model gives the same predictions as the fresh one."""
    table = rows.limit(500).drop("pricetrend").withColumn("zensus_miete_total", F.lit(8.0))
    with pytest.warns(UserWarning, match="pricetrend"):
        model, metrics = pricing.train_job(table, "listing_id", str(tmp_path / "m"), str(tmp_path / "j"))
    assert model.stages[-1].getNumTrees == 200 and model.stages[-1].getMaxDepth() == 30
    row = metrics.first()
    assert row["n_train"] + row["n_test"] == 500 and "zensus_miete_total" in row["features_used"]
    shares = {r["feature"]: r["known_pct"] for r in row["known_share"]}
    assert shares["area_sqm"] < 100 and shares["rooms"] == 100 and list(shares.values()) == sorted(shares.values())
    written = spark.read.json(str(tmp_path / "j")).first()
    assert written["n_test"] == row["n_test"] and written["mae"] == row["mae"]
    again = tables.load_model(str(tmp_path / "m"))
    pairs = [{r.listing_id: r.pred for r in pricing.score_batch(m, table).collect()} for m in (model, again)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 500
    sampled, _ = pricing.train_job(table, "listing_id", str(tmp_path / "m2"), str(tmp_path / "j2"), 100, trees=2)
    assert spark.read.json(str(tmp_path / "j2")).first()["n_train"] < 100


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0.0, 0.0), (10.0, 8.0), (20.0, 26.0)], "y double, pred double")
    r = pricing.regression_metrics(df).first()
    assert r["mae"] == pytest.approx(8 / 3) and r["mdae"] == 2.0
    assert r["mape"] == pytest.approx((0 + 0.2 + 0.3) / 3 * 100)
    assert r["smape"] == pytest.approx(100 / 3 * (0 + 4 / 18 + 12 / 46))
    assert r["r2"] == pytest.approx(1 - 40 / 200)


def test_suggestions(spark, fitted):
    units = spark.createDataFrame([(1, 10, "a", 2, 2.0, 0.0, "neu"), (2, 99, "b", None, None, 40.0, None)],
                                  "id int, property_id int, unit_no string, floor int, rooms double, size_sqm double, condition string")
    houses = spark.createDataFrame([(10, 1, "s", "24103", "Kiel", 1990)],
                                   "id int, owner_id int, street string, zip_code string, city string, year_built int")
    rule = {r.unit_id: r.suggested_rent for r in pricing.suggest_rent(units, houses).collect()}
    assert rule[1] == round(11.0 * 60**0.15 * 1.08 * 1.02 * 60, 2)
    assert rule[2] == round(11.0 * 40**0.15 * 40, 2)
    model, _ = fitted
    scored = {r.unit_id: r.suggested_rent for r in pricing.suggest_rent(units, houses, model).collect()}
    assert set(scored) == {1, 2} and scored != rule


def test_partitions_of_a_fit_follow_the_cores(spark):
    """Each partition sends the statistics of all nodes: never one for every few thousand rows."""
    assert [pricing.tasks_for(n, 12) for n in (0, 1, 50_000, 3_000_000, 3_000_001, 43_200_000)] == [1, 1, 5, 12, 24, 180]
    cores = spark.sparkContext.defaultParallelism
    wide = pricing.spread_rows(spark.range(cores * 25_000), cores * 25_000)
    assert wide.rdd.getNumPartitions() == cores and wide.count() == cores * 25_000
    wide.unpersist()


def test_medians_leave_nothing_in_memory_for_the_fit(spark):
    with frames.owned() as owner:
        prepared(places(spark, 200, 20))
        assert not owner._kept


@pytest.mark.parametrize("split", ["_rich_split", "_basic_split"])
def test_rows_of_the_model_queries_are_cleaned_once(spark, split):
    """Fit and scores read a stage, not the listings with all their joins again."""
    parts = getattr(models, split)(Tables(spark, "/root/testdata/sf0.001"))
    for part in parts:
        assert part.count() and not any("orders" in f or "lineitem" in f for f in part.inputFiles())
