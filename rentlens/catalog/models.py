"""Rent model: training table, fits, metrics, scoring, importances, suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.catalog import oracle as q
from rentlens.catalog.cleaning import HEURISTIC, STANDARD
from rentlens.catalog.registry import query
from rentlens.operators import columns, sampling
from rentlens.plans import listings as jobs
from rentlens.plans import pricing
from rentlens.plans.encoding import FeaturePreparation
from rentlens.sources import tables as store

# The jobs' own defaults are 200 and 400 trees of depth 30. At 2.1 seconds a tree over the
# 12,000 rows of sf0.01 (8 cores) each of the six queries would take 7 to 14 minutes, so they
# fit smaller forests, on all rows. The job at its defaults is run by a test.
TREES, DEPTH = 20, 8


METRICS = """WITH e AS (SELECT y, pred, abs(pred - y) AS e,
                  CASE WHEN abs(y) + abs(pred) = 0 THEN 1 ELSE abs(y) + abs(pred) END AS d
                  FROM fx_predictions)
       SELECT COUNT(*) AS n, round(AVG(e), 4) AS mae, round(median(e), 4) AS mdae,
              round(AVG(e / greatest(y, 1e-6)) * 100, 6) AS mape,
              round(AVG(2 * e / d) * 100, 6) AS smape,
              round(1 - SUM(e * e) / SUM((y - m) * (y - m)), 6) AS r2
       FROM e, (SELECT AVG(y) AS m FROM e)"""


def _standard(t):
    return columns.standardize_listings(t.fx("listings"), keep=["listing_id"])


def _cleaned(t):
    return jobs.clean_listings(t.fx("listings"))


# The rows of a model are handed over as a stage: the fit, the scores and the checks read
# them a dozen times, and what cleaning does to the listings is then done once.
def _rich_split(t):
    train = pricing.load_train(_cleaned(t).withColumn("row_key", F.col("listing_id")))
    features = [*pricing.RICH_NUMERIC, *pricing.RICH_CATEGORICAL]
    rows = train.select("listing_id", "row_key", *features, pricing.TARGET)
    return sampling.split(store.write_stage(rows, store.shared_dir(t.spark)), "row_key")


def _basic_split(t):
    rows = pricing.train_table(_standard(t), ["listing_id"])
    return sampling.split(store.write_stage(rows, store.shared_dir(t.spark)), "listing_id")


@query(
    "L1_train_table",
    f"""SELECT listing_id, city, zip_code, district, nullif(lower(`condition`), '') AS `condition`,
               area_sqm, rooms, floor, year_built, lat, lon, rent_cold
        FROM ({STANDARD}) WHERE rent_cold IS NOT NULL AND {q.plausible('area_sqm', 'rent_cold')}""",
)
def l1(t):
    return pricing.train_table(_standard(t), ["listing_id"])


# What SQL can say about a model: which rows it is tried on, that it errs at most a quarter
# more there than the mean rent of the training rows does (the derived rents follow from no
# feature, so there is nothing to learn), and that its errors are ordered as errors are.
def _tried(rows: str) -> str:
    return f"""WITH r AS (SELECT listing_id, rent_cold AS y FROM ({rows})),
        tr AS (SELECT y FROM r WHERE NOT {q.train_hash('listing_id')}),
        te AS (SELECT y FROM r WHERE {q.train_hash('listing_id')})
        SELECT COUNT(*) AS n, round(AVG(abs(y - (SELECT AVG(y) FROM tr))), 4) AS mean_mae,
               true AS near_mean, true AS in_order FROM te"""


def _judged(metrics, train, test):
    mean = train.agg(F.avg("rent_cold")).scalar()
    plain = test.agg(F.round(F.avg(F.abs(F.col("rent_cold") - mean)), 4)).scalar()
    ordered = (F.col("mdae") >= 0) & (F.col("smape") <= 200) & (F.col("r2") <= 1) & (F.col("mape") >= 0)
    return metrics.select(
        "n",
        plain.alias("mean_mae"),
        (F.col("mae") <= 1.25 * plain).alias("near_mean"),
        ordered.alias("in_order"),
    )


BASIC_ROWS = f"""SELECT listing_id, rent_cold FROM ({STANDARD})
    WHERE rent_cold IS NOT NULL AND {q.plausible('area_sqm', 'rent_cold')}"""
RICH_ROWS = "SELECT listing_id, baseRent AS rent_cold FROM fx_listings WHERE baseRent IS NOT NULL"


@query("L2_fit_basic", _tried(BASIC_ROWS))
def l2(t):
    train, test = _basic_split(t)
    model = pricing.fit_basic(train, TREES, DEPTH)
    return _judged(pricing.evaluate(model, test, store.shared_dir(t.spark)), train, test)


@query("L3_fit_rich", _tried(RICH_ROWS))
def l3(t):
    train, test = _rich_split(t)
    model = pricing.fit_rich(train, TREES, DEPTH)
    return _judged(pricing.evaluate(model, test, store.shared_dir(t.spark)), train, test)


KNOWN = {
    "area_sqm": "livingSpace", "rooms": "noRooms", "floor": "1", "pricetrend": "1",
    "serviceCharge": "1", "garden": "garden", "lift": "lift", "hasKitchen": "hasKitchen",
    "typeOfFlat": "typeOfFlat", "heatingType_clean": "1", "periode_0005": "1",
}


@query(
    "L3_known_share",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(100.0e0 * COUNT({x}) / COUNT(*), 6) AS known_pct "
        "FROM fx_listings WHERE baseRent IS NOT NULL"
        for c, x in KNOWN.items()
    ),
)
def l3_known(t):
    """All eleven features of the rich model, as the training job sees them."""
    shares = pricing.known_share(
        pricing.load_train(_cleaned(t)), [*pricing.RICH_NUMERIC, *pricing.RICH_CATEGORICAL]
    )
    return shares.withColumn("known_pct", F.round("known_pct", 6))


@query(
    "L4_regression_metrics",
    METRICS,
)
def l4(t):
    table = pricing.regression_metrics(t.fx("predictions"))
    return table.withColumns(
        {
            **{c: F.round(c, 4) for c in ("mae", "mdae")},
            **{c: F.round(c, 6) for c in ("mape", "smape", "r2")},
        }
    )


def _in_range(rows: str, test: str) -> str:
    """A forest predicts means of training rents, so none lies outside their range."""
    return f"""WITH r AS ({rows}), tr AS (SELECT rent_cold FROM r WHERE NOT {q.train_hash('listing_id')})
        SELECT {test}, (SELECT MIN(rent_cold) FROM tr) AS least, (SELECT MAX(rent_cold) FROM tr) AS most,
               true AS in_range"""


def _ranged(scored, train, pred="pred"):
    ends = train.agg(F.min("rent_cold").alias("least"), F.max("rent_cold").alias("most"))
    least, most = ends.select("least").scalar(), ends.select("most").scalar()
    # Means of many rents are rounded.
    inside = F.col(pred).between(least * (1 - 1e-9) - 0.005, most * (1 + 1e-9) + 0.005)
    return scored.select(
        *[c for c in scored.columns if c != pred],
        least.alias("least"),
        most.alias("most"),
        F.coalesce(inside, F.lit(False)).alias("in_range"),
    )


@query(
    "L5_score_batch",
    _in_range(RICH_ROWS, "listing_id") + f" FROM r WHERE {q.train_hash('listing_id')}",
)
def l5(t):
    train, test = _rich_split(t)
    model = pricing.fit_rich(train, TREES, DEPTH)
    scored = pricing.score_batch(
        model, test.select("listing_id", *pricing.RICH_NUMERIC, *pricing.RICH_CATEGORICAL)
    )
    return _ranged(scored.select("listing_id", "pred"), train)


@query(
    "L6_feature_importance",
    """SELECT unnest(['area_sqm', 'rooms', 'floor', 'pricetrend', 'serviceCharge', 'garden', 'lift',
                      'hasKitchen', 'typeOfFlat', 'heatingType_clean', 'periode_0005']) AS feature,
              1.0e0 AS total, true AS in_range""",
)
def l6(t):
    """Importances by feature: parts of a whole, which SQL knows to be one."""
    train, test = _rich_split(t)
    model = pricing.fit_rich(train, TREES, DEPTH)
    parts = pricing.feature_importance(model, pricing.transformed(model, test), k=100_000)
    names = [*pricing.RICH_NUMERIC, *pricing.RICH_CATEGORICAL]
    wanted = t.spark.createDataFrame([(c,) for c in names], "feature string")
    # One row per feature of the model, a handful.
    own = parts.withColumn("feature", F.regexp_replace("feature", "__(in|oh).*$", ""))
    sums = own.groupBy("feature").agg(F.sum("importance").alias("importance"))
    total = sums.agg(F.round(F.sum("importance"), 6)).scalar()
    share = F.coalesce("importance", F.lit(0.0))
    return wanted.join(F.broadcast(sums), "feature", "left").select(
        "feature", total.alias("total"), share.between(0, 1).alias("in_range")
    )


@query(
    "L7_suggest_rent_fallback",
    "SELECT u.id AS unit_id, "
    + HEURISTIC.format(
        city="city", size="size_sqm", condition='u."condition"', floor="u.floor"
    )
    + " AS suggested_rent FROM fx_units u LEFT JOIN fx_properties p ON u.property_id = p.id",
)
def l7_rule(t):
    return pricing.suggest_rent(t.fx("units"), t.fx("properties"))


@query("L7_suggest_rent", _in_range(BASIC_ROWS, "id AS unit_id") + " FROM fx_units")
def l7(t):
    train, _ = _basic_split(t)
    model = pricing.fit_basic(train, TREES, DEPTH)
    suggested = pricing.suggest_rent(t.fx("units"), t.fx("properties"), model)
    return _ranged(suggested, train, "suggested_rent")


@query(
    "A13_save_load_model",
    f"""SELECT listing_id, true AS same FROM ({RICH_ROWS}) WHERE {q.train_hash('listing_id')}""",
)
def a13(t):
    """Every test row scored by the fitted model and by the one that was saved and loaded."""
    train, test = _rich_split(t)
    path = store.shared_dir(t.spark)
    model = pricing.fit_rich(train, TREES, DEPTH)
    store.save_model(model, path)
    fresh = pricing.score_batch(model, test).withColumnRenamed("pred", "fresh")
    both = pricing.score_batch(store.load_model(path), fresh)
    return both.select("listing_id", (F.col("fresh") == F.col("pred")).alias("same"))


@query("A12_write_metrics", METRICS)
def a12(t):
    path = store.shared_dir(t.spark)
    store.write_metrics(pricing.regression_metrics(t.fx("predictions")), path)
    written = t.spark.read.schema(
        "n long, mae double, mdae double, mape double, smape double, r2 double"
    ).json(path)
    digits = {"mae": 4, "mdae": 4, "mape": 6, "smape": 6, "r2": 6}
    return written.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "F6_pipeline_impute",
    f"""WITH tr AS (SELECT * FROM fx_places_listed WHERE NOT {q.train_hash('listing_id')}),
        top AS (SELECT heatingType FROM tr WHERE heatingType IS NOT NULL GROUP BY heatingType
                ORDER BY COUNT(*) DESC, heatingType LIMIT 1)
        SELECT listing_id, coalesce(pricetrend, (SELECT median(pricetrend) FROM tr)) AS pricetrend,
               coalesce(totalRent, (SELECT median(totalRent) FROM tr)) AS totalRent,
               coalesce(heatingType, (SELECT heatingType FROM top)) AS heatingType
        FROM fx_places_listed""",
)
def f6(t):
    df = t.fx("places_listed").select("listing_id", "pricetrend", "totalRent", "heatingType")
    train, _ = sampling.split(df, "listing_id")
    names = ["pricetrend", "totalRent", "heatingType"]
    stage = FeaturePreparation(numeric=names[:2], one_hot=names[2:]).fit(train)
    filled = stage.transform(df)
    return filled.select("listing_id", *[F.col(f"{c}__in").alias(c) for c in names])
