from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rentlens.functions import features, parsing, places
from rentlens.functions import text as tx
from rentlens.operators import columns, filters, impute, resolve, sampling
from rentlens.plans import listings as jobs


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "fn, cases",
    [
        (parsing.to_num, {None: None, "": None, "nan": None, "NaN": None, " 7 ": 7.0, "1e3": 1000.0,
                          "1d": None, "inf": None, "3,5": None, "-2.5": -2.5, "/": None}),
        (parsing.to_num_comma, {"3,5": 3.5, "1.234,56": None, "7": 7.0}),
        (parsing.to_float_de, {"1.234,56 €": 1234.56, "7,52 €/m²": 7.52, "7.52": 7.52,
                               "12.345": 12345.0, "/": None, None: None}),
        (parsing.zensus_to_float, {"(7,12)": None, "7,1e": 7.1, "7,12 € / m²": 7.12, "6,5 (a)": 6.5,
                                   "/": None}),
        (parsing.strip_to_number, {"(7,12)": 7.12, "ca. 8": 0.8, " 9,5 e": 9.5, "–": None}),
        (parsing.to_bool01, {" Ja ": 1, "F": 0, "vielleicht": None, None: None, "1": 1}),
        (parsing.flag01, {"ja": 1, "Y": 0, None: 0, "TRUE": 1, " ja": 0}),
        (parsing.plz5, {"D-24103 Kiel": "24103", "123456": "12345", "1234": None, None: None}),
        (lambda c: parsing.pad_key(c, 12), {"1001000000": "001001000000", "0100100000001": "0100100000001",
                                            "": None, None: None, "010010000000": "010010000000"}),
        (parsing.tidy_category, {" Alt/Neu ; Bau ": "alt,neu , bau", None: "unknown", "": ""}),
        (parsing.heating_clean, {"gas_heating": "gas_heating", None: "other", "oil": "other"}),
        (parsing.lower_condition, {"NEU": "neu", "": None, None: None}),
        (parsing.state_code, {"Thüringen": "16", "thueringen": "16", "Hessen ": "06", "Tirol": None}),
        (places.city_display, {"Kiel, Landeshauptstadt": "Kiel", "Burg (Dith.)": "Burg", None: None}),
        (places.dashboard, {"Hansestadt Lübeck": "hansestadt lübeck", "Groß-Gerau": "gross gerau",
                            "Kiel, Stadt": "kiel", None: "", "St. Ingbert": "st ingbert"}),
        (places.sandbox, {"Weimar, kreisfreie Stadt": "weimar", None: None, "Bad  Amt Ems": "bad ems"}),
        (places.census_name, {"Kiel, Landeshauptstadt": "kiel", "Hansestadt Lübeck": "luebeck",
                              "Burg (Dith.)": "burg", None: ""}),
        (places.census_name_wide, {"Frankfurt a. d. Oder": "frankfurt oder", "St.Ingbert": "sankt ingbert",
                                   "Rottach am See": "rottach see"}),
        (places.separators, {"Halle/Saale; Ost": "halle saale ost", "Burg (Dith.)": "burg"}),
        (places.substrings, {"Neustadt": "neu", "Kreisstadt Unna": "unna"}),
        (places.cut_suffixes, {"Musterort, Kreis Nord": "musterort", "Prien am See": "prien",
                               "Neuburg an der Donau": "neuburg", "Köln": "koeln"}),
        (places.letters_only, {"Bad (x) Ems, Stadt": "bad ems", "NATION_5": "nation 5", None: ""}),
        (places.nine_words, {"Amt Süd": "süd", "Verbandsgemeinde 7": "7", "Rheinamt": "rheinamt"}),
        (places.unique_census, {"Kiel, Landeshauptstadt": "kiel", None: None, "Groß (x)": "gross x"}),
        (places.trailing_words, {"Marburg Universitätsstadt": "marburg", "Stadt Land": "stadt land",
                                 "Ulm Kreis Stadt": "ulm"}),
    ],
)
def test_functions(spark, fn, cases):
    got = dict(zip(cases, apply(spark, fn, list(cases))))
    assert got == cases


def test_no_break_space_counts_as_blank(spark):
    assert apply(spark, tx.collapse, [" a  b "]) == ["a b"]
    assert apply(spark, tx.strip, ["  x "]) == ["x"]
    assert apply(spark, tx.tokens, ["b a b", None]) == [["b", "a"], []]


def test_periods_and_buckets(spark):
    years = [1918.0, 1919.0, 1949.0, 1950.0, 1965.0, 1995.0, 2015.0, 2016.0, 1918.7, None]
    labels = ["vor_1919", "1919_1949", "1919_1949", "1950_1959", "1960_1969", "1990_1999",
              "2010_2015", "2016_plus", "vor_1919", None]
    assert apply(spark, features.year_to_period, years, "double") == labels
    gaps = [None if x in features.GAP_PERIODS else x for x in labels]
    assert apply(spark, features.year_bucket, years, "double") == gaps
    areas = [0.0, 29.99, 30.0, 179.99, 180.0, -1.0, None]
    assert apply(spark, features.area_bucket, areas, "double") == [
        "Unter 30 m²", "Unter 30 m²", "30 - 39 m²", "170 - 179 m²", "180 m² und mehr", None, None
    ]
    floors = [-2.0, 0.0, 60.0, 75.0, None]
    assert apply(spark, features.clamp_floor, floors, "double") == [0.0, 0.0, 60.0, 60.0, None]


@pytest.mark.parametrize("x", [1233.695, 1326.415, 0.5, 2.675, 46271.965, 0.125, 0.375, 99.995, 7.0])
def test_amounts_round_like_python(spark, x):
    assert apply(spark, parsing.format_amount, [x, -x], "double") == [f"{x:.2f}", f"{-x:.2f}"]
    assert apply(spark, parsing.round_cents, [x, -x], "double") == [round(x, 2), round(-x, 2)]


def test_heuristic_rent(spark):
    df = spark.createDataFrame(
        [("Berlin", 50.0, "Saniert", 3), (None, 0.0, None, None), ("Kiel", None, "alt", 0)],
        "city string, size double, condition string, floor int",
    )
    got = [r[0] for r in df.select(features.heuristic_rent(
        F.col("city"), F.col("size"), F.col("condition"), F.col("floor"))).collect()]
    assert got[0] == round(13.0 * 50**0.15 * 1.08 * 1.03 * 50, 2)
    assert got[1] == got[2] == round(11.0 * 60**0.15 * 60, 2)


def test_plausible_bounds_are_strict(spark):
    df = spark.createDataFrame(
        [(10.0, 500.0), (10.01, 200.01), (399.99, 9999.99), (400.0, 500.0), (50.0, 200.0), (50.0, 10000.0)],
        "area_sqm double, rent_cold double",
    )
    assert filters.plausible(df).count() == 2


def test_modes_and_medians(spark):
    df = spark.createDataFrame(
        [(1, "a", 2.0, 1.0), (2, "a", None, 3.0), (3, "b", 1.0, None), (4, None, None, None),
         (5, "b", 2.0, 5.0), (6, "b", 1.0, 1.0)],
        "id int, city string, floor double, p double",
    )
    assert {r.id: r.floor for r in impute.fill_mode(df, "floor").collect()}[2] == 1.0  # smallest on ties
    both = {r.id: (r.floor, r.p) for r in impute.fill_mode_and_mean(df, "floor", "p").collect()}
    assert both[4] == (1.0, 2.5) and both[3] == (1.0, 2.5)
    med = {r.id: r.floor for r in impute.fill_group_median(df, ["floor"], "city").collect()}
    assert med[2] == 2.0
    assert med[4] == 2.0  # null city: global median of the filled column, not a null group
    empty = df.withColumn("floor", F.lit(None).cast("double"))
    assert {r.floor for r in impute.fill_mode(empty, "floor", 0.0).collect()} == {0.0}


def test_row_total_before_column_median(spark):
    df = spark.createDataFrame(
        [(4.0, None, 1.0), (6.0, 8.0, None), (None, None, 3.0)], "Insgesamt double, a double, b double"
    )
    got = [tuple(r) for r in impute.fill_row_then_median(df, ["a", "b"], "Insgesamt").collect()]
    assert got == [(4.0, 4.0, 1.0), (6.0, 8.0, 6.0), (5.0, 6.0, 3.0)]


def test_schema_resolution(spark):
    df = spark.createDataFrame([("24103", "1,5", "NaN", "x")], "plz string, price string, area string, z string")
    out = columns.standardize_listings(df, extra_json=True).first()
    assert out["zip_code"] == "24103" and out["rent_cold"] is None and out["area_sqm"] is None
    assert out["extra_json"] == '{"z":"x"}'
    with pytest.raises(ValueError):
        columns.require_columns(df, ["absent"])
    with pytest.raises(ValueError):
        columns.find_key_column(["a", "b"])
    assert columns.load_key_map(df) is None
    with pytest.raises(ValueError):
        columns.resolve_features(df, ["q"], ["r"])
    assert columns.resolve_features(df, ["area", "q"], ["z"])["missing"] == ["q"]
    with pytest.raises(ValueError):
        columns.normalize_immo(df)


def test_warm_minus_service_when_no_cold_column(spark):
    df = spark.createDataFrame([("Kiel", "SH", 900.0, 150.0, "ja")],
                               "ort string, bundesland string, warmmiete double, nebenkosten double, kitchen string")
    row = columns.normalize_immo(df).first()
    assert row["coldRent"] == 750.0 and row["hasKitchen"] == 1 and row["city_norm"] == "kiel"


def test_samples_and_splits(spark):
    df = spark.range(0, 5000, 1, 7).withColumnRenamed("id", "k")
    one = {r.k for r in sampling.seeded_sample(df, "k", 1234).collect()}
    two = {r.k for r in sampling.seeded_sample(df.repartition(3), "k", 1234).collect()}
    assert one == two and len(one) == 1234
    assert sampling.seeded_sample(df, "k", 0).count() == 5000
    assert sampling.seeded_sample(df, "k", 6000).count() == 5000
    train, test = sampling.split(df, "k")
    assert train.intersect(test).count() == 0 and train.count() + test.count() == 5000
    assert 800 < test.count() < 1200
    kept = sampling.dedupe(df.selectExpr("k % 10 as g", "k"), ["g"], ["k"])
    assert sorted((r.g, r.k) for r in kept.collect()) == [(i, i) for i in range(10)]


def test_census_cleaning(spark):
    raw = spark.createDataFrame(
        [("1001000000", "Kiel, Landeshauptstadt", "7,50 €", "6,0", None), ("10020000000", "Ulm", "(8,0)", "/", "9,0e")],
        "`﻿GKZ ` string, Gemeindename string, Miete_raw string, `Vor 1919` string, `2016 und später` string",
    )
    got = {r["GKZ"]: r for r in jobs.clean_census(raw).collect()}
    assert got["001001000000"]["vor_1919"] == 6.0 and got["001001000000"]["2016_plus"] == 7.5
    assert got["010020000000"]["vor_1919"] == 8.0 and got["010020000000"]["2016_plus"] == 9.0


def test_kreis5_falls_back_by_column(spark):
    df = spark.createDataFrame([("K 01001", "x 09162"), (None, "x 09162"), ("ohne", "x 09162")],
                               "geo_krs string, regio2 string")
    assert [r[0] for r in df.select(resolve.kreis5(df)).collect()] == ["01001", "09162", None]


def test_a_trailing_amt_stays(spark):
    names = spark.createDataFrame([("Xyz Amt",), ("Amt Xyz",)], "n string")
    assert [r[0] for r in names.select(places.nine_words(F.col("n"))).collect()] == ["xyz amt", "xyz"]
