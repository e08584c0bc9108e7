from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rentlens.catalog.fixtures import Tables
from rentlens.operators import resolve
from rentlens.plans import listings as jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def keys(df, column):
    return {r["listing_id"]: r[column] for r in df.select("listing_id", column).collect()}


def test_steps_keep_rows_and_only_fill_gaps(t):
    listings, key_map, census = t.fx("places_listed"), t.fx("keymap"), t.fx("zensus")
    first = resolve.resolve_ars_cascade(listings, key_map)
    second = resolve.resolve_by_census_name(first, census)
    a, b = keys(first, "ARS"), keys(second, "ARS")
    assert len(a) == len(b) == listings.count() == second.count()
    assert all(b[i] == v for i, v in a.items() if v is not None)
    assert sum(v is not None for v in b.values()) >= sum(v is not None for v in a.values()) > 0
    known = {r["ARS"] for r in key_map.select("ARS").distinct().collect()}
    assert {v for v in a.values() if v} <= known


def test_matchers_leave_known_keys_alone(t):
    listings = t.fx("places_listed").withColumn(
        "GKZ", F.when(F.col("listing_id") % 2 == 0, "given")
    )
    got = keys(resolve.match_token_overlap(listings, t.fx("keymap")), "GKZ")
    assert all(v == "given" for i, v in got.items() if i % 2 == 0)
    assert any(v not in (None, "given") for v in got.values())


@pytest.mark.parametrize(
    "run, column",
    [
        (lambda t, limit: resolve.resolve_gkz_cascade(t.fx("places_listed"), t.fx("keymap"), limit=limit), "GKZ"),
        (lambda t, limit: resolve.match_overlap_filtered(t.fx("places_listed"), t.fx("keymap"), limit=limit), "GKZ"),
        (lambda t, limit: resolve.join_two_candidates(t.fx("places_listed"), t.fx("zensus"), limit), "GKZ"),
    ],
)
def test_without_broadcast_the_result_is_the_same(t, run, column):
    assert keys(run(t, resolve.BROADCAST_LIMIT), column) == keys(run(t, 0), column)


def test_token_overlap_ties_and_pools(spark):
    key_map = spark.createDataFrame(
        [("a", "01001001", "Alt Neu", "00001", "Berg", 2), ("a", "01001002", "Alt Neu", "00001", "Tal", 1),
         ("a", "09001003", "Alt Neu", "00001", "Tal", 0), ("a", "09002004", "Ganz Anders", "00001", "Fern", 3)],
        "ARS string, AGS string, Gemeindename string, PLZ string, Ort string, row_no int",
    )
    listings = spark.createDataFrame(
        [(1, "00001", None, "Alt Neu", None, None), (2, "00001", None, "Alt", None, "K 01001"),
         (3, "00001", "Bayern", "Neu Tal", None, "K 01999"), (4, "00001", "Hessen", "Nichts", None, None),
         (5, "00009", None, "Alt Neu", None, None), (6, "00001", None, "Alt Neu", None, "K 09002")],
        "listing_id int, geo_plz string, regio1 string, regio3 string, regio2 string, geo_krs string",
    )
    plain = keys(resolve.match_token_overlap(listings, key_map), "GKZ")
    assert plain[1] == "09001003"  # equal scores: first map row
    assert plain[4] is None and plain[5] is None
    pooled = keys(resolve.match_overlap_filtered(listings, key_map), "GKZ")
    assert pooled[2] == "01001002"  # same district only
    assert pooled[3] == "09001003"  # no such district: same state
    assert pooled[6] is None  # its district has a candidate, but without a common word


def test_unique_maps_drop_ambiguous_empty_and_null(spark):
    df = spark.createDataFrame(
        [("1", "a", "x"), ("1", "b", "x"), ("2", "c", "x"), ("2", "d", "y"), (None, "e", "z"), ("", "f", "w")],
        "p string, n string, v string",
    )
    by_p, by_both = resolve.unique_key_maps(df, [["p"], ["p", "n"]], "v")
    assert [tuple(r) for r in by_p.collect()] == [("1", "x")]
    assert by_both.count() == 4
    assert [tuple(r) for r in resolve.unique_key_map(df, ["p"], "v").collect()] == [("1", "x")]


def test_hot_place_keys(spark):
    """A third of the listings in one PLZ and a third without any."""
    rows = [(i, "00001" if i % 3 == 0 else None if i % 3 == 1 else f"{i % 97:05d}", "Kiel", "x") for i in range(3000)]
    listings = spark.createDataFrame(rows, "listing_id int, geo_plz string, regio3 string, regio2 string")
    key_map = spark.createDataFrame(
        [(f"{i:012d}", f"{i:08d}", f"Ort {i}", f"{i:05d}", f"Ort {i}", i) for i in range(97)],
        "ARS string, AGS string, Gemeindename string, PLZ string, Ort string, row_no int",
    )
    wide = keys(resolve.resolve_ars_cascade(listings, key_map), "ARS")
    salted = keys(resolve.resolve_ars_cascade(listings, key_map, limit=0), "ARS")
    assert wide == salted and len(wide) == 3000
    assert sum(v is None for v in wide.values()) == 1000


def test_training_table_is_complete(t):
    cleaned = jobs.clean_listings(t.fx("listings"))
    keyed = jobs.resolve_listings(
        t.fx("listings").withColumn("periode_0005", F.lit(None).cast("string")), t.fx("keymap"), t.fx("zensus")
    )
    ready = jobs.train_ready(keyed)
    assert ready.where("floor is null or pricetrend is null or serviceCharge is null").count() == 0
    assert ready.where("length(ARS) <> 12").count() == 0
    joined = jobs.train_joined(jobs.train_ready(
        jobs.resolve_listings(cleaned, t.fx("keymap"), t.fx("zensus"))), t.fx("zensus"))
    assert joined.columns[-3:] == ["zensus_miete_total", "zensus_miete_decade", "zensus_factor_decade"]
