"""Older jobs, kept for comparison with the current ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.catalog import oracle as q
from rentlens.catalog.registry import query
from rentlens.functions.features import PERIOD_COLUMNS, PICK_PERIODS
from rentlens.operators import columns, resolve
from rentlens.plans import dormant


@query("P1_city_simple_from", f"SELECT place_id, {q.n12('raw_name')} AS city_simple FROM fx_places")
def p1(t):
    df = t.fx("places").select("place_id", F.col("raw_name").alias("address"))
    out = dormant.city_simple_from(df.withColumn("city", F.lit(None).cast("string")))
    return out.select("place_id", F.when(F.col("address").isNotNull(), F.col("city_simple"))
                      .alias("city_simple"))


FALLBACK = f"""
    rows AS (SELECT s.name AS state, {q.p4('Gemeindename')} AS gemeinde_norm,
                    Insgesamt AS zensus_miete
             FROM fx_zensus z LEFT JOIN fx_states s ON substr(z.GKZ, 1, 2) = s.code),
    means AS (SELECT gemeinde_norm, AVG(zensus_miete) AS zensus_miete FROM rows GROUP BY 1)
"""


@query(
    "P5_census_with_fallback",
    f"""WITH {FALLBACK} SELECT * FROM rows
        UNION ALL SELECT NULL, gemeinde_norm, zensus_miete FROM means""",
)
def p5(t):
    return dormant.census_with_fallback(t.fx("zensus"), "Insgesamt")


@query(
    "P6_join_census_fallback",
    f"""WITH {FALLBACK},
        single AS (SELECT {q.p4('state')} AS s, gemeinde_norm AS g, MIN(zensus_miete) AS v
                   FROM rows GROUP BY 1, 2 HAVING COUNT(*) = 1)
        SELECT listing_id, coalesce(v, zensus_miete) AS zensus_miete FROM fx_places_listed
        LEFT JOIN single ON {q.p4('regio1')} = s AND {q.p4("split_part(regio3, ' ', 1)")} = g
        LEFT JOIN means ON {q.p4("split_part(regio3, ' ', 1)")} = means.gemeinde_norm""",
)
def p6(t):
    census = dormant.census_with_fallback(t.fx("zensus"), "Insgesamt")
    df = t.fx("places_listed").select(
        "listing_id", "regio1", F.substring_index("regio3", " ", 1).alias("place")
    )
    joined = dormant.join_census_fallback(df, census, "place", "regio1")
    return joined.select("listing_id", "zensus_miete")


@query(
    "P7_basic_clean",
    f"""WITH k AS (SELECT listing_id, substr(geo_plz, 1, 3) AS zip3, substr(geo_plz, 1, 2) AS zip2,
               lower(typeOfFlat) AS typeOfFlat, livingSpace AS area_sqm, noRooms AS rooms,
               coalesce(floor, 0) AS floor, yearConstructed AS y, baseRent AS rent_cold,
               noRooms / nullif(livingSpace / 100.0e0, 0) AS rooms_per_100qm,
               floor / 5.0e0 AS floor_ratio, 2025 - yearConstructed AS building_age,
               coalesce(`condition`, 'unknown') AS `condition`
             FROM fx_listings WHERE {q.plausible('livingSpace', 'baseRent')})
        SELECT * EXCLUDE (y) REPLACE (coalesce(rooms, (SELECT median(rooms) FROM k)) AS rooms),
               coalesce(y, (SELECT median(y) FROM k)) AS year_built FROM k""",
)
def p7(t):
    raw = columns.rename_map(
        t.fx("listings"), {**columns.TRAIN_NAMES, "geo_plz": "zip_code"}
    ).withColumn("numberOfFloors", F.lit("5"))
    out = dormant.basic_clean(raw)
    return out.select(
        "listing_id", "zip3", "zip2", "typeOfFlat", "area_sqm", "rooms", "floor", "rent_cold",
        "rooms_per_100qm", "floor_ratio", "building_age", "condition", "year_built",
    )


_LONG = " UNION ALL ".join(
    f"SELECT {q.n12('Gemeindename')} AS c, GKZ AS row_no, '{p}' AS b, "
    f"`{p}` / nullif(Insgesamt, 0) AS f FROM fx_zensus"
    for p in PICK_PERIODS
)


@query(
    "P8_factor_lookup",
    f"""WITH lg AS ({_LONG}),
        own AS (SELECT c, b, f FROM lg QUALIFY
                row_number() OVER (PARTITION BY c, b ORDER BY row_no DESC) = 1),
        mean AS (SELECT b, AVG(f) AS m FROM lg GROUP BY b),
        l AS (SELECT listing_id, {q.n12('regio3')} AS c,
                     CASE WHEN {q.period('yearConstructed')} NOT IN ('1960_1969', '1990_1999')
                          THEN {q.period('yearConstructed')} END AS b FROM fx_places_listed)
        SELECT listing_id, round(CASE WHEN own.c IS NOT NULL THEN f ELSE m END, 9) AS factor_age,
               round(coalesce(CASE WHEN own.c IS NOT NULL THEN f ELSE m END, 1), 9) AS combined
        FROM l LEFT JOIN own ON l.c = own.c AND l.b = own.b LEFT JOIN mean ON l.b = mean.b""",
)
def p8(t):
    from rentlens.functions import features, places

    factors = resolve.period_factors(t.fx("zensus")).select(
        places.city_simple(F.col("Gemeindename")).alias("city_simple"),
        F.col("GKZ").alias("row_no"),
        *[F.col(f"factor_{p}").alias(p) for p in PICK_PERIODS],
    )
    listings = t.fx("places_listed").select(
        "listing_id",
        places.city_simple(F.col("regio3")).alias("city_simple"),
        features.year_bucket(F.col("yearConstructed")).alias("year_bucket"),
    )
    joined = dormant.factor_lookup(listings, factors, "year_bucket", "factor_age", PICK_PERIODS)
    return joined.select(
        "listing_id",
        F.round("factor_age", 9).alias("factor_age"),
        F.round(dormant.combined_factor("factor_age"), 9).alias("combined"),
    )


@query(
    "P9_canonical_listing",
    f"""SELECT listing_id, livingSpace AS area_sqm, CAST(NULL AS DOUBLE) AS netRent,
               totalRent AS warmRent, CAST(NULL AS VARCHAR) AS state_raw,
               {q.flag01('trim(balcony)')} AS balcony, {q.flag01('trim(hasKitchen)')} AS hasKitchen,
               {q.flag01('trim(garden)')} AS garden, {q.flag01('trim(lift)')} AS lift
        FROM fx_listings""",
)
def p9(t):
    out = dormant.canonical_listing(t.fx("listings"), ["listing_id"])
    return out.select(
        "listing_id", "area_sqm", "netRent", "warmRent", "state_raw", "balcony", "hasKitchen",
        "garden", "lift",
    )


STATE = f"""
    first AS (SELECT {q.plz5('PLZ')} AS PLZ, arg_min(AGS, row_no) AS AGS FROM fx_keymap GROUP BY 1),
    st AS (SELECT l.*, s.name AS derived FROM fx_places_listed l LEFT JOIN first f ON l.geo_plz = f.PLZ
           LEFT JOIN fx_states s ON substr(f.AGS, 1, 2) = s.code)
"""


@query("P10_state_from_plz", f"WITH {STATE} SELECT listing_id, derived AS state FROM st")
def p10(t):
    df = t.fx("places_listed").withColumnRenamed("geo_plz", "PLZ")
    return dormant.state_from_plz(df, t.fx("keymap")).select("listing_id", "state")


@query(
    "P11_attach_regionals",
    f"""WITH {STATE} SELECT listing_id, coalesce(CASE WHEN listing_id % 2 = 0 THEN regio1 END, derived)
        AS state, {q.period('yearConstructed')} AS periode_0005 FROM st""",
)
def p11(t):
    df = t.fx("places_listed").select(
        "listing_id",
        F.col("geo_plz").alias("PLZ"),
        F.when(F.col("listing_id") % 2 == 0, F.col("regio1")).alias("state_raw"),
        F.lit(None).cast("string").alias("periode_0005"),
        F.col("yearConstructed").alias("year_built"),
    )
    out = dormant.attach_regionals(df, t.fx("keymap"))
    return out.select("listing_id", "state", "periode_0005")


_RATES = ", ".join(f"AVG(`{p}`) AS `{p}`" for p in PERIOD_COLUMNS)
_PICK = "CASE p " + " ".join(f"WHEN '{p}' THEN `{p}`" for p in PERIOD_COLUMNS) + " END"


@query(
    "P12_expected_rent",
    f"""WITH r AS (SELECT {q.n1('Gemeindename')} AS n, AVG(Insgesamt) AS total, {_RATES}
                   FROM fx_zensus GROUP BY 1),
        l AS (SELECT listing_id, livingSpace, {q.n1('regio3')} AS c,
                     {q.period('yearConstructed')} AS p FROM fx_listings)
        SELECT listing_id, round(coalesce({_PICK}, total), 9) AS zensus_rate,
               round(coalesce({_PICK}, total) * livingSpace, 6) AS zensus_expected
        FROM l LEFT JOIN r ON l.c = r.n""",
)
def p12(t):
    from rentlens.functions import features

    listings = t.fx("listings").select(
        "listing_id",
        F.col("regio3").alias("city"),
        F.col("livingSpace").alias("area_sqm"),
        features.year_to_period(F.col("yearConstructed")).alias("periode_0005"),
    )
    out = dormant.expected_rent(listings, columns.load_zensus(t.fx("zensus")))
    return out.select(
        "listing_id",
        F.round("zensus_rate", 9).alias("zensus_rate"),
        F.round("zensus_expected", 6).alias("zensus_expected"),
    )
