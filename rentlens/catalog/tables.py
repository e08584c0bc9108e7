"""Imputation, aggregates, profiles, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.catalog import oracle as q
from rentlens.catalog.registry import query
from rentlens.functions import features, parsing
from rentlens.functions import text as tx
from rentlens.functions.features import PERIOD_COLUMNS
from rentlens.operators import aggregates, columns, filters, impute, resolve, sampling
from rentlens.plans import listings as jobs
from rentlens.plans import market

# --- imputation ---------------------------------------------------------------------


@query(
    "F1_fill_const",
    "SELECT listing_id, coalesce(floor, 0) AS floor, coalesce(`condition`, 'unknown') "
    "AS `condition` FROM fx_places_listed",
)
def f1(t):
    df = t.fx("places_listed").select("listing_id", "floor", "condition")
    return impute.fill_const(df, {"floor": 0.0, "condition": "unknown"})


@query(
    "F2_fill_mode",
    """WITH top AS (SELECT floor, COUNT(*) AS n FROM fx_places_listed WHERE floor IS NOT NULL
                    GROUP BY floor ORDER BY n DESC, floor LIMIT 1)
       SELECT listing_id, coalesce(floor, (SELECT floor FROM top), 0) AS floor
       FROM fx_places_listed""",
)
def f2(t):
    return impute.fill_mode(t.fx("places_listed").select("listing_id", "floor"), "floor", 0.0)


@query(
    "F3_fill_mean",
    """SELECT listing_id, round(coalesce(pricetrend, (SELECT AVG(pricetrend)
              FROM fx_places_listed)), 6) AS pricetrend FROM fx_places_listed""",
)
def f3(t):
    df = impute.fill_mean(t.fx("places_listed").select("listing_id", "pricetrend"), "pricetrend")
    return df.withColumn("pricetrend", F.round("pricetrend", 6))


_GROUP_MEDIAN = """
    WITH med AS (SELECT regio3, median(yearConstructed) AS my, median(noRooms) AS mr
                 FROM fx_listings WHERE regio3 IS NOT NULL GROUP BY regio3),
    filled AS (SELECT listing_id, l.regio3, coalesce(yearConstructed, my) AS y,
                      coalesce(noRooms, mr) AS r
               FROM fx_listings l LEFT JOIN med m ON l.regio3 = m.regio3)
    SELECT listing_id, regio3,
           CAST(coalesce(y, (SELECT median(y) FROM filled)) AS DOUBLE) AS yearConstructed,
           CAST(coalesce(r, (SELECT median(r) FROM filled)) AS DOUBLE) AS noRooms
    FROM filled
"""


@query("F4_fill_group_median", _GROUP_MEDIAN)
def f4(t):
    df = t.fx("listings").select("listing_id", "regio3", "yearConstructed", "noRooms")
    return impute.fill_group_median(df, ["yearConstructed", "noRooms"], "regio3")


@query(
    "F5_fill_row_then_median",
    "WITH filled AS (SELECT GKZ, Insgesamt, "
    + ", ".join(f"coalesce(`{p}`, Insgesamt) AS `{p}`" for p in PERIOD_COLUMNS)
    + " FROM fx_zensus) SELECT GKZ, coalesce(Insgesamt, (SELECT median(Insgesamt) FROM filled)) "
    "AS Insgesamt, "
    + ", ".join(
        f"coalesce(`{p}`, (SELECT median(`{p}`) FROM filled)) AS `{p}`" for p in PERIOD_COLUMNS
    )
    + " FROM filled",
)
def f5(t):
    df = t.fx("zensus").drop("Gemeindename")
    return impute.fill_row_then_median(df, PERIOD_COLUMNS, "Insgesamt")


@query(
    "F5_fill_column_medians",
    """SELECT listing_id,
              coalesce(pricetrend, (SELECT median(pricetrend) FROM fx_places_listed)) AS pricetrend,
              coalesce(totalRent, (SELECT median(totalRent) FROM fx_places_listed)) AS totalRent
       FROM fx_places_listed""",
)
def f5_wide(t):
    df = t.fx("places_listed").select("listing_id", "pricetrend", "totalRent")
    medians = impute.column_medians(df, ["pricetrend", "totalRent"])
    return df.withColumns({c: F.coalesce(F.col(c), m) for c, m in medians.items()})


@query(
    "I1_group_median",
    """SELECT listing_id, regio3,
              CASE WHEN regio3 IS NOT NULL THEN median(yearConstructed) OVER (PARTITION BY regio3)
              END AS median_yearConstructed,
              CASE WHEN regio3 IS NOT NULL THEN median(noRooms) OVER (PARTITION BY regio3)
              END AS median_noRooms
       FROM fx_listings""",
)
def i1(t):
    df = t.fx("listings").select("listing_id", "regio3", "yearConstructed", "noRooms")
    joined = impute.with_group_median(df, ["yearConstructed", "noRooms"], "regio3")
    return joined.drop("yearConstructed", "noRooms")


# --- aggregates ---------------------------------------------------------------------


@query(
    "H1_count_by_state",
    "SELECT regio1 AS state, COUNT(*) AS n_listings FROM fx_places_listed GROUP BY 1 "
    "ORDER BY n_listings DESC, state LIMIT 10",
)
def h1(t):
    immo = columns.normalize_immo(t.fx("places_listed"))
    return aggregates.count_by(immo, "state", 10)


@query(
    "H1_count_by_city",
    "SELECT trim(regio3) AS city, COUNT(*) AS n_listings FROM fx_places_listed GROUP BY 1",
)
def h1_city(t):
    return market.dashboard_tables(t.fx("places_listed"))["agg_city"]


_STATS = f"""
    SELECT trim(regio3) AS city, {q.n1('regio3')} AS city_norm, COUNT(*) AS n,
           median(CASE WHEN livingSpace > 0 THEN baseRent / livingSpace END) AS immo_median
    FROM fx_listings WHERE_CLAUSE GROUP BY 1, 2
"""


@query(
    "H2_city_stats",
    f"SELECT city, city_norm, n, round(immo_median, 9) AS immo_median "
    f"FROM ({_STATS.replace('WHERE_CLAUSE', '')})",
)
def h2(t):
    stats = aggregates.city_stats(columns.normalize_immo(t.fx("listings")))
    return stats.withColumn("immo_median", F.round("immo_median", 9))


@query(
    "G3_join_market_census",
    f"""WITH stats AS ({_STATS.replace('WHERE_CLAUSE', 'WHERE ' + q.plausible('livingSpace', 'baseRent'))}),
        census AS (SELECT Gemeindename, Insgesamt, {q.n1('Gemeindename')} AS name_norm
                   FROM fx_zensus)
        SELECT city, n, round(immo_median, 9) AS immo_median, Insgesamt AS zensus,
               round(immo_median - Insgesamt, 9) AS delta, Gemeindename
        FROM stats LEFT JOIN census ON city_norm = name_norm
        ORDER BY n DESC, city NULLS FIRST, Gemeindename NULLS FIRST, zensus LIMIT 20""",
)
def g3(t):
    compared = market.market_versus_census(t.fx("listings"), t.fx("zensus"))
    return compared.withColumns(
        {"immo_median": F.round("immo_median", 9), "delta": F.round("delta", 9)}
    )


FLAGS = ["balcony", "hasKitchen", "lift", "garden"]


@query(
    "H3_feature_share",
    " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round_even(AVG(coalesce({q.bool01(f)}, 0)) * 100, 1) "
        "AS share_pct FROM fx_places_listed"
        for f in FLAGS
    ),
)
def h3(t):
    return aggregates.feature_share(columns.normalize_immo(t.fx("places_listed")), FLAGS)


_FLAG_SUMS = ", ".join(f"SUM(coalesce({q.bool01(f)}, 0)) AS {f}" for f in FLAGS)


@query(
    "H4_feature_counts_by_plz",
    f"""WITH sums AS (SELECT {q.plz5('geo_plz')} AS plz_str, {_FLAG_SUMS} FROM fx_places_listed
                      GROUP BY 1)
        SELECT plz_str, CAST(balcony AS BIGINT) AS balcony, CAST(hasKitchen AS BIGINT) AS hasKitchen,
               CAST(lift AS BIGINT) AS lift, CAST(garden AS BIGINT) AS garden
        FROM sums WHERE plz_str IS NOT NULL
        ORDER BY balcony + hasKitchen + lift + garden DESC, plz_str LIMIT 10""",
)
def h4(t):
    immo = columns.normalize_immo(t.fx("places_listed"))
    return aggregates.feature_counts_by_plz(immo, FLAGS)


@query(
    "H4_feature_counts_all",
    f"""SELECT CASE WHEN listing_id % 10 <> 0 THEN geo_plz END AS plz,
               {', '.join(f'CAST(SUM(coalesce({q.bool01(f)}, 0)) AS BIGINT) AS {f}' for f in FLAGS)}
        FROM fx_places_listed GROUP BY 1""",
)
def h4_all(t):
    plz = F.when(F.col("listing_id") % 10 != 0, F.col("geo_plz"))
    return market.dashboard_tables(t.fx("places_listed").withColumn("plz", plz))["feat_by_plz"]


@query(
    "H5_match_rate",
    """SELECT COUNT(totalRent) AS matched, COUNT(*) AS total,
              round(COUNT(totalRent) / COUNT(*), 9) AS rate FROM fx_places_listed""",
)
def h5(t):
    return aggregates.match_rate(t.fx("places_listed"), "totalRent").withColumn(
        "rate", F.round("rate", 9)
    )


# Every column of the listings with its type.
_PROFILED = {
    "listing_id": "bigint",
    **dict.fromkeys(
        ["baseRent", "livingSpace", "noRooms", "floor", "yearConstructed", "totalRent", "pricetrend"], "double"
    ),
    **dict.fromkeys(
        [
            "serviceCharge", "regio1", "regio2", "regio3", "geo_plz", "geo_krs", "hasKitchen", "balcony",
            "garden", "lift", "heatingType", "typeOfFlat", "condition",
        ],
        "string",
    ),
    "listed_on": "date",
}


@query(
    "H6_missing_summary",
    " UNION ALL ".join(
        f"SELECT '{c}' AS `column`, COUNT(*) - COUNT(`{c}`) AS missing_count, "
        f"round_even(AVG(CASE WHEN `{c}` IS NULL THEN 1.0e0 ELSE 0.0e0 END) * 100, 1) "
        f"AS missing_pct, '{kind}' AS dtype FROM fx_listings"
        for c, kind in _PROFILED.items()
    ),
)
def h6(t):
    return aggregates.missing_summary(t.fx("listings"))


_DESCRIBED = ["baseRent", "floor", "totalRent"]


@query(
    "H7_describe_numeric",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS `column`, COUNT({c}) AS count, round(AVG({c}), 6) AS mean,
                   round(stddev_samp({c}), 6) AS std, MIN({c}) AS min,
                   round(quantile_cont({c}, 0.25), 6) AS p25,
                   round(quantile_cont({c}, 0.5), 6) AS p50,
                   round(quantile_cont({c}, 0.75), 6) AS p75, MAX({c}) AS max
            FROM fx_places_listed"""
        for c in _DESCRIBED
    ),
)
def h7(t):
    table = aggregates.describe_numeric(t.fx("places_listed"), _DESCRIBED)
    return table.withColumns(
        {c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")}
    )


@query(
    "H7_describe_text",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS `column`, COUNT({c}) AS count, COUNT(DISTINCT {c}) AS `unique`,
                   (SELECT {c} FROM fx_places_listed WHERE {c} IS NOT NULL GROUP BY {c}
                    ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS top,
                   (SELECT COUNT(*) FROM fx_places_listed WHERE {c} IS NOT NULL GROUP BY {c}
                    ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS freq
            FROM fx_places_listed"""
        for c in ("regio1", "regio3", "typeOfFlat")
    ),
)
def h7_text(t):
    return aggregates.describe_text(
        t.fx("places_listed"), ["regio1", "regio3", "typeOfFlat"]
    )


@query(
    "H8_key_uniqueness",
    "SELECT COUNT(*) AS rows, COUNT(DISTINCT geo_plz) AS distinct_keys, "
    "COUNT(*) > COUNT(DISTINCT geo_plz) AS has_duplicates FROM fx_places_listed",
)
def h8(t):
    return aggregates.key_uniqueness(t.fx("places_listed"), "geo_plz")


@query(
    "H9_value_counts",
    f"SELECT {q.period('yearConstructed')} AS periode, COUNT(*) AS n FROM fx_places_listed "
    "GROUP BY 1 ORDER BY n DESC, periode NULLS FIRST LIMIT 15",
)
def h9(t):
    df = t.fx("places_listed").select(
        features.year_to_period(F.col("yearConstructed")).alias("periode")
    )
    return aggregates.value_counts(df, "periode")


@query(
    "H10_area_means",
    """SELECT substr(GKZ, 1, 2) AS area_key, round(AVG(Insgesamt), 9) AS mean_rent
       FROM fx_zensus GROUP BY 1
       UNION ALL
       SELECT substr(GKZ, 1, 5), round(AVG(Insgesamt), 9) FROM fx_zensus GROUP BY 1""",
)
def h10(t):
    census = t.fx("zensus")
    both = resolve.area_means(census, "Insgesamt", 2, "mean_rent").unionByName(
        resolve.area_means(census, "Insgesamt", 5, "mean_rent")
    )
    return both.withColumn("mean_rent", F.round("mean_rent", 9))


@query(
    "H11_min_max_mean",
    f"""SELECT MIN(v) AS min, MAX(v) AS max, round(AVG(v), 6) AS mean FROM
        (SELECT coalesce({q.num_comma('serviceCharge')}, 0) AS v FROM fx_places_listed)""",
)
def h11(t):
    df = t.fx("places_listed").select(
        F.coalesce(parsing.to_num_comma(F.col("serviceCharge")), F.lit(0.0)).alias("v")
    )
    return aggregates.min_max_mean(df, "v").withColumn("mean", F.round("mean", 6))


@query(
    "H12_histogram",
    f"""WITH x AS (SELECT baseRent / livingSpace AS v FROM fx_listings
                   WHERE {q.plausible('livingSpace', 'baseRent')}),
        span AS (SELECT MIN(v) AS low, MAX(v) AS high FROM x),
        counts AS (SELECT CAST(least(floor((v - low) / (high - low) * 60), 59) AS INTEGER) AS bin,
                          COUNT(*) AS n FROM x, span GROUP BY 1),
        bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(60))
        SELECT b.bin, round(low + b.bin * ((high - low) / 60), 9) AS lower, coalesce(n, 0) AS n
        FROM bins b CROSS JOIN span LEFT JOIN counts c ON b.bin = c.bin""",
)
def h12(t):
    df = filters.plausible(t.fx("listings"), "livingSpace", "baseRent")
    rates = aggregates.with_rent_per_sqm(df, "baseRent", "livingSpace")
    return aggregates.histogram(rates, "rent_per_sqm").withColumn("lower", F.round("lower", 9))


@query(
    "H13_distinct_places",
    f"""WITH raw AS (SELECT DISTINCT coalesce(nullif(trim(regio3), ''), regio2, '') AS city_raw
                     FROM fx_places_listed)
        SELECT city_raw, {q.n11('city_raw')} AS city_norm FROM raw""",
)
def h13(t):
    return aggregates.distinct_places(t.fx("places_listed"))


@query(
    "H13_count_places",
    f"""WITH raw AS (SELECT DISTINCT coalesce(nullif(trim(regio3), ''), regio2, '') AS city_raw
                     FROM fx_places_listed)
        SELECT COUNT(*) AS raw_names, COUNT(DISTINCT {q.n11('city_raw')}) AS norm_names FROM raw""",
)
def h13_counts(t):
    return aggregates.count_places(aggregates.distinct_places(t.fx("places_listed")))


# --- top-k, samples, sets -----------------------------------------------------------


@query(
    "J1_top_k",
    "SELECT listing_id, baseRent FROM fx_places_listed ORDER BY baseRent DESC, listing_id LIMIT 30",
)
def j1(t):
    df = t.fx("places_listed").select("listing_id", "baseRent")
    return aggregates.top_k(df, "baseRent", 30, "listing_id")


@query(
    "J2_seeded_sample",
    "SELECT listing_id, baseRent FROM fx_places_listed "
    "ORDER BY md5(CAST(listing_id AS VARCHAR)), listing_id LIMIT 1000",
)
def j2(t):
    df = t.fx("places_listed").select("listing_id", "baseRent")
    return sampling.seeded_sample(df, "listing_id", 1000)


@query(
    "J3_split",
    f"SELECT listing_id, CASE WHEN {q.train_hash('listing_id')} THEN 'test' ELSE 'train' END "
    "AS part FROM fx_places_listed",
)
def j3(t):
    train, test = sampling.split(t.fx("places_listed").select("listing_id"), "listing_id")
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


@query("K1_dedupe", "SELECT DISTINCT PLZ, AGS, Gemeindename FROM fx_keymap")
def k1(t):
    return sampling.dedupe(t.fx("keymap").select("PLZ", "AGS", "Gemeindename"))


@query(
    "K1_dedupe_subset",
    "SELECT PLZ, AGS, row_no FROM (SELECT *, row_number() OVER (PARTITION BY PLZ ORDER BY row_no) "
    "AS rn FROM fx_keymap) WHERE rn = 1",
)
def k1_subset(t):
    df = t.fx("keymap").select("PLZ", "AGS", "row_no")
    return sampling.dedupe(df, ["PLZ"], ["row_no"])


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({q.n8(x)}, ' '), lambda w: w <> ''))"


@query(
    "K2_set_algebra",
    f"""SELECT listing_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS common,
               CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS united
        FROM (SELECT listing_id, {_tokens('regio3')} AS a, {_tokens('regio2')} AS b
              FROM fx_places_listed)""",
)
def k2(t):
    from rentlens.functions.places import letters_only

    a, b = tx.tokens(letters_only(F.col("regio3"))), tx.tokens(letters_only(F.col("regio2")))
    return t.fx("places_listed").select(
        "listing_id",
        F.size(F.array_intersect(a, b)).alias("common"),
        F.size(F.array_union(a, b)).alias("united"),
    )


# --- whole cleaning jobs ------------------------------------------------------------


@query(
    "job_first_pass",
    f"""WITH core AS (SELECT listing_id, baseRent AS rent_cold, livingSpace AS area_sqm,
               noRooms AS rooms, coalesce(floor, 0) AS floor, yearConstructed AS year_built,
               coalesce(lower(`condition`), 'unknown') AS `condition`, geo_plz AS zip_code,
               coalesce(regio3, regio2) AS city, regio2 AS district
             FROM fx_listings WHERE {q.plausible('livingSpace', 'baseRent')}),
        med AS (SELECT city, median(year_built) AS my, median(rooms) AS mr FROM core GROUP BY city),
        f AS (SELECT core.* REPLACE (coalesce(year_built, my) AS year_built,
                                     coalesce(rooms, mr) AS rooms)
              FROM core LEFT JOIN med ON core.city = med.city),
        g AS (SELECT * REPLACE (coalesce(year_built, (SELECT median(year_built) FROM f)) AS year_built,
                                coalesce(rooms, (SELECT median(rooms) FROM f)) AS rooms) FROM f)
        SELECT *, rent_cold / area_sqm AS price_per_sqm, 2025 - year_built AS building_age
        FROM g WHERE rooms > 0 AND area_sqm > 10""",
)
def first_pass(t):
    return jobs.first_pass(t.fx("listings"))


@query(
    "job_clean_listings",
    f"""WITH a AS (SELECT listing_id, baseRent AS rent_cold, livingSpace AS area_sqm,
               noRooms AS rooms, CASE WHEN floor < 0 THEN 0 WHEN floor > 60 THEN 60 ELSE floor END
               AS floor, {q.bool01('balcony')} AS balcony, {q.bool01('hasKitchen')} AS hasKitchen,
               coalesce({q.num_comma('serviceCharge')}, 0) AS serviceCharge, totalRent, pricetrend,
               {q.period('yearConstructed')} AS p,
               CASE WHEN heatingType IN ('central_heating', 'district_heating', 'gas_heating')
                    THEN heatingType ELSE 'other' END AS heatingType_clean,
               lower(typeOfFlat) AS typeOfFlat
             FROM fx_listings),
        top AS (SELECT floor FROM a WHERE floor IS NOT NULL GROUP BY floor
                ORDER BY COUNT(*) DESC, floor LIMIT 1)
        SELECT listing_id, rent_cold, area_sqm, rooms,
               coalesce(floor, (SELECT floor FROM top)) AS floor, balcony, hasKitchen,
               serviceCharge, CASE WHEN totalRent IS NULL OR totalRent = 0
                   THEN rent_cold + serviceCharge ELSE totalRent END AS totalRent,
               round(coalesce(pricetrend, (SELECT AVG(pricetrend) FROM a)), 6) AS pricetrend,
               coalesce(p, 'unknown') AS periode_0005, heatingType_clean, typeOfFlat
        FROM a""",
)
def clean_listings(t):
    cleaned = jobs.clean_listings(t.fx("listings"))
    return cleaned.select(
        "listing_id", "rent_cold", "area_sqm", "rooms", "floor", "balcony", "hasKitchen",
        "serviceCharge", "totalRent", F.round("pricetrend", 6).alias("pricetrend"),
        "periode_0005", "heatingType_clean", "typeOfFlat",
    )


@query(
    "job_clean_census",
    "WITH filled AS (SELECT GKZ, Gemeindename, Insgesamt, "
    + ", ".join(f"coalesce(`{p}`, Insgesamt) AS `{p}`" for p in PERIOD_COLUMNS)
    + " FROM fx_zensus) SELECT * FROM filled",
)
def clean_census(t):
    raw = t.fx("zensus")
    texts = raw.select(
        F.ltrim(F.col("GKZ"), F.lit("0")).alias("﻿GKZ "),
        F.col("Gemeindename"),
        F.concat(F.translate(F.col("Insgesamt").cast("string"), ".", ","), F.lit(" €")).alias(
            "Miete_raw"
        ),
        *[
            F.translate(columns.quoted(p).cast("string"), ".", ",").alias(p)
            for p in PERIOD_COLUMNS
        ],
    )
    return jobs.clean_census(texts)
