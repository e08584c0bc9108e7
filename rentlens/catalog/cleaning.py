"""Schema resolution, filters, parsing, place names and derived features."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.catalog import oracle as q
from rentlens.catalog.registry import query
from rentlens.functions import features, parsing, places
from rentlens.functions import text as tx
from rentlens.functions.features import PERIOD_COLUMNS, PICK_PERIODS, SIZE_COLUMNS
from rentlens.operators import aggregates, columns, filters, resolve

# --- schema resolution --------------------------------------------------------------


@query(
    "B1_pick_alias",
    """SELECT listing_id, livingSpace AS area_sqm, `condition`, CAST(NULL AS VARCHAR) AS lat
       FROM fx_listings""",
)
def b1(t):
    aliases = {c: columns.LISTING_ALIASES[c] for c in ("area_sqm", "condition", "lat")}
    return columns.select_aliases(t.fx("listings"), {"listing_id": ["listing_id"], **aliases})


@query(
    "B2_pick_alias_ci",
    "SELECT listing_id, baseRent AS coldRent, balcony, hasKitchen FROM fx_places_listed",
)
def b2(t):
    wanted = {
        "listing_id": ["LISTING_ID"],
        "coldRent": ["netrent", "BASERENT"],
        "balcony": ["hasbalcony", "BALCONY"],
        "hasKitchen": columns.DASHBOARD_ALIASES["hasKitchen"],
    }
    return columns.select_aliases(t.fx("places_listed"), wanted, case_sensitive=False)


STANDARD = """
    SELECT listing_id, regio3 AS city, geo_plz AS zip_code, regio2 AS district,
           CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon, livingSpace AS area_sqm,
           noRooms AS rooms, floor, CAST(yearConstructed AS INTEGER) AS year_built, `condition`,
           baseRent AS rent_cold, totalRent AS rent_warm, CAST(NULL AS VARCHAR) AS created_at
    FROM fx_listings
"""


@query("B3_standardize_listings", STANDARD)
def b3(t):
    return columns.standardize_listings(t.fx("listings"), keep=["listing_id"])


@query(
    "B4_pack_extra_json",
    """SELECT listing_id, to_json({'serviceCharge': serviceCharge, 'heatingType': heatingType,
              'garden': garden}) AS extra_json FROM fx_places_listed""",
)
def b4(t):
    packed = columns.pack_json(["serviceCharge", "heatingType", "garden"])
    return t.fx("places_listed").select("listing_id", packed.alias("extra_json"))


@query(
    "B5_rename_map",
    "SELECT listing_id, baseRent AS rent_cold, livingSpace AS area_sqm, noRooms AS rooms "
    "FROM fx_listings",
)
def b5(t):
    df = t.fx("listings").select("listing_id", "baseRent", "livingSpace", "noRooms")
    return columns.rename_map(df, {**columns.TRAIN_NAMES, "absent": "nothing"})


@query(
    "B6_drop_existing",
    "SELECT listing_id, baseRent, regio1, typeOfFlat FROM fx_places_listed",
)
def b6(t):
    df = t.fx("places_listed").select(
        "listing_id", "baseRent", "regio1", "typeOfFlat", "condition", "heatingType"
    )
    return columns.drop_existing(df, columns.DROP_LIST)


@query(
    "B7_keep_existing",
    "SELECT floor, pricetrend, serviceCharge, garden, lift, hasKitchen, typeOfFlat, listing_id "
    "FROM fx_places_listed",
)
def b7(t):
    return columns.keep_existing(t.fx("places_listed"), [*columns.TRAIN_COLUMNS, "listing_id"])


@query("B8_require_columns", "SELECT listing_id, baseRent, regio3 FROM fx_places_listed")
def b8(t):
    names = ["listing_id", "baseRent", "regio3"]
    return columns.require_columns(t.fx("places_listed"), names).select(*names)


@query("B9_tag_source", "SELECT listing_id, 'portal' AS source FROM fx_places_listed")
def b9(t):
    return columns.tag_source(t.fx("places_listed").select("listing_id"), "portal")


@query("B10_clean_headers", "SELECT listing_id, geo_plz AS `PLZ neu` FROM fx_places_listed")
def b10(t):
    df = t.fx("places_listed").select(
        F.col("listing_id").alias("﻿listing_id "), F.col("geo_plz").alias(" PLZ   neu")
    )
    return columns.clean_headers(df)


@query("B11_find_key_column", "SELECT GKZ, Gemeindename AS label FROM fx_zensus")
def b11(t):
    df = t.fx("zensus").withColumnsRenamed({"GKZ": "Gemeindeschlüssel", "Gemeindename": "Gemeinde"})
    key, name = columns.find_key_column(df.columns)
    return df.select(F.col(key).alias("GKZ"), F.col(name).alias("label"))


@query(
    "B12_load_zensus",
    f"SELECT GKZ, Gemeindename, Insgesamt, `vor_1919`, `2016_plus`, {q.n1('Gemeindename')} "
    "AS name_norm FROM fx_zensus",
)
def b12(t):
    wanted = ["GKZ", "Gemeindename", "Insgesamt", "vor_1919", "2016_plus"]
    raw = t.fx("zensus").select(
        *[columns.quoted(c).cast("string").alias(c) for c in wanted]
    )
    return columns.load_zensus(raw.withColumnRenamed("GKZ", "ars"))


@query(
    "B13_load_key_map",
    f"""SELECT ARS, AGS, PLZ, Gemeindename, Ort, {q.n1('Gemeindename')} AS name_norm,
               {q.n1('Ort')} AS ort_norm, MIN(row_no) AS row_no
        FROM fx_keymap GROUP BY ALL""",
)
def b13(t):
    return columns.load_key_map(t.fx("keymap").withColumnRenamed("ARS", "ars"))


@query(
    "B13_load_key_map_filled",
    f"""SELECT DISTINCT {q.digits('ARS')} AS ARS, CAST(NULL AS VARCHAR) AS AGS,
               {q.plz5('PLZ')} AS PLZ, Gemeindename, Ort, {q.n2('Gemeindename')} AS name_norm,
               {q.n2('Ort')} AS ort_norm
        FROM fx_keymap""",
)
def b13_filled(t):
    raw = t.fx("keymap").drop("AGS", "row_no")
    return columns.load_key_map(raw, "sandbox", fill_missing=True)


def _melt(names: list[str]) -> str:
    parts = [
        f"SELECT GKZ AS ags, Gemeindename AS gemeinde, '{c}' AS baujahr, `{c}` AS miete_qm "
        "FROM fx_zensus"
        for c in names
    ]
    return " UNION ALL ".join(parts)


@query(
    "B14_melt_long",
    f"SELECT * FROM ({_melt(PERIOD_COLUMNS)}) WHERE miete_qm BETWEEN 2 AND 30",
)
def b14(t):
    return columns.melt_long(
        t.fx("zensus"), "GKZ", "Gemeindename", PERIOD_COLUMNS, var_name="baujahr"
    )


@query(
    "B15_detect_numeric_columns",
    """WITH head AS (SELECT * FROM fx_report ORDER BY row_no LIMIT 80),
       cells AS (SELECT 'col_0' AS `column`, col_0 AS v FROM head
                 UNION ALL SELECT 'col_2', col_2 FROM head
                 UNION ALL SELECT 'col_3', col_3 FROM head),
       shares AS (SELECT `column`, AVG(CASE WHEN TRY_CAST(replace(v, ',', '.') AS DOUBLE)
                  IS NOT NULL THEN 1.0 ELSE 0.0 END) AS share FROM cells GROUP BY ALL)
       SELECT `column`, CAST(share AS DOUBLE) AS share, share > 0.5 AS is_numeric FROM shares""",
)
def b15(t):
    return columns.detect_numeric_columns(
        t.fx("report"), "row_no", ["col_0", "col_2", "col_3"]
    )


@query(
    "B16_resolve_features",
    "SELECT floor, pricetrend, serviceCharge, garden, lift, hasKitchen, typeOfFlat "
    "FROM fx_places_listed",
)
def b16(t):
    from rentlens.plans.pricing import RICH_CATEGORICAL, RICH_NUMERIC

    df = t.fx("places_listed")
    found = columns.resolve_features(df, RICH_NUMERIC, RICH_CATEGORICAL)
    return df.select(*found["numeric"], *found["categorical"])


@query(
    "B17_normalize_immo",
    f"""SELECT listing_id, regio1 AS state, trim(regio3) AS city, baseRent AS coldRent,
               livingSpace AS area_sqm, coalesce({q.bool01('balcony')}, 0) AS balcony,
               coalesce({q.bool01('hasKitchen')}, 0) AS hasKitchen,
               {q.n1('regio3')} AS city_norm,
               CASE WHEN livingSpace > 0 THEN baseRent / livingSpace END AS rent_per_sqm
        FROM fx_listings""",
)
def b17(t):
    immo = columns.normalize_immo(t.fx("listings"))
    return immo.select(
        "listing_id", "state", "city", "coldRent", "area_sqm", "balcony", "hasKitchen",
        "city_norm", "rent_per_sqm",
    )


# --- filters ------------------------------------------------------------------------


@query(
    "C1_plausible",
    f"SELECT listing_id, baseRent, livingSpace FROM fx_listings "
    f"WHERE {q.plausible('livingSpace', 'baseRent')}",
)
def c1(t):
    df = t.fx("listings").select("listing_id", "baseRent", "livingSpace")
    return filters.plausible(df, "livingSpace", "baseRent")


@query(
    "C2_has_target",
    "SELECT listing_id, totalRent, floor FROM fx_places_listed "
    "WHERE totalRent IS NOT NULL AND floor IS NOT NULL",
)
def c2(t):
    df = t.fx("places_listed").select("listing_id", "totalRent", "floor")
    return filters.has_target(df, "totalRent", "floor")


@query(
    "C2_removed_rows",
    """SELECT COUNT(*) AS rows_before,
              COUNT(*) FILTER (WHERE totalRent IS NOT NULL AND floor IS NOT NULL) AS rows_after,
              COUNT(*) FILTER (WHERE totalRent IS NULL OR floor IS NULL) AS rows_removed
       FROM fx_places_listed""",
)
def c2_counts(t):
    return filters.removed_rows(t.fx("places_listed"), "totalRent", "floor")


@query(
    "C3_rent_between_2_30",
    "SELECT listing_id, pricetrend FROM fx_places_listed WHERE pricetrend BETWEEN 2 AND 30",
)
def c3(t):
    return filters.rent_between(
        t.fx("places_listed").select("listing_id", "pricetrend"), "pricetrend"
    )


@query(
    "C4_valid_key",
    f"SELECT text_id, {q.pad(q.digits('key_text'), 12)} AS key_text FROM fx_texts "
    f"WHERE {q.digits('key_text')} IS NOT NULL",
)
def c4(t):
    return filters.valid_key(t.fx("texts").select("text_id", "key_text"), "key_text")


@query(
    "C4_valid_mapping_rows",
    f"SELECT text_id, {q.plz5('plz_text')} AS PLZ, {q.digits('key_text')} AS AGS FROM fx_texts "
    f"WHERE {q.plz5('plz_text')} IS NOT NULL AND {q.digits('key_text')} IS NOT NULL",
)
def c4_mapping(t):
    df = t.fx("texts").select(
        "text_id", F.col("plz_text").alias("PLZ"), F.col("key_text").alias("AGS")
    )
    return filters.valid_mapping_rows(df)


@query(
    "C5_positive_rooms",
    "SELECT listing_id, noRooms, livingSpace FROM fx_listings "
    "WHERE noRooms > 0 AND livingSpace > 10",
)
def c5(t):
    df = t.fx("listings").select("listing_id", "noRooms", "livingSpace")
    return filters.positive_rooms(df, "noRooms", "livingSpace")


@query(
    "C6_inconsistent_total",
    "SELECT COUNT(*) AS inconsistent FROM fx_places_listed WHERE totalRent < baseRent",
)
def c6(t):
    return filters.inconsistent_total(t.fx("places_listed"), "totalRent", "baseRent")


# --- parsing ------------------------------------------------------------------------


def _texts(name: str, expression: str, out: str, fn, source: str = "fx_texts", key: str = "text_id"):
    """Register one scalar function over a text column."""

    @query(name, f"SELECT {key}, {expression} AS {out} FROM {source}")
    def run(t):
        return t.sql(f"SELECT * FROM {source}").select(key, fn().alias(out))

    return run


_texts("D1_to_num", q.num("num_text"), "value", lambda: parsing.to_num(F.col("num_text")))
_texts(
    "D2_to_num_comma", q.num_comma("num_text"), "value",
    lambda: parsing.to_num_comma(F.col("num_text")),
)

_MONEY = q.strip(q.rep("num_text", ("€/m²", ""), ("€", "")))
_texts(
    "D3_to_float_de",
    q.num(
        rf"replace(CASE WHEN regexp_full_match({_MONEY}, '[+-]?[0-9]{{1,3}}(\.[0-9]{{3}})+(,[0-9]*)?') "
        rf"THEN replace({_MONEY}, '.', '') ELSE {_MONEY} END, ',', '.')"
    ),
    "value",
    lambda: parsing.to_float_de(F.col("num_text")),
)
_texts(
    "D4_zensus_to_float",
    q.num(
        q.rep(
            q.sub(q.rep("num_text", ("€/m²", ""), ("€ / m²", ""), ("€", "")), r"\(.*?\)", ""),
            ("e", ""), (",", "."),
        )
    ),
    "value",
    lambda: parsing.zensus_to_float(F.col("num_text")),
)
_texts(
    "D5_strip_to_number",
    q.num(q.rep(q.sub("num_text", r"[^0-9,.\-]", ""), (",", "."))),
    "value",
    lambda: parsing.strip_to_number(F.col("num_text")),
)
_texts("D6_to_bool01", q.bool01("flag_text"), "flag", lambda: parsing.to_bool01(F.col("flag_text")))
_texts("D7_flag01", q.flag01("flag_text"), "flag", lambda: parsing.flag01(F.col("flag_text")))
_texts(
    "D8_flag_int",
    f"coalesce(CAST({q.num('flag_text')} AS INTEGER), 0)",
    "flag",
    lambda: parsing.flag_int(F.col("flag_text")),
)
_texts("D9_plz5", q.plz5("plz_text"), "plz5", lambda: parsing.plz5(F.col("plz_text")))
_texts(
    "D10_pad_key", q.pad(q.digits("key_text"), 12), "gkz",
    lambda: parsing.pad_key(F.col("key_text"), 12),
)
_texts(
    "D10_pad_key_ags", q.pad(q.digits("key_text"), 8), "ags",
    lambda: parsing.pad_key(F.col("key_text"), 8),
)
_texts(
    "D15_tidy_category",
    "coalesce("
    + q.rep(q.sub(f"lower({q.strip('category_text')})", q.WS + "+", " "), ("/", ","), (";", ","))
    + ", 'unknown')",
    "category",
    lambda: parsing.tidy_category(F.col("category_text")),
)


@query(
    "D11_key_prefix",
    "SELECT row_no, substr(AGS, 1, 2) AS state_key, substr(AGS, 1, 5) AS district_key "
    "FROM fx_keymap",
)
def d11(t):
    return t.fx("keymap").select(
        "row_no",
        parsing.key_prefix(F.col("AGS"), 2).alias("state_key"),
        parsing.key_prefix(F.col("AGS"), 5).alias("district_key"),
    )


@query(
    "D12_kreis5",
    "SELECT listing_id, nullif(regexp_extract(coalesce(geo_krs, regio2), '([0-9]{5})', 1), '') "
    "AS kreis5 FROM fx_places_listed",
)
def d12(t):
    df = t.fx("places_listed")
    return df.select("listing_id", resolve.kreis5(df).alias("kreis5"))


@query(
    "D13_state_code",
    f"SELECT listing_id, {q.state_code('regio1')} AS code, "
    f"{q.state_code(q.fold('lower(regio1)'))} AS folded FROM fx_places_listed",
)
def d13(t):
    plain = tx.fold_umlaut(F.lower("regio1"))
    return t.fx("places_listed").select(
        "listing_id",
        parsing.state_code(F.col("regio1")).alias("code"),
        parsing.state_code(plain).alias("folded"),
    )


_texts(
    "D14_fold_umlaut", q.fold("lower(raw_name)"), "folded",
    lambda: tx.fold_umlaut(F.lower("raw_name")), "fx_places", "place_id",
)


@query(
    "D16_heating_clean",
    "SELECT listing_id, CASE WHEN heatingType IN ('central_heating', 'district_heating', "
    "'gas_heating') THEN heatingType ELSE 'other' END AS heatingType_clean FROM fx_places_listed",
)
def d16(t):
    return t.fx("places_listed").select(
        "listing_id", parsing.heating_clean(F.col("heatingType")).alias("heatingType_clean")
    )


@query(
    "D17_lower_condition",
    "SELECT listing_id, nullif(lower(`condition`), '') AS to_train, "
    "coalesce(lower(`condition`), '') AS to_score FROM fx_places_listed",
)
def d17(t):
    return t.fx("places_listed").select(
        "listing_id",
        parsing.lower_condition(F.col("condition")).alias("to_train"),
        parsing.lower_condition(F.col("condition"), "").alias("to_score"),
    )


@query(
    "D18_pick_place_source",
    "SELECT listing_id, coalesce(nullif(trim(regio3), ''), regio2, '') AS place, "
    "coalesce(regio3, '') AS by_column FROM fx_places_listed",
)
def d18(t):
    df = t.fx("places_listed")
    place = F.coalesce(tx.blank_to_null(F.col("regio3")), F.col("regio2"), F.lit(""))
    return df.select(
        "listing_id", place.alias("place"), resolve.city_source(df).alias("by_column")
    )


@query(
    "D19_tokens",
    f"SELECT place_id, array_to_string(list_sort(list_distinct(list_filter(string_split({q.n8('raw_name')}, "
    "' '), lambda w: w <> ''))), '|') AS words FROM fx_places",
)
def d19(t):
    words = tx.tokens(places.letters_only(F.col("raw_name")))
    return t.fx("places").select(
        "place_id", F.array_join(F.array_sort(words), "|").alias("words")
    )


@query(
    "D20_cold_from_warm",
    f"SELECT listing_id, totalRent - {q.num(q.rep('serviceCharge', (',', '.')))} AS coldRent "
    "FROM fx_places_listed",
)
def d20(t):
    service = F.translate("serviceCharge", ",", ".")
    cold = parsing.cold_from_warm(F.lit(None).cast("double"), F.col("totalRent"), service)
    return t.fx("places_listed").select("listing_id", cold.alias("coldRent"))


@query(
    "D21_format_date_de",
    "SELECT request_id, strftime(due_date, '%d.%m.%Y') AS due FROM fx_reminders",
)
def d21(t):
    return t.fx("reminders").select(
        "request_id", parsing.format_date_de(F.col("due_date")).alias("due")
    )


@query(
    "D22_format_amount", "SELECT id, printf('%.2f', rent_base) AS amount FROM fx_leases"
)
def d22(t):
    return t.fx("leases").select("id", parsing.format_amount(F.col("rent_base")).alias("amount"))


@query(
    "D23_display_label",
    "SELECT id, street || ', ' || zip_code || ' ' || city AS label FROM fx_properties",
)
def d23(t):
    label = parsing.address_label(F.col("street"), F.col("zip_code"), F.col("city"))
    return t.fx("properties").select("id", label.alias("label"))


# --- place names --------------------------------------------------------------------

_VARIANTS = {
    "N1_dashboard": (q.n1, "dashboard"),
    "N2_sandbox": (q.n2, "sandbox"),
    "N3_census_name": (q.n3, "census_name"),
    "N4_census_name_wide": (q.n4, "census_name_wide"),
    "N5_separators": (q.n5, "separators"),
    "N6_substrings": (q.n6, "substrings"),
    "N7_cut_suffixes": (q.n7, "cut_suffixes"),
    "N8_letters_only": (q.n8, "letters_only"),
    "N9_nine_words": (q.n9, "nine_words"),
    "N10_unique_census": (q.n10, "unique_census"),
    "N11_trailing_words": (q.n11, "trailing_words"),
    "N12_city_simple": (q.n12, "city_simple"),
    "N12_city_display": (q.n12_display, "city_display"),
    "P4_norm_name": (q.p4, "norm_name"),
}


def _place(name: str, sql, variant: str):
    _texts(
        name, sql("raw_name"), "name_norm",
        lambda: places.normalize_place(F.col("raw_name"), variant), "fx_places", "place_id",
    )


for _name, (_sql, _variant) in _VARIANTS.items():
    _place(_name, _sql, _variant)


# --- derived features ---------------------------------------------------------------


@query(
    "E1_year_to_period",
    f"SELECT listing_id, {q.period('yearConstructed')} AS periode FROM fx_places_listed",
)
def e1(t):
    return t.fx("places_listed").select(
        "listing_id", features.year_to_period(F.col("yearConstructed")).alias("periode")
    )


@query(
    "E2_decade",
    "SELECT listing_id, CAST(floor(yearConstructed / 10) * 10 AS INTEGER) AS dekade "
    "FROM fx_places_listed",
)
def e2(t):
    return t.fx("places_listed").select(
        "listing_id", features.decade(F.col("yearConstructed")).alias("dekade")
    )


@query(
    "E3_period_or_unknown",
    f"SELECT listing_id, coalesce({q.period('yearConstructed')}, "
    "CASE WHEN listing_id % 2 = 0 THEN 'vor_1919' END, 'unknown') AS periode "
    "FROM fx_places_listed",
)
def e3(t):
    existing = F.when(F.col("listing_id") % 2 == 0, "vor_1919")
    return t.fx("places_listed").select(
        "listing_id",
        features.period_or_unknown(F.col("yearConstructed"), existing).alias("periode"),
    )


@query(
    "E4_price_per_sqm",
    "SELECT listing_id, CASE WHEN livingSpace > 0 THEN baseRent / livingSpace END AS eur_sqm "
    "FROM fx_listings",
)
def e4(t):
    rate = features.price_per_sqm(F.col("baseRent"), F.col("livingSpace"))
    return t.fx("listings").select("listing_id", rate.alias("eur_sqm"))


@query(
    "E5_building_age",
    "SELECT listing_id, 2025 - yearConstructed AS building_age FROM fx_places_listed",
)
def e5(t):
    return t.fx("places_listed").select(
        "listing_id", features.building_age(F.col("yearConstructed")).alias("building_age")
    )


@query(
    "E6_fill_total_rent",
    f"""SELECT listing_id, CASE WHEN totalRent IS NULL OR totalRent = 0
           THEN coalesce(baseRent, 0) + coalesce({q.num_comma('serviceCharge')}, 0)
           ELSE totalRent END AS totalRent FROM fx_places_listed""",
)
def e6(t):
    service = parsing.to_num_comma(F.col("serviceCharge"))
    total = features.fill_total_rent(F.col("totalRent"), F.col("baseRent"), service)
    return t.fx("places_listed").select("listing_id", total.alias("totalRent"))


@query(
    "E7_clamp_floor",
    "SELECT listing_id, CASE WHEN floor < 0 THEN 0 WHEN floor > 60 THEN 60 ELSE floor END "
    "AS floor FROM fx_places_listed",
)
def e7(t):
    return t.fx("places_listed").select(
        "listing_id", features.clamp_floor(F.col("floor")).alias("floor")
    )


@query(
    "E8_period_factors",
    "SELECT GKZ, "
    + ", ".join(f"`{p}` / nullif(Insgesamt, 0) AS `factor_{p}`" for p in PICK_PERIODS)
    + " FROM fx_zensus",
)
def e8(t):
    factors = resolve.period_factors(t.fx("zensus"))
    return factors.select("GKZ", *[F.col(f"factor_{p}") for p in PICK_PERIODS])


@query(
    "E9_size_factors",
    f"SELECT {q.n12('Gemeindename')} AS city_simple, GKZ, "
    + ", ".join(f"`{c}` / nullif(Insgesamt, 0) AS `{c}`" for c in SIZE_COLUMNS)
    + " FROM fx_zensus_sizes",
)
def e9(t):
    return t.fx("zensus_sizes").select(
        places.city_simple(F.col("Gemeindename")).alias("city_simple"),
        "GKZ",
        *[
            features.factor(columns.quoted(c), F.col("Insgesamt")).alias(c)
            for c in SIZE_COLUMNS
        ],
    )


_PICKED = "CASE periode " + " ".join(f"WHEN '{p}' THEN `{p}`" for p in PICK_PERIODS) + " END"


@query(
    "E10_pick_period_value",
    f"""WITH crossed AS (
           SELECT l.listing_id, {q.period('l.yearConstructed')} AS periode, z.*
           FROM fx_places_listed l
           JOIN fx_zensus z ON substr(z.GKZ, 1, 5) = regexp_extract(l.geo_krs, '([0-9]{{5}})', 1))
        SELECT listing_id, GKZ, {_PICKED} AS zensus_miete_decade,
               {_PICKED} / nullif(Insgesamt, 0) AS zensus_factor_decade
        FROM crossed""",
)
def e10(t):
    listings = t.fx("places_listed").select(
        "listing_id",
        features.year_to_period(F.col("yearConstructed")).alias("periode_0005"),
        parsing.first_digits(F.col("geo_krs"), 5).alias("area"),
    )
    census = t.fx("zensus").withColumn("area", parsing.key_prefix(F.col("GKZ"), 5))
    picked = resolve.pick_period_value(resolve.lookup_join(listings, census, ["area"], "inner"))
    return picked.select("listing_id", "GKZ", "zensus_miete_decade", "zensus_factor_decade")


HEURISTIC = """CAST(printf('%.2f',
    CASE {city} WHEN 'Berlin' THEN 13.0e0 WHEN 'München' THEN 18.0e0 WHEN 'Hamburg' THEN 14.0e0
         WHEN 'Köln' THEN 13.5e0 WHEN 'Frankfurt' THEN 15.0e0 ELSE 11.0e0 END
    * power(coalesce(nullif({size}, 0), 60.0e0), 0.15e0)
    * CASE WHEN lower({condition}) IN ('neu', 'saniert', 'renoviert') THEN 1.08e0 ELSE 1.0e0 END
    * (1.0e0 + 0.01e0 * coalesce({floor}, 0))
    * coalesce(nullif({size}, 0), 60.0e0)) AS DOUBLE)"""


@query(
    "E11_heuristic_rent",
    "SELECT listing_id, "
    + HEURISTIC.format(
        city="CASE listing_id % 7 WHEN 0 THEN 'Berlin' WHEN 1 THEN 'Köln' END",
        size="livingSpace", condition='"condition"', floor="floor",
    )
    + " AS rent FROM fx_listings",
)
def e11(t):
    at = F.col("listing_id") % 7
    city = F.when(at == 0, "Berlin").when(at == 1, "Köln")
    rent = features.heuristic_rent(city, F.col("livingSpace"), F.col("condition"), F.col("floor"))
    return t.fx("listings").select("listing_id", rent.alias("rent"))


@query(
    "P2_area_bucket",
    "SELECT listing_id, CASE WHEN livingSpace < 0 OR livingSpace IS NULL THEN NULL "
    "WHEN livingSpace < 30 THEN 'Unter 30 m²' WHEN livingSpace >= 180 THEN '180 m² und mehr' "
    "ELSE CAST(CAST(floor(livingSpace / 10) * 10 AS INTEGER) AS VARCHAR) || ' - ' || "
    "CAST(CAST(floor(livingSpace / 10) * 10 + 9 AS INTEGER) AS VARCHAR) || ' m²' END AS bucket "
    "FROM fx_listings",
)
def p2(t):
    return t.fx("listings").select(
        "listing_id", features.area_bucket(F.col("livingSpace")).alias("bucket")
    )


@query(
    "P3_year_bucket",
    f"SELECT listing_id, CASE WHEN {q.period('yearConstructed')} IN ('1960_1969', '1990_1999') "
    f"THEN NULL ELSE {q.period('yearConstructed')} END AS bucket FROM fx_places_listed",
)
def p3(t):
    return t.fx("places_listed").select(
        "listing_id", features.year_bucket(F.col("yearConstructed")).alias("bucket")
    )


@query(
    "D6_expand_flags",
    f"SELECT listing_id, {q.bool01('balcony')} AS balcony, {q.bool01('garden')} AS garden "
    "FROM fx_places_listed",
)
def d6_all(t):
    df = t.fx("places_listed").select("listing_id", "balcony", "garden")
    return aggregates.expand_flags(df, ["balcony", "garden", "cellar"])
