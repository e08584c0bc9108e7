"""Key resolution: unique maps, cascades, candidate matching, census joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.catalog import oracle as q
from rentlens.catalog.registry import query
from rentlens.functions import features, places
from rentlens.functions.features import PERIOD_COLUMNS, PICK_PERIODS
from rentlens.operators import aggregates, filters, resolve
from rentlens.operators.similarity import close_match
from rentlens.plans import listings as jobs

PICKED = "CASE periode_0005 " + " ".join(f"WHEN '{p}' THEN `{p}`" for p in PICK_PERIODS) + " END"

# --- unique maps --------------------------------------------------------------------

MAP9 = f"""m AS (SELECT {q.plz5('PLZ')} AS PLZ, trim(ARS) AS ARS, AGS, row_no,
                        {q.n9('Gemeindename')} AS g, {q.n9('Ort')} AS o FROM fx_keymap)"""


@query(
    "G6_unique_key_map_pair",
    f"WITH {MAP9} {q.unique_map('m', ['PLZ', 'g'], 'ARS')}",
)
def g6_pair(t):
    table = resolve.prepared_map(t.fx("keymap"), "nine_words")
    pairs = resolve.unique_key_map(table, ["PLZ", "gemeinde_norm"], "ARS")
    return pairs.withColumnRenamed("gemeinde_norm", "g")


@query(
    "G6_unique_key_map",
    f"""WITH {MAP9}
        SELECT 'plz' AS kind, PLZ AS k1, '' AS k2, ARS FROM ({q.unique_map('m', ['PLZ'], 'ARS')})
        UNION ALL SELECT 'name', g, '', ARS FROM ({q.unique_map('m', ['g'], 'ARS')})
        UNION ALL SELECT 'place', o, '', ARS FROM ({q.unique_map('m', ['o'], 'ARS')})
        UNION ALL SELECT 'plz_name', PLZ, g, ARS FROM ({q.unique_map('m', ['PLZ', 'g'], 'ARS')})
        UNION ALL SELECT 'plz_place', PLZ, o, ARS FROM ({q.unique_map('m', ['PLZ', 'o'], 'ARS')})""",
)
def g6(t):
    table = resolve.prepared_map(t.fx("keymap"), "nine_words")
    kinds = {
        "plz": ["PLZ"],
        "name": ["gemeinde_norm"],
        "place": ["ort_norm"],
        "plz_name": ["PLZ", "gemeinde_norm"],
        "plz_place": ["PLZ", "ort_norm"],
    }
    out = None
    for (kind, on), part in zip(
        kinds.items(), resolve.unique_key_maps(table, list(kinds.values()), "ARS")
    ):
        part = part.select(
            F.lit(kind).alias("kind"),
            F.col(on[0]).alias("k1"),
            (F.col(on[1]) if len(on) > 1 else F.lit("")).alias("k2"),
            "ARS",
        )
        out = part if out is None else out.unionByName(part)
    return out


# --- cascades -----------------------------------------------------------------------

MAP7 = f"""m7 AS (SELECT {q.plz5('PLZ')} AS PLZ, {q.digits('AGS')} AS AGS,
                         {q.n7('Gemeindename')} AS g, {q.n7('Ort')} AS o,
                         {q.n8('Gemeindename')} AS g8 FROM fx_keymap)"""

GKZ_CASCADE = f"""
    {MAP7},
    u1 AS ({q.unique_map('m7', ['PLZ'], 'AGS')}), u2 AS ({q.unique_map('m7', ['g'], 'AGS')}),
    u3 AS ({q.unique_map('m7', ['o'], 'AGS')}), u4 AS ({q.unique_map('m7', ['PLZ', 'g'], 'AGS')}),
    u5 AS ({q.unique_map('m7', ['PLZ', 'o'], 'AGS')}), u6 AS ({q.unique_map('m7', ['g8'], 'AGS')}),
    l AS (SELECT listing_id, {q.plz5('geo_plz')} AS plz5, {q.n7('regio3')} AS c,
                 {q.n8('regio3')} AS r FROM fx_places_listed)
    SELECT listing_id, coalesce(u1.AGS, u2.AGS, u3.AGS, u4.AGS, u5.AGS, u6.AGS) AS GKZ
    FROM l LEFT JOIN u1 ON l.plz5 = u1.PLZ LEFT JOIN u2 ON l.c = u2.g LEFT JOIN u3 ON l.c = u3.o
    LEFT JOIN u4 ON l.plz5 = u4.PLZ AND l.c = u4.g
    LEFT JOIN u5 ON l.plz5 = u5.PLZ AND l.c = u5.o LEFT JOIN u6 ON l.r = u6.g8
"""


@query("G7a_resolve_gkz_cascade", "WITH " + GKZ_CASCADE)
def g7a(t):
    resolved = resolve.resolve_gkz_cascade(t.fx("places_listed"), t.fx("keymap"))
    return resolved.select("listing_id", "GKZ")


ARS_CASCADE = f"""
    {MAP9},
    v1 AS ({q.unique_map('m', ['PLZ', 'g'], 'ARS')}), v2 AS ({q.unique_map('m', ['PLZ'], 'ARS')}),
    v3 AS ({q.unique_map('m', ['g'], 'ARS')}), v4 AS ({q.unique_map('m', ['o'], 'ARS')}),
    lk AS (SELECT *, {q.plz5('geo_plz')} AS plz5, {q.n9('regio3')} AS c FROM {{listed}}),
    ars AS (SELECT lk.*, coalesce(v1.ARS, v2.ARS, v3.ARS, v4.ARS) AS ARS
            FROM lk LEFT JOIN v1 ON lk.plz5 = v1.PLZ AND lk.c = v1.g
            LEFT JOIN v2 ON lk.plz5 = v2.PLZ LEFT JOIN v3 ON lk.c = v3.g
            LEFT JOIN v4 ON lk.c = v4.o)
"""
ARS_LIGHT = ARS_CASCADE.replace("{listed}", "fx_places_listed")


@query("G7b_resolve_ars_cascade", f"WITH {ARS_LIGHT} SELECT listing_id, ARS FROM ars")
def g7b(t):
    resolved = resolve.resolve_ars_cascade(t.fx("places_listed"), t.fx("keymap"))
    return resolved.select("listing_id", "ARS")


@query(
    "H5_match_rate_cascade",
    f"WITH {ARS_LIGHT} SELECT COUNT(ARS) AS matched, COUNT(*) AS total, "
    "round(COUNT(ARS) / COUNT(*), 9) AS rate FROM ars",
)
def h5(t):
    resolved = resolve.resolve_ars_cascade(t.fx("places_listed"), t.fx("keymap"))
    return aggregates.match_rate(resolved, "ARS").withColumn("rate", F.round("rate", 9))


@query(
    "C7_unmatched_rows",
    f"""WITH {ARS_LIGHT} SELECT DISTINCT regio1, regio2, regio3 FROM ars WHERE ARS IS NULL
        ORDER BY regio1, regio2, regio3 NULLS LAST LIMIT 200""",
)
def c7(t):
    resolved = resolve.resolve_ars_cascade(t.fx("places_listed"), t.fx("keymap"))
    return filters.unmatched_rows(resolved, "ARS", ["regio1", "regio2", "regio3"])


BY_NAME = f"""
    zn AS (SELECT {q.n10('Gemeindename')} AS n, {q.pad(q.digits('GKZ'), 12)} AS GKZ FROM fx_zensus),
    zu AS ({q.unique_map('zn', ['n'], 'GKZ')})
"""


@query(
    "G7c_resolve_by_census_name",
    f"""WITH {ARS_LIGHT}, {BY_NAME}
        SELECT listing_id, coalesce(ars.ARS, a.GKZ, b.GKZ) AS ARS FROM ars
        LEFT JOIN zu a ON {q.n10('regio3')} = a.n LEFT JOIN zu b ON {q.n10('regio2')} = b.n""",
)
def g7c(t):
    resolved = jobs.resolve_listings(t.fx("places_listed"), t.fx("keymap"), t.fx("zensus"))
    return resolved.select("listing_id", "ARS")


# --- names and states against the census --------------------------------------------

NAME_STATE = """
    SELECT nm, st, MIN(GKZ) AS GKZ FROM (SELECT {norm} AS nm, substr(GKZ, 1, 2) AS st, GKZ
    FROM fx_zensus) GROUP BY nm, st HAVING COUNT(*) = 1
"""


@query(
    "G2_join_name_state",
    f"""WITH u AS ({NAME_STATE.format(norm=q.n3('Gemeindename'))})
        SELECT listing_id, GKZ FROM fx_places_listed
        LEFT JOIN u ON {q.n3('regio3')} = nm AND {q.state_code('regio1')} = st""",
)
def g2(t):
    joined = resolve.join_name_state(t.fx("places_listed"), t.fx("zensus"))
    return joined.select("listing_id", "GKZ")


TWO = f"""
    u AS ({NAME_STATE.format(norm=q.n4('Gemeindename'))}),
    two AS (SELECT l.*, {q.state_code('regio1')} AS st1, coalesce(a.GKZ, b.GKZ) AS GKZ
            FROM fx_places_listed l
            LEFT JOIN u a ON {q.n4('regio3')} = a.nm AND {q.state_code('regio1')} = a.st
            LEFT JOIN u b ON {q.n4('regio2')} = b.nm AND {q.state_code('regio1')} = b.st)
"""


@query("G4_join_two_candidates", f"WITH {TWO} SELECT listing_id, GKZ FROM two")
def g4(t):
    joined = resolve.join_two_candidates(t.fx("places_listed"), t.fx("zensus"))
    return joined.select("listing_id", "GKZ")


HIERARCHY = f"""
    {TWO},
    town AS (SELECT GKZ, MIN(Insgesamt) AS v FROM fx_zensus GROUP BY GKZ),
    district AS (SELECT substr(GKZ, 1, 5) AS k, AVG(Insgesamt) AS v FROM fx_zensus GROUP BY 1),
    land AS (SELECT substr(GKZ, 1, 2) AS k, AVG(Insgesamt) AS v FROM fx_zensus GROUP BY 1),
    h AS (SELECT listing_id, two.GKZ, coalesce(town.v, district.v, land.v) AS zensus_miete,
                 CASE WHEN two.GKZ IS NOT NULL THEN 'gemeinde' WHEN district.v IS NOT NULL THEN 'kreis'
                      WHEN land.v IS NOT NULL THEN 'land' END AS gkz_precision
          FROM two LEFT JOIN town ON two.GKZ = town.GKZ
          LEFT JOIN district ON two.GKZ IS NULL
               AND nullif(regexp_extract(geo_krs, '([0-9]{{5}})', 1), '') = district.k
          LEFT JOIN land ON two.st1 = land.k)
"""


def _hierarchy(t):
    return resolve.join_hierarchy(t.fx("places_listed"), t.fx("zensus"), "Insgesamt")


@query(
    "G5_join_hierarchy",
    f"WITH {HIERARCHY} SELECT listing_id, GKZ, round(zensus_miete, 9) AS zensus_miete, "
    "gkz_precision FROM h",
)
def g5(t):
    return _hierarchy(t).select(
        "listing_id", "GKZ", F.round("zensus_miete", 9).alias("zensus_miete"), "gkz_precision"
    )


@query(
    "H5_match_rate_by_precision",
    f"""WITH {HIERARCHY} SELECT gkz_precision, COUNT(*) AS n,
        round(COUNT(*) / (SELECT COUNT(*) FROM h), 9) AS rate FROM h GROUP BY 1""",
)
def h5_precision(t):
    table = aggregates.match_rate_by(_hierarchy(t), "gkz_precision")
    return table.withColumn("rate", F.round("rate", 9))


# --- candidates of the PLZ ----------------------------------------------------------


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ' '), lambda w: w <> ''))"


MATCH = f"""
    c0 AS (SELECT {q.plz5('PLZ')} AS plz5, {q.digits('AGS')} AS AGS, row_no,
                  {q.n8('Gemeindename')} AS g, {q.n8('Ort')} AS o FROM fx_keymap),
    c AS (SELECT plz5, AGS, MIN(row_no) AS row_no, {_words('g')} AS gt, {_words('o')} AS ot
          FROM c0 GROUP BY plz5, AGS, g, o),
    l0 AS (SELECT listing_id, {q.plz5('geo_plz')} AS plz5, {q.n8('regio3')} AS nm,
                  nullif(regexp_extract(geo_krs, '([0-9]{{5}})', 1), '') AS k5,
                  {q.state_code('regio1')} AS b2 FROM fx_places_listed),
    ls AS (SELECT DISTINCT plz5, nm, k5, b2 FROM l0),
    scored AS (SELECT ls.plz5, nm, k5, b2, c.AGS, c.row_no,
                      len(list_intersect(gt, {_words('nm')})) + len(list_intersect(ot, {_words('nm')}))
                      + 0.5 * len(list_intersect(list_concat(gt, ot), {_words('nm')})) AS score,
                      CASE WHEN substr(c.AGS, 1, 5) = k5 THEN 0 WHEN substr(c.AGS, 1, 2) = b2 THEN 1
                           ELSE 2 END AS pool
               FROM ls JOIN c ON ls.plz5 = c.plz5),
    pooled AS (SELECT *, MIN(pool) OVER (PARTITION BY plz5, nm, k5, b2) AS best_pool FROM scored)
"""


@query(
    "G8_match_token_overlap",
    f"""WITH {MATCH},
        best AS (SELECT plz5, nm, k5, b2, arg_min(AGS, row_no) AS AGS FROM
                 (SELECT *, MAX(score) OVER (PARTITION BY plz5, nm, k5, b2) AS top FROM scored)
                 WHERE score = top AND score > 0 GROUP BY 1, 2, 3, 4)
        SELECT listing_id, AGS AS GKZ FROM l0 LEFT JOIN best b ON l0.plz5 = b.plz5
             AND l0.nm = b.nm AND l0.k5 IS NOT DISTINCT FROM b.k5 AND l0.b2 IS NOT DISTINCT FROM b.b2""",
)
def g8(t):
    matched = resolve.match_token_overlap(t.fx("places_listed"), t.fx("keymap"))
    return matched.select("listing_id", "GKZ")


@query(
    "G9_match_overlap_filtered",
    f"""WITH {MATCH},
        best AS (SELECT plz5, nm, k5, b2, arg_min(AGS, row_no) AS AGS FROM
                 (SELECT *, MAX(score) OVER (PARTITION BY plz5, nm, k5, b2) AS top FROM pooled
                  WHERE pool = best_pool)
                 WHERE score = top AND score > 0 GROUP BY 1, 2, 3, 4)
        SELECT listing_id, AGS AS GKZ FROM l0 LEFT JOIN best b ON l0.plz5 = b.plz5
             AND l0.nm = b.nm AND l0.k5 IS NOT DISTINCT FROM b.k5 AND l0.b2 IS NOT DISTINCT FROM b.b2""",
)
def g9(t):
    matched = resolve.match_overlap_filtered(t.fx("places_listed"), t.fx("keymap"))
    return matched.select("listing_id", "GKZ")


@query(
    "I2_argmax_first_wins",
    f"""WITH {MATCH}
        SELECT plz5, nm AS city_norm, arg_min(AGS, row_no) AS AGS FROM
        (SELECT *, MAX(score) OVER (PARTITION BY plz5, nm) AS top FROM scored)
        WHERE score = top AND score > 0 GROUP BY 1, 2""",
)
def i2(t):
    matched = resolve.match_token_overlap(t.fx("places_listed"), t.fx("keymap"))
    named = resolve.with_queries(matched.where("GKZ is not null"), hints=False)
    return named.select("plz5", "city_norm", F.col("GKZ").alias("AGS")).distinct()


def _sorted_words(x: str) -> str:
    words = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    return f"array_to_string(list_sort({words}), ' ')"


@query(
    "G10_match_fuzzy",
    f"""WITH RECURSIVE {MATCH},
        fc AS (SELECT plz5, AGS, MIN(row_no) AS row_no, {_sorted_words("concat_ws('|', g, o)")} AS b
               FROM c0 GROUP BY plz5, AGS, g, o),
        fq AS (SELECT *, {_sorted_words("concat_ws(' ', nm, nm)")} AS a FROM ls),
        fp AS (SELECT fq.*, fc.AGS, fc.row_no, fc.b,
                      CASE WHEN substr(fc.AGS, 1, 5) = k5 THEN 0 WHEN substr(fc.AGS, 1, 2) = b2 THEN 1
                           ELSE 2 END AS pool
               FROM fq JOIN fc ON fq.plz5 = fc.plz5),
        fb AS (SELECT *, MIN(pool) OVER (PARTITION BY plz5, nm, k5, b2) AS best_pool FROM fp),
        {q.common_subsequences("(SELECT a, b FROM fp WHERE a <> '' AND b <> '')")},
        fs AS (SELECT fb.*, 100.0e0 * (1 - (length(a) + length(b) - 2 * n) / (length(a) + length(b))::DOUBLE) AS score
               FROM fb JOIN lcs USING (a, b) WHERE pool = best_pool),
        best AS (SELECT plz5, nm, k5, b2, arg_min(AGS, row_no) AS AGS FROM
                 (SELECT *, MAX(score) OVER (PARTITION BY plz5, nm, k5, b2) AS top FROM fs)
                 WHERE score = top AND score >= 90 GROUP BY 1, 2, 3, 4)
        SELECT l.listing_id, l.geo_plz, l.regio3, AGS AS GKZ
        FROM fx_places_listed l JOIN l0 USING (listing_id) LEFT JOIN best b ON l0.plz5 = b.plz5
             AND l0.nm = b.nm AND l0.k5 IS NOT DISTINCT FROM b.k5 AND l0.b2 IS NOT DISTINCT FROM b.b2""",
)
def g10(t):
    matched = resolve.match_fuzzy(t.fx("places_listed"), t.fx("keymap"))
    return matched.select("listing_id", "geo_plz", "regio3", "GKZ")


def _close(wanted: str, choices: str) -> str:
    """``closest (b, a, ratio)``: the best choice of each wanted name from 0.87 on."""
    return f"""{q.match_ratios(f"(SELECT a, b FROM ({choices}) x(a), ({wanted}) y(b) WHERE a <> '' AND b <> '')")},
        closest AS (SELECT b, arg_max(a, (ratio, a)) AS a, MAX(ratio) AS ratio FROM ratios
                    WHERE ratio >= 0.87 GROUP BY b)"""


@query(
    "G11_close_match",
    f"""WITH RECURSIVE {_close(f"SELECT DISTINCT {q.n1('city_or_plz')} FROM fx_requests",
                               f"SELECT DISTINCT {q.n1('Gemeindename')} FROM fx_zensus")}
        SELECT b AS name, ratio AS score, a AS choice FROM closest""",
)
def g11(t):
    wanted = t.fx("requests").select(places.dashboard(F.col("city_or_plz")).alias("name"))
    choices = t.fx("zensus").select(places.dashboard(F.col("Gemeindename")).alias("choice"))
    return close_match(wanted, choices, "name", "choice")


# --- census values ------------------------------------------------------------------


READY = f"""
    {ARS_CASCADE.replace('{listed}', 'fx_listings')}, {BY_NAME},
    keyed AS (SELECT ars.* REPLACE (coalesce(ars.ARS, a.GKZ, b.GKZ) AS ARS) FROM ars
              LEFT JOIN zu a ON {q.n10('regio3')} = a.n LEFT JOIN zu b ON {q.n10('regio2')} = b.n),
    t0 AS (SELECT listing_id, {q.pad(q.digits('ARS'), 12)} AS ARS, baseRent AS rent_cold,
                  livingSpace AS area_sqm, noRooms AS rooms, floor, pricetrend,
                  {q.num('serviceCharge')} AS serviceCharge, {q.flag01('garden')} AS garden,
                  {q.flag01('lift')} AS lift, {q.flag01('hasKitchen')} AS hasKitchen, typeOfFlat,
                  heatingType AS heatingType_clean,
                  {q.period('yearConstructed')} AS periode_0005
           FROM keyed WHERE ARS IS NOT NULL),
    top AS (SELECT floor FROM t0 WHERE floor IS NOT NULL GROUP BY floor
            ORDER BY COUNT(*) DESC, floor LIMIT 1),
    ready AS (SELECT listing_id, ARS, rent_cold, area_sqm, rooms,
                     coalesce(floor, (SELECT floor FROM top)) AS floor,
                     coalesce(pricetrend, (SELECT AVG(pricetrend) FROM t0)) AS pricetrend,
                     coalesce(serviceCharge, 0) AS serviceCharge, garden, lift, hasKitchen,
                     coalesce(typeOfFlat, 'unknown') AS typeOfFlat,
                     coalesce(heatingType_clean, 'unknown') AS heatingType_clean,
                     coalesce(periode_0005, 'unknown') AS periode_0005
              FROM t0 WHERE {q.plausible('area_sqm', 'rent_cold')})
"""


def ready_table(t):
    """Keyed listings as they reach the training projection (period and heating named)."""
    listings = t.fx("listings").withColumns(
        {
            "heatingType_clean": F.col("heatingType"),
            "periode_0005": features.year_to_period(F.col("yearConstructed")),
        }
    )
    return jobs.train_from_listings(listings, t.fx("keymap"), t.fx("zensus"))


@query(
    "job_train_ready",
    f"WITH {READY} SELECT * EXCLUDE (listing_id) REPLACE (round(pricetrend, 6) AS pricetrend) "
    "FROM ready",
)
def train_ready(t):
    return ready_table(t).withColumn("pricetrend", F.round("pricetrend", 6))


@query(
    "G1_join_census",
    f"""WITH {READY}
        SELECT ready.* EXCLUDE (listing_id) REPLACE (round(pricetrend, 6) AS pricetrend),
               Insgesamt AS zensus_miete_total, {PICKED} AS zensus_miete_decade,
               {PICKED} / nullif(Insgesamt, 0) AS zensus_factor_decade
        FROM ready LEFT JOIN fx_zensus z ON ready.ARS = z.GKZ""",
)
def g1(t):
    joined = jobs.train_joined(ready_table(t), t.fx("zensus"))
    return joined.withColumn("pricetrend", F.round("pricetrend", 6))


PICKED_REQUEST = PICKED.replace("periode_0005", "periode")


@query(
    "G12_location_defaults",
    f"""WITH m AS (SELECT {q.plz5('PLZ')} AS PLZ, {q.digits('ARS')} AS ARS,
                          {q.n2('Gemeindename')} AS g FROM fx_keymap),
        u1 AS ({q.unique_map('m', ['PLZ'], 'ARS')}), u2 AS ({q.unique_map('m', ['g'], 'ARS')}),
        r AS (SELECT x.*, CASE WHEN periode IN ({', '.join(f"'{p}'" for p in PICK_PERIODS)})
                     THEN coalesce(u1.ARS, u2.ARS) END AS ARS
              FROM fx_requests x LEFT JOIN u1 ON {q.plz5('city_or_plz')} = u1.PLZ
              LEFT JOIN u2 ON {q.n2('city_or_plz')} = u2.g)
        SELECT request_id, city_or_plz, periode, Insgesamt AS total, {PICKED_REQUEST} AS decade,
               {PICKED_REQUEST} / nullif(Insgesamt, 0) AS factor
        FROM r LEFT JOIN fx_zensus z ON r.ARS = z.GKZ""",
)
def g12(t):
    return resolve.location_defaults(t.fx("requests"), t.fx("keymap"), t.fx("zensus"))


PICKED_ALL = "CASE periode " + " ".join(f"WHEN '{p}' THEN `{p}`" for p in PERIOD_COLUMNS) + " END"


def _city_defaults(close: str, name: str) -> str:
    return f"""WITH RECURSIVE z AS (SELECT *, {q.n1('Gemeindename')} AS n, row_number() OVER
                   (PARTITION BY {q.n1('Gemeindename')} ORDER BY GKZ) AS rn FROM fx_zensus),
        a AS (SELECT {q.n1('Gemeindename')} AS n, ARS, row_no FROM fx_keymap
              UNION ALL SELECT {q.n1('Ort')}, ARS, row_no FROM fx_keymap),
        f AS (SELECT n, arg_min(ARS, row_no) AS ARS FROM a WHERE n <> '' GROUP BY n),
        r0 AS (SELECT request_id, city_or_plz AS city, periode,
                     nullif({q.n1('city_or_plz')}, '') AS n FROM fx_requests),
        {close}
        r AS ({name})
        SELECT request_id, city, periode, coalesce(GKZ, f.ARS) AS ARS, Insgesamt AS zensus_total,
               {PICKED_ALL} AS zensus_decade,
               {PICKED_ALL} / nullif(Insgesamt, 0) AS zensus_factor
        FROM r LEFT JOIN z ON r.spelled = z.n AND z.rn = 1 LEFT JOIN f ON r.n = f.n"""


@query("G13_city_defaults_exact", _city_defaults("", "SELECT *, n AS spelled FROM r0"))
def g13(t):
    requests = t.fx("requests").withColumnRenamed("city_or_plz", "city")
    return resolve.city_defaults(requests, t.fx("zensus"), t.fx("keymap"), fuzzy=False)


UNKNOWN = "SELECT DISTINCT n FROM r0 WHERE n NOT IN (SELECT n FROM z WHERE n IS NOT NULL)"


@query(
    "G13_city_defaults_fuzzy",
    _city_defaults(
        _close(UNKNOWN, "SELECT DISTINCT n FROM z") + ",",
        "SELECT r0.*, coalesce(c.a, r0.n) AS spelled FROM r0 LEFT JOIN closest c ON r0.n = c.b",
    ),
)
def g13_fuzzy(t):
    requests = t.fx("requests").withColumnRenamed("city_or_plz", "city")
    return resolve.city_defaults(requests, t.fx("zensus"), t.fx("keymap"))


# --- duplicates ---------------------------------------------------------------------


@query(
    "G15_duplicate_keys",
    "SELECT row_no, PLZ, AGS FROM fx_keymap QUALIFY COUNT(*) OVER (PARTITION BY PLZ, AGS) > 1",
)
def g15(t):
    return resolve.duplicate_keys(t.fx("keymap").select("row_no", "PLZ", "AGS"), ["PLZ", "AGS"])


@query(
    "G15_without_duplicates",
    "SELECT row_no, PLZ, AGS FROM fx_keymap QUALIFY COUNT(*) OVER (PARTITION BY PLZ, AGS) = 1",
)
def g15_rest(t):
    table = t.fx("keymap").select("row_no", "PLZ", "AGS")
    return resolve.duplicate_keys(table, ["PLZ", "AGS"], keep=False)


@query(
    "I3_duplicate_flag",
    "SELECT listing_id, regio3, floor, COUNT(*) OVER (PARTITION BY regio3, floor) > 1 "
    "AS is_duplicate FROM fx_places_listed",
)
def i3(t):
    df = t.fx("places_listed").select("listing_id", "regio3", "floor")
    return resolve.duplicate_flag(df, ["regio3", "floor"])
