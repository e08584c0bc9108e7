"""Resolving listings to official municipality keys and census values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.functions import features, parsing, places
from rentlens.functions import text as tx
from rentlens.operators.columns import load_zensus, pick_alias, quoted
from rentlens.operators.frames import cut, keep
from rentlens.operators.joins import (
    BROADCAST_LIMIT,
    by_distinct,
    first_row,
    lookup_join,
    lookup_joins,
)
from rentlens.operators.similarity import (
    close_match,
    indel_score_udf,
    near_pairs,
    sorted_tokens,
)

CITY_SOURCES = ["regio3", "regio2", "regio1", "city", "City", "ort"]
PLZ_SOURCES = ["geo_plz", "zip_code"]


# --- keys on the listing side -------------------------------------------------------


def kreis5(df: DataFrame, first: str = "geo_krs", second: str = "regio2") -> Column:
    """Five-digit district code out of the first column, the second where that is null."""
    present = [F.col(c) for c in (first, second) if c in df.columns]
    return parsing.first_digits(F.coalesce(*present, F.lit(None).cast("string")), 5)


def city_source(df: DataFrame) -> Column:
    name = pick_alias(df.columns, CITY_SOURCES)
    return F.coalesce(F.col(name), F.lit("")) if name else F.lit("")


def plz_source(df: DataFrame) -> Column:
    name = pick_alias(df.columns, PLZ_SOURCES)
    return parsing.plz5(F.col(name)) if name else F.lit(None).cast("string")


def place_columns(df: DataFrame, extra: list[str] | None = None) -> list[str]:
    """The raw columns that place keys are made of."""
    sources = [pick_alias(df.columns, names) for names in (PLZ_SOURCES, CITY_SOURCES)]
    return list(dict.fromkeys([c for c in sources if c] + (extra or [])))


def with_place_keys(df: DataFrame, variant: str) -> DataFrame:
    return df.withColumns(
        {"plz5": plz_source(df), "city_norm": places.normalize_place(city_source(df), variant)}
    )


# --- unique maps and cascades -------------------------------------------------------


def unique_key_map(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys that lead to exactly one distinct value; null and empty keys are left out."""
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k) != "") for k in keys])
    spread = df.where(usable).groupBy(*keys).agg(
        F.min(value).alias(value), F.max(value).alias("__max")
    )
    return spread.where(F.col(value) == F.col("__max")).drop("__max")


def unique_key_maps(
    df: DataFrame, key_sets: list[list[str]], value: str
) -> list[DataFrame]:
    """``unique_key_map`` for several key sets from one pass over the table."""
    keys = list(dict.fromkeys(k for on in key_sets for k in on))
    sets = [[F.col(k) for k in on] for on in key_sets]
    spread = df.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("__set"), F.min(value).alias(value), F.max(value).alias("__max")
    )
    spread = cut(spread.where(F.col(value) == F.col("__max")))
    maps = []
    for on in key_sets:
        # One bit per key, the first key highest, set where the key is grouped away.
        number = int("".join("0" if k in on else "1" for k in keys), 2)
        usable = [F.col(k) != "" for k in on]
        wanted = reduce(lambda a, b: a & b, usable, F.col("__set") == number)
        maps.append(spread.where(wanted).select(*on, value))
    return maps


def cascade(
    df: DataFrame,
    steps: list[tuple[DataFrame, dict[str, str]]],
    value: str,
    out: str,
    limit: int = BROADCAST_LIMIT,
    measured: bool = True,
) -> DataFrame:
    """Fill ``out`` from several unique maps, the first hit wins.

    Each step is a map and its columns as {own column: map column}. An ``out`` column that
    is already there keeps its values and only its gaps are filled.
    """
    lookups = []
    for i, (table, on) in enumerate(steps):
        named = table.select(
            *[F.col(there).alias(here) for here, there in on.items()],
            F.col(value).alias(f"__hit_{i}"),
        )
        lookups.append((named, list(on)))
    hits = [f"__hit_{i}" for i in range(len(steps))]
    known = [out] if out in df.columns else []
    joined = lookup_joins(df, lookups, limit=limit, keep=measured)
    return joined.withColumn(out, F.coalesce(*known, *hits)).drop(*hits)


def _name_steps(
    table: DataFrame, value: str, order: list[str]
) -> list[tuple[DataFrame, dict[str, str]]]:
    """Unique maps by PLZ, municipality name, place name and the two pairs, in ``order``."""
    on = {
        "plz": {"plz5": "PLZ"},
        "name": {"city_norm": "gemeinde_norm"},
        "place": {"city_norm": "ort_norm"},
        "plz_name": {"plz5": "PLZ", "city_norm": "gemeinde_norm"},
        "plz_place": {"plz5": "PLZ", "city_norm": "ort_norm"},
    }
    maps = unique_key_maps(table, [list(on[s].values()) for s in order], value)
    return [(table, on[s]) for table, s in zip(maps, order)]


def prepared_map(key_map: DataFrame, variant: str) -> DataFrame:
    """Key map with clean PLZ and both names normalised, kept for the maps made from it."""
    table = key_map.withColumns(
        {
            "PLZ": parsing.plz5(F.col("PLZ")),
            "gemeinde_norm": places.normalize_place(F.col("Gemeindename"), variant),
            "ort_norm": places.normalize_place(F.col("Ort"), variant),
        }
    )
    return keep(table.where(F.col("PLZ").isNotNull()))


def resolve_gkz_cascade(
    listings: DataFrame, key_map: DataFrame, out: str = "GKZ", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """PLZ, name, place, (PLZ, name), (PLZ, place), then the fine place name alone."""
    ags = key_map.withColumn("AGS", parsing.digits_only(F.col("AGS"))).where("AGS is not null")
    table = prepared_map(ags, "cut_suffixes")
    steps = _name_steps(table, "AGS", ["plz", "name", "place", "plz_name", "plz_place"])
    fine = prepared_map(ags, "letters_only")
    by_name = unique_key_maps(fine, [["gemeinde_norm"]], "AGS")[0]
    steps.append((by_name, {"regio3_norm": "gemeinde_norm"}))

    def resolve(names: DataFrame) -> DataFrame:
        keyed = with_place_keys(names, "cut_suffixes").withColumn(
            "regio3_norm", places.letters_only(F.col("regio3"))
        )
        return cascade(keyed, steps, "AGS", out, limit, measured=False)

    return by_distinct(listings, place_columns(listings, ["regio3"]), resolve, limit)


def resolve_ars_cascade(
    listings: DataFrame, key_map: DataFrame, out: str = "ARS", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """(PLZ, name), PLZ, name, place."""
    table = prepared_map(key_map, "nine_words").withColumn("ARS", tx.strip(F.col("ARS")))
    steps = _name_steps(table, "ARS", ["plz_name", "plz", "name", "place"])

    def resolve(names: DataFrame) -> DataFrame:
        keyed = with_place_keys(names, "nine_words")
        return cascade(keyed, steps, "ARS", out, limit, measured=False)

    return by_distinct(listings, place_columns(listings), resolve, limit)


def resolve_by_census_name(
    listings: DataFrame, census: DataFrame, out: str = "ARS", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Unique census names against regio3, then regio2; only empty keys are filled."""
    names = census.select(
        places.unique_census(F.col("Gemeindename")).alias("name_norm"),
        parsing.pad_key(F.col("GKZ"), 12).alias("GKZ"),
    )
    unique = unique_key_map(names, ["name_norm"], "GKZ")
    steps = [(unique, {"__cand3": "name_norm"}), (unique, {"__cand2": "name_norm"})]

    def resolve(combinations: DataFrame) -> DataFrame:
        keyed = combinations.withColumns(
            {
                "__cand3": places.unique_census(F.col("regio3")),
                "__cand2": places.unique_census(F.col("regio2")),
            }
        )
        return cascade(keyed, steps, "GKZ", "__by_name", limit).drop("__cand3", "__cand2")

    joined = by_distinct(listings, ["regio3", "regio2"], resolve, limit)
    known = [out] if out in listings.columns else []
    return joined.withColumn(out, F.coalesce(*known, "__by_name")).drop("__by_name")


# --- name and state against the census ----------------------------------------------


def census_by_name_state(census: DataFrame, variant: str) -> DataFrame:
    """(name, state) that occur on exactly one census row."""
    keyed = census.select(
        places.normalize_place(F.col("Gemeindename"), variant).alias("name_clean"),
        parsing.key_prefix(F.col("GKZ"), 2).alias("state_code"),
        "GKZ",
    )
    counted = keyed.groupBy("name_clean", "state_code").agg(
        F.count(F.lit(1)).alias("__n"), F.min("GKZ").alias("GKZ")
    )
    return counted.where(F.col("__n") == 1).drop("__n")


def join_name_state(
    listings: DataFrame, census: DataFrame, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    unique = census_by_name_state(census, "census_name")

    def resolve(names: DataFrame) -> DataFrame:
        keyed = names.withColumns(
            {
                "name_clean": places.census_name(F.col("regio3")),
                "state_code": parsing.state_code(F.col("regio1")),
            }
        )
        return lookup_join(keyed, unique, ["name_clean", "state_code"], limit=limit)

    return by_distinct(listings, ["regio3", "regio1"], resolve, limit)


def join_two_candidates(
    listings: DataFrame, census: DataFrame, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Fine place name first, the coarser region name where that finds nothing."""
    unique = census_by_name_state(census, "census_name_wide")
    steps = [
        (unique, {"cand1": "name_clean", "state_code": "state_code"}),
        (unique, {"cand2": "name_clean", "state_code": "state_code"}),
    ]

    def resolve(names: DataFrame) -> DataFrame:
        keyed = names.withColumns(
            {
                "cand1": places.census_name_wide(F.col("regio3")),
                "cand2": places.census_name_wide(F.col("regio2")),
                "state_code": parsing.state_code(F.col("regio1")),
            }
        )
        return cascade(keyed, steps, "GKZ", "GKZ", limit)

    return by_distinct(listings, ["regio3", "regio2", "regio1"], resolve, limit)


def area_means(census: DataFrame, rent: str, digits: int, out: str) -> DataFrame:
    """Mean census rent per key prefix: 5 digits for districts, 2 for states."""
    return census.groupBy(parsing.key_prefix(F.col("GKZ"), digits).alias("area_key")).agg(
        F.avg(rent).alias(out)
    )


def join_hierarchy(listings: DataFrame, census: DataFrame, rent: str) -> DataFrame:
    """Municipality rent, else district mean, else state mean, and which one it was."""
    keyed = join_two_candidates(listings, census)
    keyed = keyed.withColumn(
        "krs5", F.when(F.col("GKZ").isNull(), parsing.first_digits(F.col("geo_krs"), 5))
    )
    towns = first_row(
        census.select("GKZ", F.col(rent).alias("__town")), ["GKZ"], ["__town"]
    )
    districts = area_means(census, rent, 5, "__district").withColumnRenamed("area_key", "krs5")
    states = area_means(census, rent, 2, "__state").withColumnRenamed("area_key", "state_code")
    joined = lookup_joins(
        keyed, [(towns, ["GKZ"]), (districts, ["krs5"]), (states, ["state_code"])]
    )
    label = (
        F.when(F.col("GKZ").isNotNull(), "gemeinde")
        .when(F.col("__district").isNotNull(), "kreis")
        .when(F.col("__state").isNotNull(), "land")
    )
    value = F.coalesce("__town", "__district", "__state")
    return joined.withColumns({"zensus_miete": value, "gkz_precision": label}).drop(
        "__town", "__district", "__state", "cand1", "cand2"
    )


# --- candidates sharing the PLZ -----------------------------------------------------

QUERY = ["plz5", "city_norm", "regio3_norm", "kreis5", "bl2"]


def query_columns(listings: DataFrame, hints: bool) -> list[str]:
    """The raw columns the candidate matchers look at."""
    extra = ["regio3", *(["geo_krs", "regio2", "regio1"] if hints else [])]
    return [c for c in place_columns(listings, extra) if c in listings.columns]


def with_queries(names: DataFrame, hints: bool) -> DataFrame:
    none = F.lit(None).cast("string")
    return names.withColumns(
        {
            "plz5": plz_source(names),
            "city_norm": places.letters_only(city_source(names)),
            "regio3_norm": places.letters_only(F.col("regio3")),
            "kreis5": kreis5(names) if hints else none,
            "bl2": parsing.state_code(F.col("regio1")) if hints else none,
        }
    )


def place_candidates(key_map: DataFrame, order: str = "row_no") -> DataFrame:
    """Distinct (PLZ, district, names); the first row in file order gives the key."""
    ags = key_map.withColumn("AGS", parsing.digits_only(F.col("AGS"))).where("AGS is not null")
    table = prepared_map(ags, "letters_only").select(
        F.col("PLZ").alias("plz5"),
        parsing.key_prefix(F.col("AGS"), 5).alias("c_kreis5"),
        parsing.key_prefix(F.col("AGS"), 2).alias("c_bl2"),
        "gemeinde_norm",
        "ort_norm",
        F.col(order).alias("row_no"),
        "AGS",
    )
    keys = ["plz5", "c_kreis5", "c_bl2", "gemeinde_norm", "ort_norm"]
    return cut(first_row(table, keys, ["row_no"]))


def with_pool(queries: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """Which candidates count: 0 the same district, 1 the same state, 2 all of the PLZ."""
    districts = candidates.select("plz5", F.col("c_kreis5").alias("kreis5")).distinct()
    states = candidates.select("plz5", F.col("c_bl2").alias("bl2")).distinct()
    joined = lookup_joins(
        queries,
        [
            (districts.withColumn("__d", F.lit(True)), ["plz5", "kreis5"]),
            (states.withColumn("__s", F.lit(True)), ["plz5", "bl2"]),
        ],
        limit=limit,
    )
    pool = F.when(F.col("__d"), 0).when(F.col("__s"), 1).otherwise(2)
    return joined.withColumn("pool", pool).drop("__d", "__s")


def _in_pool() -> Column:
    district = (F.col("pool") == 0) & (F.col("c_kreis5") == F.col("kreis5"))
    state = (F.col("pool") == 1) & (F.col("c_bl2") == F.col("bl2"))
    return district | state | (F.col("pool") == 2)


def _match_open(
    listings: DataFrame,
    out: str,
    hints: bool,
    match: Callable[[DataFrame], DataFrame],
    limit: int,
) -> DataFrame:
    """Fill the gaps of ``out`` with the best candidate per distinct query.

    ``match`` turns distinct queries with a PLZ into (query, AGS). Rows that already have
    a key take no part in the matching.
    """
    raw = query_columns(listings, hints)
    still_open = listings.where(F.col(out).isNull()) if out in listings.columns else listings
    keyed = cut(with_queries(still_open.select(*raw).distinct(), hints))
    best = match(keyed.where(F.col("plz5").isNotNull()).select(*QUERY).distinct())
    found = best.select(*QUERY, F.col("AGS").alias("__ags"))
    answers = cut(lookup_join(keyed, found, QUERY, null_safe=True, limit=limit))
    joined = lookup_join(
        listings, answers.select(*raw, "__ags"), raw, null_safe=True, limit=limit
    )
    known = [out] if out in listings.columns else []
    return joined.withColumn(out, F.coalesce(*known, "__ags")).drop("__ags")


def match_token_overlap(
    listings: DataFrame,
    key_map: DataFrame,
    out: str = "GKZ",
    hints: bool = False,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Best candidate of the PLZ by shared words, for listings without a key.

    A word of the place name counts once in the municipality name and once in the place
    name of the candidate; a word of the fine name adds one half. With ``hints`` the
    candidates are narrowed to the same district, else the same state, else all of the
    PLZ.
    """
    candidates = place_candidates(key_map)

    def match(queries: DataFrame) -> DataFrame:
        return best_overlap(with_pool(queries, candidates, limit), candidates, limit)

    return _match_open(listings, out, hints, match, limit)


def best_overlap(queries: DataFrame, candidates: DataFrame, limit: int) -> DataFrame:
    """Only candidates that share a word can score, so both sides meet on (PLZ, word)."""
    name, fine = tx.tokens(F.col("city_norm")), tx.tokens(F.col("regio3_norm"))
    asked = (
        queries.withColumns({"__name": name, "__fine": fine})
        .withColumn("token", F.explode(F.array_union("__name", "__fine")))
        .select(
            *QUERY,
            "pool",
            "token",
            F.array_contains("__name", F.col("token")).cast("int").alias("in_name"),
            F.array_contains("__fine", F.col("token")).cast("int").alias("in_fine"),
        )
    )
    gem, ort = tx.tokens(F.col("gemeinde_norm")), tx.tokens(F.col("ort_norm"))
    offered = (
        candidates.withColumns({"__gem": gem, "__ort": ort})
        .withColumn("token", F.explode(F.array_union("__gem", "__ort")))
        .withColumn(
            "found",
            F.array_contains("__gem", F.col("token")).cast("int")
            + F.array_contains("__ort", F.col("token")).cast("int"),
        )
        .drop("__gem", "__ort", "gemeinde_norm", "ort_norm")
    )
    pairs = lookup_join(asked, offered, ["plz5", "token"], "inner", limit=limit).where(_in_pool())
    points = F.col("in_name") * F.col("found") + F.lit(0.5) * F.col("in_fine")
    scores = pairs.groupBy(*QUERY, "row_no", "AGS").agg(F.sum(points).alias("score"))
    return _best(scores)


def _best(scores: DataFrame) -> DataFrame:
    """Highest score per query, the first map row on ties."""
    rank = F.struct((-F.col("score")).alias("rank"), "row_no", "AGS")
    return scores.groupBy(*QUERY).agg(F.min(rank).alias("best")).select(*QUERY, "best.AGS")


def match_overlap_filtered(
    listings: DataFrame, key_map: DataFrame, out: str = "GKZ", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    return match_token_overlap(listings, key_map, out, hints=True, limit=limit)


def match_fuzzy(
    listings: DataFrame,
    key_map: DataFrame,
    out: str = "GKZ",
    threshold: float = 90.0,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Best candidate by token-sorted similarity of at least ``threshold`` percent."""
    label = sorted_tokens(F.concat_ws("|", "gemeinde_norm", "ort_norm"))
    candidates = place_candidates(key_map).withColumn("label", label)

    def match(queries: DataFrame) -> DataFrame:
        words = F.concat_ws(
            " ", F.nullif(F.col("city_norm"), F.lit("")), F.nullif(F.col("regio3_norm"), F.lit(""))
        )
        asked = with_pool(queries, candidates, limit).withColumn("target", sorted_tokens(words))
        return best_similar(asked, candidates, threshold, limit)

    return _match_open(listings, out, True, match, limit)


def best_similar(
    queries: DataFrame, candidates: DataFrame, threshold: float, limit: int
) -> DataFrame:
    """Texts are compared once per distinct pair, then matched up within their PLZ."""
    pairs = near_pairs(queries, candidates, "target", "label", threshold / 100.0, limit=limit)
    scored = pairs.withColumn("score", indel_score_udf(F.col("target"), F.col("label"))).where(
        F.col("score") >= threshold
    )
    reachable = lookup_join(queries, scored, ["target"], "inner", limit=limit)
    offered = candidates.select("plz5", "label", "c_kreis5", "c_bl2", "row_no", "AGS")
    ranked = lookup_join(reachable, offered, ["plz5", "label"], "inner", limit=limit)
    return _best(ranked.where(_in_pool()))


# --- census values ------------------------------------------------------------------


def period_factors(census: DataFrame, total: str = "Insgesamt") -> DataFrame:
    """Period rent over total rent, one factor column per period of the pick list."""
    return census.withColumns(
        {f"factor_{p}": features.factor(quoted(p), F.col(total)) for p in features.PICK_PERIODS}
    )


def pick_period_value(
    df: DataFrame, period: str = "periode_0005", total: str = "Insgesamt"
) -> DataFrame:
    """Census rent and factor of the row's own period; null outside the pick list."""
    values = {p: quoted(p) for p in features.PICK_PERIODS}
    value = features.pick_by_label(F.col(period), values)
    return df.withColumns(
        {
            "zensus_miete_decade": value,
            "zensus_factor_decade": features.factor(value, F.col(total)),
        }
    )


def join_census(
    train: DataFrame, census: DataFrame, columns: list[str], limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Train table with the census total, period rent and period factor."""
    wanted = [quoted(p) for p in features.PICK_PERIODS]
    rents = census.select(
        tx.strip(F.col("GKZ")).alias("ARS"), F.col("Insgesamt"), *wanted
    )
    joined = pick_period_value(lookup_join(train, rents, ["ARS"], limit=limit))
    return joined.select(
        *columns,
        F.col("Insgesamt").alias("zensus_miete_total"),
        "zensus_miete_decade",
        "zensus_factor_decade",
    )


def location_defaults(requests: DataFrame, key_map: DataFrame, census: DataFrame) -> DataFrame:
    """Census defaults for rows of (city_or_plz, periode): unique PLZ, else unique name."""
    table = key_map.withColumns(
        {
            "PLZ": parsing.plz5(F.col("PLZ")),
            "gemeinde_norm": places.sandbox(F.col("Gemeindename")),
            "ARS": parsing.digits_only(F.col("ARS")),
        }
    )
    by_plz, by_name = unique_key_maps(table, [["PLZ"], ["gemeinde_norm"]], "ARS")
    steps = [(by_plz, {"__plz": "PLZ"}), (by_name, {"__name": "gemeinde_norm"})]
    asked = requests.withColumns(
        {
            "__plz": parsing.plz5(F.col("city_or_plz")),
            "__name": places.sandbox(F.col("city_or_plz")),
        }
    )
    known = F.col("periode").isin(features.PICK_PERIODS)
    found = cascade(asked, steps, "ARS", "ARS", measured=False)
    keyed = found.withColumn("ARS", F.when(known, F.col("ARS")))
    rents = first_row(
        census.select(
            F.col("GKZ").alias("ARS"),
            "Gemeindename",
            "Insgesamt",
            *[quoted(p) for p in features.PICK_PERIODS],
        ),
        ["ARS"],
        ["Gemeindename"],
    ).drop("Gemeindename")
    joined = pick_period_value(lookup_join(keyed, rents, ["ARS"]), "periode")
    return joined.select(
        *requests.columns,
        F.col("Insgesamt").alias("total"),
        F.col("zensus_miete_decade").alias("decade"),
        F.col("zensus_factor_decade").alias("factor"),
    )


def city_defaults(
    requests: DataFrame,
    census: DataFrame,
    key_map: DataFrame | None = None,
    fuzzy: bool = True,
    cutoff: float = 0.87,
    order: str = "GKZ",
) -> DataFrame:
    """Key and census rents for rows of (city, periode).

    Exact census name first, then (``fuzzy``) the closest one; where the census knows no
    key the map decides by municipality or place name. First rows win: the census in
    ``order``, the map by ``row_no``.
    """
    asked = requests.withColumn("__name", F.nullif(places.dashboard(F.col("city")), F.lit("")))
    loaded = load_zensus(census)
    rents = first_row(
        loaded.select(
            F.col("name_norm").alias("__name"),
            F.col(order).alias("__order"),
            tx.strip(F.col("GKZ")).alias("__gkz"),
            "Insgesamt",
            *[quoted(p) for p in features.PERIOD_COLUMNS],
        ).where(F.col("__name") != ""),
        ["__name"],
        ["__order"],
    ).drop("__order")
    if fuzzy:
        wanted = asked.where(F.col("__name").isNotNull()).select("__name").distinct()
        unknown = lookup_join(wanted, rents.select("__name"), ["__name"], "left_anti")
        choices = rents.select(F.col("__name").alias("__choice"))
        close = close_match(unknown, choices, "__name", "__choice", cutoff)
        spelled = lookup_join(asked, close.select("__name", "__choice"), ["__name"])
        asked = spelled.withColumn("__asked", F.col("__name")).withColumn(
            "__name", F.coalesce("__choice", "__name")
        )
    else:
        asked = asked.withColumn("__asked", F.col("__name"))
    joined = lookup_join(asked, rents, ["__name"])
    ars = [F.col("__gkz")]
    if key_map is not None:
        named = key_map.select(
            places.dashboard(F.col("Gemeindename")).alias("__by_name"),
            places.dashboard(F.col("Ort")).alias("__by_place"),
            "row_no",
            tx.strip(F.col("ARS")).alias("ARS"),
        )
        lookups = []
        for c in ("__by_name", "__by_place"):
            first = F.min(F.struct("row_no", "ARS")).alias(c)
            lookups.append(
                (named.where(F.col(c) != "").groupBy(F.col(c).alias("__asked")).agg(first), ["__asked"])
            )
        joined = lookup_joins(joined, lookups)
        ars.append(F.least("__by_name", "__by_place")["ARS"])
    values = {p: quoted(p) for p in features.PERIOD_COLUMNS}
    decade = features.pick_by_label(F.col("periode"), values)
    return joined.select(
        *requests.columns,
        F.coalesce(*ars).alias("ARS"),
        F.col("Insgesamt").alias("zensus_total"),
        decade.alias("zensus_decade"),
        features.factor(decade, F.col("Insgesamt")).alias("zensus_factor"),
    )


# --- duplicates ---------------------------------------------------------------------


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.where(F.col("__n") > 1).select(*keys)


def duplicate_keys(df: DataFrame, keys: list[str], keep: bool = True) -> DataFrame:
    """All rows whose key occurs more than once, or (``keep=False``) all the others."""
    how = "left_semi" if keep else "left_anti"
    return lookup_join(df, repeated_keys(df, keys), keys, how, null_safe=True)


def duplicate_flag(df: DataFrame, keys: list[str], out: str = "is_duplicate") -> DataFrame:
    """Every row with a flag telling whether its key occurs more than once.

    The groups are counted and joined back, so no group has to sit in one window task.
    """
    marked = repeated_keys(df, keys).withColumn(out, F.lit(True))
    joined = lookup_join(df, marked, keys, null_safe=True)
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(False)))
