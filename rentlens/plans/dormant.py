"""Older jobs, kept for comparison with the current ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import features, parsing, places
from rentlens.functions import text as tx
from rentlens.operators import filters, impute
from rentlens.operators.columns import alias_map, numeric, quoted
from rentlens.operators.joins import first_row, lookup_join, lookup_joins

# Names accepted for each canonical listing column, case-insensitive.
CANONICAL_ALIASES = {
    "area_sqm": ["area_sqm", "livingSpace", "total_living_area", "size_sqm", "area"],
    "netRent": ["netRent", "netColdRent", "net_cold_rent", "cold_rent", "kaltmiete"],
    "warmRent": ["totalRent", "warmmiete", "warm_rent"],
    "PLZ": ["zip_code", "postcode", "plz", "postalCode", "zip"],
    "city": ["city", "ort", "town"],
    "state_raw": ["state", "bundesland", "federal_state", "federalState"],
    "year_built": ["year_built", "constructionYear", "yearOfConstruction", "baujahr"],
    "periode_0005": ["periode_0005", "periode_5", "build_period"],
    "lat": ["latitude", "geo_latitude", "lat"],
    "lon": ["longitude", "geo_longitude", "lon"],
    "balcony": ["balcony", "hasBalcony"],
    "hasKitchen": ["hasKitchen", "builtInKitchen", "kitchen"],
    "garden": ["garden", "hasGarden"],
    "lift": ["lift", "hasElevator", "elevator"],
}
BINARY = ["balcony", "hasKitchen", "garden", "lift"]
NUMBERS = ["area_sqm", "netRent", "warmRent", "year_built", "lat", "lon"]


def city_simple_from(df: DataFrame) -> DataFrame:
    """``city_simple`` from the first of city, cityName, address and location present."""
    names = [c for c in ("city", "cityName", "address", "location") if c in df.columns]
    source = F.coalesce(*[F.col(c) for c in names], F.lit(""))
    return df.withColumn("city_simple", places.city_simple(source))


def canonical_listing(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fourteen canonical columns; flags are 1/0 and 0 where the source is missing."""
    found = alias_map(df, CANONICAL_ALIASES, case_sensitive=False)
    out = []
    for target, src in found.items():
        if target in BINARY:
            col = parsing.trimmed_flag01(quoted(src)) if src else F.lit(0)
        elif src is None:
            col = F.lit(None).cast("double" if target in NUMBERS else "string")
        elif target == "PLZ":
            col = parsing.plz5(quoted(src))
        elif target in NUMBERS:
            col = numeric(df, src)
        else:
            col = quoted(src).cast("string")
        out.append(col.alias(target))
    return df.select(*[quoted(c) for c in keep or []], *out)


def state_from_plz(df: DataFrame, key_map: DataFrame, out: str = "state") -> DataFrame:
    """State name through the key of the PLZ; the first map row per PLZ decides."""
    table = key_map.select(
        parsing.plz5(F.col("PLZ")).alias("PLZ"), F.col("AGS").alias("__ags"), "row_no"
    ).where("PLZ is not null and __ags is not null")
    first = first_row(table, ["PLZ"], ["row_no"]).drop("row_no")
    joined = lookup_join(df, first, ["PLZ"])
    return joined.withColumn(out, parsing.state_name(F.substring("__ags", 1, 2))).drop("__ags")


def attach_regionals(df: DataFrame, key_map: DataFrame) -> DataFrame:
    """Raw state where given, else the state of the PLZ; missing periods from the year."""
    derived = state_from_plz(df, key_map, "__state")
    return derived.withColumns(
        {
            "state": F.coalesce(tx.strip(F.col("state_raw")), F.col("__state")),
            "periode_0005": F.coalesce(
                "periode_0005", features.year_to_period(F.col("year_built"))
            ),
        }
    ).drop("__state")


def expected_rent(df: DataFrame, census: DataFrame) -> DataFrame:
    """Census rate of (city, period), else the city's total, times the area."""
    names = ["Insgesamt", *features.PERIOD_COLUMNS]
    rates = census.groupBy(F.col("name_norm").alias("city_norm")).agg(
        *[F.avg(quoted(c)).alias(f"__{c}") for c in names]
    )
    keyed = df.withColumn("city_norm", places.dashboard(F.col("city")))
    joined = lookup_join(keyed, rates, ["city_norm"])
    own = features.pick_by_label(
        F.col("periode_0005"), {p: quoted(f"__{p}") for p in features.PERIOD_COLUMNS}
    )
    rate = F.coalesce(own, F.col("__Insgesamt"))
    return joined.withColumns(
        {"zensus_rate": rate, "zensus_expected": rate * F.col("area_sqm")}
    ).drop(*[f"__{c}" for c in names])


def census_with_fallback(census: DataFrame, rent: str) -> DataFrame:
    """Rows per (state, name) and, marked by a null state, the mean per name."""
    rows = census.select(
        parsing.state_name(F.substring(parsing.zero_pad(F.col("GKZ"), 11), 1, 2)).alias("state"),
        places.norm_name(F.col("Gemeindename")).alias("gemeinde_norm"),
        F.col(rent).alias("zensus_miete"),
    )
    means = rows.groupBy("gemeinde_norm").agg(F.avg("zensus_miete").alias("zensus_miete"))
    return rows.unionByName(means, allowMissingColumns=True)


def join_census_fallback(
    df: DataFrame, census: DataFrame, city: str, state: str | None
) -> DataFrame:
    """Census rent by (state, name), else by name alone.

    Names that a state holds twice would multiply listings, which must not happen
    with an m:1 check; here such a name has no row of its own and takes the mean.
    """
    keyed = df.withColumn("__city", places.norm_name(F.col(city)))
    exact = census.where(F.col("state").isNotNull())
    single = (
        exact.groupBy(
            places.norm_name(F.col("state")).alias("__state"),
            F.col("gemeinde_norm").alias("__city"),
        )
        .agg(F.count(F.lit(1)).alias("__n"), F.min("zensus_miete").alias("__exact"))
        .where("__n = 1")
        .drop("__n")
    )
    means = census.where(F.col("state").isNull()).select(
        F.col("gemeinde_norm").alias("__city"), F.col("zensus_miete").alias("__mean")
    )
    lookups = [(means, ["__city"])]
    values = ["__mean"]
    if state:
        keyed = keyed.withColumn("__state", places.norm_name(F.col(state)))
        lookups.insert(0, (single, ["__state", "__city"]))
        values.insert(0, "__exact")
    joined = lookup_joins(keyed, lookups)
    return joined.withColumn("zensus_miete", F.coalesce(*values)).drop(
        "__city", "__state", *values
    )


def basic_clean(df: DataFrame, reference_year: int = 2025) -> DataFrame:
    """Typed listing features of the older training job, filtered and filled."""
    for c in ("numberOfFloors", "typeOfFlat", "year_built", "yearConstructed"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    year = F.coalesce(numeric(df, "year_built"), numeric(df, "yearConstructed"))
    floors = numeric(df, "numberOfFloors")
    typed = df.withColumns(
        {
            "zip3": parsing.first_digits(F.col("zip_code"), 3),
            "zip2": parsing.first_digits(F.col("zip_code"), 2),
            "typeOfFlat": F.lower("typeOfFlat"),
            "numberOfFloors": floors,
            "year_built": year,
            "building_age": features.building_age(year, reference_year),
            **{c: numeric(df, c) for c in ("rooms", "area_sqm", "floor", "rent_cold")},
        }
    )
    typed = typed.withColumns(
        {
            "rooms_per_100qm": F.try_divide(F.col("rooms"), F.col("area_sqm") / 100.0),
            "floor_ratio": F.when(
                F.col("numberOfFloors") > 0, F.col("floor") / F.col("numberOfFloors")
            ),
        }
    )
    kept = filters.plausible(typed)
    kept = impute.fill_const(kept, {"condition": "unknown", "floor": 0.0})
    medians = impute.column_medians(kept, ["year_built", "rooms"])
    return kept.withColumns({c: F.coalesce(F.col(c), m) for c, m in medians.items()})


def factor_lookup(
    df: DataFrame, factors: DataFrame, bucket: str, out: str, columns: list[str]
) -> DataFrame:
    """Factor of (city, bucket), the national mean of the bucket where the city is unknown.

    A city that occurs on several factor rows uses the last one in key order.
    """
    long = factors.select("city_simple", "row_no", *[quoted(c) for c in columns]).unpivot(
        ["city_simple", "row_no"], [quoted(c) for c in columns], "__bucket", "__factor"
    )
    keys = ["city_simple", "__bucket"]
    own = long.groupBy(*keys).agg(
        F.max(F.struct("row_no", "__factor")).alias("__last")
    ).select(*keys, F.lit(True).alias("__known"), F.col("__last.__factor").alias("__own"))
    means = long.groupBy("__bucket").agg(F.avg("__factor").alias("__mean"))
    keyed = df.withColumn("__bucket", F.col(bucket))
    joined = lookup_joins(keyed, [(own, keys), (means, ["__bucket"])])
    value = F.when(F.col("__known"), F.col("__own")).otherwise(F.col("__mean"))
    return joined.withColumn(out, value).drop("__bucket", "__known", "__own", "__mean")


def combined_factor(*parts: str):
    """Product of the factors, a missing one counting as 1."""
    return reduce(
        lambda a, b: a * b, [F.coalesce(F.col(p), F.lit(1.0)) for p in parts]
    )
