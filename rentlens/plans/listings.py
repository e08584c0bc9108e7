"""From raw portal rows to the cleaned, keyed and census-enriched training table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import features, parsing
from rentlens.operators import columns, filters, impute, resolve
from rentlens.operators.aggregates import expand_flags
from rentlens.operators.columns import numeric
from rentlens.operators.frames import cut
from rentlens.operators.joins import lookup_join

# yes/no columns and text categories of the portal file.
FLAG_COLUMNS = ["balcony", "garden", "lift", "hasKitchen", "cellar", "petsAllowed"]
CATEGORY_COLUMNS = ["firingTypes", "typeOfFlat"]
NUMBER_COLUMNS = [
    "rent_cold", "area_sqm", "rooms", "floor", "yearConstructed", "serviceCharge", "totalRent",
    "pricetrend",
]


def number_or_comma(df: DataFrame, name: str):
    """Text columns may use a decimal comma; typed columns only lose NaN."""
    if df.schema[name].dataType.simpleString() == "string":
        return parsing.to_num_comma(F.col(name))
    return numeric(df, name)


def clean_listings(raw: DataFrame) -> DataFrame:
    """Flags, heating, numbers, total rent, categories, period and the two global fills."""
    df = expand_flags(raw, FLAG_COLUMNS)
    if "heatingType" in df.columns:
        df = df.withColumn("heatingType_clean", parsing.heating_clean(F.col("heatingType")))
    df = columns.drop_existing(df, columns.DROP_LIST)
    df = columns.rename_map(df, columns.TRAIN_NAMES)
    present = [c for c in NUMBER_COLUMNS if c in df.columns]
    df = df.withColumns({c: number_or_comma(df, c) for c in present})
    if "serviceCharge" in present:
        df = impute.fill_const(df, {"serviceCharge": 0.0})
    if {"rent_cold", "serviceCharge", "totalRent"} <= set(present):
        total = features.fill_total_rent(
            F.col("totalRent"), F.col("rent_cold"), F.col("serviceCharge")
        )
        df = df.withColumn("totalRent", total)
    df = df.withColumns(
        {c: parsing.tidy_category(F.col(c)) for c in CATEGORY_COLUMNS if c in df.columns}
    )
    if "yearConstructed" in present:
        known = F.col("periode_0005") if "periode_0005" in df.columns else None
        df = df.withColumns(
            {
                "dekade": features.decade(F.col("yearConstructed")),
                "periode_0005": features.period_or_unknown(F.col("yearConstructed"), known),
            }
        )
    if "floor" in present:
        df = df.withColumn("floor", features.clamp_floor(F.col("floor")))
    return fill_global(df, 0.0)


def fill_global(
    df: DataFrame, default_floor: float | None = None, counts: DataFrame | None = None
) -> DataFrame:
    """Floor by its mode and price trend by its mean, as far as the columns exist."""
    if "floor" in df.columns and "pricetrend" in df.columns:
        return impute.fill_mode_and_mean(df, "floor", "pricetrend", default_floor, counts)
    if "floor" in df.columns:
        return impute.fill_mode(df, "floor", default_floor)
    return impute.fill_mean(df, "pricetrend") if "pricetrend" in df.columns else df


def resolve_listings(
    listings: DataFrame, key_map: DataFrame, census: DataFrame
) -> DataFrame:
    """PLZ and name cascade first; unique census names fill what it leaves open."""
    keyed = resolve.resolve_ars_cascade(listings, key_map)
    return resolve.resolve_by_census_name(keyed, census)


def train_from_listings(
    listings: DataFrame, key_map: DataFrame, census: DataFrame
) -> DataFrame:
    """``resolve_listings`` and ``train_ready`` with two passes over the listings.

    The first one counts per place and floor, as far as those columns go; places are
    resolved and the global fills found from these counts. The second one joins the keys.
    """
    if not {"floor", "pricetrend"} <= set(listings.columns):
        return train_ready(resolve_listings(listings, key_map, census))
    known = [c for c in ("ARS",) if c in listings.columns]
    sources = resolve.place_columns(listings, ["regio3", "regio2", *known])
    floor, trend = numeric(listings, "floor"), numeric(listings, "pricetrend")
    counts = cut(impute.mode_and_mean_counts(listings, floor, trend, sources))
    places = counts.select(*sources).distinct()
    own = {c: f"__{c}" for c in sources}
    resolved = resolve_listings(
        places.withColumns({new: F.col(c) for c, new in own.items()}), key_map, census
    )
    answers = cut(
        resolved.select(*[F.col(new).alias(c) for c, new in own.items()], F.col("ARS").alias("__key"))
    )

    def keyed(df: DataFrame) -> DataFrame:
        joined = lookup_join(df, answers, sources, null_safe=True)
        return joined.withColumn("ARS", F.col("__key")).drop("__key")

    return train_ready(keyed(listings), filters.valid_key(keyed(counts), "ARS", 12))


def train_ready(keyed: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Thirteen training columns, filled and filtered; rows without a key are dropped."""
    df = filters.valid_key(keyed, "ARS", 12)
    df = columns.rename_map(df, columns.TRAIN_NAMES)
    numbers = [c for c in NUMBER_COLUMNS if c in df.columns]
    df = df.withColumns({c: numeric(df, c) for c in numbers})
    flags = [c for c in ("garden", "lift", "hasKitchen", "balcony", "cellar") if c in df.columns]
    df = df.withColumns({c: parsing.flag01(F.col(c)) for c in flags})
    df = columns.keep_existing(df, columns.TRAIN_COLUMNS)
    if "serviceCharge" in df.columns:
        df = impute.fill_const(df, {"serviceCharge": 0.0})
    df = fill_global(df, counts=counts)
    texts = [c for c in ("typeOfFlat", "heatingType_clean", "periode_0005") if c in df.columns]
    return filters.plausible(impute.fill_const(df, {c: "unknown" for c in texts}))


def train_joined(ready: DataFrame, census: DataFrame) -> DataFrame:
    """Training table with census total, period rent and period factor."""
    names = columns.keep_existing(ready, columns.TRAIN_COLUMNS).columns
    return resolve.join_census(ready, census, names)


def first_pass(raw: DataFrame, reference_year: int = 2025) -> DataFrame:
    """The small cleaning pass: core columns, city medians, price per square metre, age."""
    df = filters.has_target(raw, "baseRent", "livingSpace")
    df = filters.plausible(df, "livingSpace", "baseRent")
    core = df.select(
        *[F.col(c) for c in ("listing_id",) if c in df.columns],
        numeric(df, "baseRent").alias("rent_cold"),
        numeric(df, "livingSpace").alias("area_sqm"),
        numeric(df, "noRooms").alias("rooms"),
        numeric(df, "floor").alias("floor"),
        numeric(df, "yearConstructed").alias("year_built"),
        F.lower("condition").alias("condition"),
        F.col("geo_plz").alias("zip_code"),
        F.coalesce("regio3", "regio2").alias("city"),
        F.col("regio2").alias("district"),
    )
    core = impute.fill_const(core, {"condition": "unknown", "floor": 0.0})
    core = impute.fill_group_median(core, ["year_built", "rooms"], "city")
    core = filters.positive_rooms(core)
    return core.withColumns(
        {
            "price_per_sqm": features.price_per_sqm(F.col("rent_cold"), F.col("area_sqm")),
            "building_age": features.building_age(F.col("year_built"), reference_year),
        }
    )


def clean_census(raw: DataFrame, value_columns: list[str] | None = None) -> DataFrame:
    """Census file to keys, names and gap-free rents; key padded to twelve digits."""
    df = columns.rename_map(columns.clean_headers(raw), columns.PERIOD_SPELLINGS)
    key, name = columns.find_key_column(df.columns)
    df = df.withColumnsRenamed({key: "GKZ", **({name: "Gemeindename"} if name else {})})
    wanted = value_columns or [c for c in df.columns if c not in ("GKZ", "Gemeindename")]
    df = columns.keep_existing(df, ["GKZ", "Gemeindename", *wanted])
    values = [c for c in wanted if c in df.columns]
    df = df.withColumns(
        {
            "GKZ": parsing.pad_key(F.col("GKZ"), 12),
            **{c: parsing.strip_to_number(columns.quoted(c)) for c in values},
        }
    )
    parts = [c for c in values if c != "Insgesamt"]
    return impute.fill_row_then_median(df, parts, "Insgesamt")
