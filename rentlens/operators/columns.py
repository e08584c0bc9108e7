"""Schema resolution: aliases, renames, keep and drop lists, typed target schemas.

Everything here looks only at ``df.columns`` and ends in one ``select``, so Catalyst
still sees plain column expressions and prunes the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.functions import features, parsing, places
from rentlens.functions import text as tx

# Source names accepted for each target column of the listings table.
LISTING_ALIASES = {
    "city": ["city", "Stadt"],
    "zip_code": ["zip", "postal_code", "plz"],
    "district": ["district", "Ortsteil", "neighbourhood"],
    "lat": ["lat", "latitude", "Latitude"],
    "lon": ["lng", "lon", "longitude", "Longitude"],
    "area_sqm": ["livingSpace", "area", "squareMeters", "size", "total_area_sqm"],
    "rooms": ["rooms", "numRooms", "NumRooms"],
    "floor": ["floor", "Floor"],
    "year_built": ["yearConstructed", "year_built", "construction_year"],
    "condition": ["condition", "state"],
    "rent_cold": ["price", "cold_rent", "rent", "Nettokaltmiete"],
    "rent_warm": ["warm_rent", "Warmmiete"],
    "created_at": ["date", "created_at", "inserted_at"],
}

# The portal's own names, which the list above lacks; tried after it.
PORTAL_ALIASES = {
    "city": ["regio3", "regio2"],
    "zip_code": ["geo_plz"],
    "district": ["regio2"],
    "rooms": ["noRooms"],
    "rent_cold": ["baseRent"],
    "rent_warm": ["totalRent"],
}

LISTING_DOUBLES = ["lat", "lon", "area_sqm", "rooms", "floor", "rent_cold", "rent_warm"]

# Dashboard schema and the names accepted for it, case-insensitive.
DASHBOARD_ALIASES = {
    "state": ["state", "federal_state", "bundesland", "region"],
    "city": ["city", "ort", "municipality", "place", "stadt"],
    "coldRent": ["coldRent", "netColdRent", "net_rent", "netRent", "baseRent"],
    "area_sqm": ["area_sqm", "livingSpace", "wohnflaeche", "wohnfläche", "size"],
    "rooms": ["rooms", "anzahl_zimmer"],
    "plz": ["plz", "zip_code", "postalCode"],
    "balcony": ["balcony", "hasBalcony"],
    "hasKitchen": ["hasKitchen", "kitchen", "einbaukueche", "einbauküche"],
}
WARM_ALIASES = ["totalRent", "warmmiete", "warmRent"]
SERVICE_ALIASES = ["serviceCharge", "nebenkosten"]

# The portal's region columns and the training names, tried after the list above.
DASHBOARD_EXTRA = {
    "state": ["regio1"],
    "city": ["regio3", "regio2"],
    "coldRent": ["rent_cold"],
    "plz": ["geo_plz"],
}

# Names of the census key and name columns, lower case.
KEY_SYNONYMS = [
    "gkz", "ars", "ags", "kgs", "amtlicher gemeindeschlüssel", "amtlicher gemeindeschluessel",
    "gemeindeschlüssel", "gemeindeschluessel", "amtlicher regionalschlüssel",
]
NAME_SYNONYMS = ["gemeindename", "gemeinde", "name"]
TOTAL_SYNONYMS = ["insgesamt", "total"]

# Spellings of the period columns in census files.
PERIOD_SPELLINGS = {
    "Miete_raw": "Insgesamt",
    "Vor 1919": "vor_1919",
    "befor 1919": "vor_1919",
    "1919-1949": "1919_1949",
    "1919 - 1949": "1919_1949",
    "1950-1959": "1950_1959",
    "1950 - 1959": "1950_1959",
    "1960-1969": "1960_1969",
    "1660-1969": "1960_1969",
    "1970-1979": "1970_1979",
    "1970 - 1979": "1970_1979",
    "1980-1989": "1980_1989",
    "1980 - 1989": "1980_1989",
    "1990-1999": "1990_1999",
    "1690-1999": "1990_1999",
    "2000-2009": "2000_2009",
    "2000 - 2009": "2000_2009",
    "2010-2015": "2010_2015",
    "2010 - 2015": "2010_2015",
    "2016 und später": "2016_plus",
    "after 2016": "2016_plus",
    "Gemeinde name": "Gemeindename",
}

# Training renames, columns dropped early, columns kept for training.
TRAIN_NAMES = {"baseRent": "rent_cold", "livingSpace": "area_sqm", "noRooms": "rooms"}
DROP_LIST = [
    "telekomHybridUploadSpeed", "electricityBasePrice", "electricityKwhPrice", "petsAllowed",
    "energyEfficiencyClass", "lastRefurbish", "heatingCosts", "noParkSpaces", "interiorQual",
    "thermalChar", "numberOfFloors", "houseNumber", "streetPlain", "condition",
    "telekomUploadSpeed", "telekomTvOffer", "date", "street", "description", "facilities",
    "scoutId", "noRoomsRange", "newlyConst", "livingSpaceRange", "yearConstructedRange",
    "picturecount", "heatingType",
]
REGION_COLUMNS = ["regio1", "regio2", "regio3", "geo_bln", "geo_krs", "geo_plz"]
TRAIN_COLUMNS = [
    "ARS", "rent_cold", "area_sqm", "rooms", "floor", "pricetrend", "serviceCharge",
    "garden", "lift", "hasKitchen", "typeOfFlat", "heatingType_clean", "periode_0005",
]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pick_alias(columns: list[str], candidates: list[str]) -> str | None:
    return next((c for c in candidates if c in columns), None)


def pick_alias_ci(columns: list[str], candidates: list[str]) -> str | None:
    by_lower = {c.lower(): c for c in columns}
    return next((by_lower[c.lower()] for c in candidates if c.lower() in by_lower), None)


def with_extras(
    base: dict[str, list[str]], extra: dict[str, list[str]]
) -> dict[str, list[str]]:
    return {k: names + extra.get(k, []) for k, names in base.items()}


def alias_map(
    df: DataFrame, aliases: dict[str, list[str]], case_sensitive: bool = True
) -> dict[str, str | None]:
    pick = pick_alias if case_sensitive else pick_alias_ci
    return {target: pick(df.columns, names) for target, names in aliases.items()}


def select_aliases(
    df: DataFrame, aliases: dict[str, list[str]], case_sensitive: bool = True
) -> DataFrame:
    """Project to the target names; a target without source is a null string."""
    found = alias_map(df, aliases, case_sensitive)
    return df.select(
        *[
            (quoted(src) if src else F.lit(None).cast("string")).alias(target)
            for target, src in found.items()
        ]
    )


def numeric(df: DataFrame, name: str) -> Column:
    """The column as double: typed columns lose only NaN, text is parsed tolerantly."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return parsing.no_nan(quoted(name).cast("double"))
    if isinstance(kind, T.NumericType):
        return quoted(name).cast("double")
    return parsing.to_num(quoted(name))


def standardize_listings(
    df: DataFrame, keep: list[str] | None = None, extra_json: bool = False
) -> DataFrame:
    """Thirteen target columns with types; optionally the rest packed as JSON."""
    aliases = with_extras(LISTING_ALIASES, PORTAL_ALIASES)
    found = alias_map(df, aliases)
    out = []
    for target, src in found.items():
        if src is None:
            kind = "double" if target in LISTING_DOUBLES else "string"
            col = F.lit(None).cast("int" if target == "year_built" else kind)
        elif target in LISTING_DOUBLES:
            col = numeric(df, src)
        elif target == "year_built":
            col = numeric(df, src).try_cast("int")
        else:
            col = quoted(src).cast("string")
        out.append(col.alias(target))
    if extra_json:
        used = {src for src in found.values() if src} | set(keep or [])
        rest = [c for c in df.columns if c not in used]
        out.append(pack_json(rest).alias("extra_json"))
    return df.select(*[quoted(c) for c in keep or []], *out)


def pack_json(columns: list[str]) -> Column:
    """One JSON object per row, null fields kept."""
    if not columns:
        return F.lit("{}")
    return F.to_json(F.struct(*[quoted(c) for c in columns]), {"ignoreNullFields": "false"})


def rename_map(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def drop_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*names)


def keep_existing(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in names if c in df.columns])


def require_columns(df: DataFrame, names: list[str], label: str = "table") -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{label}: missing columns {missing}; present are {df.columns}")
    return df


def tag_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def clean_headers(df: DataFrame) -> DataFrame:
    names = [re.sub(r"\s+", " ", c.replace("﻿", "").replace("\xad", "").strip()) for c in df.columns]
    return df.toDF(*names)


def find_key_column(columns: list[str]) -> tuple[str, str | None]:
    """Names of the key column (required) and of the name column (optional)."""
    key = pick_alias_ci([c.strip() for c in columns], KEY_SYNONYMS)
    if key is None:
        raise ValueError(f"no municipality key among {columns}")
    by_stripped = {c.strip(): c for c in columns}
    name = pick_alias_ci(columns, NAME_SYNONYMS)
    return by_stripped[key], name


def load_zensus(df: DataFrame) -> DataFrame:
    """Census table with GKZ, Gemeindename, numeric rest and a normalised name."""
    key, name = find_key_column(df.columns)
    names = {key: "GKZ"}
    if name:
        names[name] = "Gemeindename"
    total = pick_alias_ci(df.columns, TOTAL_SYNONYMS)
    if total:
        names[total] = "Insgesamt"
    named = df.withColumnsRenamed(names)
    texts = ["GKZ", "Gemeindename"]
    norm = (
        places.dashboard(F.col("Gemeindename")) if "Gemeindename" in named.columns else F.lit("")
    )
    return named.select(
        *[
            quoted(c) if c in texts else numeric(named, c).alias(c)
            for c in named.columns
        ],
        norm.alias("name_norm"),
    )


def load_key_map(
    df: DataFrame, variant: str = "dashboard", fill_missing: bool = False
) -> DataFrame | None:
    """ARS, AGS, PLZ, Gemeindename, Ort and both normalised names, distinct.

    Without one of the columns there is no map (None), unless ``fill_missing`` asks for
    null columns; that form also cleans PLZ and the two keys. An optional ``row_no``
    (file order, for first-wins rules) is kept as the smallest of equal rows.
    """
    wanted = ["ARS", "AGS", "PLZ", "Gemeindename", "Ort"]
    found = {c: pick_alias_ci(df.columns, [c]) for c in wanted}
    if not fill_missing and None in found.values():
        return None
    cols = {
        c: (quoted(src).cast("string") if src else F.lit(None).cast("string"))
        for c, src in found.items()
    }
    if fill_missing:
        cols["PLZ"] = parsing.plz5(cols["PLZ"])
        cols["ARS"] = parsing.digits_only(cols["ARS"])
        cols["AGS"] = parsing.pad_key(cols["AGS"], 8)
    order = [F.col("row_no")] if "row_no" in df.columns else []
    out = df.select(
        *[col.alias(c) for c, col in cols.items()],
        places.normalize_place(cols["Gemeindename"], variant).alias("name_norm"),
        places.normalize_place(cols["Ort"], variant).alias("ort_norm"),
        *order,
    )
    if not order:
        return out.distinct()
    keys = [c for c in out.columns if c != "row_no"]
    return out.groupBy(*keys).agg(F.min("row_no").alias("row_no"))


def normalize_immo(df: DataFrame) -> DataFrame:
    """The common dashboard schema on top of all other columns.

    Adds the derived columns the dashboard tables need: ``rent_per_sqm`` and
    ``city_norm``; null names stay null.
    """
    aliases = with_extras(DASHBOARD_ALIASES, DASHBOARD_EXTRA)
    found = alias_map(df, aliases, case_sensitive=False)
    warm = pick_alias_ci(df.columns, WARM_ALIASES)
    service = pick_alias_ci(df.columns, SERVICE_ALIASES)
    if found["coldRent"] is None and warm and service:
        df = df.withColumn("coldRent", numeric(df, warm) - numeric(df, service))
        found["coldRent"] = "coldRent"
    out = rename_map(df, {src: target for target, src in found.items() if src})
    require_columns(out, ["state", "city", "coldRent"], "listings")
    changes = {c: tx.strip(F.col(c).cast("string")) for c in ("state", "city")}
    changes["coldRent"] = numeric(out, "coldRent")
    for flag in ("balcony", "hasKitchen", "garden", "lift"):
        if flag in out.columns:
            text = isinstance(out.schema[flag].dataType, T.StringType)
            words = F.coalesce(parsing.to_bool01(F.col(flag)), F.lit(0))
            changes[flag] = words if text else parsing.flag_int(F.col(flag))
    out = out.withColumns(changes)
    extra = {"city_norm": places.dashboard(F.col("city"))}
    if "area_sqm" in out.columns:
        extra["rent_per_sqm"] = features.price_per_sqm(F.col("coldRent"), numeric(out, "area_sqm"))
    return out.withColumns(extra)


def melt_long(
    df: DataFrame,
    key: str,
    name: str,
    value_columns: list[str],
    value_name: str = "miete_qm",
    var_name: str = "kategorie",
    low: float = 2.0,
    high: float = 30.0,
) -> DataFrame:
    """Wide to long, cells parsed, only rents between the two bounds (inclusive)."""
    texts = df.select(
        quoted(key).alias("ags"),
        quoted(name).alias("gemeinde"),
        *[quoted(c).cast("string").alias(c) for c in value_columns],
    )
    long = texts.unpivot(
        ["ags", "gemeinde"], [quoted(c) for c in value_columns], var_name, value_name
    )
    parsed = long.withColumn(value_name, parsing.zensus_to_float(F.col(value_name)))
    return parsed.where(F.col(value_name).between(low, high))


def detect_numeric_columns(
    df: DataFrame, order: str, columns: list[str], sample_rows: int = 80, share: float = 0.5
) -> DataFrame:
    """Share of parseable cells among the first rows and whether the column counts as numeric."""
    head = df.orderBy(order).limit(sample_rows)
    parsed = [
        F.avg(parsing.zensus_to_float(quoted(c).cast("string")).isNotNull().cast("double")).alias(c)
        for c in columns
    ]
    long = head.agg(*parsed).unpivot([], [quoted(c) for c in columns], "column", "share")
    return long.withColumn("is_numeric", F.col("share") > share)


def resolve_features(df: DataFrame, numeric_names: list[str], categorical_names: list[str]) -> dict:
    """Split the wanted features into present and missing ones; none present is an error."""
    out = {
        "numeric": [c for c in numeric_names if c in df.columns],
        "categorical": [c for c in categorical_names if c in df.columns],
        "missing": [c for c in [*numeric_names, *categorical_names] if c not in df.columns],
    }
    if not out["numeric"] and not out["categorical"]:
        raise ValueError("no feature column found")
    return out
