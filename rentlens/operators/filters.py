"""Row filters and the counts that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentlens.functions import parsing


def plausible(df: DataFrame, area: str = "area_sqm", rent: str = "rent_cold") -> DataFrame:
    return df.where(
        (F.col(area) > 10) & (F.col(area) < 400) & (F.col(rent) > 200) & (F.col(rent) < 10000)
    )


def has_target(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def removed_rows(df: DataFrame, *columns: str) -> DataFrame:
    """How many rows ``has_target`` keeps and drops."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(whole).alias("rows_after"),
        F.count_if(~whole).alias("rows_removed"),
    )


def rent_between(df: DataFrame, rent: str, low: float = 2, high: float = 30) -> DataFrame:
    return df.where(F.col(rent).between(low, high))


def valid_key(df: DataFrame, key: str, width: int = 12) -> DataFrame:
    """Key cleaned and padded; rows without any digit in it are dropped."""
    return df.withColumn(key, parsing.pad_key(F.col(key), width)).where(F.col(key).isNotNull())


def valid_mapping_rows(df: DataFrame, plz: str = "PLZ", ags: str = "AGS") -> DataFrame:
    cleaned = df.withColumns({plz: parsing.plz5(F.col(plz)), ags: parsing.digits_only(F.col(ags))})
    return cleaned.dropna(subset=[plz, ags])


def positive_rooms(df: DataFrame, rooms: str = "rooms", area: str = "area_sqm") -> DataFrame:
    return df.where((F.col(rooms) > 0) & (F.col(area) > 10))


def inconsistent_total(df: DataFrame, total: str, base: str) -> DataFrame:
    return df.agg(F.count_if(F.col(total) < F.col(base)).alias("inconsistent"))


def unmatched_rows(df: DataFrame, key: str, columns: list[str], limit: int = 200) -> DataFrame:
    """Distinct places left without a key, the first ``limit`` in column order."""
    left = df.where(F.col(key).isNull()).select(*columns).distinct()
    return left.orderBy(*[F.col(c).asc_nulls_last() for c in columns]).limit(limit)
