"""Derived listing and census features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlens.functions.parsing import round_cents

# Construction periods as (label, first year, last year).
PERIODS = [
    ("vor_1919", None, 1918),
    ("1919_1949", 1919, 1949),
    ("1950_1959", 1950, 1959),
    ("1960_1969", 1960, 1969),
    ("1970_1979", 1970, 1979),
    ("1980_1989", 1980, 1989),
    ("1990_1999", 1990, 1999),
    ("2000_2009", 2000, 2009),
    ("2010_2015", 2010, 2015),
    ("2016_plus", 2016, None),
]
PERIOD_COLUMNS = [label for label, _, _ in PERIODS]

# Periods the census pick list leaves out.
GAP_PERIODS = ["1960_1969", "1990_1999"]
PICK_PERIODS = [p for p in PERIOD_COLUMNS if p not in GAP_PERIODS]

# Base rent per square metre of the rule-based estimate.
CITY_BASE = {"Berlin": 13.0, "München": 18.0, "Hamburg": 14.0, "Köln": 13.5, "Frankfurt": 15.0}
OTHER_BASE = 11.0
REFURBISHED = ["neu", "saniert", "renoviert"]


def size_bands() -> list[tuple[str, float, float | None]]:
    """Ten-square-metre bands from 30 to 180 with an open band at either end."""
    inner = [(f"{lo} - {lo + 9} m²", float(lo), float(lo + 10)) for lo in range(30, 180, 10)]
    return [("Unter 30 m²", 0.0, 30.0), *inner, ("180 m² und mehr", 180.0, None)]


SIZE_COLUMNS = [label for label, _, _ in size_bands()]


def year_to_period(year: Column, periods: list[str] = PERIOD_COLUMNS) -> Column:
    y = F.when(year >= 0, F.floor(year)).otherwise(F.ceil(year))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, first, last in PERIODS:
        if label not in periods:
            continue
        inside = F.lit(True)
        if first is not None:
            inside = inside & (y >= first)
        if last is not None:
            inside = inside & (y <= last)
        out = out.when(inside, label)
    return out


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def period_or_unknown(year: Column, existing: Column | None = None) -> Column:
    known = [year_to_period(year)] + ([existing] if existing is not None else [])
    return F.coalesce(*known, F.lit("unknown"))


def price_per_sqm(rent: Column, area: Column) -> Column:
    return F.when(area > 0, rent / area)


def building_age(year: Column, reference_year: int = 2025) -> Column:
    return F.lit(reference_year) - year


def fill_total_rent(total: Column, cold: Column, service: Column) -> Column:
    summed = F.coalesce(cold, F.lit(0.0)) + F.coalesce(service, F.lit(0.0))
    return F.when(total.isNull() | (total == 0), summed).otherwise(total)


def clamp_floor(c: Column, low: int = 0, high: int = 60) -> Column:
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def factor(part: Column, total: Column) -> Column:
    return F.try_divide(part, total)


def pick_by_label(label: Column, columns: dict[str, Column]) -> Column:
    """Value of the column whose label the row carries; null for other labels."""
    out = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, value in columns.items():
        out = out.when(label == name, value)
    return out


def area_bucket(area: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, low, high in size_bands():
        inside = area >= low
        if high is not None:
            inside = inside & (area < high)
        out = out.when(inside, label)
    return out


def year_bucket(year: Column) -> Column:
    return year_to_period(year, PICK_PERIODS)


def or_default(c: Column, default: float) -> Column:
    """Null and zero both count as missing."""
    return F.coalesce(F.nullif(c.cast("double"), F.lit(0.0)), F.lit(float(default)))


def heuristic_rent(city: Column, area: Column, condition: Column, floor: Column) -> Column:
    """Rule-based cold rent, rounded to cents."""
    base = F.when(F.lit(False), F.lit(0.0))
    for name, value in CITY_BASE.items():
        base = base.when(city == name, value)
    base = base.otherwise(OTHER_BASE)
    size = or_default(area, 60)
    refurbished = F.lower(F.coalesce(condition, F.lit(""))).isin(REFURBISHED)
    bonus = F.when(refurbished, 1.08).otherwise(1.0)
    lift = F.lit(1.0) + F.lit(0.01) * F.coalesce(floor.cast("double"), F.lit(0.0))
    return round_cents(base * F.pow(size, F.lit(0.15)) * bonus * lift * size)
