"""Dashboard tables over the common listing schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rentlens.operators import aggregates, columns, filters

FEATURES = ["balcony", "hasKitchen", "lift", "garden"]


def market_versus_census(listings: DataFrame, census: DataFrame, k: int = 20) -> DataFrame:
    """Median rent per square metre of the largest cities against the census rent."""
    immo = columns.normalize_immo(listings)
    plausible = filters.plausible(immo, "area_sqm", "coldRent")
    return aggregates.market_vs_census(
        aggregates.city_stats(plausible), columns.load_zensus(census), k
    )


def dashboard_tables(listings: DataFrame) -> dict[str, DataFrame]:
    """Listings per state and city, and feature counts per PLZ (null groups kept)."""
    immo = columns.normalize_immo(listings)
    flags = [c for c in FEATURES if c in immo.columns]
    return {
        "agg_state": aggregates.count_by(immo, "state"),
        "agg_city": aggregates.count_by(immo, "city"),
        "feat_by_plz": aggregates.feature_counts(
            immo, flags, "plz"
        ),
    }
