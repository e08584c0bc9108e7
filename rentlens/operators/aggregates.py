"""Counts, shares, profiles and the market tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.functions import features, parsing, places
from rentlens.functions import text as tx
from rentlens.operators.columns import quoted
from rentlens.operators.joins import lookup_join
from rentlens.operators.quantiles import exact_quantiles


def count_by(df: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows per value, the null group included; optionally the largest ``limit``."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_listings"))
    return counts if limit is None else top_k(counts, "n_listings", limit, key)


def top_k(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *[F.asc_nulls_first(t) for t in ties]).limit(k)


def city_stats(df: DataFrame, rent: str = "rent_per_sqm") -> DataFrame:
    """Listings and median rent per square metre of each city.

    The normalised name follows from the city, so it is made once per city.
    """
    stats = exact_quantiles(df, rent, {"immo_median": 0.5}, ["city"])
    name = places.dashboard(F.col("city"))
    return stats.select("city", name.alias("city_norm"), F.col("rows").alias("n"), "immo_median")


def market_vs_census(stats: DataFrame, census: DataFrame, k: int = 20) -> DataFrame:
    """Largest cities with their census rent and the gap to it.

    A census name that occurs on several rows repeats the city, as many rows as it has.
    Only the ``k`` largest cities can end up among the first ``k`` result rows, so the
    census side is joined to those alone.
    """
    largest = top_k(stats, "n", k, "city", "city_norm")
    rents = census.select(F.col("name_norm").alias("city_norm"), "Gemeindename", "Insgesamt")
    joined = lookup_join(largest, rents, ["city_norm"])
    compared = joined.select(
        "city",
        "n",
        "immo_median",
        F.col("Insgesamt").alias("zensus"),
        (F.col("immo_median") - F.col("Insgesamt")).alias("delta"),
        "Gemeindename",
    )
    return top_k(compared, "n", k, "city", "Gemeindename", "zensus")


def feature_share(df: DataFrame, flags: list[str]) -> DataFrame:
    """Percent of listings with each feature, one decimal, largest first."""
    shares = df.agg(*[F.bround(F.avg(f) * 100, 1).alias(f) for f in flags])
    long = shares.unpivot([], flags, "feature", "share_pct")
    return long.orderBy(F.desc("share_pct"), "feature")


def feature_counts(df: DataFrame, flags: list[str], plz: str = "plz") -> DataFrame:
    return df.groupBy(plz).agg(*[F.sum(f).alias(f) for f in flags])


def feature_counts_by_plz(
    df: DataFrame, flags: list[str], plz: str = "plz", k: int = 10
) -> DataFrame:
    """Feature counts of the ``k`` PLZ with the most features; rows without PLZ are out."""
    keyed = df.withColumn("plz_str", parsing.plz5(F.col(plz))).where(F.col("plz_str").isNotNull())
    sums = feature_counts(keyed, flags, "plz_str")
    total = sum([F.col(f) for f in flags], F.lit(0))
    return top_k(sums.withColumn("total", total), "total", k, "plz_str").drop("total")


def match_rate(df: DataFrame, key: str) -> DataFrame:
    return df.agg(
        F.count(key).alias("matched"),
        F.count(F.lit(1)).alias("total"),
        F.try_divide(F.count(key), F.count(F.lit(1))).alias("rate"),
    )


def match_rate_by(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per precision class, unresolved rows as the null class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("rate", F.col("n") / total)


def missing_summary(df: DataFrame) -> DataFrame:
    """Null count, percent (one decimal) and type of every column, in one pass."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    cells = [
        F.struct(
            F.count_if(quoted(c).isNull()).alias("missing_count"),
            F.bround(F.avg(quoted(c).isNull().cast("double")) * 100, 1).alias("missing_pct"),
            F.lit(kind).alias("dtype"),
        ).alias(c)
        for c, kind in kinds.items()
    ]
    long = df.agg(*cells).unpivot([], [quoted(c) for c in kinds], "column", "cell")
    return long.select("column", "cell.*").orderBy(F.desc("missing_count"), "column")


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per column."""
    long = df.select(*[quoted(c).cast("double").alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "column", "value"
    )
    plain = long.groupBy("column").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(
        long, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"]
    )
    # One row per described column on either side.
    return plain.join(F.broadcast(quartiles), "column").select(
        "column", F.col("n").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, distinct values, the most frequent value and its frequency per column."""
    long = df.select(*[quoted(c).cast("string").alias(c) for c in columns]).unpivot(
        [], [quoted(c) for c in columns], "column", "value"
    )
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
    known = counts.where(F.col("value").isNotNull())
    top = F.min(F.struct((-F.col("freq")).alias("rank"), "value")).alias("top")
    return known.groupBy("column").agg(
        F.sum("freq").alias("count"), F.count(F.lit(1)).alias("unique"), top
    ).select("column", "count", "unique", F.col("top.value").alias("top"),
             (-F.col("top.rank")).alias("freq"))


def key_uniqueness(df: DataFrame, key: str) -> DataFrame:
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("rows"),
        F.count(key).alias("distinct_keys"),
        F.coalesce(F.max("n") > 1, F.lit(False)).alias("has_duplicates"),
    )


def value_counts(df: DataFrame, column: str, k: int = 15) -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, "n", k, column)


def min_max_mean(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean")
    )


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included."""
    x = F.col(column)
    known = df.where(x.isNotNull()).select(column)
    span = known.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    low, high = span.select("low").scalar(), span.select("high").scalar()
    share = F.try_divide(x - low, high - low)
    at = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    empty = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return empty.join(counts, "bin", "left").select(
        "bin",
        (low + F.col("bin") * ((high - low) / bins)).alias("lower"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def distinct_places(df: DataFrame, variant: str = "trailing_words") -> DataFrame:
    """Raw and normalised place names: fine name, else the coarser one."""
    raw = F.coalesce(tx.blank_to_null(F.col("regio3")), F.col("regio2"), F.lit(""))
    named = df.select(raw.alias("city_raw")).distinct()
    return named.withColumn("city_norm", places.normalize_place(F.col("city_raw"), variant))


def count_places(names: DataFrame) -> DataFrame:
    """How many raw and normalised names there are."""
    return names.agg(
        F.count("city_raw").alias("raw_names"), F.countDistinct("city_norm").alias("norm_names")
    )


def expand_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """The yes/no candidates among ``columns`` and all true boolean columns as 1/0."""
    booleans = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    wanted = [c for c in dict.fromkeys([*columns, *booleans]) if c in df.columns]
    return df.withColumns({c: parsing.to_bool01(F.col(c)) for c in wanted})


def with_rent_per_sqm(df: DataFrame, rent: str, area: str) -> DataFrame:
    return df.withColumn("rent_per_sqm", features.price_per_sqm(F.col(rent), F.col(area)))
