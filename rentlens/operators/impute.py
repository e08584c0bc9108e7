"""Filling missing values: constants, modes, means, group and column medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.operators.columns import quoted
from rentlens.operators.joins import lookup_join
from rentlens.operators.quantiles import exact_medians


def fill_const(df: DataFrame, values: dict) -> DataFrame:
    return df.fillna(values)


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """One row with the most frequent non-null value, the smallest one on ties."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    return counts.orderBy(F.desc("count"), F.asc(column)).limit(1).select(column)


def fill_mode(df: DataFrame, column: str, default: float | None = 0.0) -> DataFrame:
    """Null cells take the most frequent value, ``default`` where there is none."""
    mode = most_frequent(df, column).scalar()
    rest = [] if default is None else [F.lit(default)]
    return df.withColumn(column, F.coalesce(F.col(column), mode, *rest))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    mean = df.agg(F.avg(column)).scalar()
    return df.withColumn(column, F.coalesce(F.col(column), mean))


def mode_and_mean_counts(
    df: DataFrame, mode_column: Column, mean_column: Column, by: list[str] | None = None
) -> DataFrame:
    """What both global fills need, per value of the mode column (and ``by``)."""
    return df.groupBy(*(by or []), mode_column.alias("__mode")).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.sum(mean_column).alias("__sum"),
        F.count(mean_column).alias("__known"),
    )


def fill_mode_and_mean(
    df: DataFrame,
    mode_column: str,
    mean_column: str,
    default: float | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Both global fills from a single pass: means are summed per value of the mode column.

    ``counts`` are those of ``mode_and_mean_counts`` where a job has them from an earlier
    pass; the rows are then not read for the fills.
    """
    if counts is None:
        counts = mode_and_mean_counts(df, F.col(mode_column), F.col(mean_column))
    per_value = counts.groupBy("__mode").agg(
        *[F.sum(c).alias(c) for c in ("__rows", "__sum", "__known")]
    )
    most = F.min(
        F.when(
            F.col("__mode").isNotNull(),
            F.struct((-F.col("__rows")).alias("rank"), F.col("__mode").alias("value")),
        )
    )
    fills = per_value.agg(
        most["value"].alias("mode"),
        F.try_divide(F.sum("__sum"), F.sum("__known")).alias("mean"),
    )
    known = fills.select(F.struct("mode", "mean")).scalar()
    mode = [known["mode"]] + ([F.lit(default)] if default is not None else [])
    return df.withColumns(
        {
            mode_column: F.coalesce(F.col(mode_column), *mode),
            mean_column: F.coalesce(F.col(mean_column), known["mean"]),
        }
    )


def with_group_median(
    df: DataFrame, columns: list[str], group: str, prefix: str = "median_"
) -> DataFrame:
    """Every row with the medians of its group; a null group has none.

    Joining the medians back keeps a large group spread over its tasks, which a window over
    the group would not.
    """
    medians = exact_medians(df.where(F.col(group).isNotNull()), columns, [group])
    named = medians.withColumnsRenamed({c: f"{prefix}{c}" for c in columns})
    return lookup_join(df, named, [group])


def fill_group_median(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Null cells take the median of their group, then of the column filled so far."""
    filled = with_group_median(df, columns, group, "__median_").withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.col(f"__median_{c}")) for c in columns}
    )
    overall = column_medians(filled, columns)
    rest = {c: F.coalesce(F.col(c), overall[c]) for c in columns}
    return filled.withColumns(rest).select(*df.columns)


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Exact medians of several columns in one pass over the unpivoted cells."""
    known = exact_medians(df, columns).select(F.struct(*[quoted(c) for c in columns])).scalar()
    return {c: known[c] for c in columns}


def fill_row_then_median(df: DataFrame, columns: list[str], total: str) -> DataFrame:
    """Null cells take the row's total, then the median of the column filled that way."""
    filled = df.withColumns({c: F.coalesce(quoted(c), quoted(total)) for c in columns})
    medians = column_medians(filled, [total, *columns])
    return filled.withColumns({c: F.coalesce(quoted(c), m) for c, m in medians.items()})
