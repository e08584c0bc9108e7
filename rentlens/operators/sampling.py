"""Repeatable samples, splits and first-rows selections.

Order comes from a hash of a key column, never from partitioning, so a rerun after a
lost executor gives the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

PREFIX = 5  # hex digits: at most 16**5 buckets

#: Rows drawn to bracket a place in an order, and rows that one task puts in order.
SAMPLE_ROWS, RANGE_ROWS = 20_000, 100_000


def key_hash(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def seeded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows by hash order; everything when ``n`` is 0 or not below the row count.

    Rows are counted per hash prefix first. Whole prefixes below the one in which the
    ``n``-th row falls are kept as they are, and only that one's rows are ranked, so no task
    sees the sample whatever ``n`` is.
    """
    if not n:
        return df
    hashed = df.withColumn("__hash", key_hash(key)).withColumn(
        "__prefix", F.substring("__hash", 1, PREFIX)
    )
    buckets = hashed.groupBy("__prefix").agg(F.count(F.lit(1)).alias("__n"))
    running = F.sum("__n").over(
        Window.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0)
    )
    enough = buckets.withColumn("__upto", running).where(F.col("__upto") >= n)
    before = (F.col("__upto") - F.col("__n")).alias("before")
    edge = enough.agg(F.min(F.struct(F.col("__prefix").alias("prefix"), before)).alias("edge"))
    last = F.coalesce(edge.select("edge.prefix").scalar(), F.lit("g"))
    taken = F.coalesce(edge.select("edge.before").scalar(), F.lit(0))
    whole = hashed.where(F.col("__prefix") < last)
    rank = F.row_number().over(Window.partitionBy("__prefix").orderBy("__hash", key))
    part = hashed.where(F.col("__prefix") == last).withColumn("__rank", rank)
    part = part.where(F.col("__rank") <= F.lit(n) - taken).drop("__rank")
    return whole.unionByName(part).drop("__hash", "__prefix")


def split(df: DataFrame, key: str, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by the hash of the key: disjoint, complete, repeatable."""
    test = is_test(key, test_share)
    return df.where(~test), df.where(test)


def is_test(key: str, test_share: float) -> Column:
    bound = f"{int(test_share * 16**8):08x}"
    return F.substring(key_hash(key), 1, 8) < bound


def cap_rows(df: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """First ``n`` rows of a load in an explicit order; all rows when ``n`` is not set.

    A small sample brackets the ``n``-th row. Rows in front of the bracket are taken as they
    are, rows in it are bracketed again until few are left, and only those are put in order.
    Counts decide, never the sample: a bracket without the ``n``-th row is widened. The rows
    come in no order.
    """
    if not n:
        return df
    total = df.count()
    if total <= n:
        return df
    place, spark = F.struct(*order), df.sparkSession
    taken, rest, wide = [], df, 2.0
    while total > RANGE_ROWS:
        share = min(1.0, SAMPLE_ROWS / total)
        drawn = [r["at"] for r in rest.select(place.alias("at")).sample(share, seed=42).orderBy("at").collect()]
        middle, margin = len(drawn) * n / total, wide * max(1.0, len(drawn) ** 0.5)
        low, high = int(middle - margin), int(middle + margin) + 1
        ends = spark.createDataFrame(
            [(drawn[low] if low > 0 else None, drawn[high] if high < len(drawn) else None)],
            _optional(rest.select(place.alias("low"), place.alias("high")).schema),
        )
        held = ends.select(F.struct("low", "high")).scalar()
        below = F.coalesce(place < held["low"], F.lit(False))
        inside = ~below & F.coalesce(place < held["high"], F.lit(True))
        counts = rest.agg(F.count_if(below).alias("below"), F.count_if(inside).alias("inside")).first()
        if counts["inside"] == total:
            break  # The order does not tell more rows apart.
        if not counts["below"] <= n <= counts["below"] + counts["inside"]:
            wide *= 4
            continue
        if low > 0:
            taken.append(rest.where(below))
        rest, n, total, wide = rest.where(inside), n - counts["below"], counts["inside"], 2.0
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    first = rest.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")
    return reduce(DataFrame.unionByName, [*taken, first])


def _optional(schema: StructType) -> StructType:
    return StructType([StructField(f.name, f.dataType, True) for f in schema.fields])


def dedupe(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Distinct rows, or one row per ``subset``: the first one in ``order``."""
    if not subset:
        return df.distinct()
    rest = [c for c in df.columns if c not in subset]
    ordered = [*(order or []), *[c for c in rest if c not in (order or [])]]
    row = F.min(F.struct(*ordered)).alias("__row")
    return df.groupBy(*subset).agg(row).select(*subset, "__row.*").select(*df.columns)
