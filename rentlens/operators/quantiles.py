"""Exact quantiles by digits, without holding a group in one task.

The bits of a double, read as a number, sort like the double. Rows are counted by their
leading digit; the digit in which a wanted rank falls is known from a running sum over at
most ``2 ** DIGIT`` counts, and only rows with that digit are counted by the next one. All
groups, columns and quantiles move on together, one pass a digit, until the rows around
each rank are few or equal. The steps after the counts see a bounded number of rows a
group, whatever the data; distributions, ties and outliers only change how many of the four
digits are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.operators.columns import quoted
from rentlens.operators.frames import cut, keep
from rentlens.operators.joins import lookup_join

#: Bits of a digit; a digit has at most 65,536 values.
DIGIT = 16

#: Rows around a rank that are put in order one by one.
FEW = 1 << DIGIT

MANTISSA, LEAST_EXPONENT, MOST_EXPONENT = 52, -1022, 1023


def with_ordered_bits(df: DataFrame, value: str, out: str) -> DataFrame:
    """The 64 bits of a double as a long that sorts like it; both zeros are 0, null stays.

    Written as arithmetic, so that it stays in generated code: the exponent from a logarithm,
    set right by comparing with powers of two, and the mantissa by an exact division.
    """
    x = F.abs(F.col(value))
    unit = float(1 << MANTISSA)
    guess = F.floor(F.log2(F.when(x > 0, x)))
    bound = F.least(F.greatest(F.coalesce(guess, F.lit(LEAST_EXPONENT)), F.lit(LEAST_EXPONENT)), F.lit(MOST_EXPONENT))
    finite = x < float("inf")
    e = F.col("__e")
    down = (F.pow(F.lit(2.0), e) > x) & (e > LEAST_EXPONENT)
    up = F.pow(F.lit(2.0), e + 1) <= x
    exponent = F.when(down, e - 1).when(up & finite, e + 1).otherwise(e)
    mantissa = x / F.pow(F.lit(2.0), e) * unit
    bits = F.when(finite, (e - LEAST_EXPONENT) * (1 << MANTISSA) + mantissa.cast("long")).otherwise(
        F.lit(2047 << MANTISSA)
    )
    known = F.col(value).isNotNull()
    return (
        df.withColumn("__e", F.when(finite, bound).otherwise(0).cast("long"))
        .withColumn("__e", exponent)
        .withColumn(out, F.when(known, F.when(F.col(value) < 0, -bits).otherwise(bits)))
        .drop("__e")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
) -> DataFrame:
    """Per group: ``rows``, non-null ``n`` and one interpolated column per quantile.

    Runs one job per digit. NaN counts as null; a group without values has null quantiles.
    """
    by = by or []
    x = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    rows = keep(with_ordered_bits(df.select(*by, x.alias("__v")), "__v", "__bits"))
    state, shift, apart = narrowed(rows, list(probs.values()), by)
    if apart:
        state = cut(_step(remaining(rows, state, shift, by), "__v", state, by, 2 * len(probs)))
    cells = [_interpolate(i, p).alias(name) for i, (name, p) in enumerate(probs.items())]
    zero = F.lit(0).cast("long")
    return state.select(
        *by, F.coalesce("__rows", zero).alias("rows"), F.coalesce("__n", zero).alias("n"), *cells
    )


def exact_median(
    df: DataFrame, value: str, by: list[str] | None = None, name: str = "median"
) -> DataFrame:
    return exact_quantiles(df, value, {name: 0.5}, by)


def exact_medians(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """The medians of several columns, one row per group, from the unpivoted cells."""
    by = by or []
    cells = df.select(*by, *[quoted(c).cast("double").alias(c) for c in columns])
    long = cells.unpivot(by, [quoted(c) for c in columns], "__column", "__value")
    medians = exact_median(long, "__value", [*by, "__column"])
    return medians.groupBy(*by).agg(
        *[F.max(F.when(F.col("__column") == c, F.col("median"))).alias(c) for c in columns]
    )


def narrowed(
    rows: DataFrame, probs: list[float], by: list[str]
) -> tuple[DataFrame, int, bool]:
    """Groups with ``__rows``, ``__n`` and ``__at``, how many bits are still open, and
    whether any rank has different values around it.

    ``__at`` has, for the two ranks around each quantile, the leading bits of the rank's
    value (``prefix``), the rows below them (``before``) and with them (``n``), and the lowest
    and highest value of those. Digits are read until each rank has few rows or equal ones.
    """
    shift = 64 - DIGIT
    counted = rows.groupBy(*by, F.shiftright("__bits", shift).alias("__prefix")).agg(
        F.count(F.lit(1)).alias("__all"), *_counts()
    )
    group = Window.partitionBy(*by)
    counted = counted.withColumns(
        {"__rows": F.sum("__all").over(group), "__n": F.sum("__c").over(group)}
    )
    last = F.col("__n") - 1
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    ranks = [
        F.struct(rank.alias("rank"), none.alias("prefix"), zero.alias("before"))
        for p in probs
        for rank in (F.floor(p * last), F.ceil(p * last))
    ]
    counted = counted.withColumns({"__parent": none, "__at": F.array(*ranks)})
    state = cut(_step(counted, "__prefix", None, by, len(ranks)))
    while True:
        apart, crowded = _apart(state)
        if shift == 0 or not crowded:
            return state, shift, apart
        inside = _inside(rows, state, shift, by)
        shift -= DIGIT
        counted = inside.groupBy(
            *by, "__parent", F.shiftright("__bits", shift).alias("__prefix")
        ).agg(*_counts())
        state = cut(_step(_carried(counted, state, by), "__prefix", state, by, len(ranks)))


def remaining(rows: DataFrame, state: DataFrame, shift: int, by: list[str]) -> DataFrame:
    """Distinct values around each rank: at most ``FEW`` a rank."""
    inside = _inside(rows, state, shift, by)
    return _carried(inside.groupBy(*by, "__parent", "__v").agg(*_counts()), state, by)


def _counts() -> list[Column]:
    return [F.count("__v").alias("__c"), F.min("__v").alias("__low"), F.max("__v").alias("__high")]


def _carried(counted: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Counts with the state of their group, joined after counting: an array that went
    through the aggregate would have every row sorted for it."""
    if by:
        return lookup_join(counted, state, by, "inner", null_safe=True)
    known = state.select(F.struct("__rows", "__n", "__at")).scalar()
    return counted.withColumn("__known", known).select(*counted.columns, "__known.*")


def _apart(state: DataFrame) -> tuple[bool, bool]:
    """Whether any rank has different values around it, and whether one has many such rows."""
    ranks = state.select(F.explode("__at").alias("a")).select("a.*")
    apart = F.col("low") < F.col("high")
    found = ranks.agg(F.bool_or(apart), F.bool_or(apart & (F.col("n") > FEW))).first()
    return bool(found[0]), bool(found[1])


def _inside(rows: DataFrame, state: DataFrame, shift: int, by: list[str]) -> DataFrame:
    """Rows whose leading bits are those of a wanted rank of their group."""
    prefixes = F.explode(F.array_distinct(F.transform("__at", lambda at: at["prefix"])))
    wanted = state.select(*by, prefixes.alias("__parent")).where(F.col("__parent").isNotNull())
    marked = rows.withColumn("__parent", F.shiftright("__bits", shift))
    return lookup_join(marked, wanted, [*by, "__parent"], "left_semi", null_safe=True)


def _step(
    counted: DataFrame, order: str, state: DataFrame | None, by: list[str], ranks: int
) -> DataFrame:
    """The state one digit on: each rank with the count that holds it.

    ``counted`` has one row per group, parent and ``order``. Groups without a value are not
    in it, as no row has their prefix; they stay as they were.
    """
    within = Window.partitionBy(*by, "__parent").orderBy(order)
    upto = F.sum("__c").over(within.rowsBetween(Window.unboundedPreceding, 0))
    running = counted.withColumn("__upto", upto)
    prefix = F.col("__prefix") if "__prefix" in counted.columns else F.col("__parent")
    picks = []
    for i in range(ranks):
        at = F.get("__at", F.lit(i))
        reached = at["before"] + F.col("__upto")
        holds = (reached > at["rank"]) & (reached - F.col("__c") <= at["rank"])
        found = F.struct(
            at["rank"].alias("rank"),
            prefix.alias("prefix"),
            (reached - F.col("__c")).alias("before"),
            F.col("__c").alias("n"),
            F.col("__low").alias("low"),
            F.col("__high").alias("high"),
        )
        picks.append(F.max(F.when(holds & at["prefix"].eqNullSafe(F.col("__parent")), found)))
    moved = running.groupBy(*by).agg(
        F.any_value("__rows").alias("__rows"),
        F.any_value("__n").alias("__n"),
        F.array(*picks).alias("__at"),
    )
    return moved if state is None else moved.unionByName(state.where(F.col("__n") == 0))


def _interpolate(i: int, p: float) -> Column:
    low, high = (F.get("__at", F.lit(j))["low"] for j in (2 * i, 2 * i + 1))
    pos = F.lit(p) * (F.col("__n") - 1)
    return low + (high - low) * (pos - F.floor(pos))
