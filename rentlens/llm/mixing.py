"""Mixing sources to token targets by entropy balancing.

Rates that stay as close as possible to one copy of each document, in relative entropy
weighted by size, and meet the token targets of the sources are exponential tilts
``exp(multiplier of the source)``. The multipliers minimise a convex dual; each document
belongs to one source, so the Hessian is diagonal and Newton steps run for all sources at
once, as rows of a distributed table. Rates become whole copies by a threshold on a hash
of the document, placed so that the words taken from the source come nearest its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import WORD, join_small, numbered_equal, shielded, staged

#: A source takes at most so many times its size, and so does a document.
MOST = 3
WEIGHTS = (1, 2, 3)

NEWTON_STEPS = 80

#: The threshold is searched digit by digit: bits of a digit, digits, bits of the draw.
DIGIT_BITS, DIGITS, DRAW_BITS = 10, 3, 48



def words(text: Column) -> Column:
    """Number of words between ASCII blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def group_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def draw(key: Column, text: Column) -> Column:
    """48 bits that depend on the document alone, so that reruns agree."""
    whole = F.concat(
        F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))
    )
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("long")


def ranked(groups: DataFrame) -> DataFrame:
    """Adds ``__rank`` from 0 in the order of ``__group``, without one task for all.

    Groups are range-partitioned; each partition numbers its own rows and adds the rows of
    the partitions before it.
    """
    parts = staged(
        groups.repartitionByRange("__group").withColumn("__part", F.spark_partition_id())
    )
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = (
        parts.groupBy("__part").count().select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    )
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__group"))
    return (
        parts.withColumn("__own", own)
        .join(F.broadcast(offsets), "__part")
        .withColumn("__rank", F.col("__own") - 1 + F.col("__before"))
        .drop("__own", "__before", "__part")
    )


def targets(groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Shares all tokens out by weight; a share stops at ``most`` times its source.

    ``groups`` has ``__group`` and ``source_size``. The excess is reshared by weight: one
    aggregate a round, until no share is above its bound.
    """
    by_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    weighted = staged(ranked(groups).withColumn("weight", by_rank))
    bound = F.col("source_size") * most
    level, capped = None, -1
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > bound
        row = weighted.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(above, bound).otherwise(0)).alias("stopped"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(above).alias("n"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped = row["n"]
        level = (row["total"] - row["stopped"]) / row["open"]
    share = F.col("weight") * F.lit(level or 0.0)
    return weighted.withColumn(
        "target", F.when(share > bound, bound.cast("double")).otherwise(share)
    )


def multiplier(size: Column, target: Column) -> Column:
    """Newton steps on the dual ``size * exp(x) - target * x`` of one source, damped to 1."""

    def step(x: Column, _: Column) -> Column:
        newton = target / (size * F.exp(x)) - 1
        return x + F.least(F.greatest(newton, F.lit(-1.0)), F.lit(1.0))

    return F.when(
        (size > 0) & (target > 0),
        F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step),
    )


def cuts(units: DataFrame, groups: DataFrame) -> DataFrame:
    """``__group, cut, tie, ties``: units with a draw up to ``cut`` get one more copy, and of
    those with the draw ``tie`` the first ``ties``.

    ``units`` has ``__group, size, __draw``; ``groups`` has ``__group, quota``. Units are
    taken in the order of their draws while that brings the tokens nearer the quota. The
    place is found digit by digit from sums by digit, so no task sees a whole group; only
    the draws that share all digits of the cut are ordered. Equal units have equal draws and
    sizes: they are counted, and the cut may fall among them.
    """
    state = groups.select("__group", "quota", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("done"))
    state = staged(state)
    rest = DRAW_BITS
    for _ in range(DIGITS):
        rest -= DIGIT_BITS
        digit = F.shiftright("__draw", rest)
        inside = join_small(units, state, ["__group"], "inner").where(
            F.shiftright("__draw", rest + DIGIT_BITS) == F.shiftright("low", rest + DIGIT_BITS)
        )
        sums = inside.groupBy("__group", "quota", "done", digit.alias("digit")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(
            Window.partitionBy("__group").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        )
        placed = sums.withColumn("upto", F.col("done") + running)
        # The first digit whose units pass the quota holds the cut.
        first = F.min(
            F.when(F.col("upto") > F.col("quota"), F.struct("digit", (F.col("upto") - F.col("size")).alias("done")))
        )
        found = placed.groupBy("__group", "quota").agg(first.alias("cut"))
        # No digit passes it: every unit is taken, and the search goes on beyond all draws.
        beyond = F.lit((1 << DRAW_BITS) - 1).cast("long")
        state = staged(
            found.select(
                "__group",
                "quota",
                F.coalesce(F.shiftleft(F.col("cut.digit"), rest), beyond).alias("low"),
                F.coalesce(F.col("cut.done"), F.lit(0)).cast("long").alias("done"),
                F.col("cut").isNull().alias("all"),
            ).where("not all").drop("all")
        )
    inside = join_small(units, state, ["__group"], "inner").where(
        F.shiftright("__draw", rest) == F.shiftright("low", rest)
    )
    equal = inside.groupBy("__group", "quota", "low", "done", "__draw").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    running = F.sum("size").over(
        Window.partitionBy("__group").orderBy("__draw").rowsBetween(Window.unboundedPreceding, 0)
    )
    before = F.col("done") + running - F.col("size")
    # A unit is taken while its middle is not past the quota.
    each = F.col("size") / F.col("n")
    fits = F.floor((F.col("quota") - before) / each + 0.5)
    take = F.when(F.col("size") == 0, F.when(before <= F.col("quota"), F.col("n")).otherwise(0)).otherwise(
        F.least(F.greatest(fits, F.lit(0)), F.col("n"))
    )
    taken = equal.withColumn("take", take.cast("long"))
    whole = F.max(F.when(F.col("take") == F.col("n"), F.col("__draw")))
    part = F.max(F.when((F.col("take") > 0) & (F.col("take") < F.col("n")), F.struct("__draw", "take")))
    cut = taken.groupBy("__group", "low").agg(whole.alias("whole"), part.alias("part"))
    return staged(
        cut.select(
            "__group",
            F.coalesce("whole", F.col("low") - 1).alias("cut"),
            F.col("part.__draw").alias("tie"),
            F.col("part.take").alias("ties"),
        )
    )


def balance(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """Adds size, source_size, target, rate, copies and taken to every document.

    Null text has size 0; null sources form one group, last in the order; repeated rows
    draw alike, and where the cut falls among them, as many of them as fit the target get one
    more copy; columns named like the added ones are replaced; an empty table gives an empty
    result.
    """
    return shielded(
        docs, [key, text, source], lambda plain: _balanced(plain, key, text, source, weights, most)
    )


def _balanced(
    docs: DataFrame, key: str, text: str, source: str, weights: tuple[int, ...], most: int
) -> DataFrame:
    sized = docs.select(
        "*",
        words(F.col(text)).alias("size"),
        group_key(F.col(source)).alias("__group"),
        draw(F.col(key), F.col(text)).alias("__draw"),
    )
    units = staged(sized.select("__group", "size", "__draw"))
    sizes = units.groupBy("__group").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, most)
    rate = F.coalesce(F.round(F.exp(multiplier(F.col("source_size"), F.col("target"))), 9), F.lit(0.0))
    plan = staged(
        goal.withColumn("rate", rate)
        .withColumn("base", F.floor("rate"))
        .withColumn("quota", F.col("target") - F.col("base") * F.col("source_size"))
    )
    found = staged(
        plan.join(cuts(units, plan), "__group", "left").select(
            "__group", "source_size", "target", "rate", "base", "tie", "ties",
            # Without a cut the quota is not passed: every document gets one more.
            F.coalesce("cut", F.lit((1 << DRAW_BITS) - 1).cast("long")).alias("cut"),
        )
    )
    joined = join_small(sized, found, ["__group"], "inner")
    tied = F.coalesce(F.col("__draw") == F.col("tie"), F.lit(False))
    more = (F.col("__draw") <= F.col("cut")).cast("long")
    apart = joined.where(~tied).withColumn("copies", F.col("base") + more)
    both = apart
    if not found.where("tie is not null").isEmpty():
        counted = numbered_equal(joined.where(tied), ["__group"])
        both = apart.unionByName(
            counted.withColumn("copies", F.col("base") + (F.col("__number") < F.col("ties")).cast("long")).drop("__number")
        )
    return (
        both.withColumn("copies", F.least(F.col("copies"), F.lit(most).cast("long")))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*docs.columns, "size", "source_size", "target", "rate", "copies", "taken")
    )
