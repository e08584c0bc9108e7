"""How quality filters interact: every order of five filters, from one pass over the texts.

A document counts only through its failures: five bits, with its part and two label flags.
Documents collapse to these cells, at most 128 a part, and no text is read again. Each cell
then folds across the constant array of all 120 orders (``transform`` over orders,
``aggregate`` along an order) to 600 structs weighted by its documents, and the structs of
a part's cells are merged by elementwise sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import UPPER, WORD, join_small, staged

#: Filters by letter, in the order of their bits. E needs the whole table.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_UPPER_PCT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> Column:
    """Bits of the filters that need the text alone; ``text`` is not null."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    # An array of one element binds the words once for both counts.
    by_words = F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) < LEAST_WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT_PCT * F.size(w), 2).otherwise(0),
    )[0]
    return (
        by_words
        + F.when(100 * upper > MOST_UPPER_PCT * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0)
    )


def cells(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """``part, mask, good, toxic, n``: documents by failures and labels.

    Copies meet by a digest of the whole text. Only the smallest key of a text passes E, so
    rows are matched with (digest, smallest key), which no large group of copies makes hot;
    and before labels are joined, the rows of a key are counted by mask.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    facts = staged(
        docs.select(
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.col(key).alias("id"),
            F.unhex(F.sha2(whole, 256)).alias("digest"),
            text_failures(whole).alias("mask"),
        )
        .groupBy("part", "id", "digest", "mask")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    firsts = facts.groupBy("digest").agg(F.min("id").alias("id")).where("id is not null")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    marked = (
        facts.join(firsts.withColumn("first", F.lit(True)), ["digest", "id"], "left")
        .withColumn("mask", F.col("mask") + F.when(copy, 16).otherwise(0))
        .groupBy("part", "id", "mask")
        .agg(F.sum("n").alias("n"))
    )
    known = staged(
        labels.groupBy(F.col(key).alias("id"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
        .where("id is not null and (good or toxic)")
    )
    flagged = join_small(marked, known, ["id"]).fillna(False, ["good", "toxic"])
    return flagged.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def _weighted(cell: Column, orders: Column) -> Column:
    """600 structs of one cell: what each step of each order does to its documents."""
    n = cell["n"]

    def when(condition: Column) -> Column:
        return F.when(condition, n).otherwise(F.lit(0).cast("long"))

    def step(state: Column, at: Column) -> Column:
        fails = F.getbit(cell["mask"].cast("long"), at) == 1
        here = state["alive"] & fails
        counted = F.struct(
            when(state["alive"] & ~fails).alias("kept"),
            when(here).alias("removed"),
            when(~state["alive"] & fails).alias("redundant"),
            when(fails & (F.bit_count(cell["mask"]) == 1)).alias("unique_fails"),
            when(here & cell["good"]).alias("good_lost"),
            when(here & cell["toxic"]).alias("toxic_lost"),
        )
        return F.struct(
            (state["alive"] & ~fails).alias("alive"),
            F.concat(state["steps"], F.array(counted)).alias("steps"),
        )

    kind = ", ".join(f"{c}: bigint" for c in COUNTS)
    start = F.struct(
        F.lit(True).alias("alive"), F.array().cast(f"array<struct<{kind}>>").alias("steps")
    )
    return F.flatten(
        F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["steps"]))
    )


def fold(cells_: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step, from ``part, mask, good, toxic, n``.

    A part has at most ``4 * 2 ** len(letters)`` cells, so its list is bounded.
    """
    numbers = list(permutations(range(len(letters))))
    orders = F.array(*[F.array(*[F.lit(i) for i in order]) for order in numbers])
    names = F.array(*[F.lit("".join(letters[i] for i in order)) for order in numbers])
    size = len(numbers) * len(letters)
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])

    def add(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])

    merged = F.aggregate(
        "cells",
        F.array_repeat(zero, size),
        lambda sums, cell: F.zip_with(sums, _weighted(cell, orders), add),
    )
    by_part = (
        cells_.groupBy("part")
        .agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
        .select("part", merged.alias("sums"))
    )
    which = F.flatten(orders)

    def removed_by(filter_: Column) -> Column:
        own = F.zip_with(
            "sums", which, lambda s, f: F.when(f == filter_, s["removed"]).otherwise(F.lit(0).cast("long"))
        )
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a + b)

    each = F.array(*[F.lit(i) for i in range(len(letters))])
    rows = by_part.select(
        "part", F.transform(each, removed_by).alias("shapley"), F.posexplode("sums").alias("at", "s")
    )
    order = (F.col("at") / len(letters)).cast("int") + 1
    return rows.select(
        "part",
        F.element_at(names, order).alias("filter_order"),
        (F.col("at") % len(letters) + 1).cast("int").alias("step"),
        "s.*",
        F.col("shapley")[F.get(which, F.col("at"))].alias("shapley"),
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """``part, filter_order, step``, the counts of ``COUNTS`` and ``shapley``.

    Null texts are empty and null parts the empty string. Rows repeated in key and text are
    counted each, and none is a copy of the other. A row without a key is neither a copy nor
    the first of copies, and has no label; several label rows of a key count as one that
    holds where any of them does. Other columns of either table do not matter; without
    documents there are no parts and no rows.
    """
    return fold(cells(docs, labels, key=key, text=text, part=part))
