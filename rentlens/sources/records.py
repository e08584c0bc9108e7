"""Records of delimited text whose quoted cells may hold line feeds.

Whether a line begins inside a quoted cell depends on all lines before it. What a line does
to that state is a small function: it leaves a cell open or closed whatever came before
(constant), keeps the state, or turns it around. Such functions compose: the state after a
line is that of the last constant line before it, turned once for every turning line since.
So every split of a file is summed up as one function, the splits of a file are composed,
and each split then works on its own lines from the state it begins with.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.operators.joins import lookup_join

SPLIT = ["file", "block"]


def _closed_to_open(text: Column, sep: str) -> Column:
    """Whether a line that begins between cells leaves a quoted cell open.

    A quote counts where a cell begins; quotes inside other cells are letters.
    """
    mark = re.escape(sep)
    whole = rf'(^|{mark})"(?:[^"]|"")*"(?={mark}|$)'
    return F.regexp_replace(text, whole, "$1").rlike(rf'(^|{mark})"')


def _rest_after_close(text: Column, sep: str) -> Column:
    """What follows the end of an open cell, from its separator on; null where it stays open."""
    mark = re.escape(sep)
    found = F.regexp_extract(text, rf'^(?:[^"]|""|"(?!{mark}|$|"))*"((?:{mark}.*)?)$', 0)
    rest = F.regexp_extract(text, rf'^(?:[^"]|""|"(?!{mark}|$|"))*?"((?:{mark}.*)?)$', 1)
    return F.when(found != "", rest)


def with_effects(lines: DataFrame, sep: str) -> DataFrame:
    """Adds the state that each line leaves: ``__from_closed`` and ``__from_open``."""
    quoted = F.contains(F.col("value"), F.lit('"'))
    rest = _rest_after_close(F.col("value"), sep)
    return lines.withColumns(
        {
            "__from_closed": quoted & _closed_to_open(F.col("value"), sep),
            "__from_open": ~quoted | F.coalesce(_closed_to_open(rest, sep), F.lit(True)),
        }
    )


def _composed(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Running composition in ``order``: the last constant and the turns since then."""
    so_far = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    constant = F.col("__from_closed") == F.col("__from_open")
    turn = F.col("__from_closed") & ~F.col("__from_open")
    turned = df.withColumn("__turns", F.sum(turn.cast("long")).over(so_far))
    last = F.when(constant, F.struct(F.col("__from_closed").alias("open"), F.col("__turns").alias("turns")))
    return turned.withColumn("__last", F.last(last, ignorenulls=True).over(so_far))


def _after(start: Column) -> Column:
    """The state after a composition that began with ``start``."""
    odd = (F.col("__turns") - F.coalesce(F.col("__last.turns"), F.lit(0))) % 2 == 1
    return F.coalesce(F.col("__last.open"), start) != odd


def records(lines: DataFrame, sep: str) -> DataFrame:
    """``value, line, n_lines``: records in one row each, line feeds in cells kept as such.

    ``lines`` has ``value`` and ``line`` (file, block, row); a record has the line that it
    begins with. Without an open cell anywhere every line is a record as it is.
    """
    effects = with_effects(lines, sep)
    if not effects.agg(F.bool_or("__from_closed")).first()[0]:
        return lines.select("value", "line", F.lit(1).cast("long").alias("n_lines"))
    placed = effects.select("value", "line.*", "__from_closed", "__from_open")
    composed = _composed(placed, SPLIT, "row")
    order = Window.partitionBy(*SPLIT).orderBy("row")

    # One row per split: its function, and, composed along the file, the state it starts in.
    ends = composed.groupBy(*SPLIT).agg(F.max_by(F.struct("__turns", "__last"), "row").alias("end"))
    whole = ends.select(
        *SPLIT, F.col("end.__turns").alias("__turns"), F.col("end.__last").alias("__last")
    ).select(
        *SPLIT,
        _after(F.lit(False)).alias("__from_closed"),
        _after(F.lit(True)).alias("__from_open"),
    )
    along = Window.partitionBy("file").orderBy("block")
    files = _composed(whole, ["file"], "block").withColumn("__then", _after(F.lit(False)))
    starts = files.select(*SPLIT, F.coalesce(F.lag("__then").over(along), F.lit(False)).alias("__start"))

    joined = lookup_join(composed, starts, SPLIT)
    stated = joined.withColumn("__then", _after(F.col("__start")))
    inside = F.coalesce(F.lag("__then").over(order), F.col("__start"))
    begun = F.when(~inside, F.struct(*SPLIT, "row"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = stated.withColumns({"__inside": inside, "line": F.last(begun, ignorenulls=True).over(so_far)})

    # Lines at the head of a split may belong to a record that began in a split before it.
    lasts = marked.groupBy(*SPLIT).agg(F.max("line").alias("__own"))
    before = F.last("__own", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    heads = lasts.select(*SPLIT, before.alias("__before"))
    owned = lookup_join(marked, heads, SPLIT).withColumn("line", F.coalesce("line", "__before"))
    single = ~F.col("__inside") & ~F.col("__then")
    alone = owned.where(single).select("value", "line", F.lit(1).cast("long").alias("n_lines"))
    pieces = F.sort_array(F.collect_list(F.struct(*SPLIT, "row", "value")))
    together = (
        owned.where(~single)
        .groupBy("line")
        .agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"), F.count(F.lit(1)).alias("n_lines"))
    )
    return alone.unionByName(together)
