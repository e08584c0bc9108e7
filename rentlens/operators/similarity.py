"""String-similarity joins that never build all pairs.

Two texts whose insert/delete similarity reaches a bound differ in few single-character
edits. Above two thirds: cut one text into one segment more than that number of edits; at
least one segment survives unchanged in the other text, near its old place (the pigeonhole
filter of the published Pass-Join method). At any lower bound no longer piece need survive,
but single characters do: both texts share as many numbered characters (the second ``e`` is
one of its own) as their longest common subsequence has, so the rarest few of each side must
have one in common (prefix filter), within bands of length, and enough characters must have a
partner near their place. Only the candidates of either join are scored, in Arrow batches.
"""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rentlens.operators.joins import BROADCAST_LIMIT, lookup_join

EPS = 1e-9

#: Above this ratio a piece of two characters or more survives the edits.
SEGMENT_RATIO = 2 / 3


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hits = row & places.get(ch, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def indel_score(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0:
        return 100.0
    distance = total - 2 * common_subsequence(a, b)
    return 100.0 * (1.0 - distance / total)


@F.pandas_udf(DoubleType())
def indel_score_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_score(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def match_ratio_udf(choice: pd.Series, wanted: pd.Series) -> pd.Series:
    scores = [
        difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(choice, wanted)
    ]
    return pd.Series(scores, dtype="float64")


def sorted_tokens(c: Column) -> Column:
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def _segment_count(length: Column, ratio: float) -> Column:
    edits = F.floor(length * ((1 - ratio) * 2 / ratio) + EPS)
    return (edits + 1).cast("int")


def _segment_start(i: Column, length: Column, count: Column) -> Column:
    return F.floor(i * length / count).cast("int")


def _steps(first: Column, last: Column) -> Column:
    """Whole numbers from first to last; no numbers when last lies below first."""
    empty = F.array().cast("array<int>")
    return F.when(first <= last, F.sequence(first, last)).otherwise(empty)


def _own_segments(c: Column, ratio: float) -> Column:
    length = F.length(c)
    count = _segment_count(length, ratio)

    def cut(i: Column) -> Column:
        start = _segment_start(i, length, count)
        end = _segment_start(i + 1, length, count)
        return F.struct(
            length.alias("length"), i.alias("i"), F.substr(c, start + 1, end - start).alias("piece")
        )

    return F.transform(_steps(F.lit(0), count - 1), cut)


def _wanted_segments(c: Column, ratio: float) -> Column:
    """Every piece of ``c`` that could be a segment of a similar text."""
    own = F.length(c)
    shortest = F.ceil(own * (ratio / (2 - ratio)) - EPS).cast("int")
    longest = F.floor(own * ((2 - ratio) / ratio) + EPS).cast("int")

    def per_length(length: Column) -> Column:
        count = _segment_count(length, ratio)
        shift = F.floor((own + length) * (1 - ratio) + EPS).cast("int")

        def per_segment(i: Column) -> Column:
            start = _segment_start(i, length, count)
            size = _segment_start(i + 1, length, count) - start
            first = F.greatest(F.lit(0), start - shift)
            last = F.least(own - size, start + shift)
            return F.transform(
                _steps(first, last),
                lambda at: F.struct(
                    length.alias("length"), i.alias("i"), F.substr(c, at + 1, size).alias("piece")
                ),
            )

        return F.flatten(F.transform(_steps(F.lit(0), count - 1), per_segment))

    pieces = F.flatten(F.transform(_steps(F.greatest(shortest, F.lit(1)), longest), per_length))
    return F.array_distinct(pieces)


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    a: str,
    b: str,
    ratio: float,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Distinct (a, b) that can reach ``ratio``: a superset without false misses."""
    if ratio <= 0:
        raise ValueError("texts without a common character cannot be joined on one")
    own = left.select(a).distinct().where(F.length(a) > 0)
    others = right.select(b).distinct().where(F.length(b) > 0)
    meet = segment_pairs if ratio > SEGMENT_RATIO else character_pairs
    # Substitutions count once in the Levenshtein distance, so it never exceeds the bound.
    edits = F.floor((F.length(a) + F.length(b)) * (1 - ratio) + EPS).cast("int")
    near = meet(own, others, a, b, ratio, limit)
    return near.where(F.levenshtein(F.col(a), F.col(b)) <= edits)


def segment_pairs(
    left: DataFrame, right: DataFrame, a: str, b: str, ratio: float, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Pairs that share a segment near its place; for ratios above two thirds."""
    wanted = left.withColumn("__p", F.explode(_wanted_segments(F.col(a), ratio))).select(a, "__p.*")
    own = right.withColumn("__p", F.explode(_own_segments(F.col(b), ratio))).select(b, "__p.*")
    found = lookup_join(wanted, own, ["length", "i", "piece"], "inner", limit=limit)
    return found.select(a, b).distinct()


def _common(length: Column, other: Column, ratio: float) -> Column:
    """Least length of a common subsequence that reaches the ratio, at least one."""
    return F.greatest(F.ceil((length + other) * (ratio / 2) - EPS), F.lit(1))


def _numbered(c: Column) -> Column:
    """The characters of a text, each with its number among equal ones so far."""
    chars = F.split(c, "")
    return F.transform(
        chars,
        lambda x, i: F.concat(
            x, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda y: y == x)).cast("string")
        ),
    )


def _rarest_first(
    df: DataFrame, c: str, counts: DataFrame, shortest: Column, ratio: float, limit: int
) -> DataFrame:
    """The characters of each text that a partner of ``shortest`` length or more must share
    one of, with their places in the order of rarity."""
    length = F.length(c)
    each = df.select(c, length.alias("__l"), F.explode(_numbered(F.col(c))).alias("token"))
    known = lookup_join(each, counts, ["token"], limit=limit)
    order = Window.partitionBy(c).orderBy(F.coalesce("n", F.lit(0)), "token")
    placed = known.withColumn("place", F.row_number().over(order)).drop("n")
    return placed.where(F.col("place") <= F.col("__l") - _common(F.col("__l"), shortest, ratio) + 1)


def character_pairs(
    left: DataFrame, right: DataFrame, a: str, b: str, ratio: float, limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Pairs that share one of their rarest characters; for any ratio above zero.

    Lengths of a pair differ at most by the factor ``(2 - ratio) / ratio``, so texts meet in
    geometric bands of that width, the left one in its own and both next to it. The number
    of rarest characters follows from the lengths of each pair. What meets is kept if enough
    characters have an equal one near their place.
    """
    factor = (2 - ratio) / ratio
    tokens = right.select(F.explode(_numbered(F.col(b))).alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    width = math.log(factor) if factor > 1 else 1.0
    band = F.floor(F.log(F.col("__l").cast("double")) / width).cast("int")
    shortest = F.ceil(F.col("__l") / factor - EPS)
    asked = _rarest_first(left, a, counts, shortest, ratio, limit)
    asked = asked.withColumn("band", F.explode(F.array(band - 1, band, band + 1)))
    asked = asked.withColumnsRenamed({"__l": "__la", "place": "__pa"})
    offered = _rarest_first(right, b, counts, shortest, ratio, limit).withColumn("band", band)
    offered = offered.withColumnsRenamed({"__l": "__lb", "place": "__pb"})
    least = _common(F.col("__la"), F.col("__lb"), ratio)
    met = lookup_join(asked, offered, ["token", "band"], "inner", limit=limit).where(
        (least <= F.least("__la", "__lb"))
        & (F.col("__pa") <= F.col("__la") - least + 1)
        & (F.col("__pb") <= F.col("__lb") - least + 1)
    )
    pairs = met.select(a, b).distinct()
    common = _common(F.length(a), F.length(b), ratio)
    shared = F.size(F.array_intersect(_numbered(F.col(a)), _numbered(F.col(b))))
    return pairs.where((shared >= common) & (_near_places(F.col(a), F.col(b), common) >= common))


def _near_places(a: Column, b: Column, common: Column) -> Column:
    """Characters of ``a`` that have an equal one in ``b`` near their place.

    In front of a character of the common subsequence at most ``len(a) - common`` others of
    ``a`` and ``len(b) - common`` of ``b`` are left over, which bounds how far it moves.
    """
    n = F.length(a)

    def has_partner(i: Column) -> Column:
        first = F.greatest(i - (n - common), F.lit(0))
        window = F.substr(b, (first + 1).cast("int"), (i + F.length(b) - common - first + 1).cast("int"))
        return F.contains(window, F.substr(a, i + 1, F.lit(1)))

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), has_partner))


def close_match(
    wanted: DataFrame,
    choices: DataFrame,
    name: str,
    choice: str,
    cutoff: float = 0.87,
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Best choice per distinct wanted name; the greater string wins on equal scores."""
    pairs = near_pairs(wanted, choices, name, choice, cutoff, limit=limit)
    scored = pairs.withColumn("score", match_ratio_udf(F.col(choice), F.col(name)))
    best = F.max(F.struct("score", choice)).alias("best")
    return scored.where(F.col("score") >= cutoff).groupBy(name).agg(best).select(name, "best.*")
