"""Small text building blocks, all of them JVM-side column expressions.

Patterns that touch blanks or word edges carry ``(?U)`` so that umlauts count as
letters and no-break spaces as blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Every Unicode white-space character; trimming by list is far cheaper than a pattern.
BLANKS = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one blank; the ends are cut."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def drop_chars(c: Column, chars: str) -> Column:
    return F.translate(c, chars, "")


def drop_words(c: Column, words: list[str]) -> Column:
    """Delete whole words wherever they stand, longer phrases first."""
    ordered = sorted(words, key=len, reverse=True)
    return F.regexp_replace(c, r"(?U)\b(" + "|".join(ordered) + r")\b", "")


def before(c: Column, mark: str) -> Column:
    """Text in front of the first ``mark``; the whole text when there is none."""
    return F.substring_index(c, mark, 1)


def fold_umlaut(c: Column) -> Column:
    for letter, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = swap(c, letter, plain)
    return c


def tokens(c: Column) -> Column:
    """Distinct white-space separated words, in order of first appearance."""
    words = F.split(F.coalesce(c, F.lit("")), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)
