"""Place-name normalisers.

Twelve cleaning rules are in use, each feeding its own key map, so each keeps its own
result. ``normalize_place(col, variant)`` picks one by name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlens.functions import text as tx

# The affixes each rule removes.
STATE_TOWN_WORDS = [
    "hansestadt", "landeshauptstadt", "kreisfreie stadt", "amtsfreie stadt",
    "gemeinde", "stadt", "markt",
]
FOUR_WORDS = ["stadt", "hansestadt", "kreis", "landeshauptstadt"]
SUBSTRINGS_ANYWHERE = [
    "landeshauptstadt", "kreisfreie stadt", "kreisstadt", "stadt", "gemeinde", "amt ",
]
CUT_PATTERNS = [
    r",\s*stadt", r",\s*kreis.*", r"\(dith\.\)", r"\(.*?\)", r"\s+landeshauptstadt",
    r"\s+kreis.*", r"\s+kreisfreie stadt", r"\s+hanse.*", r"\s+am see", r"\s+an der .*",
]
BLANKED_SUBSTRINGS = [
    " stadt", " landeshauptstadt", "kreisfreie stadt", "gemeinde", "amt", "stadtteil", "bezirk",
]
NINE_WORDS = [
    "stadt", "kreis", "hansestadt", "landeshauptstadt", "amtsfreie stadt", "amt ",
    "verbandsgemeinde", "verband", "gemeinde",
]
TRAILING_WORDS = [
    "große kreisstadt", "kreisfreie stadt", "landeshauptstadt", "universitätsstadt",
    "hansestadt", "kreisstadt", "stadt", "kreis", "gemeinde",
]


def _present(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _bare(c: Column) -> Column:
    """Lower case, sharp s folded, hyphens to blanks, brackets and points out."""
    s = tx.strip(F.lower(c))
    return tx.drop_chars(F.translate(tx.swap(s, "ß", "ss"), "-", " "), "().,")


def dashboard(c: Column) -> Column:
    s = tx.swap(tx.swap(_bare(_present(c)), " hansestadt", ""), " stadt", "")
    return tx.strip(F.regexp_replace(s, " {2,}", " "))


def sandbox(c: Column) -> Column:
    s = tx.swap(_bare(c), "  ", " ")
    for affix in (" kreisfreie stadt", " hansestadt", " stadt", " kreis"):
        s = tx.swap(s, affix, "")
    return tx.strip(tx.swap(s, " amt ", " "))


def census_name(c: Column) -> Column:
    s = tx.fold_umlaut(F.lower(_present(c)))
    s = tx.before(F.regexp_replace(s, r"\(.*?\)", ""), ",")
    return tx.collapse(tx.drop_words(F.translate(s, "-", " "), STATE_TOWN_WORDS))


def census_name_wide(c: Column) -> Column:
    s = tx.fold_umlaut(F.lower(_present(c)))
    s = F.translate(F.regexp_replace(s, r"\(.*?\)", ""), ",-", "  ")
    s = tx.drop_words(s, STATE_TOWN_WORDS)
    s = F.regexp_replace(s, r"(?U)\bst\.\s*", "sankt ")
    s = F.regexp_replace(s, r"(?U)\ba\.? d\b\.?", "an der")
    s = F.regexp_replace(s, r"(?U)\sam\b", " ")
    return tx.collapse(F.regexp_replace(s, r"(?U)\san der\b", " "))


def separators(c: Column) -> Column:
    s = F.regexp_replace(tx.strip(F.lower(_present(c))), r"(?U)\s*\([^)]*\)", "")
    s = F.regexp_replace(tx.fold_umlaut(s), r"[,.;:/\-]+", " ")
    return tx.collapse(tx.drop_words(s, FOUR_WORDS))


def substrings(c: Column) -> Column:
    s = tx.drop_chars(F.translate(tx.swap(F.lower(_present(c)), "ß", "ss"), "-", " "), "().,")
    for part in SUBSTRINGS_ANYWHERE:
        s = tx.swap(s, part, "")
    return tx.collapse(s)


def cut_suffixes(c: Column) -> Column:
    s = tx.strip(F.lower(_present(c)))
    for pattern in CUT_PATTERNS:
        s = F.regexp_replace(s, "(?U)" + pattern, "")
    s = tx.drop_chars(F.translate(tx.fold_umlaut(s), "-/", "  "), ".!?;:'\"")
    return tx.collapse(s)


def letters_only(c: Column) -> Column:
    s = F.regexp_replace(F.lower(_present(c)), r"\([^)]*\)", " ")
    s = F.translate(s, ",", " ")
    for part in BLANKED_SUBSTRINGS:
        s = tx.swap(s, part, " ")
    return tx.collapse(F.regexp_replace(s, "[^a-zäöüß0-9 ]+", " "))


def nine_words(c: Column) -> Column:
    s = F.translate(tx.drop_chars(F.lower(_present(c)), "().,"), "-", " ")
    return tx.collapse(tx.drop_words(s, NINE_WORDS))


def unique_census(c: Column) -> Column:
    s = F.translate(tx.swap(c, "ß", "ss"), "(),.", "    ")
    return tx.collapse(tx.drop_words(F.lower(tx.collapse(s)), FOUR_WORDS))


def trailing_words(c: Column) -> Column:
    s = tx.strip(tx.before(tx.strip(F.lower(_present(c))), ","))
    s = tx.collapse(F.regexp_replace(s, r"(?U)\s*\(.*?\)\s*", " "))
    for word in TRAILING_WORDS:
        s = tx.strip(F.regexp_replace(s, rf"(?U)\b{word}$", ""))
    return s


def city_simple(c: Column) -> Column:
    return F.lower(tx.strip(tx.before(c, ",")))


def city_display(c: Column) -> Column:
    return tx.strip(tx.before(tx.strip(tx.before(c, ",")), "("))


def norm_name(c: Column) -> Column:
    s = F.regexp_replace(F.lower(_present(c)), "[^a-zäöüß0-9 ]+", " ")
    return tx.collapse(s)


VARIANTS: dict[str, Callable[[Column], Column]] = {
    "dashboard": dashboard,
    "sandbox": sandbox,
    "census_name": census_name,
    "census_name_wide": census_name_wide,
    "separators": separators,
    "substrings": substrings,
    "cut_suffixes": cut_suffixes,
    "letters_only": letters_only,
    "nine_words": nine_words,
    "unique_census": unique_census,
    "trailing_words": trailing_words,
    "city_simple": city_simple,
    "city_display": city_display,
    "norm_name": norm_name,
}


def normalize_place(c: Column, variant: str) -> Column:
    return VARIANTS[variant](c)
