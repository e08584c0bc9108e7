"""Tolerant parsing of numbers, flags, keys and categories.

Nothing here can fail on bad input under ANSI mode: text that does not look like a
number turns into null, and so does NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentlens.functions import text as tx

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
GROUPED_GERMAN = r"^[+-]?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]*)?$"

# Words read as yes and as no.
YES_WORDS = ["true", "ja", "yes", "y", "t", "1"]
NO_WORDS = ["false", "nein", "no", "n", "f", "0"]
FLAG_WORDS = ["1", "true", "yes", "ja"]

# Heating types kept as they are.
MAIN_HEATING = ["central_heating", "district_heating", "gas_heating"]

# Federal states and their two-digit codes.
STATES = [
    ("01", "Schleswig-Holstein"),
    ("02", "Hamburg"),
    ("03", "Niedersachsen"),
    ("04", "Bremen"),
    ("05", "Nordrhein-Westfalen"),
    ("06", "Hessen"),
    ("07", "Rheinland-Pfalz"),
    ("08", "Baden-Württemberg"),
    ("09", "Bayern"),
    ("10", "Saarland"),
    ("11", "Berlin"),
    ("12", "Brandenburg"),
    ("13", "Mecklenburg-Vorpommern"),
    ("14", "Sachsen"),
    ("15", "Sachsen-Anhalt"),
    ("16", "Thüringen"),
]


def to_num(c: Column) -> Column:
    s = tx.strip(c.cast("string"))
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_num_comma(c: Column) -> Column:
    return to_num(F.translate(c.cast("string"), ",", "."))


def to_float_de(c: Column) -> Column:
    """German money text: units off, thousands points out, decimal comma to point."""
    s = tx.strip(tx.swap(tx.swap(c, "€/m²", ""), "€", ""))
    plain = F.when(s.rlike(GROUPED_GERMAN), F.translate(s, ".", "")).otherwise(s)
    return to_num(F.translate(plain, ",", "."))


def zensus_to_float(c: Column) -> Column:
    """Census cell: units, notes in parentheses and the footnote letter e removed."""
    s = c
    for unit in ("€/m²", "€ / m²", "€"):
        s = tx.swap(s, unit, "")
    s = F.regexp_replace(s, r"\(.*?\)", "")
    return to_num(F.translate(F.translate(s, "e", ""), ",", "."))


def strip_to_number(c: Column) -> Column:
    digits = F.regexp_replace(c.cast("string"), r"[^0-9,.\-]", "")
    return to_num(F.translate(digits, ",", "."))


def to_bool01(c: Column) -> Column:
    s = F.lower(tx.strip(c.cast("string")))
    return F.when(s.isin(YES_WORDS), 1).when(s.isin(NO_WORDS), 0)


def flag01(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin(FLAG_WORDS).cast("int"), F.lit(0))


def trimmed_flag01(c: Column) -> Column:
    return flag01(tx.strip(c.cast("string")))


def flag_int(c: Column) -> Column:
    return F.coalesce(to_num(c).try_cast("int"), F.lit(0))


def first_digits(c: Column, n: int) -> Column:
    """First ``n`` digits standing next to each other, or null."""
    found = F.regexp_extract(c.cast("string"), "([0-9]{%d})" % n, 1)
    return F.nullif(found, F.lit(""))


def plz5(c: Column) -> Column:
    return first_digits(c, 5)


def digits_only(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c.cast("string"), "[^0-9]", ""), F.lit(""))


def zero_pad(c: Column, n: int) -> Column:
    """Left-pad with zeros; longer text stays as it is (``lpad`` alone would cut it)."""
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def pad_key(c: Column, n: int) -> Column:
    return zero_pad(digits_only(c), n)


def key_prefix(c: Column, n: int) -> Column:
    """State (2) or district (5) part of a key; null when the key is shorter."""
    return F.when(F.length(c) >= n, F.substring(c, 1, n))


def state_code(c: Column) -> Column:
    """Federal state name to code; the spelling with folded umlauts counts as well."""
    s = F.lower(tx.collapse(c))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in STATES:
        spellings = {name.lower(), _plain(name.lower())}
        out = out.when(s.isin(sorted(spellings)), code)
    return out


def state_name(code: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for number, name in STATES:
        out = out.when(code == number, name)
    return out


def _plain(name: str) -> str:
    for letter, plain in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        name = name.replace(letter, plain)
    return name


def tidy_category(c: Column) -> Column:
    s = F.lower(tx.strip(c.cast("string")))
    s = F.regexp_replace(s, r"(?U)\s+", " ")
    return F.coalesce(F.translate(s, "/;", ",,"), F.lit("unknown"))


def heating_clean(c: Column) -> Column:
    return F.when(c.isin(MAIN_HEATING), c).otherwise("other")


def lower_condition(c: Column, missing: str | None = None) -> Column:
    """Lower case; empty and null become ``missing`` (null to train, '' to score)."""
    return F.coalesce(F.nullif(F.lower(c), F.lit("")), F.lit(missing).cast("string"))


def cold_from_warm(cold: Column, warm: Column, service: Column) -> Column:
    return F.coalesce(to_num(cold), to_num(warm) - to_num(service))


def format_date_de(c: Column) -> Column:
    return F.date_format(c, "dd.MM.yyyy")


def _cents(c: Column) -> tuple[Column, Column]:
    """Whole units and cents of ``abs(c)``, rounded by the exact binary value, ties to even.

    The part behind the point becomes an integer count of 2**-56, so the comparison with
    half a cent is exact where a product in floating point would not be.
    """
    size = F.abs(c)
    whole = F.floor(size)
    scaled = ((size - whole) * F.lit(float(1 << 56))).cast("long") * 100
    cents = F.shiftright(scaled, 56)
    rest = scaled - F.shiftleft(cents, 56)
    half = F.lit(1 << 55)
    up = (rest > half) | ((rest == half) & (cents % 2 == 1))
    rounded = cents + up.cast("long")
    return whole + F.when(rounded == 100, 1).otherwise(0), rounded % 100


def round_cents(c: Column) -> Column:
    whole, cents = _cents(c)
    return F.signum(c) * (whole * 100 + cents) / 100.0


def format_amount(c: Column) -> Column:
    whole, cents = _cents(c)
    sign = F.when(c < 0, "-").otherwise("")
    digits = F.lpad(cents.cast("string"), 2, "0")
    return F.concat(sign, whole.cast("string"), F.lit("."), digits)


def address_label(street: Column, zip_code: Column, city: Column) -> Column:
    return F.concat(street, F.lit(", "), zip_code, F.lit(" "), city)


def person_label(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)
