"""SQL text fragments for the checking engine.

They restate the cleaning rules in plain SQL, apart from the column expressions under
test. Patterns name the no-break space because the engine's ``\\s`` is ASCII-only.
"""

from __future__ import annotations

from rentlens.catalog.fixtures import NBSP

WS = rf"[\s{NBSP}]"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{new}', 'g')"


def rep(x: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def strip(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def collapse(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def drop(x: str, chars: str) -> str:
    return rep(x, *[(c, "") for c in chars])


def fold(x: str) -> str:
    return rep(x, ("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"))


def present(x: str) -> str:
    return f"coalesce({x}, '')"


def num(x: str) -> str:
    pattern = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    s = strip(x)
    return f"CASE WHEN regexp_full_match({s}, '{pattern}') THEN TRY_CAST({s} AS DOUBLE) END"


def num_comma(x: str) -> str:
    return num(f"replace({x}, ',', '.')")


def plz5(x: str) -> str:
    return f"nullif(regexp_extract({x}, '([0-9]{{5}})', 1), '')"


def digits(x: str) -> str:
    return f"nullif({sub(x, '[^0-9]', '')}, '')"


def pad(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) < {n} THEN lpad({x}, {n}, '0') ELSE {x} END"


def flag01(x: str) -> str:
    return f"CASE WHEN lower({x}) IN ('1', 'true', 'yes', 'ja') THEN 1 ELSE 0 END"


def bool01(x: str) -> str:
    s = f"lower({strip(x)})"
    return (
        f"CASE WHEN {s} IN ('true', 'ja', 'yes', 'y', 't', '1') THEN 1 "
        f"WHEN {s} IN ('false', 'nein', 'no', 'n', 'f', '0') THEN 0 END"
    )


def period(y: str) -> str:
    return (
        f"CASE WHEN trunc({y}) < 1919 THEN 'vor_1919' WHEN trunc({y}) <= 1949 THEN '1919_1949' "
        f"WHEN trunc({y}) <= 1959 THEN '1950_1959' WHEN trunc({y}) <= 1969 THEN '1960_1969' "
        f"WHEN trunc({y}) <= 1979 THEN '1970_1979' WHEN trunc({y}) <= 1989 THEN '1980_1989' "
        f"WHEN trunc({y}) <= 1999 THEN '1990_1999' WHEN trunc({y}) <= 2009 THEN '2000_2009' "
        f"WHEN trunc({y}) <= 2015 THEN '2010_2015' WHEN trunc({y}) > 2015 THEN '2016_plus' END"
    )


def state_code(x: str) -> str:
    """The sixteen names in alphabetical key order, umlauts folded or not."""
    names = [
        "schleswig-holstein", "hamburg", "niedersachsen", "bremen", "nordrhein-westfalen",
        "hessen", "rheinland-pfalz", "baden-wuerttemberg", "bayern", "saarland", "berlin",
        "brandenburg", "mecklenburg-vorpommern", "sachsen", "sachsen-anhalt", "thueringen",
    ]
    s = fold(f"lower({collapse(x)})")
    whens = " ".join(f"WHEN '{n}' THEN '{i + 1:02d}'" for i, n in enumerate(names))
    return f"CASE {s} {whens} END"


def _bare(x: str) -> str:
    return drop(rep(strip(f"lower({x})"), ("ß", "ss"), ("-", " ")), "().,")


def n1(x: str) -> str:
    s = rep(_bare(present(x)), (" hansestadt", ""), (" stadt", ""))
    return strip(sub(s, " {2,}", " "))


def n2(x: str) -> str:
    s = rep(
        _bare(x), ("  ", " "), (" kreisfreie stadt", ""), (" hansestadt", ""), (" stadt", ""),
        (" kreis", ""), (" amt ", " "),
    )
    return strip(s)


TOWN = "kreisfreie stadt|landeshauptstadt|amtsfreie stadt|hansestadt|gemeinde|stadt|markt"
FOUR = "landeshauptstadt|hansestadt|stadt|kreis"
NINE = (
    "landeshauptstadt|verbandsgemeinde|amtsfreie stadt|hansestadt|gemeinde|verband|stadt|kreis|amt "
)


def n3(x: str) -> str:
    s = f"split_part({sub(fold(f'lower({present(x)})'), r'\(.*?\)', '')}, ',', 1)"
    return collapse(sub(rep(s, ("-", " ")), rf"\b({TOWN})\b", ""))


def n4(x: str) -> str:
    s = rep(sub(fold(f"lower({present(x)})"), r"\(.*?\)", ""), (",", " "), ("-", " "))
    s = sub(s, rf"\b({TOWN})\b", "")
    s = sub(s, rf"\bst\.{WS}*", "sankt ")
    s = sub(s, r"\ba\.? d\b\.?", "an der")
    s = sub(s, rf"{WS}am\b", " ")
    return collapse(sub(s, rf"{WS}an der\b", " "))


def n5(x: str) -> str:
    s = sub(strip(f"lower({present(x)})"), rf"{WS}*\([^)]*\)", "")
    return collapse(sub(sub(fold(s), r"[,.;:/\-]+", " "), rf"\b({FOUR})\b", ""))


def n6(x: str) -> str:
    s = drop(rep(f"lower({present(x)})", ("ß", "ss"), ("-", " ")), "().,")
    s = rep(
        s, ("landeshauptstadt", ""), ("kreisfreie stadt", ""), ("kreisstadt", ""), ("stadt", ""),
        ("gemeinde", ""), ("amt ", ""),
    )
    return collapse(s)


def n7(x: str) -> str:
    s = strip(f"lower({present(x)})")
    for pattern in (
        rf",{WS}*stadt", rf",{WS}*kreis.*", r"\(dith\.\)", r"\(.*?\)", rf"{WS}+landeshauptstadt",
        rf"{WS}+kreis.*", rf"{WS}+kreisfreie stadt", rf"{WS}+hanse.*", rf"{WS}+am see",
        rf"{WS}+an der .*",
    ):
        s = sub(s, pattern, "")
    s = drop(rep(fold(s), ("-", " "), ("/", " ")), '.!?;:"')
    return collapse(f"replace({s}, chr(39), '')")


def n8(x: str) -> str:
    s = rep(sub(f"lower({present(x)})", r"\([^)]*\)", " "), (",", " "))
    s = rep(
        s, (" stadt", " "), (" landeshauptstadt", " "), ("kreisfreie stadt", " "),
        ("gemeinde", " "), ("amt", " "), ("stadtteil", " "), ("bezirk", " "),
    )
    return collapse(sub(s, "[^a-zäöüß0-9 ]+", " "))


def n9(x: str) -> str:
    s = rep(drop(f"lower({present(x)})", "().,"), ("-", " "))
    return collapse(sub(s, rf"\b({NINE})\b", ""))


def n10(x: str) -> str:
    s = rep(x, ("ß", "ss"), ("(", " "), (")", " "), (",", " "), (".", " "))
    return collapse(sub(f"lower({collapse(s)})", rf"\b({FOUR})\b", ""))


def n11(x: str) -> str:
    s = strip(f"split_part({strip(f'lower({present(x)})')}, ',', 1)")
    s = collapse(sub(s, rf"{WS}*\(.*?\){WS}*", " "))
    for word in (
        "große kreisstadt", "kreisfreie stadt", "landeshauptstadt", "universitätsstadt",
        "hansestadt", "kreisstadt", "stadt", "kreis", "gemeinde",
    ):
        s = strip(sub(s, rf"\b{word}$", ""))
    return s


def n12(x: str) -> str:
    return f"lower({strip(f'split_part({x}, chr(44), 1)')})"


def n12_display(x: str) -> str:
    return strip(f"split_part({strip(f'split_part({x}, chr(44), 1)')}, '(', 1)")


def p4(x: str) -> str:
    return collapse(sub(f"lower({present(x)})", "[^a-zäöüß0-9 ]+", " "))


def unique_map(table: str, keys: list[str], value: str) -> str:
    names = ", ".join(keys)
    usable = " AND ".join(f"{k} IS NOT NULL AND {k} <> ''" for k in keys)
    return (
        f"SELECT {names}, MIN({value}) AS {value} FROM {table} WHERE {usable} "
        f"GROUP BY {names} HAVING COUNT(DISTINCT {value}) = 1"
    )


def plausible(area: str, rent: str) -> str:
    return f"{area} > 10 AND {area} < 400 AND {rent} > 200 AND {rent} < 10000"


def train_hash(key: str) -> str:
    """True for test rows: the hash of the key falls into the first fifth."""
    return f"substr(md5(CAST({key} AS VARCHAR)), 1, 8) < '33333333'"


def common_subsequences(pairs: str) -> str:
    """``lcs (a, b, n)`` of the distinct ``(a, b)`` of a table, one character of b a round."""
    return f"""
    lcs_rows AS (
      SELECT DISTINCT a, b, 0 AS k, list_transform(range(length(a) + 1), lambda i: 0::BIGINT) AS r FROM {pairs}
      UNION ALL
      SELECT a, b, k + 1, list_transform(range(1, length(a) + 2), lambda j: list_max(t[1:j]))
      FROM (SELECT *, list_transform(range(length(a) + 1), lambda j:
              CASE WHEN j = 0 THEN 0 WHEN substr(a, j, 1) = substr(b, k + 1, 1) THEN r[j] + 1
                   ELSE r[j + 1] END) AS t
            FROM lcs_rows WHERE k < length(b))),
    lcs AS (SELECT a, b, list_max(r) AS n FROM lcs_rows WHERE k = length(b))"""


def match_ratios(pairs: str) -> str:
    """``ratios (a, b, ratio)``: the longest equal block, then those on both sides of it."""
    block = """list_max(flatten(list_transform(range(alo, ahi), lambda i:
        list_transform(range(blo, bhi), lambda j: [list_max(list_filter(range(0, least(ahi - i, bhi - j) + 1),
          lambda l: substr(a, (i + 1)::INT, l::INT) = substr(b, (j + 1)::INT, l::INT))), -i, -j]))))"""
    return f"""
    blocks AS (
      SELECT *, {block} AS m FROM (
        SELECT DISTINCT a, b, 0::BIGINT AS alo, length(a)::BIGINT AS ahi, 0::BIGINT AS blo,
               length(b)::BIGINT AS bhi FROM {pairs})
      UNION ALL
      SELECT *, {block} AS m FROM (
        SELECT a, b, x.alo, x.ahi, x.blo, x.bhi FROM (
          SELECT a, b, unnest([
            {{'alo': alo, 'ahi': -m[2], 'blo': blo, 'bhi': -m[3]}},
            {{'alo': m[1] - m[2], 'ahi': ahi, 'blo': m[1] - m[3], 'bhi': bhi}}]) AS x
          FROM blocks WHERE m[1] > 0))),
    ratios AS (SELECT a, b, 2.0e0 * sum(coalesce(m[1], 0)) / (length(a) + length(b)) AS ratio
               FROM blocks GROUP BY a, b)"""
