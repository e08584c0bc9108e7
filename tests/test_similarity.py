from __future__ import annotations

import difflib
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rentlens.operators import resolve, similarity


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcß ", max_size=40), st.text("abcß ", max_size=40))
def test_common_subsequence(a, b):
    assert similarity.common_subsequence(a, b) == plain_lcs(a, b)


names = st.lists(st.text("abn 1", min_size=1, max_size=14), min_size=1, max_size=25, unique=True)


@pytest.mark.parametrize("ratio", [0.87, 0.9, 0.75, 2 / 3, 0.6, 0.4, 0.1, 1.0])
@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(left=names, right=names)
def test_near_pairs_miss_nothing(spark, ratio, left, right):
    a = spark.createDataFrame([(x,) for x in left], "a string")
    b = spark.createDataFrame([(x,) for x in right], "b string")
    found = {(r.a, r.b) for r in similarity.near_pairs(a, b, "a", "b", ratio).collect()}
    wanted = {
        (x, y)
        for x in left
        for y in right
        if 2 * plain_lcs(x, y) >= ratio * (len(x) + len(y)) - 1e-9
    }
    assert wanted <= found


def test_close_match_equals_difflib(spark):
    choices = ["nation_1", "nation_2", "nation_12", "nation_21", "koeln", "kiel", "kiell", "ulm"]
    wanted = ["natoin_12", "nation_1", "kiel", "koelnn", "berlin", "nation_3", "kielll", "u"]
    w = spark.createDataFrame([(x,) for x in wanted], "name string")
    c = spark.createDataFrame([(x,) for x in choices], "choice string")
    got = {r["name"]: r["choice"] for r in similarity.close_match(w, c, "name", "choice").collect()}
    for x in wanted:
        best = difflib.get_close_matches(x, choices, n=1, cutoff=0.87)
        assert got.get(x) == (best[0] if best else None), x


def brute_fuzzy(query, candidates, threshold=90.0):
    plz, target, k5, b2 = query
    mine = [c for c in candidates if c["plz"] == plz]
    pool = [c for c in mine if k5 and c["ags"][:5] == k5]
    pool = pool or [c for c in mine if b2 and c["ags"][:2] == b2] or mine
    best, best_score = None, -1.0
    for c in pool:
        label = " ".join(sorted(c["label"].split()))
        score = similarity.indel_score(" ".join(sorted(target.split())), label)
        if score > best_score:
            best, best_score = c["ags"], score
    return best if best_score >= threshold else None


@pytest.mark.parametrize("limit", [resolve.BROADCAST_LIMIT, 0])
def test_match_fuzzy_equals_brute_force(spark, limit):
    towns = ["Neustadtl am Rhein", "Neustadtl am Rhin", "Obergreifenhain", "Kiel", "Burghausen"]
    key_map, candidates, listings, expected = [], [], [], {}
    n = 0
    for plz in ("00001", "00002", "00003"):
        for i, town in enumerate(towns):
            for state in ("01", "09"):
                ags = f"{state}{plz[-3:]}{i:03d}"
                key_map.append((ags + "0000", ags, town, plz, town, n))
                name = resolve_norm(town)
                candidates.append({"plz": plz, "ags": ags, "label": f"{name}|{name}"})
                n += 1
    asked = ["Neustadtl am Rhein", "Neustadl am Rhein", "Obergreifenhein", "Kiel", "Burghausn", None]
    states = {"Schleswig-Holstein": "01", "Bayern": "09", "Nirgendwo": None}
    i = 0
    for plz in ("00001", "00002", "99999"):
        for town in asked:
            for state, b2 in states.items():
                for krs in ("Kreis 01001", None):
                    listings.append((i, plz, state, None, town, krs))
                    name = resolve_norm(town or "")
                    target = " ".join(w for w in (name, name) if w)
                    k5 = "01001" if krs else None
                    expected[i] = brute_fuzzy((plz, target, k5, b2), candidates)
                    i += 1
    df = spark.createDataFrame(
        listings, "id int, geo_plz string, regio1 string, regio2 string, regio3 string, geo_krs string"
    )
    table = spark.createDataFrame(
        key_map, "ARS string, AGS string, Gemeindename string, PLZ string, Ort string, row_no int"
    )
    got = {r["id"]: r["GKZ"] for r in resolve.match_fuzzy(df, table, limit=limit).collect()}
    assert got == expected
    assert any(expected.values()) and not all(expected.values())


def resolve_norm(x: str) -> str:
    return " ".join(x.lower().split())


def test_a_ratio_of_nothing_is_refused(spark):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError):
        similarity.near_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", 0.0)


def town(rng):
    parts = ["neu", "alt", "ober", "unter", "burg", "stadt", "heim", "hausen", "kirch", "bach", "feld", "wald",
             "see", "berg", "dorf", "furt", "brunn", "zell", "ried", "moos", "gross", "klein", "sankt", "bad"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(2, 4)))


@pytest.mark.parametrize("limit", [resolve.BROADCAST_LIMIT, 0])
def test_candidates_at_a_low_ratio_are_few_and_whole(spark, limit):
    """At 0.6 a small part of all pairs is met and scored, and none that reaches it is missed."""
    rng = random.Random(8)
    left, right = ({town(rng) for _ in range(n)} for n in (250, 300))
    a = spark.createDataFrame([(x,) for x in left], "a string")
    b = spark.createDataFrame([(x,) for x in right], "b string")
    met = similarity.character_pairs(a, b, "a", "b", 0.6, limit)
    found = {tuple(r) for r in similarity.near_pairs(a, b, "a", "b", 0.6, limit).collect()}
    truth = {(x, y) for x in left for y in right if 2 * plain_lcs(x, y) >= 0.6 * (len(x) + len(y)) - 1e-9}
    n_met, n_all = met.count(), len(left) * len(right)
    assert truth <= found
    assert n_met <= 0.25 * n_all, n_met / n_all
    assert len(found) <= 0.2 * n_all, len(found) / n_all


def test_close_match_at_a_low_cutoff_equals_difflib(spark):
    rng = random.Random(4)
    choices, wanted = sorted({town(rng) for _ in range(40)}), sorted({town(rng)[1:] for _ in range(25)})
    w = spark.createDataFrame([(x,) for x in wanted], "name string")
    c = spark.createDataFrame([(x,) for x in choices], "choice string")
    got = {r["name"]: r["choice"] for r in similarity.close_match(w, c, "name", "choice", 0.55).collect()}
    for x in wanted:
        best = difflib.get_close_matches(x, choices, n=1, cutoff=0.55)
        assert got.get(x) == (best[0] if best else None), x
