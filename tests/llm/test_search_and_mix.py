"""Near-duplicates, mixing, top-k search."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from rentlens.llm import mixing, simhash, vafile
from rentlens.llm.components import components
from tests.llm.cases import docs, no_docs, texts, words


def plain_fingerprint(text):
    own = words(text)
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    rows = [(i, plain_fingerprint(t)) for i, t in texts()]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                    root[a] = root[b] = min(root[a], root[b])
    want = []
    for at, (i, fp) in enumerate(rows):
        ids = [rows[o][0] for o in range(len(rows)) if root[o] == root[at] and rows[o][0] is not None]
        want.append((i, f"{fp:016x}", min(ids, default=None)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


@pytest.mark.parametrize("bucket", [1, 3, 128])
def test_crowded_segments_lose_no_link(spark, bucket):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 4))) for _ in range(60)}
    values |= {rng.getrandbits(64) for _ in range(30)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(nodes, 2, bucket)).collect()}
    close = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    want = {v: v for v in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            least = min(want[b] for b in signed if close(a, b))
            changed |= least < want[a]
            want[a] = min(want[a], least)
    assert {v: roots.get(v, v) for v in signed} == want


def test_components_of_a_long_chain(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(links)
    assert got.count() == 401 and got.agg(F.max("root")).first()[0] == 0


def test_one_of_each_group_stays(spark):
    kept = simhash.one_of_each(docs(spark))
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    # 2, 3, 4 and a null key have no words; 10 and 11 are near, 12 and 13 the same.
    assert 2 in ids and not {3, 4, 13} & set(ids) and ids.count(11) <= 1 and 12 in ids
    assert kept.columns == docs(spark).columns
    repeated = docs(spark).where("doc_id = 11")
    assert simhash.one_of_each(repeated.select("doc_id", "text")).count() == 1


def test_mix_meets_targets(spark):
    rows = mixing.balance(docs(spark)).collect()
    assert len(rows) == len(texts())
    total = sum(len(words(t)) for _, t in texts())
    by_source = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert abs(sum(t for _, t in by_source.values()) - total) < 1e-6 * total
    for source, (size, target) in by_source.items():
        own = [r for r in rows if r["source"] == source]
        assert size == sum(r["size"] for r in own) and target <= 3 * size + 1e-9
        assert abs(sum(r["taken"] for r in own) - target) <= max(r["size"] for r in own)
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    again = mixing.balance(docs(spark).repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in rows) == sorted((str(r["doc_id"]), r["taken"]) for r in again)


def test_excess_is_reshared_until_none_is_above(spark):
    groups = spark.createDataFrame([("=a", 1), ("=b", 10), ("=c", 1000), ("=d", 0)], "__group string, source_size long")
    got = {r["__group"]: r["target"] for r in mixing.targets(groups).collect()}
    assert got["=a"] == 3 and got["=b"] == 30 and got["=d"] == 0 and abs(got["=c"] - 978) < 1e-9


def test_empty_tables(spark):
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    assert simhash.one_of_each(no_docs(spark)).count() == 0
    assert mixing.balance(no_docs(spark)).count() == 0
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vafile.top_k(none).count() == 0


def plain_top(rows):
    ends = (-(1 << 63), (1 << 63) - 1)
    ok = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = Counter()
    for at, (q, a) in enumerate(ok):
        if q % 50:
            continue
        found = sorted(
            (-min(max(sum(x * y for x, y in zip(a, b)), ends[0]), ends[1]), i)
            for other, (i, b) in enumerate(ok)
            if other != at and len(a) == len(b)
        )
        want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(found[:5]))
    return want


def check_top(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, vafile.top_k(table).collect())) == plain_top(rows)


def test_top_k_equals_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(260)]
    rows += [(300 + i, rows[50][1]) for i in range(12)]
    rows += [(50, rows[50][1]), (400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8)]
    rows += [(None, rows[3][1]), (403, []), (450, [0.5, 0.25]), (451, [1.0, -1.0]), (404, [float("inf")] * 8)]
    check_top(spark, rows)


def test_top_k_takes_rows_as_they_are(spark):
    """Rows of a query's own key, rows that repeat, and components of any ordinary size."""
    rng = random.Random(9)
    same = [rng.uniform(-1, 1) for _ in range(4)]
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(50, same), (50, same), (50, same), (100, same), (7, same), (7, same), (2, same)] + [(50, rows[3][1])] * 9
    check_top(spark, rows)
    check_top(spark, rows + [(500, [9e6, 1.0, -9e6, 3e7]), (501, [9e6] * 4), (550, [1e12, -1e12, 5.0, 0.25])])


def test_mix_cuts_among_equal_rows(spark):
    """Half of a source is one row over and over: as many of them are taken as fit."""
    rows = [(1, "w " * 100, "a")] * 60 + [(2 + i, "w " * 100, "a") for i in range(40)]
    rows += [(200 + i, "v " * 255, "b") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.balance(df).collect()
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    again = mixing.balance(df.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("share", [2000 / 10**11, 1e-9, 0.3, 1.0])
def test_draws_hold_at_any_size(spark, share):
    """A share of one in fifty million still draws: its bound is far above zero."""
    from rentlens.llm.common import drawn

    n = spark.range(200_000).where(drawn("id", share)).count()
    assert abs(n - 200_000 * share) <= 5 * (200_000 * share) ** 0.5 + 1
    plan = spark.range(1).select(drawn("id", share).alias("d"))._jdf.queryExecution().toString()
    assert "< 0)" not in plan
