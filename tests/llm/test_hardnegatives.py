"""Hard negatives against plain scoring of all pairs."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from rentlens.llm import hardnegatives

SCHEMA = "vec_id long, embedding array<double>, label int, `rid` string, `group` int, `x` int"


def plain(rows):
    ends = (-(1 << 63), (1 << 63) - 1)
    ok = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((i, [math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256 for x in v], label))
    out = []
    for a, (anchor, av, al) in enumerate(ok):
        if anchor % 50:
            continue
        scored = []
        for b, (i, v, label) in enumerate(ok):
            if b != a and len(v) == len(av):
                score = min(max(sum(x * y for x, y in zip(av, v)), ends[0]), ends[1])
                scored.append((-score, i, label))
        scored.sort()
        for s, positive, _ in [r for r in scored if r[2] == al][:5]:
            p = -s
            hard = [r for r in scored if r[2] != al and 50 * p <= -100 * r[0] <= 95 * p][:3]
            out += [(anchor, positive, n + 1, i, p, -t) for n, (t, i, _) in enumerate(hard)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, 4) for r in rows], SCHEMA).repartition(3)


def near(rng, centre, spread):
    return [x + rng.gauss(0, spread) for x in centre]


def cases():
    rng = random.Random(11)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = [(i, near(rng, centres[i % 5], 0.1), rng.randrange(3)) for i in range(420)]
    # A hot vector, with ties throughout, repeated keys and awkward rows.
    rows += [(500 + i, centres[0], i % 3) for i in range(150)]
    rows += [(50, rows[50][1], rows[50][2]), (50, rows[50][1], 2), (100, centres[1], 1)]
    rows += [(600, None, 1), (650, [0.1, None] * 3, 1), (700, [float("nan")] * 6, 1), (750, [float("inf")] * 6, 1)]
    rows += [(None, centres[0], 1), (800, centres[0], None), (801, centres[2], None)]
    rows += [(850, [], 1), (851, [], 1), (852, [], 2), (900, [0.5, 1.0], 1), (901, [0.5, 1.5], 1), (902, [0.4, 0.9], 0)]
    return rows


@pytest.mark.parametrize("group,block_bytes", [(1024, 32 << 20), (3, 4096)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, group, block_bytes):
    monkeypatch.setattr(hardnegatives, "SLAB", 64)
    rows = cases()
    got = hardnegatives.mine(frame(spark, rows), group=group, block_bytes=block_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_scores_stay_exact_for_large_components(spark):
    rng = random.Random(2)
    rows = []
    for size in (1e6, 1e9, 1e18, 1e306):
        # Each magnitude has a length of its own.
        dim = 2 + len(rows) // 60
        rows += [(len(rows) + i, [rng.uniform(0.2, 1) * size for _ in range(dim)], i % 2) for i in range(60)]
    assert sorted(map(tuple, hardnegatives.mine(frame(spark, rows)).collect())) == plain(rows)


def test_no_anchor_or_no_row_gives_no_pair(spark):
    rows = cases()
    assert hardnegatives.mine(frame(spark, rows).where("vec_id = 51 or vec_id = 52")).count() == 0
    assert hardnegatives.mine(frame(spark, rows).where("false")).count() == 0


def test_tree_bounds_hold_and_spare_exact_scores():
    """Anchors near each other: most candidates are told apart by their parents' scores."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 60, (8, 32))
    anchors = np.floor(np.repeat(centres, 12, axis=0) + rng.normal(0, 2, (96, 32)))
    order, parent, edge = hardnegatives.spanning_tree(anchors)
    assert sorted(order) == list(range(96))
    place = {a: i for i, a in enumerate(order)}
    assert all(p == -1 or place[p] < place[a] for a, p in enumerate(parent))
    cands = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(0, 2, (1600, 32)))
    norms = np.sqrt((cands**2).sum(axis=1))
    scores = cands @ anchors.T
    spared = 0
    for a in range(96):
        above = scores[:, parent[a]] if parent[a] >= 0 else np.zeros(len(cands))
        reach = edge[a] * norms * (1 + 1e-9)
        assert (np.abs(scores[:, a] - above) <= reach + 1e-6).all()
        fifth = np.sort(above - reach)[-5]
        spared += (above + reach < fifth).mean()
    assert spared / 96 > 0.5
