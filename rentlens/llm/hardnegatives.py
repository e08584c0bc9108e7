"""Hard negatives by windows below each positive's score, with spanning-tree bounds.

Anchors are put in groups of similar ones, and each group becomes a minimum spanning tree
that starts at the origin, whose scores are all zero. The score of a candidate at a child
differs from its score at the parent by at most the edge's length times the candidate's
norm; so the interval known at the parent, widened by that, holds the child's score, and
only candidates whose interval meets a window that still has room are scored exactly.

Two passes over (group of anchors, block of candidates): the first finds each anchor's
positives, the second the negatives in the windows that the positives set. Blocks and
groups are of bounded size, so no task holds all of either side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import numbered, staged

ANCHOR_STEP, POSITIVES, NEGATIVES = 50, 5, 3
LEAST_PCT, MOST_PCT = 50, 95
SCALE = 256

#: Anchors of a tree; candidates that a tree is walked for at a time.
GROUP, SLAB = 1_024, 4_096

#: Bytes of vectors in a block of candidates, at most.
BLOCK_BYTES = 32 * 1024 * 1024

#: Random directions whose signs bring similar anchors together.
DIRECTIONS = 12

#: Past these bounds of a score floats, then 64-bit integers, would not be exact.
FLOAT_EXACT, INT_EXACT = 2.0**53, 2.0**62

#: Rounding allowed for in an edge, and in a score held as a float.
EDGE_SLACK, SCORE_SLACK = 1e-6, 1e-12

_CODE = "rid long, id long, label long, x array<double>, dim int, code int"
_TREE = "group long, seq int, parent int, edge double, rid long, label long, x array<double>, dim int"
_CANDIDATE = ["rid", "id", "label", "x", "dim"]


def finite(vector: Column) -> Column:
    """Whether a vector takes part: no null and no non-finite component."""
    x = lambda v: v.cast("double")
    return vector.isNotNull() & F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf"))
    )


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.chunked_array(flat.chunks).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _whole(x: float) -> int:
    scaled = x * SCALE
    return math.floor(scaled) if math.isfinite(scaled) else int(x) * SCALE


def _exact(raw: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of both, in the narrowest numbers whose products stay exact."""
    with np.errstate(over="ignore"):
        a, b = np.floor(raw * SCALE), np.floor(others * SCALE)
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, raw.shape[1])
    if reach < FLOAT_EXACT:
        return a, b
    if reach < INT_EXACT and max(np.abs(a).max(), np.abs(b).max()) < INT_EXACT:
        return a.astype(np.int64), b.astype(np.int64)
    whole = np.vectorize(_whole, otypes=[object])
    return (whole(raw) if raw.size else raw), (whole(others) if others.size else others)


def _codes(batches):
    """Signs along random directions, as one number."""
    for batch in batches:
        codes = []
        for x in batch.column("x").to_pylist():
            signs = np.random.default_rng(len(x)).choice([-1.0, 1.0], (DIRECTIONS, len(x)))
            with np.errstate(all="ignore"):
                codes.append(int(((signs @ np.array(x, float)) > 0) @ (1 << np.arange(DIRECTIONS))))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("rid", "id", "label", "x", "dim")), pa.array(codes, pa.int32())],
            names=["rid", "id", "label", "x", "dim", "code"],
        )


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order in which vectors join the tree, each one's parent (-1: origin) and edge length."""
    n = len(vectors)
    squares = (vectors * vectors).sum(axis=1)
    near, parent = squares.copy(), np.full(n, -1)
    open_, order = np.ones(n, bool), []
    for _ in range(n):
        at = int(np.argmin(np.where(open_, near, np.inf))) if open_.any() else 0
        if not open_[at]:
            at = int(np.argmax(open_))
        open_[at] = False
        order.append(at)
        far = squares + squares[at] - 2 * (vectors @ vectors[at])
        closer = open_ & (far < near)
        near[closer], parent[closer] = far[closer], at
    own = vectors - np.where(parent[:, None] >= 0, vectors[parent], 0.0)
    return np.array(order, int), parent, np.sqrt((own * own).sum(axis=1))


def _trees(key: tuple[pa.Scalar, ...], anchors: pa.Table) -> pa.Table:
    group, dim = key[0].as_py(), key[1].as_py()
    with np.errstate(all="ignore"):
        vectors = np.floor(_matrix(anchors.column("x"), dim) * SCALE)
        order, parent, edge = spanning_tree(vectors)
    seq = np.empty(len(order), int)
    seq[order] = np.arange(len(order))
    parent = np.where(parent >= 0, seq[parent], -1)
    n = len(order)
    return pa.table(
        {
            "group": pa.array(np.full(n, group), pa.int64()),
            "seq": pa.array(seq, pa.int32()),
            "parent": pa.array(parent, pa.int32()),
            "edge": pa.array(edge, pa.float64()),
            "rid": anchors.column("rid"),
            "label": anchors.column("label"),
            "x": anchors.column("x"),
            "dim": anchors.column("dim"),
        }
    )


class _Best:
    """The best few (score, id) seen so far; ties go to the smaller id."""

    def __init__(self, most: int):
        self.most = most
        self.scores = np.empty(0, object)
        self.ids = np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(ids) > self.most:
            kept = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.most]
            scores, ids = scores[kept], ids[kept]
        self.scores, self.ids = scores, ids

    def least(self) -> float:
        """A score below this one cannot be among the best any more."""
        return float(min(self.scores)) if len(self.ids) == self.most else -math.inf


def _room(low: np.ndarray, inside: np.ndarray, best: _Best) -> float:
    """The least score that can still be among the best, given what is certainly inside."""
    least = best.least()
    sure = low[inside]
    if len(sure) >= best.most:
        least = max(least, float(np.partition(sure, -best.most)[-best.most]))
    # The bound itself may be rounded.
    return least - SCORE_SLACK * abs(least) - 1 if math.isfinite(least) else least


def _walk(cands: pa.Table, tree: pa.Table, dim: int, windows: list[list[tuple]], same: bool, most: int):
    """Per anchor and window the best candidates: ``windows[seq]`` has (low end, high end).

    Slabs of candidates pass the tree in turn and carry what was found, so later slabs score
    less. ``same`` asks for candidates of the anchor's label, else for those of another.
    """
    raw, own = _matrix(cands.column("x"), dim), _matrix(tree.column("x"), dim)
    vectors, anchors = _exact(raw, own)
    bounded = vectors.dtype != object
    rids, ids = cands.column("rid").to_numpy(), cands.column("id").to_numpy()
    labels = cands.column("label").to_numpy()
    parent, edge = tree.column("parent").to_numpy(), tree.column("edge").to_numpy()
    own_rid, own_label = tree.column("rid").to_numpy(), tree.column("label").to_numpy()
    found = [[_Best(most) for _ in w] for w in windows]
    for start in range(0, len(ids), SLAB):
        part = slice(start, start + SLAB)
        block, n = vectors[part], len(ids[part])
        if bounded:
            norms = np.sqrt((block.astype(float) ** 2).sum(axis=1)) * (1 + EDGE_SLACK)
            mid, reach = np.zeros((len(parent), n)), np.zeros((len(parent), n))
        for s in range(len(parent)):
            up, low = np.full(n, np.inf), np.full(n, -np.inf)
            if bounded:
                p = parent[s]
                if p >= 0:
                    mid[s], reach[s] = mid[p], reach[p]
                reach[s] += edge[s] * (1 + EDGE_SLACK) * norms
                up, low = mid[s] + reach[s], mid[s] - reach[s]
            if not windows[s]:
                continue
            fits = ((labels[part] == own_label[s]) == same) & (rids[part] != own_rid[s])
            meets = np.zeros(n, bool)
            for (first, last), best in zip(windows[s], found[s]):
                room = _room(low, fits & (low >= first) & (up <= last), best)
                meets |= fits & (up >= max(first, room)) & (low <= last)
            at = np.flatnonzero(meets)
            if not len(at):
                continue
            scores = (block @ anchors[s])[at] if 2 * len(at) > n else block[at] @ anchors[s]
            if bounded:
                mid[s, at] = scores
                reach[s, at] = SCORE_SLACK * np.abs(scores) + 1
                exact = scores.astype(np.int64)
            else:
                ends = np.iinfo(np.int64)
                exact = np.array([min(max(int(v), ends.min), ends.max) for v in scores], np.int64)
            for (first, last), best in zip(windows[s], found[s]):
                _offer(best, exact, ids[part][at], first, last)
    return found


def _offer(best: _Best, scores: np.ndarray, ids: np.ndarray, first: float, last: float) -> None:
    hit = (scores >= first) & (scores <= last)
    if len(best.ids) == best.most:
        hit &= scores >= min(best.scores)
    scores, ids = scores[hit], ids[hit]
    if len(ids) > best.most:
        # All ties of the last place stay until ids are compared.
        hit = scores >= np.partition(scores, -best.most)[-best.most]
        scores, ids = scores[hit], ids[hit]
        few = np.lexsort((ids, -scores))[: best.most]
        scores, ids = scores[few], ids[few]
    best.add(scores.astype(object), ids)


def _rows(tree: pa.Table, found) -> pa.Table:
    rid = tree.column("rid").to_numpy()
    out = [
        (int(rid[s]), place + 1, int(i), int(score))
        for s, bests in enumerate(found)
        for place, best in enumerate(bests)
        for score, i in zip(best.scores, best.ids)
    ]
    columns = list(zip(*out)) or [[], [], [], []]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["rid", "place", "id", "score"]
    )


_FOUND = "rid long, place int, id long, score long"


def _near(most: int):
    def run(key, cands: pa.Table, tree: pa.Table) -> pa.Table:
        tree = tree.sort_by("seq")
        anywhere = [[(-math.inf, math.inf)]] * tree.num_rows
        return _rows(tree, _walk(cands, tree, key[0].as_py(), anywhere, True, most))

    return run


def _inside(most: int, least_pct: int, most_pct: int):
    def run(key, cands: pa.Table, tree: pa.Table) -> pa.Table:
        tree = tree.sort_by("seq")
        # Whole scores in [least_pct, most_pct] percent of the positive's.
        windows = [
            [(-(-least_pct * p // 100), most_pct * p // 100) for p in scores]
            for scores in tree.column("scores").to_pylist()
        ]
        return _rows(tree, _walk(cands, tree, key[0].as_py(), windows, False, most))

    return run


def _first(found: DataFrame, by: list[str], most: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def mine(
    table: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    anchor_step: int = ANCHOR_STEP,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_pct: int = LEAST_PCT,
    most_pct: int = MOST_PCT,
    group: int = GROUP,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows with a null key, label or vector, or a null or non-finite component, take no part;
    labels are whole numbers. Repeated rows are rows of their own: another row with the
    anchor's key may be its positive or negative. Vectors of another length have no score
    with an anchor; empty vectors score zero. Ties go to the smaller key. A score beyond 64
    bits counts as the nearest 64-bit number. A positive without a negative in its window
    has no row; without anchors the result is empty; other columns do not matter.
    """
    rows = staged(
        table.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(key).cast("long").alias("id"),
            F.col(label).cast("long").alias("label"),
            F.col(vector).alias("x"),
        )
        .where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("x")))
        .withColumn("x", F.col("x").cast("array<double>"))
        .withColumn("dim", F.size("x"))
    )
    size = rows.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")
    ).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    fit = max(1, block_bytes // (8 * max(1, size["dim"])))
    n_blocks = -(-size["n"] // min(max(SLAB, size["n"] // (4 * cores)), fit)) or 1

    coded = rows.where(F.col("id") % anchor_step == 0).mapInArrow(_codes, _CODE)
    placed = numbered(coded, ["dim", "code", "rid"]).withColumn(
        "group", F.floor(F.col("__rank") / group)
    )
    trees = staged(
        placed.drop("__rank", "code").groupBy("group", "dim").applyInArrow(_trees, _TREE)
    )
    n_groups = (trees.agg(F.max("group")).first()[0] or 0) + 1

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    block = F.pmod(F.xxhash64("rid"), F.lit(n_blocks)).cast("long")
    left = rows.withColumn("block", block).withColumn("group", every(n_groups))
    keys = ["dim", "block", "group"]

    def passed(anchors: DataFrame, fn) -> DataFrame:
        right = anchors.withColumn("block", every(n_blocks))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(fn, _FOUND)

    near = staged(
        _first(staged(passed(trees, _near(positives))).drop("place"), ["rid"], positives, "place")
    )
    scores = near.groupBy("rid").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("scores")
    )
    none = F.array().cast("array<bigint>")
    aimed = staged(
        trees.join(scores, "rid", "left").withColumn("scores", F.coalesce("scores", none))
    )
    found = staged(passed(aimed, _inside(negatives, least_pct, most_pct)))
    hard = _first(found, ["rid", "place"], negatives, "rank")
    names = rows.select("rid", F.col("id").alias("anchor_id"))
    pairs = near.select(
        "rid", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    return (
        hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
        .join(pairs, ["rid", "place"])
        .join(names, "rid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
