"""Exact top-k inner products through a vector-approximation file.

Every dimension is cut into cells; a vector is kept as one cell number per dimension. The
cells alone bound every score from both sides. Candidates whose upper bound stays below the
k-th best lower bound are out; of the rest the exact vectors are read in the order of their
bounds, first a few per query and then those, and only those, whose bound still reaches the
k-th exact score.

Queries and cells meet in blocks of bounded size: an equality join on (block of candidates,
block of queries), so no task holds all of either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentlens.llm.common import staged

TOP = 5
QUERY_STEP = 50
SCALE = 256

#: Cells per dimension. Their numbers fit a byte.
CELLS = 64

#: Rows of a block; a task holds one block of each side, and a slab of queries at a time.
CANDIDATE_BLOCK, QUERY_BLOCK, SLAB = 16_384, 1_024, 64

#: Exact vectors read per query in the first round, as a multiple of k.
FIRST_READ = 4


#: Largest whole component; products of two, and sums of ten thousand, fit 38 digits.
LARGEST = 2.0**55

#: Below this, products and sums of a thousand of them fit 64 bits.
SMALL = 1 << 26


def integers(vector: Column) -> Column:
    """floor(256 x) of every component; null where the vector cannot take part.

    A component beyond ``LARGEST`` counts as that.
    """
    x = lambda v: v.cast("double")
    fits = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")))
    bounded = lambda v: F.greatest(F.least(x(v) * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))
    return F.when(fits & (F.size(vector) > 0), F.transform(vector, lambda v: F.floor(bounded(v))))


def _score(a: str, b: str) -> Column:
    """Inner product; beyond 64 bits the nearest 64-bit number."""
    small = lambda v: F.forall(v, lambda x: F.abs(x) < SMALL) & (F.size(v) <= 1_000)
    products = F.zip_with(a, b, lambda x, y: x * y)
    plain = F.aggregate(products, F.lit(0).cast("long"), lambda s, p: s + p)
    wide = "decimal(19,0)"
    terms = F.zip_with(a, b, lambda x, y: (x.cast(wide) * y.cast(wide)).cast("decimal(38,0)"))
    total = F.aggregate(terms, F.lit(0).cast("decimal(38,0)"), lambda s, p: (s + p).cast("decimal(38,0)"))
    ends = [F.lit(e).cast("decimal(38,0)") for e in (str(-(1 << 63)), str((1 << 63) - 1))]
    exact = F.greatest(F.least(total, ends[1]), ends[0]).cast("long")
    return F.when(small(a) & small(b), plain).otherwise(exact)


def _marks(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: first value and cell width of every dimension, over all vectors."""
    rows = (
        vectors.select("dim", F.posexplode("v").alias("at", "x"))
        .groupBy("dim", "at")
        .agg(F.min("x").alias("low"), F.max("x").alias("high"))
        .collect()
    )
    out = {}
    for dim in {r["dim"] for r in rows}:
        own = sorted((r["at"], r["low"], r["high"]) for r in rows if r["dim"] == dim)
        low, high = np.array([r[1] for r in own], np.int64), np.array([r[2] for r in own], np.int64)
        out[dim] = (low, (high - low) // CELLS + 1)
    return out


def _cells(marks):
    def run(batches):
        for batch in batches:
            packed = []
            for v in batch.column("v").to_pylist():
                low, width = marks[len(v)]
                packed.append(((np.array(v, np.int64) - low) // width).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("dim"), pa.array(packed, pa.binary())],
                names=["cid", "dim", "cells"],
            )

    return run


def _bounds(marks, top: int):
    """For a block of cells and a block of queries: candidates that may be among the best."""

    def run(key, cells: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"qid": [], "cid": [], "middle": [], "reach": []}
        dim = key[0].as_py()
        if cells.num_rows and queries.num_rows:
            low, width = marks[dim]
            cids = cells.column("cid").to_numpy()
            raw = np.frombuffer(b"".join(cells.column("cells").to_pylist()), np.uint8)
            middle = low + raw.reshape(len(cids), dim) * width + (width - 1) / 2
            qids, own = queries.column("qid").to_numpy(), queries.column("own").to_numpy()
            vectors = np.array(queries.column("v").to_pylist(), np.float64)
            # A cell reaches half its width to both sides; the rest covers rounding.
            reach = np.abs(vectors) @ ((width - 1) / 2)
            reach += 1 + 1e-12 * (np.abs(vectors) @ np.abs(middle).max(axis=0))
            for i in range(0, len(qids), SLAB):
                part = slice(i, i + SLAB)
                scores = vectors[part] @ middle.T
                others = np.where(cids[None, :] == own[part, None], -np.inf, scores)
                if others.shape[1] >= top:
                    kth = np.partition(others, -top, axis=1)[:, -top]
                else:
                    kth = np.full(len(others), -np.inf)
                may = scores + reach[part, None] >= (kth - reach[part])[:, None]
                q, c = np.nonzero(may)
                out["qid"].append(qids[part][q])
                out["cid"].append(cids[c])
                out["middle"].append(scores[q, c])
                out["reach"].append(reach[part][q])
        kinds = {"qid": pa.int64(), "cid": pa.int64(), "middle": pa.float64(), "reach": pa.float64()}
        return pa.table(
            {n: pa.array(np.concatenate(v) if v else [], kinds[n]) for n, v in out.items()}
        )

    return run


def _smallest_ids(vectors: DataFrame, top: int) -> DataFrame:
    """Distinct vectors with the ids of their first ``top + 1`` rows: no other can be reported.

    ``vectors`` has one row per id and vector, with how many rows it stands for.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = vectors.withColumn("place", place).where(F.col("place") <= top + 1)
    repeated = F.flatten(
        F.transform(
            F.sort_array(F.collect_list(F.struct("id", F.least("times", F.lit(top + 1)).cast("int").alias("n")))),
            lambda s: F.array_repeat(s["id"], s["n"]),
        )
    )
    return few.groupBy("v", "dim").agg(F.slice(repeated, 1, top + 1).alias("ids"))


def _without_one(ids: Column, id_: Column) -> Column:
    """The ids without one row of the query's own id."""
    at = F.array_position(ids, id_).cast("int")
    return F.when(at == 0, ids).otherwise(
        F.concat(F.slice(ids, F.lit(1), at - 1), F.slice(ids, at + 1, F.size(ids)))
    )


def _best(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def top_k(
    table: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    top: int = TOP,
    query_step: int = QUERY_STEP,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` best of every query row.

    Queries are the rows whose key is divisible by ``query_step``; candidates are all other
    rows with the same number of components, so a second row with the query's key is one,
    and a query row that is repeated has its results once per row. Rows without a key, null
    or empty vectors, and vectors with a null or non-finite component take no part. Ties go
    to the smaller key; a score beyond 64 bits counts as the nearest 64-bit number; a query
    without candidates has no rows.
    """
    vectors = staged(
        table.select(F.col(key).cast("long").alias("id"), integers(F.col(vector)).alias("v"))
        .where("id is not null and v is not null")
        .groupBy("id", "v")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("dim", F.size("v"))
    )
    distinct = staged(_smallest_ids(vectors, top).withColumn("cid", F.monotonically_increasing_id()))
    queries = vectors.where(F.col("id") % query_step == 0)
    queries = queries.join(distinct.select("v", F.col("cid").alias("own")), "v")
    queries = staged(queries.withColumn("qid", F.monotonically_increasing_id()))
    marks = _marks(distinct)
    cells = staged(
        distinct.select("cid", "dim", "v").mapInArrow(_cells(marks), "cid long, dim int, cells binary")
    )
    n_blocks = -(-cells.count() // CANDIDATE_BLOCK) or 1
    n_queries = -(-queries.count() // QUERY_BLOCK) or 1

    def block(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = cells.withColumn("cb", block("cid", n_blocks)).withColumn("qb", every(n_queries))
    right = (
        queries.select("qid", "own", "v", "dim")
        .withColumn("qb", block("qid", n_queries))
        .withColumn("cb", every(n_blocks))
    )
    keys = ["dim", "cb", "qb"]
    maybe = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInArrow(_bounds(marks, top), "qid long, cid long, middle double, reach double")
    )
    own = queries.select("qid", "own")
    by_bound = Window.partitionBy("qid").orderBy(F.col("middle").desc(), "cid")
    nth_other = F.sum((F.col("cid") != F.col("own")).cast("int")).over(
        by_bound.rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = staged(
        staged(maybe).join(own, "qid").withColumn("nth", F.row_number().over(by_bound)).withColumn("other", nth_other)
    )
    lowest = ranked.where((F.col("other") == top) & (F.col("cid") != F.col("own"))).select(
        "qid", (F.col("middle") - F.col("reach")).alias("least")
    )
    open_ = staged(
        ranked.join(lowest, "qid", "left")
        .where(F.col("least").isNull() | (F.col("middle") + F.col("reach") >= F.col("least")))
        .select("qid", "cid", "nth", (F.col("middle") + F.col("reach")).alias("upper"))
    )

    def read(pairs: DataFrame) -> DataFrame:
        """Exact scores of the pairs; of a query's own vector one row of its id is left out."""
        exact = (
            pairs.join(distinct.select("cid", "ids", F.col("v").alias("w")), "cid")
            .join(queries.select("qid", F.col("id").alias("query"), "own", "v"), "qid")
            .withColumn("rest", F.when(F.col("cid") == F.col("own"), _without_one(F.col("ids"), F.col("query"))).otherwise(F.col("ids")))
            .select("qid", "query", "rest", _score("v", "w").alias("score"))
        )
        return exact.select("qid", "query", "score", F.explode("rest").alias("id"))

    few = F.col("nth") <= FIRST_READ * top
    first = staged(_best(read(open_.where(few)), top))
    kth = first.where(F.col("rank") == top).select("qid", F.col("score").alias("kth"))
    rest = open_.where(~few).join(kth, "qid", "left")
    # A bound equal to the k-th score may hide a tie with a smaller id.
    rest = rest.where(F.col("kth").isNull() | (F.col("upper") >= F.col("kth"))).select("qid", "cid")
    found = _best(first.drop("rank").unionByName(read(rest)), top)
    # A query row that occurs more than once stands in the result as often.
    times = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    return (
        found.join(queries.select("qid", "times"), "qid")
        .withColumn("row", times)
        .select(F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score")
    )
