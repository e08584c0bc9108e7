"""Joins against lookup tables that stay whole and balanced at any size.

A lookup side is measured first. Within the limit it is broadcast, so the big side is
never shuffled. Beyond it the join runs as a shuffle in which keys with more rows than one
task should hold are salted: each spreads over as many tasks as its counted rows need, and
only the lookup rows of those keys are copied.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.operators import frames

BROADCAST_LIMIT = 32 * 1024 * 1024

# Rows of one key that a task takes. A key with more is hot, so hot keys are few: at most one
# for so many rows of the table.
ROWS_PER_TASK = 500_000


def measured_bytes(frames: list[DataFrame]) -> list[int]:
    """Size of each frame as it is kept in memory, all of them in one distributed job.

    Only texts and nested values are looked at; the others have a fixed size.
    """
    rows = [f.select(F.lit(i).alias("frame"), _row_bytes(f).alias("bytes")) for i, f in enumerate(frames)]
    sums = reduce(DataFrame.unionAll, rows).groupBy("frame").agg(F.sum("bytes").alias("bytes"))
    found = {r["frame"]: r["bytes"] for r in sums.collect()}
    return [found.get(i, 0) for i in range(len(frames))]


def _row_bytes(df: DataFrame) -> Column:
    """Eight bytes a column, and what texts and nested values have besides."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    return size


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    null_safe: bool = False,
    limit: int = BROADCAST_LIMIT,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join ``right`` to ``left`` on equally named columns (left, inner, semi or anti)."""
    return lookup_joins(
        left, [(right, on)], how, null_safe=null_safe, limit=limit, rows_per_task=rows_per_task
    )


def lookup_joins(
    left: DataFrame,
    lookups: list[tuple[DataFrame, list[str]]],
    how: str = "left",
    *,
    null_safe: bool = False,
    limit: int = BROADCAST_LIMIT,
    keep: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Several lookups on one big side, measured together in a single job.

    The measured frames are kept for the job, so the join does not evaluate a broadcast
    side a second time. ``keep=False`` is for frames that are read from a kept one anyway.
    """
    kept = [frames.keep(right) if keep else right for right, _ in lookups]
    sizes = measured_bytes(kept)
    # Lookups add columns, so the keys of the original rows tell which ones are hot; one pass
    # counts them for all the lookups that are not broadcast.
    wide = [on for (_, on), size in zip(lookups, sizes) if size > limit]
    hot = hot_keys(left, wide, rows_per_task) if wide else []
    for right, (_, on), size in zip(kept, lookups, sizes):
        if size <= limit:
            left = _join(left, F.broadcast(right), on, how, null_safe)
        else:
            left = salted_join(left, right, on, how, null_safe=null_safe, hot=hot.pop(0))
    return left


def by_distinct(
    df: DataFrame,
    columns: list[str],
    fn: Callable[[DataFrame], DataFrame],
    limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """Apply ``fn`` once per distinct value combination and join its new columns back.

    For work that depends on a few columns only, such as resolving place names: the
    distinct combinations are far fewer than the rows and hold no hot key. The answers are
    a checkpoint, so ``df`` is read once for them and whatever ``fn`` does runs once.
    """
    answers = frames.cut(fn(df.select(*columns).distinct()))
    return lookup_join(df, answers, columns, null_safe=True, limit=limit)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    null_safe: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Shuffle join whose hot keys on the left spread over as many tasks as they need.

    Hot keys, the null key among them, are those of ``hot``, or found by one counting job
    over the left side. They sit in the plan as a small table, so the left side appears in
    the plan only once.
    """
    if hot is None:
        hot = hot_keys(left, [on], rows_per_task)[0]
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    salt = F.when(F.col("__salts").isNotNull(), F.pmod(spread, F.col("__salts"))).otherwise(0)
    salted_left = (
        _join(left, hot, on, "left", True).withColumn("__salt", salt.cast("int")).drop("__salts")
    )
    copies = F.sequence(F.lit(0), (F.coalesce("__salts", F.lit(1)) - 1).cast("int"))
    salted_right = (
        _join(right, hot, on, "left", True).withColumn("__salt", F.explode(copies)).drop("__salts")
    )
    return _join(salted_left, salted_right, [*on, "__salt"], how, null_safe).drop("__salt")


def hot_keys(
    df: DataFrame, key_sets: list[list[str]], rows_per_task: int = ROWS_PER_TASK
) -> list[DataFrame]:
    """For each set of columns the keys with more than ``rows_per_task`` rows and their
    ``__salts``, as broadcast tables; counted for all sets in one pass."""
    distinct = list(dict.fromkeys(map(tuple, key_sets)))
    columns = list(dict.fromkeys(c for on in distinct for c in on))
    counts = df.groupingSets([[F.col(f"`{c}`") for c in on] for on in distinct], *[F.col(f"`{c}`") for c in columns])
    counted = counts.agg(F.grouping_id().alias("__set"), F.count(F.lit(1)).alias("__rows"))
    rows = counted.where(F.col("__rows") > rows_per_task).collect()
    kinds = {f.name: f.dataType for f in df.schema.fields}
    tables = {}
    for on in distinct:
        # One bit per column, the first one highest, set where the column is grouped away.
        number = int("".join("0" if c in on else "1" for c in columns), 2)
        own = [
            (*[r[c] for c in on], -(-r["__rows"] // rows_per_task)) for r in rows if r["__set"] == number
        ]
        schema = T.StructType([*[T.StructField(c, kinds[c]) for c in on], T.StructField("__salts", T.LongType())])
        tables[on] = F.broadcast(df.sparkSession.createDataFrame(own, schema))
    return [tables[tuple(on)] for on in key_sets]


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str, null_safe: bool) -> DataFrame:
    if not null_safe:
        return left.join(right, on, how)
    renamed = right.withColumnsRenamed({c: f"__key_{c}" for c in on})
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in on])
    return left.join(renamed, match, how).drop(*[f"__key_{c}" for c in on])


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.min(F.struct(*order, *rest)).alias("__row")
    picked = df.groupBy(*keys).agg(row).select(*keys, "__row.*")
    return picked.select(*df.columns)
