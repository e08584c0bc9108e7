"""Shared folder, stage tables and small-side joins for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Words of the contracts: anything between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a side that is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves a local session, whose executors are
    this process; on a cluster the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rentlens-")
    return f"{base.rstrip('/')}/rentlens-llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read back: lineage is cut, sizes are known."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "left", rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a stage table, broadcast only when it was counted and has few rows.

    Beyond that the join shuffles, and adaptive execution splits its hot keys.
    """
    if small.count() <= rows:
        small = F.broadcast(small)
    return big.join(small, on, how)


def lower_az(column: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, UPPER, UPPER.lower())


def drawn(column: Column | str, share: float) -> Column:
    """Whether a row is in a sample of about ``share``, by a hash; fine enough for any size."""
    bits = 62
    return F.pmod(F.xxhash64(column), F.lit(1 << bits)) < F.lit(min(1 << bits, int(share * (1 << bits))))


def row_digest(df: DataFrame) -> Column:
    """128 bits of all columns, maps among them, as text."""

    def hashable(field: T.StructField) -> Column:
        # Maps have no hash; as text they are compared by their entries.
        plain = "map<" not in field.dataType.simpleString()
        return F.col(f"`{field.name}`") if plain else F.col(f"`{field.name}`").cast("string")

    columns = [hashable(f) for f in df.schema.fields]
    # A null adds nothing to a hash, so which columns are null is a part of it.
    gaps = F.concat_ws("", *[c.isNull().cast("int").cast("string") for c in columns])
    return F.concat_ws("-", F.hex(F.xxhash64(gaps, *columns)), F.hex(F.xxhash64(*columns, gaps, F.lit(1))))


def shielded(
    docs: DataFrame, needed: list[str], work: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``work`` on a frame whose other columns have neutral names, which then come back.

    So no column of the documents meets a name that the work uses, whatever it is called.
    Columns that the work adds replace others of that name.
    """
    neutral = {f"extra_{i}" if c not in needed else c: c for i, c in enumerate(docs.columns)}
    out = work(docs.toDF(*neutral))
    added = [c for c in out.columns if c not in neutral]
    taken = {c.lower() for c in added}
    kept = [c for c in out.columns if c in neutral and neutral[c].lower() not in taken]
    return out.select(*[F.col(c).alias(neutral[c]) for c in kept], *added)


def without_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns whose names the operator itself uses are left out (any letter case)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def numbered(df: DataFrame, order: list[str], name: str = "__rank") -> DataFrame:
    """Adds the place of every row from 0 in an order, without one task for all.

    Rows are range-partitioned; each partition numbers its own rows and adds the rows of the
    partitions before it.
    """
    parts = staged(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("__part").count().select(
        "__part", F.coalesce(before, F.lit(0)).alias("__before")
    )
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        parts.withColumn("__own", own)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__own") - 1 + F.col("__before"))
        .drop("__own", "__before", "__part")
    )


def numbered_equal(rows: DataFrame, by: list[str], name: str = "__number") -> DataFrame:
    """Numbers rows that are alike from 0 by group, without one task for a group.

    The rows are written with the part they are in; each part numbers its own after those of
    the parts before it. Which row has which number does not matter, as they are alike.
    """
    parts = staged(rows.withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy(*by, "__part").count().select(
        *by, "__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before")
    )
    own = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__part"))
    numbered_ = parts.withColumn("__own", own).join(before, [*by, "__part"])
    return numbered_.withColumn(name, F.col("__own") - 1 + F.col("__before")).drop("__own", "__before", "__part")
