"""Shards through a fixed number of virtual slots and a stored map from slots to shards.

A record's slot is a hash of the record, whatever the number of shards. Bytes are added up by slot, and
the map says which shard has a slot. When sizes drift, or shards are added, the map is
edited: every shard keeps slots up to its fair share and the rest move, largest first, to
the shard that has least. Each edit is a new version of the stored map.

Equal texts hash alike and stay together. Only a group with more bytes than a few slots, or
more rows than a task should order, is spread by key, and equal rows of one key by number.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rentlens.llm.common import join_small, shared_folder, staged

SHARDS = 40

#: Thousands of slots, as many for each shard. Fixed for the life of a map.
SLOTS = 8_000

#: Bytes of a record besides its text.
OVERHEAD = 16

#: Rows that one task puts in order.
ROWS_PER_TASK = 50_000

#: A group of equal texts is spread when it has more bytes than so many average slots.
SLOTS_PER_GROUP = 4


def new_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt in turn, no bytes known."""
    return spark.range(slots).select(
        F.lit(0).cast("long").alias("version"),
        F.col("id").cast("int").alias("virtual_slot"),
        (F.col("id") % shards).cast("int").alias("shard"),
        F.lit(0).cast("long").alias("bytes"),
    )


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map for ``loads (virtual_slot, bytes)`` and a number of shards.

    A shard keeps its largest slots while they fit its fair share. Slots beyond that, and
    those of shards that are no more, move in the order of their bytes to the shard with the
    fewest bytes so far. Everything here has one row per slot or fewer.
    """
    filled = slot_map.drop("bytes").join(F.broadcast(loads), "virtual_slot", "left")
    filled = filled.withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))
    share = filled.agg(F.sum("bytes") / shards).scalar()
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    upto = F.sum("bytes").over(largest.rowsBetween(Window.unboundedPreceding, 0))
    stays = (F.col("shard") < shards) & ((F.col("bytes") == 0) | (upto <= share))
    judged = staged(filled.withColumn("stays", F.coalesce(stays, F.lit(False))))

    kept = judged.where("stays").groupBy("shard").agg(F.sum("bytes").alias("bytes"))
    loaded = judged.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    loaded = loaded.join(kept, "shard", "left").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("shard", F.coalesce("bytes", F.lit(0)).alias("bytes")))),
            lambda s: s["bytes"],
        ).alias("loads")
    )
    loose = judged.where("not stays").agg(
        F.sort_array(
            F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))
        ).alias("loose")
    )

    def move(state: Column, slot: Column) -> Column:
        to = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        after = F.transform(
            state["loads"], lambda have, i: F.when(i == to, have - slot["less"]).otherwise(have)
        )
        moved = F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("to"))
        return F.struct(after.alias("loads"), F.concat(state["moved"], F.array(moved)).alias("moved"))

    start = F.struct("loads", F.array().cast("array<struct<virtual_slot: int, to: int>>").alias("moved"))
    moves = (
        loaded.select("loads", loose.select("loose").scalar().alias("loose"))
        .select(F.explode(F.aggregate("loose", start, move, lambda s: s["moved"])).alias("m"))
        .select("m.*")
    )
    return judged.join(F.broadcast(moves), "virtual_slot", "left").select(
        (F.col("version") + 1).alias("version"),
        "virtual_slot",
        F.coalesce("to", "shard").alias("shard"),
        "bytes",
    )


def save_map(slot_map: DataFrame, path: str) -> None:
    """Adds a version to the stored map; a version is one folder and is never changed.

    A retried write of a version replaces that version alone.
    """
    version = slot_map.agg(F.max("version")).first()[0]
    slot_map.drop("version").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """A version of the stored map, by default the latest; none where no map is stored."""
    kinds = "virtual_slot int, shard int, bytes long, version long"
    try:
        stored = spark.read.schema(kinds).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
        if version is None:
            return None
    return stored.where(F.col("version") == version).select(
        "version", "virtual_slot", "shard", "bytes"
    )


def _records(docs: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("__id"),
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2(whole, 256)).alias("__digest"),
        F.spark_partition_id().alias("__part"),
    )


def _slots(records: DataFrame, slots: int, rows_per_task: int) -> DataFrame:
    """Adds ``virtual_slot`` and a hash ``__place`` that orders the rows of a slot."""
    total = records.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    most = SLOTS_PER_GROUP * total / slots
    hot = (F.sum("size") > most) | (F.count(F.lit(1)) > rows_per_task)

    def hot_groups(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        counted = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), hot.alias(name))
        return staged(counted.where(F.col(name) & (F.col("__n") > 1)).drop("__n"))

    groups = hot_groups(records, ["__digest"], "__group_hot")
    marked = staged(join_small(records, groups, ["__digest"]))
    same = F.xxhash64("__digest")
    cold = marked.where("__group_hot is null").select(
        "*", same.alias("__at"), F.xxhash64("__digest", "__id").alias("__place")
    )

    spread = marked.where("__group_hot").withColumn("__key", F.coalesce(F.col("__id").cast("string"), F.lit("")))
    spread = spread.withColumn("__named", F.col("__id").isNotNull())
    own = ["__digest", "__named", "__key"]
    keys = hot_groups(spread, own, "__key_hot")
    spread = staged(join_small(spread, keys, own))
    by_key = F.xxhash64("__digest", "__id")
    alone = spread.where("__key_hot is null").select("*", by_key.alias("__at"), by_key.alias("__place"))

    # Equal rows are numbered: within a part of the input, after the parts before it.
    equal = spread.where("__key_hot")
    by_part = Window.partitionBy(*own).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        equal.groupBy(*own, "__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*own, "__part", F.coalesce(F.sum("__n").over(by_part), F.lit(0)).alias("__before"))
    )
    in_part = F.row_number().over(Window.partitionBy(*own, "__part").orderBy("size"))
    numbered = equal.withColumn("__own", in_part).join(before, [*own, "__part"])
    by_number = F.xxhash64("__digest", "__id", F.col("__own") + F.col("__before"))
    numbered = numbered.select("*", by_number.alias("__at"), by_number.alias("__place"))

    columns = [*records.columns, "__at", "__place"]
    all_ = cold.select(columns).unionByName(alone.select(columns)).unionByName(numbered.select(columns))
    return all_.withColumn("virtual_slot", F.pmod("__at", F.lit(slots)).cast("int")).drop("__at")


def place(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shards: int = SHARDS,
    slots: int = SLOTS,
    maps: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.

    The law is ``bytes``: shards have nearly equal sums of size. ``slot`` is a record's
    place in its shard, gapless from 0; ``virtual_slot`` is what the map is about. ``maps``
    is the folder of a stored map, whose latest version is edited and saved as the next; a
    folder without one, or none, starts a new map.

    A null text has no bytes and is equal to an empty one. Null keys are keys like any other;
    repeated rows are placed one by one. A record larger than a shard's share has a shard
    that is above it. Other columns do not matter; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = maps or shared_folder(spark)
    records = staged(_records(docs, key, text))
    placed = staged(_slots(records, slots, rows_per_task))
    old = load_map(spark, path)
    if old is None:
        old = new_map(spark, shards, slots)
        save_map(old, path)
    loads = staged(placed.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")))
    save_map(rebalanced(old, loads, shards), path)
    now = load_map(spark, path)

    # Rows of a slot are put in order in pieces, so that no task has more than its share.
    pieces = F.lit(-(-placed.count() // (slots * rows_per_task)) or 1)
    piece = F.pmod(F.xxhash64("__place", F.lit(1)), pieces).cast("int")
    pieced = placed.withColumn("piece", piece)
    counts = pieced.groupBy("virtual_slot", "piece").agg(F.count(F.lit(1)).alias("__n"))
    in_shard = Window.partitionBy("shard").orderBy("virtual_slot", "piece")
    before = F.sum("__n").over(in_shard.rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(
        counts.join(F.broadcast(now.select("virtual_slot", "shard", "version")), "virtual_slot").select(
            "virtual_slot", "piece", "shard", "version", F.coalesce(before, F.lit(0)).alias("start")
        )
    )
    order = Window.partitionBy("virtual_slot", "piece").orderBy("__place", "__id", "text_crc32")
    own = pieced.withColumn("own", F.row_number().over(order) - 1)
    return join_small(own, starts, ["virtual_slot", "piece"], "inner").select(
        F.col("__id").alias(key),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("own")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.col("version").alias("map_version"),
    )

