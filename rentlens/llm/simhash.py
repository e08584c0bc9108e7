"""SimHash near-duplicates: deletion-variant index, links, groups.

Two 64-bit fingerprints within two bits are cut into two segments of 32 bits, so at least
one segment differs in one bit or none. The index holds every distinct segment once as it
is, and once per bit with that bit as a wildcard; equal keys meet, and the whole
fingerprints are compared. A segment that very many fingerprints share is not paired out:
its members are indexed by the whole fingerprint with two wildcards instead, where at most
four fingerprints can share a key, so the way is exact and bounded for any group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.llm.common import row_digest, shielded, staged
from rentlens.llm.components import components

SHINGLE, BITS, SEED = 3, 2, 42

#: Most fingerprints of one segment that are compared pair by pair.
BUCKET = 128

BLOCK = 1 << 16


def fingerprint_of(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, as a signed 64-bit number.

    A bit is set if it is set in over half of the XXH64 values. No words (null and blank
    texts): zero. Fewer words than a shingle: one shingle of all words.
    """
    found = (text or b"").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= shingle:
        starts, ends = [0], [len(joined)]
    else:
        stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], stops[:-shingle] + 1)).tolist()
        ends = stops[shingle - 1 :].tolist()
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends)),
        np.uint64,
        len(starts),
    )
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Fingerprint column of whole texts, computed in Arrow batches."""

    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint_of(t, shingle) for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(batch, T.LongType())(text.cast("binary"))


def _segments(nodes: DataFrame) -> DataFrame:
    high = F.struct(F.lit(0).alias("part"), F.shiftrightunsigned("fp", 32).alias("seg"))
    low = F.struct(F.lit(1).alias("part"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("seg"))
    return nodes.select("fp", F.explode(F.array(high, low)).alias("s")).select("fp", "s.*")


def _variants(segments: DataFrame) -> DataFrame:
    """Segments that differ in exactly one bit: ``part, seg, other``, both ways round.

    A one-wildcard key holds two segments at most, with the bit clear and set, so keys that
    occur twice are the pairs.
    """
    keyed = segments.select(
        "part", "seg", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("bit")
    ).select(
        "part", "bit", F.col("seg").bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, bit)"))).alias("key")
    )
    twice = keyed.groupBy("part", "bit", "key").count().where("count = 2")
    clear, set_ = F.col("key"), F.expr("key | shiftleft(1L, bit)")
    ways = F.array(
        F.struct(clear.alias("seg"), set_.alias("other")), F.struct(set_.alias("seg"), clear.alias("other"))
    )
    return twice.select("part", F.explode(ways).alias("w")).select("part", "w.*")


def _within(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def _two_wildcards(members: DataFrame) -> DataFrame:
    """Links between members within two bits, to the smallest of each key."""
    pairs = F.expr(
        "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63),"
        " j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    )
    keyed = members.select("fp", F.explode(pairs).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("key")
    )
    # At most four fingerprints agree on all other bits.
    met = keyed.groupBy("mask", "key").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")


def links(nodes: DataFrame, bits: int = BITS, bucket: int = BUCKET) -> DataFrame:
    """``(a, b)`` over distinct fingerprints ``fp``; pairs within ``bits`` (at most 2).

    Pairs that share a crowded segment are linked through the smallest fingerprint of a
    two-wildcard key, which connects the same fingerprints.
    """
    if not 0 <= bits <= 2:
        raise ValueError("two segments and two wildcards serve at most two bits")
    members = _segments(nodes)
    counts = staged(members.groupBy("part", "seg").agg(F.count(F.lit(1)).alias("n")))
    near = _variants(counts)
    sized = near.join(counts, ["part", "seg"]).join(
        counts.select("part", F.col("seg").alias("other"), F.col("n").alias("m")), ["part", "other"]
    )
    sized = staged(sized)
    crowded = (
        counts.where(F.col("n") > bucket)
        .select("part", "seg")
        .union(sized.where(F.col("n") * F.col("m") > bucket * bucket).select("part", "seg"))
        .distinct()
    )
    open_exact = counts.where(F.col("n").between(2, bucket)).select("part", "seg")
    shared = members.join(open_exact, ["part", "seg"])
    exact = shared.select("part", "seg", F.col("fp").alias("a")).join(
        shared.select("part", "seg", F.col("fp").alias("b")), ["part", "seg"]
    ).where((F.col("a") < F.col("b")) & _within("a", "b", bits))
    open_near = sized.where((F.col("seg") < F.col("other")) & (F.col("n") * F.col("m") <= bucket * bucket))
    wild = (
        open_near.select("part", "seg", "other")
        .join(members.withColumnRenamed("fp", "a"), ["part", "seg"])
        .join(members.select("part", F.col("seg").alias("other"), F.col("fp").alias("b")), ["part", "other"])
        .where(_within("a", "b", bits))
    )
    found = exact.select("a", "b").union(wild.select("a", "b"))
    hot = members.join(crowded, ["part", "seg"], "left_semi").select("fp").distinct()
    far = _two_wildcards(hot).where(_within("a", "b", bits)) if bits == 2 else _one_wildcard(hot)
    return found.union(far.select("a", "b")).distinct()


def _one_wildcard(members: DataFrame) -> DataFrame:
    keyed = members.select(
        "fp", F.explode(F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))")).alias("mask")
    ).select("fp", "mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("key"))
    met = keyed.groupBy("mask", "key").agg(F.collect_set("fp").alias("all")).where("size(all) > 1")
    return met.select(F.array_min("all").alias("a"), F.array_max("all").alias("b"))


def groups(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    bits: int = BITS,
    digest: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The stage table ``(key, fp)``, with ``row_hash`` if asked, and ``(fp, root, component_id)``.

    ``component_id`` is the smallest key reachable; null keys do not count, and a group of
    null keys only has a null one.
    """
    rows = staged(
        docs.select(
            F.col(key).alias("key"),
            fingerprint(F.col(text), shingle).alias("fp"),
            *([row_digest(docs).alias("row_hash")] if digest else []),
        )
    )
    nodes = staged(rows.groupBy("fp").agg(F.min("key").alias("least")))
    roots = components(links(nodes.select("fp"), bits)).select(F.col("node").alias("fp"), "root")
    placed = staged(
        nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows, staged(placed.join(smallest, "root").select("fp", "root", "component_id"))


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS
) -> DataFrame:
    """One row per document: key, fingerprint in hex, component_id.

    Null and empty texts have fingerprint zero and are linked like any other; repeated rows
    stay repeated; an empty table gives an empty result; other columns do not matter.
    """
    rows, found = groups(docs, key=key, text=text, shingle=shingle, bits=bits)
    return rows.join(found, "fp").select(
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS
) -> DataFrame:
    """The documents left when each group keeps one: its smallest key, null keys last.

    Among rows with the same key the smallest row hash stays, and of rows that are the same
    in every column one.
    """
    return shielded(docs, [key, text], lambda plain: _first_of_each(plain, key, text, shingle, bits))


def _first_of_each(docs: DataFrame, key: str, text: str, shingle: int, bits: int) -> DataFrame:
    rows, found = groups(docs, key=key, text=text, shingle=shingle, bits=bits, digest=True)
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row_hash")
    rooted = rows.join(found.select("fp", "root"), "fp")
    best = rooted.groupBy("root").agg(F.min(order).alias("best"), F.count(F.lit(1)).alias("n"))
    chosen = staged(best.select(F.col("best.row_hash").alias("__hash")))
    kept = docs.withColumn("__hash", row_digest(docs)).join(chosen, "__hash", "left_semi")
    # Rows that repeat in every column would all be chosen.
    copies = staged(
        rows.withColumnRenamed("row_hash", "__hash")
        .join(chosen, "__hash", "left_semi")
        .groupBy("__hash")
        .count()
        .where("count > 1")
        .select("__hash")
    )
    single = kept.join(copies, "__hash", "left_anti").select(docs.columns)
    repeated = kept.join(copies, "__hash", "left_semi")
    first = repeated.groupBy("__hash").agg(*[F.first(c).alias(c) for c in docs.columns])
    return single.unionByName(first.select(docs.columns))
