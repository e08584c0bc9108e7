"""Language-model scores of whole documents: corpus counts and a gated recurrent model.

Word counts cover every training document and stay distributed. The most frequent words form
the model's vocabulary; all others share one output class, within which their corpus counts
tell them apart, so the model gives every word a probability. Training takes every training
document once, in rounds of growing size: each partition learns on its own documents from
the common weights, and the weights are averaged by tokens after each round.

The log counts of a document come from a dictionary of the frequent words inside the scoring
tasks; only words beyond it, which are rare and hence not skewed, go through a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import staged
from rentlens.llm.gru import Gru, Trainer, score

#: Words with an output of their own.
MODEL_WORDS = 512

#: Most words whose counts are sent to the tasks.
DICTIONARY_WORDS = 1 << 18

#: The end of a text; blanks cannot be in a word.
END = b"\n"

#: Parts of 16 of the training documents that each round takes.
ROUNDS = ((0, 1), (1, 4), (4, 16))

#: Tokens that are held before a call of the model, and words before counts are passed on.
TOKEN_BUFFER, WORD_BUFFER = 4_000_000, 250_000

#: Steps of counts, as a ratio, by which the dictionary is cut.
COUNT_STEPS = 64


def tokens(text: bytes | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII blanks."""
    return (text or b"").lower().split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = pa.array(list(seen), pa.binary())
        return pa.RecordBatch.from_arrays(
            [words, pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(tokens(text))
            seen[END] += 1
            if len(seen) > WORD_BUFFER:
                yield out()
                seen.clear()
    if seen:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts, ends included; counted in the tasks before the shuffle."""
    found = texts.select(F.col("text").cast("binary")).mapInArrow(_count, "word binary, n long")
    return staged(found.groupBy("word").agg(F.sum("n").alias("n")))


def dictionary(counts: DataFrame, most: int = DICTIONARY_WORDS) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words, most frequent first, equal ones by their letters.

    Steps of counts are taken whole while they fit, and the one that does not is cut by the
    same order, so as many words as may be are in it whatever the counts are.
    """
    words = counts.where(F.col("word") != F.lit(END))
    step = F.floor(F.log("n") * COUNT_STEPS).cast("int")
    lowest, total = None, 0
    for row in sorted(words.groupBy(step.alias("step")).count().collect(), reverse=True):
        lowest = row["step"]
        if total + row["count"] > most:
            break
        total, lowest = total + row["count"], lowest - 1
    if lowest is None:
        return []
    whole = words.where(step > lowest)
    part = words.where(step == lowest).orderBy(F.col("n").desc(), "word").limit(max(0, most - total))
    rows = whole.union(part).collect()
    return sorted(((bytes(r["word"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _learner(flat, model: Gru, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.with_flat(flat.value)
        ids = {w: i for i, w in enumerate(words.value[: own.words])}
        trainer, learned, held, texts = Trainer(own), 0, 0, []
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = tokens(text)
                texts.append(np.fromiter(map(ids.get, found, repeat(own.other)), np.int32, len(found)))
                held += len(found)
                if held > TOKEN_BUFFER:
                    learned += trainer.learn(texts)
                    held, texts = 0, []
        if texts:
            learned += trainer.learn(texts)
        if learned:
            weighted = own.flat().astype(np.float64) * learned
            yield _weights(learned, weighted)

    return run


def _weights(learned: int, weighted: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([learned], pa.int64()), pa.array([weighted.tobytes()], pa.binary())],
        names=["learned", "weighted"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learned, total = 0, None
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            learned, part = learned + n, np.frombuffer(raw)
            total = part.copy() if total is None else total + part
    if learned:
        yield _weights(learned, total)


def trained(texts: DataFrame, model: Gru, words) -> Gru:
    """Rounds of local training and averaging over all texts.

    The weights of the partitions are added in a tree, so the driver gets a few rows of the
    fixed size of the model.
    """
    context = texts.sparkSession.sparkContext
    sliced = texts.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(ROUNDS[-1][1])))
    kind = "learned long, weighted binary"
    for first, last in ROUNDS:
        flat = context.broadcast(model.flat())
        chosen = sliced.where((F.col("part") >= first) & (F.col("part") < last))
        local = chosen.select(F.col("text").cast("binary")).mapInArrow(_learner(flat, model, words), kind)
        local = staged(local)
        rows = local.count()
        while rows > 8:
            rows = math.ceil(rows / 8)
            local = staged(local.repartition(rows).mapInArrow(_add, kind))
        sums = local.collect()
        learned = sum(r["learned"] for r in sums)
        if learned:
            total = sum(np.frombuffer(r["weighted"]) for r in sums)
            model = model.with_flat(total / learned)
    return model


RARE = "array<struct<word:binary,n:bigint>>"
SCORED = f"key long, held_out boolean, n_tokens long, n_known long, known double, other double, n_other long, ids double, rare {RARE}"


def _scorer(flat, model: Gru, words, counts, end_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.with_flat(flat.value)
        ranks = {w: i for i, w in enumerate(words.value)}
        logs = np.log10(np.append(counts.value, 0).astype(np.float64) + 1)
        end_log = math.log10(end_count + 1)
        rows, texts, held = [], [], 0

        def out() -> pa.RecordBatch:
            ids = score(own, texts)
            names = ["key", "held_out", "n_tokens", "n_known", "known", "other", "n_other"]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            rare = [r[-1] for r in rows]
            flat_words = pa.array([w for c in rare for w in c], pa.binary())
            flat_counts = pa.array([n for c in rare for n in c.values()], pa.int64())
            starts = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                starts, pa.StructArray.from_arrays([flat_words, flat_counts], ["word", "n"])
            )
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(ids, pa.float64()), lists], names=[*names, "ids", "rare"]
            )

        for batch in batches:
            for key, held_out, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = tokens(text)
                rank = np.fromiter(map(ranks.get, found, repeat(-1)), np.int64, len(found))
                rare = Counter(found[i] for i in np.flatnonzero(rank < 0).tolist())
                known = logs[rank]
                beyond = rank >= own.words
                n_rare = int((rank < 0).sum())
                rows.append((
                    key, held_out, len(found) + 1, len(found) - n_rare + (end_count > 0),
                    float(known.sum()) + end_log, float(known[beyond].sum()),
                    int(beyond.sum()) + n_rare, rare,
                ))
                texts.append(np.where((rank < 0) | beyond, own.other, rank).astype(np.int32))
                held += len(found) + 1
                if held > TOKEN_BUFFER:
                    yield out()
                    rows, texts, held = [], [], 0
        if rows:
            yield out()

    return run


def held_out(key: Column) -> Column:
    """crc32 of the key as text leaves 2 when divided by 7; a null key counts as no text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", model_words: int = MODEL_WORDS
) -> DataFrame:
    """One row per document: counts, log10 probability by word counts, and by the model.

    Null texts are empty: one end token. Repeated rows stay repeated and count each. Without
    training documents all words are unknown. An empty table gives an empty result; columns
    other than key and text do not matter.
    """
    context = docs.sparkSession.sparkContext
    plain = docs.select(
        F.col(key).cast("long").alias("key"),
        held_out(F.col(key)).alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    training = plain.where("not held_out").select("text")
    counts = word_counts(training)
    is_end = F.col("word") == F.lit(END)
    sums = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count("n").alias("v"),
        F.coalesce(F.sum(F.when(is_end, F.col("n"))), F.lit(0)).alias("ends"),
    ).first()
    frequent = dictionary(counts)
    own = frequent[:model_words]
    own_tokens = sum(n for _, n in own)
    other_tokens, other_words = sums["n"] - sums["ends"] - own_tokens, max(0, sums["v"] - 1 - len(own))
    start = np.array([*(n for _, n in own), sums["ends"], other_tokens], np.float64)
    words = context.broadcast([w for w, _ in frequent])
    numbers = context.broadcast(np.array([n for _, n in frequent], np.int64))
    model = trained(training, Gru.fresh(start), words)
    flat = context.broadcast(model.flat())
    scored = plain.select("key", "held_out", F.col("text").cast("binary").alias("text")).mapInArrow(
        _scorer(flat, model, words, numbers, sums["ends"]), SCORED
    )
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()))
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.*")
    looked_up = rare.join(counts.withColumnRenamed("n", "c"), "word", "left")
    by_row = looked_up.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"),
    )
    base_room = math.log10(sums["n"] + sums["v"] + 1)
    other_room = math.log10(other_tokens + other_words + 1)
    joined = scored.drop("rare").join(by_row, "row", "left").fillna({"rare_known": 0, "rare_log": 0.0})
    return joined.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(sums["n"]).cast("long").alias("train_tokens"),
        (F.col("known") + F.col("rare_log") - F.col("n_tokens") * base_room).alias("base_score"),
        (
            F.col("ids") / math.log(10)
            + F.col("other")
            + F.col("rare_log")
            - F.col("n_other") * other_room
        ).alias("score"),
    )
