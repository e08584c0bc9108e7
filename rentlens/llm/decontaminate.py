"""Benchmark decontamination by winnowing: fingerprints, their join, exact windows.

Everything is a column expression or a join. Of every run of consecutive k-gram hashes the
smallest is kept, in documents and benchmark alike. Runs are so long that any shared window
holds a whole run, so both sides keep a common hash; a hit is then extended to the windows
around it, and these are compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import BROADCAST_ROWS, lower_az, shielded, staged

WINDOW = 10
GRAM = 5

#: Characters between words, after A-Z became a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A kept hash and its place in one number: 32 bits of the hash above 31 bits of the place.
PLACE_BITS = 31


def item_words(text: Column) -> Column:
    """Words of a whole text in order; null has none."""
    parts = F.split(lower_az(F.coalesce(text, F.lit(""))), BETWEEN)
    return F.filter(parts, lambda w: w != "")


def _numbers(last: Column) -> Column:
    """0 .. last, and nothing where that is below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _hash(words: Column, start: Column, n: int) -> Column:
    return F.xxhash64(F.slice(words, start + 1, n)).bitwiseAND(F.lit(0xFFFFFFFF))


def with_kept_hashes(df: DataFrame, lengths: list[int], gram: int, run: int | None) -> DataFrame:
    """Adds ``kept``: ``struct(gram, hash, place)`` of the winnowed k-grams of ``words``.

    Ties keep the leftmost. For lengths below a k-gram every n-gram is kept. The hashes are
    a column of their own, as an expression used inside a lambda is computed per element.
    """
    short = [n for n in lengths if n < gram]
    columns = {f"__keyed{n}": _keyed(n) for n in [*short, *([gram] if run else [])]}
    hashed = df.select("*", *[c.alias(n) for n, c in columns.items()])
    none = F.array().cast("array<struct<gram:int,hash:bigint,place:int>>")
    kept = [_unpacked(F.col(f"__keyed{n}"), n) for n in short]
    if run:
        keyed = f"__keyed{gram}"
        starts = _numbers(F.size(keyed) - run)
        lowest = F.array_distinct(
            F.transform(starts, lambda i: F.array_min(F.slice(keyed, i + 1, run)))
        )
        kept.append(_unpacked(lowest, gram))
    return hashed.withColumn("kept", F.concat(none, *kept)).drop(*columns)


def _keyed(n: int) -> Column:
    words = F.col("words")
    return F.transform(
        _numbers(F.size(words) - n),
        lambda i: F.shiftleft(_hash(words, i, n), PLACE_BITS).bitwiseOR(i.cast("long")),
    )


def _unpacked(packed: Column, n: int) -> Column:
    return F.transform(
        packed,
        lambda x: F.struct(
            F.lit(n).alias("gram"),
            F.shiftright(x, PLACE_BITS).alias("hash"),
            x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int").alias("place"),
        ),
    )


class Benchmark:
    """Staged tables of the benchmark: windows, their items, fingerprints, and lengths."""

    def __init__(self, items: DataFrame, key: str, text: str, window: int, gram: int):
        if gram < 1 or window < gram:
            raise ValueError("a window holds one k-gram at least")
        base = items.select(F.col(key).alias("item"), item_words(F.col(text)).alias("words"))
        base = staged(base.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window))))
        self.lengths = sorted(r["length"] for r in base.select("length").distinct().collect())
        long = [n for n in self.lengths if n >= gram]
        self.gram, self.window = gram, window
        # The shortest window that is long enough for k-grams fixes the run.
        self.run = min(long) - gram + 1 if long else None
        starts = F.explode(_numbers(F.size("words") - F.col("length")))
        windows = base.select("item", "words", "length", starts.alias("i")).select(
            "item", F.expr("array_join(slice(words, i + 1, length), ' ')").alias("window")
        ).distinct()
        # Windows that occur in the same items share a set, so a document lists each set once.
        sets = windows.groupBy("window").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
        sets = staged(sets.withColumn("items_id", F.sha2(F.to_json("items").cast("binary"), 256)))
        self.windows = sets.select("window", "items_id")
        self.items = staged(sets.groupBy("items_id").agg(F.first("items").alias("items")))
        self.hashes = staged(
            # Outer: the filter that a plain explode adds would compute the hashes over again.
            self.with_hashes(base).select(F.explode_outer("kept").alias("h"))
            .where("h is not null").select("h.gram", "h.hash").distinct()
        )

    def with_hashes(self, df: DataFrame) -> DataFrame:
        """``kept``: hashes for windows of one k-gram at least, every n-gram of shorter ones."""
        return with_kept_hashes(df, self.lengths, self.gram, self.run)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= rows else df


def mark(
    docs: DataFrame,
    items: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words; items without words have no window; items with a
    null key count as hits but are not listed; repeated rows stay repeated; empty tables on
    either side are served. The benchmark side is broadcast only when it was counted and has
    at most ``broadcast_rows`` rows; a larger one is joined by a shuffle.
    """
    bench = Benchmark(items, item_key, item_text, window, gram)
    reach = window - gram
    words = F.col("words")

    # The words around a kept hash are all that the windows over it can hold.
    def around(h: Column) -> Column:
        begin = F.greatest(h["place"] - reach, F.lit(0))
        return F.struct(
            h["gram"].alias("gram"),
            h["hash"].alias("hash"),
            h["place"].alias("place"),
            F.slice(words, begin + 1, reach + window).alias("near"),
        )

    worded = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), item_words(F.col(text)).alias("words")
    )
    # Counted before the rows are spread, which then carry no array of words.
    counted = bench.with_hashes(worded.withColumn("n_words", F.size("words").cast("long")))
    spread = counted.select("row", "key", "n_words", F.transform("kept", around).alias("hits")).select(
        "row", "key", "n_words", F.posexplode_outer("hits").alias("nth", "h")
    ).select("row", "key", "n_words", "nth", "h.*")
    known = bench.hashes.withColumn("hit", F.lit(True))
    met = spread.join(_small(known, broadcast_rows), ["gram", "hash"], "left")
    first = F.coalesce(F.col("nth") == 0, F.lit(True))
    stage = staged(
        met.where(first | F.col("hit")).select(
            "row", "key", "n_words", first.alias("first"),
            F.when(F.col("hit"), F.struct("gram", "place", "near")).alias("h"),
        )
    )
    hits = _windows(stage, bench, broadcast_rows)
    rows = stage.where("first").select("row", "key", "n_words")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return (
        rows.join(hits, "row", "left")
        .select(
            F.col("key").alias(key),
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
            F.coalesce("items_sha256", none).alias("items_sha256"),
            F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def _windows(stage: DataFrame, bench: Benchmark, broadcast_rows: int) -> DataFrame:
    """``row, n_hit, n_items, items_sha256`` of the rows with an exact window."""
    reach = bench.window - bench.gram
    found = stage.where("h is not null").select("row", "h.*")
    begin = F.greatest(F.col("place") - reach, F.lit(0))

    def tried_windows(n: int) -> Column:
        """All windows of ``n`` words over the hit that the words around it hold."""
        short = n < bench.gram
        low = F.col("place") if short else F.greatest(F.col("place") - (n - bench.gram), F.lit(0))
        starts = F.when(F.col("gram") == min(n, bench.gram), F.sequence(low, F.col("place")))
        return F.transform(
            F.filter(starts, lambda s: s - begin + n <= F.size("near")),
            lambda s: F.struct(
                s.alias("start"),
                (s + n).alias("end"),
                F.array_join(F.slice("near", s - begin + 1, n), " ").alias("window"),
            ),
        )

    none = F.array().cast("array<struct<start:int,end:int,window:string>>")
    spans = F.concat(none, *[F.coalesce(tried_windows(n), none) for n in bench.lengths])
    tried = found.select("row", F.explode(spans).alias("w")).select("row", "w.*").distinct()
    exact = tried.join(_small(bench.windows, broadcast_rows), "window")

    # Words in the union of the spans, which are ordered by their start.
    def step(acc: Column, s: Column) -> Column:
        more = F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))
        return F.struct(
            (acc["n"] + more).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")
        )

    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    by_row = exact.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"),
        F.collect_set("items_id").alias("sets"),
    )
    by_row = staged(
        by_row.select("row", F.aggregate("spans", zero, step, lambda a: a["n"]).cast("long").alias("n_hit"), "sets")
    )
    listed = (
        by_row.select("row", F.explode("sets").alias("items_id"))
        .join(_small(bench.items, broadcast_rows), "items_id")
        .select("row", F.explode("items").alias("item"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select(
            "row", F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        )
    )
    return by_row.select("row", "n_hit").join(listed, "row", "left")


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents without any benchmark window, all columns and repeated rows kept.

    Contamination depends on the text alone, so marked texts are found by their digest.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    digests = docs.select(digest.alias("__digest"), F.col(text).alias("text"))
    marked = mark(digests, items, key="__digest", **options)
    found = _small(staged(marked.where("contaminated").select("__digest").distinct()), BROADCAST_ROWS)

    def kept(plain: DataFrame) -> DataFrame:
        return plain.withColumn("__digest", digest).join(found, "__digest", "left_anti").drop("__digest")

    return shielded(docs, [text], kept)
