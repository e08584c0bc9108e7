"""Secret scans: exact patterns, and character Markov models for strings without a pattern.

Everything is a column expression. Two order-1 models over folded characters, one of random
strings and one of ordinary identifiers, score every long run of token characters between the
exact matches, whole and by its best stretches; the sum of log ratios is a likelihood ratio, so
from each of its characters on an ordinary identifier passes a threshold ``t`` with probability
``exp(-t)`` at most under its own model. The labelled samples come from the
documents: distinct strings found by the exact patterns are random, each kind with the same
weight beside a fixed share of uniform strings; the words of a bounded sample of documents are
ordinary.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentlens.llm.common import drawn, lower_az, shielded

# The keywords and patterns of the contract.
KEYWORDS = ["password", "passwd", "secret", "token", "api_?key"]
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = (
    "(" + "|".join(_either_case(w) for w in KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# A run is a hex match only from 32 on, and runs cannot overlap: the bound may be in the pattern.
LONG_HEX = rf"[0-9a-f]{{{LEAST_HEX},}}"

#: Kinds in the order of the report.
KINDS = ["assign", "access", "hex", "model"]

#: Characters of the models, upper case folded; 0 stands for the start of a run.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1

#: Shortest run that the models judge, and how often an ordinary one may pass, by its whole
#: length or from any one of its characters on.
LEAST_RUN = 20
FALSE_RATE = 1e-9
RUN = rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}"
#: A stretch of a run is taken to the nearest separators on both sides.
UNCUT, SEPARATORS = "^[^/_=-]*", "^[/_=-]*"

#: About so many documents are drawn, by a hash, to learn ordinary identifiers from.
SAMPLE_DOCS = 2000
ORDINARY = r"[A-Za-z0-9_]*[A-Za-z][A-Za-z0-9_]+"

#: Share of the uniform part in each state of the random model, at every size of the corpus,
#: and weight of a uniform prior in each state of the ordinary one.
UNIFORM_SHARE, ORDINARY_PRIOR = 0.8, 0.5

SPAN = "array<struct<start:int,rank:int,end:int>>"
PARTS = "array<struct<low:int,high:int>>"


def _placed(
    text: Column, pattern: str, rank: int, keep: Column | None = None, inside: Column | None = None
) -> Column:
    """Spans of all matches, from the lengths of the matches and of the text between them.

    ``keep``: an array of booleans, one for each match, that says which ones stay. ``inside``:
    instead, an array of the parts ``(low, high)`` of each match that are spans.
    """
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    if inside is None:
        flags = F.transform(hits, lambda _: F.lit(True)) if keep is None else keep
        whole = F.zip_with(hits, flags, lambda h, k: F.when(
            k, F.array(F.struct(F.lit(0).alias("low"), h.alias("high")))
        ).otherwise(F.array().cast(PARTS)))
    parts = F.zip_with(F.arrays_zip(hits.alias("hit"), (whole if inside is None else inside).alias("inside")), gaps, lambda m, g: F.struct(
        g.alias("gap"), m["hit"].alias("hit"), m["inside"].alias("inside")
    ))
    # The text after the last match has no match of its own.
    parts = F.filter(parts, lambda p: p["hit"].isNotNull())
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["pos"] + p["gap"]
        end = begin + p["hit"]
        own = F.transform(p["inside"], lambda x: F.struct(
            (begin + x["low"]).alias("start"), F.lit(rank).alias("rank"), (begin + x["high"]).alias("end")
        ))
        return F.struct(end.alias("pos"), F.concat(acc["spans"], own).alias("spans"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def _longer(text: Column, pattern: str, group: int, least: int) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.length(v) >= least
    )


def with_base_spans(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``__assign``, ``__access`` and ``__hex``: spans of the exact patterns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns(
        {
            "__assign": _placed(whole, ASSIGN, 0, _longer(whole, ASSIGN, 2, LEAST_VALUE)),
            "__access": _placed(whole, ACCESS, 1, _longer(whole, ACCESS, 0, LEAST_ACCESS)),
            "__hex": _placed(whole, LONG_HEX, 2),
        }
    )


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of ``(state, next)`` by ``kind`` over folded strings ``s``: at most 42 x 41 rows a kind."""
    pair = F.expr(
        "transform(sequence(1, length(s)), i -> struct("
        f"if(i = 1, 0, instr('{ALPHABET}', substr(s, i - 1, 1))) AS a,"
        f" instr('{ALPHABET}', substr(s, i, 1)) AS b))"
    )
    return (
        strings.where(F.length("s") > 0)
        .select("kind", F.explode(pair).alias("p"))
        .groupBy("kind", "p.a", "p.b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _logs(counts: dict[tuple[int, int], int], prior: float) -> list[list[float]]:
    out = []
    for a in range(STATES):
        row = [counts.get((a, b), 0) + prior for b in range(1, STATES)]
        out.append([math.log(x / sum(row)) for x in row])
    return out


def _mixed_logs(kinds: list[dict[tuple[int, int], int]], uniform: float) -> list[list[float]]:
    """Logs of a mixture: every kind weighs the same, ``uniform`` is the uniform share of a state."""
    sums = [sum(counts.values()) for counts in kinds]
    out = []
    for a in range(STATES):
        row = [sum(c.get((a, b), 0) / n for c, n in zip(kinds, sums) if n) for b in range(1, STATES)]
        total = sum(row)
        even = 1 / len(row)
        out.append([math.log(uniform * even + (1 - uniform) * (x / total if total else even)) for x in row])
    return out


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log ratios random / ordinary of every ``(state, next)``, row by row.

    Random strings: every distinct string in ``docs`` that an exact pattern found, so copies
    and the size of the corpus do not shift the model. Ordinary ones: the identifiers of about
    ``sample_docs`` documents, with those strings taken out. Without any label the uniform
    part and the prior remain. Only the counts of character pairs reach the driver.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(whole.alias("t"))

    def found(kind: str, pattern: str, group: int) -> Column:
        strings = F.regexp_extract_all("t", F.lit(pattern), F.lit(group))
        return F.transform(strings, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))

    values = F.concat(found("assign", ASSIGN, 2), found("access", ACCESS, 0), found("hex", LONG_HEX, 0))
    labelled = (
        texts.where(F.col("t").rlike(ASSIGN) | F.col("t").rlike(ACCESS) | F.col("t").rlike(LONG_HEX))
        .select(F.explode(values).alias("v"))
        .select("v.kind", "v.s")
        .where(F.length("s") >= LEAST_VALUE)
        .select("kind", F.regexp_replace(lower_az(F.col("s")), r"[^a-z0-9+/_=-]", "").alias("s"))
        .distinct()
    )
    rate = min(1.0, sample_docs / max(1, docs.count()))
    some = texts.where(drawn("t", rate))
    cleaned = "t"
    for pattern in (ASSIGN, ACCESS, LONG_HEX):
        cleaned = F.regexp_replace(cleaned, pattern, " ")
    ordinary = (
        some.select(cleaned.alias("t"))
        .select(F.explode(F.regexp_extract_all("t", F.lit(ORDINARY), F.lit(0))).alias("s"))
        .select(F.lit("ordinary").alias("kind"), lower_az(F.col("s")).alias("s"))
    )
    counts: dict[str, dict[tuple[int, int], int]] = {k: {} for k in [*KINDS[:3], "ordinary"]}
    for r in _pairs(labelled).union(_pairs(ordinary)).collect():
        counts[r["kind"]][r["a"], r["b"]] = r["n"]
    random = _mixed_logs([counts[k] for k in KINDS[:3]], UNIFORM_SHARE)
    plain = _logs(counts["ordinary"], ORDINARY_PRIOR)
    return [x - y for a, b in zip(random, plain) for x, y in zip(a, b)]


def random_parts(run: Column, ratios: list[float], least: float) -> Column:
    """Parts ``(low, high)`` of a run of token characters that the models call random.

    The whole run if its sum of log ratios reaches ``least``; else every stretch whose sum
    does, by a running sum that starts anew below 0 and after a fall of ``least`` from its
    peak, so no stretch is lost to ordinary text before, between or behind. A stretch is
    taken to the nearest separators and counts from ``LEAST_RUN`` characters on.
    """
    table = F.split(F.lit(",".join(f"{x:.9g}" for x in ratios)), ",").cast("array<double>")
    letters = F.filter(F.split(lower_az(run), ""), lambda c: c != "")
    codes = F.transform(letters, lambda c: F.instr(F.lit(ALPHABET), c))
    width = STATES - 1

    def add(acc: Column, code: Column) -> Column:
        gain = F.element_at(table, acc["last"] * width + code)
        return F.struct((acc["sum"] + gain).alias("sum"), code.alias("last"))

    total = F.aggregate(codes, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("last")), add, lambda acc: acc["sum"])

    none = F.array().cast(PARTS)

    def ended(acc: Column) -> Column:
        part = F.array(F.struct(acc["low"].alias("low"), acc["high"].alias("high")))
        return F.when(acc["peak"] >= least, F.concat(acc["parts"], part)).otherwise(acc["parts"])

    def step(acc: Column, code: Column) -> Column:
        now = acc["sum"] + F.element_at(table, acc["last"] * width + code)
        pos = acc["pos"] + 1
        over = (now <= 0) | ((acc["peak"] >= least) & (now <= acc["peak"] - least))
        higher = now > acc["peak"]
        return F.struct(
            F.when(over, 0.0).otherwise(now).alias("sum"),
            code.alias("last"),
            pos.alias("pos"),
            F.when(over, pos).otherwise(acc["low"]).alias("low"),
            F.when(over, 0.0).when(higher, now).otherwise(acc["peak"]).alias("peak"),
            F.when(over | higher, pos).otherwise(acc["high"]).alias("high"),
            F.when(over, ended(acc)).otherwise(acc["parts"]).alias("parts"),
        )

    zero = F.lit(0)
    first = F.struct(
        F.lit(0.0).alias("sum"), zero.alias("last"), zero.alias("pos"), zero.alias("low"),
        F.lit(0.0).alias("peak"), zero.alias("high"), none.alias("parts"),
    )
    stretches = F.aggregate(codes, first, step, ended)

    def bare(part: Column) -> Column:
        own = F.substr(run, part["low"] + 1, part["high"] - part["low"])
        return F.struct(
            (part["low"] + F.length(F.regexp_extract(own, SEPARATORS, 0))).alias("low"),
            (part["high"] - F.length(F.regexp_extract(F.reverse(own), SEPARATORS, 0))).alias("high"),
        )

    def uncut(part: Column) -> Column:
        before = F.reverse(F.substr(run, F.lit(1), part["low"]))
        behind = F.substr(run, part["high"] + 1)
        return F.struct(
            (part["low"] - F.length(F.regexp_extract(before, UNCUT, 0))).alias("low"),
            (part["high"] + F.length(F.regexp_extract(behind, UNCUT, 0))).alias("high"),
        )

    long = F.filter(F.transform(F.transform(stretches, bare), uncut), lambda p: p["high"] - p["low"] >= LEAST_RUN)
    all_of_it = F.array(F.struct(F.lit(0).alias("low"), F.length(run).alias("high")))
    return F.when(total >= least, all_of_it).otherwise(F.array_distinct(long))


def _replaced(whole: Column, spans: str, mark: Callable[[Column, Column], Column]) -> Column:
    """The text with ``mark(span, pos)`` for every span, ``pos`` being the end of those before."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substr(whole, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        out = F.concat(acc["out"], before, mark(s, acc["pos"]))
        return F.struct(out.alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))

    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substr(whole, acc["pos"] + 1)))


def with_spans(
    df: DataFrame, ratios: list[float], text: str = "text", false_rate: float = FALSE_RATE
) -> DataFrame:
    """Adds ``__base`` and ``__spans``: sorted arrays of ``(start, rank, end)``.

    Runs are cut at the exact matches; what the models call random in the pieces is a span.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    least = -math.log(false_rate)
    based = with_base_spans(df, text).withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))
    # Blanks in place of the exact matches: the places of the rest stay.
    blank = _replaced(whole, "__base", lambda s, pos: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], pos), F.lit(0))))
    rest = based.withColumn("__rest", F.when(F.size("__base") > 0, blank).otherwise(whole))
    inside = F.transform(
        F.regexp_extract_all("__rest", F.lit(RUN), F.lit(0)), lambda r: random_parts(r, ratios, least)
    )
    free = _placed(F.col("__rest"), RUN, 3, inside=inside)
    joined = rest.withColumn("__free", free)
    return joined.withColumn("__spans", F.array_sort(F.concat("__base", "__free")))


def _told(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])
    )
    return F.array_join(one, ",")


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts by kind, the spans, and the digest of the exact ones.

    Null and empty texts have no spans; repeated rows stay repeated; an empty table gives an
    empty result. Positions count code points, the end is exclusive. Of an assignment the
    span is the whole match, keyword included.
    """
    ratios = train(docs, text)
    plain = docs.select(F.col(key).alias(key), F.col(text).alias(text))
    found = with_spans(plain, ratios, text)
    return found.select(
        key,
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_told("__base").cast("binary"), 256).alias("base_sha256"),
        _told("__spans").alias("spans"),
        F.size("__free").cast("long").alias("n_model"),
    )


def redact(docs: DataFrame, *, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """The documents with every span replaced; a text without spans stays as it is.

    All rows and columns are kept, ``n_chars`` too unless the text changed.
    """
    needed = [text, *[c for c in ("n_chars",) if c in docs.columns]]
    return shielded(docs, needed, lambda plain: _redacted(plain, text, mark))


def _redacted(docs: DataFrame, text: str, mark: str) -> DataFrame:
    found = with_spans(docs, train(docs, text), text)
    whole = F.col(text)
    rebuilt = _replaced(whole, "__spans", lambda s, pos: F.when(s["start"] >= pos, F.lit(mark)).otherwise(""))
    changed = found.withColumn(text, F.when(F.size("__spans") > 0, rebuilt).otherwise(whole))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.size("__spans") > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars"))
        changed = changed.withColumn("n_chars", length)
    return changed.select(docs.columns)
