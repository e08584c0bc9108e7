"""Quality classification with hierarchical empirical Bayes over sites.

A logistic classifier on form features of the whole text gives each document its evidence.
Documents of a host, and of a path below it, share what the others of that group show: soft
counts are grouped and shrunk, paths towards their host and hosts towards the global mean,
the more the sparser they are. The strength of each level is estimated from the data by the
method of moments. A document's own evidence is taken out of its groups before they speak
for it, so nothing counts twice.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentlens.llm.common import drawn, join_small, staged, without_clashes

#: Most labelled documents, about, that the classifier is fitted on; drawn by a hash.
SAMPLE_LABELS = 20_000

RIDGE, NEWTON_STEPS, BOUND = 1.0, 25, 6.0

#: Prior strengths, in documents, are kept between these.
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1e6

#: Evidence is bounded, in log odds, so that one document cannot carry a group.
MOST_EVIDENCE = 12.0

OWN = ["evidence", "site_mean", "quality_prob", "accepted", "__host", "__path"]

SYMBOLS = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ",.'\"-"])


def features(text: bytes | None) -> list[float] | None:
    """Form of a whole text; None without words."""
    raw = text or b""
    words = raw.split()
    if not words:
        return None
    n = len(words)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    seen = Counter(words)
    lines = [x for x in raw.split(b"\n") if x]
    distinct_lines = len(set(lines)) / len(lines)
    ends = sum(w[-1] in b".,;:" for w in words) / n
    symbol = byte[SYMBOLS].sum()
    return [
        np.log1p(n),
        len(raw) / n,
        byte[48:58].sum(),
        byte[65:91].sum(),
        symbol,
        np.sqrt(symbol),
        byte[ord("|")],
        byte[ord("!")],
        byte[ord("#")] + byte[ord("$")] + byte[ord("%")] + byte[ord("&")] + byte[ord("*")],
        byte[ord(".")],
        byte[10],
        byte[128:].sum(),
        ends,
        len(seen) / n,
        len(seen) / n**0.8,
        max(seen.values()) / n,
        distinct_lines,
        sum(w.isupper() for w in words) / n,
        sum(b.lower() == a.lower() for a, b in zip(words, words[1:])) / n,
    ]


def feature_column(text: Column) -> Column:
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(batch, T.ArrayType(T.DoubleType()))(text.cast("binary"))


@dataclass(frozen=True)
class Classifier:
    """Weights over standardised features; ``prior`` is the log odds of a text without words."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    prior: float

    def log_odds(self, rows: list) -> np.ndarray:
        out = np.full(len(rows), self.prior)
        have = [i for i, r in enumerate(rows) if r is not None]
        if have and self.weights:
            x = (np.array([rows[i] for i in have], float) - self.mean) / self.scale
            x = np.clip(x, -BOUND, BOUND)
            out[have] = x @ np.array(self.weights[1:]) + self.weights[0]
        return np.clip(out, -MOST_EVIDENCE, MOST_EVIDENCE)

    def column(self, text: Column) -> Column:
        def batch(texts: pa.Array) -> pa.Array:
            return pa.array(self.log_odds([features(t) for t in texts.to_pylist()]), pa.float64())

        return F.arrow_udf(batch, T.DoubleType())(text.cast("binary"))


def fit(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, sample: int = SAMPLE_LABELS) -> Classifier:
    """Ridge logistic regression by Newton's method on about ``sample`` labelled documents.

    Several labels of a key are averaged, and so are the features of its rows: a key counts
    once, however often it is repeated. Null keys and labels are left out. Without labels of
    both kinds only the prior remains.
    """
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    marks = staged(marks.groupBy(F.col(key).alias("key")).agg(F.avg(label).alias("mark")))
    rate = min(1.0, sample / max(1, marks.count()))
    some = marks.where(drawn("key", rate))
    means = [F.avg(F.col("x")[i]) for i in range(len(features(b"-")))]
    rows = (
        docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
        .join(F.broadcast(some), "key")
        .select("key", "mark", feature_column(F.col("text")).alias("x"))
        # Summed where the rows are, so about ``sample`` rows at most leave, by the draw above.
        .groupBy("key", "mark")
        .agg(F.when(F.count("x") > 0, F.array(*means)).alias("x"))
        .collect()
    )
    y = np.array([float(r["mark"] >= 0.5) for r in rows])
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    have = [i for i, r in enumerate(rows) if r["x"] is not None]
    y = y[have]
    if not len(y) or y.min() == y.max():
        return Classifier([], [], [], prior)
    x = np.array([rows[i]["x"] for i in have], float)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.column_stack([np.ones(len(y)), np.clip((x - mean) / scale, -BOUND, BOUND)])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, *[RIDGE] * (x.shape[1] - 1)])
    for _ in range(NEWTON_STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge @ w
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        w = w - np.linalg.solve(curve, slope)
    return Classifier(mean.tolist(), scale.tolist(), w.tolist(), prior)


def _strength(groups: DataFrame, mean: Column | float) -> float:
    """Prior strength of a level: groups ``n, s, q`` (sum of p, of p squared) around ``mean``."""
    m = F.col("s") / F.col("n")
    row = groups.agg(
        F.sum("n").alias("n"),
        F.count("n").alias("g"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * (m - mean) * (m - mean)).alias("between"),
        F.sum(F.col("q") - F.col("n") * m * m).alias("within"),
        F.sum("s").alias("s"),
    ).first()
    if not row["n"] or row["g"] < 2 or row["n"] <= row["g"]:
        return MOST_STRENGTH
    typical = (row["n"] - row["nn"] / row["n"]) / (row["g"] - 1)
    within = max(0.0, row["within"]) / (row["n"] - row["g"])
    spread = (row["between"] / (row["g"] - 1) - within) / max(typical, 1e-9)
    centre = row["s"] / row["n"]
    if spread <= 0:
        return MOST_STRENGTH
    return float(np.clip(centre * (1 - centre) / spread - 1, LEAST_STRENGTH, MOST_STRENGTH))


def _site(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("~"))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    *,
    host: Column,
    path: Column,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample: int = SAMPLE_LABELS,
) -> DataFrame:
    """The documents with evidence, site_mean, quality_prob and accepted.

    ``host`` and ``path`` are expressions over ``docs``; nulls form a site of their own. A
    text without words has the prior as its evidence. Documents are accepted from a
    probability of one half on. Columns named like the added ones are replaced; repeated
    rows count each; empty tables are served.
    """
    model = fit(docs, labels, key=key, text=text, label=label, sample=sample)
    plain = without_clashes(docs, OWN)
    weighed = plain.select(
        "*",
        model.column(F.col(text)).alias("evidence"),
        _site(host).alias("__host"),
        F.concat(_site(host), F.lit("/"), _site(path)).alias("__path"),
    )
    p = 1 / (1 + F.exp(-F.col("evidence")))
    paths = staged(
        weighed.select("__host", "__path", p.alias("p"))
        .groupBy("__host", "__path")
        .agg(F.count("p").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    )
    hosts = staged(
        paths.groupBy("__host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    centre = (total["s"] + 0.5) / (total["n"] + 1) if total["n"] else 0.5
    host_strength = _strength(hosts, F.lit(centre))
    inside = paths.join(
        hosts.select("__host", F.col("n").alias("hn"), F.col("s").alias("hs")), "__host"
    )
    path_strength = _strength(inside, F.col("hs") / F.col("hn"))
    sites = staged(
        inside.select("__path", F.col("n").alias("__n"), F.col("s").alias("__s"), F.col("hn").alias("__hn"), F.col("hs").alias("__hs"))
    )
    joined = join_small(weighed, sites, ["__path"], "inner")
    # Without the document itself, whose evidence is added on its own.
    host_mean = (host_strength * centre + F.col("__hs") - p) / (host_strength + F.col("__hn") - 1)
    path_mean = (path_strength * host_mean + F.col("__s") - p) / (path_strength + F.col("__n") - 1)
    mean = F.least(F.greatest(path_mean, F.lit(1e-6)), F.lit(1 - 1e-6))
    shift = F.log(F.col("site_mean") / (1 - F.col("site_mean"))) - float(np.log(centre / (1 - centre)))
    odds = F.col("evidence") + shift
    return (
        joined.withColumn("site_mean", mean)
        .withColumn("quality_prob", 1 / (1 + F.exp(-odds)))
        .withColumn("accepted", F.col("quality_prob") >= 0.5)
        .select(*plain.columns, *OWN[:4])
    )
