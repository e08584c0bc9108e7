"""Operators that SQL cannot express, against plain Python over the same rows."""

from __future__ import annotations

import math
import random
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rentlens.llm import quality, secrets, tokencount


def strength(groups, mean):
    """Method of moments over ``(n, s, q, mean of the level above)``."""
    n, g = sum(x[0] for x in groups), len(groups)
    if not n or g < 2 or n <= g:
        return quality.MOST_STRENGTH
    typical = (n - sum(x[0] ** 2 for x in groups) / n) / (g - 1)
    within = max(0.0, sum(q - k * (s / k) ** 2 for k, s, q, _ in groups)) / (n - g)
    between = sum(k * (s / k - m) ** 2 for k, s, _, m in groups) / (g - 1)
    spread = (between - within) / max(typical, 1e-9)
    if spread <= 0:
        return quality.MOST_STRENGTH
    centre = sum(x[1] for x in groups) / n
    return min(max(centre * (1 - centre) / spread - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)


def test_quality_posteriors_equal_plain_python(spark):
    """Hosts of very different size and mean, paths below them, nulls among both."""
    rng = random.Random(6)
    rows = []
    for i in range(600):
        host = [None, "big", "big", "big", "mid", f"tiny{i % 40}"][i % 6]
        good = rng.random() < (0.9 if host == "big" else 0.3)
        text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 8))) for _ in range(60))
        rows.append((i, text if good else "$$$ 123 !!! ### " * 30, ["en", "de", None][i % 3], host, int(good)))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, quality int")
    got = quality.judged(table.drop("quality"), table.select("doc_id", "quality"), host=F.col("source"), path=F.col("lang")).collect()
    p = {r["doc_id"]: 1 / (1 + math.exp(-r["evidence"])) for r in got}
    hosts, paths = defaultdict(list), defaultdict(list)
    for r in got:
        hosts[r["source"]].append(p[r["doc_id"]])
        paths[r["source"], r["lang"]].append(p[r["doc_id"]])
    centre = (sum(p.values()) + 0.5) / (len(p) + 1)
    summed = lambda xs: (len(xs), sum(xs), sum(x * x for x in xs))
    of_host = strength([(*summed(xs), centre) for xs in hosts.values()], centre)
    of_path = strength([(*summed(xs), sum(hosts[h]) / len(hosts[h])) for (h, _), xs in paths.items()], None)
    for r in got:
        own, h, s = p[r["doc_id"]], hosts[r["source"]], paths[r["source"], r["lang"]]
        above = (of_host * centre + sum(h) - own) / (of_host + len(h) - 1)
        mean = min(max((of_path * above + sum(s) - own) / (of_path + len(s) - 1), 1e-6), 1 - 1e-6)
        odds = r["evidence"] + math.log(mean / (1 - mean)) - math.log(centre / (1 - centre))
        assert r["site_mean"] == pytest.approx(mean, rel=1e-6)
        assert r["quality_prob"] == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6)
        assert r["accepted"] == (r["quality_prob"] >= 0.5)


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_sections_equal_a_plain_walk_over_tokens(spark, rule):
    texts = ["one two\nthree\n\n  four é漢\n x", "", "\n\n\n", "a\r\n\r\nb   \n   c", "x" * 50 + "\n" * 7 + "é" * 9 + " \n\n y"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in tokencount.count_sections(table, rule=rule).collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    encoder, _ = tokencount._encoder(tokencount.VOCABULARY)
    for i, text in enumerate(texts):
        data = text.encode()
        section_of = [data[:at].count(b"\n") for at in range(len(data))]
        n = max(1, data.count(b"\n") + (not data.endswith(b"\n")))
        counts, crossing, at = [0] * n, [0] * n, 0
        for token in encoder.decode_tokens_bytes(encoder.encode_ordinary(text)):
            own = section_of[at : at + len(token)]
            if rule == "first" or len(set(own)) == 1:
                home = own[0]
            else:
                # Characters are counted where they begin.
                begins = [s for s, b in zip(own, token) if b & 0xC0 != 0x80]
                home = max(dict.fromkeys(own), key=lambda s: (begins.count(s), -s))
            counts[home] += 1
            crossing[home] += len(set(own)) > 1
            at += len(token)
        ends = [k + 1 for k, c in enumerate(text) if c == "\n"]
        ends += [len(text)] if not ends or ends[-1] < len(text) else []
        want = [(k, ([0] + ends)[k], ends[k], counts[k], crossing[k]) for k in range(n)]
        assert sorted(got[i]) == want, (i, text)




@pytest.mark.parametrize("length,least", [(20, 0.98), (24, 1.0), (32, 1.0), (48, 1.0)])
def test_random_strings_are_found_and_names_are_not(spark, length, least):
    """Recall on random strings by length, and false alarms on ordinary long names.

    One document in twenty holds a random string, and any of them may be in the sample that
    ordinary identifiers are learned from.
    """
    rng, n = random.Random(length), 100
    letters = string.ascii_letters + string.digits
    parts = ["user", "account", "service", "handler", "config", "default", "manager", "request", "session", "update",
             "value", "number", "index", "render", "module", "network", "storage", "profile", "message", "window"]

    def name(k):
        return "_".join(rng.choice(parts) for _ in range(k))

    keys = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(n)]
    rows = [(i, f"call {k} now") for i, k in enumerate(keys)]
    rows += [(1000 + i, f"call {name(8)[:length].strip('_')} now") for i in range(n)]
    rows += [(5000 + i, " ".join(name(rng.randint(1, 5)) for _ in range(25))) for i in range(20 * n)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["n_model"] for r in secrets.scan(table).collect()}
    assert sum(got[i] > 0 for i in range(n)) >= least * n
    assert sum(got[i] > 0 for i in got if i >= 1000) <= 0.002 * 21 * n
