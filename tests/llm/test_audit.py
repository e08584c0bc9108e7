"""Filter interaction audit against plain counting."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from rentlens.llm import filteraudit
from tests.llm.cases import docs, no_docs

LABELS = "doc_id long, quality int, toxic int, `mask` string, `id` int, `part` string"


def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, None), (6, 1, 1), (8, 0, 0), (11, None, 1), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], LABELS)


def plain(rows, label_rows):
    good = {i for i, q, _ in label_rows if i is not None and q == 1}
    toxic = {i for i, _, t in label_rows if i is not None and t == 1}
    out = {}
    facts = []
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows),
        }
        facts.append((part or "", fails, i in good, i in toxic))
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                out_here = [f for f in left if f[1][letter]]
                shapley[letter] += len(out_here)
                failing = [f for f in own if f[1][letter]]
                out[part, "".join(order), step] = [
                    len(left) - len(out_here),
                    len(out_here),
                    len(failing) - len(out_here),
                    sum(sum(f[1].values()) == 1 for f in failing),
                    sum(f[2] for f in out_here),
                    sum(f[3] for f in out_here),
                ]
                left = [f for f in left if not f[1][letter]]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def check(spark, frame):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in frame.collect()]
    want = plain(rows, [(r["doc_id"], r["quality"], r["toxic"]) for r in labels(spark).collect()])
    got = filteraudit.audit(frame, labels(spark))
    assert got.columns == ["part", "filter_order", "step", *filteraudit.COUNTS, "shapley"]
    got = {tuple(r)[:3]: list(tuple(r)[3:]) for r in got.collect()}
    assert len(got) == 600 * len({r[2] or "" for r in rows})
    assert got == want


def test_audit_equals_brute_force_on_awkward_rows(spark):
    check(spark, docs(spark))


def test_audit_counts_hot_groups_whole(spark):
    shout = " ".join(["LOUD word"] * 150)
    rows = [(i % 40, "a copy # of many", ["en", None, ""][i % 3]) for i in range(60)]
    rows += [(None, "a copy # of many", "en")] * 5 + [(200 + i, shout + "!" * (i % 2), "fr") for i in range(30)]
    rows += [(7, " ".join(f"v{j}" for j in range(i, i + 260)), "de") for i in range(40)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4))


def test_audit_of_empty_tables(spark):
    assert filteraudit.audit(no_docs(spark), labels(spark)).count() == 0
    none = labels(spark).where("false")
    got = filteraudit.audit(docs(spark), none)
    assert got.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    assert got.where("step = 5").select("part", "kept").distinct().count() == 2


def test_fold_has_the_shapley_value_of_the_removed_rows(spark):
    """Summed over filters the shares of all orders make up every removed row."""
    cells = spark.createDataFrame(
        [("x", m, m % 2 == 0, m % 3 == 0, m + 1) for m in range(32)], "part string, mask int, good boolean, toxic boolean, n long"
    )
    got = filteraudit.fold(cells)
    first = got.where("step = 1").groupBy(F.substring("filter_order", 1, 1).alias("f")).agg(F.max("shapley").alias("s"))
    assert first.agg(F.sum("s")).first()[0] == 120 * sum(m + 1 for m in range(1, 32))
