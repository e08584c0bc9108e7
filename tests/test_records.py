"""Quoted line feeds across lines and splits, against a plain reader."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from rentlens.sources import files
from rentlens.sources.records import records

CELLS = ["a", "", "two words", "x;y", 'say "hi"', "line\nfeed", "three\nline\n\nfeeds", '"', '";"', "\n", "5 inch\" pipe", "ä"]


def table(seed, n, width=4):
    rng = random.Random(seed)
    rows = [[rng.choice(CELLS) for _ in range(width)] for _ in range(n)]
    for i, row in enumerate(rows):
        row[0] = f"r{i}"
    held = io.StringIO()
    csv.writer(held, delimiter=";", lineterminator="\n").writerows(rows)
    return rows, held.getvalue()


def as_lines(spark, text, cuts):
    """The lines of a text, dealt to splits of one file at the given places."""
    out, block, row = [], 0, 0
    for i, line in enumerate(text.rstrip("\n").split("\n")):
        if i in cuts:
            block, row = block + 1, 0
        out.append((line, ("f", block * 10, row)))
        row += 1
    return spark.createDataFrame(out, "value string, line struct<file string, block long, row long>").repartition(5)


@pytest.mark.parametrize("seed", range(6))
def test_records_equal_a_plain_reader_wherever_splits_fall(spark, seed):
    rows, text = table(seed, 60)
    n = text.count("\n")
    rng = random.Random(seed + 100)
    cuts = set(rng.sample(range(1, n), [0, 3, 10, 30, n // 2, n - 1][seed]))
    got = records(as_lines(spark, text, cuts), ";").orderBy("line").collect()
    read = [next(csv.reader(io.StringIO(r["value"]), delimiter=";")) for r in got]
    assert read == rows
    assert sum(r["n_lines"] for r in got) == n


def test_a_quote_inside_a_cell_opens_nothing(spark):
    text = 'a;5" pipe;c\nb;6" pipe;d\n'
    assert [r["value"] for r in records(as_lines(spark, text, {1}), ";").orderBy("line").collect()] == text.split("\n")[:2]


@pytest.mark.parametrize("size", [1 << 20, 700])
def test_file_with_title_lines_and_quoted_line_feeds(spark, tmp_path, size):
    """No row is lost, rejects are counted, however small the splits are."""
    rows, text = table(3, 400)
    title = "Bericht\nStand 2024\n"
    bad = 'zu;viele;"Zellen\nhier";a;b;c\n'
    path = tmp_path / "r.csv"
    path.write_text(title + text + bad, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got, over = files.scan_csv_checked(spark, str(path))
        read = [tuple(r) for r in got.orderBy("line").drop("line").collect()]
        assert read[:2] == [("Bericht", None, None, None), ("Stand 2024", None, None, None)]
        assert read[2:] == [tuple(c if c != "" else None for c in r) for r in rows]
        assert [(r["cells"], r["value"]) for r in over.collect()] == [(6, bad.rstrip("\n"))]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_several_files_do_not_share_a_state(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1;"open\nstill open;2\n')
    (tmp_path / "b.csv").write_text('3;"x\ny"\n4;z\n')
    got = records(spark.read.text(str(tmp_path)).select("value", files.file_order().alias("line")), ";")
    assert {r["value"] for r in got.collect()} == {'1;"open\nstill open;2', '3;"x\ny"', "4;z"}
    assert got.agg(F.sum("n_lines")).first()[0] == 5
