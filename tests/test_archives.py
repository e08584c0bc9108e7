"""Archives read as a stream, one partition per archive or entry."""

from __future__ import annotations

import tracemalloc
import zipfile

import pytest

from rentlens.sources import archives


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in members:
            archive.writestr(name, text)
    return str(path)


@pytest.fixture
def folder(tmp_path):
    zipped(tmp_path / "a.zip", [("x.txt", "no"), ("one.CSV", "plz,price,extra\n01067,500,q\n24103,600,\n\n"),
                                ("two.csv", "plz,late\n99999,1\n")])
    zipped(tmp_path / "b.zip", [("c.csv", '﻿price,plz\n700,"10115\nBerlin"\n')])
    zipped(tmp_path / "c.zip", [("readme.md", "nothing")])
    zipped(tmp_path / "d.zip", [("empty.csv", "")])
    (tmp_path / "notes.txt").write_text("no archive")
    return tmp_path


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.mark.parametrize("form", ["{}", "{}/*.zip", "file://{}", "file:{}"])
def test_first_csv_of_every_archive_with_the_union_of_headers(spark, folder, form):
    path = form.format(folder)
    assert archives.zip_columns(spark, path) == ["plz", "price", "extra"]
    got = archives.scan_zip_csv(spark, path)
    assert got.columns == ["path", "plz", "price", "extra"]
    assert got.rdd.getNumPartitions() == 4
    assert rows(got, "plz", "price") == [("01067", "500"), ("10115\nBerlin", "700"), ("24103", "600")]
    assert {r["path"].rsplit("/", 1)[1] for r in got.collect()} == {"a.zip", "b.zip"}
    assert rows(archives.scan_zip_csv(spark, path, ["price", "nothing"]), "price", "nothing") == [
        ("500", None), ("600", None), ("700", None)]


def test_every_entry_is_a_partition(spark, folder):
    got = archives.scan_zip_csv(spark, str(folder), entries="all")
    assert got.columns == ["path", "plz", "price", "extra", "late"] and got.rdd.getNumPartitions() == 4
    assert rows(got, "plz")[-1] == ("99999",) and got.count() == 4


def test_single_archive_most_rows_and_missing_path(spark, folder):
    one = archives.scan_zip_csv(spark, str(folder / "a.zip"), max_rows=1)
    assert rows(one, "plz") == [("01067",)]
    assert archives.scan_zip_csv(spark, str(folder / "c.zip"), ["plz"]).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        archives.scan_zip_csv(spark, str(folder / "nowhere.zip"), ["plz"]).count()


def test_schema_without_names_is_the_union_of_headers(spark, folder):
    spark.dataSource.register(archives.ZipCsvSource)
    assert spark.read.format("zip_csv").load(str(folder)).columns == ["path", "plz", "price", "extra"]


def test_written_archives_read_back(spark, tmp_path):
    df = spark.range(2000).selectExpr("id", "if(id % 3 = 0, null, concat('a,\"', id, '\\n'))  AS text").repartition(3)
    assert archives.write_zip_csv(df, str(tmp_path / "out")) == 3
    again = archives.scan_zip_csv(spark, str(tmp_path / "out"))
    assert {(r["id"], r["text"]) for r in again.collect()} == {(str(r["id"]), r["text"]) for r in df.collect()}
    assert archives.write_zip_csv(df.where("false"), str(tmp_path / "none")) == 0


def test_an_entry_larger_than_the_memory_used_for_it(tmp_path):
    """400 MB of rows pass through in a few MB; only the directory is read to begin with."""
    path = str(tmp_path / "big.zip")
    line = ("x" * 2000 + ",") * 10 + "end\n"
    n = 20_000
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
        with archive.open("big.csv", "w", force_zip64=True) as member:
            member.write((",".join(f"c{i}" for i in range(10)) + ",last\n").encode())
            for _ in range(n):
                member.write(line.encode())
    with zipfile.ZipFile(path) as archive:
        assert archive.getinfo("big.csv").file_size > 400e6
    reader = archives.ZipCsvReader({"path": path}, archives.strings(["c3", "last"]))
    (part,) = reader.partitions()
    tracemalloc.start()
    seen = 0
    for batch in reader.read(part):
        seen += batch.num_rows
        assert batch.column(1)[0].as_py() == "end"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and peak < 150e6
