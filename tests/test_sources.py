from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from rentlens import schemas
from rentlens.plans import ingest
from rentlens.sources import archives, files, tables
from rentlens.streaming.uploads import ingest_uploads


def write(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_named_scan_strips_the_mark_and_keeps_zeros(spark, tmp_path):
    path = write(tmp_path / "k.csv", "010010000000;01001000;Flensburg, Stadt;24937;Flensburg\n", "utf-8-sig")
    row = files.scan_csv_named(spark, path, schemas.KEY_MAP.names).first()
    assert row["ARS"] == "010010000000" and row["Gemeindename"] == "Flensburg, Stadt"


def test_header_scans(spark, tmp_path):
    path = write(tmp_path / "l.csv", 'id, plz \n1,01067\n2,"a ""b"""\n', "utf-8-sig")
    got = files.scan_csv_strings(spark, path)
    assert got.columns == ["id", "plz"]
    assert [tuple(r) for r in got.collect()] == [("1", "01067"), ("2", 'a "b"')]
    typed = files.scan_csv_header(spark, path, schemas._table({}, {"id": schemas.INT, "plz": schemas.INT}))
    assert [tuple(r) for r in typed.collect()] == [(1, 1067), (2, None)]


@pytest.mark.parametrize("encoding", ["utf-8-sig", "utf-8", "latin-1", "cp1252"])
@pytest.mark.parametrize("sep", [";", ",", "\t"])
def test_robust_scan(spark, tmp_path, encoding, sep):
    lines = [["Bericht", "", "Größe"], ["Nr", "GKZ", "Miete"], ["1", "01001000", "7"], ["2", "01002000"],
             ["3", "01003000", "9", "zu", "viel"], ["4", "01004000", "10"]]
    path = write(tmp_path / "r.csv", "\n".join(sep.join(x) for x in lines) + "\n", encoding)
    got = files.scan_csv_robust(spark, path)
    rows = [tuple(r)[:3] for r in got.orderBy("line").collect()]
    assert rows == [("Bericht", None, "Größe"), ("Nr", "GKZ", "Miete"), ("1", "01001000", "7"),
                    ("2", "01002000", None), ("4", "01004000", "10")]
    table = files.guess_header(got, "col_1", "line")
    assert table.columns[:3] == ["Nr", "GKZ", "Miete"]
    assert table.count() == 3


def test_a_title_line_does_not_cut_the_table(spark, tmp_path):
    path = write(tmp_path / "t.csv", "Bericht\nGKZ;Name;Miete\n01001000;A;7\n01002000;\"B;b\";8;9;9\n01003000;C;9\n", "utf-8")
    got = files.scan_csv_robust(spark, path)
    assert [tuple(r)[:3] for r in got.orderBy("line").collect()] == [
        ("Bericht", None, None), ("GKZ", "Name", "Miete"), ("01001000", "A", "7"), ("01003000", "C", "9"),
    ]
    over = files.scan_csv_checked(spark, path)[1].collect()
    assert [(r["cells"], r["value"]) for r in over] == [(5, '01002000;"B;b";8;9;9')]
    assert files.guess_header(got, "col_0", "line").columns[:3] == ["GKZ", "Name", "Miete"]


def test_guess_header_without_data_or_header(spark):
    none = spark.createDataFrame([(1, "a"), (2, "b")], "n int, col_0 string")
    assert files.guess_header(none, "col_0", "n").count() == 2
    first = spark.createDataFrame([(1, "1234567"), (2, "x")], "n int, col_0 string")
    assert files.guess_header(first, "col_0", "n").columns == ["n", "col_0"]


def zipped(path, members):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name, text in members:
            archive.writestr(name, text)
    path.write_bytes(held.getvalue())


def test_archives(spark, tmp_path):
    zipped(tmp_path / "a.zip", [("x.txt", "no"), ("one.CSV", "plz,price,extra\n01067,500,q\n24103,600,\n"),
                                ("two.csv", "plz\n99999\n")])
    zipped(tmp_path / "b.zip", [("c.csv", "price,plz\n700,10115\n")])
    zipped(tmp_path / "c.zip", [("readme.md", "nothing")])
    rows = archives.scan_zip_csv(spark, str(tmp_path / "*.zip"), ["plz", "price"]).collect()
    assert sorted((r.plz, r.price) for r in rows) == [("01067", "500"), ("10115", "700"), ("24103", "600")]
    assert archives.scan_zip_csv(spark, str(tmp_path / "*.zip"), ["plz"], max_rows=1).count() == 2
    table = str(tmp_path / "table")
    assert ingest.ingest_zip(spark, str(tmp_path / "*.zip"), table) == 3
    assert ingest.ingest_zip(spark, str(tmp_path / "c.zip"), table) == 0
    got = {r["zip_code"]: r for r in tables.read_listings(spark, table).collect()}
    assert got["01067"]["rent_cold"] == 500.0 and got["01067"]["extra_json"] == '{"extra":"q"}'
    assert got["10115"]["source"] == "kaggle" and got["10115"]["extra_json"] == '{"extra":null}'


def test_upload_and_stream_give_the_same_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write(folder / "1.csv", "plz,price,livingSpace,note\n01067,500,40,x\n24103,,50,\n")
    table, streamed = str(tmp_path / "t"), str(tmp_path / "s")
    assert ingest.ingest_csv(spark, str(folder / "1.csv"), table) == 2
    assert ingest.ingest_csv(spark, str(folder / "1.csv"), str(tmp_path / "m"), max_rows=1) == 1
    assert tables.read_listings(spark, str(tmp_path / "m")).first()["zip_code"] == "01067"
    schema = schemas.strings(["plz", "price", "livingSpace", "note"])

    def run():
        query = ingest_uploads(spark, str(folder), schema, streamed, str(tmp_path / "cp"))
        query.awaitTermination(60)
        return spark.read.parquet(streamed)

    order = ["zip_code"]
    want = [r.asDict() for r in tables.read_listings(spark, table).orderBy(*order).collect()]
    assert [r.asDict() for r in run().orderBy(*order).collect()] == want
    assert run().count() == 2  # the same file is not read twice
    write(folder / "2.csv", "plz,price,livingSpace,note\n10115,700,60,y\n")
    assert run().count() == 3
    listed = tables.scan_listings(spark, streamed, ["zip_code"])
    assert {r.zip_code for r in listed.collect()} == {"01067", "10115"}


def test_filter_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(10).select(F.col("id").alias("rent_cold"), F.lit("x").alias("regio3"), F.lit(1).alias("z"))
    tables.replace_listings(df, path)
    plan = tables.scan_listings(spark, path, ["regio3"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(rent_cold)]" in plan
    assert "z:int" not in plan.split("ReadSchema")[1]


def test_shared_dir_comes_from_the_cluster(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = tables.shared_dir(spark)
    assert path != tables.shared_dir(spark)
    if base:
        assert path.startswith(base.rstrip("/"))


def listed(spark, path):
    return sorted((r["id"], r["v"]) for r in tables.read_listings(spark, path).collect())


def test_an_upload_that_is_tried_again_leaves_its_rows_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(5).selectExpr("id", "'a' AS v")
    assert tables.append_listings(df, path, "one") == 5
    assert tables.append_listings(df.where("id < 2"), path, "two") == 2
    assert tables.append_listings(df.withColumn("v", F.lit("b")), path, "one") == 5
    assert listed(spark, path) == sorted([(i, "b") for i in range(5)] + [(0, "a"), (1, "a")])
    assert tables.append_listings(df, path) == 5 and tables.append_listings(df, path) == 5
    assert len(listed(spark, path)) == 17


def test_the_same_file_twice_is_one_upload(spark, tmp_path):
    path = write(tmp_path / "u.csv", "plz,price,livingSpace\n01067,500,40\n24103,600,50\n")
    for _ in range(2):
        assert ingest.ingest_csv(spark, path, str(tmp_path / "t")) == 2
    assert tables.read_listings(spark, str(tmp_path / "t")).count() == 2
    assert ingest.ingest_csv(spark, path, str(tmp_path / "t"), upload="by name") == 2
    assert tables.read_listings(spark, str(tmp_path / "t")).count() == 4


def test_a_replacement_that_fails_leaves_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_listings(spark.range(3).selectExpr("id", "'old' AS v"), path)
    old = listed(spark, path)
    late = spark.range(0, 200, 1, 4).selectExpr("id", "if(id = 190, raise_error('no'), 'new') AS v")
    with pytest.raises(Exception, match="no"):
        tables.replace_listings(late, path)
    assert listed(spark, path) == old
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_writing")]
    # From the table itself, and with an upload on top that the next version drops.
    tables.replace_listings(tables.read_listings(spark, path).withColumn("v", F.lit("new")), path)
    tables.append_listings(spark.range(9, 10).selectExpr("id", "'more' AS v"), path, "x")
    assert listed(spark, path) == [(0, "new"), (1, "new"), (2, "new"), (9, "more")]
    tables.replace_listings(spark.range(1).selectExpr("id", "'last' AS v"), path)
    assert listed(spark, path) == [(0, "last")]
    assert len(list((tmp_path / "t").glob("version-*"))) == 2


def test_a_version_that_another_job_took_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_listings(spark.range(3).selectExpr("id", "'old' AS v"), path)
    spark.range(1).write.parquet(f"{path}/_writing-x")
    with pytest.raises(Exception):
        tables._rename(spark, f"{path}/_writing-x", f"{path}/version-000001")
    assert len(listed(spark, path)) == 3
