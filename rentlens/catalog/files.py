"""File, archive and table jobs. Each writes the derived tables and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rentlens.catalog.cleaning import STANDARD
from rentlens.catalog.registry import query
from rentlens.operators import columns, sampling
from rentlens.schemas import strings
from rentlens.sources import archives, files, tables

TYPED = ["listing_id", "baseRent", "floor", "serviceCharge", "regio3", "geo_plz"]


def _export(t, df, sep=",", header=True) -> str:
    path = tables.shared_dir(t.spark)
    tables.export_csv(df, path, sep, header)
    return path


@query("A1_scan_csv_header", f"SELECT {', '.join(TYPED)} FROM fx_places_listed")
def a1(t):
    df = t.fx("places_listed").select(*TYPED)
    return files.scan_csv_header(t.spark, _export(t, df), df.schema)


@query(
    "A2_scan_csv_strings",
    "SELECT CAST(listing_id AS VARCHAR) AS listing_id, regio3, geo_plz FROM fx_places_listed",
)
def a2(t):
    df = t.fx("places_listed").select("listing_id", "regio3", "geo_plz")
    return files.scan_csv_strings(t.spark, _export(t, df))


@query("A3_scan_csv_named", "SELECT ARS, AGS, Gemeindename, PLZ, Ort FROM fx_keymap")
def a3(t):
    names = ["ARS", "AGS", "Gemeindename", "PLZ", "Ort"]
    path = _export(t, t.fx("keymap").select(*names), ";", False)
    return files.scan_csv_named(t.spark, path, names)


@query(
    "A4_scan_csv_robust",
    "SELECT ARS AS col_0, AGS AS col_1, Gemeindename AS col_2, PLZ AS col_3, Ort AS col_4 "
    "FROM fx_keymap",
)
def a4(t):
    names = ["ARS", "AGS", "Gemeindename", "PLZ", "Ort"]
    path = _export(t, t.fx("keymap").select(*names), ";", False)
    return files.scan_csv_robust(t.spark, path).drop("line")


# Every ninth name of the report has a line feed, every thirteenth row two cells too many.
NAMED = "CASE WHEN row_no % 9 = 0 THEN col_2 || chr(10) || 'Ortsteil' ELSE col_2 END"


@query(
    "A4_report_with_line_feeds",
    f"""SELECT col_0 AS Nr, col_1 AS GKZ, {NAMED} AS Gemeinde, col_3 AS Miete,
               (SELECT COUNT(*) FROM fx_report WHERE row_no > 2 AND row_no % 13 = 0) AS rejected
        FROM fx_report WHERE row_no > 2 AND row_no % 13 <> 0""",
)
def a4_report(t):
    """A file with title lines and quoted line feeds, from its text to a named table."""
    path = tables.shared_dir(t.spark)
    cells = [F.col(c) for c in ("col_0", "col_1")]
    name = F.when(F.col("row_no") > 2, F.concat(F.lit('"'), F.expr(NAMED), F.lit('"'))).otherwise(F.col("col_2"))
    more = F.when((F.col("row_no") > 2) & (F.col("row_no") % 13 == 0), F.lit("zu;viel"))
    line = F.concat_ws(";", *cells, name, "col_3", more)
    t.fx("report").orderBy("row_no").select(line.alias("value")).write.text(path)
    rows, over = files.scan_csv_checked(t.spark, path)
    table = files.guess_header(rows, "col_1", "line").drop("line")
    return table.withColumn("rejected", over.agg(F.count(F.lit(1))).scalar())


@query(
    "A5_scan_zip_csv",
    """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 <> 0 THEN first_name END AS first_name,
              last_name, CASE WHEN id % 3 = 0 THEN 'short' END AS note FROM fx_tenants""",
)
def a5(t):
    """Real archives with two kinds of headers; the columns are the union of them."""
    tenants = t.fx("tenants").select("id", "first_name", "last_name")
    path = tables.shared_dir(t.spark)
    archives.write_zip_csv(tenants.where("id % 3 <> 0").repartition(3, "id"), f"{path}/whole")
    short = tenants.where("id % 3 = 0").select("last_name", "id", F.lit("short").alias("note"))
    archives.write_zip_csv(short.repartition(2, "id"), f"{path}/short", "tenants.CSV")
    found = archives.scan_zip_csv(t.spark, [f"{path}/whole", f"{path}/short"])
    return found.drop("path")


@query("A6_cap_rows", "SELECT listing_id, baseRent FROM fx_places_listed ORDER BY listing_id LIMIT 12000")
def a6(t):
    return sampling.cap_rows(
        t.fx("places_listed").select("listing_id", "baseRent"), 12_000, ["listing_id"]
    )


@query(
    "A7_guess_header",
    "SELECT row_no, col_0 AS Nr, col_1 AS GKZ, col_2 AS Gemeinde, col_3 AS Miete FROM fx_report "
    "WHERE row_no > 2",
)
def a7(t):
    return files.guess_header(t.fx("report"), "col_1", "row_no")


def _standard(t):
    return columns.standardize_listings(t.fx("listings"), keep=["listing_id"])


@query(
    "A8_scan_listings",
    f"SELECT listing_id, district, rent_cold FROM ({STANDARD}) WHERE rent_cold IS NOT NULL",
)
def a8(t):
    path = tables.shared_dir(t.spark)
    tables.replace_listings(_standard(t), path)
    return tables.scan_listings(t.spark, path, ["listing_id", "district", "rent_cold"])


@query(
    "A9_append_listings",
    f"""SELECT listing_id, source, rent_cold FROM (SELECT *, 'first' AS source FROM ({STANDARD})
        UNION ALL SELECT *, 'second' FROM ({STANDARD}))""",
)
def a9(t):
    path = tables.shared_dir(t.spark)
    # The second upload is tried twice.
    for source in ("first", "second", "second"):
        tables.append_listings(columns.tag_source(_standard(t), source), path, source)
    return tables.read_listings(t.spark, path).select("listing_id", "source", "rent_cold")


@query("A10_replace_listings", STANDARD)
def a10(t):
    path = tables.shared_dir(t.spark)
    tables.replace_listings(_standard(t).withColumn("old", F.lit(1)), path)
    tables.replace_listings(_standard(t), path)
    return tables.read_listings(t.spark, path)


@query("A11_write_stage", "SELECT ARS, AGS, Gemeindename, PLZ, Ort, row_no FROM fx_keymap")
def a11(t):
    return tables.write_stage(t.fx("keymap"), tables.shared_dir(t.spark))


@query("A11_export_csv", "SELECT GKZ, Gemeindename, Insgesamt FROM fx_zensus")
def a11_csv(t):
    df = t.fx("zensus").select("GKZ", "Gemeindename", "Insgesamt")
    path = _export(t, df, ";")
    raw = t.spark.read.schema(strings(df.columns)).option("header", True).option("sep", ";").csv(path)
    return raw.withColumn("Insgesamt", columns.numeric(raw, "Insgesamt"))
