"""Upload path: raw files to the standard listings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.operators import columns, sampling
from rentlens.sources import archives, files, tables


def standard_rows(raw: DataFrame, source: str) -> DataFrame:
    """Thirteen typed columns, everything else as JSON, and the source label."""
    return columns.tag_source(columns.standardize_listings(raw, extra_json=True), source)


def ingest_csv(
    spark: SparkSession,
    path: str,
    table: str,
    source: str = "kaggle",
    max_rows: int | None = None,
    order: list[str] | None = None,
    upload: str | None = None,
) -> int:
    """Append the rows of a delimited file and return how many there were.

    ``max_rows`` takes the first rows in ``order``, by default the order of the file.
    ``upload`` names the upload; by default its files as they are do, so a job that is tried
    again leaves its rows once.
    """
    raw = files.scan_csv_strings(spark, path)
    if max_rows and not order:
        placed = raw.withColumn("__line", files.file_order())
        raw = sampling.cap_rows(placed, max_rows, ["__line"]).drop("__line")
    elif max_rows:
        raw = sampling.cap_rows(raw, max_rows, order or [])
    return tables.append_listings(standard_rows(raw, source), table, upload or upload_name(spark, path))


def upload_name(spark: SparkSession, path: str) -> str:
    """A name for the files at a path: their places, sizes and times."""
    found = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    rows = found.agg(F.sort_array(F.collect_list(F.concat_ws("|", "path", "length", "modificationTime"))).alias("all"))
    return rows.select(F.md5(F.array_join("all", "\n"))).first()[0]


def ingest_zip(
    spark: SparkSession,
    path: str,
    table: str,
    source: str = "kaggle",
    max_rows: int | None = None,
    upload: str | None = None,
) -> int:
    """Append the rows of the first CSV file of every archive; none of them gives 0."""
    names = archives.zip_columns(spark, path)
    if not names:
        return 0
    raw = archives.scan_zip_csv(spark, path, names, max_rows).select(*names)
    return tables.append_listings(standard_rows(raw, source), table, upload or upload_name(spark, path))
