"""Delimited text files."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rentlens.operators.columns import clean_headers, quoted
from rentlens.operators.frames import keep
from rentlens.schemas import strings
from rentlens.sources.records import records

BOM = "﻿"
SEPARATORS = ",;\t|"


def scan_csv_header(
    spark: SparkSession, path: str | list[str], schema: StructType, sep: str = ","
) -> DataFrame:
    """File with header into typed columns; cells that do not fit become null."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("sep", sep)
        .option("multiLine", False)
        .option("escape", '"')
        .csv(path)
    )


def scan_csv_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """File with header, every column text, so keys keep their leading zeros."""
    header = spark.read.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return clean_headers(header)


def scan_csv_named(
    spark: SparkSession, path: str, names: list[str], sep: str = ";"
) -> DataFrame:
    """File without header under the given names; a byte-order mark is removed."""
    df = spark.read.schema(strings(names)).option("sep", sep).option("escape", '"').csv(path)
    return df.withColumn(names[0], F.ltrim(F.col(names[0]), F.lit(BOM)))


def sniff_separator(lines: list[str]) -> str:
    """The separator that splits the sample most evenly into the most columns."""
    best, best_score = ",", (0, 0)
    for sep in SEPARATORS:
        widths = [len(row) for row in csv.reader(lines, delimiter=sep)]
        if not widths:
            continue
        usual = max(set(widths), key=widths.count)
        score = (widths.count(usual) if usual > 1 else 0, usual)
        if score > best_score:
            best, best_score = sep, score
    return best


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line is valid UTF-8, else Latin-1, checked over the whole file."""
    lines = spark.read.text(path)
    valid = lines.agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    return "UTF-8" if valid or valid is None else "ISO-8859-1"


def scan_csv_robust(spark: SparkSession, path: str, sample_lines: int = 20) -> DataFrame:
    """Separator and encoding found out, no header, all text, overlong records left out.

    Columns are ``col_0 …`` as many as most records of the whole file have, so a title line
    above a table does not cut it; short records are filled up with null. A quoted cell may
    hold line feeds. ``line`` orders the rows as in the file.
    """
    return scan_csv_checked(spark, path, sample_lines)[0]


def scan_csv_checked(
    spark: SparkSession, path: str, sample_lines: int = 20
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``scan_csv_robust`` and the records it rejects.

    Rejected are records with more cells than most: ``line``, ``cells`` and ``value``.
    """
    encoding = detect_encoding(spark, path)
    text = spark.read.text(path).select(
        _decoded(F.col("value"), encoding).alias("value"), file_order().alias("line")
    )
    sample = [r["value"].lstrip(BOM) for r in text.select("value").take(sample_lines)]
    sep = sniff_separator(sample)
    plain = text.withColumn("value", F.regexp_replace("value", "^" + BOM, ""))
    whole = keep(records(plain, sep).where(F.trim("value") != ""))
    width = common_width(whole, sep)
    names = [f"col_{i}" for i in range(width)]
    options = {"sep": sep, "escape": '"', "lineSep": "\u0001", "maxCharsPerColumn": "-1"}
    kinds = ", ".join(f"{c} string" for c in [*names, "overflow"])
    cells = F.from_csv("value", kinds, options)
    parsed = whole.select("line", "value", cells.alias("c")).select("line", "value", "c.*")
    rows = parsed.where(F.col("overflow").isNull()).select(*names, "line")
    over = parsed.where(F.col("overflow").isNotNull())
    return rows, over.select("line", _width(sep).alias("cells"), "value")


def _width(sep: str) -> Column:
    """Cells of a record; separators inside quotes do not count."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    return F.size(F.split(bare, re.escape(sep), -1))


def common_width(lines: DataFrame, sep: str) -> int:
    """The number of cells that most records have, the larger one of equals; 0 without any."""
    filled = lines.where(F.trim("value") != "")
    widths = filled.groupBy(_width(sep).alias("width")).count()
    row = widths.agg(F.max(F.struct("count", "width")).alias("top")).first()
    return row["top"]["width"] if row["top"] else 0


def _decoded(c: Column, encoding: str) -> Column:
    return c if encoding == "UTF-8" else F.decode(c.cast("binary"), encoding)


def file_order() -> Column:
    """Sortable position: file, block in the file, row in the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def guess_header(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows from the first data row on, named by the row in front of it.

    A data row has six or more digits and nothing else in the key column. Without such a
    row, or with nothing in front of it, columns keep their names.
    """
    names = [c for c in df.columns if c != order]
    is_data = F.coalesce(F.col(key).rlike("^[0-9]{6,}$"), F.lit(False))
    start = df.where(is_data).agg(F.min(order).alias("start"))
    first = start.first()["start"]
    if first is None:
        return df
    begin = start.scalar()
    head = (
        df.where(F.col(order) < begin)
        .agg(F.max(F.struct(order, *[quoted(c) for c in names])).alias("head"))
        .first()["head"]
    )
    rows = df.where(F.col(order) >= begin)
    if head is None:
        return rows
    labels = {c: head[c] for c in names if head[c]}
    return rows.withColumnsRenamed(labels)
