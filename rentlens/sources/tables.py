"""Listing tables, stage files, metrics and models on shared storage."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rentlens.operators.frames import shared_base


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one."""
    return f"{shared_base(spark)}/rentlens-{uuid.uuid4().hex}"


#: A listings table is a folder of versions; the highest number is the table.
VERSION = "version-"

#: Rows of one upload are one partition of the table.
UPLOAD = "upload"


def current(spark: SparkSession, path: str) -> str:
    """The folder of the table's present version; a folder without versions is the table."""
    found = _versions(spark, path)
    return f"{path.rstrip('/')}/{found[-1]}" if found else path


def scan_listings(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Listings that have a cold rent; filter and columns reach the Parquet scan."""
    df = read_listings(spark, path).where(F.col("rent_cold").isNotNull())
    return df.select(*columns) if columns else df


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(current(spark, path)).drop(UPLOAD)


def append_listings(df: DataFrame, path: str, upload: str | None = None) -> int:
    """Append all rows and return how many there were, counted while writing.

    The rows become the table's partition ``upload``, in place of any that it has, so an
    upload that is tried again under its name leaves its rows once. Without a name every
    call is an upload of its own.
    """
    spark = df.sparkSession
    seen = Observation()
    counted = df.drop(UPLOAD).observe(seen, F.count(F.lit(1)).alias("rows"))
    target = current(spark, path)
    if target == path:
        target = f"{path.rstrip('/')}/{VERSION}{1:06d}"
    named = counted.withColumn(UPLOAD, F.lit(upload or uuid.uuid4().hex))
    writer = named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(UPLOAD).parquet(target)
    return seen.get["rows"]


def replace_listings(df: DataFrame, path: str) -> None:
    """The rows as the table's next version.

    They are written beside the table and become it by one rename, so readers have the old
    rows until then, and a job that fails leaves the table as it was. The version before
    stays for readers that have begun; older ones go.
    """
    spark = df.sparkSession
    root = path.rstrip("/")
    found = _versions(spark, path)
    number = int(found[-1][len(VERSION) :]) + 1 if found else 1
    beside = f"{root}/_writing-{uuid.uuid4().hex}"
    try:
        named = df.drop(UPLOAD).withColumn(UPLOAD, F.lit(f"replaced-{number}"))
        named.write.partitionBy(UPLOAD).parquet(beside)
        _rename(spark, beside, f"{root}/{VERSION}{number:06d}")
    except Exception:
        _delete(spark, beside)
        raise
    for old in found[:-1]:
        _delete(spark, f"{root}/{old}")


def _store(spark: SparkSession, path: str):
    """Hadoop's view of a path, which reaches every store that Spark does."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, path: str) -> list[str]:
    store, place = _store(spark, path)
    if not store.exists(place):
        return []
    names = [status.getPath().getName() for status in store.listStatus(place)]
    return sorted(n for n in names if n.startswith(VERSION))


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Fails where the new name is taken, by another job that replaced the table meanwhile."""
    store, place = _store(spark, old)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        store.getUri(), spark._jsc.hadoopConfiguration()
    )
    options = spark._jvm.org.apache.hadoop.fs.Options
    none = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 0)
    context.rename(place, spark._jvm.org.apache.hadoop.fs.Path(new), none)


def _delete(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def write_stage(df: DataFrame, path: str) -> DataFrame:
    """Hand-over between jobs: written as Parquet, read back, lineage cut."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).option(
        "escape", '"'
    ).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One metrics row as one JSON object; more rows are an error."""
    if len(metrics.take(2)) > 1:
        raise ValueError("metrics have more than one row")
    metrics.coalesce(1).write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
