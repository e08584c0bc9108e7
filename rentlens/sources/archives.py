"""ZIP archives of CSV files as a Spark data source.

One partition per archive or per entry. A task reads an archive's directory by ranges from
its end, then inflates one entry in chunks and hands its rows on in batches; neither the
archive nor an entry is ever held whole, whatever their sizes.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import posixpath
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from rentlens.schemas import strings

FORMAT = "zip_csv"

#: Rows of a batch, and bytes read from an archive at a time.
BATCH, CHUNK = 5_000, 1 << 20

#: A cell may be as long as a cell can be.
CELL_LIMIT = 2**31 - 1

#: Column that has the archive a row is from.
SOURCE = "path"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; without a scheme that is the local one."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(path)


def archives_at(path: str) -> list[str]:
    """A single archive, all archives of a folder, or those that match a last part with marks."""
    store, inside = file_system(path)
    folder, last = posixpath.split(inside.rstrip("/"))
    prefix = path[: len(path.rstrip("/")) - len(last)]
    if any(c in last for c in "*?["):
        found = store.get_file_info(fs.FileSelector(folder))
        names = [f.base_name for f in found if f.type == fs.FileType.File]
        return [prefix + n for n in sorted(names) if fnmatch.fnmatchcase(n, last)]
    info = store.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(inside))
    names = [f.base_name for f in found if f.type == fs.FileType.File]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.lower().endswith(".zip")]


def opened(path: str) -> zipfile.ZipFile:
    """The archive over a file that is read by ranges; only its directory is read here."""
    store, inside = file_system(path)
    return zipfile.ZipFile(io.BufferedReader(store.open_input_file(inside), CHUNK))


def csv_entries(archive: zipfile.ZipFile) -> list[str]:
    return [n for n in archive.namelist() if n.lower().endswith(".csv")]


def lines(archive: zipfile.ZipFile, entry: str) -> Iterator[list[str]]:
    csv.field_size_limit(CELL_LIMIT)
    with archive.open(entry) as member:
        yield from csv.reader(io.TextIOWrapper(member, encoding="utf-8-sig", newline=""))


@dataclass
class Part(InputPartition):
    """An archive, and one entry of it; without one its first CSV file."""

    path: str
    entry: str | None = None
    number: int = 0


class ZipCsvSource(DataSource):
    """Options: ``entries`` (first, all), ``maxRows`` per entry, ``headers`` (names only)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        reader = ZipCsvReader(self.options, StructType())
        with ThreadPoolExecutor(16) as pool:
            found = pool.map(reader.header, reader.partitions())
        return strings([SOURCE, *dict.fromkeys(n for names in found for n in names)])

    def reader(self, schema: StructType) -> ZipCsvReader:
        return ZipCsvReader(self.options, schema)


class ZipCsvReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.paths = paths
        self.names = schema.names
        self.every = options.get("entries", "first") == "all"
        self.most = int(options.get("maxRows", 0))
        self.headers = options.get("headers", "false").lower() == "true"

    def partitions(self) -> list[Part]:
        archives = [a for p in self.paths for a in archives_at(p)]
        if not self.every:
            # The first entry is found by the task, so the driver opens no archive.
            return [Part(a) for a in archives]
        with ThreadPoolExecutor(16) as pool:
            entries = list(pool.map(self._entries, archives))
        return [Part(a, e, i) for a, own in zip(archives, entries) for i, e in enumerate(own)]

    @staticmethod
    def _entries(path: str) -> list[str]:
        with opened(path) as archive:
            return csv_entries(archive)

    def header(self, part: Part) -> list[str]:
        with opened(part.path) as archive:
            entry = part.entry or next(iter(csv_entries(archive)), None)
            return [n.strip() for n in next(lines(archive, entry), [])] if entry else []

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if self.headers:
            names = self.header(part)
            n = len(names)
            columns = [[part.path] * n, [part.number] * n, list(range(n)), names]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "entry", "at", "name"]
            )
            return
        with opened(part.path) as archive:
            entry = part.entry or next(iter(csv_entries(archive)), None)
            if entry:
                yield from self._batches(part.path, lines(archive, entry))

    def _batches(self, path: str, rows: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        header = {n.strip(): i for i, n in enumerate(next(rows, []))}
        at = [header.get(n) for n in self.names]
        own = [n == SOURCE and i is None for n, i in zip(self.names, at)]
        held: list[list[str]] = []
        done = 0
        for row in rows:
            if self.most and done >= self.most:
                break
            if row:
                held.append(row)
                done += 1
            if len(held) >= BATCH:
                yield self._batch(path, held, at, own)
                held = []
        if held:
            yield self._batch(path, held, at, own)

    def _batch(self, path: str, rows: list[list[str]], at: list, own: list) -> pa.RecordBatch:
        columns = []
        for i, is_path in zip(at, own):
            if is_path:
                cells = [path] * len(rows)
            elif i is None:
                cells = [None] * len(rows)
            else:
                cells = [r[i] if i < len(r) and r[i] != "" else None for r in rows]
            columns.append(pa.array(cells, pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=list(self.names))


def _source(spark: SparkSession, path: str | list[str], entries: str):
    spark.dataSource.register(ZipCsvSource)
    reader = spark.read.format(FORMAT).option("entries", entries)
    return reader.option("paths", json.dumps([path] if isinstance(path, str) else path))


def zip_columns(spark: SparkSession, path: str | list[str], entries: str = "first") -> list[str]:
    """Header names of all archives in their first order of appearance, read in tasks."""
    reader = _source(spark, path, entries).option("headers", True)
    found = reader.schema("path string, entry int, at int, name string").load()
    first = found.groupBy("name").agg(F.min(F.struct("path", "entry", "at")).alias("first"))
    return [r["name"] for r in first.orderBy("first").collect()]


def scan_zip_csv(
    spark: SparkSession,
    path: str | list[str],
    names: list[str] | None = None,
    max_rows: int | None = None,
    entries: str = "first",
) -> DataFrame:
    """Rows of the archives at a path, as text, with the archive as ``path``.

    Columns are found by header name, by default those of all headers together; a name that
    a file lacks is null, and so is an empty cell. ``max_rows`` is per entry. An archive
    without a CSV file has no rows.
    """
    columns = names if names is not None else zip_columns(spark, path, entries)
    reader = _source(spark, path, entries).option("maxRows", max_rows or 0)
    return reader.schema(strings([SOURCE, *[c for c in columns if c != SOURCE]])).load()


def write_zip_csv(df: DataFrame, folder: str, entry: str = "rows.csv") -> int:
    """Every partition with rows as one archive of one CSV file; how many there are.

    An archive gets its name only when it is whole, so a retried task leaves none behind in
    part.
    """
    names = df.columns

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, inside = file_system(folder)
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        store.create_dir(inside, recursive=True)
        final = f"{inside}/part-{context.partitionId():05d}.zip"
        part = f"{final}.{context.taskAttemptId()}.tmp"
        with store.open_output_stream(part) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            with archive.open(entry, "w", force_zip64=True) as member:
                text = io.TextIOWrapper(member, encoding="utf-8", newline="")
                writer = csv.writer(text)
                writer.writerow(names)
                while first is not None:
                    writer.writerows(zip(*[c.to_pylist() for c in first.columns]))
                    first = next(batches, None)
                text.flush()
        store.move(part, final)
        yield pa.RecordBatch.from_arrays([pa.array([final])], names=["file"])

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    return texts.mapInArrow(write, "file string").count()
