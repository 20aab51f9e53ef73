"""Files as such: written, listed, copied and unpacked in tasks, through any file system that Arrow can name (file, hdfs, s3).

A version of a table is published by a pointer that is swapped last; a sync copies only files whose size differs; archives
are opened a member a task and decoded in a stream.
"""

from __future__ import annotations

import csv
import gzip
import io
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task gives on at once, and bytes that it copies at once.
ROWS, BYTES = 10_000, 1 << 20


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def put(path: str, body: bytes) -> None:
    """A file in one piece: written beside its place and moved there."""
    where, name = at(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    beside = f"{name}.{uuid.uuid4().hex}.tmp"
    with where.open_output_stream(beside, compression=None) as out:
        out.write(body)
    where.move(beside, name)


def write_files(rows: DataFrame, root: str, compress: bool = False) -> int:
    """Writes each row's body (binary, or text) under its key, in tasks; a key that is put again is replaced. Returns how many there were."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key, body in zip(part["key"], part["body"]):
                body = body.encode() if isinstance(body, str) else bytes(body)
                put(f"{root}/{key}", gzip.compress(body, mtime=0) if compress else body)
            yield pd.DataFrame({"n": [len(part)]})

    return rows.select("key", "body").mapInPandas(of, "n long").agg(F.sum("n")).first()[0] or 0


# listings and syncs


def listed(spark: SparkSession, root: str, feed: str | None = None, days: tuple[date, date] | None = None) -> DataFrame:
    """(key, length, modified) of all files below the root, or of a feed's day folders from one day to another; no file is opened.

    With days only their folders are listed, so the time doesn't grow with what lies in others.
    """
    root = root.rstrip("/")
    below = [f"{root}/{feed}" if feed else root]
    if days:
        below = [f"{below[0]}/{days[0] + timedelta(n):%Y/%m/%d}" for n in range((days[1] - days[0]).days + 1)]
        below = [p for p in below if at(p)[0].get_file_info(at(p)[1]).type == fs.FileType.Directory]
    plain = at(root)[1]
    try:
        if not below:
            raise AnalysisException("PATH_NOT_FOUND")
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(below)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, length long, modified timestamp")
    key = F.regexp_replace("path", rf"^.*?\Q{plain}\E/", "")
    return rows.select(key.alias("key"), "length", F.col("modificationTime").alias("modified"))


def changed(there: DataFrame, here: DataFrame) -> DataFrame:
    """The files of one listing that the other hasn't or has with another size."""
    return there.join(here.select("key", "length"), ["key", "length"], "left_anti")


def synced(spark: SparkSession, source: str, target: str, feed: str | None = None, days: tuple[date, date] | None = None) -> list[str]:
    """Copies what is changed, in tasks, each file moved to its place when it is whole; returns the keys. A run that died is repeated."""

    def copied(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for key in part["key"]:
                (a, given), (b, name) = at(f"{source}/{key}"), at(f"{target}/{key}")
                b.create_dir(name.rsplit("/", 1)[0], recursive=True)
                beside = f"{name}.{uuid.uuid4().hex}.tmp"
                with a.open_input_stream(given, compression=None) as src, b.open_output_stream(beside, compression=None) as out:
                    while block := src.read(BYTES):
                        out.write(block)
                b.move(beside, name)
            yield part[["key"]]

    here = listed(spark, target, feed, days).where(~F.col("key").endswith(".tmp"))
    work = changed(listed(spark, source, feed, days), here).select("key")
    done = work.repartition(spark.sparkContext.defaultParallelism).mapInPandas(copied, "key string")
    return sorted(r.key for r in done.collect())  # the names of new files


# versions


def publish(df: DataFrame, folder: str, stop_before_pointer: bool = False) -> str:
    """Writes df as a new version and makes it the current one by the last step, a small file moved into its place.

    A run that dies before leaves readers on the version before. stop_before_pointer: dies there, for tests.
    """
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/versions/{version}")
    if stop_before_pointer:
        raise RuntimeError("stopped before the pointer")
    put(f"{folder}/current", version.encode())
    return version


def version_of(folder: str) -> str:
    where, name = at(f"{folder}/current")
    with where.open_input_stream(name) as given:
        return given.read().decode()


def current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/versions/{version_of(folder)}")


def recovered(folder: str) -> list[str]:
    """Deletes the versions that aren't current, such as those of runs that died; returns them. Not while one is being written."""
    where, name = at(f"{folder}/versions")
    gone = [i.path for i in where.get_file_info(fs.FileSelector(name)) if i.base_name != version_of(folder)]
    for path in gone:
        where.delete_dir(path)
    return sorted(p.rsplit("/", 1)[1] for p in gone)


# archives


def members(paths: DataFrame) -> DataFrame:
    """(path, member, size) of the CSV files in zip archives; only their directories are read."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path in part["path"]:
                where, name = at(path)
                with where.open_input_file(name) as given, zipfile.ZipFile(given) as archive:
                    found = [(path, i.filename, i.file_size) for i in archive.infolist() if i.filename.lower().endswith(".csv")]
                yield pd.DataFrame(found, columns=["path", "member", "size"])

    return paths.select("path").mapInPandas(of, "path string, member string, size long")


def unzipped(found: DataFrame, columns: Sequence[str], encoding: str = "cp1252") -> DataFrame:
    """The rows of archives' members as strings, with path and member: a member a task, decoded and given on in a stream.

    Columns are found by the header of each member; one that a member lacks is null. Bytes that the encoding hasn't become
    replacement characters.
    """
    names = ["path", "member", *columns]

    def of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for path, member in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                where, name = at(path)
                with where.open_input_file(name) as given, zipfile.ZipFile(given) as archive, archive.open(member) as raw:
                    held: list[list] = []
                    for row in csv.DictReader(io.TextIOWrapper(raw, encoding=encoding, errors="replace", newline="")):
                        held.append([path, member, *(row.get(c) for c in columns)])
                        if len(held) == ROWS:
                            yield batch(held)
                            held = []
                    if held:
                        yield batch(held)

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names)

    dealt = found.select("path", "member").repartition(F.col("path"), F.col("member"))
    return dealt.mapInArrow(of, ", ".join(f"`{c}` string" for c in names))
