"""Captures as a source: files named by their time in day folders, read in batches and as a stream.

<feed>/YYYY/MM/DD/<feed>_<time>Z.json.gz. The window of a read, `after` < time <= `until`, chooses day folders and then file
names, so files outside of it are neither listed nor opened; a stream's offset is the time of the last name. The window is an
option of each read and no pushed filter, as this Spark version keeps a Python source's pushed filters for later queries of
the same frame, which would then lack rows.
"""

from __future__ import annotations

import gzip
import json
import re
from collections.abc import Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from harborlight.sources.files import at

SCHEMA = "captured_at timestamp, last_updated long, station_id string, num_docks_available long, num_bikes_available long, is_installed long, is_returning long, last_reported long, file string"
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")][2:-1]
FOREVER = datetime(1900, 1, 1), datetime(9999, 12, 31)


def time_of(name: str) -> datetime | None:
    found = re.search(r"_(\d{8}T\d{6})Z\.json\.gz$", name)
    return datetime.strptime(found[1], "%Y%m%dT%H%M%S") if found else None


def folders(path: str, after: datetime, until: datetime) -> Iterator[str]:
    """The day folders from the day of `after` to that of `until`, going down only into years and months that can hold one."""
    where, root = at(path)

    def below(folder: str, low: list[int], high: list[int]) -> Iterator[str]:
        if not low:
            yield folder
            return
        for i in sorted(where.get_file_info(fs.FileSelector(folder, allow_not_found=True)), key=lambda i: i.path):
            if i.type == fs.FileType.Directory and i.base_name.isdigit() and low[0] <= int(i.base_name) <= high[0]:
                n = int(i.base_name)
                yield from below(i.path, low[1:] if n == low[0] else [0] * (len(low) - 1), high[1:] if n == high[0] else [99] * (len(high) - 1))

    yield from below(root, [after.year, after.month, after.day], [until.year, until.month, until.day])


def chosen(path: str, after: datetime, until: datetime) -> list[tuple[datetime, str]]:
    """(time, file) of the captures with after < time <= until, in order."""
    where, _ = at(path)
    out = []
    for folder in folders(path, after, until):
        for i in where.get_file_info(fs.FileSelector(folder)):
            t = time_of(i.path)
            if t and after < t <= until:
                out.append((t, i.path))
    return sorted(out)


class File(InputPartition):
    def __init__(self, path: str, name: str, t: datetime):
        self.path, self.name, self.t = path, name, t


def rows_of(part: File) -> Iterator[tuple]:
    """A file's stations; missing fields are null, and a document that is no feed gives nothing."""
    where, _ = at(part.path)
    with where.open_input_stream(part.name, compression=None) as given:
        document = json.loads(gzip.decompress(given.read()))
    stations = (document.get("data") or {}).get("stations") if isinstance(document, dict) else None
    for s in stations or []:
        yield (part.t, document.get("last_updated"), *(s.get(f) for f in FIELDS), part.name.rsplit("/", 1)[1])


class Reader(DataSourceReader):
    def __init__(self, path: str, after: datetime, until: datetime):
        self.path, self.after, self.until = path, after, until

    def partitions(self) -> list[File]:
        return [File(self.path, name, t) for t, name in chosen(self.path, self.after, self.until)] or [File(self.path, "", FOREVER[0])]

    def read(self, partition: File) -> Iterator[tuple]:
        return rows_of(partition) if partition.name else iter(())


class StreamReader(DataSourceStreamReader):
    """Offsets are times of names: a batch has the captures since the one before, so a run with a checkpoint reads only what is new."""

    def __init__(self, path: str):
        self.path, self.last = path, FOREVER[0].isoformat()

    def initialOffset(self) -> dict:
        return {"until": FOREVER[0].isoformat()}

    def latestOffset(self) -> dict:
        found = chosen(self.path, datetime.fromisoformat(self.last), FOREVER[1])
        if found:
            self.last = found[-1][0].isoformat()
        return {"until": self.last}

    def partitions(self, start: dict, end: dict) -> list[File]:
        self.last = max(self.last, end["until"])
        return [File(self.path, name, t) for t, name in chosen(self.path, datetime.fromisoformat(start["until"]), datetime.fromisoformat(end["until"]))]

    def read(self, partition: File) -> Iterator[tuple]:
        return rows_of(partition)


class Captures(DataSource):
    """spark.read.format("captures").load("<root>/<feed>"), with the options after and until, or readStream."""

    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        after, until = (datetime.fromisoformat(self.options.get(k, v.isoformat())) for k, v in zip(("after", "until"), FOREVER))
        return Reader(self.options["path"], after, until)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(Captures)
    return spark


def read(spark: SparkSession, folder: str, after: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """Stations of the captures with after < time <= until."""
    rows = registered(spark).read.format("captures")
    for name, t in (("after", after), ("until", until)):
        rows = rows.option(name, t.isoformat()) if t else rows
    return rows.load(folder)
