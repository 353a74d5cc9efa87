"""[S1] Files below folders as a Spark data source: hidden names too, sorted, each file once."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexhaul.operators.index import numbered
from lexhaul.sources.files import SUPPORTED

SCHEMA = "path string, real string, entry int, place string, length long, content binary"


@dataclass
class Folder(InputPartition):
    """One folder without what lies below it, or one file that was named itself."""

    entry: int
    path: str
    place: tuple[str, ...]
    named: bool = False


def suffix(name: str) -> str:
    return os.path.splitext(name)[1].lower()


class FolderReader(DataSourceReader):
    """The driver only walks folders, and does not follow links to them; each is a partition, whose task lists and reads its files."""

    def __init__(self, entries: list[str], suffixes: Sequence[str]) -> None:
        self.entries, self.suffixes = entries, tuple(suffixes)

    def partitions(self) -> list[Folder]:
        out = []
        for n, entry in enumerate(self.entries):
            entry = os.path.expanduser(entry)
            if not os.path.isdir(entry):
                out.append(Folder(n, entry, (), named=True))
                continue
            for at, below, _ in os.walk(entry):
                below.sort()
                rest = os.path.relpath(at, entry)
                out.append(Folder(n, at, () if rest == "." else tuple(rest.split(os.sep))))
        return out or [Folder(0, "", (), named=True)]

    def read(self, part: Folder) -> Iterator[tuple]:
        names = [part.path] if part.named else sorted(os.path.join(part.path, x) for x in os.listdir(part.path) if suffix(x) in self.suffixes)
        for path in names:
            if not path or not part.named and not os.path.isfile(path):
                continue
            content = None
            if os.path.isfile(path):
                with open(path, "rb") as f:
                    content = f.read()
            place = "\x00".join([*part.place, os.path.basename(path)])  # orders like the parts of a path one by one
            yield path, os.path.realpath(path) if os.path.exists(path) else path, part.entry, place, len(content) if content is not None else None, content


class Listing(DataSource):
    """Format `listing`; options: entries, a list of folders and files one to a line, and suffixes, separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FolderReader:
        return FolderReader([x for x in self.options["entries"].split("\n") if x], self.options.get("suffixes", ",".join(SUPPORTED)).split(","))


def collect_files(spark: SparkSession, entries: list[str], suffixes: Sequence[str] = SUPPORTED) -> DataFrame:
    """position, path, length, content of all files: those below folders if their suffix is supported, those named whatever they are.

    Hidden files are listed, links to folders not followed. A file that is reached twice, also by a link, counts
    once, where it is reached first: in order of `entries`, inside of one by sorted path. A named path that is not there
    keeps its row without content, so that it can be reported. All executors have to see the folders; a file is read whole by one task, and
    what is sorted are paths, not contents.
    """
    spark.dataSource.register(Listing)
    found = spark.read.format("listing").option("entries", "\n".join(entries)).option("suffixes", ",".join(suffixes)).load()
    first = found.drop("content").groupBy("real").agg(F.min_by(F.struct("path", "entry", "place"), F.struct("entry", "place")).alias("f")).select("f.*")
    ranked = numbered(first, ["entry", "place"]).select("path", "entry", (F.col("id") - 1).alias("position"))
    return found.join(ranked, ["path", "entry"]).select("position", "path", "length", "content")
