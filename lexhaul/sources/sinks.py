"""[S16] Texts as files, written by tasks beside their place and moved there by the driver only when all are whole."""

from __future__ import annotations

import contextlib
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Staged(WriterCommitMessage):
    """Names in the folder, and where a task has put their texts for the time being."""

    files: list[tuple[str, str]] = field(default_factory=list)


class FileWriter(DataSourceWriter):
    """Two phases: a task writes below `.staged-<write>` under names of its own and reports them; commit moves what successful tasks have reported, abort moves nothing. Both remove the rest."""

    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder, overwrite
        self.staging = os.path.join(folder, f".staged-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> Staged:
        os.makedirs(self.staging, exist_ok=True)
        out = Staged()
        for row in iterator:
            name, text = row["name"], row["text"]
            if not name or name in (".", "..") or os.path.basename(name) != name or name.startswith(".staged-"):
                raise ValueError(f"not a file name: {name!r}")
            at = os.path.join(self.staging, uuid.uuid4().hex)
            with open(at, "w", encoding="utf-8", newline="") as f:
                f.write(text or "")
            out.files.append((name, at))
        return out

    def commit(self, messages: list[Staged | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _ in files]
        try:
            if len(set(names)) < len(names):
                raise ValueError("a file name comes twice")
            if not self.overwrite and (there := [n for n in names if os.path.exists(os.path.join(self.folder, n))]):
                raise FileExistsError(f"{there[0]} is there already")
            for name, at in files:
                os.replace(at, os.path.join(self.folder, name))
        finally:
            self.clean()

    def clean(self) -> None:
        """Removes what this write has put aside, and what tasks that were killed late have left of writes of a day ago or more."""
        shutil.rmtree(self.staging, ignore_errors=True)
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            at = os.path.join(self.folder, name)
            with contextlib.suppress(OSError):
                if name.startswith(".staged-") and time.time() - os.path.getmtime(at) > 86_400:
                    shutil.rmtree(at, ignore_errors=True)

    def abort(self, messages: list[Staged | None]) -> None:
        self.clean()


class TextFiles(DataSource):
    """Format `text_files`: rows of name, text; the folder is the path. Mode append refuses names that are there, overwrite replaces these and leaves all others."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: object, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"], overwrite)


def write_files(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A file for each row of `df` (name, text; null text: an empty file) in a folder that the driver and all executors see.

    A failed write leaves the files as they were (a task that is killed late may leave a hidden `.staged-` folder until a later write), a task that runs twice writes nothing twice. A name that comes twice, that is
    there already (unless `overwrite`) or that leads out of the folder is an error, and nothing is written.
    """
    df.sparkSession.dataSource.register(TextFiles)
    df.select("name", "text").write.format("text_files").mode("overwrite" if overwrite else "append").save(folder)
