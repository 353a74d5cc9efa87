"""Log-structured tables of Parquet: immutable runs, deletions as rows, merge on read, compaction, numbered pointers."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of one size that are merged into one.
FAN = 8
#: A pointer that cannot be read counts as still being written for this long.
PATIENCE_S = 600.0


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class WriteConflict(OSError):
    """Another writer has published first; read again and repeat."""


class Pointers:
    """Numbered pointer files `CURRENT-<n>` below `base`, each a JSON state; the highest that can be read holds.

    A writer creates the number after the one that it has read, and creation fails if the file exists, so of two writers
    one gets a WriteConflict. That needs a file system whose create-if-absent is atomic: HDFS and local disks are,
    object stores only with conditional writes. A pointer that is there but not yet whole is not read, and still
    blocks its number; one that a crash left like that is passed over after PATIENCE_S.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base.rstrip("/")

    def pointers(self) -> list[tuple[int, str]]:
        """Number and path of every pointer, oldest first."""
        fs, at = file_system(self.spark, f"{self.base}/CURRENT-*")
        paths = [s.getPath() for s in fs.globStatus(at) or []]
        return sorted((int(p.getName().rpartition("-")[2]), p.toString()) for p in paths if p.getName().rpartition("-")[2].isdigit())

    def state(self, path: str) -> dict | None:
        """What a pointer holds; null if it is gone or not whole."""
        fs, at = file_system(self.spark, path)
        try:
            stream = fs.open(at)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        except Exception as e:
            if isinstance(e, json.JSONDecodeError) or "FileNotFound" in str(e):
                return None
            raise

    def latest(self) -> tuple[int, dict | None]:
        """The number that a writer has to follow, and the state that holds."""
        found = self.pointers()
        while True:
            last = found[-1][0] if found else 0
            for number, path in reversed(found):
                if (state := self.state(path)) is not None:
                    return (last if number == last or self.abandoned(found[-1][1]) else number), state
            seen, found = found, self.pointers()
            if found == seen:  # else all that were listed have been followed and removed meanwhile
                return (last if found and self.abandoned(found[-1][1]) else 0), None

    def abandoned(self, path: str) -> bool:
        fs, at = file_system(self.spark, path)
        return fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > PATIENCE_S

    def current(self) -> dict | None:
        return self.latest()[1]

    def publish(self, state: dict, after: int, keep: int = 2) -> None:
        """Makes `state` current if nobody has followed pointer `after` yet; of the older pointers `keep` - 1 stay."""
        fs, target = file_system(self.spark, f"{self.base}/CURRENT-{after + 1:012d}")
        try:
            out = fs.create(target, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or fs.exists(target):
                raise WriteConflict(f"{target.toString()} was made by another writer") from e
            raise
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        for number, path in self.pointers():
            if number <= after + 1 - keep:
                fs.delete(file_system(self.spark, path)[1], False)


class RunStore:
    """Tables below `base` whose rows are replaced or deleted by key, at a cost that follows the change.

    tables: name to (DDL of the columns, key column), all of one kind of key, a long. A write adds one run: a folder
    `<table>/run=<n>-<id>` of new rows for each table, and one of deleted keys, which take effect on earlier runs only. Nothing
    is ever written again or moved, so a reader keeps what it has begun with. Reads scan the runs that the pointer names at
    once and drop rows whose key a later run deletes. compact() merges neighbouring runs; vacuum() removes what no kept
    pointer names.
    """

    def __init__(self, spark: SparkSession, base: str, tables: dict[str, tuple[str, str]]) -> None:
        self.spark, self.base, self.tables = spark, base.rstrip("/"), tables
        self.log = Pointers(spark, base)

    def fresh(self) -> dict:
        return {"runs": [], "next": 1}

    def scan(self, name: str, ddl: str, runs: list[dict]) -> DataFrame:
        """The rows of some runs with their run's number as `_run`."""
        paths = [f"{self.base}/{name}/run={r['run']}" for r in runs if r["rows"].get(name)]
        if not paths:
            return self.spark.createDataFrame([], f"{ddl}, _run long")
        found = self.spark.read.schema(f"{ddl}, run string").option("basePath", f"{self.base}/{name}").parquet(*paths)
        return found.withColumn("_run", F.substring_index("run", "-", 1).cast("long")).drop("run")

    def deletions(self, runs: list[dict]) -> tuple[DataFrame, int]:
        """Deleted keys with the last run that deletes them, and how many there are at most, which the pointer knows."""
        return self.scan("deleted", "key long", runs).groupBy("key").agg(F.max("_run").alias("_gone")), sum(r["rows"].get("deleted", 0) for r in runs)

    def live(self, name: str, state: dict, runs: list[dict] | None = None) -> DataFrame:
        """Rows of `runs` (default: all) that no run of `state` deletes. Few deletions are broadcast, many are joined by a shuffle."""
        ddl, key = self.tables[name]
        rows = self.scan(name, ddl, state["runs"] if runs is None else runs)
        gone, n = self.deletions(state["runs"])
        if not n:
            return rows.drop("_run")
        gone = F.broadcast(gone) if n <= 200_000 else gone
        return rows.join(gone, (rows[key] == gone["key"]) & (gone["_gone"] > rows["_run"]), "left_anti").drop("_run")

    def read(self, name: str) -> DataFrame:
        return self.live(name, self.log.current() or self.fresh())

    def add_run(self, state: dict, rows: dict[str, DataFrame | Callable[[dict], DataFrame]], deleted: DataFrame | None = None, number: int | None = None) -> dict:
        """Writes a run and returns what a pointer says of it; readers do not see it yet. deleted: a column key. Rows may be a function of the run's tables that are written before them."""
        run = {"run": f"{number or state['next']:012d}-{uuid.uuid4().hex[:12]}", "rows": {}}
        written: dict[str, DataFrame] = {}
        for name, df in [*rows.items(), *([("deleted", deleted.select(F.col("key").cast("long")).distinct())] if deleted is not None else [])]:
            at = f"{self.base}/{name}/run={run['run']}"
            df = df(written) if callable(df) else df
            df.write.option("compression", "zstd").parquet(at)
            written[name] = self.spark.read.schema(df.schema).parquet(at)
            run["rows"][name] = written[name].count()
        return run

    def append(self, rows: dict[str, DataFrame], deleted: DataFrame | None = None, more: dict | None = None, replace: bool = False) -> dict:
        """One run on top of the current ones (with `replace`: instead of them) and a pointer that also holds `more`; returns the new state."""
        number, state = self.log.latest()
        state = state or self.fresh()
        run = self.add_run(state, rows, deleted)
        after = {**state, **(more or {}), "runs": [*([] if replace else state["runs"]), run], "next": state["next"] + 1}
        self.publish(after, number)
        return after

    def publish(self, state: dict, after: int) -> None:
        self.log.publish(state, after)

    def due(self, runs: list[dict]) -> int:
        """How many of the newest runs to merge: as soon as FAN of them are of one tier, all smaller ones counted as one; tiers are powers of FAN."""
        tier = [int(math.log(max(1, sum(r["rows"].values())), FAN)) for r in runs]
        for t in sorted(set(tier)):
            n = next((k for k, x in enumerate(reversed(tier)) if x > t), len(tier))
            own = tier[len(tier) - n :]
            if own.count(t) + (min(own, default=t) < t) >= FAN:
                return n
        return 0

    def compact(self, newest: int | None = None) -> int:
        """Merges the `newest` runs (default: those that are due) into one without deleted rows; returns how many.

        The merged run takes the number of its last one, so deletions that earlier runs still need keep their place; once the
        oldest run is among the merged, none is needed. Nothing happens to readers; a writer that comes between is a
        WriteConflict.
        """
        number, state = self.log.latest()
        if state is None:
            return 0
        n = self.due(state["runs"]) if newest is None else min(newest, len(state["runs"]))
        if n < 1 or (newest is None and n < 2):
            return 0
        older, merged = state["runs"][:-n], state["runs"][-n:]
        rows = {name: self.live(name, state, merged) for name in self.tables}
        run = self.add_run(state, rows, self.deletions(merged)[0] if older else None, int(merged[-1]["run"].partition("-")[0]))
        self.publish({**state, "runs": [*older, run]}, number)
        return n

    def vacuum(self, min_age_s: float = 86_400.0) -> list[str]:
        """Deletes runs that no pointer names and that are older than `min_age_s`, so that a run being written stays; returns their paths."""
        named = {r["run"] for _, path in self.log.pointers() for r in (self.log.state(path) or self.fresh())["runs"]}
        gone = []
        for name in [*self.tables, "deleted"]:
            fs, at = file_system(self.spark, f"{self.base}/{name}/run=*")
            for s in fs.globStatus(at) or []:
                if s.getPath().getName().removeprefix("run=") not in named and time.time() - s.getModificationTime() / 1000 >= min_age_s:
                    gone.append(s.getPath().toString())
                    fs.delete(s.getPath(), True)
        return gone
