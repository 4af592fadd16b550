"""Keyed tables as immutable versions, for state that streams and imports keep up to date."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinfold.session import write_table_at


class SnapshotTable:
    """A table with one row for each value of `keys`, kept as files that never change and a log of versions.

    A commit writes the rows that changed as a folder of its own and then, by a rename that fails if the name is taken, an
    entry `log/<version>.json` naming the folders that make up the version. A reader sees one whole version, whatever is
    written meanwhile; of two writers of one version the second fails. Each entry holds the number of the batch that it came
    from, so a batch that a stream runs again changes nothing. After `compact_every` commits of changes the next one writes all
    rows; versions older than the last `keep` and folders that none of those name are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], compact_every: int = 8, keep: int = 4):
        self.spark, self.path, self.keys, self.compact_every, self.keep = spark, path.rstrip("/"), keys, compact_every, keep
        self.schema = StructType.fromDDL(schema)
        self.values = [f.name for f in self.schema if f.name not in keys]

    # The log, through the file system that Spark itself uses for the path.
    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        fs, at = self._fs(), self._at(folder)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("log") if n.endswith(".json") and n[0] != ".")

    def entry(self, version: int | None = None) -> dict | None:
        """What a version is made of; the latest if none is given, None before the first commit."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        stream = self._fs().open(self._at(f"log/{version:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, entry: dict) -> None:
        jvm, name = self.spark._jvm, f"log/.{uuid.uuid4().hex}"
        out = self._fs().create(self._at(name), False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("log").toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._at(name), self._at(f"log/{entry['version']:012d}.json"), self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))

    # The rows.
    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add("__version", "long").add("__gone", "boolean")

    def _folder(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._stored()).parquet(f"{self.path}/data/{name}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given; empty before the first commit."""
        entry = self.entry(version)
        if entry is None:
            return self.spark.createDataFrame([], self.schema)
        return self._rows(entry["folders"])

    def _rows(self, folders: list[str]) -> DataFrame:
        first = self._folder(folders[0])  # all rows of its version, none gone
        if len(folders) == 1:
            return first.select(*self.schema.names)
        rows = first
        for f in folders[1:]:
            rows = rows.unionByName(self._folder(f))
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct("__gone", *self.values), "__version").alias("x"))
        return last.filter("NOT x.__gone").select(*(F.col(c) if c in self.keys else F.col(f"x.{c}").alias(c) for c in self.schema.names))

    def done(self, batch: int) -> bool:
        """Whether a batch is part of the table already."""
        entry = self.entry()
        return entry is not None and entry["batch"] >= batch

    def commit(self, changes: DataFrame, batch: int, gone: DataFrame | None = None) -> bool:
        """A new version in which `changes` (one row a key) replace the rows of their keys, and the keys in `gone` have none;
        False, and nothing is done, if the batch or a later one is committed. The two may be made from this table itself."""
        before = self.entry()
        if before is not None and before["batch"] >= batch:
            return False
        version, folder = (before["version"] if before else 0) + 1, f"{batch}-{uuid.uuid4().hex}"
        rows = changes.select(*self.schema.names, F.lit(version).cast("bigint").alias("__version"), F.lit(False).alias("__gone"))
        if gone is not None:
            none = [F.lit(None).cast(f.dataType).alias(f.name) if f.name not in self.keys else F.col(f.name) for f in self.schema]
            rows = rows.unionByName(gone.select(*none, F.lit(version).cast("bigint").alias("__version"), F.lit(True).alias("__gone")))
        folders = before["folders"] if before else []
        if before is not None and len(folders) <= self.compact_every:
            write_table_at(rows, f"{self.path}/data/{folder}")
            folders = [*folders, folder]
        else:
            if before is not None:  # the changes once, as they may be made from the table
                write_table_at(rows, f"{self.path}/data/{folder}-changes")
                rows = self._rows([*folders, f"{folder}-changes"]).withColumns({"__version": F.lit(version).cast("bigint"), "__gone": F.lit(False)})
            else:
                rows = rows.filter("NOT __gone")
            write_table_at(rows, f"{self.path}/data/{folder}")
            folders = [folder]
        self._publish({"version": version, "batch": batch, "folders": folders})
        self._clean()
        return True

    def _clean(self) -> None:
        known, fs = self.versions(), self._fs()
        for v in known[: -self.keep]:
            fs.delete(self._at(f"log/{v:012d}.json"), False)
        used = {f for v in known[-self.keep :] for f in self.entry(v)["folders"]}
        for name in self._names("data"):
            if name not in used:
                fs.delete(self._at(f"data/{name}"), True)
