"""Tables in versions: each write is a new folder, and a pointer file that appears whole says which one holds.

    <root>/data/<version>/       Parquet of one write
    <root>/pointers/<number>     the version that holds from this number on

A pointer is never changed: a new one is moved into place under the next number, which fails if
another writer took that number. A write that fails, or loses that race, leaves what held before.
Going back adds a pointer to an earlier version. Frames that were read keep their folder, whatever
is published later; only `prune` deletes. What is listed and read here are names, never rows.

Defined cases: a table without pointers reads as nothing (LookupError); an empty frame is a version
like any other, its schema kept; columns may differ from version to version, each reads as it was
written; a root that doesn't exist has no history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _files(self):
        return self._path().getFileSystem(self._conf)

    def history(self) -> list[tuple[int, str]]:
        """(number, version) of every pointer, oldest first."""
        fs, folder = self._files(), self._path("pointers")
        if not fs.exists(folder):
            return []
        numbers = sorted(int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit())
        return [(n, self._said(n)) for n in numbers]

    def _said(self, number: int) -> str:
        stream = self._files().open(self._path("pointers", f"{number:012d}"))
        try:
            return str(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> str | None:
        held = self.history()
        return held[-1][1] if held else None

    def stage(self, df: DataFrame, *partition_by: str) -> str:
        """Writes a version that nobody reads yet; its name."""
        version = uuid.uuid4().hex
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/data/{version}")
        return version

    def point(self, version: str, after: int | None = None) -> int:
        """Makes a staged or earlier version the one that holds; the pointer's number.

        after: the last number that the caller has seen, where what it wrote rests on what held then; by default the last there is.
        """
        fs = self._files()
        if not fs.exists(self._path("data", version, "_SUCCESS")):
            raise LookupError(f"no whole version {version} under {self.root}")
        held = self.history()
        number = (held[-1][0] if held else 0) + 1 if after is None else after + 1
        made = self._path("pointers", f".{uuid.uuid4().hex}")
        stream = fs.create(made, False)
        stream.write(bytearray(version, "utf-8"))
        stream.close()
        # a move that doesn't replace: of two writers one gets the number
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(made), fs.makeQualified(self._path("pointers", f"{number:012d}")), none)
        except Exception as clash:
            fs.delete(made, False)
            raise RuntimeError(f"pointer {number} of {self.root} is taken") from clash
        return number

    def write(self, df: DataFrame, *partition_by: str) -> int:
        """A new version that holds from now on; its pointer's number. It fails if another came to hold since the write began."""
        held = self.history()
        return self.point(self.stage(df, *partition_by), held[-1][0] if held else 0)

    def read(self, number: int | None = None) -> DataFrame:
        """The version that holds, or that held at a number."""
        held = self.history()
        found = [v for n, v in held if number is None or n == number]
        if not found:
            raise LookupError(f"{self.root} has no version" + f" at {number}" * (number is not None))
        return self.spark.read.parquet(f"{self.root}/data/{found[-1]}")

    def rollback(self, number: int | None = None) -> int:
        """What held at a number holds again (by default: what held before the last pointer); the new pointer's number."""
        held = self.history()
        if number is None:
            if len(held) < 2:
                raise LookupError(f"{self.root} has no earlier version")
            number = held[-2][0]
        version = dict(held).get(number)
        if version is None:
            raise LookupError(f"{self.root} has no version at {number}")
        return self.point(version, held[-1][0])

    def view(self, name: str) -> None:
        """A temporary view of the version that holds now."""
        self.read().createOrReplaceTempView(name)

    def prune(self, last: int) -> list[str]:
        """Deletes the versions that none of the last pointers names, those that were staged and never held too; their names. Nobody may be writing or reading them."""
        if last < 1:
            raise ValueError("the version that holds stays")
        keep = {v for _, v in self.history()[-last:]}
        fs, folder = self._files(), self._path("data")
        gone = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        gone = sorted(v for v in gone if v not in keep)
        for v in gone:
            fs.delete(self._path("data", v), True)
        return gone
