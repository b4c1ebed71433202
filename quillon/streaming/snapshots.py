"""Output that is rewritten as a whole, again and again, and read back at the next start.

Every version is a folder of its own. A version counts once its marker, a file named by its number and holding the folder's name, has
been renamed into place: a crash before leaves the version before, and of two writers of one number the later fails. Versions
that no marker names, and old ones, are removed by ``prune``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.joins import last_write, pending
from quillon.operators.split import positions


class Snapshots:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(folder))] if self.fs.exists(self._at(folder)) else []

    def version(self) -> int:
        """The last version, 0 before the first."""
        return max((int(n) for n in self._names("_versions") if re.fullmatch(r"\d+", n)), default=0)

    def _folder(self, version: int) -> str:
        stream = self.fs.open(self._at(f"_versions/{version:012d}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version's rows, the last one's by default; None before the first."""
        version = version or self.version()
        return self.spark.read.parquet(f"{self.path}/{self._folder(version)}") if version else None

    def write(self, df: DataFrame, after: int | None = None) -> int:
        """A new version behind ``after``, the last one by default; raises if another writer was first."""
        number = (self.version() if after is None else after) + 1
        folder = f"data-{number:012d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        marker, aside = self._at(f"_versions/{number:012d}"), self._at(f"_versions/_{uuid.uuid4().hex}")
        stream = self.fs.create(aside)
        stream.write(bytearray(folder.encode()))
        stream.close()
        if self.fs.exists(marker) or not self.fs.rename(aside, marker):
            self.fs.delete(aside, False)
            self.fs.delete(self._at(folder), True)
            raise RuntimeError(f"version {number} was written by another")
        return number

    def prune(self, keep: int = 1) -> None:
        """Remove all but the last versions, and what was never finished."""
        numbers = sorted(int(n) for n in self._names("_versions") if re.fullmatch(r"\d+", n))
        kept = {self._folder(n) for n in numbers[-keep:]}
        for n in numbers[:-keep]:
            self.fs.delete(self._at(f"_versions/{n:012d}"), False)
        for name in self._names(""):
            if name.startswith("data-") and name not in kept:
                self.fs.delete(self._at(name), True)


def rewrite_every(spark: SparkSession, items: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, key: str, every: int) -> DataFrame:
    """``step`` over the items that the output hasn't yet, ``every`` at a time; after each lot the output is rewritten with it.

    A run that begins after a crash finds the lots that were finished and goes on behind them.
    """
    store = Snapshots(spark, path)
    held = store.read()
    todo = positions(pending(items, held, key) if held is not None else items, [key], "_nth")
    for lot in range(-(-todo.count() // every)):
        new = step(todo.where(f"_nth >= {lot * every} and _nth < {(lot + 1) * every}").drop("_nth"))
        both = new if held is None else held.unionByName(new)
        store.write(last_write(both, key, [key]))
        held = store.read()
    return held if held is not None else step(items.limit(0))
