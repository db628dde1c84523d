"""Numbered manifests: small JSON files, each written once, the highest number being the present state.

A manifest is created only if its number is free, so of two writers that build on the same state one
fails (``Conflict``) instead of undoing the other, and a reader always finds a whole state: the old one
until the new file exists. Files of earlier numbers stay for readers that began with them.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has committed the same number."""


class Manifests:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path().getFileSystem(self._conf)

    def path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _numbers(self) -> list[int]:
        at = self.path("_manifests")
        if not self.fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def last(self) -> tuple[int, list[dict]]:
        """(number, entries) of the present state; (0, []) before the first."""
        for n in reversed(self._numbers()):
            if (got := self._read(n)) is not None:
                return n, got
        return 0, []

    def _read(self, number: int) -> list[dict] | None:
        stream = self.fs.open(self.path("_manifests", f"{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:  # still being written
            return None
        finally:
            stream.close()

    def commit(self, number: int, entries: list[dict]) -> None:
        """Make ``entries`` the state after ``number``. Hard to see half written: a reader that can't parse
        the highest number takes the one before, which was the state when it began."""
        try:
            out = self.fs.create(self.path("_manifests", f"{number + 1:012d}.json"), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                raise Conflict(f"{self.folder} has a state {number + 1} already") from e
            raise
        try:
            out.write(bytearray(json.dumps(entries).encode()))
        finally:
            out.close()
