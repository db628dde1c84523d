"""Versioned tables on parquet: every write is a new version, a numbered manifest lists the versions.

A version is a set of parquet folders; the manifest is small JSON, written last and only if its number
is free, so a reader sees a version whole or not at all and two writers can't undo each other.
Appends write only the new rows. A table written with ``bucket_by`` is kept in buckets by the hash of
its keys, and a merge or delete by keys rewrites only the buckets it meets.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.sources.manifest import Manifests

BUCKET = "__bucket"
#: Buckets of a table that is merged into; a merge rewrites those its keys fall into.
BUCKETS = 64


class Store:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _manifests(self, table: str) -> Manifests:
        return Manifests(self.spark, f"{self.root}/{table}")

    def versions(self, table: str) -> list[dict]:
        """Versions of a table: version, time, folders, and for a bucketed table its keys and number of buckets."""
        return self._manifests(table).last()[1]

    def _write(self, table: str, df: DataFrame, partition_by: Sequence[str], keys: Sequence[str], buckets: int) -> list[list]:
        """Write rows under a fresh name; [folder, bucket] of what was written, a bucket of null holding any key."""
        folder = f"data-{uuid.uuid4().hex}"
        at = f"{self.root}/{table}/{folder}"
        if not keys:
            (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(at)
            return [[folder, None]]
        placed = df.withColumn(BUCKET, _bucket(keys, buckets))
        placed.repartition(buckets, BUCKET).write.partitionBy(BUCKET).parquet(at)
        fs = self._manifests(table)
        names = [s.getPath().getName() for s in fs.fs.listStatus(fs.path(folder))]
        return [[f"{folder}/{n}", int(n.split("=")[1])] for n in sorted(names) if n.startswith(BUCKET)]

    def write(self, table: str, df: DataFrame, mode: str = "replace", partition_by: Sequence[str] = (), order_by: Sequence[str] = (), bucket_by: Sequence[str] = (), buckets: int = BUCKETS) -> int:
        """A new version: ``replace`` of ``df`` alone, ``append`` of the last version and ``df``."""
        at, have = self._manifests(table).last()
        last = have[-1] if have else None
        df = df.sortWithinPartitions(*order_by) if order_by else df
        if mode == "append" and last:
            bucket_by, buckets = last["keys"], last["buckets"]
        made = self._write(table, df, partition_by, bucket_by, buckets)
        before = last["folders"] if last and mode == "append" else []
        return self._commit(table, at, have, [*before, *made], bucket_by, buckets, df)

    def _commit(self, table: str, at: int, have: list[dict], folders: list[list], keys: Sequence[str], buckets: int, like: DataFrame) -> int:
        n = have[-1]["version"] + 1 if have else 1
        entry = {"version": n, "time": time.time(), "folders": folders, "keys": list(keys), "buckets": buckets, "schema": like.schema.json() if not folders else None}
        self._manifests(table).commit(at, [*have, entry])
        return n

    def _entry(self, table: str, version: int | None) -> dict:
        have = self.versions(table)
        entry = have[-1] if version is None and have else next((v for v in have if v["version"] == version), None)
        if entry is None:
            raise ValueError(f"{table} has no version {version}")
        return entry

    def _rows(self, table: str, entry: dict, buckets: set[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets; folders of one write are read by one scan."""
        writes: dict[str, list[str]] = {}
        for folder, bucket in entry["folders"]:
            if buckets is None or bucket is None or bucket in buckets:
                writes.setdefault(folder.split("/")[0], []).append(f"{self.root}/{table}/{folder}")
        if not writes:
            first = next((f for f, _ in entry["folders"]), None)
            schema = self.spark.read.parquet(f"{self.root}/{table}/{first}").schema if first else T.StructType.fromJson(json.loads(entry["schema"]))
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.parquet(*paths) for paths in writes.values()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version; the last by default. Columns added later are null in older rows."""
        return self._rows(table, self._entry(table, version))

    def merge(self, table: str, source: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> int:
        """A new version in which rows of ``source`` replace those with the same keys, or are added.

        With ``order`` the row that is last by these columns stays, on either side: a late row that is
        older than the one held replaces nothing. Null keys meet null keys. The first merge makes a bucketed table.
        """
        keys = list(keys)
        at, have = self._manifests(table).last()
        if order:
            best = F.max_by(F.struct(*source.columns), F.struct(*order))
            source = source.groupBy(*keys).agg(best.alias("__x")).select("__x.*")
        if not have:
            return self.write(table, source, bucket_by=keys)
        last = have[-1]
        if last["keys"] != keys:  # kept otherwise: rewritten once, into buckets
            mine = self.read(table)
            made = self._write(table, _merged(mine, source, keys, order), (), keys, BUCKETS)
            return self._commit(table, at, have, made, keys, BUCKETS, mine)
        hit = {r[0] for r in source.select(_bucket(keys, last["buckets"])).distinct().collect()}  # at most the number of buckets
        made = self._write(table, _merged(self._rows(table, last, hit), source, keys, order), (), keys, last["buckets"])
        kept = [f for f in last["folders"] if f[1] is not None and f[1] not in hit]
        return self._commit(table, at, have, [*kept, *made], keys, last["buckets"], source)

    def replace(self, table: str, rows: DataFrame) -> int:
        """A new version of ``rows``, which may be made of the last one, in the same buckets."""
        at, have = self._manifests(table).last()
        last = have[-1]
        return self._commit(table, at, have, self._write(table, rows, (), last["keys"], last["buckets"]), last["keys"], last["buckets"], rows)

    def delete(self, table: str, condition: str) -> int:
        """A new version without the rows the condition holds for."""
        return self.replace(table, self.read(table).filter(~F.coalesce(F.expr(condition), F.lit(False))))

    def compact(self, table: str, files: int = 1) -> int:
        """The last version as one folder, of few files unless it is bucketed."""
        at, have = self._manifests(table).last()
        last = have[-1]
        rows = self.read(table)
        made = self._write(table, rows if last["keys"] else rows.coalesce(files), (), last["keys"], last["buckets"])
        return self._commit(table, at, have, made, last["keys"], last["buckets"], rows)

    def expire(self, table: str, keep: int = 1) -> None:
        """Forget all but the last versions; ``clean`` then deletes what none of them needs."""
        at, have = self._manifests(table).last()
        self._manifests(table).commit(at, have[-keep:])
        self.clean(table)

    def clean(self, table: str, older_than: float = 0.0) -> list[str]:
        """Delete folders that no version names: expired ones and orphans of writes that failed.

        older_than: age in seconds below which a folder is left alone, as its writer may be at work.
        """
        m = self._manifests(table)
        needed = {f for v in self.versions(table) for f, _ in v["folders"]}
        gone, now = [], time.time()

        def drop(path, name: str) -> None:
            m.fs.delete(path, True)
            gone.append(name)

        for s in m.fs.listStatus(m.path()):
            name = s.getPath().getName()
            if not name.startswith("data-") or now - s.getModificationTime() / 1000 < older_than:
                continue
            if not any(f == name or f.startswith(f"{name}/") for f in needed):
                drop(s.getPath(), name)
            elif name not in needed:
                for b in m.fs.listStatus(s.getPath()):
                    inner = f"{name}/{b.getPath().getName()}"
                    if b.isDirectory() and inner not in needed:
                        drop(b.getPath(), inner)
        return gone


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in keys)), F.lit(buckets)).cast("int")


def _merged(mine: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    if order:
        both = mine.unionByName(source, allowMissingColumns=True)
        return both.groupBy(*keys).agg(F.max_by(F.struct(*both.columns), F.struct(*order)).alias("__x")).select("__x.*")
    mine, theirs = mine.alias("m"), source.select(*keys).distinct().alias("s")
    same = reduce(lambda a, b: a & b, (F.col(f"m.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
    return mine.join(theirs, same, "left_anti").unionByName(source, allowMissingColumns=True)
