"""Read paths: pages by key, cursors, lookups, searches, latest runs, health figures, numbered edges.

A page is a filter on the key behind which it begins, an order and a limit: with the files sorted by
the key only the row groups from there on are read, and the limit is taken from each partition before any exchange.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.session import cut


def encode_cursor(snapshot: int, key: Sequence) -> str:
    """Where a page ended: the version read and the last key."""
    return base64.urlsafe_b64encode(json.dumps([snapshot, list(key)], separators=(",", ":")).encode()).decode()


def decode_cursor(cursor: str) -> tuple[int, list]:
    try:
        snapshot, key = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        return int(snapshot), list(key)
    except (ValueError, TypeError) as e:
        raise ValueError(f"not a cursor: {cursor!r}") from e


def page(df: DataFrame, keys: Sequence[str], after: Sequence | None = None, limit: int = 50) -> DataFrame:
    """The next ``limit`` rows by ``keys`` behind those of the last row seen. Null keys come first and are never behind a key."""
    if after is not None:
        if len(after) != len(keys):
            raise ValueError(f"a key of {len(keys)} columns is not {list(after)}")
        behind = F.lit(False)
        for i in range(len(keys)):
            equal = reduce(lambda a, b: a & b, (F.col(k) == F.lit(v) for k, v in zip(keys[:i], after)), F.lit(True))
            behind = behind | (equal & (F.col(keys[i]) > F.lit(after[i])))
        df = df.filter(behind)
    return df.orderBy(*keys).limit(limit)


def arrow_page(df: DataFrame, keys: Sequence[str], after: Sequence | None = None, limit: int = 1_000) -> pa.Table:
    """A page as an Arrow table."""
    return page(df, keys, after, limit).toArrow()


def contains(c: Column, term: str) -> Column:
    """Whether a text holds a term in any case; the term has no wildcards."""
    return F.contains(F.lower(c), F.lit(term.lower()))


def entity_of(membership: DataFrame, keys: DataFrame) -> DataFrame:
    """(record_key, entity_id) of some records; null for those of no entity."""
    return keys.select("record_key").distinct().join(membership.select("record_key", "entity_id"), "record_key", "left")


def latest_run(runs: DataFrame, by: Sequence[str], at: str = "captured_at", tie: str = "id") -> DataFrame:
    """The last run of each ``by``."""
    best = F.max_by(F.struct(*runs.columns), F.struct(at, tie)).alias("x")
    return runs.groupBy(*by).agg(best).select("x.*")


def health(parts: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """(check, n): how many rows of each table meet its condition, or how many there are."""
    each = [df.agg(F.count(F.lit(1)) if c is None else F.count_if(c)).toDF("n").select(F.lit(name).alias("check"), F.col("n")) for name, (df, c) in parts.items()]
    return reduce(DataFrame.unionByName, each)


def edge_ids(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``edges`` with ``edge_id``, their place from 0 in the order of their ends. Only one row for each sorted partition
    is numbered in one task; equal edges take places in any order."""
    placed = cut(edges.repartitionByRange(F.col(a), F.col(b)).sortWithinPartitions(a, b).withColumn("__at", F.monotonically_increasing_id()))
    part, pos = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    out = placed.withColumn("__part", part).join(before, "__part")
    return out.withColumn("edge_id", F.col("__before") + pos).drop("__part", "__before", "__at")
