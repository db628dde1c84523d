"""Matching entities across sources without keys (problem 4).

Sorted neighbourhood: every distinct version of a record is put in order by several composite sort
keys at once (one range-partitioned sort over all keys), a window slides over each order and scores
each pair inside by weighted likeness of fields; records of one source found to be one person
become one unit; units of two sources are assigned one to one so that the total confidence is greatest.

The window bounds the work whatever the data: rows x keys x window, without any group ever being
paired off. Where neighbours have the same mailbox, phone or door it widens to WIDE rows, so the
versions of a household don't push each other out; a value that a third of all rows share only
makes its neighbours be ordered by the rest of the key. Exact copies and unchanged versions are
folded before. The rows at the edges of the sorted partitions (WIDE - 1 at either end) are numbered
by one row for each partition and compared in blocks of their numbers, in as many tasks as there are blocks.

Defined results: records without any usable value match nothing; nulls are no evidence; rows without a source or record id have no key and are left out; ties go to
the smaller keys; repeated rows change nothing; an empty table gives no rows; further columns are
ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm import person as P
from kinweave.llm.assignment import assign
from kinweave.llm.components import components
from kinweave.operators import contents as C
from kinweave.operators import records as R
from kinweave.session import cut, reclaim

WINDOW = 8
#: Rows apart up to which records of one mailbox, phone or door are compared.
WIDE = 32
#: Edge rows whose numbers fall into one block of this size meet in one task.
EDGE_BLOCK = 4_096
#: Rows of a sorted partition, and so of one task.
PARTITION_ROWS = 100_000
#: Composite sort keys of a row.
N_KEYS = 6


def versions(raw: DataFrame) -> DataFrame:
    """(key, source_system, v): distinct versions of each record key, the compared values packed into
    ``v``. A record without any usable value keeps one row of empty ones."""
    key = F.concat("source_system", F.lit(":"), "source_record_id")
    rows = raw.select(key.alias("key"), "source_system", "payload", "is_deleted").filter("key IS NOT NULL")
    return C.packed_contents(rows, ["key", "source_system"], P.COLUMNS).distinct()


def packed(rows: DataFrame) -> DataFrame:
    """Rows with the compared values as columns in the form of ``versions``."""
    return rows.select("key", "source_system", F.concat_ws(C.GAP, *(F.coalesce(n, F.lit("")) for n in P.COLUMNS)).alias("v"))


def sort_keys(rows: DataFrame) -> DataFrame:
    """Each row of ``versions``, its key packed behind its values, once for each composite sort key it
    can fill, with the key's number ``k``, its text ``at`` and ``lead``, a hash of the mailbox, phone or door
    it begins with (0 for other keys)."""
    c = F.col
    parts = rows.select("source_system", F.concat_ws(C.GAP, "v", "key").alias("v"), F.split("v", C.GAP).alias("p"))
    rows = parts.select("source_system", "v", *(F.nullif(F.col("p")[i], F.lit("")).alias(n) for i, n in enumerate(P.COLUMNS)))
    first = F.split_part("given", F.lit(" "), F.lit(1))
    named = F.lit(0).cast("long")

    def key(need: str, *parts: Column, lead: Column = named) -> Column:
        return F.when(c(need).isNotNull(), F.struct(F.concat_ws("|", *(F.coalesce(p, F.lit("~")) for p in parts)).alias("at"), lead.alias("lead")))

    keys = [
        key("email", c("email"), c("birth"), first, lead=F.xxhash64("email")),
        key("phone", c("phone"), c("birth"), first, lead=F.xxhash64("phone")),
        key("birth", c("birth"), F.substring(c("family"), 1, 3), first),
        key("birth", c("birth"), F.substring(first, 1, 2), c("family")),
        key("street", c("street"), c("number"), c("town"), c("birth"), first, lead=F.xxhash64("street", "number", "town")),
        key("family", c("family"), first, c("birth"), c("town")),
    ]
    return rows.select("source_system", "v", F.posexplode(F.array(*keys)).alias("k", "x")).filter("x IS NOT NULL").select("k", "source_system", "v", "x.at", "x.lead")


_PAIR = T.StructType([T.StructField("key_a", T.StringType()), T.StructField("key_b", T.StringType()), T.StructField("cross", T.BooleanType()), T.StructField("score", T.DoubleType())])
_ROW = ["k", "lead", "source_system", "v"]
_EDGE = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("k", T.IntegerType()), T.StructField("lead", T.LongType()), *(T.StructField(c, T.StringType()) for c in _ROW[2:])])
_ARROW = {T.StringType(): pa.string(), T.BooleanType(): pa.bool_(), T.DoubleType(): pa.float64(), T.IntegerType(): pa.int32(), T.LongType(): pa.int64()}
_BOTH = pa.schema([pa.field(f.name, _ARROW[f.dataType]) for f in (*_PAIR.fields, *_EDGE.fields)])


def _unpacked(t: pa.Table) -> pa.Table:
    """``t`` with the packed values as columns of their own; an empty value is a null."""
    n, width = len(t), len(P.COLUMNS) + 1
    flat = pc.split_pattern(t.column("v").combine_chunks(), C.GAP, max_splits=width - 1).flatten()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    at = np.arange(n) * width
    for c, name in enumerate([*P.COLUMNS, "key"]):
        col = flat.take(pa.array(at + c))
        t = t.append_column(name, col if name == "key" else pc.if_else(pc.equal(col, ""), pa.scalar(None, col.type), col))
    return t


def _scored(t: pa.Table, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """The pairs (i, j) of rows with enough evidence, the best of those between the same two keys."""
    hit, score = P.Block(t).scores(i, j)
    best = np.argsort(-score, kind="stable")
    hit, score = hit[best], score[best]
    i, j = i[hit], j[hit]
    code = P.Block._code(t.column("key"))
    x, y = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
    _, first = np.unique(x * (code.max(initial=0) + 1) + y, return_index=True)
    i, j, score = i[first], j[first], score[first]
    pick = lambda c, n: t.column(c).take(pa.array(n)).combine_chunks()
    a, b = pick("key", i), pick("key", j)
    swap = pc.greater(a, b)
    cross = pc.not_equal(pick("source_system", i), pick("source_system", j))
    return pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b), cross, pa.array(score.astype(float))], _PAIR.names)


def _window_pairs(t: pa.Table, new_from: int, window: int, wide: int, at: np.ndarray | None = None, part: np.ndarray | None = None) -> pa.RecordBatch:
    """Scored pairs of rows less than ``window`` apart, or less than ``wide`` with the same lead, of which
    the later is at ``new_from`` or behind. ``at``: rows' numbers, where they aren't consecutive; then
    only pairs of different ``part`` count."""
    n = len(t)
    k, lead, key = t.column("k").to_numpy(), t.column("lead").to_numpy(), P.Block._code(t.column("key"))
    i, j = [], []
    for s in range(1, min(wide, n)):
        b = np.arange(max(new_from, s), n)
        apart = s if at is None else at[b] - at[b - s]
        ok = (k[b] == k[b - s]) & (key[b] != key[b - s]) & ((apart < window) | ((apart < wide) & (lead[b] == lead[b - s]) & (lead[b] != 0)))
        if part is not None:
            ok &= (part[b] != part[b - s]) & (apart > 0)
        i.append(b[ok] - s)
        j.append(b[ok])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
    return _scored(t, i, j)


def _slide(window: int, wide: int):
    """Pairs of each sorted partition, and its first and last rows for ``_across``."""
    keep = wide - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, pos, head = TaskContext.get().partitionId(), None, 0, None

        def edge(t: pa.Table, at: int) -> pa.RecordBatch:
            n = len(t)
            cols = [*(pa.nulls(n, f.type) for f in list(_BOTH)[:4]), pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), *(t.column(c).combine_chunks() for c in _ROW)]
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _BOTH)], schema=_BOTH)

        for b in batches:
            if not len(b):
                continue
            t = _unpacked(pa.Table.from_batches([b]).select(_ROW))
            if head is None or len(head) < keep:
                head = t.slice(0, keep) if head is None else pa.concat_tables([head, t.slice(0, keep - len(head))])
            whole = t if carry is None else pa.concat_tables([carry, t])
            got = _window_pairs(whole, len(whole) - len(t), window, wide)
            cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(got), f.type) for f in list(_BOTH)[4:])], schema=_BOTH)
            pos += len(t)
            carry = whole.slice(max(0, len(whole) - keep))
        if head is not None:
            yield edge(head, 0)
            if pos > len(head):
                tail = carry.slice(max(0, len(carry) - min(keep, pos - len(head))))
                yield edge(tail, pos - len(tail))

    return run


def _across(window: int, wide: int):
    """Pairs across the edges of partitions; rows come sorted by block and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not len(b):
                continue
            t = _unpacked(pa.Table.from_batches([b]))
            whole = t if carry is None else pa.concat_tables([carry, t])
            # rows of another block are as far apart as their blocks
            at = whole.column("at").to_numpy() + whole.column("block").to_numpy() * np.int64(4 * (wide + EDGE_BLOCK))
            yield _window_pairs(whole, len(whole) - len(t), window, wide, at, whole.column("part").to_numpy())
            carry = whole.slice(max(0, len(whole) - wide + 1))

    return run


def window_pairs(rows: DataFrame, window: int = WINDOW, wide: int = WIDE) -> DataFrame:
    """(key_a, key_b, cross, score): pairs of ``versions`` found in any window with enough evidence, best score kept."""
    spark = rows.sparkSession
    wide = max(wide, window)
    keyed = sort_keys(rows)
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = max(tasks, rows.count() * N_KEYS // PARTITION_ROWS + 1)
    ordered = keyed.repartitionByRange(n, "k", "at", "v").sortWithinPartitions("k", "at", "v").select(*_ROW)
    out = cut(ordered.mapInArrow(_slide(window, wide), T.StructType([*_PAIR.fields, *_EDGE.fields])))
    pairs = out.filter("key_a IS NOT NULL").select(*_PAIR.names)
    edges = out.filter("part IS NOT NULL").select(*_EDGE.names)
    # one row for each partition, whatever its size
    sizes = edges.groupBy("part").agg((F.max("pos") + 1).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    at = (F.col("before") + F.col("pos")).alias("at")
    numbered = edges.join(before, "part").select("part", at, *_ROW)
    block = F.floor(F.col("at") / EDGE_BLOCK)
    both = F.when((F.col("at") % EDGE_BLOCK < wide - 1) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    blocked = numbered.withColumn("block", F.explode(both)).repartition(tasks, "block").sortWithinPartitions("block", "at")
    found = pairs.unionByName(blocked.mapInArrow(_across(window, wide), _PAIR))
    best = cut(found.groupBy("key_a", "key_b").agg(F.first("cross").alias("cross"), F.max("score").alias("score")))
    reclaim(out)
    return best


def _third_side(one: DataFrame) -> DataFrame:
    """Assignments that follow from two others: a unit's partners in two sources are partners too,
    unless either is assigned elsewhere. At most one row for each unit and pair of its partners."""
    ends = one.select(F.col("a").alias("m"), F.col("b").alias("o"), "score").unionByName(one.select(F.col("b").alias("m"), F.col("a").alias("o"), "score"))
    source = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    x, y = ends.select("m", F.col("o").alias("a"), F.col("score").alias("sa")), ends.select("m", F.col("o").alias("b"), F.col("score").alias("sb"))
    new = x.join(y, "m").filter(source("a") < source("b")).groupBy("a", "b").agg(F.max(F.least("sa", "sb")).alias("score")).withColumn("side", F.concat_ws("-", source("a"), source("b")))
    new = new.join(one.select("side", "a"), ["side", "a"], "left_anti").join(one.select("side", "b"), ["side", "b"], "left_anti")
    return new.select("side", "a", "b", "score")


def matches(raw: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rec_a_key, rec_b_key, confidence): records of different sources that are one person."""
    rows = cut(versions(raw))
    pairs = window_pairs(rows, window)
    reclaim(rows)
    unit = cut(components(pairs.filter("NOT cross"), "key_a", "key_b").select(F.col("vertex").alias("key"), F.col("group").alias("unit")))
    source = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    a, b = unit.select(F.col("key").alias("key_a"), F.col("unit").alias("ua")), unit.select(F.col("key").alias("key_b"), F.col("unit").alias("ub"))
    cross = pairs.filter("cross").join(a, "key_a", "left").join(b, "key_b", "left").select(F.coalesce("ua", "key_a").alias("x"), F.coalesce("ub", "key_b").alias("y"), "score")
    cross = cross.select(F.when(source("x") < source("y"), F.struct(F.col("x").alias("a"), F.col("y").alias("b"))).otherwise(F.struct(F.col("y").alias("a"), F.col("x").alias("b"))).alias("p"), "score")
    weighed = cut(cross.select(F.concat_ws("-", source("p.a"), source("p.b")).alias("side"), "p.a", "p.b", "score"))
    best = weighed.groupBy("side", "a", "b").agg(F.max("score").alias("score"))
    one = cut(assign(weighed).join(best, ["side", "a", "b"]))
    one = one.unionByName(_third_side(one))
    ma, mb = unit.select(F.col("unit").alias("a"), F.col("key").alias("ka")), unit.select(F.col("unit").alias("b"), F.col("key").alias("kb"))
    full = one.join(ma, "a", "left").join(mb, "b", "left").select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"), "score")
    sure = 1 / (1 + F.pow(F.lit(2.0), -(F.col("score") - P.THRESHOLD + 2)))
    return full.select(F.least("x", "y").alias("rec_a_key"), F.greatest("x", "y").alias("rec_b_key"), sure.alias("confidence"))
