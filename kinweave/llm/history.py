"""Deduplicating new batches against all history (problem 1) by a persisted minwise index.

``HistoryIndex`` keeps, for each content ever delivered, its minwise band keys with the values they were
made of and the earliest row that it repeats, in files partitioned by a hash. A batch is folded into its
distinct contents; only the partitions its contents fall into are read; candidates that share a band
key are verified value by value; then the keys of what is new are appended. ``found`` runs a
whole delivery history through the index, batch after batch of each source.

A content's minwise set is the padded q-grams of the values in which a slip of the pen is allowed
(given and family name, street, town); the values that must agree (e-mail, phone, birth date,
house number, unit, region, postal code) salt each gram, so contents that differ there share no
element, and their hash places the content in the index: all its band keys lie in one partition.
The band counts follow from the collision curve: sets of Jaccard similarity LIKENESS share a
key with chance RECALL.

Exact copies are folded before anything is compared, so a content that holds a third of all rows is
one row. Where more than HOT contents agree in all values that must agree (mostly because these
are blank), the place of such a group would hold them all; from then on its contents are kept in a second
table, a row for each key of bands of more rows, as many bands as keep the same recall, placed
by the hash of the key: such buckets hold all but equal contents, and only those a batch hits are read.

A content that repeats an earlier one is kept as well, with the row it repeats, so what is like it but
less like the original still finds the original. Adding a batch again changes nothing.

Defined results: null, blank and stand-in values are one kind of blank; a row with no usable value
has no content and is no case; rows with a null payload and deleted rows are no case; ties in
time go to the smaller id; a row written twice in its own batch is none by that; an empty table
gives no rows; further columns are ignored.
"""

import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kinweave.functions import kernels as K
from kinweave.functions.address import slips
from kinweave.operators import contents as C
from kinweave.operators import records as R
from kinweave.session import checkpoint_root, cut, reclaim
from kinweave.sources.manifest import Manifests

STRICT = ["email", "phone", "birth", "region", "postal", "number", "unit"]
LOOSE = ["given", "family", "street", "kind", "direction", "town"]
Q = 2
#: Two slips in one of four values leave a Jaccard similarity of 0.6 or more of their padded bigrams.
LIKENESS, RECALL = 0.6, 0.9999
#: (rows, bands) of the keys of a content, and of one among more than HOT that agree in all of STRICT.
COARSE, FINE = ((r, K.bands_for(LIKENESS, r, RECALL)) for r in (1, 4))
HOT = 1_000
MOST_SLIPS = 2
#: Contents of one bucket of a run, about; runs from which on the smaller half is merged; hashes of a batch
#: up to which only their buckets are read.
BUCKET_ROWS, MOST_RUNS, FEW = 50_000, 24, 1_000
#: Rows of 32 bytes that are broadcast at most; loads in which a whole history is read.
BROADCAST_ROWS, LOADS = 1_000_000, 3


def contents(raw: DataFrame, order: DataFrame) -> DataFrame:
    """(source_system, id, batch_no, ingested_at, values..., strict, content): a row for each usable
    delivered row. ``strict`` and ``content`` are 128 bits of hash of the values."""
    keep = ["id", "source_system", "batch_no", "ingested_at"]
    rows = raw.select("id", "source_system", "ingest_batch_id", "ingested_at", "payload", "is_deleted").join(order, "ingest_batch_id")
    rows = C.contents(rows, keep)
    both = lambda *cs: F.struct(F.xxhash64(*cs).alias("a"), F.xxhash64(F.lit(1), *reversed(cs)).alias("b"))
    cols = lambda names: [F.coalesce(F.col(n), F.lit("")) for n in names]
    usable = F.coalesce(*(F.col(c) for c in ("given", "family", "email", "phone", "birth", "street"))).isNotNull()
    return rows.filter(usable).select(
        *keep, *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in LOOSE),
        both(F.col("source_system"), *cols(STRICT)).alias("strict"), both(F.col("source_system"), *cols(STRICT + LOOSE)).alias("content"),
    )


_KEYS = T.ArrayType(T.LongType())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their coarse and, where ``finely``, fine band keys; a key's kind is part of it."""
    for b in batches:
        if not len(b):
            continue
        at = b.schema.names.index
        text = pc.binary_join_element_wise("^", *[pc.utf8_replace_slice(b.column(at(c)), 0, 0, f"{i}") for i, c in enumerate(("given", "family", "street", "town"))], "^", "^")
        strict = b.column(at("strict"))
        salt = np.asarray(strict.field("a")).view(np.uint64) ^ K.mix(np.asarray(strict.field("b")).view(np.uint64))
        finely = np.asarray(b.column(at("finely")).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        cols = []
        for n, ((rows, bands), which) in enumerate(((COARSE, np.ones(len(b), bool)), (FINE, finely))):
            some = np.flatnonzero(which)
            h, starts = K.gram_hashes(text.take(pa.array(some)), Q)
            keys = K.mix(K.band_keys(K.minwise(h, starts, rows * bands, salt[some]), bands, rows), n).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(which, bands, 0))]).astype(np.int32)
            cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1), pa.int64())))
        yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "coarse", "fine"])


def _near(x: str, y: str) -> bool:
    if x == y:
        return True
    if not x or not y:
        return False
    a, b = x.replace(" ", ""), y.replace(" ", "")
    return slips(a, b, MOST_SLIPS) <= (MOST_SLIPS if min(len(a), len(b)) > 3 else 1)


def _same_street(s1: str, k1: str, d1: str, s2: str, k2: str, d2: str) -> bool:
    if (k1, d1) == (k2, d2):
        return _near(s1, s2)
    if k1 and k2 and k1 != k2 or d1 and d2 and d1 != d2:
        return False
    return _near(" ".join(filter(None, (d1, s1, k1))), " ".join(filter(None, (d2, s2, k2))))


@pandas_udf(T.BooleanType())
def _alike(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """Whether the values in which slips are allowed mean the same."""
    rows = zip(*(a[c] for c in LOOSE), *(b[c] for c in LOOSE))
    return pd.Series([_near(g, g2) and _near(f, f2) and _near(t, t2) and _same_street(s, k, d, s2, k2, d2) for g, f, s, k, d, t, g2, f2, s2, k2, d2, t2 in rows], dtype=bool)


def classes_of(rows: DataFrame) -> DataFrame:
    """One row for each content of each batch: content, batch_no, strict, the values, first row."""
    first = F.min(F.struct("batch_no", "ingested_at", "id")).alias("first")
    return rows.groupBy("content", "batch_no").agg(first, *(F.first(c).alias(c) for c in ("strict", *LOOSE)))


class HistoryIndex:
    """Contents of all batches added so far, on files of the shared store at ``path``.

    Each batch is a run: a table bucketed and sorted by the hash of the values that must agree, in a number
    of buckets that grows with the run. A batch is brought to the buckets of a run that has as many as the session
    has shuffle partitions, so a run of any size to speak of is never shuffled (smaller ones Spark exchanges); a batch
    of up to FEW such hashes reads only their buckets and row groups. Numbered manifests
    list the runs. When there are more than MOST_RUNS, the smaller half is merged into one, so a content is
    written again a logarithmic number of times. One writer at a time: a second one's commit fails and may
    be repeated. The session's catalog names the runs while the index is open; ``close`` takes the names back.
    """

    def __init__(self, spark: SparkSession, path: str, hot: int = HOT, bucket_rows: int = BUCKET_ROWS, most_runs: int = MOST_RUNS) -> None:
        self.spark, self.path, self.hot, self.bucket_rows, self.most_runs = spark, path.rstrip("/"), hot, bucket_rows, most_runs
        self.manifests = Manifests(spark, path)
        self.named: set[str] = set()

    def _run(self, r: dict) -> DataFrame:
        """A run as a table whose buckets Spark knows."""
        name = r["folder"].replace("-", "_")
        if name not in self.named:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _ROW)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {r['buckets']} BUCKETS LOCATION '{self.path}/{r['folder']}'")
            self.named.add(name)
        return self.spark.table(name)

    def close(self) -> None:
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.named = set()

    def _read(self, kind: str, asked: DataFrame, leave: str) -> DataFrame:
        """Rows of one kind (coarse, fine) placed by one of the hashes ``h`` asked for, but not those of the load ``leave``.
        The join is on the bucket's column alone: only then the index's side needs no exchange."""
        runs = [r for r in self.manifests.last()[1] if r["kind"] == kind and r["name"] != leave]
        out = self.spark.createDataFrame([], _ROW)
        if not runs:
            return out
        asked = asked.select("h").distinct()
        few = [r.h for r in asked.limit(FEW + 1).collect()]
        for r in runs:
            rows = self._run(r)
            rows = rows.filter(F.col("h").isin(few)) if len(few) <= FEW else rows
            out = out.unionByName(rows.join(asked, "h", "left_semi").select(*_ROW.names))
        return out

    def _write(self, name: str, kind: str, rows: DataFrame, n: int) -> list[dict]:
        """Write a run of at most ``n`` rows; its entry for the manifest."""
        if not n:
            return []
        buckets = 1 << max(0, math.ceil(math.log2(n / self.bucket_rows)))
        folder = f"run-{uuid.uuid4().hex}"
        table = folder.replace("-", "_")
        placed = rows.select(*_ROW.names).repartition(buckets, "h").sortWithinPartitions("h")
        placed.write.bucketBy(buckets, "h").sortBy("h").option("path", f"{self.path}/{folder}").format("parquet").saveAsTable(table)
        self.named.add(table)
        return [{"name": name, "kind": kind, "folder": folder, "rows": n, "buckets": buckets}]

    def compact(self) -> None:
        """Merge the smaller half of the runs of a kind into one, if there are too many."""
        number, runs = self.manifests.last()
        for kind in ("coarse", "fine"):
            mine = [r for r in runs if r["kind"] == kind]
            if len(mine) > self.most_runs:
                few = sorted(mine, key=lambda r: (r["rows"], r["name"]))[: len(mine) // 2]
                made = self._write("+".join(r["name"] for r in few), kind, reduce(DataFrame.unionByName, [self._run(r) for r in few]), sum(r["rows"] for r in few))
                runs = [*(r for r in runs if r not in few), *made]
                self.manifests.commit(number, runs)
                number += 1

    def add(self, classes: DataFrame, name: str) -> DataFrame:
        """(content, batch_no, root): contents of a load that repeat a row of an earlier batch, with the
        earliest such row; what the index hasn't yet is added to it under the load's name. A load is a
        batch, or several when a history is first read; ``classes`` is a written table."""
        asked = classes.groupBy(F.col("strict.a").alias("h"), "strict").agg(F.count(F.lit(1)).alias("here"))
        asked = cut(asked)
        held = cut(self._read("coarse", asked, name))
        had = held.groupBy("strict").agg(F.count_if(F.col("content").isNotNull()).alias("had"), F.max(F.col("content").isNull()).alias("was_hot"))
        # only where several contents agree in what must agree is there anything to compare
        several = cut(asked.join(had, "strict", "left").filter("here > 1 OR had IS NOT NULL").select("strict", (F.coalesce("had", F.lit(0)) + F.col("here")).alias("rivals"), F.coalesce("was_hot", F.lit(False)).alias("was_hot")))
        small = several.count() <= BROADCAST_ROWS
        old = held.filter("content IS NOT NULL")
        new = classes.join(F.broadcast(several) if small else several, "strict", "left").withColumn("rivals", F.coalesce("rivals", F.lit(1))).withColumn("was_hot", F.coalesce("was_hot", F.lit(False)))
        new = new.withColumn("finely", F.col("was_hot") | (F.col("rivals") > self.hot))
        keyed = cut(new.mapInArrow(_keys, T.StructType([*new.schema.fields, T.StructField("coarse", _KEYS), T.StructField("fine", _KEYS)])))
        lone, every = keyed.filter("rivals = 1 AND NOT was_hot"), keyed.filter("rivals > 1 OR was_hot")
        # a content's own hash is one more key, by which an equal one is found
        every = every.withColumn("fine", F.concat("fine", F.array("content.a")))
        every = every.join(old.select("content", F.col("root").alias("known")), "content", "left")
        every = cut(every.select("content", "batch_no", "first", "strict", *LOOSE, "finely", "was_hot", "known", "coarse", "fine"))
        rival = every.filter("known IS NULL")
        # keys are salted by what must agree, so a key alone finds the bucket; values follow once for each pair
        ask = rival.select("content", F.explode("coarse").alias("h"))
        ask_fine = rival.filter("finely").select("content", "was_hot", F.explode("fine").alias("h"))
        held_fine = cut(self._read("fine", ask_fine.filter("was_hot"), name))
        to = F.col("content").alias("to")
        seen = old.select(to, F.explode("bands").alias("h")).unionByName(rival.filter("NOT finely").select(to, F.explode("coarse").alias("h")))
        seen_fine = held_fine.select(to, "h").unionByName(ask_fine.select(to, "h"))
        pairs = ask.join(seen, "h").unionByName(ask_fine.select("content", "h").join(seen_fine, "h")).select("content", "to").distinct()
        values = lambda df, c, v, at: df.groupBy(F.col("content").alias(c)).agg(F.min(F.col(at)).alias(f"{v}_at"), F.first("strict").alias(f"{v}_strict"), F.first(F.struct(*LOOSE)).alias(v))
        place = lambda df, at: df.select("content", F.col(at).alias("at"), "strict", *LOOSE)
        theirs = values(place(old, "root").unionByName(place(held_fine, "root")).unionByName(place(rival, "first")), "to", "theirs", "at")
        # a content of several batches asks for its last, so that its own first row counts as earlier
        mine = rival.groupBy("content").agg(F.max("first").alias("mine_at"), F.first("strict").alias("mine_strict"), F.first(F.struct(*LOOSE)).alias("mine"))
        both = pairs.join(mine, "content").join(theirs, "to").filter("theirs_at < mine_at AND mine_strict = theirs_strict")
        like = cut(both.filter(_alike("theirs", "mine")).select("content", "to", F.col("theirs_at").alias("root")))
        root = _earliest(like)
        there_already = held_fine.select("content").distinct().withColumn("kept", F.lit(True))
        linked = cut(rival.drop("known").join(root, "content", "left").join(there_already, "content", "left"))
        fresh = linked.filter("kept IS NULL").groupBy("content").agg(F.min(F.coalesce("root", "first")).alias("root"), *(F.first(c).alias(c) for c in ("strict", *LOOSE, "finely", "coarse", "fine")))
        n = linked.selectExpr("count_if(NOT finely)", "count_if(finely AND kept IS NULL)", "count_if(finely AND NOT was_hot)").first()
        marks = linked.filter("finely AND NOT was_hot").select("strict").distinct().select(F.col("strict.a").alias("h"), "strict")
        plain = lone.select("content", F.col("first").alias("root"), "strict", *LOOSE, F.col("coarse").alias("bands")).unionByName(fresh.filter("NOT finely").select("content", "root", "strict", *LOOSE, F.col("coarse").alias("bands")))
        coarse = plain.withColumn("h", F.col("strict.a")).unionByName(marks, allowMissingColumns=True)
        finer = fresh.filter("finely").withColumn("h", F.explode("fine")).withColumn("bands", F.lit(None).cast(_KEYS))
        made = self._write(name, "coarse", coarse, lone.count() + n[0] + n[2]) + self._write(name, "fine", finer, n[1] * (FINE[1] + 1))
        number, runs = self.manifests.last()
        self.manifests.commit(number, [*(r for r in runs if r["name"] != name), *made])
        self.compact()
        again = every.filter("known IS NOT NULL").select("content", "batch_no", F.col("known").alias("root"))
        found = again.unionByName(linked.filter("root IS NOT NULL").select("content", "batch_no", "root")).filter(F.col("root.batch_no") < F.col("batch_no"))
        for done in (asked, held, several, keyed, held_fine, like):
            reclaim(done)
        return found

    def accept(self, raw_batch: DataFrame, order: DataFrame, name: str) -> DataFrame:
        """(id, prior_id) of a delivered batch's rows that repeat an earlier batch's; the batch is added."""
        rows = cut(contents(raw_batch, order))
        return prior(rows, self.add(cut(classes_of(rows)), name))


_HASH = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_FIRST = T.StructType([T.StructField("batch_no", T.LongType()), T.StructField("ingested_at", T.TimestampNTZType()), T.StructField("id", T.StringType())])
_ROW = T.StructType([
    T.StructField("h", T.LongType()), T.StructField("content", _HASH), T.StructField("strict", _HASH), T.StructField("root", _FIRST), *(T.StructField(c, T.StringType()) for c in LOOSE),
    T.StructField("bands", _KEYS),  # of a coarse row; a fine row stands under one key, and a row without content says that its group is hot
])


def prior(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(id, prior_id) of rows whose content in their batch repeats an earlier batch's row."""
    out = rows.select("id", "content", "batch_no").join(found, ["content", "batch_no"])
    return out.select("id", F.col("root.id").alias("prior_id")).distinct()


def _earliest(like: DataFrame) -> DataFrame:
    """(content, root) from (content, to, root): what a content repeats may itself repeat something earlier."""
    best = cut(like.groupBy("content").agg(F.min("root").alias("root")))
    while True:
        up = like.join(best.select(F.col("content").alias("to"), F.col("root").alias("up")), "to").groupBy("content").agg(F.min("up").alias("up"))
        step = cut(best.join(up, "content", "left").select("content", F.least("root", "up").alias("root"), (F.col("up") < F.col("root")).alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("content", "root")
        best = step.select("content", "root")


def found(raw: DataFrame, profile_runs: DataFrame, path: str | None = None, hot: int = HOT, loads: int = LOADS) -> DataFrame:
    """(id, prior_id): rows whose content an earlier batch of their source has brought, with the earliest
    such row. The history goes through the index in ``loads`` runs of batches, in their order; a batch that
    is delivered later is a load of its own (``HistoryIndex.accept``)."""
    spark = raw.sparkSession
    order = R.batch_order(profile_runs).withColumn("load", F.ntile(max(1, loads)).over(Window.orderBy("batch_no")))  # one row for each batch
    # batches that share a number belong to one load
    order = cut(order.join(order.groupBy("batch_no").agg(F.min("load").alias("l")), "batch_no").select("ingest_batch_id", "batch_no", F.col("l").alias("load")))
    rows = cut(contents(raw, order.drop("load")))
    classes = cut(classes_of(rows).join(F.broadcast(order.select("batch_no", "load").distinct()), "batch_no"))
    index = HistoryIndex(spark, path or f"{checkpoint_root(spark)}/kinweave/history-{uuid.uuid4().hex}", hot)
    out = None
    for load in sorted(r[0] for r in order.select("load").distinct().collect()):
        got = index.add(classes.filter(F.col("load") == load).drop("load"), f"{load:06d}")
        out = got if out is None else out.unionByName(got)
    index.close()
    return prior(rows, out) if out is not None else rows.select("id", F.col("id").alias("prior_id")).limit(0)
