"""Variant spellings of names typed by people (problem 5).

A record's name is the set of its padded q-grams. Names say who, not which of the namesakes, so
the set is made once for each context the record has (mailbox, phone, door, birth date with one
half of the name, birth date with the initials of both halves in either order), each gram salted by the context. MinHash bands over these sets meet where the
same context and a like name meet. The number of bands follows from the collision curve: pairs
whose names have Jaccard similarity NAME_LIKENESS are found with RECALL. A pair is verified by the
Monge-Elkan likeness of its name parts together with what the other attributes say; star
clustering makes persons of the pairs, and the records of a star are what comes out: a pair across two
stars is given up, two spokes of one star that never met are found.

A context is compared whole whatever its size: one of more than TILE rows is cut into groups by
hash and each two groups meet in a block of their own, so no block is large and none is left out.
Its work grows with the square of its rows. Contexts are counted with a map-side part before
anything is compared.

Defined results: a record without any name or without a record id pairs with none; a null part of a name is left out; the
name is that of the row of the earliest batch, ties by time, then id; repeated rows change nothing;
an empty table gives no rows; further columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.functions import kernels as K
from kinweave.llm import person as P
from kinweave.operators import contents as C
from kinweave.operators import records as R
from kinweave.session import cut, reclaim

SOURCES = ["crm", "billing"]
Q = 2
#: A surname changed by marriage or a pet form leaves about this much of the q-grams.
NAME_LIKENESS, RECALL, ROWS = 0.15, 0.97, 1
BANDS = K.bands_for(NAME_LIKENESS, ROWS, RECALL)
#: Rows of a group of a context, and pairs scored at once.
TILE, MOST_PAIRS = 1_000, 500_000


def people(raw: DataFrame, order: DataFrame) -> DataFrame:
    """(key, name, versions' values): distinct versions of each record with the full name typed in its earliest batch."""
    key = F.concat("source_system", F.lit(":"), "source_record_id")
    rows = raw.filter(F.col("source_system").isin(SOURCES)).select(key.alias("key"), "id", "ingested_at", "ingest_batch_id", "payload", "is_deleted")
    rows = rows.filter("key IS NOT NULL").join(order, "ingest_batch_id", "left")
    rows = cut(C.contents(rows, ["key", "batch_no", "ingested_at", "id"], typed=True))
    early = F.struct(F.col("batch_no").isNull().alias("n"), "batch_no", "ingested_at", "id", F.col(C.TYPED).alias("name"))
    names = rows.groupBy("key").agg(F.min(early)["name"].alias("name"))
    return rows.select("key", *P.COLUMNS).distinct().join(names, "key").filter("name <> ''")


def _initials(word: Column) -> Column:
    """First letters of a word and, for a pet form, of the names it stands for."""
    pets = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for w, full in sorted(P._FULL.items()) for x in (w, sorted({f[0] for f in full}))))
    return F.array_distinct(F.concat(F.array(F.substring(word, 1, 1)), F.coalesce(F.try_element_at(pets, word), F.array().cast("array<string>"))))


def in_contexts(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """Each version once for each context it shares and each block of that context: columns context, block,
    the version's group and whether the block is for pairs of two groups."""
    c = F.col
    ctx = lambda no, *parts: F.when(~F.isnull(parts[0]) & ~F.isnull(parts[-1]), F.xxhash64(F.lit(no), *parts))
    first, end = (lambda n: F.split_part(n, F.lit(" "), F.lit(1))), (lambda n: F.element_at(F.split(n, " "), -1))
    last = F.substring(end("family"), 1, 3)
    contexts = F.array(ctx(1, c("email")), ctx(2, c("phone")), ctx(3, c("street"), c("number")), ctx(5, c("birth"), last))
    by_given = F.transform(_initials(first("given")), lambda x: ctx(4, c("birth"), x))
    g, f = _initials(first(F.coalesce("given", "family"))), _initials(end(F.coalesce("family", "given")))
    by_both = F.flatten(F.transform(g, lambda x: F.transform(f, lambda y: ctx(6, c("birth"), F.least(x, y), F.greatest(x, y)))))
    each = rows.select("*", F.explode(F.array_distinct(F.array_compact(F.concat(contexts, by_given, by_both)))).alias("context"))
    held = each.groupBy("context").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("context", F.ceil(F.col("n") / tile).cast("int").alias("groups"))
    each = each.join(held, "context").withColumn("group", F.pmod(F.xxhash64("key", *P.COLUMNS), "groups").cast("int"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), c("groups") - 1)).alias("other"))
    block = F.when(c("groups") == 1, c("context")).otherwise(F.xxhash64("context", F.least("group", "other"), F.greatest("group", "other")))
    return each.withColumn("block", block).withColumn("two", c("group") != c("other")).drop("groups", "other")


_PAIR = T.StructType([T.StructField("key_a", T.StringType()), T.StructField("key_b", T.StringType()), T.StructField("score", T.DoubleType())])


def _compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Scored pairs of records that share a band of a context; rows are sorted by block and context."""
    full = [" ".join(x for x in (P.canon_given(g), f) if x) for g, f in zip(t.column("given").to_pylist(), t.column("family").to_pylist())]
    padded = pc.binary_join_element_wise(pa.array(["^"] * len(t)), pa.array(full), pa.array(["^^"] * len(t)), "")
    block, context, group, two = (t.column(c).to_numpy() for c in ("block", "context", "group", "two"))
    h, starts = K.gram_hashes(padded, Q)
    sig = K.band_keys(K.minwise(h, starts, BANDS * ROWS, context.view(np.uint64)), BANDS, ROWS)
    key, records = P.Block._code(t.column("key")), P.Block(t)
    keys = np.array(t.column("key").to_pylist(), dtype=object)

    def scored(i: list[np.ndarray], j: list[np.ndarray]) -> pa.RecordBatch:
        i, j = np.concatenate(i), np.concatenate(j)
        hit, score = records.scores(i, j)
        a, b = keys[i[hit]], keys[j[hit]]
        swap = a > b
        return pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a), pa.string()), pa.array(np.where(swap, a, b), pa.string()), pa.array(score.astype(float))], _PAIR.names)

    i, j, n, s = [], [], 0, 1
    alive = np.arange(len(t))  # later rows whose block still holds the row s places before
    while True:
        alive = alive[alive >= s]
        alive = alive[block[alive] == block[alive - s]]
        if not len(alive):
            break
        ok = alive[(key[alive] != key[alive - s]) & (context[alive] == context[alive - s])]
        ok = ok[~two[ok] | (group[ok] != group[ok - s])]  # a block of two groups leaves each group's own pairs to its own block
        ok = ok[(sig[ok] == sig[ok - s]).any(axis=1)]
        i.append(ok - s)
        j.append(ok)
        n += len(ok)
        s += 1
        if n >= MOST_PAIRS:
            yield scored(i, j)
            i, j, n = [], [], 0
    if n:
        yield scored(i, j)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches regrouped so that no block is cut; a block has about two groups' rows at most."""
    rest = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        at = t.column("block").to_numpy()
        cut_at = int(np.searchsorted(at, at[-1], side="left"))
        rest = t.slice(cut_at)
        if cut_at:
            yield from _compare(t.slice(0, cut_at))
    if rest is not None and len(rest):
        yield from _compare(rest)


def person_pairs(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """(key_a, key_b, score) of records that mean one person, best score of any context and version."""
    near = in_contexts(rows.drop("name"), tile)
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    found = near.repartition(n, "block").sortWithinPartitions("block", "context").mapInArrow(_blocks, _PAIR)
    return found.groupBy("key_a", "key_b").agg(F.max("score").alias("score"))


def star_clusters(pairs: DataFrame) -> DataFrame:
    """(key, star): star clustering. Of the vertices not yet covered each that has the highest degree
    (ties: the smaller key) among its uncovered neighbours becomes the centre of a star; its
    neighbours are covered by their heaviest such centre; so on until all are covered."""
    ends = pairs.select(F.col("key_a").alias("v"), F.col("key_b").alias("w"), "score").unionByName(pairs.select(F.col("key_b").alias("v"), F.col("key_a").alias("w"), "score"))
    degree = ends.groupBy("v").agg(F.count(F.lit(1)).alias("d"))
    left = cut(ends.join(degree, "v").join(degree.select(F.col("v").alias("w"), F.col("d").alias("e")), "w"))
    stars = None
    while not left.isEmpty():
        beaten = (F.col("e") > F.col("d")) | ((F.col("e") == F.col("d")) & (F.col("w") < F.col("v")))
        centres = left.groupBy("v").agg(F.max(beaten.cast("int")).alias("m")).filter("m = 0").select(F.col("v").alias("w"))
        spokes = left.join(centres, "w").groupBy("v").agg(F.max_by("w", F.struct("score", "w")).alias("star")).select(F.col("v").alias("key"), "star")
        got = cut(spokes.unionByName(centres.select(F.col("w").alias("key"), F.col("w").alias("star"))))
        stars = got if stars is None else stars.unionByName(got)
        covered = got.select(F.col("key").alias("v"))
        # a vertex whose neighbours are all covered is a star of its own and pairs with none
        rest = cut(left.join(covered, "v", "left_anti").join(covered.select(F.col("v").alias("w")), "w", "left_anti"))
        reclaim(left)
        left = rest
    return stars if stars is not None else left.select(F.col("v").alias("key"), F.col("w").alias("star"))


def variants(raw: DataFrame, profile_runs: DataFrame) -> DataFrame:
    """(rec_a_key, rec_b_key): records of one star, that is one person, whose full names as typed differ."""
    rows = cut(people(raw, R.batch_order(profile_runs)))
    pairs = cut(person_pairs(rows))
    stars = cut(star_clusters(pairs))
    reclaim(pairs)
    a, b = stars.select(F.col("key").alias("x"), "star"), stars.select(F.col("key").alias("y"), "star")
    both = a.join(b, "star").filter("x < y").select(F.col("x").alias("key_a"), F.col("y").alias("key_b"))
    names = rows.select("key", "name").distinct()
    named = both.join(names.select(F.col("key").alias("key_a"), F.col("name").alias("na")), "key_a").join(names.select(F.col("key").alias("key_b"), F.col("name").alias("nb")), "key_b")
    return named.filter("na <> nb").select(F.col("key_a").alias("rec_a_key"), F.col("key_b").alias("rec_b_key"))
