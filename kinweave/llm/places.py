"""Same postal address written differently (problem 7): a set-containment join on rare tokens.

A line becomes a set of tokens: grams of its street's name, each bound to the house number, the unit,
the direction and the town, so that a slip spoils a few tokens and not the set. Every address is indexed by its
rarest tokens, as many (PREFIX) as two slips can spoil plus one; fuller addresses probe the index with all
of theirs. An address without a town is indexed by tokens without one, and all probe those too, so
lines of different towns never meet, however many towns have the street. What meets is
verified: the shorter line's grams, weighted by their rarity, must be contained in the fuller one's
(CONTAINED), street names must agree up to the slips, and no part may contradict: house number and unit agree
exactly, and so does direction (lines of one street without a direction come several at a time beside lines
with one, as a neighbouring street's do, so a missing direction is one of its own); street type and town where
both have them.

A part left out is filled before the last comparison: the town from the postal code (the town most
lines of that code name), then type and town from what most of the matching lines say. Lines that
read the same are folded into one before any join, so a line that a third of all rows repeat is
one row until the end, where the pairs of ids asked for are made.

Towns are read off the table's own town column: every name that three lines or more give, without a
limit. They are handed to the readers in blocks of TOWN_BLOCK names, which bounds what is broadcast; with
more than one block a line is read once for each and the reading that knows its town is kept.

Defined results: null, blank and unreadable lines and lines without house number and street are no
case; ties of a filling go to the smaller text; repeated rows of an address_id count once; an empty
table gives no rows; further columns are ignored.
"""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kinweave.functions import address as A
from kinweave.functions import values as V
from kinweave.session import cut, reclaim

MOST_SLIPS = 2
GRAM = 3
#: Padded trigrams that two slips can spoil (four for a swap of neighbours), plus one.
PREFIX = MOST_SLIPS * (GRAM + 1) + 1
#: Share of the weight of the shorter line's grams that the fuller one must hold.
CONTAINED = 0.1
#: Names of towns in one block, some 10 MB on an executor.
TOWN_BLOCK = 200_000
#: Parts that a line may leave out, in the order in which they are filled.
FILLED = ["kind", "town"]
PARTS = ["number", "street", "kind", "direction", "unit", "town", "postal"]


def _spellings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each town under itself and every text that leaves up to MOST_SLIPS of its letters out."""
    for b in batches:
        out: tuple[list, list, list] = ([], [], [])
        for town, n in zip(*(c.to_pylist() for c in b.columns)):
            keys = {town}
            for _ in range(MOST_SLIPS if len(town) >= 5 else 0):
                keys |= {k[:i] + k[i + 1 :] for k in keys for i in range(len(k))}
            for k in keys:
                for col, v in zip(out, (k, town, n)):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["spelling", "town", "n"])


def gazetteer(lines: DataFrame) -> DataFrame:
    """(town): names that at least three lines give in their own column, without the slips of frequent ones."""

    @pandas_udf(T.StringType())
    def norm(s: pd.Series) -> pd.Series:
        return s.map(A.town_norm)

    @pandas_udf(T.BooleanType())
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([A.slips(x, y, MOST_SLIPS) <= MOST_SLIPS for x, y in zip(a, b)], dtype=bool)

    named = lines.filter("addr_city IS NOT NULL").groupBy("addr_city").agg(F.count(F.lit(1)).alias("k"))
    town = named.select(norm("addr_city").alias("town"), "k").filter("town IS NOT NULL").groupBy("town").agg(F.sum("k").alias("n")).filter("n >= 3")
    spelt = cut(town.mapInArrow(_spellings, "spelling string, town string, n long"))
    # of the towns a spelling may stand for the most frequent; two slips apart means a spelling in common
    first = spelt.groupBy("spelling").agg(F.max(F.struct("n", "town")).alias("x")).select("spelling", F.col("x.n").alias("most"), F.col("x.town").alias("its"))
    slip = spelt.join(first, "spelling").filter((F.col("most") > 20 * F.col("n")) & (F.length("town") >= 5)).filter(near("town", "its")).select("town").distinct()
    return spelt.select("town").distinct().join(slip, "town", "left_anti")


def _read(lines: DataFrame, towns: A.Towns) -> DataFrame:
    schema = T.StructType([T.StructField("address_id", T.LongType()), *(T.StructField(p, T.StringType()) for p in PARTS), T.StructField("known", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, line, city, postal in zip(*(c.to_pylist() for c in b.columns)):
                line = V.present(line) if line else None
                a = A.parse(line, towns) if line else A.NOTHING
                if i is None or not a.number or not a.street:
                    continue
                town = A.town_norm(V.present(city)) if city and V.present(city) else a.town
                near = A.near_town(town, towns) if town else None
                code = V.postal(V.present(postal)) if postal and V.present(postal) else None
                out.append((i, a.number, a.street, a.kind, a.direction, a.unit, near or town, code or a.postal, near is not None))
            cols = [*zip(*out)] if out else [[] for _ in range(9)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:8]), pa.array(cols[8], pa.bool_())], ["address_id", *PARTS, "known"])

    return lines.select("address_id", "input", "addr_city", "addr_postal").mapInArrow(run, schema)


def doors(lines: DataFrame, towns: DataFrame, block: int = TOWN_BLOCK) -> DataFrame:
    """(address_id, number, street, kind, direction, unit, town, postal) of lines that are a street address."""
    towns = cut(towns)
    blocks = -(-towns.count() // block) or 1
    part = lambda i: A.Towns(r.town for r in towns.filter(F.pmod(F.xxhash64("town"), F.lit(blocks)) == i).collect())  # noqa: E731 - a block
    if blocks == 1:
        return _read(lines, part(0)).drop("known").distinct()
    each = _read(lines, part(0))
    for i in range(1, blocks):
        each = each.unionByName(_read(lines, part(i)))
    best = each.groupBy("address_id").agg(F.max(F.struct("known", *PARTS)).alias("x"))  # a known town before none, then the larger
    return best.select("address_id", *(f"x.{p}" for p in PARTS))


def _with_town(d: DataFrame) -> DataFrame:
    """Missing towns from the postal code, where most lines of the code name one."""
    by = d.filter("postal IS NOT NULL AND town IS NOT NULL").groupBy("postal", "town").agg(F.count(F.lit(1)).alias("n"))
    by = by.groupBy("postal").agg(F.max(F.struct("n", "town"))["town"].alias("its_town"))
    return d.join(by, "postal", "left").withColumn("town", F.coalesce("town", "its_town")).drop("its_town", "postal")


@pandas_udf(T.BooleanType())
def _same_street(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two street names are one up to slips, compared without spaces."""

    def same(x: str, y: str) -> bool:
        x, y = x.replace(" ", ""), y.replace(" ", "")
        n = min(len(x), len(y))
        return x == y or n >= 4 and A.slips(x, y, MOST_SLIPS) <= (MOST_SLIPS if n >= 6 else 1)

    return pd.Series([same(x, y) for x, y in zip(a, b)], dtype=bool)


@pandas_udf(T.BooleanType())
def _no_contradiction(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x is None or y is None or x == y or len(x) > 4 and len(y) > 4 and A.slips(x, y, 2) <= 2 for x, y in zip(a, b)], dtype=bool)


def grams(street: Column) -> Column:
    """Distinct padded grams of a street's name without spaces."""
    name = F.concat(F.lit("^^"), F.replace(street, F.lit(" "), F.lit("")), F.lit("$$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - GRAM + 1), lambda i: F.substr(name, i, F.lit(GRAM))))


def weighed(classes: DataFrame) -> DataFrame:
    """``classes`` with ``grams``, an array of (gram, weight), and ``parts``, how full the line is.
    A gram's weight is the logarithm of how rare it is among all street names."""
    names = cut(classes.select("street").distinct().withColumn("g", grams(F.col("street"))))
    total = F.lit(float(max(1, names.count())))
    df = names.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    weight = names.select("street", F.explode("g").alias("gram")).join(df, "gram").groupBy("street").agg(F.array_sort(F.collect_list(F.struct("gram", F.log(1 + total / F.col("n")).alias("weight")))).alias("grams"))
    full = sum((F.col(p).isNotNull().cast("int") for p in ("kind", "town")), F.lit(0)) * 1000 + F.least(F.size("grams"), F.lit(999))
    return classes.join(weight, "street").withColumn("parts", full)


def _candidates(classes: DataFrame) -> DataFrame:
    """(a, b): classes of which b, at least as full, holds one of the rarest tokens of a."""
    # only classes that share house number, unit, direction and town (or have none) with another can meet it
    door = F.xxhash64("number", F.coalesce("unit", F.lit("")), F.coalesce("direction", F.lit("")))
    every = classes.select("c", "parts", "town", F.coalesce("town", F.lit("")).alias("t"), door.alias("door"), "grams")
    by_door = every.groupBy("door").agg(F.count(F.lit(1)).alias("same"), F.count_if(F.col("town").isNull()).alias("bare")).filter("same > 1")
    by_town = every.groupBy("door", "t").agg(F.count(F.lit(1)).alias("here"))
    each = every.join(by_door, "door").join(by_town, ["door", "t"]).filter("town IS NULL OR here > 1 OR bare > 0")
    each = each.select("c", "parts", "town", "t", "door", "here", "bare", F.explode("grams.gram").alias("gram"))
    own = each.filter("town IS NULL OR here > 1").select("c", "parts", F.xxhash64("door", "t", "gram").alias("token"), F.lit(True).alias("own"))
    without = each.filter("town IS NOT NULL AND bare > 0").select("c", "parts", F.xxhash64("door", F.lit(""), "gram").alias("token"), F.lit(False).alias("own"))
    tokens = cut(own.unionByName(without))
    df = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("indexed")).filter("n > 1 AND indexed > 0")
    shared = tokens.join(df.select("token", "n"), "token")
    # tokens nobody else has are the rarest; they take their places in the prefix and need no row in the index
    size = tokens.filter("own").groupBy("c").agg(F.count(F.lit(1)).alias("all"))
    rare = shared.filter("own").groupBy("c", "parts").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("t")).join(size, "c")
    index = rare.select(F.col("c").alias("a"), F.col("parts").alias("pa"), F.explode(F.slice("t", F.lit(1), F.greatest(F.lit(0), PREFIX - (F.col("all") - F.size("t"))).cast("int"))).alias("x"))
    probe = shared.select(F.col("c").alias("b"), F.col("parts").alias("pb"), "token", "own")
    # with a town is fuller than without one, whatever else is missing
    hit = index.select("a", "pa", F.col("x.token").alias("token")).join(probe, "token").filter("NOT own OR pb > pa OR (pb = pa AND a < b)")
    found = cut(hit.select("a", "b").distinct())
    reclaim(tokens)
    return found


def _filled(classes: DataFrame, pairs: DataFrame, part: str) -> DataFrame:
    """``classes`` with a missing part set to what most lines of the matching classes say."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    need = classes.filter(F.col(part).isNull()).select(F.col("c").alias("a"))
    say = both.join(need, "a", "left_semi").join(classes.filter(F.col(part).isNotNull()).select(F.col("c").alias("b"), F.col(part).alias("p"), "lines"), "b")
    most = say.groupBy("a", "p").agg(F.sum("lines").alias("n")).groupBy("a").agg(F.min(F.struct(-F.col("n"), "p"))["p"].alias("p"))
    return classes.join(most.select(F.col("a").alias("c"), "p"), "c", "left").withColumn(part, F.coalesce(part, "p")).drop("p")


def _verified(pairs: DataFrame, classes: DataFrame, contained: float | None = None) -> DataFrame:
    """Pairs without a contradiction; with ``contained`` also that share of the weight of a's grams in b."""
    cols = [*PARTS[:-1], *(["grams"] if contained is not None else [])]
    x = pairs.join(classes.select(F.col("c").alias("a"), *(F.col(p).alias(f"a_{p}") for p in cols)), "a")
    x = x.join(classes.select(F.col("c").alias("b"), *(F.col(p).alias(f"b_{p}") for p in cols)), "b")
    for p in ("number", "unit", "direction"):
        x = x.filter(F.col(f"a_{p}").eqNullSafe(F.col(f"b_{p}")))
    x = x.filter(F.col("a_kind").isNull() | F.col("b_kind").isNull() | (F.col("a_kind") == F.col("b_kind")))
    if contained is not None:
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, g: s + g["weight"])
        held = F.filter("a_grams", lambda g: F.array_contains(F.col("b_grams.gram"), g["gram"]))
        x = x.filter(total(held) >= contained * total(F.col("a_grams")))
    return x.filter(_same_street("a_street", "b_street") & _no_contradiction("a_town", "b_town")).select("a", "b")


def same_door(lines: DataFrame) -> DataFrame:
    """(address_a, address_b): pairs of address ids that mean one door, the smaller first."""
    d = cut(_with_town(doors(lines, gazetteer(lines))))
    parts = PARTS[:-1]
    key = F.xxhash64(*(F.coalesce(p, F.lit("")) for p in parts))
    d = d.withColumn("c", key)
    classes = cut(weighed(d.groupBy("c").agg(F.count(F.lit(1)).alias("lines"), *(F.first(p).alias(p) for p in parts))))
    near = _candidates(classes)
    pairs = cut(_verified(near, classes, CONTAINED))
    reclaim(near)
    full = classes.drop("grams")
    for part in FILLED:
        full = _filled(full, pairs, part)
    pairs = _verified(pairs, cut(full))
    ids = d.select("address_id", "c")
    within = pairs.unionByName(classes.filter("lines > 1").select(F.col("c").alias("a"), F.col("c").alias("b")))
    out = within.join(ids.select(F.col("address_id").alias("x"), F.col("c").alias("a")), "a").join(ids.select(F.col("address_id").alias("y"), F.col("c").alias("b")), "b")
    out = out.filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return out.select(F.least("x", "y").alias("address_a"), F.greatest("x", "y").alias("address_b")).filter("address_a <> address_b").distinct()
