"""One-to-one assignment of units that maximises total confidence (a step of problem 4).

An edge both of whose ends have no other edge is taken as it stands. What is left falls into
connected parts. A part of up to MOST_EDGES edges is solved exactly by shortest augmenting paths,
many parts to a task; a larger part, whose size nothing bounds, is solved by a distributed auction
that ends within EPSILON of the best total for each unit, so no part is ever gathered into one task
because it grew.

Defined results: of several edges between the same two units the heaviest counts; edges with a null
end or weight, or a weight of 0 or less, are never taken; among equal totals the smaller names
win inside a part; an empty table gives no rows; further columns are ignored.
"""

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.components import components
from kinweave.session import cut, reclaim

#: Edges of a part that one task solves, whole; the auction solves larger ones.
MOST_EDGES = 20_000
#: What the auction may lose for each unit, in the unit of the weights.
EPSILON = 0.25


def solve(edges: list[tuple[str, str, float]]) -> list[int]:
    """Indices of the edges (a, b, weight) of a matching of greatest total weight, by shortest
    augmenting paths: each a in turn is matched to a b or to none at all."""
    a_no, b_no = {}, {}
    order = sorted(range(len(edges)), key=lambda k: edges[k])
    for k in order:
        a_no.setdefault(edges[k][0], len(a_no))
        b_no.setdefault(edges[k][1], len(b_no))
    top = max(w for _, _, w in edges)
    n, m = len(a_no), len(b_no)
    near: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
    for k in order:
        a, b, w = edges[k]
        near[a_no[a]].append((b_no[b], top - w, k))
    for i in range(n):
        near[i].append((m + i, top, -1))  # unmatched
    price, of_b, of_a = [0.0] * (m + n), [-1] * (m + n), [(-1, 0.0, -1)] * n
    for i in range(n):
        dist: dict[int, float] = {}
        back: dict[int, tuple[int, tuple[int, float, int]]] = {}
        done: set[int] = set()
        heap: list[tuple[float, int]] = []
        row, base = i, 0.0
        while True:
            for e in near[row]:
                j, d = e[0], base + e[1] - price[e[0]]
                if j not in done and d < dist.get(j, float("inf")) - 1e-12:
                    dist[j], back[j] = d, (row, e)
                    heapq.heappush(heap, (d, j))
            while True:
                d, j = heapq.heappop(heap)
                if j not in done and d == dist[j]:
                    break
            if of_b[j] < 0:
                break
            done.add(j)
            row = of_b[j]
            base = d - (of_a[row][1] - price[j])
        for x in done:
            price[x] += dist[x] - d
        while True:
            row, e = back[j]
            last, of_a[row], of_b[j] = of_a[row][0], e, row
            if row == i:
                break
            j = last
    return sorted(e[2] for e in of_a if e[2] >= 0)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chosen edges of whole parts; rows come sorted by part."""
    part, held = None, []

    def chosen() -> pa.RecordBatch:
        got = [held[k] for k in solve([(a, b, w) for _, a, b, w in held])] if held else []
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in got], pa.string()) for c in range(3)], ["side", "a", "b"])

    for batch in batches:
        for p, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                yield chosen()
                part, held = p, []
            held.append(tuple(row))
    yield chosen()


def auction(edges: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(side, a, b): every a without a b bids, in each round, for the b that leaves it most, as much as
    it can give over its second choice (or over staying alone); a b goes to its highest bidder."""
    edges = cut(edges.select("side", "a", "b", "score"))
    held = cut(edges.select("side", "b", "a", F.col("score").alias("price")).limit(0))
    out = cut(edges.select("side", "a").limit(0))
    while True:
        free = edges.join(held.select("side", "a"), ["side", "a"], "left_anti").join(out, ["side", "a"], "left_anti")
        worth = free.join(held.select("side", "b", "price"), ["side", "b"], "left").withColumn("v", F.col("score") - F.coalesce("price", F.lit(0.0)))
        worth = cut(worth.select("side", "a", "b", "v", F.coalesce("price", F.lit(0.0)).alias("price")))
        if worth.isEmpty():
            return held.select("side", "a", "b")
        best = worth.groupBy("side", "a").agg(F.max(F.struct("v", "b", "price")).alias("x")).select("side", "a", "x.v", "x.b", "x.price")
        rest = worth.join(best.select("side", "a", "b"), ["side", "a", "b"], "left_anti").groupBy("side", "a").agg(F.max("v").alias("second"))
        bids = cut(best.join(rest, ["side", "a"], "left").withColumn("bid", F.col("price") + F.col("v") - F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0)) + epsilon))
        out = cut(out.unionByName(bids.filter("v <= 0").select("side", "a")))
        won = bids.filter("v > 0").groupBy("side", "b").agg(F.max(F.struct("bid", "a")).alias("x")).select("side", "b", F.col("x.a").alias("a"), F.col("x.bid").alias("price"))
        new = cut(held.join(won.select("side", "b"), ["side", "b"], "left_anti").unionByName(won))
        for old in (held, worth, bids):
            reclaim(old)
        held = new


def assign(pairs: DataFrame, most_edges: int = MOST_EDGES, epsilon: float = EPSILON) -> DataFrame:
    """(side, a, b): the assignment between the units a and b of each ``side`` (two sources), by ``score``."""
    pairs = cut(pairs.filter("a IS NOT NULL AND b IS NOT NULL AND score > 0").groupBy("side", "a", "b").agg(F.max("score").alias("score")))
    count = lambda c: pairs.groupBy("side", c).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    all_edges = cut(pairs.join(count("a"), ["side", "a"]).join(count("b"), ["side", "b"]).withColumn("alone", (F.col("n_a") == 1) & (F.col("n_b") == 1)))
    alone = all_edges.filter("alone").select("side", "a", "b")
    rest = all_edges.filter("NOT alone").select("side", "a", "b", "score", F.concat_ws("|", "side", F.lit("a"), "a").alias("va"), F.concat_ws("|", "side", F.lit("b"), "b").alias("vb"))
    n = rest.count()
    if not n:
        return alone
    if n <= most_edges:  # no more than one part may have
        return alone.unionByName(rest.select(F.col("side").alias("part"), "side", "a", "b", "score").coalesce(1).sortWithinPartitions("part", "a", "b").mapInArrow(_parts, "side string, a string, b string"))
    part = components(rest, "va", "vb").select(F.col("vertex").alias("va"), F.col("group").alias("part"))
    placed = cut(rest.join(part, "va").select("part", "side", "a", "b", "score"))
    large = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_edges).select("part")
    small = placed.join(large, "part", "left_anti")
    spark = pairs.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    exact = small.repartition(tasks, "part").sortWithinPartitions("part", "a", "b").mapInArrow(_parts, "side string, a string, b string")
    out = alone.unionByName(exact)
    big = placed.join(large, "part", "left_semi")
    return out if big.isEmpty() else out.unionByName(auction(big, epsilon))
