"""Graphs of links: components, increments, metrics, bridges, best links, cuts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.reads import edge_ids
from kinweave.session import cut


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and the sum of their hashes: equal only for equal sets, but for a chance of 2^-64."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", nodes: DataFrame | None = None) -> DataFrame:
    """(node, cluster): each node with the smallest node linked to it; nodes without a link are their own.

    Alternates the large-star and the small-star step until nothing changes: every step is one
    aggregation by node and one join, and the number of rounds grows with the logarithm of the size.
    """
    x, y = F.col(a), F.col(b)
    current = cut(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct())
    mark = _mark(current)
    while True:
        # large star: every larger neighbour of a node goes to the node's least neighbour (or the node)
        near = _both(current)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        new = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = cut(new)
        mark, last = _mark(new), mark
        if mark == last:
            break
        current = new
    tree = current.select(F.col("a").alias("node"), F.col("b").alias("cluster"))
    own = current.select(F.col("b").alias("node"), F.col("b").alias("cluster")).distinct()
    out = tree.unionByName(own).groupBy("node").agg(F.min("cluster").alias("cluster"))
    if nodes is not None:
        out = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct().join(out, "node", "left").select("node", F.coalesce("cluster", "node").alias("cluster"))
    return out


def components_incremental(old: DataFrame, new_edges: DataFrame) -> DataFrame:
    """``old`` (node, cluster) with new edges (a, b): old clusters are contracted to one node each, so
    only new links are clustered; equal to clustering all edges anew."""
    at = lambda c: old.select(F.col("node").alias(c), F.col("cluster").alias(f"c{c}"))
    up = new_edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    merged = components(up).select(F.col("node").alias("cluster"), F.col("cluster").alias("to"))
    known = old.join(merged, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster"))
    fresh = _both(new_edges).select(F.col("a").alias("node")).distinct().join(old, "node", "left_anti")
    self_ = fresh.join(merged.select(F.col("cluster").alias("node"), "to"), "node", "left").select("node", F.coalesce("to", "node").alias("cluster"))
    return known.unionByName(self_)


def node_metrics(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node, cluster, degree, centrality): centrality is the degree over the cluster's size less one."""
    degree = _both(edges.filter("a <> b")).distinct().groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    out = clusters.join(degree, "node", "left").join(size, "cluster")
    return out.select("node", "cluster", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.when(F.col("size") > 1, F.coalesce("degree", F.lit(0)) / (F.col("size") - 1)).otherwise(0.0).alias("centrality"))


def cluster_metrics(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(cluster, n_nodes, n_edges, density, centralisation)."""
    m = node_metrics(edges, clusters)
    n, d = F.col("n_nodes"), F.col("d")
    out = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("d"), F.max("degree").alias("top"))
    dense = F.when(n > 1, d / (n * (n - 1)))
    central = F.when(n > 2, (n * F.col("top") - d) / ((n - 1) * (n - 2)))
    return out.select("cluster", "n_nodes", (d / 2).cast("long").alias("n_edges"), dense.alias("density"), central.alias("centralisation"))


def _bridges(a: Sequence[str], b: Sequence[str]) -> list[tuple[str, str]]:
    """Edges of one component whose loss would part it; an explicit stack instead of recursion."""
    near: dict[str, list[tuple[str, int]]] = {}
    for i, (x, y) in enumerate(zip(a, b)):
        near.setdefault(x, []).append((y, i))
        near.setdefault(y, []).append((x, i))
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    out = []
    for root in near:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, -1, iter(near[root]))]
        while stack:
            v, came, it = stack[-1]
            for w, e in it:
                if e == came:
                    continue
                if w in order:
                    low[v] = min(low[v], order[w])
                    continue
                order[w] = low[w] = len(order)
                stack.append((w, e, iter(near[w])))
                break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] > order[u]:
                        out.append((min(u, v), max(u, v)))
    return out


#: Edges of a cluster that one task searches for bridges; larger clusters are searched by joins.
MOST_EDGES = 200_000
_EDGE = "a string, b string"


def _cluster_bridges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bridges of whole clusters; rows come sorted by cluster."""
    cluster, held = None, ([], [])

    def out() -> pa.RecordBatch:
        got = _bridges(*held)
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in got], pa.string()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for c, x, y in zip(*(col.to_pylist() for col in batch.columns)):
            if c != cluster:
                yield out()
                cluster, held = c, ([], [])
            held[0].append(x)
            held[1].append(y)
    yield out()


def bridges(edges: DataFrame, clusters: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """(a, b): edges whose loss would part a cluster. Clusters of up to ``most_edges`` edges are searched whole, many
    to a task; larger ones, which nothing bounds, by ``bridges_by_tour``."""
    e = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    placed = cut(e.join(clusters.select(F.col("node").alias("a"), "cluster"), "a").select("cluster", "a", "b"))
    large = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_edges).select("cluster")
    spark = edges.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    small = placed.join(large, "cluster", "left_anti").repartition(tasks, "cluster").sortWithinPartitions("cluster", "a", "b").mapInArrow(_cluster_bridges, _EDGE)
    big = cut(placed.join(large, "cluster", "left_semi"))
    return small if big.isEmpty() else small.unionByName(bridges_by_tour(big))


def spanning_forest(edges: DataFrame, seed: int = 0) -> DataFrame:
    """(a, b): edges that join each component without a circle. Each round every vertex whose least neighbour, by fresh
    hash order, is least among its own neighbours too merges into it by an edge between them."""
    cur, tree, n = cut(edges.select("a", "b", F.struct("a", "b").alias("o"))), None, 0
    while not cur.isEmpty():
        n += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed * 1000 + n), c).alias("h"), c.alias("v"))
        ends = cur.select(F.col("a").alias("v"), F.col("b").alias("w"), "o").unionByName(cur.select(F.col("b").alias("v"), F.col("a").alias("w"), "o"))
        best = cut(ends.groupBy("v").agg(F.min(F.struct(rank(F.col("w")).alias("r"), "o")).alias("m")).select("v", F.col("m.r.v").alias("w"), "m.o", (rank(F.col("v")) < F.col("m.r")).alias("root")))
        hooks = cut(best.filter("NOT root").join(best.filter("root").select(F.col("v").alias("w")), "w", "left_semi").select("v", F.col("w").alias("to"), "o"))
        got = hooks.select("o.a", "o.b")
        tree = got if tree is None else tree.unionByName(got)
        at = lambda c: hooks.select(F.col("v").alias(c), F.col("to").alias(f"{c}_to"))
        moved = cur.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y"), "o")
        left = moved.filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("o").alias("o"))
        cur = cut(left)
    return tree if tree is not None else edges.select("a", "b").limit(0)


def _xor_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, x, y, part, pos): running exclusive or of x and of y within a sorted partition."""
    part, last, at = TaskContext.get().partitionId(), [np.int64(0), np.int64(0)], 0
    for b in batches:
        cols = []
        for i in (0, 1):
            run = np.bitwise_xor.accumulate(np.concatenate([[last[i]], b.column(i + 1).to_numpy(zero_copy_only=False)]))[1:]
            last[i] = run[-1] if len(run) else last[i]
            cols.append(pa.array(run, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([part] * len(b), pa.int32()), pa.array(range(at, at + len(b)), pa.int64())], ["id", "x", "y", "part", "pos"])
        at += len(b)


def bridges_by_tour(edges: DataFrame) -> DataFrame:
    """(a, b) of ``edges`` (cluster, a, b) whose loss would part a cluster, by joins alone.

    Edges outside a spanning forest get random labels; a vertex has the exclusive or of its own. An edge of the
    forest is a bridge if the vertices behind it cancel out: no outer edge leads from there to the rest (wrongly so
    with a chance of 2^-128). Behind an edge lies what an Euler tour of the tree visits between its two passes; the
    tour is ranked by doubling, in as many rounds as the logarithm of its length.
    """
    e = cut(edges.select("cluster", "a", "b"))
    tree = cut(spanning_forest(e).join(e, ["a", "b"]).select("cluster", "a", "b"))
    outer = e.join(tree.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.xxhash64("a", "b", F.lit(1)).alias("x"), F.xxhash64("a", "b", F.lit(2)).alias("y"))
    mark = outer.select(F.col("a").alias("v"), "x", "y").unionByName(outer.select(F.col("b").alias("v"), "x", "y")).groupBy("v").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    both = tree.select("cluster", F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tree.select("cluster", F.col("b").alias("u"), F.col("a").alias("v")))
    arcs = cut(edge_ids(both, "u", "v").withColumnRenamed("edge_id", "id"))
    # behind an arc the tour goes on with the next arc, in the order of their numbers, out of the vertex it came to
    following = arcs.select((F.col("id") - 1).alias("id"), F.col("u").alias("nu"))
    first = arcs.groupBy("u").agg(F.min("id").alias("least"))
    after = arcs.join(following, "id", "left").join(first, "u").select("u", "v", F.when(F.col("nu") == F.col("u"), F.col("id") + 1).otherwise(F.col("least")).alias("nxt"))
    toured = arcs.join(after.select(F.col("u").alias("v"), F.col("v").alias("u"), "nxt"), ["u", "v"])
    start = arcs.groupBy("cluster").agg(F.min("id").alias("start"))
    opened = toured.join(start, "cluster").select("id", F.when(F.col("nxt") != F.col("start"), F.col("nxt")).alias("nxt"))
    rank = cut(opened.withColumn("d", F.col("nxt").isNotNull().cast("long")))
    while not rank.filter("nxt IS NOT NULL").isEmpty():
        far = rank.select(F.col("id").alias("nxt"), F.col("nxt").alias("next"), F.col("d").alias("more"))
        rank = cut(rank.join(far, "nxt", "left").select("id", F.col("next").alias("nxt"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
    ranked = cut(arcs.join(rank.select("id", "d"), "id"))
    back = ranked.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("d").alias("other"), F.col("id").alias("back"))
    # the pass that comes first enters a vertex; its mark counts there
    passes = ranked.join(back, ["u", "v"]).withColumn("down", F.col("d") > F.col("other")).join(mark.withColumnRenamed("v", "at"), F.col("v") == F.col("at"), "left")
    own = lambda c: F.when(F.col("down"), F.coalesce(c, F.lit(0))).otherwise(0).alias(c)
    passes = cut(passes.select("cluster", "id", "back", "d", "u", "v", "down", own("x"), own("y")))
    ordered = passes.repartitionByRange(F.col("cluster"), F.desc("d")).sortWithinPartitions("cluster", F.desc("d")).select("id", "x", "y")
    scan = cut(ordered.mapInArrow(_xor_scan, "id long, x long, y long, part int, pos long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = scan.groupBy("part").agg(F.max_by(F.struct("x", "y"), "pos").alias("t")).select("part", *(F.coalesce(F.bit_xor(f"t.{c}").over(before), F.lit(0)).alias(f"b{c}") for c in "xy"))
    summed = cut(scan.join(parts, "part").select("id", *(F.col(c).bitwiseXOR(F.col(f"b{c}")).alias(c) for c in "xy")))
    one, two = summed.select("id", F.col("x").alias("x1"), F.col("y").alias("y1")), summed.select(F.col("id").alias("back"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    inside = passes.filter("down").join(one, "id").join(two, "back")
    alone = [F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2")).bitwiseXOR(F.col(c)) == 0 for c in "xy"]
    return inside.filter(alone[0] & alone[1]).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


def threshold_summary(edges: DataFrame, nodes: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, clusters, largest, mean_size) for each threshold on ``p``; from the highest down each
    clustering starts from the one before."""
    out, have, last = [], None, None
    for t in sorted(thresholds, reverse=True):
        new = edges.filter((F.col("p") >= t) & (F.col("p") < last) if last is not None else F.col("p") >= t)
        have = cut(components(new, nodes=nodes) if have is None else components_incremental(have, new.select("a", "b")))
        last = t
        size = have.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        out.append(size.agg(F.lit(float(t)).alias("threshold"), F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), F.avg("n").alias("mean_size")))
    return reduce(DataFrame.unionByName, out)


def single_best_links(edges: DataFrame, source: Column | None = None, sources: Sequence[str] = ()) -> DataFrame:
    """(node, cluster): links accepted only where each side is the other's best, joined so that no
    cluster holds two records of a source in ``sources``; repeated until no link is accepted.

    ``edges``: a, b, p, and the sides' sources sa, sb.
    """
    node = edges.select(F.col("a").alias("node"), F.col("sa").alias("src")).unionByName(edges.select(F.col("b").alias("node"), F.col("sb").alias("src"))).distinct()
    state = cut(node.withColumn("cluster", F.col("node")))
    while True:
        la, lb = (state.select(F.col("node").alias(c), F.col("cluster").alias(f"c{c}")) for c in "ab")
        across = edges.join(la, "a").join(lb, "b").filter("ca <> cb").groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.max("p").alias("p"))
        if sources:
            has = state.filter(F.col("src").isin(*sources)).select("cluster", "src").distinct()
            clash = across.join(has.select(F.col("cluster").alias("x"), "src"), "x").join(has.select(F.col("cluster").alias("y"), "src"), ["y", "src"]).select("x", "y").distinct()
            across = across.join(clash, ["x", "y"], "left_anti")
        ends = across.select(F.col("x").alias("v"), F.col("y").alias("w"), "p").unionByName(across.select(F.col("y").alias("v"), F.col("x").alias("w"), "p"))
        best = ends.groupBy("v").agg(F.min(F.struct(-F.col("p"), "w"))["w"].alias("w"))
        pair = cut(best.join(best.select(F.col("v").alias("w"), F.col("w").alias("v")), ["v", "w"]).filter("v < w"))
        if pair.isEmpty():
            return state.select("node", "cluster")
        state = cut(state.join(pair.select(F.col("w").alias("cluster"), F.col("v").alias("to")), "cluster", "left").select("node", "src", F.coalesce("to", "cluster").alias("cluster")))


def drop_ties(edges: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Edges (a, b, p, sa, sb) without those that tie: a record of either side that has several neighbours in
    one of the duplicate-free ``sources`` at the same score has none of them."""
    ends = edges.select(F.col("a").alias("v"), F.col("b").alias("w"), F.col("sb").alias("sw"), "p").unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w"), F.col("sa").alias("sw"), "p"))
    ties = cut(ends.filter(F.col("sw").isin(list(sources))).groupBy("v", "sw", "p").agg(F.countDistinct("w").alias("n")).filter("n > 1").drop("n"))
    out = edges.join(ties.select(F.col("v").alias("a"), F.col("sw").alias("sb"), "p"), ["a", "sb", "p"], "left_anti")
    return out.join(ties.select(F.col("v").alias("b"), F.col("sw").alias("sa"), "p"), ["b", "sa", "p"], "left_anti").select(*edges.columns)


def closure(links: DataFrame, depth: int = 10) -> DataFrame:
    """(child, ancestor, hops) over parent links (child, parent), at most ``depth`` hops, each pair once."""
    step = links.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("hops"))
    out = step
    for h in range(2, depth + 1):
        step = cut(step.join(links.select(F.col("child").alias("ancestor"), "parent"), "ancestor").select("child", F.col("parent").alias("ancestor"), F.lit(h).alias("hops")))
        if step.isEmpty():
            break
        out = out.unionByName(step)
    return out.groupBy("child", "ancestor").agg(F.min("hops").alias("hops"))


def without_relatives(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not ancestor and descendant either way."""
    both = closed.select(F.col("child").alias("a"), F.col("ancestor").alias("b")).unionByName(closed.select(F.col("ancestor").alias("a"), F.col("child").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")
