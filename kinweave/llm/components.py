"""Consolidating pairwise matches into groups (problem 3) by randomised contraction.

Each round every vertex hooks to the vertex of least hash among itself and its neighbours, the hash
being drawn afresh for the round; edges are relabelled to the hooks, loops and repeats dropped, and
the round's mapping kept. A round removes a constant share of the vertices in expectation, whatever
the shape: a chain of billions needs some tens of rounds, not its length. Afterwards the mappings
are composed from the last round back to the first.

Vertices of many edges are never gathered: the least neighbour is an aggregate with a map-side
part, and relabelling joins edges to a table with one row for each vertex, which AQE splits on the
edges' side where a vertex is hot.

Defined results: self pairs and pairs with a null side count for nothing; either order and any
number of repeats of a pair are one link; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.session import cut, reclaim


def components(edges: DataFrame, a: str = "a", b: str = "b", seed: int = 0) -> DataFrame:
    """(vertex, group): each vertex of any edge with the smallest vertex linked to it, directly or not."""
    x, y = F.col(a), F.col(b)
    links = cut(edges.filter(x.isNotNull() & y.isNotNull() & (x != y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())
    first, maps, current, n = links, [], links, 0
    while not current.isEmpty():
        n += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(seed * 1000 + n), c).alias("h"), c.alias("v"))
        ends = current.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(current.select(F.col("b").alias("v"), F.col("a").alias("w")))
        hooks = ends.groupBy("v").agg(F.min(rank(F.col("w"))).alias("m")).select("v", F.least(F.col("m"), rank(F.col("v")))["v"].alias("to"))
        hooks = cut(hooks)
        maps.append(hooks)
        left = current.join(hooks.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(hooks.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        nxt = cut(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if current is not first:
            reclaim(current)
        current = nxt
    if not maps:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("group"))
    root = maps[-1]
    for m in reversed(maps[:-1]):  # m: v -> to; root: vertices of the next rounds -> their last hook
        root = m.join(root.select(F.col("v").alias("to"), F.col("to").alias("r")), "to", "left").select("v", F.coalesce("r", "to").alias("to"))
    root = cut(root)
    for m in maps:
        reclaim(m)
    least = root.groupBy("to").agg(F.min("v").alias("group"))
    return root.join(least, "to").select(F.col("v").alias("vertex"), "group")


def linking_pairs(scores: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Unordered pairs whose active row of latest ``scored_at`` reaches the threshold; a tie in time goes to the larger id."""
    rows = scores.filter(F.col("is_active") & (F.col("rec_a_key") != F.col("rec_b_key"))).select(
        F.least("rec_a_key", "rec_b_key").alias("a"), F.greatest("rec_a_key", "rec_b_key").alias("b"), "scored_at", "id", "match_probability"
    )
    last = rows.groupBy("a", "b").agg(F.max(F.struct("scored_at", "id", "match_probability")).alias("m"))
    return last.filter(F.col("m.match_probability") >= threshold).select("a", "b")


def grouped_records(scores: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(record_key, group_key) of each record in a linking pair."""
    return components(linking_pairs(scores, threshold)).select(F.col("vertex").alias("record_key"), F.col("group").alias("group_key"))
