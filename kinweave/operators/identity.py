"""Identity over time: assertions, cuts, reconciliation with earlier entities, events, redirects."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.graph import components
from kinweave.session import cut, reclaim


def contradictions(assertions: DataFrame) -> DataFrame:
    """(a, b): never pairs that the always pairs link, directly or not. ``assertions``: a, b, kind."""
    same = components(assertions.filter("kind = 'always'"))
    x = assertions.filter("kind = 'never'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    at = lambda c: same.select(F.col("node").alias(c), F.col("cluster").alias(f"c{c}"))
    return x.join(at("a"), "a").join(at("b"), "b").filter("ca = cb").select("a", "b")


def _cut_cluster(p: pd.DataFrame) -> pd.DataFrame:
    """Edges to cut in one cluster until no never pair is linked: of the shortest path between the pair
    (first by name) the weakest unprotected edge goes; a path of protected edges stays and is told."""
    edges = {(r.a, r.b): (r.p, r.protected) for r in p[p.kind == "edge"].itertuples()}
    nevers = sorted({(r.a, r.b) for r in p[p.kind == "never"].itertuples()})
    out = []

    def path(s: str, t: str):
        near: dict[str, list[str]] = {}
        for x, y in edges:
            near.setdefault(x, []).append(y)
            near.setdefault(y, []).append(x)
        came, layer = {s: None}, [s]
        while layer and t not in came:
            after = []
            for v in sorted(layer):
                for w in sorted(near.get(v, ())):
                    if w not in came:
                        came[w] = v
                        after.append(w)
            layer = after
        if t not in came:
            return None
        steps, v = [], t
        while came[v] is not None:
            steps.append((min(v, came[v]), max(v, came[v])))
            v = came[v]
        return steps

    for s, t in nevers:
        while steps := path(s, t):
            free = [e for e in steps if not edges[e][1]]
            if not free:
                out.append((s, t, "unsatisfiable"))
                break
            e = min(free, key=lambda e: (edges[e][0], e))
            out.append((*e, "cut"))
            del edges[e]
    return pd.DataFrame(out, columns=["a", "b", "outcome"])


def never_cuts(edges: DataFrame, nevers: DataFrame) -> DataFrame:
    """(a, b, outcome): edges cut so that no never pair stays linked, and pairs that can't be parted.

    ``edges``: a < b, p, protected. Only clusters that hold a never pair are looked at, each by itself.
    """
    same = cut(components(edges))
    x = nevers.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    at = lambda c: same.select(F.col("node").alias(c), F.col("cluster").alias(f"c{c}"))
    hit = x.join(at("a"), "a").join(at("b"), "b").filter("ca = cb").select(F.col("ca").alias("cluster"), "a", "b", F.lit(None).cast("double").alias("p"), F.lit(False).alias("protected"), F.lit("never").alias("kind"))
    rows = edges.join(at("a"), "a").select(F.col("ca").alias("cluster"), "a", "b", "p", "protected", F.lit("edge").alias("kind")).join(hit.select("cluster").distinct(), "cluster", "left_semi").select("cluster", "a", "b", "p", "protected", "kind")
    return rows.unionByName(hit).groupBy("cluster").applyInPandas(_cut_cluster, "a string, b string, outcome string")


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(group, entity_id, minted): identity of each new group (record_key, group) given old entities
    (record_key, entity_id). An entity offers its id to the group that holds most of it, a group takes
    the offer of the largest overlap; ties go to the smaller name. Other groups get a new id made of
    their smallest member."""
    shared = old.join(new, "record_key").groupBy("entity_id", "group").agg(F.count(F.lit(1)).alias("n"))
    offer = Window.partitionBy("entity_id").orderBy(F.desc("n"), "group")
    take = Window.partitionBy("group").orderBy(F.desc("n"), "entity_id")
    kept = shared.withColumn("r", F.row_number().over(offer)).filter("r = 1").withColumn("t", F.row_number().over(take)).filter("t = 1").select("group", "entity_id")
    groups = new.groupBy("group").agg(F.min("record_key").alias("least"))
    own = F.sha2(F.concat(F.lit("entity:"), F.col("least")), 256)
    return groups.join(kept, "group", "left").select("group", F.coalesce("entity_id", own).alias("entity_id"), F.col("entity_id").isNull().alias("minted"))


def events(old: DataFrame, new: DataFrame) -> DataFrame:
    """(event_type, entity_id, record_key): what became of entities between two memberships (record_key,
    entity_id): created, retired, merged (into), split (from), member_added, member_removed."""
    was, now = old.select("entity_id").distinct(), new.select("entity_id").distinct()
    created = now.join(was, "entity_id", "left_anti")
    gone = was.join(now, "entity_id", "left_anti")
    moves = old.withColumnRenamed("entity_id", "before").join(new.withColumnRenamed("entity_id", "after"), "record_key", "full")
    merged = moves.join(gone.withColumnRenamed("entity_id", "before"), "before", "left_semi").filter("after IS NOT NULL").select(F.col("before").alias("entity_id")).distinct()
    split = moves.filter("before <> after").join(now.withColumnRenamed("entity_id", "before"), "before", "left_semi").select(F.col("before").alias("entity_id")).distinct()
    say = lambda df, kind, key=None: df.select(F.lit(kind).alias("event_type"), "entity_id", (F.col(key) if key else F.lit(None).cast("string")).alias("record_key"))
    differ = ~F.col("before").eqNullSafe(F.col("after"))
    added = moves.filter(differ & F.col("after").isNotNull()).select(F.col("after").alias("entity_id"), "record_key")
    removed = moves.filter(differ & F.col("before").isNotNull()).select(F.col("before").alias("entity_id"), "record_key")
    parts = [say(created, "created"), say(gone.join(merged, "entity_id", "left_anti"), "retired"), say(merged, "merged"), say(split, "split"), say(added, "member_added", "record_key"), say(removed, "member_removed", "record_key")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolved(redirects: DataFrame, hops: int = 32) -> DataFrame:
    """(entity_id, target): where merged entities (entity_id, merged_into) end; an entity on a circle, or
    further than 2^hops, ends nowhere (null). Of several redirects of an entity the least counts.

    By doubling, and as long as that halves them only of the entities that others lead to: the rest wait, a level
    each round, for the end of what they lead to. All joins are merges, as a table's files say too little of its
    rows: 9 million numbered in a row are under Spark's limit for a broadcast and more than a driver holds.
    """
    cur = redirects.filter("merged_into IS NOT NULL").groupBy("entity_id").agg(F.min("merged_into").alias("to"))
    cur = cut(_asked(cur))
    n, asked = cur.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    rounds, levels = n.bit_length(), []
    halves = rounds <= hops
    for r in range(min(rounds, hops)):
        if halves and r:
            cur, last = cut(_asked(cur)), cur
            n, asked = cur.agg(F.count(F.lit(1)), F.count_if("asked")).first()
            reclaim(last)
        halves = halves and 2 * asked <= n
        if halves:
            levels.append(cur)
        last, cur = cur, cur.filter("asked") if halves else cur
        ahead = cur.select(F.col("entity_id").alias("to"), F.col("to").alias("next")).hint("merge")
        cur = cut(cur.join(ahead, "to", "left").select("entity_id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if not halves:
            reclaim(last)
        if cur.filter("moved").isEmpty():
            out = cur.select("entity_id", F.col("to").alias("target"))
            break
    else:
        on = cur.select(F.col("entity_id").alias("to"), F.lit(True).alias("on")).hint("merge")
        out = cur.join(on, "to", "left").select("entity_id", F.when(F.col("on").isNull(), F.col("to")).alias("target"))
    for level in reversed(levels):
        ends = out.select(F.col("entity_id").alias("to"), "target", F.lit(True).alias("on")).hint("merge")
        out = level.join(ends, "to", "left").select("entity_id", F.when(F.col("on"), F.col("target")).otherwise(F.col("to")).alias("target"))
    return out


def _asked(links: DataFrame) -> DataFrame:
    """Links (entity_id, to) told whether one of them leads to their entity."""
    to = links.select(F.col("to").alias("entity_id")).distinct().withColumn("on", F.lit(True)).hint("merge")
    return links.join(to, "entity_id", "left").select("entity_id", "to", F.col("on").isNotNull().alias("asked"))


def merge(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``source`` put in place of those with the same keys, or added."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source, allowMissingColumns=True)


# Steward tables in the store ------------------------------------------------------------------------
REVIEW_KEY = ["rec_a_key", "rec_b_key", "reason"]


def gray_band(scores: DataFrame, review: float, auto: float) -> DataFrame:
    """(rec_a_key, rec_b_key, reason, p): pairs whose best active score lies between the thresholds."""
    best = scores.filter("is_active").groupBy("rec_a_key", "rec_b_key").agg(F.max("match_probability").alias("p"))
    return best.filter((F.col("p") >= review) & (F.col("p") < auto)).select("rec_a_key", "rec_b_key", F.lit("gray_band").alias("reason"), "p")


def upsert_reviews(store, table: str, found: DataFrame) -> int:
    """Merge found reviews (REVIEW_KEY, p) into a table of the store: new ones are open, a known one keeps its
    status and takes the new probability."""
    known = store.read(table).select(*REVIEW_KEY, "status")
    return store.merge(table, found.join(known, REVIEW_KEY, "left").withColumn("status", F.coalesce("status", F.lit("open"))), REVIEW_KEY)


def prune_ledger(store, table: str, std: DataFrame, models: Sequence[str]) -> int:
    """Delete ledger rows of records that no longer exist and of models that are not live."""
    led = store.read(table)
    gone = led.select("record_key").distinct().join(std.select("record_key"), "record_key", "left_anti")
    rows = led.filter(F.col("model_version").isin(list(models))).join(gone, "record_key", "left_anti")
    return store.replace(table, rows)
