"""Whole runs: deliveries to golden records, what a run depends on, one record against the corpus."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import contents as C
from kinweave.operators import golden as N
from kinweave.operators import graph as G
from kinweave.operators import linkage as L
from kinweave.operators import standardize as S
from kinweave.session import cut


def config_hash(config: dict) -> str:
    """SHA-256 of a configuration's canonical JSON: the order of keys doesn't matter."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Fingerprint:
    """What a run's result depends on."""

    config: str
    model: str
    frequencies: str
    standardizer: str
    survivorship: str
    engine: str

    def drift(self, other: Fingerprint) -> list[str]:
        return [k for k in self.__dataclass_fields__ if getattr(self, k) != getattr(other, k)]

    def verdict(self, other: Fingerprint) -> str:
        """proceed if nothing differs, full if stored scores can't be kept, refuse if the engine itself changed."""
        d = set(self.drift(other))
        return "proceed" if not d else "refuse" if "engine" in d else "full" if d & {"model", "frequencies", "standardizer", "config"} else "reassemble"


def standardized(raw: DataFrame) -> DataFrame:
    """Current versions of all records with their values in one writing, under the names of the standardized table."""
    cur = S.supersede(raw).withColumn("record_key", F.concat("source_system", F.lit(":"), "source_record_id"))
    x = C.contents(cur.select("record_key", "source_system", "ingested_at", "payload", "is_deleted"), ["record_key", "source_system", "ingested_at"])
    return x.select("record_key", "source_system", F.col("ingested_at").alias("updated_at_source"), "ingested_at", F.col("given").alias("given_name"), F.col("family").alias("family_name"), "email", F.col("phone").alias("phone_e164"), F.col("birth").try_cast("date").alias("birth_date"))


def link(std: DataFrame, model: L.Model, threshold: float = 0.95) -> DataFrame:
    """(record_key, entity_id): records grouped by the pairs that reach the threshold."""
    pairs = L.predict(std, model, threshold).select(F.col(f"{model.uid}_l").alias("a"), F.col(f"{model.uid}_r").alias("b"))
    return G.components(pairs, nodes=std.select(model.uid)).select(F.col("node").alias("record_key"), F.col("cluster").alias("entity_id"))


def run_all(raw: DataFrame, model: L.Model, rank: dict[str, int], chain: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Golden rows (entity_id and the compared attributes) from deliveries: standardize, match, group, assemble."""
    std = cut(standardized(raw))
    members = std.join(link(std, model, threshold), "record_key")
    attributes = [c.column for c in model.comparisons]
    return N.records(N.lineage(cut(members), {a: chain for a in attributes}, rank), attributes)


def resolve_one(probe: DataFrame, std: DataFrame, membership: DataFrame, model: L.Model, auto: float = 0.95, review: float = 0.6) -> DataFrame:
    """(probe, record_key, entity_id, confidence, band): entities that a few probe records may be."""
    s = L.predict_between(std, probe, model, review)
    s = s.select(F.col(f"{model.uid}_r").alias("probe"), F.col(f"{model.uid}_l").alias("record_key"), "match_probability")
    best = s.join(membership.select("record_key", "entity_id"), "record_key", "left")
    return best.select("probe", "record_key", "entity_id", F.floor(100 * F.col("match_probability")).alias("confidence"), L.band(F.col("match_probability"), auto, review).alias("band"))


def ensemble(df: DataFrame, models: Sequence[tuple[L.Model, float]], cascade: bool = True) -> DataFrame:
    """(a, b, p, member): pairs of several models with their own thresholds; in a cascade a pair that an
    earlier member took is not scored again."""
    out = None
    for i, (m, t) in enumerate(models):
        s = L.predict(df, m, t).select(F.col(f"{m.uid}_l").alias("a"), F.col(f"{m.uid}_r").alias("b"), F.col("match_probability").alias("p"), F.lit(i).alias("member"))
        if cascade and out is not None:
            s = s.join(out.select("a", "b"), ["a", "b"], "left_anti")
        out = s if out is None else out.unionByName(s)
    return out
