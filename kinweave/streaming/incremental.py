"""Incremental linkage: what is new against a ledger, scores that no longer hold, micro-batches.

Late rows are never dropped: a version's place is decided by its delivery time and batch, not by
when it arrives, so there is no watermark. Replays are harmless: every write merges on a key made
of the content.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators import linkage as L
from kinweave.session import cut
from kinweave.sources.store import Store


def delta(std: DataFrame, ledger: DataFrame, model_version: str) -> DataFrame:
    """Records whose present content the model has not scored yet."""
    done = ledger.filter(F.col("model_version") == model_version).select("record_key", "content_hash")
    return std.join(done, ["record_key", "content_hash"], "left_anti")


def departed(ledger: DataFrame, std: DataFrame) -> DataFrame:
    """Ledger keys that no live record has."""
    return ledger.select("record_key").distinct().join(std.select("record_key"), "record_key", "left_anti")


def still_valid(scores: DataFrame, changed: DataFrame) -> DataFrame:
    """Scores neither side of which is among the changed keys."""
    k = changed.select("record_key").distinct()
    return scores.join(k.withColumnRenamed("record_key", "rec_a_key"), "rec_a_key", "left_anti").join(k.withColumnRenamed("record_key", "rec_b_key"), "rec_b_key", "left_anti")


def retired_models(scores: DataFrame, model_version: str) -> DataFrame:
    """Scores with those of other models set inactive."""
    return scores.withColumn("is_active", F.col("is_active") & (F.col("model_version") == model_version))


def deliver(stream: DataFrame, store: Store, table: str, keys: list[str], checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, order: Sequence[str] = ("ingested_at", "ingest_batch_id"), **trigger):
    """Write a stream of deliveries to a versioned table, each micro-batch merged on ``keys``.

    Of the rows of a key the last by ``order`` stays, however late an older one arrives; columns of
    ``order`` the stream lacks are left out. A batch that is replayed after a failure gives the same table.
    """
    by = [c for c in order if c in stream.columns]

    def each(batch: DataFrame, n: int) -> None:
        store.merge(table, batch if by else batch.dropDuplicates(keys), keys, by)
        if then:
            then(batch, n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def sync_ledger(store: Store, table: str, std: DataFrame, model_version: str) -> int:
    """Record that a model has scored the present contents: one row for each record and model."""
    return store.merge(table, std.select("record_key", "content_hash").withColumn("model_version", F.lit(model_version)), ["record_key", "model_version"])


def rescore(std: DataFrame, ledger: DataFrame, scores: DataFrame, model: L.Model, model_version: str, threshold: float | None = None) -> DataFrame:
    """Scores after a delivery, in two passes: the new and changed records against all others, and against each
    other; scores that neither touches stay."""
    fresh = cut(delta(std, ledger, model_version))
    rest = std.join(fresh.select(model.uid), model.uid, "left_anti")
    new = L.predict_between(rest, fresh, model, threshold).unionByName(L.predict(fresh, model, threshold), allowMissingColumns=True)
    a, b = F.col(f"{model.uid}_l"), F.col(f"{model.uid}_r")
    new = new.select(F.least(a, b).alias("rec_a_key"), F.greatest(a, b).alias("rec_b_key"), "match_probability")
    touched = fresh.select(F.col(model.uid).alias("record_key")).unionByName(departed(ledger, std.withColumnRenamed(model.uid, "record_key") if model.uid != "record_key" else std))
    return still_valid(scores, touched).select("rec_a_key", "rec_b_key", "match_probability").unionByName(new)
