"""Batch upserts with conflict policies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, key: Sequence[str], update: Sequence[str], on_conflict: str = "update") -> DataFrame:
    """Current with incoming rows put in. New keys are inserted; for known keys the update columns are taken from
    the incoming row ("update") or the current row stays ("ignore"). Each side must hold a key once."""
    key = list(key)
    rest = [c for c in current.columns if c not in key]
    j = current.select(*key, F.struct(*rest).alias("old")).join(incoming.select(*key, F.struct(*rest).alias("new")), key, "full_outer")
    take = lambda c: F.col("new." + c) if on_conflict == "update" and c in update else F.col("old." + c)
    cols = [F.when(F.col("old").isNull(), F.col("new." + c)).when(F.col("new").isNull(), F.col("old." + c)).otherwise(take(c)).alias(c) for c in rest]
    return j.select(*key, *cols)


def bump_versions(current: DataFrame, incoming: DataFrame, key: Sequence[str], tracked: Sequence[str], version: str) -> DataFrame:
    """Upsert that raises the version of a row only when a tracked column changed; new rows start at 1."""
    key = list(key)
    j = current.select(*key, version, F.struct(*tracked).alias("old")).join(incoming.select(*key, F.struct(*tracked).alias("new")), key, "full_outer")
    changed = F.col("new").isNotNull() & F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))
    v = F.when(F.col("old").isNull(), F.lit(1)).when(changed, F.col(version) + 1).otherwise(F.col(version))
    return j.select(*key, *[F.coalesce(F.col("new"), F.col("old"))[c].alias(c) for c in tracked], v.cast("bigint").alias(version), F.when(F.col("old").isNull(), "INSERTED").when(changed, "UPDATED").otherwise("UNCHANGED").alias("effect"))


def fenced(events: DataFrame, current: DataFrame, key: Sequence[str], version: str, alive: Column) -> DataFrame:
    """Each event with its verdict against the current rows: APPLY if the row is alive and has the event's version,
    STALE if not, ORPHAN if there is no row."""
    c = current.select(*key, F.col(version).alias("current_version"), alive.alias("alive_"))
    v = F.when(F.col("alive_").isNull(), "ORPHAN").when(F.col("alive_") & (F.col(version) == F.col("current_version")), "APPLY").otherwise("STALE")
    return events.join(c, list(key), "left").withColumn("verdict", v).drop("alive_", "current_version")


def register(known: DataFrame, incoming: DataFrame, key: Sequence[str], content: str) -> DataFrame:
    """(key, effect) of INSERTED, REPLAY (same content) or CONFLICT (other content under a known key)."""
    j = incoming.select(*key, F.col(content).alias("new")).distinct().join(known.select(*key, F.col(content).alias("old"), F.lit(True).alias("there")), list(key), "left")
    return j.select(*key, F.when(F.col("there").isNull(), "INSERTED").when(F.col("old").eqNullSafe(F.col("new")), "REPLAY").otherwise("CONFLICT").alias("effect"))


def latest_only(versions: DataFrame, group: Sequence[str], version: str, active: Column) -> DataFrame:
    """The version of each group that stays active when only the latest may be; combined before the shuffle."""
    return versions.where(active).groupBy(*group).agg(F.max(version).alias(version))


def repair_actions(expected: DataFrame, actual: DataFrame, key: Sequence[str], held: Column, wanted: Column) -> DataFrame:
    """(key, action): UPSERT where a wanted row has no counterpart, DELETE where a counterpart is unwanted or unknown,
    HOLD where it would be deleted but is held. held and wanted are read from expected."""
    e = expected.select(*key, wanted.alias("wanted"), F.coalesce(held, F.lit(False)).alias("held"))
    j = e.join(actual.select(*key).distinct().withColumn("there", F.lit(True)), list(key), "full_outer")
    want, there = F.coalesce("wanted", F.lit(False)), F.coalesce("there", F.lit(False))
    action = F.when(want & ~there, "UPSERT").when(there & ~want & F.coalesce("held", F.lit(False)), "HOLD").when(there & ~want, "DELETE")
    return j.select(*key, action.alias("action")).where("action IS NOT NULL")


def keep_longest(current: Column, incoming: Column, replace: bool) -> Column:
    """An expiry under change: replaced, or the later of both; null means never and wins."""
    return incoming if replace else F.when(current.isNull() | incoming.isNull(), F.lit(None).cast("timestamp")).otherwise(F.greatest(current, incoming))


def as_events(rows: DataFrame, key: Sequence[str], operation: str, version: str, payload: Mapping[str, Column] | None = None) -> DataFrame:
    """Change events for rows, with a name that makes their delivery idempotent."""
    from millrace.functions.text import uuid5

    p = F.to_json(F.struct(*[c.alias(n) for n, c in payload.items()])) if payload else F.lit(None).cast("string")
    return rows.select(uuid5(F.concat_ws("|", *key, F.lit(operation), version)).alias("id"), *key, F.lit(operation).alias("operation"), F.col(version).alias("operation_version"), F.lit(0).alias("attempt_count"), p.alias("payload"))
