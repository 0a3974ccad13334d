"""References to records that do not exist (problem 5).

The distinct non-null foreign keys, aggregated before the shuffle so a hot key becomes one row, are matched
against the parent keys with an anti join; parents that are deleted or younger than the earliest
reference come from the same pass. Only the keys in question go back to the referring rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINK = ("kind", "access_zone_id", "target")


def foreign_keys(df: DataFrame, table: str, field: str, kind: Column, target: Column, row_key: str, at: str, live: Column | None = None) -> DataFrame:
    """The references of one field in the common form. Repeated rows count once. Rows that live says are deleted,
    and null references, are left out; strings are compared in lower case."""
    df = df if live is None else df.where(live)
    return (
        df.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.lower("access_zone_id").alias("access_zone_id"), kind.alias("kind"), target.alias("target"), F.lower(row_key).alias("row_key"), F.col(at).alias("at"))
        .where("target IS NOT NULL AND kind IS NOT NULL AND access_zone_id IS NOT NULL")
    )


def parent_keys(df: DataFrame, kind: str, target: Column, created: str, deleted: Column) -> DataFrame:
    """The records that can be referred to, one row per key: deleted if all its rows are, with the earliest creation."""
    return (
        df.select(F.lit(kind).alias("kind"), F.lower("access_zone_id").alias("access_zone_id"), target.alias("target"), F.col(created).alias("created"), F.coalesce(deleted, F.lit(False)).alias("gone"))
        .where("target IS NOT NULL AND access_zone_id IS NOT NULL")
        .groupBy(*_LINK)
        .agg(F.min("created").alias("created"), F.min("gone").alias("gone"))
    )


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(ref_table, ref_field, access_zone_id, row_key, reason, period): one row per faulty reference.

    reason: missing if no parent has the key; else deleted; else late if the parent was created after the
    referring row (a null time on either side is never late). period is the month of the referring row,
    null where that time is null. Empty refs give no rows, empty parents make every reference missing.
    """
    keys = refs.groupBy(*_LINK).agg(F.min("at").alias("first"))
    missing = keys.join(parents, list(_LINK), "left_anti").select(*_LINK, F.lit("missing").alias("why"), F.lit(None).cast("timestamp").alias("created"))
    faulty = (
        parents.join(keys, list(_LINK), "inner")
        .where("gone OR created > first")
        .select(*_LINK, F.when(F.col("gone"), "deleted").otherwise("late").alias("why"), "created")
    )
    return (
        refs.join(missing.unionByName(faulty), list(_LINK), "inner")
        .where("why != 'late' OR created > at")
        .select("ref_table", "ref_field", "access_zone_id", "row_key", F.col("why").alias("reason"), F.date_format("at", "yyyy-MM").alias("period"))
        .distinct()
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Faulty references per table, field, month and reason."""
    return orphans.groupBy("ref_table", "ref_field", "period", "reason").agg(F.count("*").alias("n_refs"))
