"""Integrity audits, fingerprints and set comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(children: DataFrame, parents: DataFrame, on: Sequence[str]) -> DataFrame:
    """Children without a parent. A null in the key is an orphan too."""
    return children.join(parents.select(*on).distinct(), list(on), "left_anti")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def count_audit(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row (check, n) per named set of offending rows; a check without any counts 0."""
    out = None
    for name, df in checks.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(hash) of the row counts of tables by one column each; equal contents give equal hashes in any row order.

    What is brought together is one row per table and value, never the rows."""
    counts = None
    for name, (df, by) in tables.items():
        one = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("v")).agg(F.count("*").alias("n")).select(F.concat_ws("|", F.lit(name), "v", "n").alias("line"))
        counts = one if counts is None else counts.unionByName(one)
    return counts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("hash"))


def compare_sets(known: DataFrame, applied: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state) of UNKNOWN (only applied), PENDING (only known), MISMATCH or MATCH."""
    j = known.select(key, F.col(value).alias("a"), F.lit(True).alias("in_a")).join(applied.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b")), key, "full_outer")
    state = F.when(F.col("in_a").isNull(), "UNKNOWN").when(F.col("in_b").isNull(), "PENDING").when(~F.col("a").eqNullSafe(F.col("b")), "MISMATCH").otherwise("MATCH")
    return j.select(key, state.alias("state"))


def incomplete(keys: DataFrame, parts: Mapping[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Keys that lack rows in any part, with the list of those parts."""
    out = keys.select(*on).distinct()
    for name, df in parts.items():
        out = out.join(df.select(*on).distinct().withColumn(f"has_{name}", F.lit(True)), list(on), "left")
    lacks = F.array_compact(F.array(*[F.when(F.col(f"has_{n}").isNull(), n) for n in parts]))
    return out.select(*on, lacks.alias("lacks")).where(F.size("lacks") > 0)


def expired_age(df: DataFrame, expires: str, as_of: str) -> DataFrame:
    """How many rows are past their expiry, and for how many seconds the first of them."""
    t = F.lit(as_of).cast("timestamp")
    past = df.where(F.col(expires) <= t)
    return past.agg(F.count("*").alias("n_expired"), (F.unix_timestamp(t) - F.unix_timestamp(F.min(expires))).alias("oldest_s"))


def counts_object(df: DataFrame, by: str) -> DataFrame:
    """(counts) as a map from value to count, in order of the values."""
    g = df.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))
    return g.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))
