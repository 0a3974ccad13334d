"""Guards, fences, cascades and resolutions over tables of state.

All of them are joins against distinct or pre-aggregated keys: nothing is looked up row by row, no group is collected,
and which states count is a parameter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_by(rows: DataFrame, guards: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows with held_by, the names of the guards that have a row with the same key. A null key is never held. Rows
    with an empty list are free: this is NOT EXISTS for several guards at once, which also tells why a row is kept."""
    out = rows
    for name, (guard, key) in guards.items():
        out = out.join(guard.select(*key).distinct().withColumn(f"by_{name}", F.lit(name)), list(key), "left")
    return out.withColumn("held_by", F.array_compact(F.array(*[f"by_{n}" for n in guards]))).drop(*[f"by_{n}" for n in guards])


def purgeable(rows: DataFrame, gone: Column, since: Column, as_of: str, grace_days: int, guards: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows that have been gone for the days of grace and more, with what holds them back. Rows of which it is not
    known since when stay out."""
    return held_by(rows.where(gone & (since <= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(grace_days)} DAYS"))), guards)


def deletable_points(points: DataFrame, bindings: DataFrame, key: Sequence[str], gone: Column, held: Column) -> DataFrame:
    """points (key, verdict): SKIPPED_LEGAL_HOLD whatever else, ORPHAN without a binding (deletable too), DELETABLE if
    the binding is gone. Other points give no row. gone and held are read from the bindings, of which there is one per key."""
    b = bindings.where(" AND ".join(f"{k} IS NOT NULL" for k in key)).select(*key, F.coalesce(gone, F.lit(False)).alias("gone_"), F.coalesce(held, F.lit(False)).alias("held_"))
    j = points.select(*key).distinct().join(b, list(key), "left")
    verdict = F.when(F.col("held_"), "SKIPPED_LEGAL_HOLD").when(F.col("gone_").isNull(), "ORPHAN").when(F.col("gone_"), "DELETABLE")
    return j.select(*key, verdict.alias("verdict")).where("verdict IS NOT NULL")


def fenced_deletes(events: DataFrame, current: DataFrame, key: Sequence[str], version: str, generation: str, held: Column) -> DataFrame:
    """Delete events with a verdict: ORPHAN without a row, HELD under legal hold, STALE if the row's generation is beyond
    the event's version, else APPLY. current has one row per key."""
    c = current.select(*key, F.coalesce(F.col(generation), F.lit(0)).alias("generation_"), F.coalesce(held, F.lit(False)).alias("held_"))
    verdict = F.when(F.col("held_").isNull(), "ORPHAN").when(F.col("held_"), "HELD").when(F.col("generation_") > F.col(version), "STALE").otherwise("APPLY")
    return events.join(c, list(key), "left").withColumn("verdict", verdict).drop("generation_", "held_")


def cascade(gone: DataFrame, key: Sequence[str], tables: Mapping[str, tuple[DataFrame, str]], holds: DataFrame) -> DataFrame:
    """(table_name, *key, row_id): the tombstones that the removal of the keys in gone leaves in every table, fenced: a
    key with a row in holds is not removed anywhere. One semi join per table on distinct keys."""
    free = gone.select(*key).distinct().join(holds.select(*key).distinct(), list(key), "left_anti")
    out = None
    for name, (df, row_id) in tables.items():
        one = df.join(free, list(key), "left_semi").select(F.lit(name).alias("table_name"), *key, F.col(row_id).alias("row_id")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def activation(versions: DataFrame, parts: Mapping[str, DataFrame], on: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Versions (*on, n_<part>..., state): how many rows each part has for the version, counted before the join, and the
    name of the first rule that holds, or READY."""
    out = versions.select(*on).distinct()
    for name, df in parts.items():
        out = out.join(df.groupBy(*on).agg(F.count("*").alias(f"n_{name}")), list(on), "left").fillna(0, [f"n_{name}"])
    state = F.lit("READY")
    for name, rule in reversed(rules):
        state = F.when(rule, name).otherwise(state)
    return out.withColumn("state", state)


def resolve_zones(requests: DataFrame, registry: DataFrame, request: str, codes: str, ids: str, most: int | None = None) -> DataFrame:
    """Requests with arrays of zone codes and ids, either of which may be null or empty, against a registry
    (zone_id, zone_code): (request, zones, error). zones are the ids in the order in which they were first asked for. error:
    EMPTY, UNKNOWN if a code or id is not registered, MISMATCH if codes and ids are given and name different sets, TOO_MANY."""
    asked = lambda c, kind: requests.select(F.col(request).alias("request"), F.posexplode(c).alias("pos", "name")).withColumn("kind", F.lit(kind))
    every = asked(codes, "CODE").unionByName(asked(ids, "ID")).groupBy("request", "kind", "name").agg(F.min("pos").alias("pos"))
    names = registry.select(F.lit("CODE").alias("kind"), F.col("zone_code").alias("name"), "zone_id").unionByName(registry.select(F.lit("ID").alias("kind"), F.col("zone_id").alias("name"), "zone_id")).distinct()
    found = every.join(names, ["kind", "name"], "left")
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("zone_id"))))
    # codes come before ids; a request is as long as its caller made it, so its rows fit one group
    place = F.struct(F.when(F.col("kind") == "CODE", 0).otherwise(1).alias("k"), "pos", "zone_id")
    g = found.groupBy("request").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("zone_id").isNotNull(), place))), lambda x: x["zone_id"])).alias("zones"), F.count_if(F.col("zone_id").isNull()).alias("unknown"), of("CODE").alias("a"), of("ID").alias("b"))
    error = F.when(F.col("zones").isNull(), "EMPTY").when(F.col("unknown") > 0, "UNKNOWN").when((F.size("a") > 0) & (F.size("b") > 0) & (F.col("a") != F.col("b")), "MISMATCH")
    if most is not None:
        error = F.coalesce(error, F.when(F.size("zones") > most, "TOO_MANY"))
    every_request = requests.select(F.col(request).alias("request")).distinct()
    none = F.array().cast(f"array<{dict(registry.dtypes)['zone_id']}>")
    return every_request.join(g, "request", "left").select(F.col("request").alias(request), F.when(error.isNull(), F.col("zones")).otherwise(none).alias("zones"), error.alias("error"))


def replace_edges(current: DataFrame, incoming: DataFrame, document: Sequence[str]) -> DataFrame:
    """The edges after the graphs of all documents in incoming were replaced: every old edge of such a document goes, the
    others stay. Both have the same columns."""
    kept = current.join(incoming.select(*document).distinct(), list(document), "left_anti")
    return kept.select(*current.columns).unionByName(incoming.select(*current.columns))
