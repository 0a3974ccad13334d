"""Change events and ingestion sessions as streams.

Order of arrival does not matter: state is keyed by binding and folded by version, so a micro-batch may be replayed."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.change_feed import OPERATIONS
from millrace.storage import publish, read_published

EVENT = "id string, access_zone_id string, binding_id string, operation string, operation_version long, attempt_count int, status string, locked_by string, lock_generation long, payload string, created_at timestamp"


def read_events(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(path)


def once(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each (zone, binding, version, attempt) once within the watermark, which also bounds the state."""
    return events.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["access_zone_id", "binding_id", "operation", "operation_version", "attempt_count"])


def winners(events: DataFrame) -> DataFrame:
    """The holding delivery of each change, as (access_zone_id, binding_id, operation, operation_version, attempt_count): enough
    to be folded again with later batches by apply_changes."""
    op = F.upper(F.regexp_replace("operation", r"(?U)^\s+|\s+$", ""))
    rows = events.where("access_zone_id IS NOT NULL AND binding_id IS NOT NULL AND operation_version IS NOT NULL").select(F.lower("access_zone_id").alias("access_zone_id"), F.lower("binding_id").alias("binding_id"), "operation_version", op.alias("operation"), F.coalesce(F.col("attempt_count").cast("bigint"), F.lit(-1)).alias("attempt_count"))
    code = F.lit(0)
    for k, v in OPERATIONS.items():
        code = F.when(F.col("operation") == k, v).otherwise(code)
    return rows.groupBy("access_zone_id", "binding_id", "operation_version").agg(F.max_by(F.struct("operation", "attempt_count"), F.struct("attempt_count", code)).alias("w")).select("access_zone_id", "binding_id", "w.operation", "operation_version", "w.attempt_count")


def follow(events: DataFrame, target: str, checkpoint: str, max_attempts: int | None = None, buckets: int = 256) -> StreamingQuery:
    """Keep the changes known so far under target, in buckets of bindings; deliveries whose attempts are used up go to
    target/dead_letters. A batch rewrites only the buckets it touches, and its last rename makes all of them current at once.
    Batches can be repeated: folding a batch twice changes nothing, and dead letters are written per batch number."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        good = df
        if max_attempts is not None:
            spent = F.coalesce((F.col("attempt_count") >= max_attempts) & (F.upper("status") != "COMPLETED"), F.lit(False))
            df.where(spent).write.mode("overwrite").parquet(f"{target}/dead_letters/batch={number}")
            good = df.where(~spent)
        bucket = F.pmod(F.xxhash64("access_zone_id", "binding_id"), F.lit(buckets)).cast("int")
        fresh = winners(good).withColumn("bucket", bucket)
        current = _manifest(spark, target)
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}  # at most `buckets`
        old = [f"{current[b]}/bucket={b}" for b in touched if b in current]
        known = fresh.drop("bucket")
        if old:
            known = winners(known.unionByName(spark.read.schema(known.schema).parquet(*old)))
        place = f"{target}/data/{uuid.uuid4().hex}"
        known.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(place)
        publish(spark.createDataFrame(sorted((current | dict.fromkeys(touched, place)).items()), "bucket int, place string").coalesce(1), f"{target}/manifest")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _manifest(spark: SparkSession, target: str) -> dict[int, str]:
    m = read_published(spark, f"{target}/manifest")
    return {} if m is None else {r["bucket"]: r["place"] for r in m.collect()}


def followed(spark: SparkSession, target: str) -> DataFrame:
    """The changes that follow keeps: the newest place of each bucket."""
    paths = [f"{p}/bucket={b}" for b, p in _manifest(spark, target).items()]
    schema = "access_zone_id string, binding_id string, operation string, operation_version long, attempt_count long"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def sessions(blocks: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Staged blocks (session_id, block_id, n_bytes, staged_at, final boolean) as sessions: (session_id, status,
    n_blocks, n_bytes, last_at). A session completes with its final block and expires when nothing came for `idle` of event
    time; blocks sent twice count once. State is dropped at either end."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    n, unit = idle.split()
    wait = int(n) * seconds[unit.rstrip("s")] * 1000

    def step(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        seen, total, last = state.get if state.exists else ([], 0, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "status": ["EXPIRED"], "n_blocks": [len(seen)], "n_bytes": [total], "last_at": [pd.Timestamp(last, unit="ms")]})
            return
        known, done = set(seen), False
        for f in frames:
            f = f.dropna(subset=["block_id"])
            fresh = f[~f["block_id"].isin(known)].drop_duplicates("block_id")
            known |= set(fresh["block_id"])
            total += int(fresh["n_bytes"].fillna(0).sum())
            if len(f):
                last = max(last, int(f["staged_at"].max().timestamp() * 1000))
                done = done or bool(f["final"].fillna(False).any())
        if done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "status": ["COMPLETED"], "n_blocks": [len(known)], "n_bytes": [total], "last_at": [pd.Timestamp(last, unit="ms")]})
        else:
            state.update((sorted(known), total, last))
            state.setTimeoutTimestamp(max(last + wait, state.getCurrentWatermarkMs() + 1))

    out = "session_id string, status string, n_blocks long, n_bytes long, last_at timestamp"
    return blocks.withWatermark("staged_at", "0 seconds").groupBy("session_id").applyInPandasWithState(step, out, "seen array<string>, total long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Extension: counts and sums per window of event time and type, batch or stream; rows later than delay are left out of a stream."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
