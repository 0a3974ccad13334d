"""Queries of query planning, end-to-end retrieval, ingestion and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import queryplan
from millrace.plans import retrieve
from millrace.plans.audit_queries import PROFILE
from millrace.plans.retrieval_queries import _titles
from millrace.sources import views
from millrace.sources.tables import table
from millrace.streaming.changes import windowed_counts, winners


def _plans(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "normalized_queries").select("query_id", "original_text").dropDuplicates(["query_id"])
    return queryplan.plan_queries(q, "query_id", "original_text")


def plan_queries(spark: SparkSession, d: str) -> DataFrame:
    """T18, T21-T25 over the query log."""
    return _plans(spark, d).select("query_id", "error", "tier", "n_tokens", F.sha2("normalized_text", 256).alias("print"), F.size("segments").alias("n_segments"), F.size("intents").alias("n_intents"))


def plan_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Segments and intents by kind."""
    p = _plans(spark, d)
    s = queryplan.segments_of(p, "query_id").groupBy(F.lit("segment").alias("part"), "kind").agg(F.count("*").alias("n"), F.count_if("required").alias("n_required"))
    return s.unionByName(queryplan.intents_of(p, "query_id").groupBy(F.lit("intent").alias("part"), "kind").agg(F.count("*").alias("n"), F.count_if("required").alias("n_required")))


def plan_bindings(spark: SparkSession, d: str) -> DataFrame:
    """J18, T24."""
    return queryplan.bound_intents(_plans(spark, d), "query_id")


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return views.chunks(spark, d), views.bindings(spark, d), views.versions(spark, d), views.edges(spark, d)


def retrieved(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline for the titles of the stated documents."""
    return retrieve.retrieve(_titles(spark, d), *_tables(spark, d), retrieve.Options(level=4)).withColumn("origins", F.array_join("origins", "+"))


def retrieved_trace(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the stage they were dropped at."""
    return retrieve.explain(_titles(spark, d), *_tables(spark, d), retrieve.Options(level=4)).groupBy(F.coalesce("dropped_at", F.lit("kept")).alias("dropped_at")).agg(F.count("*").alias("n"))


def ingested(spark: SparkSession, d: str) -> DataFrame:
    """Ingestion of all segments: rows each table would get."""
    t = retrieve.ingest(views.segments(spark, d), PROFILE, "mg-v1")
    out = None
    for n, df in t.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def stream_winners(spark: SparkSession, d: str) -> DataFrame:
    """The holding delivery of each change, the state that streams keep."""
    return winners(table(spark, d, "outbox_events"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Extension: hourly windows of the event stream."""
    return windowed_counts(table(spark, d, "events"))


QUERIES = {f.__name__: f for f in (plan_queries, plan_kinds, plan_bindings, retrieved, retrieved_trace, ingested, stream_winners, stream_windows)}

_OP = r"upper(regexp_replace(operation, '^\s+|\s+$', '', 'g'))"
SQL = {
    "stream_winners": f"""
WITH e AS (SELECT lower(access_zone_id) AS access_zone_id, lower(binding_id) AS binding_id, {_OP} AS operation, operation_version, CAST(coalesce(attempt_count, -1) AS BIGINT) AS attempt_count FROM outbox_events WHERE access_zone_id IS NOT NULL AND binding_id IS NOT NULL AND operation_version IS NOT NULL)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY access_zone_id, binding_id, operation_version ORDER BY attempt_count DESC, CASE operation WHEN 'DELETE_POINT' THEN 3 WHEN 'UPDATE_PAYLOAD' THEN 2 WHEN 'UPSERT_POINT' THEN 1 ELSE 0 END DESC) AS r FROM e) WHERE r = 1""",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
