"""Queries of the general data-processing problems 1, 4 and 5, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.change_feed import publish_state
from millrace.operators.copy_diff import NEVER_EPOCH, copy_differences, json_value
from millrace.operators.references import foreign_keys, orphan_counts, orphan_references, parent_keys
from millrace.sources.tables import table
from millrace.storage import shared_dir


def p1_state(spark: SparkSession, d: str) -> DataFrame:
    """The published state, tombstones included."""
    import uuid

    return publish_state(table(spark, d, "outbox_events"), f"{shared_dir(spark)}/binding_state-{uuid.uuid4().hex}")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_state(spark, d).where("NOT deleted").select("access_zone_id", "binding_id", "operation_version", "attempt_count")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    same = lambda n: (F.col(n), F.col(n))
    expires = F.coalesce(F.floor(F.unix_micros("expires_at") / F.lit(1_000_000)), F.lit(NEVER_EPOCH)).cast("bigint")
    compare = {
        "payload_version": same("payload_version"),
        "lifecycle_status": same("lifecycle_status"),
        "qdrant_sync_status": same("qdrant_sync_status"),
        "access_level": same("access_level"),
        "expires_at": (expires, F.col("expires_at_epoch")),
        "metadata": (json_value(F.col("metadata")), json_value(F.col("metadata"))),
    }
    return copy_differences(
        table(spark, d, "vector_bindings"), table(spark, d, "index_points"), ["access_zone_id", "qdrant_point_id"], compare, "updated_at", "scanned_at", "missing_in_index", "missing_in_bindings"
    )


def _references(spark: SparkSession, d: str) -> DataFrame:
    vb, ge, rc = (table(spark, d, t) for t in ("vector_bindings", "graph_edges", "related_chunks"))
    live = F.expr("lifecycle_status IS NULL OR lifecycle_status != 'DELETED'")
    chunk = lambda c: F.struct(F.lower(c).alias("id"), F.lit(None).cast("bigint").alias("version"))
    named = lambda c: F.when(F.col(c).isNotNull(), chunk(c))
    newest = (
        vb.groupBy(F.lower("access_zone_id").alias("access_zone_id"), F.lower("id").alias("id"))
        .agg(F.max_by(F.struct("chunk_id", "parent_chunk_id", "lifecycle_status", "created_at"), F.struct(F.coalesce(F.unix_micros("updated_at"), F.lit(-(2**63))), F.xxhash64("chunk_id", "parent_chunk_id", "lifecycle_status", "created_at"))).alias("row"))
        .select("access_zone_id", "id", "row.*")
    )
    kind = F.when(F.col("target_node_type").isin("CHUNK", "DOCUMENT", "LOGICAL_BLOCK"), F.col("target_node_type"))
    version = F.struct(F.lower("related_document_id").alias("id"), F.col("related_document_version").alias("version"))
    return (
        foreign_keys(newest, "vector_bindings", "chunk_id", F.lit("CHUNK"), named("chunk_id"), "id", "created_at", live)
        .unionByName(foreign_keys(newest, "vector_bindings", "parent_chunk_id", F.lit("CHUNK"), named("parent_chunk_id"), "id", "created_at", live))
        .unionByName(foreign_keys(ge, "graph_edges", "target_node_id", kind, named("target_node_id"), "edge_id", "created_at", live))
        .unionByName(foreign_keys(rc, "related_chunks", "related_document_id", F.lit("VERSION"), F.when(F.expr("related_document_id IS NOT NULL"), version), "relation_identity", "found_at"))
    )


def _parents(spark: SparkSession, d: str) -> DataFrame:
    gc, dv, ts = (table(spark, d, t) for t in ("generated_chunks", "document_versions", "text_segments"))
    key = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.lower(c).alias("id"), F.lit(None).cast("bigint").alias("version")))
    deleted = F.col("lifecycle_status") == "DELETED"
    version = F.when(F.expr("document_id IS NOT NULL"), F.struct(F.lower("document_id").alias("id"), F.col("document_version").alias("version")))
    return (
        parent_keys(gc, "CHUNK", key("id"), "created_at", deleted)
        .unionByName(parent_keys(dv, "DOCUMENT", key("document_id"), "created_at", deleted))
        .unionByName(parent_keys(dv, "VERSION", version, "created_at", deleted))
        .unionByName(parent_keys(ts, "LOGICAL_BLOCK", key("block_id"), "created_at", F.lit(False)))
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d), _parents(spark, d))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(p5_found(spark, d))


QUERIES = {"p1_found": p1_found, "p1_state": p1_state, "p4_found": p4_found, "p5_found": p5_found, "p5_counts": p5_counts}

_TRIM = r"upper(regexp_replace(operation, '^\s+|\s+$', '', 'g'))"

SQL = {
    "p1_found": f"""
WITH e AS (
  SELECT lower(access_zone_id) AS access_zone_id, lower(binding_id) AS binding_id, operation_version AS v, coalesce(attempt_count, -1) AS a,
         CASE {_TRIM} WHEN 'UPSERT_POINT' THEN 1 WHEN 'UPDATE_PAYLOAD' THEN 2 WHEN 'DELETE_POINT' THEN 3 ELSE 0 END AS op
  FROM outbox_events WHERE access_zone_id IS NOT NULL AND binding_id IS NOT NULL AND operation_version IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY access_zone_id, binding_id, v ORDER BY a DESC, op DESC) AS r FROM e),
s AS (SELECT *, max(CASE WHEN op = 3 THEN v END) OVER w AS del, max(CASE WHEN op = 1 THEN v END) OVER w AS up
  FROM c WHERE r = 1 WINDOW w AS (PARTITION BY access_zone_id, binding_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY access_zone_id, binding_id ORDER BY v DESC) AS k
  FROM s WHERE up IS NOT NULL AND (del IS NULL OR up > del) AND op IN (1, 2) AND v >= up)
SELECT access_zone_id, binding_id, v AS operation_version, CASE WHEN a < 0 THEN NULL ELSE CAST(a AS BIGINT) END AS attempt_count FROM l WHERE k = 1""",
    "p5_found": """
WITH vb AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(access_zone_id), lower(id) ORDER BY updated_at DESC NULLS LAST) AS r FROM vector_bindings) WHERE r = 1),
refs AS (
  SELECT DISTINCT * FROM (
  SELECT 'vector_bindings' AS ref_table, 'chunk_id' AS ref_field, lower(access_zone_id) AS access_zone_id, 'CHUNK' AS kind, lower(chunk_id) AS id, CAST(NULL AS BIGINT) AS version, lower(id) AS row_key, created_at AS made
  FROM vb WHERE chunk_id IS NOT NULL AND lifecycle_status IS DISTINCT FROM 'DELETED'
  UNION ALL
  SELECT 'vector_bindings', 'parent_chunk_id', lower(access_zone_id), 'CHUNK', lower(parent_chunk_id), NULL, lower(id), created_at
  FROM vb WHERE parent_chunk_id IS NOT NULL AND lifecycle_status IS DISTINCT FROM 'DELETED'
  UNION ALL
  SELECT 'graph_edges', 'target_node_id', lower(access_zone_id), target_node_type, lower(target_node_id), NULL, lower(edge_id), created_at
  FROM graph_edges WHERE target_node_id IS NOT NULL AND target_node_type IN ('CHUNK', 'DOCUMENT', 'LOGICAL_BLOCK') AND lifecycle_status IS DISTINCT FROM 'DELETED'
  UNION ALL
  SELECT 'related_chunks', 'related_document_id', lower(access_zone_id), 'VERSION', lower(related_document_id), related_document_version, lower(relation_identity), found_at
  FROM related_chunks WHERE related_document_id IS NOT NULL)),
parents AS (
  SELECT kind, access_zone_id, id, version, min(created_at) AS created, bool_and(gone) AS gone FROM (
  SELECT 'CHUNK' AS kind, lower(access_zone_id) AS access_zone_id, lower(id) AS id, CAST(NULL AS BIGINT) AS version, created_at, coalesce(lifecycle_status = 'DELETED', false) AS gone FROM generated_chunks
  UNION ALL SELECT 'DOCUMENT', lower(access_zone_id), lower(document_id), NULL, created_at, coalesce(lifecycle_status = 'DELETED', false) FROM document_versions
  UNION ALL SELECT 'VERSION', lower(access_zone_id), lower(document_id), document_version, created_at, coalesce(lifecycle_status = 'DELETED', false) FROM document_versions
  UNION ALL SELECT 'LOGICAL_BLOCK', lower(access_zone_id), lower(block_id), NULL, created_at, false FROM text_segments) GROUP BY ALL),
j AS (
  SELECT r.*, CASE WHEN p.id IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.created > r.made THEN 'late' END AS reason
  FROM refs r LEFT JOIN parents p ON p.kind = r.kind AND p.access_zone_id = r.access_zone_id AND p.id = r.id AND p.version IS NOT DISTINCT FROM r.version)
SELECT DISTINCT ref_table, ref_field, access_zone_id, row_key, reason, strftime(timezone('UTC', made), '%Y-%m') AS period FROM j WHERE reason IS NOT NULL""",
    "p4_found": """
WITH b AS (
  SELECT * FROM (SELECT lower(access_zone_id) AS z, lower(qdrant_point_id) AS p, payload_version, lifecycle_status, qdrant_sync_status, access_level,
    coalesce(CAST(floor(epoch_us(expires_at) / 1000000) AS BIGINT), 253402300799) AS expires, metadata,
    row_number() OVER (PARTITION BY lower(access_zone_id), lower(qdrant_point_id) ORDER BY updated_at DESC NULLS LAST) AS r
    FROM vector_bindings WHERE access_zone_id IS NOT NULL AND qdrant_point_id IS NOT NULL) WHERE r = 1),
i AS (
  SELECT * FROM (SELECT lower(access_zone_id) AS z, lower(qdrant_point_id) AS p, payload_version, lifecycle_status, qdrant_sync_status, access_level, expires_at_epoch AS expires, metadata,
    row_number() OVER (PARTITION BY lower(access_zone_id), lower(qdrant_point_id) ORDER BY scanned_at DESC NULLS LAST) AS r
    FROM index_points WHERE access_zone_id IS NOT NULL AND qdrant_point_id IS NOT NULL) WHERE r = 1),
jb AS (SELECT z, p, list_sort(list_transform(json_keys(metadata), lambda k: k || '=' || CAST(json_extract(metadata, '$."' || k || '"') AS VARCHAR))) AS m FROM b WHERE metadata IS NOT NULL),
ji AS (SELECT z, p, list_sort(list_transform(json_keys(metadata), lambda k: k || '=' || CAST(json_extract(metadata, '$."' || k || '"') AS VARCHAR))) AS m FROM i WHERE metadata IS NOT NULL),
f AS (
  SELECT coalesce(b.z, i.z) AS access_zone_id, coalesce(b.p, i.p) AS qdrant_point_id,
    CASE WHEN i.p IS NULL THEN ['missing_in_index'] WHEN b.p IS NULL THEN ['missing_in_bindings'] ELSE [
      CASE WHEN b.payload_version IS DISTINCT FROM i.payload_version THEN 'payload_version' END,
      CASE WHEN b.lifecycle_status IS DISTINCT FROM i.lifecycle_status THEN 'lifecycle_status' END,
      CASE WHEN b.qdrant_sync_status IS DISTINCT FROM i.qdrant_sync_status THEN 'qdrant_sync_status' END,
      CASE WHEN b.access_level IS DISTINCT FROM i.access_level THEN 'access_level' END,
      CASE WHEN b.expires IS DISTINCT FROM i.expires THEN 'expires_at' END,
      CASE WHEN jb.m IS DISTINCT FROM ji.m THEN 'metadata' END] END AS diffs
  FROM b FULL JOIN i ON b.z = i.z AND b.p = i.p LEFT JOIN jb ON jb.z = b.z AND jb.p = b.p LEFT JOIN ji ON ji.z = i.z AND ji.p = i.p)
SELECT access_zone_id, qdrant_point_id, difference FROM (SELECT access_zone_id, qdrant_point_id, unnest(diffs) AS difference FROM f) WHERE difference IS NOT NULL""",
}
SQL["p1_state"] = f"""
WITH e AS (
  SELECT lower(access_zone_id) AS access_zone_id, lower(binding_id) AS binding_id, operation_version AS v, coalesce(attempt_count, -1) AS a,
         CASE {_TRIM} WHEN 'UPSERT_POINT' THEN 1 WHEN 'UPDATE_PAYLOAD' THEN 2 WHEN 'DELETE_POINT' THEN 3 ELSE 0 END AS op
  FROM outbox_events WHERE access_zone_id IS NOT NULL AND binding_id IS NOT NULL AND operation_version IS NOT NULL),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY access_zone_id, binding_id, v ORDER BY a DESC, op DESC) AS r FROM e) WHERE r = 1 AND op <> 0),
s AS (SELECT *, max(CASE WHEN op = 3 THEN v END) OVER w AS del, max(CASE WHEN op = 1 THEN v END) OVER w AS up
  FROM c WINDOW w AS (PARTITION BY access_zone_id, binding_id)),
l AS (SELECT *, coalesce(up > coalesce(del, up - 1), false) AS live FROM s WHERE up IS NOT NULL OR del IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY access_zone_id, binding_id ORDER BY v DESC) AS k FROM l WHERE CASE WHEN live THEN op IN (1, 2) AND v >= up ELSE op = 3 END)
SELECT access_zone_id, binding_id, v AS operation_version, CASE WHEN a < 0 THEN NULL ELSE CAST(a AS BIGINT) END AS attempt_count, NOT live AS deleted FROM k WHERE k = 1"""
SQL["p5_counts"] = f"SELECT ref_table, ref_field, period, reason, count(*) AS n_refs FROM ({SQL['p5_found']}) GROUP BY ALL"
