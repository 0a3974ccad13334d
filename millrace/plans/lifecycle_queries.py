"""Queries of guards, fences, cascades and resolutions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import lifecycle
from millrace.plans.serving_queries import AS_OF
from millrace.sources import views
from millrace.sources.tables import table

_DOC = ["access_zone_id", "document_id", "document_version"]
_POINT = ["access_zone_id", "qdrant_point_id"]
_GONE = ("DELETING", "DELETED", "EXPIRED", "SUPERSEDED", "DELETE_FAILED")


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "outbox_events")
    return e.select(*[F.lower(c).alias(c) for c in ("id", "access_zone_id", "binding_id")], F.upper(F.trim("operation")).alias("operation"), "operation_version", "status").where("binding_id IS NOT NULL AND operation_version IS NOT NULL")


def purge_bindings(spark: SparkSession, d: str) -> DataFrame:
    """Bindings deleted for thirty days, and what holds them back: legal hold on any of the document's bindings, an
    unfinished event, a live binding of the same chunk."""
    b = views.bindings(spark, d)
    pending = _events(spark, d).where("status IN ('PENDING', 'PROCESSING', 'RETRY_PENDING')")
    guards = {
        "legal_hold": (b.where("legal_hold"), _DOC),
        "pending_event": (pending, ["access_zone_id", "binding_id"]),
        "live_reference": (b.where("lifecycle_status = 'ACTIVE'"), ["access_zone_id", "chunk_id"]),
    }
    rows = lifecycle.purgeable(b, F.col("lifecycle_status") == "DELETED", F.col("updated_at"), AS_OF, 30, guards)
    return rows.select("access_zone_id", "binding_id", F.array_join("held_by", "+").alias("held_by"))


def deletable_points(spark: SparkSession, d: str) -> DataFrame:
    """F07, F08."""
    return lifecycle.deletable_points(views.points(spark, d), views.bindings(spark, d).dropDuplicates(_POINT), _POINT, F.col("lifecycle_status").isin(*_GONE), F.col("legal_hold"))


def delete_fence(spark: SparkSession, d: str) -> DataFrame:
    """L03."""
    e = _events(spark, d).where("operation = 'DELETE_POINT'").select("id", "access_zone_id", "binding_id", "operation_version").distinct()
    return lifecycle.fenced_deletes(e, views.bindings(spark, d), ["access_zone_id", "binding_id"], "operation_version", "payload_version", F.col("legal_hold")).select("id", "access_zone_id", "binding_id", "verdict")


def cascade_deleted(spark: SparkSession, d: str) -> DataFrame:
    """The tombstones of deleted versions in chunks, bindings, edges and blocks."""
    b = views.bindings(spark, d)
    gone = views.versions(spark, d).where("lifecycle_status = 'DELETED'")
    tables = {"generated_chunks": (views.chunks(spark, d), "chunk_id"), "vector_bindings": (b, "binding_id"), "graph_edges": (views.edges(spark, d), "edge_id"), "text_segments": (views.segments(spark, d), "block_id")}
    return lifecycle.cascade(gone, _DOC, tables, b.where("legal_hold"))


def activation_ready(spark: SparkSession, d: str) -> DataFrame:
    """Whether each version may be activated."""
    b, e = views.bindings(spark, d), _events(spark, d).select("access_zone_id", "binding_id").distinct()
    parts = {
        "chunks": views.chunks(spark, d).where("granularity != 'SOURCE'"),
        "bindings": b,
        "synced": b.where("qdrant_sync_status = 'SYNCED'"),
        "evented": b.join(e, ["access_zone_id", "binding_id"], "left_semi"),
    }
    rules = [("NO_CHUNKS", F.expr("n_chunks = 0")), ("MISSING_BINDINGS", F.expr("n_bindings < n_chunks")), ("MISSING_EVENTS", F.expr("n_evented < n_bindings")), ("NOT_SYNCED", F.expr("n_synced < n_bindings"))]
    return lifecycle.activation(views.versions(spark, d), parts, _DOC, rules)


def zones_resolved(spark: SparkSession, d: str) -> DataFrame:
    """A request for each document version: its zone by code, named twice, with zone 0500 and by id."""
    v = views.versions(spark, d)
    registry = v.where("access_zone_code IS NOT NULL").select(F.col("access_zone_id").alias("zone_id"), F.col("access_zone_code").alias("zone_code")).distinct()
    r = v.select(F.concat_ws("/", *_DOC).alias("request_id"), F.array_compact(F.array("access_zone_code", F.when(F.col("document_version") > 1, F.lit("0500")), "access_zone_code")).alias("codes"), F.array("access_zone_id").alias("ids"))
    return lifecycle.resolve_zones(r, registry, "request_id", "codes", "ids").select("request_id", F.array_join("zones", "+").alias("zones"), "error")


def graph_replaced(spark: SparkSession, d: str) -> DataFrame:
    """The graphs of the active documents replaced by the edges that are active and not in quarantine."""
    e = views.edges(spark, d).select(*_DOC, "edge_id", "relation_type", "lifecycle_status", "quarantined")
    v = views.versions(spark, d).where("lifecycle_status = 'ACTIVE'").select(*_DOC)
    fresh = e.where("lifecycle_status = 'ACTIVE' AND NOT coalesce(quarantined, false)").join(v, _DOC, "left_semi")
    return lifecycle.replace_edges(e, fresh, _DOC).select(*_DOC, "edge_id", "relation_type")


QUERIES = {f.__name__: f for f in (purge_bindings, deletable_points, delete_fence, cascade_deleted, activation_ready, zones_resolved, graph_replaced)}

_EVENTS = "events_ AS (SELECT lower(id) AS id, lower(access_zone_id) AS access_zone_id, lower(binding_id) AS binding_id, upper(trim(operation)) AS operation, operation_version, status FROM outbox_events WHERE binding_id IS NOT NULL AND operation_version IS NOT NULL)"
_SAME_DOC = "{a}.access_zone_id = {b}.access_zone_id AND {a}.document_id = {b}.document_id AND {a}.document_version = {b}.document_version"
_HELD = "EXISTS (SELECT 1 FROM bindings h WHERE h.legal_hold AND " + _SAME_DOC.format(a="h", b="g") + ")"
_TOMB = "SELECT DISTINCT '{t}' AS table_name, x.access_zone_id, x.document_id, x.document_version, x.{i} AS row_id FROM {v} x JOIN g ON " + _SAME_DOC.format(a="x", b="g")
_IN = lambda values: ", ".join(repr(v) for v in values)

SQL = {
    "purge_bindings": views.with_tables("bindings")
    + f""", {_EVENTS} SELECT b.access_zone_id, b.binding_id, array_to_string(list_filter([
  CASE WHEN EXISTS (SELECT 1 FROM bindings h WHERE h.legal_hold AND {_SAME_DOC.format(a="h", b="b")}) THEN 'legal_hold' END,
  CASE WHEN EXISTS (SELECT 1 FROM events_ e WHERE e.access_zone_id = b.access_zone_id AND e.binding_id = b.binding_id AND e.status IN ('PENDING', 'PROCESSING', 'RETRY_PENDING')) THEN 'pending_event' END,
  CASE WHEN EXISTS (SELECT 1 FROM bindings l WHERE l.access_zone_id = b.access_zone_id AND l.chunk_id = b.chunk_id AND l.lifecycle_status = 'ACTIVE') THEN 'live_reference' END], lambda x: x IS NOT NULL), '+') AS held_by
FROM bindings b WHERE b.lifecycle_status = 'DELETED' AND b.updated_at <= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAYS""",
    "deletable_points": views.with_tables("bindings", "points")
    + f""" SELECT * FROM (SELECT p.access_zone_id, p.qdrant_point_id, CASE WHEN coalesce(b.legal_hold, false) THEN 'SKIPPED_LEGAL_HOLD' WHEN b.binding_id IS NULL THEN 'ORPHAN' WHEN b.lifecycle_status IN ({_IN(_GONE)}) THEN 'DELETABLE' END AS verdict
FROM points p LEFT JOIN bindings b ON b.access_zone_id = p.access_zone_id AND b.qdrant_point_id = p.qdrant_point_id) WHERE verdict IS NOT NULL""",
    "delete_fence": views.with_tables("bindings")
    + f""", {_EVENTS} SELECT e.id, e.access_zone_id, e.binding_id, CASE WHEN b.binding_id IS NULL THEN 'ORPHAN' WHEN coalesce(b.legal_hold, false) THEN 'HELD' WHEN coalesce(b.payload_version, 0) > e.operation_version THEN 'STALE' ELSE 'APPLY' END AS verdict
FROM (SELECT DISTINCT id, access_zone_id, binding_id, operation_version FROM events_ WHERE operation = 'DELETE_POINT') e LEFT JOIN bindings b ON b.access_zone_id = e.access_zone_id AND b.binding_id = e.binding_id""",
    "cascade_deleted": views.with_tables("versions", "bindings", "chunks", "edges", "segments")
    + f", g AS (SELECT * FROM versions g WHERE lifecycle_status = 'DELETED' AND NOT {_HELD}) "
    + " UNION ALL ".join(_TOMB.format(t=t, i=i, v=v) for t, i, v in (("generated_chunks", "chunk_id", "chunks"), ("vector_bindings", "binding_id", "bindings"), ("graph_edges", "edge_id", "edges"), ("text_segments", "block_id", "segments"))),
    "activation_ready": views.with_tables("versions", "bindings", "chunks")
    + f""", {_EVENTS}, v AS (SELECT DISTINCT access_zone_id, document_id, document_version FROM versions),
c AS (SELECT access_zone_id, document_id, document_version, count(*) AS n FROM chunks WHERE granularity <> 'SOURCE' GROUP BY ALL),
b AS (SELECT access_zone_id, document_id, document_version, count(*) AS n, count(*) FILTER (WHERE qdrant_sync_status = 'SYNCED') AS s, count(*) FILTER (WHERE (access_zone_id, binding_id) IN (SELECT (access_zone_id, binding_id) FROM events_)) AS e FROM bindings GROUP BY ALL),
k AS (SELECT v.*, coalesce(c.n, 0) AS n_chunks, coalesce(b.n, 0) AS n_bindings, coalesce(b.s, 0) AS n_synced, coalesce(b.e, 0) AS n_evented FROM v LEFT JOIN c ON {_SAME_DOC.format(a="c", b="v")} LEFT JOIN b ON {_SAME_DOC.format(a="b", b="v")})
SELECT *, CASE WHEN n_chunks = 0 THEN 'NO_CHUNKS' WHEN n_bindings < n_chunks THEN 'MISSING_BINDINGS' WHEN n_evented < n_bindings THEN 'MISSING_EVENTS' WHEN n_synced < n_bindings THEN 'NOT_SYNCED' ELSE 'READY' END AS state FROM k""",
    "zones_resolved": views.with_tables("versions")
    + """, reg AS (SELECT DISTINCT access_zone_id AS zone_id, access_zone_code AS zone_code FROM versions WHERE access_zone_code IS NOT NULL),
r AS (SELECT concat_ws('/', access_zone_id, document_id, document_version) AS request_id, access_zone_id AS id, access_zone_code AS c1, CASE WHEN document_version > 1 THEN '0500' END AS c2 FROM versions),
a AS (SELECT request_id, 0 AS kind, 1 AS pos, c1 AS name FROM r WHERE c1 IS NOT NULL UNION ALL SELECT request_id, 0, 2, c2 FROM r WHERE c2 IS NOT NULL UNION ALL SELECT request_id, 1, 1, id FROM r),
u AS (SELECT request_id, kind, name, min(pos) AS pos FROM a GROUP BY ALL),
f AS (SELECT u.*, reg.zone_id FROM u LEFT JOIN reg ON CASE WHEN kind = 0 THEN reg.zone_code = u.name ELSE reg.zone_id = u.name END),
z AS (SELECT request_id, zone_id, min(kind * 1000 + pos) AS place FROM f WHERE zone_id IS NOT NULL GROUP BY ALL),
s AS (SELECT request_id, string_agg(zone_id, '+' ORDER BY place, zone_id) AS zones FROM z GROUP BY ALL),
e AS (SELECT request_id, bool_or(zone_id IS NULL) AS unknown, list_sort(list_distinct(list(zone_id) FILTER (WHERE kind = 0))) AS a, list_sort(list_distinct(list(zone_id) FILTER (WHERE kind = 1))) AS b FROM f GROUP BY ALL)
SELECT request_id, CASE WHEN error IS NULL THEN zones ELSE '' END AS zones, error FROM (
  SELECT e.request_id, s.zones, CASE WHEN unknown THEN 'UNKNOWN' WHEN len(a) > 0 AND len(b) > 0 AND a <> b THEN 'MISMATCH' END AS error FROM e LEFT JOIN s USING (request_id))""",
    "graph_replaced": views.with_tables("edges", "versions")
    + f""", v AS (SELECT * FROM versions WHERE lifecycle_status = 'ACTIVE'),
n AS (SELECT e.* FROM edges e WHERE e.lifecycle_status = 'ACTIVE' AND NOT coalesce(e.quarantined, false) AND EXISTS (SELECT 1 FROM v WHERE {_SAME_DOC.format(a="v", b="e")}))
SELECT access_zone_id, document_id, document_version, edge_id, relation_type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM n WHERE {_SAME_DOC.format(a="n", b="e")}) UNION ALL SELECT access_zone_id, document_id, document_version, edge_id, relation_type FROM n""",
}
