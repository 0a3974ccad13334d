"""Queries of audits, upserts and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import audits, chunking, upserts
from millrace.plans.serving_queries import AS_OF
from millrace.sources import views
from millrace.sources.tables import table

_DOC = ["access_zone_id", "document_id", "document_version"]
_POINT = ["access_zone_id", "qdrant_point_id"]
#: (target, min, max) words, as in the first profile of size_profiles.
PROFILE = {"PARENT": (520, 350, 700), "SUB_180": (180, 130, 220), "SUB_260": (260, 200, 320)}


def audit_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Offending rows of each check."""
    c, b, v, s, e = (f(spark, d) for f in (views.chunks, views.bindings, views.versions, views.segments, views.edges))
    p = c.select("access_zone_id", F.col("chunk_id").alias("parent_id"), F.col("document_id").alias("p_document"), F.col("document_version").alias("p_version"))
    kids = c.where("parent_id IS NOT NULL")
    return audits.count_audit(
        {
            "chunk_without_version": audits.orphans(c, v, _DOC),
            "binding_without_chunk": audits.orphans(b, c, ["access_zone_id", "chunk_id"]),
            "block_without_version": audits.orphans(s, v, _DOC),
            "child_without_parent": audits.orphans(kids, p, ["access_zone_id", "parent_id"]),
            "child_of_other_document": kids.join(p, ["access_zone_id", "parent_id"]).where("NOT (document_id <=> p_document AND document_version <=> p_version)"),
            "edge_without_version": audits.orphans(e, v, _DOC),
            "event_without_binding": audits.orphans(table(spark, d, "outbox_events").where("binding_id IS NOT NULL").select(F.lower("access_zone_id").alias("access_zone_id"), F.lower("binding_id").alias("binding_id")).distinct(), b, ["access_zone_id", "binding_id"]),
            "point_of_two_bindings": audits.duplicates(b.where("qdrant_point_id IS NOT NULL"), _POINT),
        }
    )


def audit_incomplete(spark: SparkSession, d: str) -> DataFrame:
    """Active versions without chunks, bindings or blocks."""
    v = views.versions(spark, d).where("lifecycle_status = 'ACTIVE'")
    return audits.incomplete(v, {"chunks": views.chunks(spark, d).where("granularity != 'SOURCE'"), "bindings": views.bindings(spark, d), "segments": views.segments(spark, d)}, _DOC).select(*_DOC, F.array_join("lacks", ",").alias("lacks"))


def audit_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A05."""
    return audits.fingerprint({"versions": (views.versions(spark, d), "status"), "chunks": (views.chunks(spark, d), "granularity"), "edges": (views.edges(spark, d), "relation_type")})


def audit_sets(spark: SparkSession, d: str) -> DataFrame:
    """Payload versions of bindings against points."""
    b = views.bindings(spark, d).where("qdrant_point_id IS NOT NULL").select(F.concat_ws("/", *_POINT).alias("k"), "payload_version")
    return audits.compare_sets(b, views.points(spark, d).select(F.concat_ws("/", *_POINT).alias("k"), "payload_version"), "k", "payload_version")


def audit_zones(spark: SparkSession, d: str) -> DataFrame:
    """All zones that any table names, with a running code."""
    from pyspark.sql.window import Window

    z = None
    for t in ("document_versions", "generated_chunks", "vector_bindings", "graph_edges"):
        one = table(spark, d, t).select(F.lower("access_zone_id").alias("access_zone_id")).distinct()
        z = one if z is None else z.union(one)
    # zones are few: one per tenant, whatever the size of the tables
    return z.distinct().withColumn("code", F.lpad(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("access_zone_id")).cast("string"), 4, "0"))


def audit_expired(spark: SparkSession, d: str) -> DataFrame:
    """A01, A02."""
    return audits.expired_age(views.bindings(spark, d), "expires_at", AS_OF)


def audit_windows(spark: SparkSession, d: str) -> DataFrame:
    """Staged bytes per document."""
    return views.segments(spark, d).groupBy(*_DOC).agg(F.count("*").alias("n_blocks"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n_bytes"))


def upsert_points(spark: SparkSession, d: str) -> DataFrame:
    """The bindings' payload versions put into the index; status stays where the point is known."""
    b = views.bindings(spark, d).where("qdrant_point_id IS NOT NULL").select(*_POINT, "payload_version", "lifecycle_status")
    return upserts.upsert(views.points(spark, d).select(*_POINT, "payload_version", "lifecycle_status"), b, _POINT, ["payload_version"])


def upsert_versions(spark: SparkSession, d: str) -> DataFrame:
    """Payload versions raised where level or status changed."""
    b = views.bindings(spark, d).where("qdrant_point_id IS NOT NULL").select(*_POINT, "access_level", "lifecycle_status")
    return upserts.bump_versions(views.points(spark, d), b, _POINT, ["access_level", "lifecycle_status"], "payload_version")


def upsert_fence(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on each distinct event."""
    e = table(spark, d, "outbox_events").where("binding_id IS NOT NULL AND operation_version IS NOT NULL").select(F.lower("access_zone_id").alias("access_zone_id"), F.lower("binding_id").alias("binding_id"), F.col("operation_version").alias("payload_version")).distinct()
    return upserts.fenced(e, views.bindings(spark, d), ["access_zone_id", "binding_id"], "payload_version", F.col("lifecycle_status") == "ACTIVE")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """The version of each document that stays active."""
    return upserts.latest_only(views.versions(spark, d), ["access_zone_id", "document_id"], "document_version", F.col("status") == "ACTIVE")


def upsert_register(spark: SparkSession, d: str) -> DataFrame:
    """Second versions registered over the first ones' keys."""
    v = views.versions(spark, d)
    return upserts.register(v.where("document_version = 1"), v.withColumn("document_version", F.lit(1).cast("bigint")), _DOC, "content_hash")


def upsert_repairs(spark: SparkSession, d: str) -> DataFrame:
    """What brings the index back in line."""
    b = views.bindings(spark, d).where("qdrant_point_id IS NOT NULL")
    return upserts.repair_actions(b, views.points(spark, d), _POINT, F.col("legal_hold"), F.col("lifecycle_status") == "ACTIVE")


def chunk_trace(spark: SparkSession, d: str) -> DataFrame:
    """A25-A27."""
    return chunking.document_trace(views.segments(spark, d))


def chunk_all(spark: SparkSession, d: str) -> DataFrame:
    """All segments chunked at three sizes."""
    return chunking.chunk_segments(views.segments(spark, d), PROFILE, "mg-v1")


QUERIES = {f.__name__: f for f in (audit_integrity, audit_incomplete, audit_fingerprint, audit_sets, audit_zones, audit_expired, audit_windows, upsert_points, upsert_versions, upsert_fence, upsert_latest, upsert_register, upsert_repairs, chunk_trace, chunk_all)}

_JP = "FULL JOIN {b} ON b.access_zone_id = p.access_zone_id AND b.qdrant_point_id = p.qdrant_point_id"
_B = "(SELECT * FROM bindings WHERE qdrant_point_id IS NOT NULL) b"
_ANTI = lambda child, parent, on: f"(SELECT count(*) FROM {child} c WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE " + " AND ".join(f"p.{x} = c.{y}" for x, y in on) + "))"
_ODOC = [(c, c) for c in _DOC]
_SPEC = "CASE block_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in chunking.SPECIFICITY.items()) + " ELSE 0 END"

SQL = {
    "audit_integrity": views.with_tables("chunks", "bindings", "versions", "segments", "edges")
    + f""", ev AS (SELECT DISTINCT lower(access_zone_id) AS access_zone_id, lower(binding_id) AS binding_id FROM outbox_events WHERE binding_id IS NOT NULL), kid AS (SELECT * FROM chunks WHERE parent_id IS NOT NULL)
SELECT * FROM (VALUES ('chunk_without_version', {_ANTI("chunks", "versions", _ODOC)}), ('binding_without_chunk', {_ANTI("bindings", "chunks", [("access_zone_id", "access_zone_id"), ("chunk_id", "chunk_id")])}),
 ('block_without_version', {_ANTI("segments", "versions", _ODOC)}), ('child_without_parent', {_ANTI("kid", "chunks", [("access_zone_id", "access_zone_id"), ("chunk_id", "parent_id")])}),
 ('child_of_other_document', (SELECT count(*) FROM kid c JOIN chunks p ON p.access_zone_id = c.access_zone_id AND p.chunk_id = c.parent_id WHERE p.document_id IS DISTINCT FROM c.document_id OR p.document_version IS DISTINCT FROM c.document_version)),
 ('edge_without_version', {_ANTI("edges", "versions", _ODOC)}), ('event_without_binding', {_ANTI("ev", "bindings", [("access_zone_id", "access_zone_id"), ("binding_id", "binding_id")])}),
 ('point_of_two_bindings', (SELECT count(*) FROM (SELECT 1 FROM bindings WHERE qdrant_point_id IS NOT NULL GROUP BY access_zone_id, qdrant_point_id HAVING count(*) > 1)))) t("check", n)""",
    "audit_incomplete": views.with_tables("chunks", "bindings", "versions", "segments")
    + """, k AS (SELECT DISTINCT access_zone_id, document_id, document_version FROM versions WHERE lifecycle_status = 'ACTIVE'),
c AS (SELECT DISTINCT access_zone_id, document_id, document_version, 1 AS c FROM chunks WHERE granularity <> 'SOURCE'), b AS (SELECT DISTINCT access_zone_id, document_id, document_version, 1 AS b FROM bindings), s AS (SELECT DISTINCT access_zone_id, document_id, document_version, 1 AS s FROM segments)
SELECT access_zone_id, document_id, document_version, concat_ws(',', CASE WHEN c IS NULL THEN 'chunks' END, CASE WHEN b IS NULL THEN 'bindings' END, CASE WHEN s IS NULL THEN 'segments' END) AS lacks
FROM k LEFT JOIN c USING (access_zone_id, document_id, document_version) LEFT JOIN b USING (access_zone_id, document_id, document_version) LEFT JOIN s USING (access_zone_id, document_id, document_version) WHERE c IS NULL OR b IS NULL OR s IS NULL""",
    "audit_fingerprint": views.with_tables("versions", "chunks", "edges")
    + """, l AS (SELECT 'versions|' || coalesce(status, '') || '|' || count(*) AS line FROM versions GROUP BY status UNION ALL SELECT 'chunks|' || coalesce(granularity, '') || '|' || count(*) FROM chunks GROUP BY granularity UNION ALL SELECT 'edges|' || coalesce(relation_type, '') || '|' || count(*) FROM edges GROUP BY relation_type)
SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM l""",
    "audit_sets": views.with_tables("bindings", "points")
    + f" SELECT coalesce(b.access_zone_id || '/' || b.qdrant_point_id, p.access_zone_id || '/' || p.qdrant_point_id) AS k, CASE WHEN b.qdrant_point_id IS NULL THEN 'UNKNOWN' WHEN p.qdrant_point_id IS NULL THEN 'PENDING' WHEN b.payload_version IS DISTINCT FROM p.payload_version THEN 'MISMATCH' ELSE 'MATCH' END AS state FROM points p {_JP.format(b=_B)}",
    "audit_zones": "SELECT z AS access_zone_id, lpad(CAST(row_number() OVER (ORDER BY z) AS VARCHAR), 4, '0') AS code FROM (SELECT lower(access_zone_id) AS z FROM document_versions UNION SELECT lower(access_zone_id) FROM generated_chunks UNION SELECT lower(access_zone_id) FROM vector_bindings UNION SELECT lower(access_zone_id) FROM graph_edges)",
    "audit_expired": views.with_tables("bindings") + f" SELECT count(*) AS n_expired, CAST(epoch(TIMESTAMPTZ '{AS_OF}+00') - floor(epoch(min(expires_at))) AS BIGINT) AS oldest_s FROM bindings WHERE expires_at <= TIMESTAMPTZ '{AS_OF}+00'",
    "audit_windows": views.with_tables("segments") + " SELECT access_zone_id, document_id, document_version, count(*) AS n_blocks, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS n_bytes FROM segments GROUP BY ALL",
    "upsert_points": views.with_tables("bindings", "points")
    + f" SELECT coalesce(p.access_zone_id, b.access_zone_id) AS access_zone_id, coalesce(p.qdrant_point_id, b.qdrant_point_id) AS qdrant_point_id, CASE WHEN b.qdrant_point_id IS NULL THEN p.payload_version ELSE b.payload_version END AS payload_version, CASE WHEN p.qdrant_point_id IS NULL THEN b.lifecycle_status ELSE p.lifecycle_status END AS lifecycle_status FROM points p {_JP.format(b=_B)}",
    "upsert_versions": views.with_tables("bindings", "points")
    + f""" SELECT coalesce(p.access_zone_id, b.access_zone_id) AS access_zone_id, coalesce(p.qdrant_point_id, b.qdrant_point_id) AS qdrant_point_id, CASE WHEN b.qdrant_point_id IS NULL THEN p.access_level ELSE b.access_level END AS access_level, CASE WHEN b.qdrant_point_id IS NULL THEN p.lifecycle_status ELSE b.lifecycle_status END AS lifecycle_status,
 CASE WHEN p.qdrant_point_id IS NULL THEN 1 WHEN b.qdrant_point_id IS NOT NULL AND (b.access_level IS DISTINCT FROM p.access_level OR b.lifecycle_status IS DISTINCT FROM p.lifecycle_status) THEN p.payload_version + 1 ELSE p.payload_version END AS payload_version,
 CASE WHEN p.qdrant_point_id IS NULL THEN 'INSERTED' WHEN b.qdrant_point_id IS NOT NULL AND (b.access_level IS DISTINCT FROM p.access_level OR b.lifecycle_status IS DISTINCT FROM p.lifecycle_status) THEN 'UPDATED' ELSE 'UNCHANGED' END AS effect FROM points p {_JP.format(b=_B)}""",
    "upsert_fence": views.with_tables("bindings")
    + " SELECT e.z AS access_zone_id, e.b AS binding_id, e.v AS payload_version, CASE WHEN b.binding_id IS NULL THEN 'ORPHAN' WHEN b.lifecycle_status = 'ACTIVE' AND b.payload_version = e.v THEN 'APPLY' ELSE 'STALE' END AS verdict FROM (SELECT DISTINCT lower(access_zone_id) AS z, lower(binding_id) AS b, operation_version AS v FROM outbox_events WHERE binding_id IS NOT NULL AND operation_version IS NOT NULL) e LEFT JOIN bindings b ON b.access_zone_id = e.z AND b.binding_id = e.b",
    "upsert_latest": views.with_tables("versions") + " SELECT access_zone_id, document_id, max(document_version) AS document_version FROM versions WHERE status = 'ACTIVE' GROUP BY ALL",
    "upsert_register": views.with_tables("versions")
    + ", i AS (SELECT DISTINCT access_zone_id, document_id, CAST(1 AS BIGINT) AS document_version, content_hash FROM versions) SELECT i.access_zone_id, i.document_id, i.document_version, CASE WHEN v.document_id IS NULL THEN 'INSERTED' WHEN v.content_hash IS NOT DISTINCT FROM i.content_hash THEN 'REPLAY' ELSE 'CONFLICT' END AS effect FROM i LEFT JOIN versions v ON v.access_zone_id = i.access_zone_id AND v.document_id = i.document_id AND v.document_version = 1",
    "upsert_repairs": views.with_tables("bindings", "points")
    + f""" SELECT * FROM (SELECT coalesce(p.access_zone_id, b.access_zone_id) AS access_zone_id, coalesce(p.qdrant_point_id, b.qdrant_point_id) AS qdrant_point_id,
 CASE WHEN coalesce(b.lifecycle_status = 'ACTIVE', false) AND p.qdrant_point_id IS NULL THEN 'UPSERT' WHEN p.qdrant_point_id IS NOT NULL AND NOT coalesce(b.lifecycle_status = 'ACTIVE', false) AND coalesce(b.legal_hold, false) THEN 'HOLD' WHEN p.qdrant_point_id IS NOT NULL AND NOT coalesce(b.lifecycle_status = 'ACTIVE', false) THEN 'DELETE' END AS action FROM points p {_JP.format(b=_B)}) WHERE action IS NOT NULL""",
    "chunk_trace": views.with_tables("segments")
    + f", t AS (SELECT *, row_number() OVER (PARTITION BY access_zone_id, document_id, document_version ORDER BY {_SPEC} * 1000000 + octet_length(encode(coalesce(text, ''))) DESC, block_id DESC) AS r FROM segments) SELECT access_zone_id, document_id, document_version, max(block_id) FILTER (WHERE r = 1) AS primary_block_id, count(*) AS n_blocks, CASE WHEN count(*) = 1 THEN 'EXACT' ELSE 'MERGED' END AS trace_quality, string_agg(DISTINCT block_type, ',' ORDER BY block_type) AS block_types FROM t GROUP BY ALL",
}
