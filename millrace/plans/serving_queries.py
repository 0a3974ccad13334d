"""Queries of point reads, visibility, hydration and the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph, ranking, serving
from millrace.sources import views
from millrace.sources.tables import table

AS_OF = "2026-01-01 00:00:00"
AS_OF_EPOCH = 1767225600
_Z = ["access_zone_id", "chunk_id"]


def scan_points(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that related_chunks points to."""
    keys = table(spark, d, "related_chunks").select(F.lower("access_zone_id").alias("access_zone_id"), F.lower("chunk_id").alias("chunk_id"))
    return serving.by_keys(views.chunks(spark, d), keys, _Z).select(*_Z, "document_id", "granularity", F.sha2("content", 256).alias("content_hash"))


def scan_group(spark: SparkSession, d: str) -> DataFrame:
    """The chunk groups of all documents."""
    c = views.chunks(spark, d)
    return serving.chunk_group(c, c.select("access_zone_id", "root_id").distinct()).select("access_zone_id", "root_id", "chunk_id", "place")


def scan_parents(spark: SparkSession, d: str) -> DataFrame:
    """The parent text of every child chunk."""
    c = views.chunks(spark, d)
    return serving.parent_context(c.where("granularity IN ('SUB_180', 'SUB_260')").select(*_Z), c).select(*_Z, "parent_chunk_id", F.sha2("parent_text", 256).alias("parent_hash"))


def scan_latest_points(spark: SparkSession, d: str) -> DataFrame:
    """The index entry of each chunk's newest synchronised binding."""
    p = views.points(spark, d).select("access_zone_id", "qdrant_point_id", F.col("payload_version").alias("vector"))
    return serving.latest_embedding(views.bindings(spark, d), p)


def scan_counts(spark: SparkSession, d: str) -> DataFrame:
    """Points and synchronised bindings by document."""
    b = views.bindings(spark, d)
    p = views.points(spark, d).select("access_zone_id", "qdrant_point_id", F.lit(1).alias("there"))
    j = b.join(p, ["access_zone_id", "qdrant_point_id"], "left")
    s = F.col("qdrant_sync_status")
    g = j.groupBy("access_zone_id", "document_id", "document_version").agg(F.count("*").alias("expected"), F.count_if(s == "SYNCED").alias("synced"), F.count_if(s.isin("PENDING", "UPDATE_PENDING", "DELETE_PENDING")).alias("pending"), F.count_if(s == "FAILED").alias("failed"), F.count_if(F.col("there").isNull()).alias("missing_points"))
    return g.withColumn("ready", (F.col("synced") == F.col("expected")) & (F.col("missing_points") == 0))


def scan_payloads(spark: SparkSession, d: str) -> DataFrame:
    """the payload of every current binding."""
    return serving.index_payload(views.bindings(spark, d)).drop("metadata")


def visible_index(spark: SparkSession, d: str) -> DataFrame:
    """F01-F03, F06 over the index."""
    return serving.index_filter(views.points(spark, d), 2, AS_OF_EPOCH, equal={"qdrant_sync_status": "SYNCED", "binding_id": ""}).select("access_zone_id", "qdrant_point_id", "chunk_id")


def visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible chunks."""
    return serving.visible_chunks(views.chunks(spark, d), views.bindings(spark, d), views.versions(spark, d), 2, AS_OF).select(*_Z, "document_id", "document_version")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Every state a binding ever had is a candidate; its document stands for the query."""
    t = table(spark, d, "vector_bindings")
    low = lambda c: F.lower(c)
    return t.select(low("document_id").alias("query_id"), low("access_zone_id").alias("access_zone_id"), low("id").alias("binding_id"), low("chunk_id").alias("chunk_id"), F.coalesce(low("parent_chunk_id"), low("chunk_id")).alias("parent_chunk_id"), F.col("chunk_granularity").alias("granularity")).distinct()


def _hydrated(spark: SparkSession, d: str) -> DataFrame:
    return serving.hydrate(_candidates(spark, d), views.bindings(spark, d), views.chunks(spark, d), views.versions(spark, d), 3, AS_OF)


def hydrated(spark: SparkSession, d: str) -> DataFrame:
    """One outcome for each candidate."""
    return _hydrated(spark, d).select("query_id", "access_zone_id", "binding_id", "chunk_id", "parent_chunk_id", "outcome")


def hydrated_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return serving.hydration_coverage(_hydrated(spark, d))


def rechecked(spark: SparkSession, d: str) -> DataFrame:
    """F05."""
    c = _candidates(spark, d).drop("granularity")
    return serving.recheck(c, views.bindings(spark, d), views.chunks(spark, d), views.versions(spark, d), 3, AS_OF)


_RELATIONS = [*graph.DOMAIN, *graph.SIMILARITY, "CHUNK_HAS_PARENT", "CHUNK_NEXT_SIBLING", "LEADS_TO"]


def graph_one_hop(spark: SparkSession, d: str) -> DataFrame:
    """Every seed is a query of its own, its forty best edges, scored."""
    r = table(spark, d, "related_chunks").select(F.lower("seed_access_zone_id").alias("access_zone_id"), F.lower("seed_chunk_id").alias("chunk_id")).distinct()
    return _one_hop(spark, d, r.select(F.concat_ws("/", "access_zone_id", "chunk_id").alias("query_id"), "*", F.lit(1).alias("seed_rank")))


def _one_hop(spark: SparkSession, d: str, seeds: DataFrame) -> DataFrame:
    x = graph.one_hop(seeds, views.edges(spark, d), _RELATIONS, 40)
    s = graph.candidate_score(F.lit(0.8), F.col("relation_type"), F.col("relation_score").cast("double"), F.lit(1))
    return x.select("query_id", "seed_chunk_id", "chunk_id", "edge_id", "relation_type", F.round(s, 6).alias("score"), F.round(graph.legacy_score(F.lit(0.8), F.col("relation_type"), F.col("relation_score").cast("double")), 6).alias("legacy_score"))


def graph_structure(spark: SparkSession, d: str) -> DataFrame:
    """G01, G02, G04, W04."""
    return graph.structural_edges(views.versions(spark, d), views.segments(spark, d), views.chunks(spark, d))


def graph_tables(spark: SparkSession, d: str) -> DataFrame:
    """The smaller chunks cut from one table, in order of their number, which stands for that of the row."""
    t = views.segments(spark, d).where("block_type = 'TABLE'").select("access_zone_id", F.col("block_id").alias("source_block_id"))
    c = views.chunks(spark, d).where("granularity IN ('SUB_180', 'SUB_260')").join(t, ["access_zone_id", "source_block_id"], "left_semi")
    return graph.table_neighbours(c, ["access_zone_id", "source_block_id", "granularity"], "sequence_no", "chunk_id")


def graph_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks that become graph nodes, within the limits of the service."""
    s = views.segments(spark, d)
    return graph.select_blocks(s, graph.block_depths(s), views.chunks(spark, d))


def graph_fan_out(spark: SparkSession, d: str) -> DataFrame:
    """Containment of blocks as edges between their chunks."""
    s = views.segments(spark, d).where("parent_block_id IS NOT NULL")
    r = s.select(F.concat_ws("/", "access_zone_id", "block_id").alias("relation_id"), "access_zone_id", F.col("parent_block_id").alias("source_block"), F.col("block_id").alias("target_block"), F.lit("RELATED_TO").alias("relation_type"))
    b = views.chunks(spark, d).where("granularity != 'SOURCE'").select("access_zone_id", F.explode("source_block_ids").alias("block_id"), "chunk_id").withColumn("block_id", F.lower("block_id")).distinct()
    return graph.relation_fan_out(r, b).select("relation_id", "source_chunk", "target_chunk")


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    """A03, A04, R06."""
    e = views.edges(spark, d)
    return graph.edge_summary(e).withColumn("class", graph.relation_class(F.col("relation_type")))


QUERIES = {f.__name__: f for f in (scan_points, scan_group, scan_parents, scan_latest_points, scan_counts, scan_payloads, visible_index, visible_text, hydrated, hydrated_coverage, rechecked, graph_one_hop, graph_structure, graph_tables, graph_blocks, graph_fan_out, graph_summary)}

_T = f"TIMESTAMPTZ '{AS_OF}+00'"
_LIVE_VERSION = "SELECT access_zone_id, document_id, document_version FROM versions WHERE status = 'ACTIVE' AND lifecycle_status = 'ACTIVE'"
_CAND = """k AS (SELECT DISTINCT lower(document_id) AS query_id, lower(access_zone_id) AS access_zone_id, lower(id) AS binding_id, lower(chunk_id) AS chunk_id, coalesce(lower(parent_chunk_id), lower(chunk_id)) AS parent_chunk_id, chunk_granularity AS granularity FROM vector_bindings)"""
_OUTCOME = (
    views.with_tables("bindings", "chunks", "versions")
    + f""", {_CAND}, o AS (
SELECT k.*, CASE
  WHEN b.binding_id IS NULL OR m.chunk_id IS NULL OR b.chunk_id <> k.chunk_id OR b.chunk_granularity <> k.granularity OR b.document_id <> m.document_id OR b.document_version <> m.document_version
    OR (k.granularity IN ('SUB_180', 'SUB_260') AND (b.parent_chunk_id IS DISTINCT FROM k.parent_chunk_id OR m.parent_id IS DISTINCT FROM k.parent_chunk_id))
    OR (k.granularity = 'PARENT' AND (b.parent_chunk_id IS NOT NULL OR m.parent_id IS NOT NULL OR k.chunk_id <> k.parent_chunk_id)) OR k.granularity NOT IN ('PARENT', 'SUB_180', 'SUB_260') THEN 'BINDING_INVALID'
  WHEN p.chunk_id IS NULL OR d.document_id IS NULL THEN 'HYDRATION_MISSING'
  WHEN m.document_id <> p.document_id OR m.document_version <> p.document_version OR m.root_id <> p.root_id THEN 'BINDING_INVALID'
  WHEN b.lifecycle_status <> 'ACTIVE' OR b.qdrant_sync_status <> 'SYNCED' OR b.expires_at <= {_T} OR b.access_level > 3 OR b.representation_type <> 'ORIGINAL' OR m.lifecycle_status <> 'ACTIVE' OR p.lifecycle_status <> 'ACTIVE'
    OR p.granularity <> 'PARENT' OR d.status <> 'ACTIVE' OR d.lifecycle_status <> 'ACTIVE' THEN 'VISIBILITY_REJECTED'
  WHEN trim(coalesce(p.content, '')) = '' THEN 'EMPTY_CONTEXT' ELSE 'HYDRATED' END AS outcome
FROM k LEFT JOIN bindings b ON b.access_zone_id = k.access_zone_id AND b.binding_id = k.binding_id
LEFT JOIN chunks m ON m.access_zone_id = k.access_zone_id AND m.chunk_id = k.chunk_id
LEFT JOIN chunks p ON p.access_zone_id = k.access_zone_id AND p.chunk_id = k.parent_chunk_id
LEFT JOIN versions d ON d.access_zone_id = k.access_zone_id AND d.document_id = p.document_id AND d.document_version = p.document_version)"""
)
_DOMAIN = ", ".join(repr(r) for r in graph.DOMAIN)
_ORDER = f"CASE WHEN relation_source = 'QUALITY_FIXTURE' THEN 0 ELSE 1 END, CASE WHEN relation_type IN ({_DOMAIN}) THEN 0 WHEN relation_type = 'CHUNK_SEMANTIC_SIMILAR' THEN 2 ELSE 1 END, relation_score DESC NULLS FIRST, relation_rank ASC NULLS LAST, edge_id, related_id"
_CASE = lambda values, default: "CASE relation_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default} END"

SQL = {
    "scan_points": views.with_tables("chunks") + " SELECT access_zone_id, chunk_id, document_id, granularity, sha256(content) AS content_hash FROM chunks WHERE (access_zone_id, chunk_id) IN (SELECT (lower(access_zone_id), lower(chunk_id)) FROM related_chunks)",
    "scan_group": views.with_tables("chunks") + " SELECT access_zone_id, root_id, chunk_id, CAST(row_number() OVER (PARTITION BY access_zone_id, root_id ORDER BY granularity, sequence_no ASC NULLS LAST, chunk_id) AS INTEGER) AS place FROM chunks WHERE root_id IS NOT NULL AND access_zone_id IS NOT NULL",
    "scan_parents": views.with_tables("chunks") + " SELECT c.access_zone_id, c.chunk_id, p.chunk_id AS parent_chunk_id, sha256(p.content) AS parent_hash FROM chunks c JOIN chunks p ON p.access_zone_id = c.access_zone_id AND p.chunk_id = coalesce(c.parent_id, c.chunk_id) AND p.granularity = 'PARENT' WHERE c.granularity IN ('SUB_180', 'SUB_260')",
    "scan_latest_points": views.with_tables("bindings", "points")
    + ", n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY access_zone_id, chunk_id ORDER BY updated_at DESC, qdrant_point_id DESC) AS r FROM bindings WHERE qdrant_sync_status = 'SYNCED') WHERE r = 1) SELECT n.access_zone_id, n.qdrant_point_id, n.chunk_id, p.payload_version AS vector FROM n JOIN points p ON p.access_zone_id = n.access_zone_id AND p.qdrant_point_id = n.qdrant_point_id",
    "scan_counts": views.with_tables("bindings", "points")
    + """, g AS (SELECT b.access_zone_id, b.document_id, b.document_version, count(*) AS expected, count(*) FILTER (WHERE b.qdrant_sync_status = 'SYNCED') AS synced, count(*) FILTER (WHERE b.qdrant_sync_status IN ('PENDING', 'UPDATE_PENDING', 'DELETE_PENDING')) AS pending,
  count(*) FILTER (WHERE b.qdrant_sync_status = 'FAILED') AS failed, count(*) FILTER (WHERE p.qdrant_point_id IS NULL) AS missing_points FROM bindings b LEFT JOIN points p ON p.access_zone_id = b.access_zone_id AND p.qdrant_point_id = b.qdrant_point_id GROUP BY ALL)
SELECT *, synced = expected AND missing_points = 0 AS ready FROM g""",
    "scan_payloads": views.with_tables("bindings")
    + " SELECT access_zone_id, qdrant_point_id, binding_id, chunk_id, coalesce(parent_chunk_id, chunk_id) AS parent_chunk_id, document_id, document_version, chunk_granularity AS granularity, representation_type, access_level, lifecycle_status, qdrant_sync_status, coalesce(CAST(floor(epoch_us(expires_at) / 1000000) AS BIGINT), 253402300799) AS expires_at_epoch, payload_version, model_version FROM bindings",
    "visible_index": views.with_tables("points") + f" SELECT access_zone_id, qdrant_point_id, chunk_id FROM points WHERE access_level <= 2 AND lifecycle_status = 'ACTIVE' AND expires_at_epoch > {AS_OF_EPOCH} AND qdrant_sync_status = 'SYNCED'",
    "visible_text": views.with_tables("bindings", "chunks", "versions")
    + f" SELECT access_zone_id, chunk_id, document_id, document_version FROM chunks c WHERE lifecycle_status = 'ACTIVE' AND (access_zone_id, document_id, document_version) IN ({_LIVE_VERSION.replace('SELECT access_zone_id, document_id, document_version', 'SELECT (access_zone_id, document_id, document_version)')}) AND EXISTS (SELECT 1 FROM bindings b WHERE b.access_zone_id = c.access_zone_id AND b.chunk_id = c.chunk_id AND b.access_level <= 2 AND b.lifecycle_status = 'ACTIVE' AND (b.expires_at IS NULL OR b.expires_at > {_T}))",
    "hydrated": _OUTCOME + " SELECT query_id, access_zone_id, binding_id, chunk_id, parent_chunk_id, outcome FROM o",
    "hydrated_coverage": _OUTCOME
    + """, w AS (SELECT *, bool_or(outcome IN ('VISIBILITY_REJECTED', 'HYDRATION_MISSING', 'EMPTY_CONTEXT')) OVER (PARTITION BY query_id, access_zone_id, parent_chunk_id) AS bad FROM o),
g AS (SELECT query_id, count(*) FILTER (WHERE outcome = 'HYDRATED' AND NOT bad) AS survivors, count(*) FILTER (WHERE outcome <> 'HYDRATED') AS dropped, count(*) FILTER (WHERE outcome = 'HYDRATION_MISSING') AS broken FROM w GROUP BY ALL)
SELECT query_id, survivors, dropped, CASE WHEN dropped = 0 THEN 'FULL' WHEN survivors > 0 OR broken = 0 THEN 'PARTIAL' ELSE 'NONE_DUE_TO_INFRASTRUCTURE_FAILURE' END AS coverage FROM g""",
    "rechecked": views.with_tables("bindings", "chunks", "versions")
    + f""", {_CAND} SELECT k.query_id, k.access_zone_id, k.binding_id, k.chunk_id, k.parent_chunk_id FROM (SELECT DISTINCT query_id, access_zone_id, binding_id, chunk_id, parent_chunk_id FROM k) k
JOIN chunks m ON m.access_zone_id = k.access_zone_id AND m.chunk_id = k.chunk_id AND m.lifecycle_status = 'ACTIVE' AND coalesce(m.parent_id, m.chunk_id) = k.parent_chunk_id
JOIN chunks p ON p.access_zone_id = k.access_zone_id AND p.chunk_id = k.parent_chunk_id AND p.lifecycle_status = 'ACTIVE' AND p.granularity = 'PARENT' AND p.document_id = m.document_id AND p.document_version = m.document_version
JOIN versions d ON d.access_zone_id = m.access_zone_id AND d.document_id = m.document_id AND d.document_version = m.document_version AND d.status = 'ACTIVE' AND d.lifecycle_status = 'ACTIVE'
LEFT JOIN bindings b ON b.access_zone_id = k.access_zone_id AND b.binding_id = k.binding_id
WHERE k.binding_id IS NULL OR (b.chunk_id = m.chunk_id AND b.document_id = m.document_id AND b.document_version = m.document_version AND b.parent_chunk_id IS NOT DISTINCT FROM m.parent_id AND b.lifecycle_status = 'ACTIVE' AND b.qdrant_sync_status = 'SYNCED' AND (b.expires_at IS NULL OR b.expires_at > {_T}) AND b.access_level <= 3 AND b.representation_type = 'ORIGINAL')""",
    "graph_structure": views.with_tables("versions", "segments", "chunks")
    + """, kid AS (SELECT *, lead(chunk_id) OVER (PARTITION BY access_zone_id, parent_id ORDER BY sequence_no ASC NULLS LAST, chunk_id) AS next_id FROM chunks WHERE granularity IN ('SUB_180', 'SUB_260') AND parent_id IS NOT NULL),
e AS (
  SELECT access_zone_id, 'DOCUMENT' AS source_type, document_id AS source_id, 'LOGICAL_BLOCK' AS target_type, block_id AS target_id, 'DOCUMENT_CONTAINS_BLOCK' AS relation_type, CAST(NULL AS INTEGER) AS rank FROM segments
  UNION ALL SELECT access_zone_id, 'LOGICAL_BLOCK', parent_block_id, 'LOGICAL_BLOCK', block_id, 'BLOCK_CONTAINS_BLOCK', NULL FROM segments WHERE parent_block_id IS NOT NULL
  UNION ALL SELECT access_zone_id, 'LOGICAL_BLOCK', source_block_id, 'CHUNK', chunk_id, 'BLOCK_PRODUCED_CHUNK', NULL FROM chunks WHERE source_block_id IS NOT NULL AND granularity <> 'SOURCE'
  UNION ALL SELECT access_zone_id, 'CHUNK', chunk_id, 'CHUNK', parent_id, 'CHUNK_HAS_PARENT', NULL FROM chunks WHERE parent_id IS NOT NULL
  UNION ALL SELECT access_zone_id, 'CHUNK', chunk_id, 'CHUNK', next_id, 'CHUNK_NEXT_SIBLING', 1 FROM kid WHERE next_id IS NOT NULL
  UNION ALL SELECT access_zone_id, 'CHUNK', next_id, 'CHUNK', chunk_id, 'CHUNK_PREVIOUS_SIBLING', -1 FROM kid WHERE next_id IS NOT NULL),
n AS (SELECT access_zone_id, 'DOCUMENT' AS type, document_id AS id FROM versions UNION SELECT access_zone_id, 'LOGICAL_BLOCK', block_id FROM segments UNION SELECT access_zone_id, 'CHUNK', chunk_id FROM chunks)
SELECT e.* FROM e WHERE (source_id <> target_id OR source_type <> target_type) AND EXISTS (SELECT 1 FROM n WHERE n.access_zone_id = e.access_zone_id AND type = source_type AND id = source_id) AND EXISTS (SELECT 1 FROM n WHERE n.access_zone_id = e.access_zone_id AND type = target_type AND id = target_id)""",
    "graph_tables": views.with_tables("segments", "chunks")
    + """, t AS (SELECT c.* FROM chunks c WHERE granularity IN ('SUB_180', 'SUB_260') AND EXISTS (SELECT 1 FROM segments s WHERE s.block_type = 'TABLE' AND s.access_zone_id = c.access_zone_id AND s.block_id = c.source_block_id))
SELECT access_zone_id, source_block_id, granularity, chunk_id AS source_id, next_id AS target_id, 'CHUNK_SAME_TABLE' AS relation_type FROM (SELECT *, lead(chunk_id) OVER (PARTITION BY access_zone_id, source_block_id, granularity ORDER BY sequence_no ASC NULLS LAST, chunk_id) AS next_id FROM t) WHERE next_id IS NOT NULL""",
    "graph_blocks": views.with_tables("segments", "chunks").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, up AS (SELECT access_zone_id, block_id, block_id AS at, 0 AS depth FROM segments UNION ALL SELECT u.access_zone_id, u.block_id, s.parent_block_id, u.depth + 1 FROM up u JOIN segments s ON s.access_zone_id = u.access_zone_id AND s.block_id = u.at WHERE s.parent_block_id IS NOT NULL AND u.depth < 32),
d AS (SELECT access_zone_id, block_id, max(depth) AS depth FROM up GROUP BY ALL),
b AS (SELECT s.*, CASE block_type WHEN 'DOCUMENT' THEN 0 WHEN 'SECTION' THEN 10 WHEN 'SUBSECTION' THEN 20 WHEN 'TABLE' THEN 30 WHEN 'PARAGRAPH' THEN 40 WHEN 'TABLE_ROW' THEN 40 WHEN 'LIST_ITEM' THEN 40 WHEN 'FAQ_ITEM' THEN 40 ELSE 90 END + depth AS place,
  CASE WHEN EXISTS (SELECT 1 FROM chunks c WHERE c.access_zone_id = s.access_zone_id AND c.source_block_id = s.block_id) THEN 0 ELSE 1 END AS used FROM segments s JOIN d USING (access_zone_id, block_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY access_zone_id, document_id, document_version, parent_block_id ORDER BY place, used, order_index ASC NULLS LAST, block_id) AS nth FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY access_zone_id, document_id, document_version ORDER BY place, used, order_index ASC NULLS LAST, block_id) AS n FROM p WHERE nth <= 100 OR block_type IN ('DOCUMENT', 'SECTION', 'SUBSECTION'))
SELECT access_zone_id, document_id, document_version, block_id, CAST(place AS INTEGER) AS place, CAST(n AS INTEGER) AS n FROM t WHERE n <= 3000""",
    "graph_fan_out": views.with_tables("segments", "chunks")
    + """, r AS (SELECT access_zone_id || '/' || block_id AS relation_id, access_zone_id, parent_block_id, block_id FROM segments WHERE parent_block_id IS NOT NULL),
b AS (SELECT DISTINCT access_zone_id, lower(block) AS block_id, chunk_id FROM (SELECT access_zone_id, chunk_id, unnest(source_block_ids) AS block FROM chunks WHERE granularity <> 'SOURCE')),
j AS (SELECT relation_id, s.chunk_id AS source_chunk, t.chunk_id AS target_chunk, row_number() OVER (PARTITION BY relation_id ORDER BY s.chunk_id, t.chunk_id) AS n FROM r JOIN b s ON s.access_zone_id = r.access_zone_id AND s.block_id = r.parent_block_id JOIN b t ON t.access_zone_id = r.access_zone_id AND t.block_id = r.block_id WHERE s.chunk_id <> t.chunk_id)
SELECT relation_id, source_chunk, target_chunk FROM j WHERE n <= 64""",
    "graph_summary": views.with_tables("edges")
    + f" SELECT relation_type, count(*) AS n, round(avg(CAST(relation_score AS DOUBLE)), 6) AS avg_score, round(min(CAST(relation_score AS DOUBLE)), 6) AS min_score, round(max(CAST(relation_score AS DOUBLE)), 6) AS max_score, CASE WHEN relation_type IN ({_DOMAIN}) THEN 'SEMANTIC_DOMAIN' WHEN relation_type = 'CHUNK_SEMANTIC_SIMILAR' THEN 'SEMANTIC_SIMILARITY' ELSE 'STRUCTURAL' END AS class FROM edges GROUP BY relation_type",
}
SQL["graph_one_hop"] = (
    views.with_tables("edges")
    + f""", s AS (SELECT DISTINCT lower(seed_access_zone_id) AS access_zone_id, lower(seed_chunk_id) AS chunk_id FROM related_chunks),
e AS (SELECT * FROM edges WHERE lifecycle_status = 'ACTIVE' AND NOT coalesce(quarantined, false) AND source_node_type = 'CHUNK' AND target_node_type = 'CHUNK' AND relation_type IN ({_DOMAIN}, 'CHUNK_SEMANTIC_SIMILAR', 'CHUNK_HAS_PARENT', 'CHUNK_NEXT_SIBLING')),
c AS (SELECT s.*, e.edge_id, relation_type, relation_score, relation_source, relation_rank, target_node_id AS related_id FROM s JOIN e ON e.access_zone_id = s.access_zone_id AND e.source_node_id = s.chunk_id
  UNION ALL SELECT s.*, e.edge_id, relation_type, relation_score, relation_source, relation_rank, source_node_id FROM s JOIN e ON e.access_zone_id = s.access_zone_id AND e.target_node_id = s.chunk_id WHERE relation_type IN ('CHUNK_SAME_TABLE', 'CHUNK_SEMANTIC_SIMILAR', 'RELATED_TO')),
x AS (SELECT *, row_number() OVER (PARTITION BY access_zone_id, chunk_id ORDER BY {_ORDER}) AS n FROM c)
SELECT access_zone_id || '/' || chunk_id AS query_id, chunk_id AS seed_chunk_id, related_id AS chunk_id, edge_id, relation_type, round(0.8::DOUBLE * CAST(relation_score AS DOUBLE) * {_CASE(graph.WEIGHTS, 0.6)}, 6) AS score, round(0.8::DOUBLE * {_CASE(graph.BOOSTS, 0.5)} * CAST(relation_score AS DOUBLE), 6) AS legacy_score FROM x WHERE n <= 40 AND chunk_id <> related_id"""
)
