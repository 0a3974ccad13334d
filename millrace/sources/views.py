"""The engine's tables, read from their Parquet files: ids in lower case, repeated rows once, current states only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.tables import table


def _lower(*names: str) -> list[Column]:
    return [F.lower(n).alias(n) for n in names]


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Key (access_zone_id, chunk_id). Repeats of a row are exact, so any of them will do."""
    t = table(spark, d, "generated_chunks")
    t = t.select(*_lower("access_zone_id", "document_id"), "document_version", F.lower("id").alias("chunk_id"), *_lower("root_id", "source_id", "parent_id"), "granularity", "sequence_no", "token_count", "content", *_lower("source_block_id"), "source_block_ids", "profile_version", "lifecycle_status", "created_at")
    return t.dropDuplicates(["access_zone_id", "chunk_id"])


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Key (access_zone_id, document_id, document_version)."""
    t = table(spark, d, "document_versions").withColumns({c: F.lower(c) for c in ("access_zone_id", "document_id")})
    return t.dropDuplicates(["access_zone_id", "document_id", "document_version"])


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Key (access_zone_id, block_id)."""
    t = table(spark, d, "text_segments").withColumns({c: F.lower(c) for c in ("access_zone_id", "document_id", "block_id", "parent_block_id")})
    return t.dropDuplicates(["access_zone_id", "block_id"])


def latest_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest row per key by a time column (null lowest, ties by a print of the row), combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    rank = F.struct(F.coalesce(F.unix_micros(order), F.lit(-(2**63))), F.xxhash64(*rest))
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("row")).select(*key, "row.*")


def bindings(spark: SparkSession, d: str) -> DataFrame:
    """Key (access_zone_id, binding_id): the current state of each binding."""
    t = table(spark, d, "vector_bindings").withColumnRenamed("id", "binding_id")
    t = t.withColumns({c: F.lower(c) for c in ("access_zone_id", "binding_id", "document_id", "parent_chunk_id", "chunk_id", "qdrant_point_id")})
    return latest_by(t, ["access_zone_id", "binding_id"], "updated_at")


def points(spark: SparkSession, d: str) -> DataFrame:
    """Key (access_zone_id, qdrant_point_id): the newest scan of each index point."""
    t = table(spark, d, "index_points").withColumns({c: F.lower(c) for c in ("access_zone_id", "qdrant_point_id", "binding_id", "chunk_id")})
    return latest_by(t, ["access_zone_id", "qdrant_point_id"], "scanned_at")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Key (access_zone_id, edge_id)."""
    t = table(spark, d, "graph_edges").withColumns({c: F.lower(c) for c in ("access_zone_id", "edge_id", "source_node_id", "target_node_id", "document_id")})
    return t.dropDuplicates(["access_zone_id", "edge_id"])


_LATEST = "SELECT * EXCLUDE (r) FROM (SELECT {cols}, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC NULLS LAST) AS r FROM {table}) WHERE r = 1"

#: The same tables for SQL, as common table expressions.
CTE = {
    "chunks": "chunks AS (SELECT DISTINCT lower(access_zone_id) AS access_zone_id, lower(document_id) AS document_id, document_version, lower(id) AS chunk_id, lower(root_id) AS root_id, lower(source_id) AS source_id, lower(parent_id) AS parent_id, granularity, sequence_no, token_count, content, lower(source_block_id) AS source_block_id, source_block_ids, profile_version, lifecycle_status, created_at FROM generated_chunks)",
    "versions": "versions AS (SELECT DISTINCT * REPLACE (lower(access_zone_id) AS access_zone_id, lower(document_id) AS document_id) FROM document_versions)",
    "segments": "segments AS (SELECT DISTINCT * REPLACE (lower(access_zone_id) AS access_zone_id, lower(document_id) AS document_id, lower(block_id) AS block_id, lower(parent_block_id) AS parent_block_id) FROM text_segments)",
    "bindings": "bindings AS ("
    + _LATEST.format(
        cols="* EXCLUDE (id) REPLACE (lower(access_zone_id) AS access_zone_id, lower(document_id) AS document_id, lower(parent_chunk_id) AS parent_chunk_id, lower(chunk_id) AS chunk_id, lower(qdrant_point_id) AS qdrant_point_id), lower(id) AS binding_id",
        key="lower(access_zone_id), lower(id)",
        order="updated_at",
        table="vector_bindings",
    )
    + ")",
    "points": "points AS ("
    + _LATEST.format(cols="* REPLACE (lower(access_zone_id) AS access_zone_id, lower(qdrant_point_id) AS qdrant_point_id, lower(binding_id) AS binding_id, lower(chunk_id) AS chunk_id)", key="lower(access_zone_id), lower(qdrant_point_id)", order="scanned_at", table="index_points")
    + ")",
    "edges": "edges AS (SELECT DISTINCT * REPLACE (lower(access_zone_id) AS access_zone_id, lower(edge_id) AS edge_id, lower(source_node_id) AS source_node_id, lower(target_node_id) AS target_node_id, lower(document_id) AS document_id) FROM graph_edges)",
}


def with_tables(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)
