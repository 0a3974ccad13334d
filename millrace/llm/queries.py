"""Queries of the training-text problems 2, 3, 6, 7 and 8."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import eval_leaks, lookalikes, packing, spam_pages, splitting
from millrace.sources.tables import table, wide_table
from millrace.storage import write_work


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of all oversized chunks."""
    key = ["access_zone_id", "chunk_id"]
    profiles = table(spark, d, "size_profiles").select("profile_version", "granularity", "max_tokens", "overlap")
    chunks = wide_table(spark, d, "generated_chunks").where("content IS NOT NULL AND granularity != 'SOURCE' AND id IS NOT NULL AND access_zone_id IS NOT NULL")
    chunks = chunks.select(F.lower("access_zone_id").alias("access_zone_id"), F.lower("id").alias("chunk_id"), "profile_version", "granularity", "content", "source_block_ids").join(profiles, ["profile_version", "granularity"])
    over = chunks.where(splitting.count_tokens(F.col("content")) > F.col("max_tokens"))
    # a repeated row counts once
    over = over.groupBy(*key).agg(F.max_by(F.struct("content", "source_block_ids", "max_tokens", "overlap"), F.xxhash64("content", "source_block_ids")).alias("row")).select(*key, "row.*")
    over = write_work(over, "oversized")  # used for the blocks and for the cuts; the other chunks are read only once
    tails = splitting.block_tails(over, key, "source_block_ids", table(spark, d, "text_segments"), "access_zone_id", "block_id", "text")
    return splitting.split_oversized(over.join(tails, key, "left"), key, tails="tails")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).where("piece_no = 0").select("access_zone_id", "chunk_id")


def _p3_rows(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "normalized_queries").select(F.lit("normalized_queries").alias("table_name"), F.col("query_id").alias("key"), F.col("original_text").alias("text"))
    c = wide_table(spark, d, "generated_chunks").select(F.lit("generated_chunks").alias("table_name"), F.concat(F.lower("access_zone_id"), F.lit("/"), F.lower("id")).alias("key"), F.col("content").alias("text"))
    return q.unionByName(c)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_pairs(_p3_rows(spark, d))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per key with its class of texts that look the same."""
    return lookalikes.lookalike_classes(lookalikes.text_classes(_p3_rows(spark, d)))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """All texts of both tables in their consistent form, with one set of representatives."""
    q = table(spark, d, "normalized_queries").select(F.lit("normalized_queries").alias("table_name"), F.col("query_id").alias("key"), F.posexplode(F.array("original_text", "normalized_text")).alias("i", "text"))
    q = q.select("table_name", F.when(F.col("i") == 0, "original_text").otherwise("normalized_text").alias("field"), "key", "text")
    c = _p3_rows(spark, d).where("table_name = 'generated_chunks'").select("table_name", F.lit("content").alias("field"), "key", "text")
    rows = q.unionByName(c).where("text IS NOT NULL")
    patterns = lookalikes.rewriting(lookalikes.pattern_counts(rows.select("text")))
    return rows.select("table_name", "field", "key", lookalikes.canonical(F.col("text"), patterns).alias("text"))


#: The vocabulary that sizes documents; any file of the same form will do.
VOCABULARY = os.environ.get("MILLRACE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed_documents(wide_table(spark, d, "documents"), table(spark, d, "context_windows"), VOCABULARY)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_packed(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return eval_leaks.eval_leaks(wide_table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages.spam_pages(wide_table(spark, d, "documents")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p3_found": p3_found, "p3_classes": p3_classes, "p3_texts": p3_texts, "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_found": p7_found, "p8_found": p8_found}
_WHITE = r"[\t-\r\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SQL: dict[str, str] = {
    "p2_found": f"""
SELECT DISTINCT lower(access_zone_id) AS access_zone_id, lower(id) AS chunk_id FROM generated_chunks JOIN size_profiles USING (profile_version, granularity)
WHERE content IS NOT NULL AND granularity <> 'SOURCE' AND len(list_filter(regexp_split_to_array(content, '{_WHITE}'), lambda x: x <> '')) > max_tokens""",
}
