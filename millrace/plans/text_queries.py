"""Queries of the text and sparse functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import sparse, text
from millrace.sources import views
from millrace.sources.tables import table


def text_shape(spark: SparkSession, d: str) -> DataFrame:
    """T01, T02, T04, T28, T32 over all documents."""
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", text.sha256_hex(text.normalize_space(t)).alias("space_print"), text.count_words(t).alias("n_words"), text.label(F.col("title"), t).alias("label"), text.length_bucket(text.count_words(t)).alias("bucket")
    )


def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    """T05 over all documents."""
    s = text.sentences(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n_sentences"), text.sha256_hex(F.array_join(s, "\n")).alias("print"))


def text_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """T03, T14, F15, T30 over the query log."""
    q = table(spark, d, "normalized_queries").select("query_id").distinct()
    return q.select(
        "query_id", text.uuid5(F.col("query_id")).alias("name_id"), text.sparse_index(F.lit("ordinary_word"), F.col("query_id")).alias("index"), text.opaque_id("parent", F.col("query_id")).alias("opaque"), text.backoff(F.substring("query_id", -1, 1).cast("int"), 5, 300).alias("wait_s")
    )


def text_stems(spark: SparkSession, d: str) -> DataFrame:
    """Stems of the words of all documents with their frequency."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return w.where(~F.col("w").isin(sparse.STOP_WORDS)).groupBy(text.stem(F.col("w")).alias("stem")).agg(F.count("*").alias("n"))


def text_sparse_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Sparse vectors of all chunks."""
    c = views.chunks(spark, d).where("content IS NOT NULL")
    v = sparse.encode(c, ["access_zone_id", "chunk_id"], "content", max_non_zero=256)
    return v.select("access_zone_id", "chunk_id", F.size("indices").alias("nnz"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x), 6).alias("length"))


def text_token_kinds(spark: SparkSession, d: str) -> DataFrame:
    """T17 over the query log."""
    q = table(spark, d, "normalized_queries").select("query_id", "original_text").distinct()
    return sparse.token_counts(q, ["query_id"], "original_text")


def text_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Paths into JSON metadata, bindings per chunking profile and trace quality."""
    b = views.bindings(spark, d)
    at = lambda p: F.get_json_object("metadata", p)
    return b.groupBy(at("$.chunking_profile_version").alias("profile"), at("$.trace_quality").alias("quality")).agg(F.count("*").alias("n"), F.max(at("$.run").cast("int")).alias("last_run"))


def text_canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    """One hash per document version over its blocks in order, as canonical JSON with nulls written out."""
    s = views.segments(spark, d).where("text IS NOT NULL")
    block = F.to_json(F.struct(F.coalesce("order_index", F.lit(-1)).alias("order"), "block_id", "block_type", F.sha2("text", 256).alias("text")), {"ignoreNullFields": "false"})
    rows = s.groupBy("access_zone_id", "document_id", "document_version").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("order_index", F.lit(-1)).alias("o"), "block_id", block.alias("j")))).alias("b"))
    return rows.select("access_zone_id", "document_id", "document_version", F.sha2(F.concat(F.lit("["), F.array_join(F.transform("b", lambda x: x["j"]), ","), F.lit("]")), 256).alias("batch_hash"))


QUERIES = {f.__name__: f for f in (text_shape, text_sentences, text_identifiers, text_stems, text_sparse_vectors, text_token_kinds, text_metadata, text_canonical_hash)}

_WHITE = r"[\t-\r\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_N_WORDS = f"coalesce(len(list_filter(regexp_split_to_array(text, '{_WHITE}'), lambda x: x <> '')), 0)"
_STEM = "CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN w[:-4] || 'y' WHEN length(w) > 6 AND w LIKE '%ing' THEN w[:-4] WHEN length(w) > 5 AND w LIKE '%ed' THEN w[:-3] WHEN length(w) > 5 AND w LIKE '%es' THEN w[:-3] WHEN length(w) > 4 AND w LIKE '%s' THEN w[:-2] ELSE w END"

SQL = {
    "text_shape": f"""
SELECT doc_id, sha256(trim(regexp_replace(text, '{_WHITE}', ' ', 'g'))) AS space_print, CAST({_N_WORDS} AS INTEGER) AS n_words,
  coalesce(nullif(title, ''), substring(text, 1, 80)) AS label,
  CASE WHEN {_N_WORDS} <= 64 THEN 64 WHEN {_N_WORDS} <= 128 THEN 128 WHEN {_N_WORDS} <= 256 THEN 256 ELSE 512 END AS bucket FROM documents""",
    "text_sentences": f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$'), lambda x: regexp_replace(x, '^{_WHITE}|{_WHITE}$', '', 'g')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CAST(len(l) AS INTEGER) AS n_sentences, sha256(coalesce(array_to_string(l, chr(10)), '')) AS print FROM s""",
    "text_stems": f"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT {_STEM} AS stem, count(*) AS n FROM w WHERE w NOT IN ({", ".join(repr(x) for x in sparse.STOP_WORDS)}) GROUP BY ALL""",
    "text_metadata": views.with_tables("bindings")
    + """
SELECT json_extract_string(metadata, '$.chunking_profile_version') AS profile, json_extract_string(metadata, '$.trace_quality') AS quality, count(*) AS n,
  max(CAST(json_extract_string(metadata, '$.run') AS INTEGER)) AS last_run FROM bindings GROUP BY ALL""",
    "text_canonical_hash": views.with_tables("segments")
    + """
SELECT access_zone_id, document_id, document_version, sha256('[' || string_agg('{"order":' || coalesce(order_index, -1) || ',"block_id":"' || block_id || '","block_type":' || coalesce('"' || block_type || '"', 'null') || ',"text":"' || sha256(text) || '"}', ',' ORDER BY coalesce(order_index, -1), block_id) || ']') AS batch_hash
FROM segments WHERE text IS NOT NULL GROUP BY ALL""",
}
