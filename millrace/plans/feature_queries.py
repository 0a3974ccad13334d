"""Queries of gates, windows, checks and events that other pipelines use only in passing, and their SQL."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import metrics, ranking, upserts
from millrace.plans.retrieval_queries import _APPENDED, _ID, _RELATED, _WHITE, _related
from millrace.plans.serving_queries import AS_OF
from millrace.sources import views
from millrace.sources.tables import table

_MODE = "CASE WHEN branch IN ('EXPLAINS', 'REQUIRES') THEN 'DENSE' WHEN branch = 'RELATED_TO' THEN 'SPARSE' ELSE 'HYBRID' END"


def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which candidates are evidence; rank stands for the matched terms, the first rank for an exact match."""
    r = _related(spark, d).withColumns({"mode": F.expr(_MODE), "exact": F.when(F.col("rank") == 1, 1).otherwise(0)})
    passed = ranking.no_answer_gate(F.col("mode"), F.col("score"), F.col("rank"), F.col("exact"))
    dense, sparse = F.when(F.col("mode") == "DENSE", F.col("score")), F.when(F.col("mode") == "SPARSE", F.col("score"))
    return r.select("query_id", "relation_identity", passed.alias("passed"), ranking.evidence_reason(passed, F.col("exact"), dense, sparse).alias("reason"))


def intents_inherited(spark: SparkSession, d: str) -> DataFrame:
    """The ranks that proved themselves are the intents a seed hands on."""
    e = _related(spark, d).select("query_id", F.col("related_document_id").alias("seed"), F.col("rank").cast("bigint").alias("intent_id"), (F.col("score") >= 0.5).alias("passed"))
    return ranking.inherited_intents(e).select("query_id", "seed", F.array_join(F.transform("intent_ids", lambda x: x.cast("string")), "+").alias("intents"))


def lexical_triggered(spark: SparkSession, d: str) -> DataFrame:
    """The queries whose sparse branch needs help, and how many candidates each would hydrate."""
    r = _related(spark, d)
    need = ranking.lexical_needed(r.select("query_id").distinct(), r.where("branch = 'RELATED_TO'"), 2, 0.6)
    n = r.groupBy("query_id").agg(F.count("*").alias("n"))
    return need.join(n, "query_id").select("query_id", ranking.fetch_window(F.col("n"), F.lit(3), 4, 2, 8).cast("bigint").alias("window"))


def merge_at_least(spark: SparkSession, d: str) -> DataFrame:
    """K14-K16 with the limit raised to the number of results asked for."""
    r = _related(spark, d).groupBy("query_id", *_ID, F.col("branch").isin("EXPLAINS", "REQUIRES", "RELATED_TO").alias("is_direct")).agg(F.max("score").alias("score"))
    return ranking.merge_graph(r.where("is_direct"), r.where("NOT is_direct"), _ID, 1, "DIRECT_FIRST", limit_mode="AT_LEAST_TOP_K", top_k=4).select("query_id", *_ID, F.array_join("origins", "+").alias("origins"), "score", "rank")


def coverage_segments(spark: SparkSession, d: str) -> DataFrame:
    """Ranks stand for segments, the first four of which are required; a strong score is a result."""
    r = _related(spark, d).select("query_id", F.col("rank").alias("segment_index"), (F.col("rank") <= 4).alias("required"), "score")
    return ranking.segment_coverage(r, r.where("score >= 0.6")).select("query_id", "required_total", "required_covered", "status", F.size("uncovered").alias("n_uncovered"))


def enrichments_checked(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned form of each logged question, twice in other cases, as variants of the question."""
    q = table(spark, d, "normalized_queries").select("query_id", "original_text", "normalized_text").distinct()
    v = q.withColumn("variants", F.array("normalized_text", F.translate("normalized_text", ascii_lowercase, ascii_uppercase), F.lit(" "), F.lit("segment")))
    return ranking.checked_enrichments(v, ["query_id"], "original_text", "variants", 400)


def eval_no_answer(spark: SparkSession, d: str) -> DataFrame:
    """By relation type; a strong relation is an answer, a document past its first version one that is expected."""
    r = _related(spark, d).select("branch", (F.col("related_document_version") > 1).alias("expected_empty"), (F.col("score") >= 0.6).alias("answered"))
    return metrics.no_answer(r, ["branch"], {"no_answer_recall": 0.4})


def text_checks(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, zone codes and expiry of all documents."""
    t = table(spark, d, "documents")
    until = text.days_after(F.col("updated_at"), F.col("ttl_days"))
    return t.select("doc_id", text.holds_phrase(F.col("text"), F.lit("BOTH")).alias("has_phrase"), text.is_zone_code(F.col("access_zone_code")).alias("zone_ok"), F.floor(F.unix_micros(until) / F.lit(1_000_000)).alias("expires_s"))


def result_prints(spark: SparkSession, d: str) -> DataFrame:
    """The hash of the ranked results of each query."""
    r = _related(spark, d)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "relation_identity"))), lambda x: x["relation_identity"])
    return r.groupBy("query_id").agg(lines.alias("lines")).select("query_id", text.result_print(F.col("lines")).alias("hash"))


def ttl_events(spark: SparkSession, d: str) -> DataFrame:
    """The delete events of bindings whose time is up."""
    b = views.bindings(spark, d).where(F.col("expires_at") <= F.lit(AS_OF).cast("timestamp"))
    return upserts.as_events(b, ["access_zone_id", "binding_id"], "DELETE_POINT", "payload_version").drop("payload")


def ttl_updates(spark: SparkSession, d: str) -> DataFrame:
    """Thirty days more for the bindings of a document group, never less than they have: new versions and their events."""
    b = views.bindings(spark, d).where("lifecycle_status = 'ACTIVE' AND updated_at IS NOT NULL")
    later = upserts.keep_longest(F.col("expires_at"), text.days_after(F.col("updated_at"), F.lit(30)), False)
    b = b.withColumns({"until": later, "payload_version": F.coalesce("payload_version", F.lit(0)) + 1})
    return b.select("access_zone_id", "binding_id", "payload_version", F.unix_micros("until").alias("until_us"), text.uuid5(F.concat_ws("|", "access_zone_id", "binding_id", F.lit("UPDATE_PAYLOAD"), "payload_version")).alias("event_id"))


QUERIES = {f.__name__: f for f in (evidence_gate, intents_inherited, lexical_triggered, merge_at_least, coverage_segments, enrichments_checked, eval_no_answer, text_checks, result_prints, ttl_events, ttl_updates)}

#: The name-based identifier of a name in the namespace of addresses.
_UUID5 = "(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({name})) AS h))"
_WORDS = lambda t: f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '{_WHITE}'), lambda x: x <> ''))"

SQL = {
    "evidence_gate": _RELATED
    + f""", m AS (SELECT *, {_MODE} AS mode, CASE WHEN rank = 1 THEN 1 ELSE 0 END AS exact FROM related),
l AS (SELECT *, CASE mode WHEN 'DENSE' THEN 0.25 WHEN 'SPARSE' THEN 0.10 ELSE 0.30 END::DOUBLE AS least FROM m),
p AS (SELECT *, (CASE WHEN exact > 0 AND score >= 2 * least THEN score * 1.5 ELSE score END >= least) AND (mode <> 'SPARSE' OR rank >= 2 OR exact > 0) AS passed FROM l)
SELECT query_id, relation_identity, passed, CASE WHEN NOT passed THEN 'INSUFFICIENT_EVIDENCE' WHEN exact > 0 THEN 'EXACT_TECHNICAL_MATCH' WHEN mode = 'SPARSE' AND score > 0 THEN 'SPARSE_EVIDENCE' WHEN mode = 'DENSE' AND score > 0 THEN 'DENSE_EVIDENCE' ELSE 'LEXICAL_EVIDENCE' END AS reason FROM p""",
    "intents_inherited": _RELATED + " SELECT query_id, related_document_id AS seed, string_agg(CAST(rank AS VARCHAR), '+' ORDER BY rank) AS intents FROM (SELECT DISTINCT query_id, related_document_id, rank FROM related WHERE score >= 0.5) GROUP BY ALL",
    "lexical_triggered": _RELATED
    + ", g AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE branch = 'RELATED_TO') AS s, max(score) FILTER (WHERE branch = 'RELATED_TO') AS top FROM related GROUP BY ALL) SELECT query_id, least(greatest(n, 5), 8) AS window FROM g WHERE s < 2 OR top < 0.6",
    "merge_at_least": _APPENDED.format(room="4 - nd"),
    "coverage_segments": _RELATED
    + ", s AS (SELECT query_id, rank, bool_or(score >= 0.6) AS hit FROM related GROUP BY ALL), g AS (SELECT query_id, count(*) FILTER (WHERE rank <= 4) AS t, count(*) FILTER (WHERE rank <= 4 AND hit) AS c FROM s GROUP BY ALL) SELECT query_id, t AS required_total, c AS required_covered, CASE WHEN t = 0 OR c = 0 THEN 'INSUFFICIENT' WHEN t = c THEN 'FOUND' ELSE 'DEGRADED' END AS status, CAST(t - c AS INTEGER) AS n_uncovered FROM g",
    "enrichments_checked": f"""
WITH q AS (SELECT DISTINCT query_id, original_text, normalized_text FROM normalized_queries),
v AS (SELECT query_id, original_text, unnest([normalized_text, translate(normalized_text, '{ascii_lowercase}', '{ascii_uppercase}'), ' ', 'segment']) AS variant, unnest([1, 2, 3, 4]) AS i FROM q),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, original_text, lower(variant) ORDER BY i) AS r FROM v WHERE variant IS NOT NULL AND octet_length(encode(variant)) <= 400 AND variant IS DISTINCT FROM original_text),
w AS (SELECT query_id, variant, {_WORDS("variant")} AS a, {_WORDS("original_text")} AS b FROM k WHERE r = 1),
o AS (SELECT *, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END, 9) AS overlap FROM w)
SELECT query_id, variant, overlap, CASE WHEN len(a) = 0 THEN 'REJECTED' WHEN overlap >= 0.35 THEN 'VALIDATED' ELSE 'UNCERTAIN' END AS verdict FROM o""",
    "eval_no_answer": "WITH related AS (SELECT DISTINCT lower(relation_identity) AS relation_identity, relation_type AS branch, related_document_version AS version, round(CAST(relation_score AS DOUBLE), 6) AS score FROM related_chunks), "
    + """g AS (SELECT branch, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(score >= 0.6, false)) AS s, count(*) FILTER (WHERE version > 1) AS e, count(*) FILTER (WHERE version > 1 AND NOT coalesce(score >= 0.6, false)) AS b FROM related GROUP BY ALL),
m AS (SELECT branch, n AS n_queries, round(CASE WHEN s > 0 THEN b::DOUBLE / s ELSE 0.0 END, 6) AS no_answer_precision, round(CASE WHEN e > 0 THEN b::DOUBLE / e ELSE 0.0 END, 6) AS no_answer_recall, round(CASE WHEN n > e THEN (s - b)::DOUBLE / (n - e) ELSE 0.0 END, 6) AS false_abstention FROM g)
SELECT *, no_answer_recall >= 0.4 AS passed FROM m""",
    "text_checks": "SELECT doc_id, coalesce(contains(lower(text), 'both'), false) AS has_phrase, coalesce(regexp_full_match(access_zone_code, '[0-9]{4}'), false) AS zone_ok, CAST(floor((epoch_us(updated_at) + ttl_days * 86400000000) / 1000000) AS BIGINT) AS expires_s FROM documents",
    "result_prints": _RELATED + " SELECT query_id, sha256(string_agg(relation_identity, chr(10) ORDER BY rank, relation_identity)) AS hash FROM related GROUP BY ALL",
    "ttl_events": views.with_tables("bindings")
    + f" SELECT {_UUID5.format(name="access_zone_id || '|' || binding_id || '|DELETE_POINT' || coalesce('|' || payload_version, '')")} AS id, access_zone_id, binding_id, 'DELETE_POINT' AS operation, payload_version AS operation_version, 0 AS attempt_count FROM bindings WHERE expires_at <= TIMESTAMPTZ '{AS_OF}+00'",
    "ttl_updates": views.with_tables("bindings")
    + f""", n AS (SELECT access_zone_id, binding_id, coalesce(payload_version, 0) + 1 AS payload_version, CASE WHEN expires_at IS NOT NULL THEN greatest(epoch_us(expires_at), epoch_us(updated_at) + 30 * 86400000000) END AS until_us FROM bindings WHERE lifecycle_status = 'ACTIVE' AND updated_at IS NOT NULL)
SELECT *, {_UUID5.format(name="access_zone_id || '|' || binding_id || '|UPDATE_PAYLOAD|' || payload_version")} AS event_id FROM n""",
}
