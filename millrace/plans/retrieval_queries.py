"""Queries of search, fusion, merging, diversification and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import sparse
from millrace.functions.text import lexical_overlap
from millrace.operators import metrics, ranking, search
from millrace.sources import views
from millrace.sources.tables import table

_ID = ["access_zone_id", "chunk_id"]


def _related(spark: SparkSession, d: str) -> DataFrame:
    """Ranked candidates: the seed stands for the query, the relation type for the branch that found the candidate."""
    r = table(spark, d, "related_chunks").withColumns({c: F.lower(c) for c in ("access_zone_id", "chunk_id", "seed_access_zone_id", "seed_chunk_id", "related_document_id", "relation_identity")}).dropDuplicates(["relation_identity"])
    return r.select(F.concat_ws("/", "seed_access_zone_id", "seed_chunk_id").alias("query_id"), *_ID, "related_document_id", "related_document_version", "relation_identity", F.col("relation_type").alias("branch"), F.coalesce("relation_rank", F.lit(10)).alias("rank"), F.round(F.col("relation_score").cast("double"), 6).alias("score"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").dropDuplicates(["vec_id"])


def _stated(df: DataFrame, key: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return df.where(F.col(key) % 20 == 0)


def search_dense(spark: SparkSession, d: str) -> DataFrame:
    """K01."""
    v = _vectors(spark, d)
    return search.dense_topk(_stated(v, "vec_id").withColumnRenamed("vec_id", "query_id"), v, 10, "query_id", ["vec_id"])


def search_dense_same_label(spark: SparkSession, d: str) -> DataFrame:
    """K01 behind F01: all rows of the query's zone (label), itself left out."""
    v = _vectors(spark, d)
    return search.dense_topk(_stated(v, "vec_id").withColumnRenamed("vec_id", "query_id"), v, 5, "query_id", ["vec_id"], same="label", not_self="vec_id")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text")).dropDuplicates(["query_id"])
    return _stated(t, "query_id")


def search_sparse(spark: SparkSession, d: str) -> DataFrame:
    """The titles of the stated documents against all chunks, by their technical and ordinary tokens."""
    q = sparse.encode(_titles(spark, d), ["query_id"], "text", unique=True)
    c = sparse.encode(views.chunks(spark, d).where("content IS NOT NULL"), _ID, "content", unique=True)
    return search.sparse_topk(q, c, 10, "query_id", _ID, once=True)


def search_lexical(spark: SparkSession, d: str) -> DataFrame:
    """The titles of the stated documents against all chunks."""
    c = views.chunks(spark, d).withColumnRenamed("content", "text")
    return search.lexical_topk(_titles(spark, d), c, 10, "query_id", _ID)


def search_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Similarity edges within a label."""
    return search.neighbours(_vectors(spark, d), "label", "vec_id", "embedding", least=0.2)


def search_recent(spark: SparkSession, d: str) -> DataFrame:
    """The newest documents of each source."""
    t = table(spark, d, "documents").select("doc_id", "source", "updated_at")
    return ranking.ranked(t, ["source"], [F.col("updated_at").desc_nulls_last(), "doc_id"], k=5).select("source", "rank", "doc_id")


def fusion_segments(spark: SparkSession, d: str) -> DataFrame:
    """Branches stand for segments, with one intent for two of them."""
    r = _related(spark, d)
    seg = F.pmod(F.col("rank"), F.lit(4))
    c = r.select("query_id", *_ID, seg.alias("segment_index"), "rank", F.col("score").alias("weight"), F.when(seg < 2, F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("intent_ids"))
    return ranking.cross_segment_rrf(c, _ID, 60.0, 10).select("query_id", *_ID, "score", F.size("matched_segments").alias("n_segments"), "best_segment_index", "rank")


def fusion_rrf(spark: SparkSession, d: str) -> DataFrame:
    """R02."""
    return ranking.hybrid_rrf(_related(spark, d), _ID, {"RELATED_TO": 0.2}).select("query_id", *_ID, "score", F.size("branches").alias("n_branches"), "rank")


def fusion_weighted(spark: SparkSession, d: str) -> DataFrame:
    """R03."""
    return ranking.weighted_fusion(_related(spark, d), _ID, {"EXPLAINS": 0.6, "REQUIRES": 0.4})


def fusion_weighted_normalized(spark: SparkSession, d: str) -> DataFrame:
    """R03, scaled."""
    return ranking.weighted_fusion(_related(spark, d), _ID, {"EXPLAINS": 0.6, "REQUIRES": 0.4, "RELATED_TO": 0.5}, True)


def fusion_groups(spark: SparkSession, d: str) -> DataFrame:
    """The best candidate of each query and document."""
    return ranking.best_per_group(_related(spark, d), ["query_id", "related_document_id"], [F.col("score").desc(), "relation_identity"]).select("query_id", "related_document_id", "relation_identity", "score")


def score_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The two forms of each logged question against each other."""
    q = table(spark, d, "normalized_queries").select("query_id", "original_text", "normalized_text").distinct()
    lex = F.round(lexical_overlap(F.coalesce("original_text", F.lit("")), F.coalesce("normalized_text", F.lit(""))), 6)
    r = q.select("query_id", lex.alias("lexical"), ranking.relevance(F.lit(0.9), F.lit(0.5), lex, F.lit(None).cast("double")).alias("r"))
    return r.select("query_id", "lexical", F.round("r.final", 6).alias("final"), F.col("r.decision").alias("decision"), ranking.evidence_reason(F.col("lexical") >= 0.5, F.lit(0), F.lit(0.0), F.lit(0.0)).alias("reason"))


def coverage_intents(spark: SparkSession, d: str) -> DataFrame:
    """Relations of a seed stand for its intents, those found by a strong score are covered."""
    r = _related(spark, d).groupBy("query_id", F.col("rank").cast("bigint").alias("intent_id")).agg(F.max("score").alias("weight"))
    i = r.withColumn("required", F.col("intent_id") <= 6)
    return ranking.coverage(i, r.where("weight >= 0.6")).select("query_id", "required_total", "required_covered", F.round("ratio", 6).alias("ratio"), "status", F.size("uncovered").alias("n_uncovered"))


def coverage_branches(spark: SparkSession, d: str) -> DataFrame:
    """A16, R12."""
    s = F.when(F.col("score") >= 0.5, "SUCCESS").when(F.col("score") >= 0.4, "SKIPPED_BUDGET").otherwise("TIMEOUT")
    return ranking.branch_summary(_related(spark, d).select("query_id", s.alias("status")), ["query_id"])


def _origins(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _related(spark, d).groupBy("query_id", *_ID, F.col("branch").isin("EXPLAINS", "REQUIRES", "RELATED_TO").alias("is_direct")).agg(F.max("score").alias("score"))
    return r.where("is_direct"), r.where("NOT is_direct")


def _merged(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        a, b = _origins(spark, d)
        return ranking.merge_graph(a, b, _ID, 4, strategy, append=1).select("query_id", *_ID, F.array_join("origins", "+").alias("origins"), "score", "rank")

    return run


def diversified(spark: SparkSession, d: str) -> DataFrame:
    """Eight of each stated vector's thirty nearest, with the query's own label protected."""
    v = _vectors(spark, d)
    hits = search.dense_topk(_stated(v, "vec_id").withColumnRenamed("vec_id", "query_id"), v, 30, "query_id", ["vec_id"])
    rows = hits.join(v.select("vec_id", F.col("embedding").alias("vector"), F.concat(F.lit("label "), "label").alias("text")), "vec_id").withColumn("first", F.col("rank") == 1)
    return ranking.mmr(rows, "vec_id", 8, protected="first")


def budgeted(spark: SparkSession, d: str) -> DataFrame:
    """The chunks related to each seed, best first, within a token budget."""
    r = ranking.ranked(_related(spark, d).select("query_id", *_ID, "score", "relation_identity", "rank").withColumnRenamed("rank", "given"), ["query_id"], [F.col("score").desc(), "relation_identity"])
    t = r.join(views.chunks(spark, d).select(*_ID, "content"), _ID, "left")
    return ranking.token_budget(t, "content", 1500, 500).select("query_id", "relation_identity", "rank", "est_tokens", "used_tokens")


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _related(spark, d)
    grade = F.when(F.col("score") >= 0.8, 3).when(F.col("score") >= 0.6, 2).when(F.col("score") >= 0.5, 1).otherwise(0)
    return ranking.ranked(r, ["query_id"], ["rank", "relation_identity"]).select("query_id", "relation_identity", "rank"), r.select("query_id", "relation_identity", grade.alias("relevance"))


def eval_ir(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    return metrics.ir_metrics(*_judged(spark, d), "relation_identity")


def eval_macro(spark: SparkSession, d: str) -> DataFrame:
    """By the number of results."""
    a, j = _judged(spark, d)
    m = metrics.ir_metrics(a, j, "relation_identity").join(a.groupBy("query_id").agg(F.least(F.count("*"), F.lit(5)).alias("n_results")), "query_id")
    return metrics.macro(m, ["n_results"], ["p5", "recall5", "rr10", "ndcg10"])


def eval_latency(spark: SparkSession, d: str) -> DataFrame:
    """A21, A22."""
    return metrics.nearest_rank_up(table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])


def eval_stability(spark: SparkSession, d: str) -> DataFrame:
    """Ranking by rank against ranking by score."""
    r = _related(spark, d)
    a, b = (ranking.ranked(r, ["query_id"], o).select("query_id", "relation_identity", "rank") for o in (["rank", "relation_identity"], [F.col("score").desc(), "relation_identity"]))
    return metrics.stability(a, b, "relation_identity", 3)


def eval_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The share of errors per user with its interval."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
    w = metrics.wilson(F.col("errors"), F.col("n"))
    return g.select("user_id", "errors", "n", F.round(w["low"], 6).alias("low"), F.round(w["high"], 6).alias("high"))


QUERIES = {
    f.__name__: f
    for f in (search_dense, search_dense_same_label, search_sparse, search_lexical, search_neighbours, search_recent, fusion_segments, fusion_rrf, fusion_weighted, fusion_weighted_normalized, fusion_groups, score_relevance, coverage_intents, coverage_branches, diversified, budgeted, eval_ir, eval_macro, eval_latency, eval_stability, eval_intervals)
} | {"merge_by_score": _merged("SCORE_THEN_TRUNCATE"), "merge_direct_first": _merged("DIRECT_FIRST"), "merge_append": _merged("GRAPH_AS_CONTEXT_APPEND")}

_RELATED = """WITH related AS (
  SELECT DISTINCT lower(seed_access_zone_id) || '/' || lower(seed_chunk_id) AS query_id, lower(access_zone_id) AS access_zone_id, lower(chunk_id) AS chunk_id, lower(related_document_id) AS related_document_id,
    lower(relation_identity) AS relation_identity, relation_type AS branch, coalesce(relation_rank, 10) AS rank, round(CAST(relation_score AS DOUBLE), 6) AS score FROM related_chunks)"""
_COS = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"
_FUSED = """
SELECT query_id, access_zone_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, access_zone_id, chunk_id) AS INTEGER) AS rank FROM f"""
_WHITE = r"[\t-\r\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_MERGE = (
    _RELATED
    + """, o AS (SELECT query_id, access_zone_id, chunk_id, branch IN ('EXPLAINS', 'REQUIRES', 'RELATED_TO') AS is_direct, max(score) AS score FROM related GROUP BY ALL),
m AS (SELECT query_id, access_zone_id, chunk_id, bool_or(is_direct) AS direct, CASE WHEN bool_or(is_direct) AND bool_or(NOT is_direct) THEN 'DIRECT+GRAPH' WHEN bool_or(is_direct) THEN 'DIRECT' ELSE 'GRAPH' END AS origins,
  round(max(CASE WHEN is_direct THEN score ELSE score * 0.85 END), 9) AS top, round(max(CASE WHEN is_direct THEN score END), 9) AS d FROM o GROUP BY ALL)"""
)
_APPENDED = (
    _MERGE
    + """, n AS (SELECT *, coalesce(d, top) AS score, row_number() OVER (PARTITION BY query_id, direct ORDER BY coalesce(d, top) DESC, access_zone_id, chunk_id) AS nth, least(4, count(*) FILTER (WHERE direct) OVER (PARTITION BY query_id)) AS nd FROM m)
SELECT query_id, access_zone_id, chunk_id, origins, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY direct DESC, nth) AS INTEGER) AS rank FROM n WHERE nth <= CASE WHEN direct THEN 4 ELSE {room} END"""
)
_IR = (
    _RELATED
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, relation_identity) AS r, CASE WHEN score >= 0.8 THEN 3 WHEN score >= 0.6 THEN 2 WHEN score >= 0.5 THEN 1 ELSE 0 END AS rel FROM related),
i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, relation_identity) AS ir FROM a WHERE rel > 0),
m AS (SELECT query_id, count(*) FILTER (WHERE r <= 5) / 5.0::DOUBLE AS p5, CAST(count(*) FILTER (WHERE r <= 5) > 0 AS INTEGER) AS hit5,
  round(count(*) FILTER (WHERE r <= 5)::DOUBLE / count(*), 9) AS recall5, round(count(*) FILTER (WHERE r <= 10)::DOUBLE / count(*), 9) AS recall10, round(count(*) FILTER (WHERE r <= 20)::DOUBLE / count(*), 9) AS recall20,
  round(CASE WHEN min(r) <= 10 THEN 1.0::DOUBLE / min(r) ELSE 0.0 END, 9) AS rr10,
  round(coalesce(sum(CASE WHEN r <= 10 THEN (pow(2, rel) - 1) / log2(r + 1) END), 0) / sum(CASE WHEN ir <= 10 THEN (pow(2, rel) - 1) / log2(ir + 1) END), 9) AS ndcg10 FROM i GROUP BY query_id)"""
)

SQL = {
    "search_dense": f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""",
    "search_dense_same_label": f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.label = v.label AND q.vec_id <> v.vec_id)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "search_neighbours": f"""
WITH s AS (SELECT q.label, q.vec_id AS source, v.vec_id AS target, {_COS} AS score FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id)
SELECT label, source, target, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS rank FROM s WHERE score >= 0.2) WHERE rank <= 3""",
    "search_lexical": views.with_tables("chunks")
    + f""", q AS (SELECT DISTINCT doc_id AS query_id, trim(regexp_replace(lower(title), '{_WHITE}', ' ', 'g')) AS whole FROM documents WHERE title IS NOT NULL AND doc_id % 20 = 0),
qw AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest(string_split(whole, ' ')) AS w FROM q) WHERE w <> ''),
c AS (SELECT access_zone_id, chunk_id, trim(regexp_replace(lower(content), '{_WHITE}', ' ', 'g')) AS body FROM chunks WHERE content IS NOT NULL),
cw AS (SELECT DISTINCT access_zone_id, chunk_id, w FROM (SELECT access_zone_id, chunk_id, unnest(string_split(body, ' ')) AS w FROM c) WHERE w <> ''),
n AS (SELECT query_id, count(*) AS n FROM qw GROUP BY ALL),
m AS (SELECT query_id, access_zone_id, chunk_id, count(*) AS m FROM qw JOIN cw USING (w) GROUP BY ALL),
s AS (SELECT query_id, access_zone_id, chunk_id, round(m::DOUBLE / n + CASE WHEN m = n AND contains(body, whole) THEN 1 ELSE 0 END, 6) AS score FROM m JOIN n USING (query_id) JOIN q USING (query_id) JOIN c USING (access_zone_id, chunk_id))
SELECT query_id, access_zone_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, access_zone_id, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "search_recent": "SELECT source, CAST(rank AS INTEGER) AS rank, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC NULLS LAST, doc_id) AS rank FROM documents) WHERE rank <= 5",
    "fusion_segments": _RELATED
    + """, p AS (SELECT *, rank % 4 AS seg, score / (60.0::DOUBLE + greatest(rank, 1)) AS part, CASE WHEN rank % 4 < 2 THEN 'i0' ELSE 's' || (rank % 4) END AS k FROM related),
b AS (SELECT query_id, access_zone_id, chunk_id, k, max(part) AS best FROM p GROUP BY ALL),
g AS (SELECT query_id, access_zone_id, chunk_id, count(DISTINCT seg) AS n_segments FROM p GROUP BY ALL),
t AS (SELECT query_id, access_zone_id, chunk_id, seg FROM (SELECT *, row_number() OVER (PARTITION BY query_id, access_zone_id, chunk_id ORDER BY part DESC, rank, seg) AS r FROM p) WHERE r = 1),
f AS (SELECT query_id, access_zone_id, chunk_id, round(sum(best), 9) AS score FROM b GROUP BY ALL)
SELECT * FROM (SELECT query_id, access_zone_id, chunk_id, score, CAST(n_segments AS INTEGER) AS n_segments, CAST(seg AS INTEGER) AS best_segment_index,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_segments DESC, access_zone_id, chunk_id) AS INTEGER) AS rank
FROM f JOIN g USING (query_id, access_zone_id, chunk_id) JOIN t USING (query_id, access_zone_id, chunk_id)) WHERE rank <= 10""",
    "fusion_rrf": _RELATED
    + """, b AS (SELECT query_id, access_zone_id, chunk_id, branch, min(rank) AS r FROM related GROUP BY ALL),
f AS (SELECT query_id, access_zone_id, chunk_id, round(sum(CASE WHEN branch = 'RELATED_TO' THEN 0.2::DOUBLE ELSE 1 END / (60.0::DOUBLE + r)), 9) AS score, CAST(count(*) AS INTEGER) AS n_branches FROM b GROUP BY ALL)
SELECT query_id, access_zone_id, chunk_id, score, n_branches, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, access_zone_id, chunk_id) AS INTEGER) AS rank FROM f""",
    "fusion_weighted": _RELATED
    + """, b AS (SELECT query_id, access_zone_id, chunk_id, branch, max(score) AS s FROM related GROUP BY ALL),
f AS (SELECT query_id, access_zone_id, chunk_id, round(sum(CASE branch WHEN 'EXPLAINS' THEN 0.6::DOUBLE WHEN 'REQUIRES' THEN 0.4::DOUBLE ELSE 0 END * s), 9) AS score FROM b GROUP BY ALL)"""
    + _FUSED,
    "fusion_weighted_normalized": _RELATED
    + """, b AS (SELECT query_id, access_zone_id, chunk_id, branch, max(score) AS s FROM related GROUP BY ALL),
z AS (SELECT *, min(s) OVER w AS lo, max(s) OVER w AS hi FROM b WINDOW w AS (PARTITION BY query_id, branch)),
f AS (SELECT query_id, access_zone_id, chunk_id, round(sum(CASE branch WHEN 'EXPLAINS' THEN 0.6::DOUBLE WHEN 'REQUIRES' THEN 0.4::DOUBLE WHEN 'RELATED_TO' THEN 0.5::DOUBLE ELSE 0 END * CASE WHEN hi = lo THEN 1 ELSE (s - lo) / (hi - lo) END), 9) AS score FROM z GROUP BY ALL)"""
    + _FUSED,
    "fusion_groups": _RELATED + " SELECT query_id, related_document_id, relation_identity, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, related_document_id ORDER BY score DESC, relation_identity) AS n FROM related) WHERE n = 1",
    "score_relevance": f"""
WITH q AS (SELECT DISTINCT query_id, original_text, normalized_text FROM normalized_queries),
w AS (SELECT query_id, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(original_text, '')), '{_WHITE}'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(normalized_text, '')), '{_WHITE}'), lambda x: x <> '')) AS b FROM q),
l AS (SELECT query_id, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / len(a) END, 6) AS lexical FROM w),
f AS (SELECT *, least(1.0, 0.55::DOUBLE * 0.9::DOUBLE + 0.25::DOUBLE * 0.5::DOUBLE + 0.20::DOUBLE * lexical) AS x FROM l)
SELECT query_id, lexical, round(x, 6) AS final, CASE WHEN x >= 0.85 THEN 'RELEVANT' WHEN x >= 0.65 THEN 'PARTIALLY_RELEVANT' WHEN x >= 0.45 THEN 'UNCERTAIN' ELSE 'NOT_RELEVANT' END AS decision, CASE WHEN lexical >= 0.5 THEN 'LEXICAL_EVIDENCE' ELSE 'INSUFFICIENT_EVIDENCE' END AS reason FROM f""",
    "coverage_intents": _RELATED
    + """, r AS (SELECT query_id, rank, max(score) AS weight FROM related GROUP BY ALL),
g AS (SELECT query_id, count(*) FILTER (WHERE rank <= 6) AS t, count(*) FILTER (WHERE rank <= 6 AND weight >= 0.6) AS c, sum(weight) FILTER (WHERE rank <= 6) AS w, coalesce(sum(weight) FILTER (WHERE rank <= 6 AND weight >= 0.6), 0) AS cw FROM r GROUP BY ALL)
SELECT query_id, t AS required_total, c AS required_covered, round(CASE WHEN w > 0 THEN cw / w ELSE 0.0 END, 6) AS ratio, CASE WHEN t = 0 OR c = 0 THEN 'INSUFFICIENT' WHEN t = c THEN 'FOUND' ELSE 'DEGRADED' END AS status, CAST(t - c AS INTEGER) AS n_uncovered FROM g""",
    "coverage_branches": _RELATED
    + """, g AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE score >= 0.5) AS ok, count(*) FILTER (WHERE score >= 0.4 AND score < 0.5) AS sk FROM related GROUP BY ALL)
SELECT query_id, CASE WHEN sk = n THEN 'SKIPPED' WHEN n - ok - sk = 0 THEN 'SUCCESS' WHEN ok = 0 THEN 'FAILED' ELSE 'PARTIAL_FAILURE' END AS overall, ok = n AS no_answer_eligible FROM g""",
    "merge_by_score": _MERGE
    + """, n AS (SELECT *, direct AND row_number() OVER (PARTITION BY query_id, direct ORDER BY top DESC, access_zone_id, chunk_id) = 1 AS saved FROM m),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY saved DESC, top DESC, access_zone_id, chunk_id) AS place FROM n) WHERE place <= 4)
SELECT query_id, access_zone_id, chunk_id, origins, top AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY top DESC, access_zone_id, chunk_id) AS INTEGER) AS rank FROM k""",
    "merge_direct_first": _APPENDED.format(room="4 - nd"),
    "merge_append": _APPENDED.format(room="least(1, 4 - nd)"),
    "budgeted": _RELATED
    + ", "
    + views.CTE["chunks"]
    + """, r AS (SELECT r.*, content, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relation_identity) AS n FROM related r LEFT JOIN chunks c ON c.access_zone_id = r.access_zone_id AND c.chunk_id = r.chunk_id),
e AS (SELECT *, CAST(ceil(length(coalesce(content, '')) / 3.0::DOUBLE * 1.2::DOUBLE) AS BIGINT) AS est_tokens FROM r),
u AS (SELECT *, CAST(sum(est_tokens) OVER (PARTITION BY query_id ORDER BY n) AS BIGINT) AS used_tokens FROM e)
SELECT query_id, relation_identity, CAST(n AS INTEGER) AS rank, est_tokens, used_tokens FROM u WHERE used_tokens <= 1000 OR n = 1""",
    "eval_ir": _IR + " SELECT * FROM m",
    "eval_macro": _IR
    + """, c AS (SELECT query_id, least(count(*), 5) AS n_results FROM related GROUP BY ALL)
SELECT n_results, count(*) AS n_queries, round(avg(p5), 6) AS p5, round(avg(recall5), 6) AS recall5, round(avg(rr10), 6) AS rr10, round(avg(ndcg10), 6) AS ndcg10 FROM m JOIN c USING (query_id) GROUP BY ALL""",
    "eval_latency": """
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, min(value) FILTER (WHERE r = ceil((n - 1) * 0.5::DOUBLE) + 1) AS p50, min(value) FILTER (WHERE r = ceil((n - 1) * 0.95::DOUBLE) + 1) AS p95, min(value) FILTER (WHERE r = ceil((n - 1) * 0.99::DOUBLE) + 1) AS p99, max(value) AS max FROM s GROUP BY event_type""",
    "eval_stability": _RELATED
    + """, r AS (SELECT query_id, relation_identity, row_number() OVER (PARTITION BY query_id ORDER BY rank, relation_identity) AS a, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relation_identity) AS b FROM related)
SELECT query_id, bool_or(a = 1 AND b = 1) AS top1, round(count(*) FILTER (WHERE a <= 3 AND b <= 3)::DOUBLE / count(*) FILTER (WHERE a <= 3 OR b <= 3), 9) AS jaccard FROM r GROUP BY ALL""",
    "eval_intervals": """
WITH g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY ALL),
p AS (SELECT *, errors::DOUBLE / n AS p, 1.96::DOUBLE * 1.96::DOUBLE AS zz FROM g),
w AS (SELECT *, (p + zz / (2 * n)) / (1 + zz / n) AS mid, 1.96::DOUBLE * sqrt(p * (1 - p) / n + zz / (4.0 * n * n)) / (1 + zz / n) AS half FROM p)
SELECT user_id, errors, n, round(greatest(0, mid - half), 6) AS low, round(least(1, mid + half), 6) AS high FROM w""",
}
