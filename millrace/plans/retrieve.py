"""End-to-end retrieval of contexts for a table of queries, and ingestion of logical documents, from the operators.

All queries at once, keyed by query_id: query plans, the search branches of the profile's mode for each segment, fusion of
branches and of segments, no-answer gate, grouping by parent, hydration, one-hop graph expansion, merge, MMR, token budget,
last visibility check, coverage of the intents. Stages are plain DataFrames; explain() returns all of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import sparse
from millrace.operators import graph, queryplan, ranking, search, serving
from millrace.operators.chunking import chunk_segments, document_trace
from millrace.operators.upserts import as_events
from millrace.storage import write_work

_Z = ["access_zone_id", "chunk_id"]


# Retrieval profiles with their search mode and candidate limit.
PROFILES = {"SEMANTIC": ("DENSE", 60), "LEXICAL_STRICT": ("SPARSE", 80), "LEGAL": ("HYBRID", 120), "TECHNICAL": ("HYBRID", 100), "BALANCED": ("HYBRID", 80)}

# Token classes whose exact match is evidence by itself, and the candidates that MMR looks at.
STRONG = "numeric_exact alphanumeric error_code underscore_identifier path filename ip_or_port uuid grpc_method version_token".split()
CAP = 80


@dataclass
class Options:
    """F16: limits are clamped to what the service allows."""

    level: int = 2
    as_of: str = "2026-01-01 00:00:00"
    profile: str = "BALANCED"
    contexts: int = 5
    graph: bool = True
    edges: int = 40
    budget: int = 6000

    def __post_init__(self) -> None:
        self.contexts = max(1, min(self.contexts or 5, 50))
        self.candidates = PROFILES[self.profile][1]


def _found(segments: DataFrame, visible: DataFrame, o: Options, chunk_vectors: DataFrame | None, query_vectors: DataFrame | None) -> DataFrame:
    """(unit, *_Z, branch, score, rank, terms, exact): what each branch of the profile's mode finds for each segment. The
    lexical branch runs beside the sparse one, for the segments that need it."""
    mode = PROFILES[o.profile][0]
    out = None
    if mode != "DENSE":
        q = sparse.encode(segments, ["unit"], "text")
        exact = sparse.token_rows(segments, ["unit"], "text").where(F.col("class").isin(STRONG)).groupBy("unit").agg(F.collect_set(sparse.sparse_index(F.col("class"), F.col("token"))).alias("strong"))
        c = write_work(sparse.encode(visible.where("content IS NOT NULL"), _Z, "content"), "sparse")
        hits = write_work(search.sparse_topk(q, c, o.candidates, "unit", _Z), "sparse_hits")
        lexical = search.lexical_topk(ranking.lexical_needed(segments.select("unit", "text"), hits, query="unit"), visible.withColumnRenamed("content", "text"), o.candidates, "unit", _Z)
        both = hits.withColumn("branch", F.lit("SPARSE")).unionByName(lexical.withColumn("branch", F.lit("LEXICAL")))
        j = both.join(q.select("unit", F.col("indices").alias("asked")), "unit", "left").join(exact, "unit", "left").join(c.select(*_Z, "indices"), _Z, "left")
        some = lambda c: F.coalesce(c, F.array().cast("array<bigint>"))
        n = lambda side: F.size(F.array_intersect(some(side), some("indices")))
        out = j.select("unit", *_Z, "branch", "score", "rank", n("asked").alias("terms"), n("strong").alias("exact"))
    if mode != "SPARSE" and chunk_vectors is not None and query_vectors is not None:
        q = segments.select("unit", "query_id", "segment_index").join(query_vectors, ["query_id", "segment_index"]).select("unit", "vector")
        dense = search.dense_topk(q, chunk_vectors.join(visible.select(*_Z), _Z, "left_semi"), o.candidates, "unit", _Z, "vector")
        dense = dense.select("unit", *_Z, F.lit("DENSE").alias("branch"), "score", "rank", F.lit(0).alias("terms"), F.lit(0).alias("exact"))
        out = dense if out is None else out.unionByName(dense)
    if out is None:
        raise ValueError(f"profile {o.profile} searches by vectors only: chunk_vectors and query_vectors are needed")
    return out


def _passed(hits: DataFrame) -> DataFrame:
    """(unit, *_Z) that are evidence: one of its branches passes its own gate, or all of them together the hybrid one
    (INFERRED; a lexical score is gated like a hybrid one, matched terms are the tokens and stems in common)."""
    of = lambda b: F.max(F.when(F.col("branch") == b, F.when(F.lit(b == "LEXICAL") & (F.col("score") > 1), 1.0).otherwise(F.col("score"))))
    g = hits.groupBy("unit", *_Z).agg(of("DENSE").alias("d"), of("SPARSE").alias("s"), of("LEXICAL").alias("l"), F.max("terms").alias("terms"), F.max("exact").alias("exact"))
    gate = lambda mode, score: F.coalesce(ranking.no_answer_gate(F.lit(mode), score, F.col("terms"), F.col("exact")), F.lit(False))
    fused = ranking.relevance(F.col("d"), F.col("s"), F.col("l"), F.lit(None).cast("double"))["fused"]
    return g.where(gate("DENSE", F.col("d")) | gate("SPARSE", F.col("s")) | gate("LEXICAL", F.col("l")) | gate("HYBRID", fused)).select("unit", *_Z)


def stages(queries: DataFrame, chunks: DataFrame, bindings: DataFrame, versions: DataFrame, edges: DataFrame, options: Options | None = None, chunk_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """queries (query_id, text). Every stage by name, in order; the last, contexts, is the answer. The dense branch needs
    chunk_vectors (access_zone_id, chunk_id, vector) and query_vectors (query_id, segment_index, vector); without them a
    hybrid profile runs its other branches. The gate comes before the grouping, so that a parent counts if any chunk of it does."""
    o = options or Options()
    visible = serving.visible_chunks(chunks, bindings, versions, o.level, o.as_of).where("granularity IN ('PARENT', 'SUB_180', 'SUB_260')")
    plans = write_work(queryplan.plan_queries(queries, "query_id", "text").where("error IS NULL"), "plans")
    segments = queryplan.segments_of(plans, "query_id").select(F.concat_ws("/", F.col("query_id").cast("string"), "index").alias("unit"), "query_id", F.col("index").alias("segment_index"), "weight", "intent_ids", "text")
    found = _found(segments, visible, o, chunk_vectors, query_vectors)
    hits = write_work(found.join(segments.drop("text"), "unit"), "hits")  # every later stage builds on it; at most `candidates` rows a segment and branch
    local = ranking.hybrid_rrf(hits, _Z, {"LEXICAL": 0.2}, query="unit").select("unit", *_Z, "rank").join(segments.drop("text"), "unit")
    fused = write_work(ranking.cross_segment_rrf(local, _Z), "fused")
    proof = hits.join(_passed(hits), ["unit", *_Z], "left_semi").select("query_id", *_Z, F.explode_outer("intent_ids").alias("intent_id")).distinct()
    proof = write_work(proof.withColumn("intent_id", F.col("intent_id").cast("bigint")), "proof")
    evidence = fused.join(proof, ["query_id", *_Z], "left_semi")
    bound = bindings.where("representation_type = 'ORIGINAL' AND qdrant_sync_status = 'SYNCED'").groupBy(*_Z).agg(F.max("binding_id").alias("binding_id"))
    where = chunks.select(*_Z, F.coalesce("parent_id", "chunk_id").alias("parent_chunk_id"), "granularity")
    candidates = evidence.join(where, _Z).join(bound, _Z, "left")
    grouped = ranking.best_per_group(candidates, ["query_id", "access_zone_id", "parent_chunk_id"], [F.col("rank"), F.col("chunk_id")])
    outcomes = serving.hydrate(grouped.select("query_id", "access_zone_id", "binding_id", "chunk_id", "parent_chunk_id", "granularity", "score"), bindings, chunks, versions, o.level, o.as_of)
    direct = write_work(serving.settle(outcomes), "direct")
    if o.graph:
        seeds = ranking.ranked(direct, ["query_id"], [F.col("score").desc(), "chunk_id"], "seed_rank", 5)
        hop = graph.one_hop(seeds, edges, [*graph.DOMAIN, *graph.SIMILARITY, "CHUNK_NEXT_SIBLING", "CHUNK_PREVIOUS_SIBLING"], o.edges)
        s = graph.candidate_score(F.col("seed_score"), F.col("relation_type"), F.col("relation_score").cast("double"), F.lit(1))
        scored = hop.join(seeds.select("query_id", "access_zone_id", F.col("chunk_id").alias("seed_chunk_id"), F.col("score").alias("seed_score")), ["query_id", "access_zone_id", "seed_chunk_id"]).withColumn("score", s)
        related = write_work(scored.join(visible.select(*_Z), _Z, "left_semi").select("query_id", *_Z, "seed_chunk_id", "score"), "related")
        inherited = ranking.inherited_intents(proof.select("query_id", F.struct("access_zone_id", "chunk_id").alias("seed"), "intent_id", F.lit(True).alias("passed")))
        inherited = inherited.select("query_id", F.col("seed.access_zone_id").alias("access_zone_id"), F.col("seed.chunk_id").alias("seed_chunk_id"), F.explode("intent_ids").alias("intent_id"))
        proof = proof.unionByName(related.join(inherited, ["query_id", "access_zone_id", "seed_chunk_id"]).select("query_id", *_Z, "intent_id"))
    else:
        related = direct.limit(0)
    merged = ranking.merge_graph(direct, related.groupBy("query_id", *_Z).agg(F.max("score").alias("score")), _Z, max(CAP, o.contexts))
    merged = write_work(merged, "merged")
    text = serving.parent_context(merged.select("query_id", *_Z, "origins", "score", "rank"), chunks)
    diverse = write_work(_diverse(text, o.contexts, chunk_vectors), "diverse")
    budgeted = ranking.token_budget(diverse, "parent_text", o.budget)
    seen = serving.recheck(budgeted.select("query_id", *_Z, "parent_chunk_id", "origins", "score", "rank", "est_tokens", F.lit(None).cast("string").alias("binding_id")), bindings, chunks, versions, o.level, o.as_of).drop("binding_id")
    seen = write_work(seen, "seen")
    intents = queryplan.intents_of(plans, "query_id").select("query_id", F.col("id").cast("bigint").alias("intent_id"), "required", "weight")
    coverage = ranking.coverage(intents, seen.join(proof, ["query_id", *_Z]).select("query_id", "intent_id"))
    contexts = seen.join(coverage.where("status != 'INSUFFICIENT'").select("query_id"), "query_id", "left_semi")
    return {"hits": hits, "fused": fused, "evidence": evidence, "grouped": grouped, "hydrated": direct, "merged": merged, "diversified": diverse, "budgeted": budgeted, "visible": seen, "coverage": coverage, "contexts": contexts}


def _diverse(text: DataFrame, select: int, vectors: DataFrame | None) -> DataFrame:
    """The rows that MMR selects, ranked as selected. Scores are taken relative to the query's best, because fused
    ranks are far below similarities (INFERRED); the best direct row is protected."""
    key = F.to_json(F.struct(*_Z))
    rows = text.withColumn("key_", key).withColumn("part_", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    direct = F.array_contains("origins", "DIRECT")
    first = F.row_number().over(Window.partitionBy("query_id", direct).orderBy("rank"))
    rows = rows.withColumn("first_", direct & (first == 1))
    v = rows.join(vectors.select(*_Z, "vector"), _Z, "left") if vectors is not None else rows.withColumn("vector", F.lit(None).cast("array<double>"))
    chosen = ranking.mmr(v.select("query_id", "key_", F.col("part_").alias("score"), "vector", F.col("parent_text").alias("text"), "first_"), "key_", select, cap=CAP, protected="first_")
    return rows.drop("rank", "part_", "first_").join(chosen.select("query_id", "key_", F.col("position").alias("rank")), ["query_id", "key_"]).drop("key_")


def retrieve(queries: DataFrame, chunks: DataFrame, bindings: DataFrame, versions: DataFrame, edges: DataFrame, options: Options | None = None, chunk_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, access_zone_id, chunk_id, parent_chunk_id, origins, score, rank, est_tokens)."""
    return stages(queries, chunks, bindings, versions, edges, options, chunk_vectors, query_vectors)["contexts"]


def explain(queries: DataFrame, chunks: DataFrame, bindings: DataFrame, versions: DataFrame, edges: DataFrame, options: Options | None = None, chunk_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """What became of every candidate that a search found."""
    s = stages(queries, chunks, bindings, versions, edges, options, chunk_vectors, query_vectors)
    return ranking.stage_trace({n: s[n] for n in ("hits", "evidence", "grouped", "hydrated", "merged", "diversified", "budgeted", "visible", "contexts")}, ["query_id", *_Z])


def ingest(segments: DataFrame, profile: dict, version: str) -> dict[str, DataFrame]:
    """The tables that a batch of logical documents adds: chunks, their blocks, bindings, change events and the document traces."""
    from millrace.functions.text import uuid5

    doc = ["access_zone_id", "document_id", "document_version"]
    chunks = chunk_segments(segments, profile, version)
    bindings = chunks.select(*doc, "chunk_id", "parent_id", "granularity", uuid5(F.concat_ws("|", F.lit("binding"), "access_zone_id", "chunk_id")).alias("binding_id"), F.lit(1).cast("bigint").alias("payload_version"))
    return {
        "chunks": chunks,
        "block_map": chunks.select("access_zone_id", F.col("source_block_id").alias("block_id"), "chunk_id", "trace"),
        "bindings": bindings,
        "events": as_events(bindings, ["access_zone_id", "binding_id"], "UPSERT_POINT", "payload_version", {"chunk_id": F.col("chunk_id")}),
        "traces": document_trace(segments),
    }
