"""Fusion, grouping, merging, diversification and budgeting of ranked candidates. All queries are processed at once;
every window and aggregation is keyed by the query, so work spreads over queries. Where the reference behaviour is only known
from its documented contract the docstring says CONTRACT, where a choice is ours INFERRED."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Decimals at which scores are compared, so that ties do not hang on the order of additions.
DECIMALS = 9


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank", k: int | None = None) -> DataFrame:
    """1-based rank within by; with k only the first k (pruned before the shuffle's sort by the optimizer)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col(name) <= k)


def cross_segment_rrf(candidates: DataFrame, identity: Sequence[str], rrf_k: float = 60.0, limit: int | None = None, query: str = "query_id") -> DataFrame:
    """Candidates (query, *identity, segment_index, rank, weight, intent_ids).

    A candidate contributes weight / (max(k, 1) + max(rank, 1)) to each of its intents, or to its segment if it has none;
    the best contribution per intent counts, and they are added up. Ordered by score, number of segments, identity.
    """
    identity = list(identity)
    part = F.col("weight").cast("double") / (F.lit(max(rrf_k, 1.0)) + F.greatest("rank", F.lit(1)))
    rows = candidates.select(query, *identity, "segment_index", F.greatest("rank", F.lit(1)).alias("rank"), part.alias("part"), "intent_ids")
    keys = F.when(F.size("intent_ids") > 0, F.transform("intent_ids", lambda i: F.struct(F.lit(0).alias("kind"), i.cast("bigint").alias("id")))).otherwise(F.array(F.struct(F.lit(1).alias("kind"), F.col("segment_index").cast("bigint").alias("id"))))
    best = rows.select(query, *identity, "segment_index", "rank", "part", F.explode(keys).alias("key")).groupBy(query, *identity, "key").agg(
        F.max("part").alias("best"), F.collect_set("segment_index").alias("segments"), F.max_by(F.struct("segment_index", "part", "rank"), F.struct("part", -F.col("rank"), -F.col("segment_index"))).alias("top")
    )
    out = best.groupBy(query, *identity).agg(F.round(F.sum("best"), DECIMALS).alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("segments")))).alias("matched_segments"), F.max_by("top", F.struct("top.part", -F.col("top.rank"), -F.col("top.segment_index"))).alias("top"))
    out = out.select(query, *identity, "score", "matched_segments", F.col("top.segment_index").alias("best_segment_index"), F.col("top.rank").alias("best_local_rank"))
    return ranked(out, [query], [F.col("score").desc(), F.size("matched_segments").desc(), *[F.col(c).asc_nulls_first() for c in identity]], k=limit)


def hybrid_rrf(hits: DataFrame, identity: Sequence[str], weights: Mapping[str, float] | None = None, rrf_k: float = 60.0, query: str = "query_id") -> DataFrame:
    """R02 (CONTRACT): the sum of weight / (k + rank) over the branches a candidate is in; hits (query, *identity, branch, rank)."""
    w = F.lit(1.0)
    for b, x in (weights or {}).items():
        w = F.when(F.col("branch") == b, x).otherwise(w)
    best = hits.groupBy(query, *identity, "branch").agg(F.min("rank").alias("rank"))
    out = best.groupBy(query, *identity).agg(F.round(F.sum(w / (F.lit(rrf_k) + F.col("rank"))), DECIMALS).alias("score"), F.array_sort(F.collect_set("branch")).alias("branches"))
    return ranked(out, [query], [F.col("score").desc(), *identity])


def weighted_fusion(hits: DataFrame, identity: Sequence[str], weights: Mapping[str, float], normalized: bool = False, query: str = "query_id") -> DataFrame:
    """R03 (CONTRACT): the weighted sum of branch scores, scaled to [0, 1] within query and branch first if normalized;
    a branch whose scores are all equal counts as 1 (INFERRED). Branches without a weight add nothing."""
    best = hits.groupBy(query, *identity, "branch").agg(F.max(F.col("score").cast("double")).alias("score"))
    if normalized:
        w = Window.partitionBy(query, "branch")
        lo, hi = F.min("score").over(w), F.max("score").over(w)
        best = best.withColumn("score", F.when(hi == lo, 1.0).otherwise((F.col("score") - lo) / F.nullif(hi - lo, F.lit(0.0))))
    x = F.lit(0.0)
    for b, v in weights.items():
        x = F.when(F.col("branch") == b, v).otherwise(x)
    out = best.groupBy(query, *identity).agg(F.round(F.sum(x * F.col("score")), DECIMALS).alias("score"))
    return ranked(out, [query], [F.col("score").desc(), *identity])


def best_per_group(hits: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """K11 (CONTRACT), W03: the first row of each group."""
    return ranked(hits, group, order, "n_", 1).drop("n_")


def relevance(dense: Column, sparse: Column, lexical: Column, consistency: Column) -> Column:
    """struct<fused, final, decision>."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    dense, sparse, lexical = (F.coalesce(c, F.lit(0.0)) for c in (dense, sparse, lexical))
    fused = unit(0.55 * F.greatest(dense, F.lit(0.0)) + 0.25 * unit(sparse) + 0.20 * lexical)
    c = F.coalesce(consistency, F.lit(0.0))
    final = F.when(c > 0, unit(0.8 * fused + 0.2 * c)).otherwise(fused)
    # Thresholds of the decisions.
    decision = F.when(final >= 0.85, "RELEVANT").when(final >= 0.65, "PARTIALLY_RELEVANT").when(final >= 0.45, "UNCERTAIN").otherwise("NOT_RELEVANT")
    return F.struct(F.round(fused, DECIMALS).alias("fused"), F.round(final, DECIMALS).alias("final"), decision.alias("decision"))


def evidence_reason(passed: Column, exact: Column, dense: Column, sparse: Column) -> Column:
    """R13."""
    d, s = F.coalesce(dense, F.lit(0.0)), F.coalesce(sparse, F.lit(0.0))
    return (
        F.when(~passed, "INSUFFICIENT_EVIDENCE").when(exact > 0, "EXACT_TECHNICAL_MATCH").when((s >= d) & (s > 0), "SPARSE_EVIDENCE").when(d > 0, "DENSE_EVIDENCE").otherwise("LEXICAL_EVIDENCE")
    )


def no_answer_gate(mode: Column, score: Column, matched_terms: Column, exact: Column) -> Column:
    """R11 (CONTRACT; the way the clauses combine is INFERRED): whether a candidate is evidence at all."""
    least = F.when(mode == "DENSE", 0.25).when(mode == "SPARSE", 0.10).otherwise(0.30)
    boosted = F.when((exact > 0) & (score >= 2 * least), score * 1.5).otherwise(score)
    enough = (mode != "SPARSE") | (matched_terms >= 2) | (exact > 0)
    return (boosted >= least) & enough


def inherited_intents(evidence: DataFrame, query: str = "query_id") -> DataFrame:
    """A candidate found over the graph inherits the intents its seed proved: (query, seed, intent_ids)."""
    return evidence.where("passed").groupBy(query, "seed").agg(F.array_sort(F.collect_set("intent_id")).alias("intent_ids"))


def coverage(intents: DataFrame, covered: DataFrame, query: str = "query_id") -> DataFrame:
    """Intents (query, intent_id, required, weight) against the proven (query, intent_id)."""
    hit = intents.where("required").join(covered.select(query, "intent_id").distinct().withColumn("hit", F.lit(True)), [query, "intent_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    every = intents.select(query).distinct()
    out = hit.groupBy(query).agg(F.count("*").alias("required_total"), F.count_if("hit").alias("required_covered"), F.sum("weight").alias("w"), F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0.0)).alias("c"), F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("intent_id")))).alias("uncovered"))
    t, c = F.coalesce("required_total", F.lit(0)), F.coalesce("required_covered", F.lit(0))
    status = F.when((t == 0) | (c == 0), "INSUFFICIENT").when(t == c, "FOUND").otherwise("DEGRADED")
    ratio = F.when(F.col("w") > 0, F.round(F.col("c") / F.col("w"), DECIMALS)).otherwise(0.0)
    return every.join(out, query, "left").select(query, t.alias("required_total"), c.alias("required_covered"), ratio.alias("ratio"), status.alias("status"), F.coalesce("uncovered", F.array().cast("array<bigint>")).alias("uncovered"))


def segment_coverage(segments: DataFrame, hits: DataFrame, query: str = "query_id") -> DataFrame:
    """Segments (query, segment_index, required) against the segments that brought in results, (query, segment_index): how many
    of the required ones did, which did not, and the status, read as for intents. Repeated rows count once."""
    s = segments.groupBy(query, "segment_index").agg(F.max("required").alias("required"))
    hit = s.join(hits.select(query, "segment_index").distinct().withColumn("hit", F.lit(True)), [query, "segment_index"], "left")
    need, have = F.col("required"), F.col("required") & F.col("hit").isNotNull()
    g = hit.groupBy(query).agg(F.count_if(need).alias("required_total"), F.count_if(have).alias("required_covered"), F.array_sort(F.collect_list(F.when(need & F.col("hit").isNull(), F.col("segment_index")))).alias("uncovered"))
    status = F.when((F.col("required_total") == 0) | (F.col("required_covered") == 0), "INSUFFICIENT").when(F.col("required_total") == F.col("required_covered"), "FOUND").otherwise("DEGRADED")
    return g.select(query, "required_total", "required_covered", "uncovered", status.alias("status"))


def checked_enrichments(rows: DataFrame, key: Sequence[str], source: str, variants: str, most_bytes: int = 4096, least: float = 0.35) -> DataFrame:
    """(*key, variant, overlap, verdict) of the variants (array<string>) made of a source text: VALIDATED if at least the given
    share of the variant's words is in the source, REJECTED if it has none, else UNCERTAIN. Of variants alike but for case the first
    stays; null ones, those of more than most_bytes bytes and those equal to the source are dropped."""
    from millrace.functions.text import lexical_overlap, word_set

    kept = F.filter(F.coalesce(F.col(variants), F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.octet_length(v) <= most_bytes) & ~v.eqNullSafe(F.col(source)))
    low = F.transform("kept_", lambda v: F.lower(v))
    one = rows.select(*key, F.col(source).alias("source_"), kept.alias("kept_")).select(*key, "source_", F.explode(F.filter("kept_", lambda v, i: F.array_position(low, F.lower(v)) == i + 1)).alias("variant"))
    share = F.round(lexical_overlap(F.col("variant"), F.coalesce("source_", F.lit(""))), DECIMALS)
    verdict = F.when(F.size(word_set(F.col("variant"))) <= 0, "REJECTED").when(share >= least, "VALIDATED").otherwise("UNCERTAIN")
    return one.select(*key, "variant", share.alias("overlap"), verdict.alias("verdict"))


def branch_summary(statuses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statuses (by, status) of SUCCESS, SUCCESS_EMPTY, SKIPPED_BUDGET or a failure: the overall status, and
    whether an empty result may be called no answer (only if every branch succeeded)."""
    ok = F.col("status").isin("SUCCESS", "SUCCESS_EMPTY")
    g = statuses.groupBy(*by).agg(F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "SKIPPED_BUDGET").alias("skipped"), F.count("*").alias("n"))
    failed = F.col("n") - F.col("ok") - F.col("skipped")
    overall = F.when(F.col("skipped") == F.col("n"), "SKIPPED").when(failed == 0, "SUCCESS").when(F.col("ok") == 0, "FAILED").otherwise("PARTIAL_FAILURE")
    return g.select(*by, overall.alias("overall"), (F.col("ok") == F.col("n")).alias("no_answer_eligible"))


def merge_graph(direct: DataFrame, graph: DataFrame, identity: Sequence[str], final: int, strategy: str = "SCORE_THEN_TRUNCATE", append: int = 5, graph_factor: float = 0.85, graph_bias: float = 0.0, query: str = "query_id", limit_mode: str = "STRICT", top_k: int = 0) -> DataFrame:
    """K14-K16, U07 (CONTRACT): one ranking of direct (query, *identity, score) and graph candidates.

    Scores are calibrated, an identity found both ways keeps its direct row with both origins. At least one direct row
    survives. GRAPH_AS_CONTEXT_APPEND adds at most min(append, final - direct) graph rows behind the direct ones. With limit_mode
    AT_LEAST_TOP_K the final limit is raised to top_k (INFERRED); STRICT keeps it.
    """
    final = max(final, top_k) if limit_mode == "AT_LEAST_TOP_K" else final
    identity = list(identity)
    both = direct.select(query, *identity, F.lit("DIRECT").alias("origin"), F.col("score").cast("double").alias("score")).unionByName(graph.select(query, *identity, F.lit("GRAPH").alias("origin"), (F.col("score") * graph_factor + graph_bias).cast("double").alias("score")))
    one = both.groupBy(query, *identity).agg(F.array_sort(F.collect_set("origin")).alias("origins"), F.max("score").alias("top"), F.max(F.when(F.col("origin") == "DIRECT", F.col("score"))).alias("d"))
    one = one.select(query, *identity, "origins", F.col("d").isNotNull().alias("direct"), F.round(F.when(F.lit(strategy == "SCORE_THEN_TRUNCATE"), F.col("top")).otherwise(F.coalesce("d", "top")), DECIMALS).alias("score"))
    order = [F.col("score").desc(), *identity]
    if strategy == "SCORE_THEN_TRUNCATE":
        first = F.row_number().over(Window.partitionBy(query, "direct").orderBy(*order))
        out = one.withColumn("saved", F.col("direct") & (first == 1))
        out = ranked(out, [query], [F.col("saved").desc(), *order], "place", final).drop("saved", "place")
        return ranked(out, [query], order).drop("direct")
    out = ranked(one, [query, "direct"], order, "nth")
    out = out.withColumn("room", F.lit(final) - F.least(F.count_if("direct").over(Window.partitionBy(query)), F.lit(final)))
    room = F.least(F.lit(append), F.col("room")) if strategy == "GRAPH_AS_CONTEXT_APPEND" else F.col("room")
    out = out.where(F.when(F.col("direct"), F.col("nth") <= final).otherwise(F.col("nth") <= room))
    return ranked(out, [query], [F.col("direct").desc(), "nth"]).drop("direct", "nth", "room")


def token_budget(rows: DataFrame, text: str, budget: int = 6000, reserved: int = 1000, margin: float = 1.2, per_chars: float = 3.0, query: str = "query_id") -> DataFrame:
    """K17 (CONTRACT; rounding and the reserve are INFERRED): the rows, best rank first, whose estimated tokens fit the
    budget together. The first row is kept even if it alone exceeds the budget."""
    est = F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(per_chars) * F.lit(margin)).cast("bigint")
    w = Window.partitionBy(query).orderBy("rank")
    out = rows.withColumn("est_tokens", est).withColumn("used_tokens", F.sum("est_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where((F.col("used_tokens") <= budget - reserved) | (F.col("rank") == 1))


def mmr(rows: DataFrame, key: str, select: int, lam: float = 0.75, cap: int = 80, query: str = "query_id", vector: str = "vector", text: str = "text", protected: str | None = None) -> DataFrame:
    """K12, K13 (CONTRACT): greedy diversification, lam * score - (1 - lam) * the greatest similarity to what is chosen.

    Of each query's rows (query, key, score, vector, text) the best cap, and all protected ones, are candidates; this bounds
    the group a task sees. Two rows are compared by the inner product of their unit vectors if both have one of equal
    length, else by the Jaccard similarity of their words. Protected rows are chosen first, never beyond select.
    Ties go to the smaller key. Returns (query, key, score, mmr_score, position).
    """
    p = F.col(protected) if protected else F.lit(False)
    some = ranked(rows.withColumn("protected_", F.coalesce(p, F.lit(False))), [query], [F.col("protected_").desc(), F.col("score").desc(), key], "n_", max(cap, select)).select(query, key, F.col("score").cast("double").alias("score"), F.col(vector).alias("v_"), F.col(text).alias("t_"), "protected_")
    kinds = dict(rows.dtypes)

    def choose(f):
        import numpy as np
        import pandas as pd

        f = f.sort_values(["score", key], ascending=[False, True], kind="stable").reset_index(drop=True)
        vs = [None if v is None or len(v) == 0 else np.asarray(v, dtype=float) for v in f["v_"]]
        vs = [None if v is None or not np.linalg.norm(v) else v / np.linalg.norm(v) for v in vs]
        ws = [frozenset((t or "").lower().split()) for t in f["t_"]]

        def sim(i, j):
            if vs[i] is not None and vs[j] is not None and len(vs[i]) == len(vs[j]):
                return float(vs[i] @ vs[j])
            u = ws[i] | ws[j]
            return len(ws[i] & ws[j]) / len(u) if u else 0.0

        n, worst = len(f), np.zeros(len(f))
        score = f["score"].to_numpy()
        left, out = list(range(n)), []
        while left and len(out) < select:
            pool = [i for i in left if f["protected_"][i]] or left
            gain = {i: round(lam * score[i] - (1 - lam) * (worst[i] if out else 0.0), DECIMALS) for i in pool}
            i = max(pool, key=lambda i: (gain[i], -i))
            out.append((i, gain[i]))
            left.remove(i)
            for j in left:
                worst[j] = max(worst[j], sim(i, j)) if len(out) > 1 else sim(i, j)
        at = [i for i, _ in out]
        return pd.DataFrame({query: f[query].to_numpy()[at], key: f[key].to_numpy()[at], "score": score[at], "mmr_score": [g for _, g in out], "position": np.arange(1, len(at) + 1, dtype="int32")})

    return some.groupBy(query).applyInPandas(choose, f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, score double, mmr_score double, position int")


def lexical_needed(queries: DataFrame, sparse_hits: DataFrame, least_hits: int = 10, least_score: float = 0.10, query: str = "query_id") -> DataFrame:
    """R15 (CONTRACT; reading the two limits as alternatives is INFERRED): the queries whose sparse branch found too few
    candidates, or only weak ones, and which therefore take the lexical branch too."""
    g = sparse_hits.groupBy(query).agg(F.count("*").alias("n_"), F.max("score").alias("top_"))
    weak = F.col("n_").isNull() | (F.col("n_") < least_hits) | (F.col("top_") < least_score)
    return queries.join(g, query, "left").where(weak).drop("n_", "top_")


def fetch_window(candidates: Column, final: Column, reserve: int, reserve_max: int, cap: int) -> Column:
    """How many candidates to hydrate."""
    return F.least(F.greatest(candidates, final + min(reserve, reserve_max)), F.greatest(F.lit(cap), final))


def stage_trace(stages: Mapping[str, DataFrame], identity: Sequence[str]) -> DataFrame:
    """Per candidate, which stages it passed and the first it was dropped at; stages in order, all keyed by identity."""
    names = list(stages)
    rows = None
    for i, n in enumerate(names):
        one = stages[n].select(*identity).distinct().withColumn("i", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    last = rows.groupBy(*identity).agg(F.max("i").alias("last"), F.array_sort(F.collect_set("i")).alias("seen"))
    name = F.array(*[F.lit(n) for n in names])
    return last.select(*identity, F.transform("seen", lambda i: F.element_at(name, i + 1)).alias("passed"), F.when(F.col("last") < len(names) - 1, F.element_at(name, F.col("last") + 2)).alias("dropped_at"))
