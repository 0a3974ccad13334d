"""Search, ranking and metrics on hand-made rows: ties, empty inputs, bounds."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import metrics, ranking, search


def test_dense_search_equals_brute_force_whatever_the_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).round(3)
    v[7] = v[3]  # ties
    v[9] = 0
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(300)] + [(300, None, 0), (301, [], 0)]
    d = spark.createDataFrame(rows, "id long, e array<float>, zone int")
    q = d.where("id % 20 = 0 OR id = 3").withColumnRenamed("id", "q")
    f = v.astype(np.float32).astype(float)
    n = f / np.maximum(np.linalg.norm(f, axis=1, keepdims=True), 1e-300)
    for block, parts in ((1024, 1), (4, 7)):
        got = search.dense_topk(q, d.repartition(parts), 5, "q", ["id"], "e", same="zone", not_self="id", block=block).collect()
        for a in [i for i in range(300) if i % 20 == 0 or i == 3]:
            want = sorted(((-round(float(n[a] @ n[b]), 6), b) for b in range(300) if b % 3 == a % 3 and b != a and b != 9))[:5]
            assert [(r.id, r.rank) for r in sorted(got, key=lambda r: r.rank) if r.q == a] == [(b, k + 1) for k, (_, b) in enumerate(want)]
    assert search.dense_topk(q.limit(0), d, 5, "q", ["id"], "e").count() == 0
    assert search.dense_topk(q, d.limit(0), 5, "q", ["id"], "e").count() == 0


def test_the_flagship_search_reaches_every_row(spark, sf):
    import __spark_entry__ as e

    v = {r.vec_id: (r.label, np.array(r.embedding, dtype=float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    n = {i: x / np.linalg.norm(x) for i, (_, x) in v.items()}
    want = {}
    for q in [i for i in v if i % 20 == 0]:
        best = sorted((-round(float(n[q] @ n[i]), 6), i) for i in v if i != q and v[i][0] == v[q][0])[:5]
        want |= {(q, i): rank + 1 for rank, (_, i) in enumerate(best)}
    got = {(r.query_id, r.vec_id): r["rank"] for r in e.entry(spark).collect()}
    assert got == want and {i % 4 for _, i in got} == {0, 1, 2, 3}


def test_sparse_and_lexical_search(spark):
    c = spark.createDataFrame([(1, [1, 2], [0.6, 0.8]), (2, [2], [1.0]), (3, [], []), (4, None, None), (5, [9], [1.0])], "id long, indices array<long>, values array<double>")
    q = spark.createDataFrame([(10, [2, 3], [1.0, 5.0]), (11, [], [])], "q long, indices array<long>, values array<double>")
    assert [(r.q, r.id, r.score) for r in search.sparse_topk(q, c, 5, "q", ["id"]).orderBy("rank").collect()] == [(10, 2, 1.0), (10, 1, 0.8)]
    t = spark.createDataFrame([(1, "red  Apple pie"), (2, "apple red"), (3, ""), (4, None), (5, "pear"), (6, "Apple Red Apple")], "id long, text string")
    got = search.lexical_topk(spark.createDataFrame([(1, "red apple"), (2, "  ")], "q long, text string"), t, 9, "q", ["id"]).orderBy("rank").collect()
    assert [(r.id, r.score) for r in got] == [(1, 2.0), (6, 2.0), (2, 1.0)]


def test_sparse_search_equals_brute_force_whatever_the_blocks(spark):
    rng = random.Random(3)
    vector = lambda: {t: rng.choice([0.125, 0.25, 0.5, 1.0, -0.5]) for t in rng.sample(range(40), rng.randint(0, 9))}
    c, q = [vector() for _ in range(700)], [vector() for _ in range(30)]
    frame = lambda vs, key: spark.createDataFrame([(i, list(v), list(v.values())) for i, v in enumerate(vs)], f"{key} long, indices array<long>, values array<double>")
    want = {}
    for a, x in enumerate(q):
        scores = [(-sum(w * y.get(t, 0) for t, w in x.items()), b) for b, y in enumerate(c)]
        want |= {(a, rank + 1): (b, -s) for rank, (s, b) in enumerate(sorted(p for p in scores if p[0] < 0)[:4])}
    for block, parts, once in ((None, 1, False), (7, 5, True)):
        got = search.sparse_topk(frame(q, "q"), frame(c, "id").repartition(parts), 4, "q", ["id"], block=block, once=once).collect()
        assert {(r.q, r["rank"]): (r.id, r.score) for r in got} == want and len(got) == len(want)


def test_the_sparse_query_explodes_no_tokens(spark, sf):
    import __spark_entry__ as e

    plan = e.queries()["search_sparse"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # tokens are not exploded


def test_neighbours_respects_the_group_limit(spark):
    rows = [("a", i, [1.0, i / 10]) for i in range(5)] + [("b", i, [1.0, 0.0]) for i in range(9)] + [("c", 1, None), ("c", 2, [0.0, 0.0])]
    d = spark.createDataFrame(rows, "g string, k long, v array<float>")
    got = search.neighbours(d, "g", "k", "v", k=2, most_rows=8).collect()
    assert {r.g for r in got} == {"a"} and all(r.source != r.target for r in got) and max(r["rank"] for r in got) == 2


def test_neighbours_of_large_groups_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", i, [float(x) for x in rng.normal(size=4).round(2)]) for i in range(620)] + [("cool", i, [float(x) for x in rng.normal(size=4).round(2)]) for i in range(40)] + [(None, 1, [1.0] * 4), (None, 2, [1.0] * 4)]
    d = spark.createDataFrame(rows, "g string, k int, v array<float>").repartition(5)
    want = set()
    for g, n in (("hot", 620), ("cool", 40)):
        v = np.array([r[2] for r in rows if r[0] == g], dtype=np.float32).astype(float)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        s = np.rint(v @ v.T * 1_000_000).astype(int)
        for i in range(n):
            best = sorted((-int(s[i, j]), j) for j in range(n) if j != i and s[i, j] >= 700_000)[:3]
            want |= {(g, i, j, rank + 1) for rank, (_, j) in enumerate(best)}
    for within, block in ((2048, 1024), (100, 128), (10, 128)):
        got = search.neighbours(d, "g", "k", "v", within=within, block=block).collect()
        assert len(got) == len(want) and {(r.g, r.source, r.target, r["rank"]) for r in got} == want


def test_segment_fusion_takes_the_best_per_intent(spark):
    rows = [(1, "a", 0, 1, 1.0, [7]), (1, "a", 1, 2, 1.0, [7]), (1, "a", 2, 1, 0.5, []), (1, "b", 0, 1, 1.0, [7, 8]), (1, "c", 3, 0, 1.0, [])]
    got = ranking.cross_segment_rrf(spark.createDataFrame(rows, "query_id long, id string, segment_index int, rank int, weight double, intent_ids array<long>"), ["id"], 60.0).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert math.isclose(got[1].score, 1 / 61 + 0.5 / 61, abs_tol=1e-8) and got[1].matched_segments == [0, 1, 2] and got[1].best_segment_index == 0


def test_merge_keeps_a_direct_row(spark):
    d = spark.createDataFrame([(1, "d", 0.1)], "query_id long, id string, score double")
    g = spark.createDataFrame([(1, x, 0.9) for x in "efgh"] + [(1, "d", 0.99)], "query_id long, id string, score double")
    got = ranking.merge_graph(d, g, ["id"], 3).collect()
    assert {r.id for r in got} >= {"d"} and len(got) == 3
    got = ranking.merge_graph(d, g, ["id"], 3, "GRAPH_AS_CONTEXT_APPEND", append=1).orderBy("rank").collect()
    assert [r.id for r in got][0] == "d" and len(got) == 2 and got[0].origins == ["DIRECT", "GRAPH"] and got[0].score == 0.1


def test_mmr(spark):
    rows = [(1, "a", 1.0, [1.0, 0.0], "x y", False), (1, "b", 0.99, [1.0, 0.01], "x y", False), (1, "c", 0.7, [0.0, 1.0], "z", False), (1, "p", 0.1, None, "x y", True), (1, "q", 0.6, [1.0], "", None)]
    d = spark.createDataFrame(rows, "query_id long, k string, score double, vector array<double>, text string, keep boolean")
    got = ranking.mmr(d, "k", 4, 0.5, protected="keep").orderBy("position").collect()
    assert [r.k for r in got][0] == "p" and len(got) == 4 and [r.k for r in got].index("c") < ([r.k for r in got] + ["b"]).index("b")
    assert ranking.mmr(d, "k", 1, 0.5, protected="keep").first().k == "p"
    assert ranking.mmr(d.limit(0), "k", 3).count() == 0


def test_budget_keeps_the_first_row(spark):
    d = spark.createDataFrame([(1, 1, "x" * 90000), (1, 2, "x"), (2, 1, "x" * 300), (2, 2, None), (2, 3, "x" * 20000)], "query_id long, rank int, t string")
    assert {(r.query_id, r["rank"]) for r in ranking.token_budget(d, "t").collect()} == {(1, 1), (2, 1), (2, 2)}


def test_coverage_and_branches(spark):
    i = spark.createDataFrame([(1, 1, True, 1.0), (1, 2, True, 0.5), (2, 1, False, 1.0), (3, 1, True, 1.0)], "query_id long, intent_id long, required boolean, weight double")
    c = spark.createDataFrame([(1, 1), (3, 1), (3, 1), (9, 9)], "query_id long, intent_id long")
    got = {r.query_id: r for r in ranking.coverage(i, c).collect()}
    assert (got[1].status, got[2].status, got[3].status) == ("DEGRADED", "INSUFFICIENT", "FOUND") and got[1].uncovered == [2] and math.isclose(got[1].ratio, 2 / 3, abs_tol=1e-8)
    s = spark.createDataFrame([(1, "SUCCESS"), (1, "TIMEOUT"), (2, "SKIPPED_BUDGET"), (3, "SUCCESS_EMPTY"), (4, "TIMEOUT")], "q long, status string")
    assert {r.q: (r.overall, r.no_answer_eligible) for r in ranking.branch_summary(s, ["q"]).collect()} == {1: ("PARTIAL_FAILURE", False), 2: ("SKIPPED", False), 3: ("SUCCESS", True), 4: ("FAILED", False)}


def test_scores(spark):
    one = spark.range(1)
    r = one.select(ranking.relevance(F.lit(1.0), F.lit(9.0), F.lit(1.0), F.lit(0.5)).alias("a"), ranking.relevance(F.lit(-1.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("double")).alias("b"), ranking.fetch_window(F.lit(8), F.lit(5), 5, 10, 7).alias("w")).first()
    assert (r.a.final, r.a.decision, r.b.final, r.b.decision, r.w) == (0.9, "RELEVANT", 0.0, "NOT_RELEVANT", 7)
    g = spark.createDataFrame([("DENSE", 0.25, 0, 0), ("SPARSE", 0.2, 1, 0), ("SPARSE", 0.2, 2, 0), ("SPARSE", 0.09, 5, 0), ("HYBRID", 0.29, 0, 0)], "m string, s double, t int, x int")
    assert [x[0] for x in g.select(ranking.no_answer_gate(*map(F.col, "mstx"))).collect()] == [True, False, True, False, False]
    e = spark.createDataFrame([(1, "s", 3, True), (1, "s", 2, True), (1, "s", 3, True), (1, "s", 9, False)], "query_id int, seed string, intent_id int, passed boolean")
    assert ranking.inherited_intents(e).first().intent_ids == [2, 3]


def test_metrics(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "n", 3)], "query_id int, k string, rank int")
    j = spark.createDataFrame([(1, "y", 3), (1, "m", 1), (2, "z", 1), (3, "w", 0)], "query_id int, k string, relevance int")
    got = {r.query_id: r for r in metrics.ir_metrics(a, j, "k").collect()}
    assert set(got) == {1, 2} and got[1].rr10 == 0.5 and got[1].recall5 == 0.5 and got[2].ndcg10 == 0.0
    assert math.isclose(got[1].ndcg10, (7 / math.log2(3)) / (7 / 1 + 1 / math.log2(3)), abs_tol=1e-8)
    rng = random.Random(1)
    xs = [rng.randrange(50) for _ in range(101)] + [None]
    p = metrics.nearest_rank_up(spark.createDataFrame([(1, x) for x in xs], "g int, v int"), ["g"], "v", [0.0, 0.5, 0.95, 1.0]).first()
    s = sorted(x for x in xs if x is not None)
    assert [p.p0, p.p50, p.p95, p.p100] == [s[math.ceil(100 * q)] for q in (0, 0.5, 0.95, 1)]
    w = spark.range(1).select(metrics.wilson(F.lit(0), F.lit(0)).alias("z"), metrics.wilson(F.lit(5), F.lit(10)).alias("h")).first()
    assert (w.z.low, w.z.high) == (0.0, 1.0) and 0.23 < w.h.low < 0.24 and 0.76 < w.h.high < 0.77


def test_trace(spark):
    s = lambda *k: spark.createDataFrame([(x,) for x in k], "k string")
    got = {r.k: (r.passed, r.dropped_at) for r in ranking.stage_trace({"a": s("x", "y", "x"), "b": s("x"), "c": s("x")}, ["k"]).collect()}
    assert got == {"x": (["a", "b", "c"], None), "y": (["a"], "b")}


def test_lexical_branch_is_needed_where_the_sparse_one_is_weak(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    h = spark.createDataFrame([(1, 0.5)] * 12 + [(2, 0.05)] * 12, "query_id int, score double")
    assert {r.query_id for r in ranking.lexical_needed(q, h).collect()} == {2, 3}
