"""End-to-end retrieval on hand-made rows: every branch of the profile, the gate, coverage."""

import pytest

from millrace.plans import retrieve
from tests.test_tables import AS_OF, BIND, CHUNK, VERSION

EDGE = "access_zone_id string, edge_id string, source_node_type string, source_node_id string, target_node_type string, target_node_id string, relation_type string, relation_score float, relation_source string, relation_rank int, lifecycle_status string, quarantined boolean"
TEXTS = {
    "tech": "(pump_state_77), overheated; restart.",
    "weak": "Notes on basalt, pumps.",
    "plain": "how basalt forms in winter",
    "vec": "nothing shared whatsoever",
    "near": "linked from elsewhere",
}


@pytest.fixture(scope="module")
def world(spark):
    chunks = spark.createDataFrame([("z", i, "d", 1, "r", "r", None, "PARENT", 1, t, "ACTIVE", None) for i, t in TEXTS.items()], CHUNK)
    bindings = spark.createDataFrame([("z", f"b_{i}", i, "PARENT", "d", 1, None, "ORIGINAL", 1, "ACTIVE", "SYNCED", None) for i in TEXTS], BIND)
    versions = spark.createDataFrame([("z", "d", 1, "ACTIVE", "ACTIVE")], VERSION)
    edges = spark.createDataFrame([("z", "e", "CHUNK", "tech", "CHUNK", "near", "EXPLAINS", 0.9, "Q", 1, "ACTIVE", False)], EDGE)
    return chunks, bindings, versions, edges


QUERIES = [(1, "pump_state_77 overheated"), (2, "stone marble quartz granite lava basalt"), (3, "zzz yyy"), (4, "")]


def run(spark, world, profile, *vectors):
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    rows = retrieve.retrieve(q, *world, retrieve.Options(as_of=AS_OF, profile=profile), *vectors).collect()
    return {(r.query_id, r.chunk_id): r for r in rows}


def test_sparse_branch_finds_what_words_do_not(spark, world):
    got = run(spark, world, "BALANCED")
    # white-space words of the text have brackets, so only the sparse branch finds it; its graph neighbour comes with it
    assert set(got) == {(1, "tech"), (1, "near")}
    assert got[1, "tech"].origins == ["DIRECT"] and got[1, "near"].origins == ["GRAPH"] and got[1, "tech"]["rank"] == 1


def test_dense_branch_runs_where_vectors_are_given(spark, world):
    c = spark.createDataFrame([("z", "vec", [1.0, 0.0]), ("z", "weak", [0.0, 1.0]), ("y", "vec", [1.0, 0.0])], "access_zone_id string, chunk_id string, vector array<double>")
    v = spark.createDataFrame([(3, 0, [1.0, 0.1])], "query_id long, segment_index int, vector array<double>")
    assert set(run(spark, world, "BALANCED", c, v)) == {(1, "tech"), (1, "near"), (3, "vec")}
    assert set(run(spark, world, "SEMANTIC", c, v)) == {(3, "vec")}
    assert set(run(spark, world, "LEXICAL_STRICT", c, v)) == {(1, "tech"), (1, "near")}
    with pytest.raises(ValueError):
        run(spark, world, "SEMANTIC")


def test_trace_names_the_gate(spark, world):
    q = spark.createDataFrame(QUERIES, "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.dropped_at for r in retrieve.explain(q, *world, retrieve.Options(as_of=AS_OF)).collect()}
    # one ordinary word of six is no evidence
    assert got[2, "plain"] == got[2, "weak"] == "evidence" and got[1, "tech"] is None


def test_diversity_keeps_the_best_direct_row(spark):
    rows = [(1, "z", "a", ["DIRECT"], 0.016, 2, "x y"), (1, "z", "b", ["GRAPH"], 0.02, 1, "x y"), (1, "z", "c", ["GRAPH"], 0.015, 3, "w v")]
    d = spark.createDataFrame(rows, "query_id long, access_zone_id string, chunk_id string, origins array<string>, score double, rank int, parent_text string")
    got = retrieve._diverse(d, 2, None).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"]) for r in got] == [("a", 1), ("c", 2)]
