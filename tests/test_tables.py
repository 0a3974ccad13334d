"""Serving, graph, audits, upserts, chunking, streams and sources on hand-made rows."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from millrace.operators import audits, chunking, graph, serving, upserts
from millrace.sources import records
from millrace.streaming import changes

AS_OF = "2025-06-01 00:00:00"


def ts(*a):
    return datetime(*a, tzinfo=timezone.utc)


CHUNK = "access_zone_id string, chunk_id string, document_id string, document_version long, root_id string, source_id string, parent_id string, granularity string, sequence_no int, content string, lifecycle_status string, source_block_id string"
BIND = "access_zone_id string, binding_id string, chunk_id string, chunk_granularity string, document_id string, document_version long, parent_chunk_id string, representation_type string, access_level int, lifecycle_status string, qdrant_sync_status string, expires_at timestamp"
VERSION = "access_zone_id string, document_id string, document_version long, status string, lifecycle_status string"


@pytest.fixture(scope="module")
def world(spark):
    def c(z, i, parent=None, g="PARENT", text="text", doc="d1", state="ACTIVE"):
        return (z, i, doc, 1, "r" + doc, "r" + doc, parent, g, 1, text, state, None)

    chunks = [c("z1", "p1"), c("z1", "k1", "p1", "SUB_180"), c("z2", "p1"), c("z1", "blank", text="  "), c("z1", "dead", state="DELETED"), c("z1", "kdead", "dead", "SUB_180"), c("z1", "old", doc="d2"), c("z1", "lost", "nowhere", "SUB_180"), c("z1", "hi"), c("z1", "exp"), c("z1", "edge")]

    def b(z, i, ch, g="PARENT", parent=None, level=1, state="ACTIVE", sync="SYNCED", exp=None, doc="d1"):
        return (z, i, ch, g, doc, 1, parent, "ORIGINAL", level, state, sync, exp)

    bindings = [
        b("z1", "b_p1", "p1"), b("z1", "b_k1", "k1", "SUB_180", "p1"), b("z1", "b_blank", "blank"), b("z1", "b_dead", "dead"), b("z1", "b_kdead", "kdead", "SUB_180", "dead"), b("z1", "b_old", "old", doc="d2"), b("z1", "b_lost", "lost", "SUB_180", "nowhere"),
        b("z1", "b_hi", "hi", level=3), b("z1", "b_exp", "exp", exp=ts(2025, 6, 1)), b("z1", "b_edge", "edge", exp=ts(2025, 6, 1, 0, 0, 1)), b("z1", "b_wrong", "k1", "SUB_260", "p1"), b("z1", "b_pend", "p1", sync="PENDING"),
    ]
    versions = [("z1", "d1", 1, "ACTIVE", "ACTIVE"), ("z2", "d1", 1, "ACTIVE", "ACTIVE"), ("z1", "d2", 1, "SUPERSEDED", "SUPERSEDED")]
    return spark.createDataFrame(chunks, CHUNK), spark.createDataFrame(bindings, BIND), spark.createDataFrame(versions, VERSION)


def test_hydration_gives_one_outcome_each(spark, world):
    chunks, bindings, versions = world
    rows = [("q", "z1", f"b_{n}", n, p, g) for n, p, g in (("p1", "p1", "PARENT"), ("k1", "p1", "SUB_180"), ("blank", "blank", "PARENT"), ("dead", "dead", "PARENT"), ("kdead", "dead", "SUB_180"), ("old", "old", "PARENT"), ("lost", "nowhere", "SUB_180"), ("hi", "hi", "PARENT"), ("exp", "exp", "PARENT"), ("edge", "edge", "PARENT"))]
    rows += [("q", "z1", "b_wrong", "k1", "p1", "SUB_180"), ("q", "z1", None, "p1", "p1", "PARENT"), ("q", "z2", "b_p1", "p1", "p1", "PARENT"), ("q", "z1", "b_pend", "p1", "p1", "PARENT"), ("q", "z1", "b_k1", "k1", "blank", "SUB_180"), ("q", "z1", "b_p1", "p1", "p1", "SOURCE")]
    d = spark.createDataFrame(rows, "query_id string, access_zone_id string, binding_id string, chunk_id string, parent_chunk_id string, granularity string")
    out = serving.hydrate(d, bindings, chunks, versions, 2, AS_OF)
    got = {(r.access_zone_id, r.binding_id, r.chunk_id, r.parent_chunk_id, r.granularity): r.outcome for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    want = ["HYDRATED", "HYDRATED", "EMPTY_CONTEXT", "VISIBILITY_REJECTED", "VISIBILITY_REJECTED", "VISIBILITY_REJECTED", "HYDRATION_MISSING", "VISIBILITY_REJECTED", "VISIBILITY_REJECTED", "HYDRATED"]
    want += ["BINDING_INVALID", "BINDING_INVALID", "BINDING_INVALID", "VISIBILITY_REJECTED", "BINDING_INVALID", "BINDING_INVALID"]
    assert [got[r[1:]] for r in rows] == want
    # the pending binding of p1 takes p1 and its child with it
    assert {r.binding_id for r in serving.settle(out).collect()} == {"b_edge"}
    assert serving.hydration_coverage(out).first().coverage == "PARTIAL"


def test_visibility_and_recheck(spark, world):
    chunks, bindings, versions = world
    seen = {(r.access_zone_id, r.chunk_id) for r in serving.visible_chunks(chunks, bindings, versions, 2, AS_OF).collect()}
    assert seen == {("z1", x) for x in ("p1", "k1", "blank", "lost", "kdead", "edge")}
    rows = [("z1", None, "k1", "p1"), ("z1", "b_k1", "k1", "p1"), ("z1", "b_wrong", "k1", "p1"), ("z1", "b_pend", "p1", "p1"), ("z1", "b_exp", "exp", "exp"), ("z1", "b_edge", "edge", "edge"), ("z1", None, "k1", "blank"), ("z1", None, "old", "old"), ("z1", "none", "p1", "p1")]
    d = spark.createDataFrame(rows, "access_zone_id string, binding_id string, chunk_id string, parent_chunk_id string")
    got = {(r.binding_id, r.chunk_id) for r in serving.recheck(d, bindings, chunks, versions, 2, AS_OF).collect()}
    assert got == {(None, "k1"), ("b_k1", "k1"), ("b_edge", "edge"), ("b_wrong", "k1")}
    p = spark.createDataFrame([("z", 1, "ACTIVE", 100), ("z", 2, "ACTIVE", 100), ("z", 1, "ACTIVE", 50), ("z", None, "ACTIVE", 100), ("y", 1, None, 100)], "access_zone_id string, access_level int, lifecycle_status string, expires_at_epoch long")
    assert serving.index_filter(p, 1, 50, ["z", "y"]).count() == 1


def test_one_hop(spark):
    e = lambda i, s, t, r, score=0.5, src="Q", rank=None, state="ACTIVE", q=False, z="z": (z, i, "CHUNK", s, "CHUNK", t, r, score, src, rank, state, q)
    rows = [e("e1", "a", "b", "EXPLAINS", 0.4), e("e2", "a", "c", "CHUNK_SEMANTIC_SIMILAR", 0.99), e("e3", "a", "a", "RELATED_TO"), e("e4", "x", "a", "RELATED_TO"), e("e5", "x", "a", "REQUIRES"), e("e6", "a", "d", "LEADS_TO"), e("e7", "a", "d", "EXPLAINS", q=True), e("e8", "a", "d", "EXPLAINS", state="DELETED"), e("e9", "a", "d", "EXPLAINS", z="y"), e("f1", "s", "t", "CHUNK_NEXT_SIBLING", 1.0), e("f2", "s", "u", "EXPLAINS", 0.1, "QUALITY_FIXTURE")]
    edges = spark.createDataFrame(rows, "access_zone_id string, edge_id string, source_node_type string, source_node_id string, target_node_type string, target_node_id string, relation_type string, relation_score float, relation_source string, relation_rank int, lifecycle_status string, quarantined boolean")
    seeds = spark.createDataFrame([("q", "z", "a", 1), ("q", "z", "s", 2)], "query_id string, access_zone_id string, chunk_id string, seed_rank int")
    got = graph.one_hop(seeds, edges, ["explains", "CHUNK_SEMANTIC_SIMILAR", "RELATED_TO", "REQUIRES", "LEADS_TO", "CHUNK_NEXT_SIBLING"], 40)
    assert {(r.seed_chunk_id, r.chunk_id) for r in got.collect()} == {("a", "b"), ("a", "c"), ("a", "x"), ("s", "t"), ("s", "u")}
    assert {r.chunk_id: r.seed_edge_rank for r in got.where("seed_chunk_id = 's'").collect()} == {"u": 1, "t": 2}
    # seeds take turns: two edges are one of each seed
    assert {r.seed_chunk_id for r in graph.one_hop(seeds, edges.where("edge_id NOT IN ('e3')"), ["EXPLAINS", "RELATED_TO"], 2).collect()} == {"a", "s"}
    r = spark.createDataFrame([(" explains",), ("CHUNK_SAME_TABLE",), ("LEADS_TO",), (None,)], "t string").select(graph.relation_class(F.col("t"))).collect()
    assert [x[0] for x in r] == ["SEMANTIC_DOMAIN", "STRUCTURAL", None, None]
    s = spark.range(1).select(graph.candidate_score(F.lit(0.01), F.lit("CHUNK_HAS_PARENT"), F.lit(1.0), F.lit(1)).alias("a"), graph.candidate_score(F.lit(0.5), F.lit("EXPLAINS"), F.lit(0.5), F.lit(2), power=2.0).alias("b")).first()
    assert abs(s.a - 0.095) < 1e-9 and abs(s.b - 0.5 * 0.25 * 0.75 * 0.7) < 1e-9


def test_depths_with_cycle_and_missing_parent(spark):
    s = spark.createDataFrame([("z", "a", None), ("z", "b", "a"), ("z", "c", "b"), ("z", "x", "y"), ("z", "y", "x"), ("z", "w", "x"), ("z", "o", "gone")], "access_zone_id string, block_id string, parent_block_id string")
    assert {r.block_id: r.depth for r in graph.block_depths(s).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "w": None, "o": 1}
    assert graph.block_depths(s.limit(0)).count() == 0
    chain = spark.createDataFrame([("z", f"b{i}", f"b{i - 1}" if i else None) for i in range(100)], "access_zone_id string, block_id string, parent_block_id string")
    assert {r.block_id: r.depth for r in graph.block_depths(chain).collect()} == {f"b{i}": i for i in range(100)}


def test_table_neighbours(spark):
    r = spark.createDataFrame([("z", "t1", 1, "a"), ("z", "t1", 2, "b"), ("z", "t2", 1, "c"), ("z", "t1", None, "d"), ("z", None, 1, "e"), ("y", "t1", 3, "f")], "zone string, tab string, i int, id string")
    assert {(x.source_id, x.target_id) for x in graph.table_neighbours(r, ["zone", "tab"], "i", "id").collect()} == {("a", "b"), ("b", "d")}


def test_guards_and_fences(spark):
    from millrace.operators import lifecycle as lc

    b = spark.createDataFrame([("z", "1", "DELETED", "2025-01-01 00:00:00", 3, None), ("z", "2", "DELETED", "2025-12-31 00:00:00", 1, True), ("z", "3", "ACTIVE", None, None, False), (None, "4", "DELETED", None, 9, True)], "zone string, id string, state string, at string, gen long, hold boolean").withColumn("at", F.to_timestamp("at"))
    gone = F.col("state") == "DELETED"
    held = lc.held_by(b, {"x": (b.where("hold"), ["zone", "id"]), "y": (b.where("gen > 0"), ["zone"])})
    assert {r.id: r.held_by for r in held.collect()} == {"1": ["y"], "2": ["x", "y"], "3": ["y"], "4": []}
    assert [r.id for r in lc.purgeable(b, gone, F.col("at"), "2026-01-01 00:00:00", 30, {}).collect()] == ["1"]
    p = spark.createDataFrame([("z", "1"), ("z", "2"), ("z", "3"), ("z", "9"), ("z", "9")], "zone string, id string")
    assert {r.id: r.verdict for r in lc.deletable_points(p, b, ["zone", "id"], gone, F.col("hold")).collect()} == {"1": "DELETABLE", "2": "SKIPPED_LEGAL_HOLD", "9": "ORPHAN"}
    e = spark.createDataFrame([("z", "1", 3), ("z", "1", 2), ("z", "2", 9), ("z", "3", 0), ("z", "9", 1)], "zone string, id string, v long")
    assert [(r.id, r.v, r.verdict) for r in lc.fenced_deletes(e, b, ["zone", "id"], "v", "gen", F.col("hold")).orderBy("id", "v").collect()] == [("1", 2, "STALE"), ("1", 3, "APPLY"), ("2", 9, "HELD"), ("3", 0, "APPLY"), ("9", 1, "ORPHAN")]
    t = lc.cascade(b.where(gone).select("zone"), ["zone"], {"p": (p, "id")}, b.where("hold AND id = '4'").select("zone"))
    assert {(r.table_name, r.row_id) for r in t.collect()} == {("p", "1"), ("p", "2"), ("p", "3"), ("p", "9")}
    assert lc.cascade(b.select("zone"), ["zone"], {"p": (p, "id")}, b.select("zone")).count() == 0


def test_zone_resolution(spark):
    from millrace.operators import lifecycle as lc

    reg = spark.createDataFrame([("i1", "0001"), ("i2", "0002"), ("i2", "0002")], "zone_id string, zone_code string")
    rows = [("order", ["0002", "0001", "0002"], None), ("both", ["0001"], ["i1"]), ("differ", ["0001"], ["i2"]), ("unknown", ["0009"], None), ("empty", [], None), ("nothing", None, None), ("ids", None, ["i2", "i1"])]
    r = lc.resolve_zones(spark.createDataFrame(rows, "r string, c array<string>, i array<string>"), reg, "r", "c", "i").collect()
    assert {x.r: (x.zones, x.error) for x in r} == {"order": (["i2", "i1"], None), "both": (["i1"], None), "differ": ([], "MISMATCH"), "unknown": ([], "UNKNOWN"), "empty": ([], "EMPTY"), "nothing": ([], "EMPTY"), "ids": (["i2", "i1"], None)}
    assert lc.resolve_zones(spark.createDataFrame(rows, "r string, c array<string>, i array<string>"), reg, "r", "c", "i", 1).where("r = 'order'").first().error == "TOO_MANY"


def test_audits(spark):
    d = spark.createDataFrame([("a", 1), ("b", None), ("c", 2), ("c", 3)], "k string, v int")
    e = spark.createDataFrame([("a", 1), ("c", 2), ("x", 1)], "k string, v int")
    assert {r.k for r in audits.orphans(d, e, ["k"]).collect()} == {"b"} and [r.k for r in audits.duplicates(d, ["k"]).collect()] == ["c"]
    assert {r.k: r.state for r in audits.compare_sets(d.where("k != 'c'"), e, "k", "v").collect()} == {"a": "MATCH", "b": "PENDING", "c": "UNKNOWN", "x": "UNKNOWN"}
    f = lambda x: audits.fingerprint({"t": (x, "v")}).first().hash
    assert f(d) == f(d.orderBy(F.desc("k"))) != f(e)
    assert audits.counts_object(d, "k").first().counts == {"a": 1, "b": 1, "c": 2}
    assert {r.check: r.n for r in audits.count_audit({"x": d.limit(0), "y": d}).collect()} == {"x": 0, "y": 4}
    assert [(r.k, r.lacks) for r in audits.incomplete(d, {"p": e, "q": d.where("k = 'a'")}, ["k"]).orderBy("k").collect()] == [("b", ["p", "q"]), ("c", ["q"])]
    t = spark.createDataFrame([(ts(2025, 5, 31, 23, 59, 0),), (ts(2026, 1, 1),), (None,)], "t timestamp")
    assert tuple(audits.expired_age(t, "t", AS_OF).first()) == (1, 60)


def test_upserts(spark):
    cur = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 7), (4, None, "n", 1)], "k int, c string, s string, ver long")
    new = spark.createDataFrame([(2, "B", "Y", 0), (3, "C", "Z", 0), (4, None, "m", 0)], "k int, c string, s string, ver long")
    got = {r.k: (r.c, r.s, r.ver) for r in upserts.upsert(cur, new, ["k"], ["c"]).collect()}
    assert got == {1: ("a", "x", 5), 2: ("B", "y", 7), 3: ("C", "Z", 0), 4: (None, "n", 1)}
    assert {r.k: r.c for r in upserts.upsert(cur, new, ["k"], ["c"], "ignore").collect()}[2] == "b"
    got = {r.k: (r.ver, r.effect) for r in upserts.bump_versions(cur, new.drop("ver"), ["k"], ["c"], "ver").collect()}
    assert got == {1: (5, "UNCHANGED"), 2: (8, "UPDATED"), 3: (1, "INSERTED"), 4: (1, "UNCHANGED")}
    e = spark.createDataFrame([(1, 5), (1, 4), (2, 7), (9, 1)], "k int, ver long")
    assert sorted(r.verdict for r in upserts.fenced(e, cur, ["k"], "ver", F.col("s") == "x").collect()) == ["APPLY", "ORPHAN", "STALE", "STALE"]
    assert {r.k: r.effect for r in upserts.register(cur, new, ["k"], "c").collect()} == {2: "CONFLICT", 3: "INSERTED", 4: "REPLAY"}
    x = spark.createDataFrame([(1, True, None), (2, False, True), (3, False, False), (5, None, None)], "k int, w boolean, h boolean")
    assert {r.k: r.action for r in upserts.repair_actions(x, spark.createDataFrame([(2,), (3,), (4,)], "k int"), ["k"], F.col("h"), F.col("w")).collect()} == {1: "UPSERT", 2: "HOLD", 3: "DELETE", 4: "DELETE"}
    ev = upserts.as_events(cur, ["k"], "UPSERT_POINT", "ver", {"c": F.col("c")})
    assert ev.select("id").distinct().count() == 3 and json.loads(ev.where("k = 1").first().payload) == {"c": "a"}


def test_packing_of_sentences():
    assert chunking.pack_sentences("a b. c d. e f.", 3, 1, 4) == ["a b. c d.", "e f."]
    assert chunking.pack_sentences("a b c d e f g", 3, 1, 4) == ["a b c", "d e f", "g"]
    assert chunking.pack_sentences("a b c. d.", 3, 2, 3) == ["a b c.", "d."] and chunking.pack_sentences("a b. d e. f.", 3, 2, 4) == ["a b. d e.", "f."]
    assert chunking.pack_sentences("a b c d. e f g h. i.", 4, 2, 5) == ["a b c d.", "e f g h. i."] and chunking.pack_sentences("", 3, 1, 4) == []
    chunking.check_profile(180, 130, 220, 35)
    with pytest.raises(ValueError):
        chunking.check_profile(180, 130, 150, 35)


def test_chunk_tree(spark):
    text = " ".join(f"Word{i} one two three four." for i in range(30))
    rows = [("z", "d", 1, "b1", 0, text, "PARAGRAPH"), ("z", "d", 1, "b2", 1, " \n ", "PARAGRAPH"), ("z", "d", 1, "b3", None, "Short one.", "TABLE"), ("y", "d", 1, "b1", 0, None, "LIST")]
    d = spark.createDataFrame(rows, "access_zone_id string, document_id string, document_version long, block_id string, order_index int, text string, block_type string")
    got = chunking.chunk_segments(d, {"PARENT": (60, 20, 80), "SUB_180": (20, 5, 25), "SUB_260": (30, 10, 40)}, "v1").collect()
    assert {r.source_block_id for r in got} == {"b1", "b3"} and len({r.chunk_id for r in got}) == len(got) == len({r.sequence_no for r in got})
    ids = {r.chunk_id: r for r in got}
    for r in got:
        assert (r.parent_id is None) == (r.granularity == "PARENT") and r.token_count == len(r.content.split())
        if r.parent_id:
            assert r.content in ids[r.parent_id].content
    for g in ("SUB_180", "SUB_260"):
        for p in (r for r in got if r.granularity == "PARENT"):
            assert " ".join(r.content for r in sorted(got, key=lambda r: r.sequence_no) if r.parent_id == p.chunk_id and r.granularity == g) == p.content
    again = chunking.chunk_segments(d.repartition(3), {"PARENT": (60, 20, 80), "SUB_180": (20, 5, 25), "SUB_260": (30, 10, 40)}, "v1").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    t = {(r.access_zone_id): r for r in chunking.document_trace(d).collect()}
    assert t["z"].primary_block_id == "b1" and t["z"].n_blocks == 3 and t["y"].trace_quality == "EXACT"


def test_stream_of_changes(spark, tmp_path):
    from millrace.operators.change_feed import apply_changes

    rows = [(str(i), "Z", f"B{i % 5}", ["UPSERT_POINT", "update_payload ", "DELETE_POINT"][i % 3], i // 2, i % 4, "FAILED" if i == 3 else "COMPLETED", None, 0, None, ts(2025, 1, 1, i % 24)) for i in range(40)]
    d = spark.createDataFrame(rows, changes.EVENT)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    d.where("id % 2 = 0").coalesce(1).write.parquet(src)
    changes.follow(changes.read_events(spark, src, 1), f"file://{out}", cp, max_attempts=3).awaitTermination()
    d.where("id % 2 = 1").coalesce(1).write.mode("append").parquet(src)
    changes.follow(changes.once(changes.read_events(spark, src, 1)), f"file://{out}", cp + "2", max_attempts=3).awaitTermination()
    got = apply_changes(changes.followed(spark, f"file://{out}")).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, apply_changes(d.where("id != 3")).collect()))
    assert [r.id for r in spark.read.parquet(f"file://{out}/dead_letters").select("id").distinct().collect()] == ["3"]


def test_sessions_as_stream(spark, tmp_path):
    src = str(tmp_path / "s")
    schema = "session_id string, block_id string, n_bytes long, staged_at timestamp, final boolean"
    a = [("s1", "b1", 10, ts(2025, 1, 1, 0, 0), False), ("s1", "b1", 10, ts(2025, 1, 1, 0, 1), False), ("s2", "b1", 5, ts(2025, 1, 1, 0, 0), False)]
    b = [("s1", "b2", 7, ts(2025, 1, 1, 0, 2), True)]
    c = [("s3", "b1", 1, ts(2025, 1, 1, 5, 0), False)]
    e = [("s4", "b1", 1, ts(2025, 1, 1, 6, 0), False)]
    for i, rows in enumerate((a, b, c, e)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{src}/part={i}")
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(src)
    q = changes.sessions(stream).writeStream.format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.session_id: (r.status, r.n_blocks, r.n_bytes) for r in spark.sql("SELECT * FROM sessions_out").collect()}
    assert got["s1"] == ("COMPLETED", 2, 17) and got["s2"] == ("EXPIRED", 1, 5) and "s4" not in got


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"query_id":"a","relevant":[{"document_id":"d","source_block_id":"b","relevance":3}]}\n\n{"query_id":"b","relevant":[]}\n')
    d = records.read_jsonl(spark, str(p), "judgment")
    assert d.count() == 2 and d.select(F.explode("relevant.relevance")).first()[0] == 3
    p.write_text('{"query_id": 1, "relevant": 7}\n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(p), "judgment").collect()
    assert records.schema_differences(d, "query_id int, x string") == ["query_id is string, not int", "missing x"] and not records.schema_differences(d, d.schema)
    out = f"file://{tmp_path}/report"
    one = spark.createDataFrame([(1,)], "a int")
    for n in (1, 2):
        records.write_report(one.union(one) if n == 2 else one, out)
        assert spark.read.json(out).count() == n
    assert records.exists(spark, out) and records.drop(spark, out) and records.drop(spark, out) and not records.exists(spark, out)
    target = f"file://{tmp_path}/tables"
    assert records.read_tables(spark, target) == {}
    for n in (1, 2):
        records.publish_tables({"a": one, "b": one.limit(n - 1)}, target)
        assert {k: v.count() for k, v in records.read_tables(spark, target).items()} == {"a": 1, "b": n - 1}


def test_blocks_are_cut_at_the_limits_of_the_service_only(spark, tmp_path):
    from millrace.plans.serving_queries import QUERIES

    rows = [("z", "d", 1, "top", None, "DOCUMENT", 0)] + [("z", "d", 1, f"s{i:03d}", "top", "PARAGRAPH", i) for i in range(130)] + [("z", "e", 1, f"e{i:02d}", None, "SECTION", i) for i in range(40)]
    spark.createDataFrame(rows, "access_zone_id string, document_id string, document_version long, block_id string, parent_block_id string, block_type string, order_index int").write.parquet(f"{tmp_path}/text_segments.parquet")
    c = "access_zone_id string, document_id string, document_version long, id string, root_id string, source_id string, parent_id string, granularity string, sequence_no int, token_count long, content string, source_block_id string, source_block_ids array<string>, profile_version string, lifecycle_status string, created_at timestamp"
    spark.createDataFrame([], c).write.parquet(f"{tmp_path}/generated_chunks.parquet")
    got = [r.block_id for r in QUERIES["graph_blocks"](spark, str(tmp_path)).collect()]
    assert len(got) == 141 and {f"s{i:03d}" for i in range(100)} | {f"e{i:02d}" for i in range(40)} | {"top"} == set(got)


def test_every_seed_of_a_zone_is_expanded(spark, tmp_path):
    from millrace.plans.serving_queries import QUERIES

    spark.createDataFrame([("Z", f"S{i:02d}") for i in range(60)] * 2, "seed_access_zone_id string, seed_chunk_id string").write.parquet(f"{tmp_path}/related_chunks.parquet")
    rows = [("z", f"e{i:02d}", "CHUNK", f"s{i:02d}", "CHUNK", f"t{i:02d}", "EXPLAINS", 0.5, "Q", 1, "ACTIVE", False, "d") for i in range(60)]
    e = "access_zone_id string, edge_id string, source_node_type string, source_node_id string, target_node_type string, target_node_id string, relation_type string, relation_score float, relation_source string, relation_rank int, lifecycle_status string, quarantined boolean, document_id string"
    spark.createDataFrame(rows, e).write.parquet(f"{tmp_path}/graph_edges.parquet")
    got = QUERIES["graph_one_hop"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(f"z/s{i:02d}", f"t{i:02d}") for i in range(60)} and len(got) == 60
