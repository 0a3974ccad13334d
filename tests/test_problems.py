"""Problems 1, 4 and 5 against plain Python on small random tables, with the awkward cases in them."""

import json
import random
from collections import defaultdict
from datetime import datetime, timezone

from pyspark.sql import functions as F

from millrace.operators.change_feed import apply_changes, publish_state
from millrace.operators.copy_diff import copy_differences, json_value
from millrace.operators.references import foreign_keys, orphan_counts, orphan_references, parent_keys
from millrace.storage import publish, read_published

EVENTS = "access_zone_id string, binding_id string, operation string, operation_version long, attempt_count int, v string, c long"


def brute_state(rows):
    changes = defaultdict(dict)
    codes = {"UPSERT_POINT": 1, "UPDATE_PAYLOAD": 2, "DELETE_POINT": 3}
    for z, b, op, v, a, *_ in rows:
        if z is not None and b is not None and v is not None:
            key = (z.lower(), b.lower())
            d = (-1 if a is None else a, codes.get((op or "").strip().upper(), 0))
            changes[key][v] = max(changes[key].get(v, d), d)
    out = {}
    for key, cs in changes.items():
        state = None
        for v in sorted(cs):
            a, op = cs[v]
            if op == 1 or op == 2 and state and not state[2]:
                state = (v, a, False)
            elif op == 3:
                state = (v, a, True)
        if state:
            out[key] = (state[0], None if state[1] < 0 else state[1], state[2])
    return out


def test_change_feed_equals_replay_in_order(spark):
    rng = random.Random(3)
    ops = ["UPSERT_POINT", "update_payload ", " Delete_Point", "UPDATE_PAYLOAD", "QUARANTINE_POINT", None]
    rows = []
    for _ in range(3000):
        b = "hot" if rng.random() < 0.4 else f"B{rng.randrange(150)}"
        rows.append((rng.choice(["Z1", "z1", "z2", None] if rng.random() < 0.1 else ["z1", "z2"]), rng.choice([b, b.upper(), b.lower()]) if rng.random() < 0.98 else None, rng.choice(ops), rng.choice([None, *range(-2, 40)]), rng.choice([None, 0, 1, 2, 5]), "x", 7))
    rows += rng.sample(rows, 500)
    rng.shuffle(rows)
    got = apply_changes(spark.createDataFrame(rows, EVENTS).repartition(5)).collect()
    assert {(r.access_zone_id, r.binding_id): (r.operation_version, r.attempt_count, r.deleted) for r in got} == brute_state(rows)
    assert len(got) == len({(r.access_zone_id, r.binding_id) for r in got})
    many = apply_changes(spark.createDataFrame(rows, EVENTS).repartition(5), buckets=23).collect()
    assert sorted(many) == sorted(got)


def test_merge_exports_bounded_tables():
    import pyarrow as pa
    from millrace.operators import change_feed as cf

    names = ["bucket", "k0", *[f"{s}_{x}" for s in cf._SEQS for x in "va"]]

    def batch(pairs):
        n = len(pairs)
        cols = [pa.array([b for b, _ in pairs], pa.int32()), pa.array([k for _, k in pairs])]
        return pa.record_batch(cols + [pa.array(range(n), pa.int64())] * 6, names=names)

    cf._ROWS, keep = 50, cf._ROWS
    try:
        rows = [(0, f"k{i // 2 % 300}") for i in range(1000)]
        out = [r for b in cf._merge_states(1, "200MB", 100)(iter([batch(rows[i : i + 70]) for i in range(0, 1000, 70)])) for r in b.to_pylist()]
        assert {r["k0"] for r in out} == {k for _, k in rows} and 300 < len(out) < 1000
        rows = sorted((i % 7, f"k{i % 300}-{i % 7}") for i in range(5000))
        out = [r for b in cf._merge_states(1, "200MB", bucketed=True)(iter([batch(rows[i : i + 333]) for i in range(0, 5000, 333)])) for r in b.to_pylist()]
        assert sorted((r["bucket"], r["k0"]) for r in out) == sorted(set(rows))
    finally:
        cf._ROWS = keep


def test_change_feed_empty_and_publication(spark, tmp_path):
    empty = spark.createDataFrame([], EVENTS)
    assert apply_changes(empty).count() == 0
    one = spark.createDataFrame([("z", "b", "UPSERT_POINT", 1, 0, "", 0)], EVENTS)
    target = f"file://{tmp_path}/state"
    assert publish_state(one, target).count() == 1
    gone = spark.createDataFrame([("z", "b", "UPSERT_POINT", 1, 0, "", 0), ("z", "b", "DELETE_POINT", 2, 0, "", 0)], EVENTS)
    assert [r.deleted for r in publish_state(gone, target).collect()] == [True]
    assert read_published(spark, target).first().deleted
    try:
        publish(one.select(F.raise_error(F.lit("lost")).alias("x")), target)
    except Exception:
        pass
    assert read_published(spark, target).first().deleted  # a failed run leaves the last snapshot in place


SIDE = "z string, p string, n long, s string, m string, t timestamp, k long, bucket string, row string"


def brute_diff(a, b):
    def newest(rows):
        out = {}
        for r in rows:
            if r[0] is not None and r[1] is not None:
                key = (r[0].lower(), r[1].lower())
                if key not in out or (r[5] is not None and (out[key][5] is None or r[5] > out[key][5])):
                    out[key] = r
        return out

    def value(x):
        try:
            return json.dumps(json.loads(x), sort_keys=True) if x is not None else None
        except ValueError:
            return x

    x, y = newest(a), newest(b)
    out = set()
    for key in x.keys() | y.keys():
        if key not in y:
            out.add((*key, "only_a"))
        elif key not in x:
            out.add((*key, "only_b"))
        else:
            out |= {(*key, f) for f, i, norm in (("n", 2, lambda v: v), ("s", 3, lambda v: v), ("m", 4, value)) if norm(x[key][i]) != norm(y[key][i])}
    return out


def test_copy_differences_equal_full_comparison(spark):
    rng = random.Random(9)
    t = lambda i: datetime(2025, 1, 1, 0, 0, i, tzinfo=timezone.utc)
    js = ['{"a":1,"b":[1,2]}', '{ "b": [1, 2], "a": 1 }', '{"a":2}', "{}", None, "no json", '{"a":"1.0"}', '{"a":"1"}']
    row = lambda i: (rng.choice(["z", "Z"]), f"p{i}" if rng.random() < 0.5 else f"P{i}", rng.choice([1, 2, None]), rng.choice(["x", "X", "", None]), rng.choice(js))
    base = [row(i) for i in range(400)]
    a = [(*r, t(5), 0, "", "") for r in base[:380]]
    b = [(*r, t(5), 0, "", "") for r in base[20:]]
    for rows in (a, b):
        rows += [(*row(i)[:5], t(4), 0, "", "") for i in range(30, 200)]  # earlier states
        rows += [(*row(i)[:5], t(9), 0, "", "") for i in rng.sample(range(60, 300), 40)]
        seen = {}
        for r in rows:  # one row per key and time, so that ties are exact repeats
            seen[(r[0].lower(), r[1].lower(), r[5])] = r
        rows[:] = list(seen.values()) * 2
        rows.append((None, "p1", 1, "x", None, t(1), 0, "", ""))
        rng.shuffle(rows)
    same = lambda c: (F.col(c), F.col(c))
    compare = {"n": same("n"), "s": same("s"), "m": (json_value(F.col("m")), json_value(F.col("m")))}
    da, db = (spark.createDataFrame(x, SIDE) for x in (a, b))
    want = brute_diff(a, b)
    for buckets, cells in ((8, 300), (3, 6)):  # the second set of tables is far too small: all buckets are compared whole
        got = copy_differences(da, db, ["z", "p"], compare, "t", "t", "only_a", "only_b", buckets, cells).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert copy_differences(da, da, ["z", "p"], compare, "t", "t", buckets=8, cells=300).count() == 0
    e = spark.createDataFrame([], SIDE)
    assert copy_differences(e, e, ["z", "p"], compare, "t", "t").count() == 0
    assert {r.difference for r in copy_differences(da, e, ["z", "p"], compare, "t", "t", "only_a", "only_b").collect()} == {"only_a"}


def test_json_values(spark):
    rows = [('{"a":1.0,"b":"1.0"}', '{"b":"1.0","a":1}', True), ('{"a":1.50}', '{"a":1.5}', True), ('{"a":null}', "{}", False), ("[1,2]", "[2,1]", False), ("x", "x", True), ("x", " x", False), ('{"a":"x:1.0,"}', '{"a":"x:1,"}', False)]
    got = spark.createDataFrame(rows, "a string, b string, same boolean").select((json_value(F.col("a")) == json_value(F.col("b"))).alias("is"), "same", "a", "b").collect()
    assert [(r.a, r.b) for r in got if r["is"] != r.same] == []


REF = "access_zone_id string, target string, id string, at timestamp, dead boolean, kind string"


def test_orphan_references(spark):
    t = lambda m, d=1: datetime(2025, m, d, tzinfo=timezone.utc)
    refs = [("Z", "A", "R1", t(3), False, "X"), ("z", "a", "r1", t(3), False, "X"), ("z", "gone", "r2", t(4), False, "X"), ("z", "nope", "r3", t(4), False, "X"), ("z", "young", "r4", t(5), False, "X"), ("z", "young", "r5", t(8), False, "X"), ("z", None, "r6", t(5), False, "X"), ("z", "nope", "r7", t(5), True, "X"), ("y", "a", "r8", t(5), False, "X"), ("z", "nope", "r9", None, False, "X")]
    refs += [("z", "a", f"h{i}", t(3), False, "X") for i in range(300)]
    parents = [("z", "a", "", t(1), False, ""), ("z", "A", "", t(1), False, ""), ("z", "gone", "", t(1), True, ""), ("z", "half", "", t(1), True, ""), ("z", "half", "", t(2), None, ""), ("z", "young", "", t(7), False, ""), ("z", "young", "", t(9), False, "")]
    d, p = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, REF)
    r = foreign_keys(d, "t", "f", F.lit("K"), F.lower("target"), "id", "at", F.expr("NOT dead"))
    k = parent_keys(p, "K", F.lower("target"), "at", F.col("dead"))
    got = {(x.row_key, x.reason, x.period) for x in orphan_references(r, k).collect()}
    assert got == {("r2", "deleted", "2025-04"), ("r3", "missing", "2025-04"), ("r4", "late", "2025-05"), ("r8", "missing", "2025-05"), ("r9", "missing", None)}
    assert {(x.reason, x.period): x.n_refs for x in orphan_counts(orphan_references(r, k)).collect()}[("missing", "2025-04")] == 1
    assert orphan_references(r.limit(0), k).count() == 0
    assert {x.reason for x in orphan_references(r, k.limit(0)).collect()} == {"missing"}
