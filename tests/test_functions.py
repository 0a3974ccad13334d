import math
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import querytext, sparse, text, vectors

ODD = [None, "", "  a  b c\n", "Ünïcödé  text", "x" * 5000, "One. Two! Three?\nFour"]


def col(spark, values, kind="string"):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"t {kind}, i int").orderBy("i")


def test_text(spark):
    r = col(spark, ODD).select(text.normalize_space(F.col("t")).alias("n"), text.count_words(F.col("t")).alias("w"), text.sentences(F.coalesce("t", F.lit(""))).alias("s"), text.label(F.lit(""), F.col("t")).alias("l")).collect()
    assert [x.n for x in r] == [None, "", "a b c", "Ünïcödé text", "x" * 5000, "One. Two! Three? Four"]
    assert [x.w for x in r] == [0, 0, 3, 2, 1, 4]
    assert r[5].s == ["One.", "Two!", "Three?", "Four"] and r[1].s == []
    assert r[4].l == "x" * 80


def test_identifiers_and_numbers(spark):
    names = ["a", "", "é中", "x" * 100]
    r = col(spark, names).select(text.uuid5(F.col("t")).alias("u"), text.sparse_index(F.lit("path"), F.col("t")).alias("x")).collect()
    assert [x.u for x in r] == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert all(10**9 <= x.x < 2 * 10**9 for x in r)
    r = col(spark, [0, 1, 2, 10, 99], "int").select(text.backoff(F.col("t"), 5, 300).alias("b"), text.length_bucket(F.col("t") * 60).alias("k")).collect()
    assert [x.b for x in r] == [5, 5, 10, 300, 300] and [x.k for x in r] == [64, 64, 128, 512, 512]
    words = ["queries", "ties", "running", "ring", "edges", "used", "cats", "gas", "boxes"]
    assert [x[0] for x in col(spark, words).select(text.stem(F.col("t"))).collect()] == ["query", "ties", "runn", "ring", "edge", "used", "cats", "gas", "boxe"]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0]), (None, [1.0])]
    r = spark.createDataFrame(rows, "a array<float>, b array<float>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.normalize(F.col("a")).alias("n")).collect()
    assert [x.c for x in r] == [1.0, -1.0, 0.0, 0.0, 0.0, 0.0] and [x.n for x in r][2:4] == [None, None]
    d = spark.createDataFrame([([1, 5, 9], [1.0, 2.0, 3.0], [5, 9, 10], [4.0, 0.5, 7.0])], "ai array<long>, av array<float>, bi array<long>, bv array<float>")
    assert d.select(vectors.sparse_dot(*map(F.col, ("ai", "av", "bi", "bv")))).first()[0] == 9.5


def brute_tokens(t):
    edge = " \t\n\r\f\v,;:()[]{}\"'"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    out = []
    for name, (pattern, _) in sparse.CLASSES.items():
        for m in re.finditer(pattern, t):
            tok = m[0].strip(edge)
            tok = low(tok) if name in ("ordinary_word", "uuid") else tok
            if not tok or name == "ordinary_word" and tok in sparse.STOP_WORDS:
                continue
            more = []
            if name == "ordinary_word":
                s = tok[:-3] + "y" if len(tok) > 5 and tok.endswith("ies") else next((tok[: -len(x)] for x in ("ing", "ed", "es", "s") if len(tok) > len(x) + 3 and tok.endswith(x)), tok)
                more += [s] if s != tok and s not in sparse.STOP_WORDS else []
            if name in sparse._FOLDED and low(tok) != tok:
                more.append(low(tok))
            if name in ("underscore_identifier", "path", "grpc_method"):
                parts = [p for p in tok.split("_" if name == "underscore_identifier" else "/") if len(p) >= 2]
                more += [p for p in (parts if name == "grpc_method" else map(low, parts)) if p != tok]
            out += [(name, x) for x in [tok, *more]]
    return sorted(out)


def test_sparse_tokens_equal_brute_force(spark):
    texts = ["Connect to 10.0.0.1:8080 or localhost:9000, see /api/v1/Documents (config_file.yaml)", "ERR-6892 in RetrievalFacade/RetrieveContext at v12/fix3; ID 550E8400-e29b-41d4-a716-446655440000", "The queries are running while studies failed 404 times abc123 9lives max_Overlaps", "", "the of and", "Тест ünïcode_Name x_1", "a.b.cc foo-bar-BAZ __x__ {\"k_1\": 'v'}"]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in sparse.token_rows(d, ["i"], "t").collect():
        got.setdefault(r.i, []).append((r["class"], r.token))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == brute_tokens(t), t
    v = {r.i: r for r in sparse.encode(d, ["i"], "t", max_non_zero=5).collect()}
    assert all(r.indices == sorted(r.indices) and len(r.indices) <= 5 for r in v.values()) and 3 not in v and 4 not in v
    full = sparse.encode(d, ["i"], "t").where("i = 0").first()
    assert math.isclose(sum(x * x for x in full["values"]), 1.0, rel_tol=1e-9)


def test_vectors_of_words_equal_those_of_exploded_tokens(spark):
    odd = [f"ab{c}cd{c}12{c}34 {c}{c}{c} v1{c} X_{c}_Y_z 1.2.3.{c} foo-{c}1 /a{c}b/c" for c in [chr(i) for i in (*range(1, 0x250), *range(0x2000, 0x2500))] + ["\u0301", "\u0661", "\u2167", "\u24b6", "\u200d", "\u203f", "\U0001f130", "\U0001f14a", "\U0001d7d9", "\u4e2d"]]
    texts = [*odd, None, "", "the of and", "word " * 3000, "".join(f"t{i} Z_{i}y " for i in range(900)), "ERR-1 ERR-1 err-1", "/" * 70 + "a" * 5000]
    d = spark.createDataFrame([(i % (len(texts) - 3), t) for i, t in enumerate(texts)], "i int, t string")  # three keys have two texts
    for min_weight, most in ((0.0, 512), (2.1, 3)):
        want = {r.i: r for r in sparse.vectors(sparse.term_weights(d, ["i"], "t", min_weight), ["i"], most).collect()}
        got = {r.i: r for r in sparse.encode(d, ["i"], "t", min_weight, most).collect()}
        assert got.keys() == want.keys() and all(got[i].indices == want[i].indices and np.allclose(got[i]["values"], want[i]["values"], rtol=1e-12) for i in want)


def test_kept_words_are_bounded(monkeypatch):
    texts = [None, "", *(f"w{i} common word{i % 7} 10.0.0.{i}" for i in range(200)), ""]
    flat = lambda parts: [(int(i), ids, values) for rows, counts, index, value in parts for i, ids, values in zip(rows, np.split(index, np.cumsum(counts)), np.split(value, np.cumsum(counts)))]  # noqa: B905, E731
    want = flat(sparse.Encoder(0.0, 512).encode(texts))
    monkeypatch.setattr(sparse, "WORDS", 10)
    monkeypatch.setattr(sparse, "KEPT", 12)
    small = sparse.Encoder(0.0, 512)
    got = flat(small.encode(texts))
    assert len(small.words) <= 30 and [x[0] for x in got] == [x[0] for x in want] == list(range(2, 202))
    assert all((a[1] == b[1]).all() and np.allclose(a[2], b[2], rtol=1e-12) for a, b in zip(got, want, strict=True))


def test_learned_weights(spark):
    d = spark.createDataFrame([(1, [5, 5, 7, 8, 9, 0], [0.5, 0.9, 0.1, float("nan"), 2.0, 3.0], [1, 1, 1, 1, 0, 1])], "k int, i array<int>, w array<double>, m array<int>")
    assert {(r["index"], r.weight) for r in sparse.learned_weights(d, ["k"], "i", "w", "m", [0], 0.2).collect()} == {(5, 0.9)}


def test_query_normalisation_offsets():
    for t in ["", "  \r\n ", "a\r\nb\rc", "  Привет \t\n\n\n\n\nмир  ", "```\nselect 1\n```\n", "x" * 300]:
        n, bounds = querytext.normalize(t)
        raw = t.encode()
        assert "\r" not in n and n == n.strip() and "\n\n\n\n" not in n and len(bounds) == len(n.encode()) + 1
        assert bounds == sorted(bounds)
        for i, ch in enumerate(n):
            b = len(n[:i].encode())
            if ch != "\n":
                assert raw[bounds[b] : bounds[b] + len(ch.encode())].decode() == ch


def test_query_plans():
    p = querytext.plan("Explain the outbox. Only ACTIVE rows.\nERR-2041 appears. Why?")
    assert [i["kind"] for i in p["intents"]] == ["IMPERATIVE_REQUEST", "CONSTRAINT", "TECHNICAL_EVIDENCE", "EXPLICIT_QUESTION"] and p["tier"] == "SINGLE"
    assert querytext.plan("plain words here")["intents"][-1]["kind"] == "IMPLICIT_SEARCH_INTENT"
    for n, tier in ((1, "SINGLE"), (256, "SINGLE"), (257, "SEGMENTED_STANDARD"), (1024, "SEGMENTED_STANDARD"), (1025, None), (2049, None)):
        assert querytext.plan("w " * n).get("tier") == tier
    assert querytext.plan("w " * 2048, querytext.Limits(allow_extended=True))["tier"] == "SEGMENTED_EXTENDED"
    assert querytext.plan("w " * 1025)["error"] == "EXTENDED_NOT_ENABLED" and querytext.plan("w " * 2049)["error"] == "TOKEN_LIMIT_EXCEEDED" and querytext.plan(" \n")["error"] == "EMPTY"
    long = querytext.plan(". ".join("word " * 30 for _ in range(20)) + "?")
    assert all(s["tokens"] <= 220 for s in long["segments"]) and {t for s in long["segments"] for t in range(s["token_start"], s["token_end"])} == set(range(long["tokens"]))
    assert querytext.kind_of("The endpoint is config_file.yaml") == "TECHNICAL" and querytext.kind_of("Объясни порядок") == "QUESTION" and querytext.kind_of("Just some words.") == "CONTEXT"


def test_phrases_codes_and_links(spark):
    r = col(spark, ["One TWO", None, ""]).select(text.holds_phrase(F.col("t"), F.lit("e Two")).alias("p")).collect()
    assert [x.p for x in r] == [True, False, False]
    assert [x[0] for x in col(spark, ["0123", "12345", "12a4", None, "1234\n"]).select(text.is_zone_code(F.col("t"))).collect()] == [True, False, False, False, False]
    d = spark.createDataFrame([([("a", "u", 1), ("a", "u", 2), ("b", "u", 3), (None, "u", 4), (None, "u", 5)],), ([],)], "l array<struct<type:string,url:string,n:int>>")
    assert [[x.n for x in r[0]] for r in d.select(text.unique_links(F.col("l"))).collect()] == [[1, 3, 4], []]


def test_lexical_weights(spark):
    d = spark.createDataFrame([(1, "ERR-12", [5, 5, 7, 0], [1, 1, 0, 1])], "k int, t string, i array<int>, m array<int>")
    got = {r["index"]: round(r.weight, 6) for r in sparse.lexical_weights(d, ["k"], "t", "i", "m", [0]).collect()}
    assert got[5] == round(1 + math.log(2), 6) and 7 not in got and 0 not in got and len(got) > 1
