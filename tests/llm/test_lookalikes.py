from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import lookalikes as la


def mapping(*texts):
    return la.rewriting(sum((la.text_counts(t) for t in texts), Counter()))


def same(a, b, *more):
    r = la.Rewriter(mapping(a, b, "plain latin text " * 9, *more))
    return r(a) == r(b)


def test_what_looks_the_same_becomes_equal():
    for a, b in [("paper", "рареr"), ("Ｆｕｌｌ　ｗｉｄｔｈ！", "Full width!"), ("café", "café"), ("ệ", "ệ"), ("so­ft", "soft"), ("a​b﻿⁠", "ab"), ("a b", "a b"), ("a b", "a　b"), ("ﬁne ﬀ", "fine ff"), ("ΑΒΕ", "ABE"), ("ёж", "ёж"), ("ё", "ë"), ("line\r\nend", "line\nend"), ("lone\rend", "lone\nend"), ("x²", "x2"), ("ѕcорe", "scope"), ("fі", "ﬁ")]:
        assert same(a, b), (a, b)


def test_what_looks_different_stays_different():
    for a, b in [("Case", "case"), ("resume", "resumé"), ("a b", "a  b"), ("a\nb", "a b"), ("a\n\nb", "a\nb"), ("rn", "m"), ("0", "O"), ("1", "l"), ("I", "l"), ("u", "v"), ("k", "к"), ("m", "м"), ("", " "), ("a\rb", "ab"), ("ж", "x")]:
        assert not same(a, b), (a, b)


def test_representatives_follow_frequency():
    assert mapping("ооооо", "o")["o"] == "о" and mapping("ooooo", "о")["о"] == "o"
    r = la.Rewriter(mapping("ооооо", "o"))
    assert r("o") == "о" == r("о")
    assert la.Rewriter({})("anything é") == "anything é"


def test_rewriting_is_idempotent():
    t = "\u0415\u0301 \ufb01 \uff21\u0392\u200b \u00e9 \u0451\r\n\u2116 \u2026 \ufb01\u0301 \uac01 \u1100\u1161\u11a8"
    for r in (la.Rewriter(mapping(t)), la.Rewriter(mapping("plain")), la.Rewriter({})):
        assert r(r(t)) == r(t)


def test_strings_are_patterns_and_frequency_chooses_among_them():
    often, seldom = "e\u0301" * 5, "\u00e9"
    m = mapping(often, seldom, "\u0435\u0301")
    assert m[seldom] == "e\u0301" == m["\u0435\u0301"] and "e\u0301" not in m
    assert mapping(seldom * 5, often[:2])["e\u0301"] == seldom
    assert la.Rewriter(m)("caf\u00e9 caf\u0435\u0301") == "cafe\u0301 cafe\u0301"


def test_strings_beyond_the_table_get_the_same_form():
    texts = ["e\u0301x", "\u00e9x", "\u0435\u200b\u0301x", "q\u0323\u0307", "q\u0307\u0323", "\u1e69", "s\u0323\u0307", "\u1e63\u0307", "\u0455\u0307\u0323", "\uac01", "\u1100\u1161\u11a8"]
    full = sum((la.text_counts(t) for t in texts), Counter())
    few = Counter({k: n for k, n in full.items() if len(k) == 1})
    for counts in (full, few):
        r = la.Rewriter(la.rewriting(counts))
        groups = [{r(t) for t in texts[:3]}, {r(t) for t in texts[3:5]}, {r(t) for t in texts[5:9]}, {r(t) for t in texts[9:]}]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4, groups


ROWS = "table_name string, key string, text string, canon string"


def test_pairs_equal_brute_force(spark):
    texts = ["hello", "hеllo", "he​llo", "Hello", "hello", None, "", "​", "naïve", "naïve", "naive", "a b", "a b", "a  b"]
    rows = [(t, f"k{i:02d}", x, "") for t in ("one", "two") for i, x in enumerate(texts)]
    rows += [("one", f"copy{i}", "hello", "") for i in range(60)] + rows[:5] + [("one", None, "hello", "")]
    d = spark.createDataFrame(rows, ROWS).repartition(3)
    r = la.Rewriter(mapping(*[x for x in texts * 9 if x]))
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and None not in (a[1], b[1], a[2], b[2]) and a[1] < b[1] and a[2] != b[2] and r(a[2]) == r(b[2])}
    got = [tuple(x) for x in la.lookalike_pairs(d).collect()]
    assert set(got) == want and len(got) == len(want)
    assert la.lookalike_pairs(d.limit(0)).count() == 0
    classes = la.lookalike_classes(la.text_classes(d)).collect()
    assert {(x.table_name, x.key) for x in classes} == {(x[0], x[1]) for x in rows if None not in (x[1], x[2])}
    by = {(x.table_name, x.key): x for x in classes}
    assert by["one", "k00"].class_id == by["one", "k02"].class_id != by["one", "k03"].class_id and by["one", "k00"].n_keys == 64 and by["one", "k00"].n_texts == 3


def test_canonical_column(spark):
    d = spark.createDataFrame([("hеllo",), (None,), ("",), ("x" * 100000,)], "t string")
    patterns = la.rewriting(la.pattern_counts(d.union(d)))
    assert [x[0] for x in d.select(la.canonical(F.col("t"), patterns)).collect()] == ["hello" if patterns.get("е") == "e" else "hеllo".replace("e", "е"), None, "", "x" * 100000]
