import random
from collections import Counter, defaultdict

import pytest

from millrace.llm import packing as pk

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_patterns_fill_the_capacity():
    means = [3.0, 10.5, 40.0, 77.7]
    ways = pk.patterns(means, 100)
    assert len({tuple(sorted(w.items())) for w in ways}) == len(ways) and all({c: int(100 / m)} in ways for c, m in enumerate(means))
    for w in ways:
        room = 100 - sum(means[c] * k for c, k in w.items())
        assert 0 <= room and len(w) <= pk.MIXED and any(means[c] > room for c in w)


def test_fitted_patterns_fill_most_containers_of_common_lengths():
    rng = random.Random(3)
    h = Counter(max(1, min(2048, int(rng.lognormvariate(5.5, 0.8)))) for _ in range(20000))
    runs, fitted = pk.pack_sizes(h, 2048)
    number = sum(n for _, n in runs)
    assert fitted >= 0.8 * number and number <= 1.01 * sum(s * n for s, n in h.items()) / 2048 + 1


def test_length_classes_share_the_tokens():
    h = {s: 1 + s % 3 for s in range(1, 600)}
    classes = pk.length_classes(h, 12)
    assert [s for own, _ in classes for s in own] == sorted(h) and len(classes) <= 12
    tokens = [sum(s * h[s] for s in own) for own, _ in classes]
    assert max(tokens) < 2 * min(tokens)


def test_nnls():
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.random((8, 5))
    x = np.array([0, 2.0, 0, 0.5, 1.0])
    assert np.allclose(pk.nnls(a, a @ x), x, atol=1e-6)
    y = pk.nnls(a, -np.ones(8))
    assert (y == 0).all()


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 512, 2048])
def test_runs_hold_every_item_once(capacity):
    rng = random.Random(capacity)
    h = Counter(rng.randint(1, capacity) for _ in range(3000)) + Counter({capacity: 5, 1: 700})
    runs, fitted = pk.pack_sizes(h, capacity)
    back = Counter()
    for content, n in runs:
        assert n > 0 and sum(s * k for s, k in content) <= capacity
        for s, k in content:
            back[s] += k * n
    assert back == h
    least = -(-sum(s * n for s, n in h.items()) // capacity)
    assert sum(n for _, n in runs) <= least * 1.02 + 2
    at = 0
    for content, n in runs:  # the fitted containers come first, and are full
        if at < fitted:
            assert sum(s * k for s, k in content) == capacity
        at += n
    assert fitted <= at and pk.pack_sizes({}, capacity) == ([], 0)


def test_pack_table(spark):
    rng = random.Random(1)
    sizes = [0, None, 5, 5, 10, 11, 25, 30, 1000] + [rng.randint(1, 12) for _ in range(400)] + [3] * 300
    d = spark.createDataFrame([(i, n, "x", 1) for i, n in enumerate(sizes)], "doc_id long, n long, text string, container_no int").repartition(5)
    got = pk.pack(d, "doc_id", "n", 10).collect()
    held, by = defaultdict(int), defaultdict(list)
    for r in got:
        held[r.container_no] += r.n_tokens
        by[r.doc_id].append(r)
    assert max(held.values()) <= 10 and set(by) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        ps = sorted(by[i], key=lambda r: r.piece_no)
        assert [p.piece_no for p in ps] == list(range(len(ps))) and len(ps) == max(1, -(-(n or 0) // 10))
        at = 0
        for p in ps:
            assert p.first_token == at
            at += p.n_tokens
        assert at == (n or 0)
    used = len(held)
    assert used <= -(-sum(n or 0 for n in sizes) // 10) * 1.05 + 2
    assert pk.pack(d.limit(0), "doc_id", "n", 10).count() == 0
    again = pk.pack(d.repartition(2), "doc_id", "n", 10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_token_counts(spark):
    import base64

    import tiktoken

    with open(VOCABULARY, "rb") as f:
        enc = tiktoken.Encoding("t", pat_str=pk.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    texts = [None, "", "Hello world, it's 2024!", "Ünï  \n\n code " * 50, "word " * 60000, "<|endoftext|>"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in pk.token_counts(d, "doc_id", "text", VOCABULARY).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert "".join(pk.stretches("word " * 60000)) == "word " * 60000 and len(list(pk.stretches("word " * 60000))) > 1


def test_packed_documents(spark):
    d = spark.createDataFrame([(i, "some words here " * (i % 40)) for i in range(200)], "doc_id long, text string")
    w = spark.createDataFrame([("a", 64), ("b", 256)], "window_name string, capacity_tokens int")
    p = pk.packed_documents(d, w, VOCABULARY)
    f = {r.window_name: r for r in pk.fill(p).collect()}
    assert f["a"].n_tokens == f["b"].n_tokens and f["a"].n_containers * 64 < f["a"].n_tokens * 1.05 and p.where("window_name = 'a'").select("doc_id").distinct().count() == 200
    assert pk.packed_documents(d, w.limit(0), VOCABULARY).count() == 0
