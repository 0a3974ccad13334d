import random
import re

from pyspark.sql import functions as F

from millrace.llm import splitting as sp

SCHEMA = "z string, id string, content string, max_tokens int, overlap int, tails array<string>, text string, piece_no int"
WS = re.compile(f"[{sp.WHITE}]+")


def tokens(t):
    return [x for x in WS.split(t) if x]


def check(text, limit, overlap, pieces):
    """An exact round trip: the pieces without their overlaps are the item's tokens, in order."""
    want, got = tokens(text), []
    overlap = max(0, min(overlap, limit - 1))
    for k, p in enumerate(sorted(pieces, key=lambda p: p.piece_no)):
        own = tokens(p.text)
        assert p.piece_no == k and len(own) == p.token_count <= limit
        assert p.overlap_tokens == min(overlap, len(got)) if k else p.overlap_tokens == 0
        assert p.first_token == len(got) - p.overlap_tokens
        if k:
            assert own[: p.overlap_tokens] == got[len(got) - p.overlap_tokens :]
        assert p.text in text
        got += own[p.overlap_tokens :]
    assert got == want


def sample(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice("abcdé​") for _ in range(rng.choice([1, 3, 9, 40]))) + rng.choice(["", "", "", ".", "?", ","]))
        out.append(rng.choice([" ", " ", "  ", "\n", "　", "\xa0", "\n\n"]))
    return "".join(out)


def test_pieces_round_trip(spark):
    rng = random.Random(5)
    rows = [("z", str(i), sample(rng, n), limit, overlap, None, "x", 1) for i, (n, limit, overlap) in enumerate([(0, 5, 1), (5, 5, 1), (6, 5, 1), (300, 20, 5), (301, 7, 0), (999, 100, 90), (64, 1, 0), (500, 2, 1), (60, 4, 9), (10, 0, 0)])]
    rows.append(("z", "gaps", "a b" + " \u3000" * 3000 + "c" + "\n" * 5000 + "d e f" + "g" * 3000 + " h " * 40, 6, 2, None, "x", 1))
    rows += [("z", "null", None, 5, 1, None, "x", 1), ("z", "nolimit", "a b c", None, 1, None, "x", 1), ("z", "neg", sample(rng, 50), 10, -3, None, "x", 1), ("z", "nullover", sample(rng, 50), 10, None, None, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    cut = {}
    for range_chars in (1 << 20, 64, 1000):
        got = sp.split_oversized(df, ["z", "id"], tails="tails", range_chars=range_chars).collect()
        assert {r.id for r in got} == {r[1] for r in rows if r[2] and r[3] and len(tokens(r[2])) > r[3]}
        for _, i, text, limit, overlap, *_ in rows:
            if any(r.id == i for r in got):
                check(text, limit, overlap or 0, [r for r in got if r.id == i])
        cut[range_chars] = sorted((r.id, r.piece_no, r.first_token, r.token_count, r.text, r.boundary) for r in got)
    assert cut[1 << 20] == cut[64] == cut[1000]


def test_boundaries_are_preferred(spark):
    sentence = "One two three four five six seven. "
    text = sentence * 6 + "\n" + sentence * 6
    got = sp.split_oversized(spark.createDataFrame([("z", "a", text, 30, 0, ["five six seven."], "", 0)], SCHEMA), ["z", "id"]).collect()
    assert all(p.text.endswith(".") for p in got) and {p.boundary for p in got} >= {1}
    got = sp.split_oversized(spark.createDataFrame([("z", "a", "\n".join(["a b c d e f g"] * 12), 30, 0, None, "", 0)], SCHEMA), ["z", "id"]).collect()
    assert all(p.token_count % 7 == 0 for p in got)
    block = "\n".join(["p q r s. t u v w"] * 2) + "\n\n"
    text = block * 3 + "end of block " + block * 3
    got = sp.split_oversized(spark.createDataFrame([("z", "a", text, 60, 0, ["end of block"], "", 0)], SCHEMA), ["z", "id"], tails="tails").collect()
    assert [p.boundary for p in got if p.text.endswith("end of block")] == [sp.BLOCK]


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(2)
    texts = {"a.txt": sample(rng, 4000), "b.txt": "x" * 9000 + " y " + sample(rng, 100), "c.txt": "", "d.txt": "short"}
    for n, t in texts.items():
        (tmp_path / n).write_text(t, encoding="utf-8", newline="")
    got = sp.split_ranges(sp.file_ranges(spark, str(tmp_path), 50, 10, range_bytes=3000), ["path"]).collect()
    assert {r.path.rsplit("/", 1)[1] for r in got} == {"a.txt", "b.txt"}
    for n in ("a.txt", "b.txt"):
        check(texts[n], 50, 10, [r for r in got if r.path.endswith(n)])


def test_a_file_of_sixty_four_megabytes(spark, tmp_path):
    words = [f"word{i}" + ("." if i % 13 == 0 else "") for i in range(5000)]
    block = " ".join(words) + "\n"
    n = -(-(64 << 20) // len(block))
    with open(tmp_path / "big.txt", "w") as f:
        for _ in range(n):
            f.write(block)
    got = sp.split_ranges(sp.file_ranges(spark, str(tmp_path / "big.txt"), 2000, 100, range_bytes=4 << 20), ["path"])
    own = got.select("piece_no", "first_token", "token_count", "overlap_tokens", sp.count_tokens(F.col("text")).alias("n"), F.split("text", " ")[0].alias("first"), "boundary").orderBy("piece_no").collect()
    at = 0
    for k, p in enumerate(own):
        assert p.piece_no == k and p.n == p.token_count <= 2000 and p.first_token == at - p.overlap_tokens and p.overlap_tokens == (100 if k else 0)
        assert p.first == words[p.first_token % 5000] or "\n" in p.first
        at = p.first_token + p.token_count
    assert at == n * 5000 and all(p.boundary >= sp.SENTENCE for p in own)


def test_empty_table_and_tails(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sp.split_oversized(empty, ["z", "id"]).count() == 0
    items = spark.createDataFrame([("Z", "a", ["B1", "b2", None])], "z string, id string, blocks array<string>")
    seg = spark.createDataFrame([("z", "b1", "the end. \n"), ("z", "b1", "the end. \n"), ("z", "b2", None), ("y", "b2", "other")], "access_zone_id string, block_id string, text string")
    got = sp.block_tails(items.withColumn("access_zone_id", F.col("z")), ["z", "id"], "blocks", seg, "access_zone_id", "block_id", "text").collect()
    assert [(r.z, r.id, r.tails) for r in got] == [("Z", "a", ["the end."])]
