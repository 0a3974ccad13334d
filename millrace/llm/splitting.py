"""Splitting oversized items at natural boundaries (problem 2).

Every text, short or long, and every file is worked on in ranges with halos, by many tasks. A first pass finds the tokens that
begin in each range and the boundaries between them; prefix sums over the ranges' counts stitch these tables into one per item.
Cuts need no walk through the text: an item of N tokens gets evenly spaced nominal cuts, each range's table proposes its best
natural boundary in the window before each of them, and the best proposal wins, whatever range it lies in. The cut
table says which tokens each piece covers, and the ranges emit its text by offset. So one item may be longer than
any task could hold; only the pieces of one item share a limit, never its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.storage import write_work

# The characters with Unicode's White_Space property.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = re.compile(f"[^{WHITE}]+")
_LINE = re.compile(r"[\n\r\x0b\x0c\x85\u2028\u2029]")
_SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
#: Strengths of boundaries; a token start with none of them is the last resort.
BLOCK, LINE, SENTENCE, NONE = 3, 2, 1, 0
_BLANKS = "".join(c for c in map(chr, range(0x3001)) if not _TOKEN.fullmatch(c))
#: Characters (bytes, of files) of a range and of the halo on its left, which reaches back over white space as far as that goes.
RANGE, HALO = 1 << 16, 512
_BLOCK_TOKENS = 4096


def count_tokens(text: Column) -> Column:
    """Longest runs of characters that are not white space; 0 for null."""
    # Java's \\S with Unicode classes is the complement of exactly these characters, and three times as fast as a class that lists them
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)\S++")), F.lit(0)).cast("bigint")


def plan_cuts(n: int, limit: int, overlap: int) -> tuple[int, int, int]:
    """(cuts, spacing, slack) for an item of n tokens: cut k lies in [k * spacing - slack, k * spacing] tokens. Any
    choice keeps every piece, with overlap tokens of the one before it, within the limit."""
    room = limit - max(0, min(overlap, limit - 1))
    slack = room // 4
    cuts = -(-n // (room - slack)) - 1
    spacing = -(-n // (cuts + 1))
    return cuts, spacing, min(room - spacing, spacing // 2)


def halo_start(text: str, start: int) -> int:
    """Where the halo of a range from start begins: HALO characters before the white space that ends there."""
    end = start
    while end and not (part := text[max(0, end - 4 * HALO) : end].rstrip(_BLANKS)):
        end = max(0, end - 4 * HALO)
    return max(0, (max(0, end - 4 * HALO) + len(part) if end else 0) - HALO)


def text_ranges(text: str, size: int) -> Iterator[tuple[int, int, int, str]]:
    """(range_no, lead, size, body) of a text in ranges of so many characters: the halo, the range, and the rest of a token
    that begins in it."""
    for k in range(-(-len(text) // size)):
        start, stop = k * size, min(len(text), (k + 1) * size)
        lo, end = halo_start(text, start), stop
        if stop < len(text) and text[stop] not in _BLANKS and text[stop - 1] not in _BLANKS:  # a token is open at the edge
            own = text[max(0, start - 1) : stop]
            if not start or any(c in own for c in _BLANKS):  # and begins in this range
                end = _TOKEN.match(text, stop).end()
        yield k, start - lo, stop - start, text[lo:end]


class Range:
    """A range of a text with its halo: where its tokens begin, and where the last token before them ends.

    body holds the halo and the range and goes on to the end of a token that begins in the range;
    lead is the length of the halo; a token belongs to the range it begins in."""

    def __init__(self, body: str, lead: int, size: int) -> None:
        self.body = body
        spans = [m.span() for m in _TOKEN.finditer(body)]
        first = next((i for i, (s, _) in enumerate(spans) if s >= lead), len(spans))
        self.before = spans[first - 1][1] if first else 0
        self.spans = [x for x in spans[first:] if x[0] < lead + size]

    def boundaries(self, tails: Sequence[str]) -> list[tuple[int, int]]:
        """(token, strength) of the boundaries before the range's tokens, where there is more than white space to one."""
        ends, body, out = set(), self.body, []
        for t in tails:
            at = body.find(t) if t else -1
            while at >= 0:
                ends.add(at + len(t))
                at = body.find(t, at + 1)
        end = self.before
        for j, (start, stop) in enumerate(self.spans):
            if end in ends:
                out.append((j, BLOCK))
            elif _LINE.search(body, end, start):
                out.append((j, LINE))
            elif _SENTENCE.search(body[max(0, end - 8) : end]):
                out.append((j, SENTENCE))
            end = stop
        return out


def proposals(n: int, at: Sequence[int], strong: Sequence[int], base: int, total: int, limit: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(cut, strength, token): the best boundary for each nominal cut near a range of n tokens, of which base lie before it."""
    from bisect import bisect_left, bisect_right

    cuts, spacing, slack = plan_cuts(total, limit, overlap)
    for k in range(max(1, base // spacing), min(cuts, (base + n + slack) // spacing) + 1):
        lo, hi = max(k * spacing - slack, base), min(k * spacing, base + n - 1)
        i, j = bisect_left(at, lo - base), bisect_right(at, hi - base)
        if i < j:
            x = max(range(i, j), key=lambda q: (strong[q], at[q]))
            yield k, int(strong[x]), base + int(at[x])
        elif base <= k * spacing < base + n:
            yield k, NONE, k * spacing


def _schema(df: DataFrame, cols: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"`{c}` {kinds[c]}" for c in cols)


def _mapped(body, columns: Sequence[str]):
    """mapInPandas body: the rows that a function of one row makes. Names end in an underscore, as itertuples renames those
    that begin with one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([x for r in f.itertuples(index=False) for x in body(r)], columns=list(columns))

    return run


def split_oversized(items: DataFrame, key: Sequence[str], text: str = "content", limit: str = "max_tokens", overlap: str = "overlap", tails: str | None = None, range_chars: int = RANGE) -> DataFrame:
    """(*key, piece_no, first_token, token_count, overlap_tokens, text, boundary): the pieces of every item of
    more tokens than its limit, numbered from 0. Items within their limit give no rows.

    key must be unique. tails names a column with the last characters of the item's blocks. A piece holds at most
    limit tokens, of which the first overlap_tokens repeat the end of the piece before it; an overlap of the limit or more
    is taken as one token less than it. boundary tells where the piece ends (3 block or item, 2 line, 1 sentence, 0 between tokens).
    Null or empty texts, null limits and limits below 1 are never cut. White space around a piece is dropped, within it it stays.
    range_chars sets how an item is dealt out to the tasks, and does not change its pieces.
    """
    key = list(key)
    none = F.array().cast("array<string>")
    rows = items.select(
        *key,
        F.col(text).alias("body_"),
        F.col(limit).cast("bigint").alias("limit_"),
        F.greatest(F.coalesce(F.col(overlap).cast("bigint"), F.lit(0)), F.lit(0)).alias("overlap_"),
        (F.coalesce(F.col(tails), none) if tails else none).alias("tails_"),
    ).where("body_ IS NOT NULL AND limit_ >= 1")
    columns = [*key, "range_no", "limit_", "overlap_", "tails_", "lead_", "size_", "body_"]
    ranges = rows.mapInPandas(_mapped(lambda r: [(*r[: len(key)], k, r.limit_, r.overlap_, r.tails_, lead, size, body) for k, lead, size, body in text_ranges(r.body_, range_chars)], columns), _schema(items, key) + ", " + _RANGE)
    return split_ranges(write_work(ranges, "ranges"), key)


_RANGE = "range_no int, limit_ long, overlap_ long, tails_ array<string>, lead_ int, size_ int, body_ string"


def split_ranges(ranges: DataFrame, key: Sequence[str]) -> DataFrame:
    """The pieces, as split_oversized gives them, of items that come as ranges: (*key, range_no, limit_, overlap_,
    tails_, lead_, size_, body_), where body_ holds lead_ characters before the range, its size_ characters and the
    rest of the token that begins last in it."""
    key = list(key)
    kinds = _schema(ranges, key)
    name = lambda r: [getattr(r, c) for c in key]

    def table(r):
        g = Range(r.body_, r.lead_, r.size_)
        found = g.boundaries(r.tails_)
        yield (*name(r), r.range_no, r.limit_, r.overlap_, len(g.spans), [t for t, _ in found], [s for _, s in found])

    found = ranges.mapInPandas(_mapped(table, [*key, "range_no", "limit_", "overlap_", "n", "at", "strong"]), kinds + ", range_no int, limit_ long, overlap_ long, n long, at array<int>, strong array<int>")
    w = Window.partitionBy(*key)
    # used for the cuts and for the pieces, while the texts are read once more only to emit them
    stitched = write_work(found.withColumns({"base": F.sum("n").over(w.orderBy("range_no")) - F.col("n"), "total": F.sum("n").over(w)}).where("total > limit_"), "boundaries")
    proposed = stitched.where("n > 0").mapInPandas(
        _mapped(lambda r: [(*name(r), *x) for x in proposals(r.n, r.at, r.strong, r.base, r.total, r.limit_, r.overlap_)], [*key, "cut", "strength", "token"]), kinds + ", cut int, strength int, token long"
    )
    cuts = proposed.groupBy(*key, "cut").agg(F.max(F.struct("strength", "token")).alias("best")).select(*key, "cut", "best.token", "best.strength")
    ends = stitched.where("range_no = 0").select(*key, "total", F.least("overlap_", F.col("limit_") - 1).alias("most_"))
    starts = cuts.unionByName(ends.select(*key, F.lit(0).alias("cut"), F.lit(0).cast("bigint").alias("token"), F.lit(BLOCK).alias("strength")))
    order = w.orderBy("cut")
    lead = F.least("most_", "token")
    plan = (
        starts.withColumns({"stop": F.lead("token").over(order), "boundary": F.lead("strength").over(order)})
        .join(ends, key)
        .select(*key, F.col("cut").alias("piece_no"), (F.col("token") - lead).alias("first_token"), F.coalesce("stop", "total").alias("stop"), lead.alias("overlap_tokens"), F.coalesce("boundary", F.lit(BLOCK)).alias("boundary"))
    )
    blocks = lambda a, b: F.explode(F.sequence(F.floor(a / _BLOCK_TOKENS), F.floor((b - 1) / _BLOCK_TOKENS)))
    p = plan.withColumn("tb", blocks(F.col("first_token"), F.col("stop")))
    q = stitched.where("n > 0").select(*key, "range_no", "base", "n", blocks(F.col("base"), F.col("base") + F.col("n")).alias("tb"))
    # a range may lie inside one token of a piece and hold no token start, but the range with that start has its rest
    piece = F.struct("piece_no", "first_token", "stop", "overlap_tokens", "boundary")
    wanted = p.join(q, [*key, "tb"]).where("first_token < base + n AND stop > base").groupBy(*key, "range_no").agg(F.max("base").alias("base"), F.collect_set(piece).alias("pieces"))

    def parts_of(r):
        g = Range(r.body_, r.lead_, r.size_)
        n = len(g.spans)
        for p in r.pieces:
            a, b = p["first_token"] - r.base, p["stop"] - r.base
            # white space between the tokens of two ranges comes from the halo of the later one
            lo = g.spans[a][0] if a >= 0 else g.before
            hi = g.spans[b - 1][1] if b <= n else g.spans[-1][1]
            yield (*name(r), p["piece_no"], r.range_no, p["first_token"], p["stop"] - p["first_token"], p["overlap_tokens"], p["boundary"], g.body[lo:hi])

    columns = [*key, "piece_no", "range_no", "first_token", "token_count", "overlap_tokens", "boundary", "part"]
    parts = ranges.select(*key, "range_no", "lead_", "size_", "body_").join(wanted, [*key, "range_no"]).mapInPandas(_mapped(parts_of, columns), kinds + ", piece_no int, range_no int, first_token long, token_count long, overlap_tokens long, boundary int, part string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_no", "part"))), lambda x: x["part"]), "")
    return parts.groupBy(*key, "piece_no", "first_token", "token_count", "overlap_tokens", "boundary").agg(joined.alias("text")).select(*key, "piece_no", "first_token", "token_count", "overlap_tokens", "text", "boundary")


def file_ranges(spark: SparkSession, path: str, limit: int, overlap: int, range_bytes: int = 32 << 20) -> DataFrame:
    """Ranges of UTF-8 text files for split_ranges, keyed by path. Only sizes are listed on the driver; tasks read byte ranges
    with their halos through the file system's own client, so no file is ever loaded as a whole."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    todo = files.where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / F.lit(range_bytes)).cast("int") - 1)).alias("range_no"))
    white = re.compile(f"[{WHITE}]")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for f in frames:
            for p, length, k in f.itertuples(index=False, name=None):
                system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", p))
                with system.open_input_file(at) as src:
                    start, stop = k * range_bytes, min(length, (k + 1) * range_bytes)
                    lo = max(0, start - 4 * HALO)
                    data = src.read_at(stop - lo, lo)
                    while lo and not data[: start - lo].decode("utf-8", "ignore").strip(_BLANKS):  # back over white space
                        more = max(0, lo - (1 << 16))
                        data, lo = src.read_at(lo - more, more) + data, more
                    rest, more = b"", stop
                    while more < length:  # up to the end of the token that is open at the range's end
                        rest += src.read_at(min(1 << 16, length - more), more)
                        more = min(length, more + (1 << 16))
                        if white.search(rest.decode("utf-8", "ignore")):
                            break
                data += rest
                edge = lambda i, data=data: next((j for j in range(i, len(data)) if data[j] & 0xC0 != 0x80), len(data))
                a, b, c = edge(0) if lo else 0, edge(start - lo), edge(stop - lo)
                halo, own, tail = (data[x:y].decode("utf-8", "replace") for x, y in ((a, b), (b, c), (c, len(data))))
                m = white.search(tail)
                yield pd.DataFrame({"path": [p], "range_no": [k], "lead_": [len(halo)], "size_": [len(own)], "body_": [halo + own + (tail[: m.start()] if m else tail)]})

    bodies = todo.repartition("path", "range_no").select("path", "length", "range_no").mapInPandas(read, "path string, range_no int, lead_ int, size_ int, body_ string")
    return bodies.select("path", "range_no", F.lit(limit).cast("bigint").alias("limit_"), F.lit(overlap).cast("bigint").alias("overlap_"), F.array().cast("array<string>").alias("tails_"), "lead_", "size_", "body_")


def block_tails(items: DataFrame, key: Sequence[str], block_ids: str, segments: DataFrame, zone: str, block_id: str, text: str, n: int = 48) -> DataFrame:
    """(*key, tails): the last n characters of each item's blocks, to find the blocks' ends in its text."""
    blank = "".join(c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{WHITE}]", c))
    tail = F.right(F.rtrim(F.col(text), F.lit(blank)), F.lit(n))
    s = segments.where(F.col(text).isNotNull()).groupBy(F.lower(zone).alias("zone_"), F.lower(block_id).alias("block_")).agg(F.max(tail).alias("tail_"))
    ids = items.select(*key, F.lower(zone).alias("zone_"), F.explode(block_ids).alias("id_")).withColumn("block_", F.lower("id_"))
    return ids.join(s.where("tail_ != ''"), ["zone_", "block_"]).groupBy(*key).agg(F.collect_set("tail_").alias("tails"))
