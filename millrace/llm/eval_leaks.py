"""Evaluation texts leaking into training text (problem 7).

Pigeonhole edit matching on words. A passage is a third of an item's words with at most e edits. An item is cut into
consecutive pieces so short that every such third holds e + 1 whole ones, of which the edits must leave one unchanged; all
pieces are looked up in every document, with one vectorised pass per piece length. Where a piece hits, a count of word
pairs rejects chance without losing a case, and Myers' bit-parallel distance decides whether some third of the item lies
there within its error budget. The corpus is only mapped over, never shuffled; the items are prepared by Spark and travel to
the tasks in blocks of bounded size, of which the driver holds one at a time.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from millrace.llm.lookalikes import LOOKALIKES, _basic
from millrace.storage import write_work

#: An item's words to one of a passage that makes a case, words of a passage to one edit, and the most words that are
#: only a few in a row: they make no case unless they are the whole item.
THIRD, PER_EDIT, FEW = 3, 4, 4
#: Lines and labels that at least so many different items share are instructions, not part of an item.
SHARED = 3
#: Characters of item text that travel to the tasks at once.
BLOCK_CHARS = 16_000_000

_TAG = re.compile(r"<[^<>\n]{1,200}>")
# scripts written without blanks between words give a word for each character
_JOINED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_WORD = re.compile(f"[{_JOINED}]|[^\\W_{_JOINED}]+")
_LABEL = re.compile(r"^\W*((?:[^\W_]+\W){0,2}?[^\W_]+)\s*[:：]")


class _Fold(dict):
    """Translation of single code points to the form that is compared, filled as they are met."""

    def __init__(self) -> None:
        super().__init__()
        self.double = {x: line[0] for line in LOOKALIKES.split("\n") for x in "".join(line.split()[1:])}

    def __missing__(self, cp: int) -> str:
        basic = " " if 0xD800 <= cp < 0xE000 else _basic(chr(cp))
        self[cp] = to = "".join(self.double.get(x, x) for x in basic)
        return to


_FOLD = _Fold()


def plain_words(text: str) -> list[str]:
    """The words that are compared: no case, markup, punctuation, look-alike or invisible characters."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_FOLD))
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.casefold())


def item_words(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item, words): the words of each item without the lines and labels that SHARED different items have in common.
    Items that read alike count as one. Rows with a null key or text are left out, items without words too."""
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole = " ".join(plain_words(t))
                for k, r in enumerate(t.split("\n")):
                    if own := plain_words(r):
                        m = _LABEL.match(r)
                        out.append((i, whole, k, own, " ".join(own), len(x := plain_words(m[1])) if m else 0, " ".join(x) if m else ""))
            cols = list(zip(*out, strict=True)) or [()] * 7
            yield pa.record_batch([pa.array(c, x) for c, x in zip(cols, (b.schema.field(0).type, pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string()), strict=True)], names=["item", "whole", "no", "words", "line", "n_label", "label"])

    own = items.select(F.col(key).alias("item"), F.col(text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL").distinct()
    lines = own.mapInArrow(run, f"item {kind}, whole string, no int, words array<string>, line string, n_label int, label string")
    common = lambda c: lines.where(f"{c} != ''").select(c, "whole").distinct().groupBy(c).count().where(F.col("count") >= SHARED).select(c)
    kept = lines.join(common("line"), "line", "left_anti").join(common("label").withColumn("known", F.lit(True)), "label", "left")
    rest = F.when(F.col("known"), F.slice("words", F.col("n_label") + 1, F.size("words"))).otherwise(F.col("words"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("no", rest.alias("w")))), lambda x: x["w"])
    return kept.groupBy("item").agg(F.flatten(parts).alias("words")).where("size(words) > 0")


def passage_length(n: int) -> int:
    """Words of the shortest passage of an item of n words that is a case."""
    return max(-(-n // THIRD), min(n, FEW + 1))


def error_budget(length: int) -> int:
    """Most edits in a passage of so many words: one for every PER_EDIT words."""
    return length // PER_EDIT if length > FEW else 0


def piece_length(length: int) -> int:
    """Words of a piece, such that a passage holds one more whole piece than it may have edits, wherever it begins."""
    return max(1, (length + 1) // (error_budget(length) + 2))


def pieces(n: int) -> list[int]:
    """Where the pieces of an item of n words begin: consecutive from its start, and for the passages that reach into what
    is left over at its end, consecutive from there backwards."""
    length = passage_length(n)
    p = piece_length(length)
    back = range(n - p, max(-1, n - length - p), -p) if n % p else ()
    return sorted({*range(0, n - p + 1, p), *back})


def least_distance(pattern: Sequence[int], text: Sequence[int]) -> int:
    """Myers' bit-parallel search: the least edit distance between pattern and any stretch of text."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & mask, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best = score
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv
    return best


class Matcher:
    """The pieces of a block of items, and the test of one document against the items whose pieces it holds."""

    def __init__(self, items: dict) -> None:
        import numpy as np

        self.items = [(i, w) for i, w in items.items() if w]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for _, w in self.items for x in w}))}
        self.ids = [[self.vocabulary[x] for x in w] for _, w in self.items]
        self.pairs = [list(zip(a, a[1:], strict=False)) for a in self.ids]
        places: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, a in enumerate(self.ids):
            p = piece_length(passage_length(len(a)))
            h = self._grams(np.array(a, dtype=np.uint64), p).tolist()
            for at in pieces(len(a)):
                places[p][h[at]].append((i, at))
        self.places = {p: dict(x) for p, x in places.items()}
        self.grams = {p: np.array(sorted(x), dtype=np.uint64) for p, x in self.places.items()}

    @staticmethod
    def _grams(ids, p: int):
        """A print of each run of p ids; equal runs have equal prints, and every hit is verified later."""
        import numpy as np

        n = len(ids) - p + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(p):
            h = (h ^ ids[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, ids):
        """{item number: [(place in ids, place in item)]} of the pieces found in a document."""
        import numpy as np

        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        known = ids > 0
        for p, grams in self.grams.items():
            if len(ids) < p:
                continue
            run = known[: len(ids) - p + 1].copy()
            for j in range(1, p):
                run &= known[j : j + len(run)]
            (at,) = np.nonzero(run)
            if not len(at):
                continue
            h = self._grams(ids, p)[at]
            k = np.searchsorted(grams, h)
            k[k == len(grams)] = 0
            good = grams[k] == h
            for q, x in zip(at[good].tolist(), h[good].tolist(), strict=True):
                for i, o in self.places[p][x]:
                    by[i].append((q, o))
        return by

    def leaked(self, words: Sequence[str]) -> list:
        """The keys of the items that a document of these words holds."""
        import numpy as np

        get = self.vocabulary.get
        ids = [get(w, 0) for w in words]
        by = self.hits(np.array(ids, dtype=np.uint64))
        if not by:
            return []
        there = set(zip(ids, ids[1:], strict=False))
        return [self.items[i][0] for i, places in by.items() if self._holds(i, ids, places, there)]

    def _holds(self, i: int, ids: list[int], places: list[tuple[int, int]], everywhere: set[tuple[int, int]]) -> bool:
        a, pairs = self.ids[i], self.pairs[i]
        n = len(a)
        length = passage_length(n)
        e = error_budget(length)
        need = length - 1 - 2 * e  # word pairs that must be left of length - 1, as an edit breaks two
        if sum(map(everywhere.__contains__, pairs)) < need:
            return False
        p = piece_length(length)
        done: dict[int, int] = {}
        for q, o in sorted(places):
            # a passage with this piece unchanged begins at most so far before it, in the item and, with edits, in the document
            if q < done.get(o, -1):
                continue
            done[o] = q + p
            lo, hi = max(0, q - length - e), min(len(ids), q + length + e + p)
            region = ids[lo:hi]
            there = set(zip(region, region[1:], strict=False))
            have = [0]
            for x in pairs:
                have.append(have[-1] + (x in there))
            if have[-1] < need:
                continue
            for s in range(max(0, o + p - length), min(o, n - length) + 1):
                if have[s + length - 1] - have[s] >= need and least_distance(a[s : s + length], region) <= e:
                    return True
        return False


def _blocks(words: DataFrame) -> Iterator[dict]:
    """The items with their words, in blocks of about BLOCK_CHARS characters by a print of the key (or one item, if that
    is longer); the driver holds one at a time."""
    total = words.agg(F.sum(F.length(F.array_join("words", " ")))).first()[0]
    if not total:
        return
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        own = words if n == 1 else words.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k)
        yield {r["item"]: r["words"] for r in own.collect()}


def eval_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key): the documents that hold a passage of an item.

    Null keys or texts, texts without words, and items of shared lines only are no cases; repeated rows count once. The
    shortest passage is a third of an item's words, but FEW words in a row are a case only if they are the whole item. If
    the items need several blocks the corpus is read once for each. No items, or no documents, give an empty result.
    """
    kind, ikind = dict(documents.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"{key} {kind}, {item_key} {ikind}"
    itype = to_arrow_type(items.schema[item_key].dataType)
    spark = documents.sparkSession
    pages = documents.select(key, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    words = write_work(item_words(items, item_key, item_text), "items")
    found: DataFrame | None = None
    for block in _blocks(words):
        if found is not None:
            found = write_work(found, "leaks")  # the block before has done its work and leaves the tasks
            shared.unpersist()
        shared = spark.sparkContext.broadcast(Matcher(block))

        def run(batches: Iterator, shared=shared) -> Iterator:
            import pyarrow as pa

            m = shared.value
            for b in batches:
                out, which = [], []
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for i in m.leaked(plain_words(t)):
                        out.append(k)
                        which.append(i)
                yield pa.record_batch([pa.array(out, b.column(0).type), pa.array(which, itype)], names=[key, item_key])

        found_here = pages.mapInArrow(run, schema)
        found = found_here if found is None else found.unionByName(found_here)
    return found.distinct() if found is not None else spark.createDataFrame([], schema)
