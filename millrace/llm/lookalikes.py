"""Visually identical text with different characters (problem 3).

Code points and strings that look the same are joined into transitive classes by union-find: letters with combining accents
and their composed forms, ligatures and other compatibility forms, blanks, line breaks, invisible characters, and look-alike letters of
Latin, Greek and Cyrillic. The counts of all code points and strings over all texts choose each class's representative. Every
text is then rewritten in one greedy leftmost-longest pass by a multi-pattern automaton over both. Only the table of
patterns reaches the driver: code points, at most the size of Unicode, and the STRINGS most frequent strings; what is
rarer is spelt out in the tasks by the same rules, with the same result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import write_work

# Letters drawn alike in common typefaces, Latin letter first, then its Cyrillic and Greek doubles.
LOOKALIKES = """
A АΑ
B ВΒ
C СϹ
E ЕΕ
F Ϝ
G Ԍ
H НΗ
I ІӀΙ
J ЈͿ
K КΚ
M МΜ
N Ν
O ОΟ
P РΡ
Q Ԛ
S Ѕ
T ТΤ
V Ѵ
W Ԝ
X ХΧ
Y ҮΥ
Z Ζ
a а
c сϲ
d ԁ
e е
h һ
i і
j јϳ
l ӏ
o оο
p рρ
q ԛ
s ѕ
v ѵν
w ԝ
x х
y у
Г Γ
Л Λ
П Π
Ф Φ
"""
#: Characters that are drawn though their category is that of format characters.
VISIBLE_FORMAT = frozenset([*range(0x600, 0x606), 0x6DD, 0x70F, 0x8E2, 0x890, 0x891, 0x110BD, 0x110CD])
#: Characters of other categories that are not drawn: joiners, fillers and variation selectors.
INVISIBLE_OTHER = frozenset([0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)])
LINE_BREAKS = frozenset("\n\r\x0b\x0c\x85\u2028\u2029")


class Classes:
    """Union-find over code points and strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


#: Strings of which counts and representatives travel.
STRINGS = 50_000


@lru_cache(1 << 16)
def _basic(ch: str) -> str:
    """What a code point stands for: nothing if invisible, one blank, one line break, or its full decomposition."""
    cp, kind = ord(ch), unicodedata.category(ch)
    if ch in LINE_BREAKS:
        return "\n"
    if kind == "Zs" or ch == "\t":
        return " "
    if cp in INVISIBLE_OTHER or kind == "Cf" and cp not in VISIBLE_FORMAT or kind == "Cc":
        return ""
    return "".join(_basic(x) for x in d) if (d := unicodedata.normalize("NFKD", ch)) != ch else ch


@cache
def _first_letters() -> dict[str, str]:
    return {x: line[0] for line in LOOKALIKES.split("\n") for x in "".join(line.split()[1:])}


@lru_cache(1 << 16)
def spelt(s: str) -> str:
    """The one spelling that all strings share that look like s: basic characters, accents in their order, first letters."""
    first = _first_letters()
    return unicodedata.normalize("NFD", "".join(first.get(c, c) for c in unicodedata.normalize("NFD", "".join(map(_basic, s)))))


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """What only strings have (an accent, a medial letter of a syllable, a carriage return; roughly, but fast), and the strings
    of several characters that are drawn as one: a character with accents, whatever is invisible between them; a syllable
    in separate letters; a line break of two characters."""

    def ranges(cps: list[int]) -> str:
        cuts = [i for i in range(1, len(cps)) if cps[i] != cps[i - 1] + 1]
        return "".join(f"\\U{cps[i]:08x}-\\U{cps[j - 1]:08x}" for i, j in zip([0, *cuts], [*cuts, len(cps)], strict=True))

    # beyond these planes there are neither accents nor invisible characters
    some = [c for c in (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)) if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf", "Cc") or c in INVISIBLE_OTHER]
    hidden = [c for c in some if not _basic(chr(c))]
    drawn = sorted({c for c in some if unicodedata.category(chr(c))[0] == "M"} - set(hidden))
    marks, unseen, near = ranges(drawn), ranges(hidden), ranges([c for c in drawn if c < 0x10000])
    return re.compile(f"[\r\u1161-\u1175{near}\U00010000-\U0010ffff]"), re.compile(f"\r\n|[\u1100-\u1112][{unseen}]*[\u1161-\u1175](?:[{unseen}]*[\u11a8-\u11c2])?|[^\\s{marks}{unseen}][{unseen}]*[{marks}][{marks}{unseen}]*(?<=[{marks}])")


def strings_of(text: str) -> list[str]:
    """The strings in a text, see _patterns."""
    if text.isascii() and "\r" not in text:
        return []
    hint, whole = _patterns()
    return whole.findall(text) if hint.search(text) else []


def rewriting(counts: Mapping[str, int]) -> dict[str, str]:
    """Pattern -> representative for every code point and string counted.

    A class of letters, or of letters with accents, is represented by its most frequent member, of equally frequent ones by
    the shortest and smallest; one that stands for several letters (a ligature) by these, each in its representative. A
    carriage return before a line feed is part of one line break."""
    classes = Classes()
    seen = {x for x in counts if not (len(x) == 1 and 0xD800 <= ord(x) < 0xE000)}
    for x in sorted(seen):
        classes.union(x, "\n" if x == "\r\n" else spelt(x))
    single = _patterns()[1].fullmatch
    best: dict[str, str] = {}
    several: list[tuple[str, list[str]]] = []
    for group in classes.members().values():
        to = "\n" if "\n" in group else spelt(group[0])
        if to in ("", " ", "\n") or to[0].isspace():
            best.update(dict.fromkeys(group, to))
        elif len(to) == 1 or single(to):
            mine = [x for x in group if len(spelt(x)) == len(to) and (len(x) > 1 or unicodedata.normalize("NFKC", x) == x)] or [to]
            best.update(dict.fromkeys(group, min(mine, key=lambda x: (-counts.get(x, 0), len(x), x))))
        else:
            several.append((to, group))
    for to, group in several:
        best.update(dict.fromkeys(group, Rewriter(best)(to)))
    return {x: to for x, to in best.items() if x != to}


class Rewriter:
    """Greedy leftmost-longest rewriting with an Aho-Corasick automaton over code points and strings. Strings that are not
    among the patterns are spelt out first, and their spelling is rewritten like any other text."""

    def __init__(self, patterns: Mapping[str, str]) -> None:
        import ahocorasick

        self.known = {k for k in patterns if len(k) > 1} | {v for v in patterns.values() if len(v) > 1}
        self.automaton = ahocorasick.Automaton()
        for k, v in patterns.items():
            self.automaton.add_word(k, (len(k), v))
        for v in self.known - set(patterns):  # a representative of several characters stays whole
            self.automaton.add_word(v, (len(v), v))
        self.hint, self.whole = _patterns()
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def _spell(self, m: re.Match) -> str:
        return m[0] if m[0] in self.known else spelt(m[0])

    def __call__(self, text: str) -> str:
        if not text.isascii() and self.hint.search(text):
            text = self.whole.sub(self._spell, text)
        if self.empty:
            return text
        parts, at = [], 0
        for end, (n, to) in self.automaton.iter_long(text):
            parts += (text[at : end + 1 - n], to)
            at = end + 1
        return "".join([*parts, text[at:]]) if parts else text


def text_counts(text: str) -> Counter:
    """Occurrences of each code point and string of a text."""
    own = Counter(text)
    own.update(strings_of(text))
    return own


def pattern_counts(texts: DataFrame, strings: int = STRINGS) -> dict[str, int]:
    """Occurrences of each code point, and of the most frequent strings, in the first column, over all rows; repeated rows
    count as often as they occur. Null and empty texts count nothing."""
    col = texts.columns[0]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(0x110000, dtype=np.int64)
        found: Counter = Counter()
        for b in batches:
            own = [x for x in b.column(0).to_pylist() if x]
            if joined := "".join(own):
                n = np.bincount(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
                total[: len(n)] += n
            for x in own:
                found.update(strings_of(x))
            if len(found) > 200_000:
                yield pa.record_batch([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], names=["s", "n"])
                found.clear()
        at = [c for c in np.nonzero(total)[0].tolist() if not 0xD800 <= c < 0xE000]
        yield pa.record_batch([pa.array([*map(chr, at), *found], pa.string()), pa.array([*total[at].tolist(), *found.values()], pa.int64())], names=["s", "n"])

    rows = texts.select(col).where(F.col(col).isNotNull()).mapInArrow(run, "s string, n long").groupBy("s").agg(F.sum("n").alias("n"))
    one, more = rows.where(F.length("s") == 1), rows.where(F.length("s") > 1).orderBy(F.desc("n"), "s").limit(strings)
    return {r["s"]: r["n"] for r in one.unionByName(more).collect()}


def canonical(col: Column, patterns: Mapping[str, str]) -> Column:
    """The text in its consistent form; null stays null, empty stays empty."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        rewrite = Rewriter(patterns)
        return s.map(rewrite, na_action="ignore")

    return run(col)


def text_prints(rows: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """(table_name, key, raw, canon) of (table_name, key, text): 128-bit prints of the text and of its consistent
    form, so texts themselves are never shuffled. Rows without key or text are left out."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        rewrite, digest = Rewriter(patterns), xxhash.xxh3_128_digest
        for b in batches:
            raw, canon = [], []
            for t in b.column(2).to_pylist():
                h = digest(t.encode("utf-8", "surrogatepass"))
                raw.append(h)
                c = rewrite(t)
                canon.append(h if c is t else digest(c.encode("utf-8", "surrogatepass")))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(raw, pa.binary()), pa.array(canon, pa.binary())], names=["table_name", "key", "raw", "canon"])

    return rows.select("table_name", "key", "text").where("key IS NOT NULL AND text IS NOT NULL").mapInArrow(run, "table_name string, key string, raw binary, canon binary")


def text_classes(rows: DataFrame, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """(table_name, key, raw, canon) of (table_name, key, text), each once: canon is the print of the class of texts that
    look the same. Written once, as everything else is read off it. See text_prints."""
    patterns = rewriting(pattern_counts(rows.select("text"))) if patterns is None else patterns
    return write_work(text_prints(rows, patterns).distinct(), "prints")


def lookalike_classes(classes: DataFrame) -> DataFrame:
    """(table_name, key, class_id, n_texts, n_keys): one row per key and class of its texts, with the number of different
    texts and of keys in the class; combined before the shuffle, so a popular text costs no more than any other."""
    sizes = classes.groupBy("table_name", "canon", "raw").agg(F.count("*").alias("n")).groupBy("table_name", "canon").agg(F.count("*").alias("n_texts"), F.sum("n").alias("n_keys"))
    return classes.select("table_name", "canon", "key").distinct().join(sizes, ["table_name", "canon"]).select("table_name", "key", F.lower(F.hex("canon")).alias("class_id"), "n_texts", "n_keys")


def lookalike_pairs(rows: DataFrame, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """(table_name, key_a, key_b): keys of one table, key_a < key_b, whose texts differ but look the same.

    rows: (table_name, key, text). Distinct texts are paired first and keys joined on afterwards, so any number
    of copies of one text costs nothing but the rows of the result. Repeated rows count once. Null keys or texts
    are no cases; empty texts look like texts of invisible characters only.
    """
    keys = text_classes(rows, patterns)
    texts = keys.select("table_name", "canon", "raw").distinct()
    mixed = texts.groupBy("table_name", "canon").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo != hi").select("table_name", "canon")
    some = texts.join(mixed, ["table_name", "canon"], "left_semi")
    pairs = some.withColumnRenamed("raw", "raw_a").join(some.withColumnRenamed("raw", "raw_b"), ["table_name", "canon"]).where("raw_a < raw_b")
    a = keys.select("table_name", "canon", F.col("raw").alias("raw_a"), F.col("key").alias("x"))
    b = keys.select("table_name", "canon", F.col("raw").alias("raw_b"), F.col("key").alias("y"))
    both = pairs.join(a, ["table_name", "canon", "raw_a"]).join(b, ["table_name", "canon", "raw_b"])
    return both.where("x != y").select("table_name", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
