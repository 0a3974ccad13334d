"""Keyword-stuffed and link-list pages (problem 8).

Two measures decide, and neither knows a language. Clause structure: a page falls into units, and a unit is shaped like
a clause by its length, its end and what divides it: separators, links, tags and numbers. Repetition: the suffix
automaton of a page's words counts how often every substring occurs, and a unit that maximal substrings cover which
come more often than a page of that length would have by chance is stuffing, however it is shaped. A page is spam if more
than half of its words lie in units without clauses, and if the suffix automaton of these units' characters finds
enough of them in repeated maximal substrings. Every page is judged whole and by itself, in a map without any shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

#: Fewest words of a clause with and without an end mark, and words to each separator, link or number in it.
ENDED, OPEN, SPREAD = 3, 9, 3
#: Words of a phrase that counts as stuffed, its fewest occurrences, and words of the page to each of them.
PHRASE, TIMES, PER = 2, 3, 100
#: Most words in a row that stuffing leaves between its phrases, if they are no more than a quarter of the unit; more make a clause.
GAP = 2
#: Share of a unit's words in stuffed phrases from which on it is no clause, share of characters that must be repeated, and part of
#: that which is enough where most words outside clauses stand between bars, in links, tags or numbered parts.
STUFFED, MIN_COVERAGE, LISTED = 0.5, 0.25, 0.5
#: Width of lines, in characters, that may have been wrapped.
WRAPPED = (30, 130)
#: Characters (or words) up to which the automaton is built; beyond, sorted grams give the same measure in less memory.
AUTOMATON = 1 << 17

# scripts written without blanks between words: each character, or each few, counts as a word
_DENSE = "\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_JOINED = "\u0e01-\u0e4e\u0e81-\u0ece\u1000-\u109f\u1780-\u17d3"
_WORD = re.compile(f"[{_DENSE}]{{1,2}}|[{_JOINED}]{{1,4}}|[^\\W\\d_{_DENSE}{_JOINED}]+(?:['’-][^\\W\\d_{_DENSE}{_JOINED}]+)*")
_PLAIN_WORD = re.compile("[a-z]+(?:['-][a-z]+)*")
_MARKED = re.compile(r"[\d#@]")
_MARK = re.compile(r"(?<!\S)[#@]\w|(?<![\w.,:-])(?:[^\W\d]*-?\d)")
_TAG = re.compile(r"<[^<>\n]{1,2000}>")
_LINK_TARGET = re.compile(r"\]\([^()\s]*\)")
_ADDRESS = re.compile(r"\b(?:https?|ftp)://[^\s<>\"')\]]+|\bwww\.[^\s<>\"')\]]+", re.IGNORECASE)
_STATEMENT = re.compile(r"\s*(?:[{}]\s*$|(?:let|var|const|for|if|while|return|def|class|function|import|from|select|insert|update|delete|create)\b.*[=(){}<>;:])|[\w./-]*[_.][\w./-]*\s*[:=]\s*\S+\s*$", re.IGNORECASE)
_CODE_END = re.compile(r"[=(){}\[\]].*[;{}]\s*$|\w\([^()]*\)\s*;?\s*$")
_CODE_LAST = (";", "{", "}", ")")
_LOG = re.compile(r"^\W*(?:\d{4}-\d\d-\d\d[T ])?\d\d:\d\d:\d\d\b|^\W*\d{4}-\d\d-\d\d[T ]|^\W*(?:TRACE|DEBUG|INFO|WARN|WARNING|ERROR|FATAL)\b")
_QUOTE = re.compile(r"^\s*>\s?")
_LEAD = re.compile(r"^\s*(?:[#>*+•–-]+|\d+[.)])\s+")
# ends of sentences in many scripts (a blank is one in the joined ones), and the bars and arrows of menus and tables
_CUT = re.compile(rf"""(?<=[{_JOINED}])\s+(?=[{_JOINED}])|([.!?…][\"'”’»)\]]*)(?=\s)|([。！？؟।۔։။។])|\s[|>»·•→/]+\s|\|""")
_PLAIN_CUT = re.compile(r"""([.!?][\"')\]]*)(?=\s)|\s[|>/]+\s|\|""")
_END = re.compile(r"[.!?…。！？؟।۔։။។:][\"'”’»)\]*_]*\s*$")
_SEPARATORS = ",;|>،、，；»·•→"
_DASH = re.compile(r"\s[-–—/]\s")
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


def occurrences(seq: Sequence) -> tuple[list[int], list[int], list[int], list[int]]:
    """The suffix automaton of seq: (link, length, ends, at): per state its suffix link, the length of its longest
    substring and the number of places it ends in, and the state of each prefix."""
    nexts: list[dict] = [{}]
    link, length, ends = [-1], [0], [0]
    at: list[int] = []
    last = 0
    for ch in seq:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        ends.append(1)
        p = last
        while p != -1 and ch not in nexts[p]:
            nexts[p][ch] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][ch]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                c = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append(0)
                while p != -1 and nexts[p].get(ch) == q:
                    nexts[p][ch] = c
                    p = link[p]
                link[q] = link[cur] = c
        last = cur
        at.append(cur)
    for s in sorted(range(1, len(nexts)), key=length.__getitem__, reverse=True):
        if link[s] > 0:
            ends[link[s]] += ends[s]
    return link, length, ends, at


def _covered_by_grams(seq: Sequence, least: int, times: int):
    """covered() of long sequences: a place lies in a substring of at least `least` symbols that occurs often enough just
    if it lies in such a substring of exactly that many symbols; the grams are sorted a share at a time."""
    import numpy as np

    n = len(seq)
    ids = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) if isinstance(seq, str) else np.unique(np.array(seq), return_inverse=True)[1].astype(np.uint64)
    h = np.zeros(n - least + 1, dtype=np.uint64)
    for j in range(least):
        h = (h ^ (ids[j : j + len(h)] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    edge = np.zeros(n + 1, dtype=np.int32)
    shares = max(1, n >> 22)
    for k in range(shares):
        (place,) = np.nonzero(h % np.uint64(shares) == k)
        _, which, count = np.unique(h[place], return_inverse=True, return_counts=True)
        hit = place[count[which] >= times]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + least, -1)
    return np.cumsum(edge[:n]) > 0


def covered(seq: Sequence, least: int, times: int = 2):
    """For each place of seq whether it lies in a substring of at least `least` symbols that occurs `times` times or more.

    The longest such substring that ends at a place is the longest string of the first state on its suffix path with so
    many ends."""
    n = len(seq)
    if n < least + times - 1:
        return [False] * n
    if n > AUTOMATON:
        return _covered_by_grams(seq, least, times)
    link, length, ends, at = occurrences(seq)
    out, reach = [False] * n, n
    for i in range(n - 1, -1, -1):
        s = at[i]
        while s > 0 and ends[s] < times:
            s = link[s]
        if s > 0 and length[s] >= least:
            reach = min(reach, i - length[s] + 1)
        out[i] = reach <= i
    return out


def repeated_coverage(text: str, least: int) -> float:
    """Share of the characters of text that lie in a substring of at least `least` characters that occurs twice or more."""
    return sum(covered(text, least)) / len(text) if text else 0.0


def chance_length(n: int) -> int:
    """Characters from which on a repeated substring is no matter of course in prose of n characters: prose repeats its short
    words whatever it says, and the longest repeat that chance brings about grows by one with each doubling."""
    return 6 + max(0, math.floor(math.log2(max(n, 1) / 250)))


class Unit:
    """A stretch of a line between ends of sentences, or bars; its words, and whether it has the shape of a clause."""

    __slots__ = ("clause", "listed", "n", "name", "raw", "words")

    def __init__(self, raw: str, barred: bool = False) -> None:
        self.raw = plain = raw
        links = addresses = 0
        if "<" in raw or "](" in raw or "://" in raw or "www." in raw:
            links = raw.count("](") + raw.count("<a ")
            plain, addresses = _ADDRESS.subn(" ", _LINK_TARGET.sub("] ", _TAG.sub(" ", raw)))
        self.words = _PLAIN_WORD.findall(plain.lower()) if (plain_ascii := plain.isascii()) else _WORD.findall(plain.casefold())
        n = len(self.words)
        self.n = n + addresses  # an address is a word, of no clause
        self.name = " ".join(self.words)
        shown = links + addresses + sum(map(plain.count, _SEPARATORS[:4] if plain_ascii else _SEPARATORS))
        if _MARKED.search(plain):
            shown += len(_MARK.findall(plain))
        if " -" in plain or " /" in plain or not plain_ascii:
            shown += len(_DASH.findall(plain))
        self.listed = barred or SPREAD * shown > n
        self.clause = SPREAD * shown <= n and n >= ENDED and (n >= OPEN or bool(_END.search(plain[-12:])))


def _unwrapped(lines: list[str]) -> list[str]:
    """Lines that were broken to a width put together again: each but the last is so long that the next line's first word would
    not have found room in it, and the last one ends a sentence."""
    if len(lines) < 2:
        return lines
    bare = [_QUOTE.sub("", x, count=1) for x in lines]
    width = max(map(len, bare[1:-1] or bare))  # other text may stand before the first and after the last
    if WRAPPED[0] <= width <= WRAPPED[1] and _END.search(bare[-1]) and all(len(x) + 1 + len(y.split(None, 1)[0] if y.strip() else "") > width for x, y in zip(bare, bare[1:], strict=False)):
        return [" ".join(bare)]
    return lines


def units(text: str) -> tuple[list[Unit], int]:
    """The units of a page, and the number of words in its code and log lines."""
    out: list[Unit] = []
    run: list[str] = []
    apart, fenced = 0, False

    def close() -> None:
        for line in _unwrapped(run):
            at, barred = 0, False
            line = _LEAD.sub("", line, count=1)
            for m in (_PLAIN_CUT if line.isascii() else _CUT).finditer(line):
                bar = not m.lastindex and not m[0].isspace()
                if part := line[at : m.end(m.lastindex) if m.lastindex else m.start()].strip():
                    out.append(Unit(part, barred or bar))
                at, barred = m.end(), bar
            if part := line[at:].strip():
                out.append(Unit(part, barred))
        run.clear()

    for line in text.split("\n"):
        fence = "```" in line or "~~~" in line
        if fenced or fence or _LOG.match(line) or _code(line):
            close()
            apart += len(_WORD.findall(line))
        elif not line.strip() or _LEAD.match(line) and not _QUOTE.match(line):
            close()
            run += [line] if line.strip() else []
        else:
            run.append(line)
        fenced ^= fence
    close()
    return out, apart


def _code(line: str) -> bool:
    if "<" in line or "](" in line or "://" in line:
        line = _ADDRESS.sub(" ", _LINK_TARGET.sub("]", _TAG.sub(" ", line)))
    return bool(_STATEMENT.match(line) or line.rstrip()[-1:] in _CODE_LAST and _CODE_END.search(line))


def _longest_gap(marked: Sequence[bool]) -> int:
    """The most words in a row that no stuffed phrase covers."""
    longest = now = 0
    for m in marked:
        now = 0 if m else now + 1
        longest = max(longest, now)
    return longest


def _stuffed(parts: list[Unit], n: int, outside: int) -> set[str]:
    """The words of the clause-shaped units that stuffed phrases cover. A sentence that stands there twice is still a
    sentence, other numbers in it or not: each counts once among the occurrences of phrases."""
    clauses = {u.name: u for u in parts if u.clause}
    times = max(TIMES, -(-n // PER))
    count = Counter(w for u in clauses.values() for w in u.words)
    count.update(w for u in parts if not u.clause for w in u.words)
    often = {w for w, k in count.items() if k >= times}
    # only words that come so often themselves can lie in such phrases: the automaton is built unless these cannot decide
    able = {c for c, u in clauses.items() if sum(map(often.__contains__, u.words)) >= STUFFED * len(u.words)}
    if 2 * (outside + sum(u.n for u in parts if u.clause and u.name in able)) <= n:
        return set()
    ids: dict[str, int] = {}
    seq: list[int] = []
    for k, u in enumerate([*clauses.values(), *(u for u in parts if not u.clause)]):
        seq += [ids.setdefault(w, len(ids)) for w in u.words]
        seq.append(-1 - k)
    marked, at = covered(seq, PHRASE, times), 0
    out = set()
    for name, u in clauses.items():
        own = marked[at : at + len(u.words)]
        if sum(own) >= STUFFED * len(own) and _longest_gap(own) <= max(GAP, len(own) // 4):
            out.add(name)
        at += len(u.words) + 1
    return out


def page_measures(text: str | None) -> tuple[int, int, float, bool]:
    """(words, words outside clauses, repeated share of their characters, whether most of them are listed). The last two are
    measured only where they can matter, that is for more than half of the words."""
    if not text:
        return 0, 0, 0.0, False
    parts, apart = units(text)
    n = apart + sum(u.n for u in parts)
    outside = sum(u.n for u in parts if not u.clause)
    stuffed = _stuffed(parts, n, outside)
    outside += sum(u.n for u in parts if u.clause and u.name in stuffed)
    if 2 * outside <= n:
        return n, outside, 0.0, False
    free = [u for u in parts if not u.clause or u.name in stuffed]
    kept = _SPACE.sub(" ", _DIGITS.sub("0", "\n".join(u.raw for u in free))).casefold()
    return n, outside, repeated_coverage(kept, chance_length(len(kept))), 2 * sum(u.n for u in free if u.listed) > outside


def is_spam(measures: tuple[int, int, float, bool], min_coverage: float = MIN_COVERAGE) -> bool:
    n, outside, coverage, listed = measures
    return 2 * outside > n and coverage >= min_coverage * (LISTED if listed else 1)


def spam_pages(pages: DataFrame, key: str = "doc_id", text: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(key, n_words, n_outside, coverage): the pages judged spam, each key once.

    Null, empty and wordless texts are no spam. Rows with a null key are left out; of rows that share a key any
    spam row makes the key spam, reported with the greatest measures. Other columns are ignored.
    """
    from pyspark.sql import functions as F

    schema = f"{key} {dict(pages.dtypes)[key]}, n_words long, n_outside long, coverage double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [(k, m) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if k is not None and is_spam(m := page_measures(t), min_coverage)]
            yield pa.record_batch(
                [pa.array([k for k, _ in rows], b.column(0).type), pa.array([m[0] for _, m in rows], pa.int64()), pa.array([m[1] for _, m in rows], pa.int64()), pa.array([m[2] for _, m in rows], pa.float64())],
                names=[key, "n_words", "n_outside", "coverage"],
            )

    found = pages.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, schema)
    return found.groupBy(key).agg(F.max("n_words").alias("n_words"), F.max("n_outside").alias("n_outside"), F.max("coverage").alias("coverage"))
