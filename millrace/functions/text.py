"""Scalar text functions as column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space (Unicode's White_Space property) and its complement, for Java's regular expressions.
WHITE, SOLID = r"(?U)\s++", r"(?U)\S++"
#: Name space of URLs, in which name-based identifiers are made.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Prefix that keeps sparse indices apart from those of other hashes.
SPARSE_NAMESPACE = "millrace:sparse:v1:"


def normalize_space(t: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(t, WHITE, " "))


def sha256_hex(t: Column) -> Column:
    """T02."""
    return F.sha2(t, 256)


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The name-based identifier (version 5) of a name, without any Python."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def count_words(t: Column) -> Column:
    """Words between white space; null text has none."""
    return F.coalesce(F.regexp_count(t, F.lit(SOLID)), F.lit(0))


def sentences(t: Column) -> Column:
    """Cut behind every . ! ? and line feed, terminator kept, trimmed, empty ones dropped."""
    parts = F.regexp_extract_all(t, F.lit(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$"), F.lit(0))
    trimmed = F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def stem(word: Column) -> Column:
    """A light stemmer of English endings, on words in lower case."""
    n = F.length(word)
    cut = lambda k: F.substring(word, F.lit(1), n - k)
    out = F.when((n > 5) & word.endswith("ies"), F.concat(cut(3), F.lit("y")))
    for suffix in ("ing", "ed", "es", "s"):
        out = out.when((n > len(suffix) + 3) & word.endswith(suffix), cut(len(suffix)))
    return out.otherwise(word)


def sparse_index(token_class: Column, token: Column, namespace: str = SPARSE_NAMESPACE) -> Column:
    """A stable index in [1e9, 2e9) from the first 32 bits of a hash."""
    h = F.sha2(F.concat(F.lit(namespace), token_class, F.lit(":"), token), 256)
    return F.lit(1_000_000_000).cast("bigint") + F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % 1_000_000_000


def label(heading: Column, t: Column, n: int = 80) -> Column:
    """The heading, or the first characters of the text."""
    return F.coalesce(F.nullif(heading, F.lit("")), F.substring(t, 1, n))


def backoff(attempt: Column, base: int, most: int, cap: int = 30) -> Column:
    """Base doubled with each attempt, up to most."""
    exponent = F.least(F.greatest(attempt, F.lit(1)) - 1, F.lit(cap)).cast("double")
    return F.least(F.lit(float(most)), F.lit(float(base)) * F.pow(F.lit(2.0), exponent)).cast("bigint")


def length_bucket(tokens: Column, edges: tuple[int, ...] = (64, 128, 256, 512)) -> Column:
    """The smallest edge that holds the text, else the last."""
    out = F.lit(edges[-1])
    for e in reversed(edges[:-1]):
        out = F.when(tokens <= e, e).otherwise(out)
    return out


def days_after(t: Column, days: Column) -> Column:
    """So many days after a time; null days mean never, which is null."""
    return F.timestamp_micros(F.unix_micros(t) + days.cast("bigint") * 86_400_000_000)


def word_set(t: Column) -> Column:
    """The distinct words of a text in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(t), WHITE), lambda w: w != ""))


def lexical_overlap(query: Column, text: Column) -> Column:
    """The share of the query's distinct words that the text holds; 0 for a query without words."""
    q = word_set(query)
    return F.when(F.size(q) <= 0, 0.0).otherwise(F.size(F.array_intersect(q, word_set(text))) / F.size(q))


def opaque_id(prefix: str, *parts: Column) -> Column:
    """an identifier that does not tell what it stands for."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(F.concat(*parts), 256), 1, 16))


def result_print(lines: Column) -> Column:
    """The hash of an ordered list of result lines."""
    return F.sha2(F.array_join(lines, "\n"), 256)


def truncated(indices_values: Column, n: int) -> Column:
    """Of (index, weight) pairs the n heaviest (ties by index), in order of index."""
    heavy = F.array_sort(indices_values, lambda a, b: F.when(a["weight"] != b["weight"], F.when(a["weight"] > b["weight"], -1).otherwise(1)).when(a["index"] < b["index"], -1).when(a["index"] > b["index"], 1).otherwise(0))
    return F.array_sort(F.slice(heavy, 1, n))


def holds_phrase(t: Column, phrase: Column) -> Column:
    """whether the text holds the phrase, whatever the case; null texts hold nothing."""
    return F.coalesce(F.contains(F.lower(t), F.lower(phrase)), F.lit(False))


def is_zone_code(c: Column) -> Column:
    """exactly four digits."""
    return F.coalesce(c.rlike(r"^[0-9]{4}\z"), F.lit(False))


def unique_links(links: Column) -> Column:
    """array<struct<type, url, ...>> without links whose type and url came before; the first of them stays."""
    keys = F.transform(links, lambda x: F.struct(x["type"], x["url"]))
    return F.filter(links, lambda x, i: F.array_position(keys, F.struct(x["type"], x["url"])) == i + 1)
