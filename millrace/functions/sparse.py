"""Sparse encoding of exact technical tokens (T09-T17). token_rows extracts tokens set at a time by built-in regular
expressions. encode makes whole vectors on Arrow batches: no token spans white space, so the tokens of a word are found once
and kept, and neither words nor tokens are exploded or shuffled."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import SPARSE_NAMESPACE, sparse_index, stem

# Classes of technical tokens with their patterns and base weights.
CLASSES = {
    "uuid": (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", 2.5),
    "ip_or_port": (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b|\blocalhost:\d{2,5}\b", 2.5),
    "grpc_method": (r"\b[A-Z][A-Za-z0-9]+(?:Facade|Service)/[A-Z][A-Za-z0-9]+\b", 2.5),
    "path": (r"/[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+", 2.5),
    "filename": (r"\b[A-Za-z0-9_-]+\.[A-Za-z0-9]{2,}\b", 2.2),
    "error_code": (r"\b[A-Za-z]{1,12}(?:-[A-Za-z0-9]+)+\b", 3.0),
    "underscore_identifier": (r"\b[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+\b", 2.4),
    "version_token": (r"\bv\d+(?:/fix\d+)?\b|\bfix\d+\b", 2.0),
    "numeric_exact": (r"\b\d{3,}\b", 2.5),
    "alphanumeric": (r"\b(?:[A-Za-z]+\d+[A-Za-z0-9]*|\d+[A-Za-z]+[A-Za-z0-9]*)\b", 2.2),
    "ordinary_word": (r"\b[A-Za-z]{2,}\b", 1.0),
}
# Words without weight.
STOP_WORDS = "a an and are as at be by did do does during for from how if in is it must of on or should the to what when where while with".split()
_EDGE = r"[\s,;:()\[\]{}\"']"
_FOLDED = ("alphanumeric", "error_code", "filename", "grpc_method", "path", "underscore_identifier", "version_token")


def _ascii_lower(t: Column) -> Column:
    return F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def token_rows(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(*key, class, token), a row per match of a class and per variant of it; matches of several classes may overlap.

    Matches are exploded before they are worked on, so that trimming and variants are compiled column code."""
    t = F.coalesce(F.col(text), F.lit(""))
    classes = F.array(*[F.struct(F.lit(n).alias("class_"), F.regexp_extract_all(t, F.lit("(?U)" + p), F.lit(0)).alias("hits_")) for n, (p, _) in CLASSES.items()])
    raw = texts.select(*key, F.inline(classes)).select(*key, "class_", F.explode("hits_").alias("raw_"))
    trimmed = raw.select(*key, "class_", F.regexp_replace("raw_", f"^{_EDGE}+|{_EDGE}+$", "").alias("raw_"))
    c, token, lower = F.col("class_"), F.col("token_"), F.col("lower_")
    first = trimmed.withColumn("lower_", _ascii_lower(F.col("raw_"))).withColumn("token_", F.when(c.isin("ordinary_word", "uuid"), lower).otherwise(F.col("raw_")))
    first = first.where((token != "") & ~((c == "ordinary_word") & token.isin(STOP_WORDS)))
    none, s = F.array().cast("array<string>"), stem(token)
    stems = F.when((c == "ordinary_word") & (s != token) & ~s.isin(STOP_WORDS), F.array(s))
    folded = F.when(c.isin(*_FOLDED) & (lower != token), F.array(lower))
    parts = F.when(c == "underscore_identifier", F.split(lower, "_")).when(c == "path", F.split(lower, "/")).when(c == "grpc_method", F.split(token, "/"))
    parts = F.filter(parts, lambda p: (F.octet_length(p) >= 2) & (p != token))
    return first.select(*key, c.alias("class"), F.explode(F.concat(F.array(token), *[F.coalesce(x, none) for x in (stems, folded, parts)])).alias("token"))


def base_weight(token_class: Column) -> Column:
    out = F.lit(1.0)
    for name, (_, w) in CLASSES.items():
        out = F.when(token_class == name, w).otherwise(out)
    return out


def term_weights(texts: DataFrame, key: list[str], text: str, min_weight: float = 0.0) -> DataFrame:
    """(*key, index, weight), the weights of tokens with one index summed. Texts without tokens give no row."""
    tf = token_rows(texts, key, text).groupBy(*key, "token", "class").agg(F.count("*").alias("tf"))
    w = tf.select(*key, sparse_index(F.col("class"), F.col("token")).alias("index"), (base_weight(F.col("class")) * (1 + F.log("tf"))).alias("weight"))
    return w.where(F.col("weight") > min_weight).groupBy(*key, "index").agg(F.sum("weight").alias("weight"))


_PATTERNS = [(name, re.compile(p), w) for name, (p, w) in CLASSES.items()]
_STOP = frozenset(STOP_WORDS)
#: Words worked on at a time; words, and characters of words, whose tokens are kept.
WORDS, KEPT, KEPT_CHARS = 1 << 18, 1 << 18, 1 << 24


def _stem(word: str) -> str:
    """text.stem for one word."""
    n = len(word)
    if n > 5 and word.endswith("ies"):
        return word[:-3] + "y"
    return next((word[: -len(x)] for x in ("ing", "ed", "es", "s") if n > len(x) + 3 and word.endswith(x)), word)


def _shadow(word: str) -> str:
    """The word with other characters that bound the same: Java's Unicode \\w and Python's differ in marks and number signs.
    Characters that tokens may hold (ASCII and decimal digits) stay. Only characters newer than the JVM's Unicode may differ."""

    def shown(c: str) -> str:
        kind = unicodedata.category(c)
        if c < "\x80" or kind == "Nd":
            return c
        letter = kind[0] in "LM" or kind in ("Nl", "Pc") or c in "\u200c\u200d" or "\u24b6" <= c <= "\u24e9" or "\U0001f130" <= c <= "\U0001f189" and kind == "So" and not ("\U0001f14a" <= c <= "\U0001f14f" or "\U0001f16a" <= c <= "\U0001f16f")
        return "\u00e9" if letter else "\u00a7"

    return word if word.isascii() else "".join(map(shown, word))


def word_tokens(word: str) -> list[tuple[str, str]]:
    """(class, token) of a word without white space, as token_rows gives them."""
    out = []
    text = _shadow(word)
    for name, pattern, _ in _PATTERNS:
        for raw in pattern.findall(text):
            raw = raw.strip(" \t\n\v\f\r,;:()[]{}\"'")
            low = raw.lower()
            token = low if name in ("ordinary_word", "uuid") else raw
            if not token or name == "ordinary_word" and token in _STOP:
                continue
            out.append((name, token))
            if name == "ordinary_word":
                s = _stem(token)
                if s != token and s not in _STOP:
                    out.append((name, s))
            if name in _FOLDED and low != token:
                out.append((name, low))
            parts = low.split("_") if name == "underscore_identifier" else low.split("/") if name == "path" else token.split("/") if name == "grpc_method" else ()
            out += [(name, p) for p in parts if len(p.encode()) >= 2 and p != token]
    return out


class Encoder:
    """Vectors of texts; the tokens of the words met so far are kept, up to a bound."""

    def __init__(self, min_weight: float, max_non_zero: int) -> None:
        self.min_weight, self.most = min_weight, max_non_zero
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.terms: dict[tuple[str, str], int] = {}
        self.index, self.base, self.of, self.ends, self.chars, self.arrays = [], [], [], [0], 0, None

    def _new(self, word: str) -> int:
        for term in word_tokens(word):
            if (at := self.terms.get(term)) is None:
                at = self.terms[term] = len(self.index)
                self.index.append(1_000_000_000 + int.from_bytes(hashlib.sha256(f"{SPARSE_NAMESPACE}{term[0]}:{term[1]}".encode()).digest()[:4]) % 1_000_000_000)
                self.base.append(CLASSES[term[0]][1])
            self.of.append(at)
        self.ends.append(len(self.of))
        self.chars += len(word)
        self.arrays = None
        n = self.words[word] = len(self.words)
        return n

    def encode(self, texts: Sequence[str | None]) -> Iterator[tuple]:
        """(rows, counts, indices, values), for one stretch of texts after another: rows are positions of the texts with
        tokens, counts the lengths of their vectors, which lie one behind the other."""
        ids: list[int] = []
        sizes: list[int] = []
        first = 0
        for at, t in enumerate(texts):
            words, n = self.words, len(ids)
            for w in (t or "").split():
                i = words.get(w)
                ids.append(self._new(w) if i is None else i)
            sizes.append(len(ids) - n)
            if len(ids) >= WORDS or at == len(texts) - 1:
                yield self._vectors(ids, sizes, first)
                ids, sizes, first = [], [], at + 1
                if len(self.words) > KEPT or self.chars > KEPT_CHARS:
                    self._forget()

    def _vectors(self, ids: list[int], sizes: list[int], first: int) -> tuple:
        import numpy as np

        if self.arrays is None:
            self.arrays = np.array(self.of, np.int64), np.array(self.ends, np.int64), np.array(self.index, np.int64), np.array(self.base, np.float64)
        of, ends, index, base = self.arrays
        word = np.array(ids, np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        n = ends[word + 1] - ends[word]
        term = of[np.repeat(ends[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both = np.sort(np.repeat(row, n) * len(base) + term)  # a row and a term
        start = np.flatnonzero(np.r_[True, both[1:] != both[:-1]][: len(both)])
        tf = np.diff(np.r_[start, len(both)])
        row, term = np.divmod(both[start], max(1, len(base)))
        logs = np.array([0.0, *(1 + math.log(x) for x in range(1, int(tf.max(initial=0)) + 1))])
        weight = base[term] * logs[tf]
        keep = weight > self.min_weight
        key, weight = (row[keep] << 32) | index[term[keep]], weight[keep]
        order = np.argsort(key, kind="stable")
        key, weight = key[order], weight[order]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        if len(start) < len(key):
            key, weight = key[start], np.add.reduceat(weight, start)
        row = key >> 32
        value = weight / np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(sizes)))[row]
        counts = np.bincount(row, minlength=len(sizes))
        if (counts > self.most).any():
            at, n = np.lexsort((key, -value, row)), np.cumsum(counts) - counts
            kept = np.sort(at[np.arange(len(row)) - n[row] < self.most])
            key, value, counts = key[kept], value[kept], np.minimum(counts, self.most)
        rows = np.flatnonzero(counts)
        return rows + first, counts[rows], key & 0xFFFFFFFF, value


def encode(texts: DataFrame, key: list[str], text: str, min_weight: float = 0.0, max_non_zero: int = 512, unique: bool = False) -> DataFrame:
    """Sparse vectors: (*key, indices, values) at length 1 (before they are cut to the heaviest max_non_zero), ascending.
    Texts of one key count together, and texts without tokens give no row. With unique, every key has one row, and nothing is shuffled."""
    rows = texts.select(*key, F.col(text).alias("text_")) if unique else texts.groupBy(*key).agg(F.array_join(F.collect_list(text), "\n").alias("text_"))
    schema = T.StructType([*rows.select(*key).schema, T.StructField("indices", T.ArrayType(T.LongType())), T.StructField("values", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = Encoder(min_weight, max_non_zero)
        for b in batches:
            for at, counts, indices, values in encoder.encode(b.column(len(key)).to_pylist()):
                ends = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
                vectors_ = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (indices, values)]
                yield pa.record_batch([*[b.column(j).take(pa.array(at)) for j in range(len(key))], *vectors_], names=schema.names)

    return rows.mapInArrow(run, schema)


def vectors(weights: DataFrame, key: list[str], max_non_zero: int = 512) -> DataFrame:
    """Collect (*key, index, weight) rows to normalized vectors; one vector is bounded by the distinct tokens of its text."""
    from millrace.functions.text import truncated

    rows = weights.groupBy(*key).agg(F.collect_list(F.struct("index", "weight")).alias("v"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
    scaled = F.transform("v", lambda x: F.struct(x["index"].alias("index"), (x["weight"] / F.col("n")).alias("weight")))
    return rows.withColumn("v", truncated(scaled, max_non_zero)).select(*key, F.transform("v", lambda x: x["index"]).alias("indices"), F.transform("v", lambda x: x["weight"]).alias("values"))


def token_counts(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Distinct (token, class) pairs per text by kind."""
    n = lambda *names: F.count_if(F.col("class").isin(*names)).cast("int")
    special = [c for c in CLASSES if c not in ("numeric_exact", "alphanumeric", "ordinary_word")]
    rows = token_rows(texts, key, text).distinct()
    return rows.groupBy(*key).agg(n(*[c for c in CLASSES if c != "ordinary_word"]).alias("technical"), n("numeric_exact").alias("numeric"), n("alphanumeric").alias("alphanumeric"), n(*special).alias("special"))


def learned_weights(rows: DataFrame, key: list[str], ids: str, weights: str, mask: str, special: list[int], min_weight: float) -> DataFrame:
    """Model token weights to (*key, index, weight): masked, special, light and undefined ones dropped, the
    greatest weight of each id kept; not normalized."""
    z = rows.select(*key, F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(weights).alias("w"), F.col(mask).alias("m"))).alias("z")).select(*key, F.col("z.i").cast("bigint").alias("index"), F.col("z.w").cast("double").alias("weight"), F.col("z.m").alias("m"))
    keep = (F.col("m") != 0) & ~F.isnan("weight") & (F.col("weight") > min_weight) & (F.abs("weight") < F.lit(float("inf")))
    if special:
        keep = keep & ~F.col("index").isin(special)
    return z.where(keep).groupBy(*key, "index").agg(F.max("weight").alias("weight"))


def lexical_weights(rows: DataFrame, key: list[str], text: str, ids: str, mask: str, special: list[int], min_weight: float = 0.0) -> DataFrame:
    """(*key, index, weight): frequencies of a tokenizer's ids (masked and special ones dropped), 1 + ln tf each, added to
    the technical weights of the text; vectors() normalizes them."""
    z = rows.select(*key, F.explode(F.arrays_zip(F.col(ids).alias("i"), F.col(mask).alias("m"))).alias("z")).where("z.m != 0")
    if special:
        z = z.where(~F.col("z.i").isin(special))
    tf = z.groupBy(*key, F.col("z.i").cast("bigint").alias("index")).agg((1 + F.log(F.count("*"))).alias("weight"))
    both = tf.where(F.col("weight") > min_weight).unionByName(term_weights(rows, key, text, min_weight))
    return both.groupBy(*key, "index").agg(F.sum("weight").alias("weight"))
