"""Multi-granularity chunking of annotated text segments.

Segments are packed independently, one map over all of them. The numbers that run through a whole document come from
prefix sums over small per-segment counts, so a document may be spread over any number of tasks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import normalize_space, uuid5

# How specific a block type is.
SPECIFICITY = {"FAQ_ITEM": 50, "TABLE_ROW": 50, "LIST_ITEM": 50, "PARAGRAPH": 50, "CODE_BLOCK": 45, "TABLE": 40, "LIST": 40, "SUBSECTION": 30, "SECTION": 20, "DOCUMENT": 10}


def check_profile(target: int, least: int, most: int, overlap: int) -> None:
    """T08."""
    if not (0 < least < target < most and 0 <= overlap < least):
        raise ValueError("a profile needs 0 < min < target < max and 0 <= overlap < min")


def split_sentences(text: str) -> list[str]:
    """T05 for one text."""
    import re

    return [s for p in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", text) if (s := p.strip())]


def pack_sentences(text: str, target: int, least: int, most: int) -> list[str]:
    """Greedy packing of sentences up to `most` words. A longer sentence is cut every `target` words. A last group of
    fewer than `least` words joins the one before it if both fit. Overlap is validated but not applied, as documented."""
    groups: list[list[str]] = []
    now: list[str] = []
    for words in (s.split() for s in split_sentences(text)):
        if len(words) > most:
            groups += [now] if now else []
            now = []
            groups += [words[i : i + target] for i in range(0, len(words), target)]
        elif len(now) + len(words) > most and now:
            groups.append(now)
            now = words
        else:
            now = now + words
    groups += [now] if now else []
    if len(groups) > 1 and len(groups[-1]) < least and len(groups[-2]) + len(groups[-1]) <= most:
        groups[-2:] = [groups[-2] + groups[-1]]
    return [" ".join(g) for g in groups]


def chunk_segments(segments: DataFrame, profile: Mapping[str, tuple[int, int, int]], version: str, document: Sequence[str] = ("access_zone_id", "document_id", "document_version")) -> DataFrame:
    """Chunks (document..., chunk_id, parent_id, granularity, sequence_no, token_count, content, source_block_id, trace).

    profile maps PARENT, SUB_180 and SUB_260 to (target, min, max). Each segment gives parents, each parent its children of both
    sizes. Sequence numbers run through the document: after the parents of a segment, and after each size of children, one
    number is left out. Identifiers are name-based. Blank segments give no chunks; order_index null comes last."""
    doc = list(document)
    sizes = dict(profile)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = [*doc, "block_id", "order_", "granularity", "local_no", "parent_local", "content", "span", "long_"]
        for f in frames:
            out = []
            for r in f.itertuples(index=False, name=None):
                head, text = r[: len(doc) + 2], r[-1]
                parents = pack_sentences(text, *sizes["PARENT"])
                long_ = len(text.split()) > sizes["SUB_260"][2]
                rows = [("PARENT", i, None, p) for i, p in enumerate(parents)]
                at = len(parents) + 1
                for i, p in enumerate(parents):
                    for g in ("SUB_180", "SUB_260"):
                        kids = pack_sentences(p, *sizes[g])
                        rows += [(g, at + j, i, k) for j, k in enumerate(kids)]
                        at += len(kids) + 1
                out += [(*head, *x, at, long_) for x in rows]
            yield pd.DataFrame(out, columns=cols)

    kinds = {f.name: f.dataType.simpleString() for f in segments.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in doc) + ", block_id string, order_ int, granularity string, local_no long, parent_local double, content string, span long, long_ boolean"
    clean = segments.withColumn("text_", normalize_space(F.col("text"))).where("text_ != ''")
    packed = clean.select(*doc, "block_id", F.coalesce("order_index", F.lit(2**31 - 1)).alias("order_"), "text_").mapInPandas(pack, schema)
    w = Window.partitionBy(*doc).orderBy("order_", "block_id")
    base = packed.groupBy(*doc, "order_", "block_id").agg(F.first("span").alias("span")).withColumn("base", F.sum("span").over(w) - F.col("span")).drop("span", "order_")
    rows = packed.drop("span").join(base, [*doc, "block_id"])
    seq = (F.col("base") + F.col("local_no")).alias("sequence_no")
    name = lambda g, no: uuid5(F.concat_ws("|", *doc, F.lit(version), g, no))
    parent = F.when(F.col("parent_local").isNotNull(), name(F.lit("PARENT"), (F.col("base") + F.col("parent_local").cast("bigint")).cast("string")))
    return rows.select(
        *doc, name(F.col("granularity"), (F.col("base") + F.col("local_no")).cast("string")).alias("chunk_id"), parent.alias("parent_id"), "granularity", seq, F.size(F.split("content", " ")).alias("token_count"), "content",
        F.col("block_id").alias("source_block_id"), F.when(F.col("granularity") == "PARENT", "PARENT_CONTEXT").when(F.col("long_"), "SPLIT_FROM_BLOCK").otherwise("DIRECT").alias("trace"),
    )


def document_trace(segments: DataFrame, document: Sequence[str] = ("access_zone_id", "document_id", "document_version")) -> DataFrame:
    """Per document the primary block (most specific type, then most bytes of text, then greatest id), and its block types in order."""
    score = F.lit(0)
    for k, v in SPECIFICITY.items():
        score = F.when(F.col("block_type") == k, v).otherwise(score)
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return segments.groupBy(*document).agg(
        F.max_by("block_id", F.struct(score * 1_000_000 + size, "block_id")).alias("primary_block_id"), F.count("*").alias("n_blocks"), F.when(F.count("*") == 1, "EXACT").otherwise("MERGED").alias("trace_quality"), F.array_join(F.array_sort(F.collect_set("block_type")), ",").alias("block_types")
    )
