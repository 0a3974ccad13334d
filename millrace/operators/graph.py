"""Graph construction, one-hop expansion and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.storage import write_work

# Relation types by class, those that may be followed backwards, weights and boosts.
DOMAIN = "EXPLAINS RELATED_TO REPAIRED_BY OBSERVED_BY CONSTRAINED_BY PRODUCES CONSTRAINS PROTECTED_BY REQUIRES PUBLISHES_TO".split()
STRUCTURAL = "DOCUMENT_CONTAINS_BLOCK BLOCK_CONTAINS_BLOCK BLOCK_PRODUCED_CHUNK CHUNK_PRODUCED_BY_BLOCK CHUNK_HAS_PARENT CHUNK_PREVIOUS_SIBLING CHUNK_NEXT_SIBLING CHUNK_SAME_TABLE".split()
SIMILARITY = ["CHUNK_SEMANTIC_SIMILAR"]
SYMMETRIC = ["CHUNK_SAME_TABLE", "CHUNK_SEMANTIC_SIMILAR", "RELATED_TO"]
WEIGHTS = {"CHUNK_HAS_PARENT": 0.95, "CHUNK_PREVIOUS_SIBLING": 0.90, "CHUNK_NEXT_SIBLING": 0.90, "CHUNK_SAME_TABLE": 0.85, "CHUNK_SEMANTIC_SIMILAR": 0.60, "EXPLAINS": 0.75, "RELATED_TO": 0.65, "REPAIRED_BY": 0.80, "OBSERVED_BY": 0.70, "CONSTRAINED_BY": 0.75, "PRODUCES": 0.75, "CONSTRAINS": 0.75, "PROTECTED_BY": 0.75, "REQUIRES": 0.75, "PUBLISHES_TO": 0.75}
BOOSTS = {"CHUNK_HAS_PARENT": 0.90, "CHUNK_PREVIOUS_SIBLING": 0.75, "CHUNK_NEXT_SIBLING": 0.75, "CHUNK_SAME_TABLE": 0.60, "CHUNK_SEMANTIC_SIMILAR": 0.60, "BLOCK_PRODUCED_CHUNK": 0.70, "CHUNK_PRODUCED_BY_BLOCK": 0.70, **dict.fromkeys(DOMAIN, 0.70)}


def _lookup(key: Column, values: dict, default: Column) -> Column:
    out = default
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def relation_class(relation: Column) -> Column:
    """Read without case and padding; unknown types give null, so that callers can reject them."""
    r = F.upper(F.trim(relation))
    return F.when(r.isin(DOMAIN), "SEMANTIC_DOMAIN").when(r.isin(SIMILARITY), "SEMANTIC_SIMILARITY").when(r.isin(STRUCTURAL), "STRUCTURAL")


def candidate_score(seed: Column, relation: Column, edge: Column, hops: Column, power: float = 1.0, floor: float = 0.10) -> Column:
    """Seed score times edge score times the relation's weight times the penalty of the distance."""
    structural = relation_class(relation) == "STRUCTURAL"
    s = F.when(structural, F.greatest(seed, F.lit(floor))).otherwise(seed)
    e = F.when(structural, edge).otherwise(F.pow(edge, F.lit(power)))
    w = _lookup(relation, WEIGHTS, F.when(structural, 0.90).otherwise(0.60))
    hop = F.when(hops == 1, 1.0).when(hops == 2, 0.70).otherwise(0.50)
    return s * e * w * hop


def legacy_score(seed: Column, relation: Column, edge: Column) -> Column:
    """R04."""
    return seed * _lookup(relation, BOOSTS, F.lit(0.50)) * edge


def one_hop(seeds: DataFrame, edges: DataFrame, relations: Sequence[str], max_edges: int, query: str = "query_id") -> DataFrame:
    """Edges from seeds (query, access_zone_id, chunk_id, seed_rank) forward, and backward where
    the relation is symmetric; taken from the seeds in turn, best edge of each first, up to max_edges a query.

    The limit comes before anything is checked about the related chunks, so fewer may remain. Inactive and quarantined
    edges, self-edges and unknown relations are left out; of two ways to one chunk both stay."""
    known = [r.upper() for r in relations if r.upper() in {*DOMAIN, *STRUCTURAL, *SIMILARITY}]
    live = edges.where("lifecycle_status = 'ACTIVE' AND NOT coalesce(quarantined, false)").where(F.col("relation_type").isin(known))
    cols = ["access_zone_id", "edge_id", "relation_type", "relation_score", "relation_source", "relation_rank"]
    chunk_end = lambda side: F.col(f"{side}_node_type") == "CHUNK"
    both = live.where(chunk_end("source") & chunk_end("target"))
    out = both.select(*cols, F.col("source_node_id").alias("chunk_id"), F.col("target_node_id").alias("related_id"))
    back = both.where(F.col("relation_type").isin(SYMMETRIC)).select(*cols, F.col("target_node_id").alias("chunk_id"), F.col("source_node_id").alias("related_id"))
    found = seeds.select(query, "access_zone_id", "chunk_id", "seed_rank").join(out.unionByName(back), ["access_zone_id", "chunk_id"])
    cls = F.when(F.col("relation_type").isin(DOMAIN), 0).when(F.col("relation_type").isin(SIMILARITY), 2).otherwise(1)
    order = [F.when(F.col("relation_source") == "QUALITY_FIXTURE", 0).otherwise(1), cls, F.col("relation_score").desc_nulls_first(), F.col("relation_rank").asc_nulls_last(), "edge_id", "related_id"]
    w = Window.partitionBy(query, "access_zone_id", "chunk_id").orderBy(*order)
    turn = found.withColumn("seed_edge_rank", F.row_number().over(w)).where(F.col("seed_edge_rank") <= max_edges)
    w = Window.partitionBy(query).orderBy("seed_edge_rank", "seed_rank", *order)
    taken = turn.withColumn("n_", F.row_number().over(w)).where(F.col("n_") <= max_edges).drop("n_")
    return taken.where("related_id != chunk_id").withColumnRenamed("chunk_id", "seed_chunk_id").withColumnRenamed("related_id", "chunk_id")


def structural_edges(versions: DataFrame, segments: DataFrame, chunks: DataFrame) -> DataFrame:
    """(access_zone_id, source_type, source_id, target_type, target_id, relation_type, rank).

    Children of one parent are neighbours in order of sequence_no, both sizes together. Edges with an end that
    does not exist, and self-edges, are dropped by semi joins against the nodes."""
    e = lambda df, st, s, tt, t, r, rank=None: df.select("access_zone_id", F.lit(st).alias("source_type"), F.col(s).alias("source_id"), F.lit(tt).alias("target_type"), F.col(t).alias("target_id"), F.lit(r).alias("relation_type"), F.lit(rank).cast("int").alias("rank"))
    kids = chunks.where("granularity IN ('SUB_180', 'SUB_260') AND parent_id IS NOT NULL").withColumn("next_id", F.lead("chunk_id").over(Window.partitionBy("access_zone_id", "parent_id").orderBy(F.col("sequence_no").asc_nulls_last(), "chunk_id")))
    made = chunks.where("source_block_id IS NOT NULL AND granularity != 'SOURCE'")
    every = (
        e(segments, "DOCUMENT", "document_id", "LOGICAL_BLOCK", "block_id", "DOCUMENT_CONTAINS_BLOCK")
        .unionByName(e(segments.where("parent_block_id IS NOT NULL"), "LOGICAL_BLOCK", "parent_block_id", "LOGICAL_BLOCK", "block_id", "BLOCK_CONTAINS_BLOCK"))
        .unionByName(e(made, "LOGICAL_BLOCK", "source_block_id", "CHUNK", "chunk_id", "BLOCK_PRODUCED_CHUNK"))
        .unionByName(e(chunks.where("parent_id IS NOT NULL"), "CHUNK", "chunk_id", "CHUNK", "parent_id", "CHUNK_HAS_PARENT"))
        .unionByName(e(kids.where("next_id IS NOT NULL"), "CHUNK", "chunk_id", "CHUNK", "next_id", "CHUNK_NEXT_SIBLING", 1))
        .unionByName(e(kids.where("next_id IS NOT NULL"), "CHUNK", "next_id", "CHUNK", "chunk_id", "CHUNK_PREVIOUS_SIBLING", -1))
    )
    n = lambda df, t, i: df.select("access_zone_id", F.lit(t).alias("type"), F.col(i).alias("id"))
    nodes = n(versions, "DOCUMENT", "document_id").unionByName(n(segments, "LOGICAL_BLOCK", "block_id")).unionByName(n(chunks, "CHUNK", "chunk_id")).distinct()
    end = lambda side: nodes.select("access_zone_id", F.col("type").alias(f"{side}_type"), F.col("id").alias(f"{side}_id"))
    kept = every.where("source_id != target_id OR source_type != target_type")
    for side in ("source", "target"):
        kept = kept.join(end(side), ["access_zone_id", f"{side}_type", f"{side}_id"], "left_semi")
    return kept


def table_neighbours(rows: DataFrame, table: Sequence[str], row_index: str, key: str) -> DataFrame:
    """Edges (*table, source_id, target_id, relation_type) between the rows of one table that follow one another in order
    of row_index (null last; ties by key). Rows without a table give none; a table of one row gives none."""
    w = Window.partitionBy(*table).orderBy(F.col(row_index).asc_nulls_last(), key)
    t = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in table)).withColumn("next_id", F.lead(key).over(w))
    return t.where("next_id IS NOT NULL").select(*table, F.col(key).alias("source_id"), F.col("next_id").alias("target_id"), F.lit("CHUNK_SAME_TABLE").alias("relation_type"))


def block_depths(segments: DataFrame) -> DataFrame:
    """(access_zone_id, block_id, depth): the number of ancestors of each block, of whatever depth; null where the chain of
    parents runs into a cycle. A parent that does not exist still counts.

    Pointers are doubled until all chains have ended, so a depth of n takes log n rounds. Each round is written and read
    again, so plans do not grow; blocks whose chain goes on after as many rounds as the blocks could need are in cycles."""
    p = segments.select("access_zone_id", "block_id", F.col("parent_block_id").alias("up")).distinct()
    known = p.select("access_zone_id", F.col("block_id").alias("up"))
    p = p.join(known.withColumn("there", F.lit(True)), ["access_zone_id", "up"], "left").select("access_zone_id", "block_id", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("up").isNotNull(), 1).otherwise(0).alias("depth"))
    p = write_work(p, "depths")
    most = max(1, p.count()).bit_length() + 1
    for _ in range(most):
        if not p.where("up IS NOT NULL").limit(1).count():
            break
        q = p.select("access_zone_id", F.col("block_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        p = write_work(p.join(q, ["access_zone_id", "up"], "left").select("access_zone_id", "block_id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
    return p.select("access_zone_id", "block_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


#: Stands for the depth of blocks in cycles where blocks are ordered.
CYCLIC = 1000


def select_blocks(segments: DataFrame, depths: DataFrame, chunks: DataFrame, per_parent: int = 100, total: int = 3000) -> DataFrame:
    """The blocks of each document version that become graph nodes: by kind and depth, those with chunks first, at most
    per_parent under one parent (sections excepted) and total in all. The running count of the rule equals a row number."""
    base = F.when(F.col("block_type") == "DOCUMENT", 0).when(F.col("block_type") == "SECTION", 10).when(F.col("block_type") == "SUBSECTION", 20).when(F.col("block_type") == "TABLE", 30).when(F.col("block_type").isin("PARAGRAPH", "TABLE_ROW", "LIST_ITEM", "FAQ_ITEM"), 40).otherwise(90)
    used = chunks.where("source_block_id IS NOT NULL").select("access_zone_id", F.col("source_block_id").alias("block_id")).distinct().withColumn("used", F.lit(0))
    b = segments.join(depths, ["access_zone_id", "block_id"]).join(used, ["access_zone_id", "block_id"], "left").withColumn("place", base + F.coalesce("depth", F.lit(CYCLIC)))
    doc = ["access_zone_id", "document_id", "document_version"]
    order = ["place", F.coalesce("used", F.lit(1)), F.col("order_index").asc_nulls_last(), "block_id"]
    b = b.withColumn("nth", F.row_number().over(Window.partitionBy(*doc, "parent_block_id").orderBy(*order)))
    b = b.where((F.col("nth") <= per_parent) | F.col("block_type").isin("DOCUMENT", "SECTION", "SUBSECTION"))
    return b.withColumn("n", F.row_number().over(Window.partitionBy(*doc).orderBy(*order))).where(F.col("n") <= total).select(*doc, "block_id", "place", "n")


def relation_fan_out(relations: DataFrame, block_chunks: DataFrame, most: int = 64) -> DataFrame:
    """Relations between blocks (relation_id, access_zone_id, source_block, target_block, relation_type) as edges
    between their chunks (access_zone_id, block_id, chunk_id), at most `most` pairs a relation, which the feature defines."""
    side = lambda n: block_chunks.select("access_zone_id", F.col("block_id").alias(f"{n}_block"), F.col("chunk_id").alias(f"{n}_chunk"))
    # the first `most` chunks of a block are enough on either side, so no pair beyond the limit squared is ever made
    first = lambda n: side(n).withColumn("k", F.row_number().over(Window.partitionBy("access_zone_id", f"{n}_block").orderBy(f"{n}_chunk"))).where(F.col("k") <= most + 1).drop("k")
    j = relations.join(first("source"), ["access_zone_id", "source_block"]).join(first("target"), ["access_zone_id", "target_block"]).where("source_chunk != target_chunk")
    w = Window.partitionBy("relation_id").orderBy("source_chunk", "target_chunk")
    return j.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def edge_summary(edges: DataFrame) -> DataFrame:
    """Edges and their scores by relation."""
    return edges.groupBy("relation_type").agg(F.count("*").alias("n"), F.round(F.avg("relation_score"), 6).alias("avg_score"), F.round(F.min("relation_score").cast("double"), 6).alias("min_score"), F.round(F.max("relation_score").cast("double"), 6).alias("max_score"))
