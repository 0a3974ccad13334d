"""Point reads, visibility and hydration of candidates.

as_of is always a parameter. Every key holds the access zone. Candidate sides are small beside the tables, which Spark sees at
run time: no join is forced to broadcast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE_CHUNK = ["access_zone_id", "chunk_id"]
#: Stands for "never" in whole seconds, so that expiry is one range comparison.
NEVER_EPOCH = 253402300799


def by_keys(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows with one of the keys; repeated and unknown keys do no harm."""
    return rows.join(keys.select(*on), list(on), "left_semi")


def chunk_group(chunks: DataFrame, roots: DataFrame) -> DataFrame:
    """All chunks under the given (access_zone_id, root_id), with their place in the group."""
    from pyspark.sql.window import Window

    rows = by_keys(chunks, roots, ["access_zone_id", "root_id"])
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("access_zone_id", "root_id").orderBy("granularity", F.col("sequence_no").asc_nulls_last(), "chunk_id")))


def alive(as_of: str, status: str = "lifecycle_status", expires: str = "expires_at") -> Column:
    """Active and not expired; an expiry equal to as_of has passed, a null one never does."""
    return (F.col(status) == "ACTIVE") & (F.col(expires).isNull() | (F.col(expires) > F.lit(as_of).cast("timestamp")))


def index_filter(points: DataFrame, level: int, as_of_epoch: int, zones: Sequence[str] | None = None, equal: Mapping[str, str] | None = None) -> DataFrame:
    """What a search of the index may return; all of it reaches the scan as pushed filters.

    Empty strings in equal mean no filter. A null level, status or expiry hides the point."""
    out = points.where((F.col("access_level") <= level) & (F.col("lifecycle_status") == "ACTIVE") & (F.col("expires_at_epoch") > as_of_epoch))
    if zones is not None:
        out = out.where(F.col("access_zone_id").isin(list(zones)))
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v) if v != "" else out
    return out


def visible_chunks(chunks: DataFrame, bindings: DataFrame, versions: DataFrame, level: int, as_of: str) -> DataFrame:
    """Chunks that are active in an active document version and bound within the caller's level, unexpired."""
    live = versions.where("status = 'ACTIVE' AND lifecycle_status = 'ACTIVE'").select("access_zone_id", "document_id", "document_version")
    bound = bindings.where((F.col("access_level") <= level) & alive(as_of)).select(*ZONE_CHUNK).distinct()
    return chunks.where("lifecycle_status = 'ACTIVE'").join(live, ["access_zone_id", "document_id", "document_version"], "left_semi").join(bound, ZONE_CHUNK, "left_semi")


def parent_context(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with the text of the PARENT chunk they belong to (themselves, if they are one)."""
    c = chunks.select(*ZONE_CHUNK, "parent_id", "granularity", "document_id", "document_version")
    p = chunks.where("granularity = 'PARENT'").select("access_zone_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("content").alias("parent_text"))
    return candidates.join(c, ZONE_CHUNK).withColumn("parent_chunk_id", F.coalesce("parent_id", "chunk_id")).drop("parent_id").join(p, ["access_zone_id", "parent_chunk_id"])


def latest_embedding(bindings: DataFrame, vectors: DataFrame, point: str = "qdrant_point_id") -> DataFrame:
    """The vector of each chunk's newest synchronised binding; vectors (access_zone_id, point, vector)."""
    newest = bindings.where("qdrant_sync_status = 'SYNCED'").groupBy(*ZONE_CHUNK).agg(F.max_by(point, F.struct("updated_at", point)).alias(point))
    return newest.join(vectors, ["access_zone_id", point])


def hydrate(candidates: DataFrame, bindings: DataFrame, chunks: DataFrame, versions: DataFrame, level: int, as_of: str) -> DataFrame:
    """Exactly one outcome for each candidate (query_id, access_zone_id, binding_id, chunk_id, parent_chunk_id, granularity).

    In order: BINDING_INVALID (binding or chunk missing or at odds with the candidate), HYDRATION_MISSING (parent or document
    version missing), BINDING_INVALID (parent at odds), VISIBILITY_REJECTED, EMPTY_CONTEXT, HYDRATED."""
    k = candidates.withColumnRenamed("chunk_id", "matched")
    b = bindings.select("access_zone_id", "binding_id", F.struct("chunk_id", "chunk_granularity", "document_id", "document_version", "parent_chunk_id", "representation_type", "access_level", "lifecycle_status", "qdrant_sync_status", "expires_at").alias("b"))
    one = chunks.select("access_zone_id", "chunk_id", F.struct("document_id", "document_version", "parent_id", "root_id", "granularity", "lifecycle_status", "content", F.lit(True).alias("there")).alias("c"))
    m = one.select("access_zone_id", F.col("chunk_id").alias("matched"), F.col("c").dropFields("content").alias("m"))
    p = one.select("access_zone_id", F.col("chunk_id").alias("parent_chunk_id"), F.col("c").alias("p"))
    d = versions.select(F.col("access_zone_id").alias("d_zone"), F.col("document_id").alias("d_id"), F.col("document_version").alias("d_version"), F.struct("status", "lifecycle_status").alias("d"))
    j = k.join(b, ["access_zone_id", "binding_id"], "left").join(m, ["access_zone_id", "matched"], "left").join(p, ["access_zone_id", "parent_chunk_id"], "left")
    j = j.join(d, (F.col("access_zone_id") == F.col("d_zone")) & (F.col("p.document_id") == F.col("d_id")) & (F.col("p.document_version") == F.col("d_version")), "left").drop("d_zone", "d_id", "d_version")
    sub, par = F.col("granularity").isin("SUB_180", "SUB_260"), F.col("granularity") == "PARENT"
    ne = lambda a, x: F.col(a) != F.col(x)
    distinct = lambda a, x: ~F.col(a).eqNullSafe(F.col(x))
    odd = (
        F.col("b").isNull() | F.col("m").isNull() | ne("b.chunk_id", "matched") | ne("b.chunk_granularity", "granularity") | ne("b.document_id", "m.document_id") | ne("b.document_version", "m.document_version")
        | (sub & (distinct("b.parent_chunk_id", "parent_chunk_id") | distinct("m.parent_id", "parent_chunk_id")))
        | (par & (F.col("b.parent_chunk_id").isNotNull() | F.col("m.parent_id").isNotNull() | ne("matched", "parent_chunk_id"))) | ~(sub | par)
    )
    apart = ne("m.document_id", "p.document_id") | ne("m.document_version", "p.document_version") | ne("m.root_id", "p.root_id")
    hidden = (
        ne_("b.lifecycle_status", "ACTIVE") | ne_("b.qdrant_sync_status", "SYNCED") | (F.col("b.expires_at") <= F.lit(as_of).cast("timestamp")) | (F.col("b.access_level") > level) | ne_("b.representation_type", "ORIGINAL")
        | ne_("m.lifecycle_status", "ACTIVE") | ne_("p.lifecycle_status", "ACTIVE") | ne_("p.granularity", "PARENT") | ne_("d.status", "ACTIVE") | ne_("d.lifecycle_status", "ACTIVE")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    outcome = F.when(yes(odd), "BINDING_INVALID").when(F.col("p").isNull() | F.col("d").isNull(), "HYDRATION_MISSING").when(yes(apart), "BINDING_INVALID").when(yes(hidden), "VISIBILITY_REJECTED").when(F.trim(F.coalesce("p.content", F.lit(""))) == "", "EMPTY_CONTEXT").otherwise("HYDRATED")
    return j.select(*[c if c != "chunk_id" else F.col("matched").alias("chunk_id") for c in candidates.columns], outcome.alias("outcome"), F.when(outcome == "HYDRATED", F.col("p.content")).alias("parent_text"))


def ne_(column: str, value: str) -> Column:
    return F.col(column) != value


def settle(outcomes: DataFrame, query: str = "query_id") -> DataFrame:
    """The survivors: a rejection that concerns the parent takes all candidates of that parent with it."""
    from pyspark.sql.window import Window

    scoped = F.col("outcome").isin("VISIBILITY_REJECTED", "HYDRATION_MISSING", "EMPTY_CONTEXT")
    bad = F.max(scoped.cast("int")).over(Window.partitionBy(query, "access_zone_id", "parent_chunk_id"))
    return outcomes.withColumn("bad_", bad).where("outcome = 'HYDRATED' AND bad_ = 0").drop("bad_")


def hydration_coverage(outcomes: DataFrame, query: str = "query_id") -> DataFrame:
    """FULL, PARTIAL or NONE_DUE_TO_INFRASTRUCTURE_FAILURE per query."""
    kept = settle(outcomes, query).groupBy(query).agg(F.count("*").alias("survivors"))
    g = outcomes.groupBy(query).agg(F.count_if(F.col("outcome") != "HYDRATED").alias("dropped"), F.count_if(F.col("outcome") == "HYDRATION_MISSING").alias("broken")).join(kept, query, "left").withColumn("survivors", F.coalesce("survivors", F.lit(0)))
    cls = F.when(F.col("dropped") == 0, "FULL").when((F.col("survivors") > 0) | (F.col("broken") == 0), "PARTIAL").otherwise("NONE_DUE_TO_INFRASTRUCTURE_FAILURE")
    return g.select(query, "survivors", "dropped", cls.alias("coverage"))


def recheck(results: DataFrame, bindings: DataFrame, chunks: DataFrame, versions: DataFrame, level: int, as_of: str) -> DataFrame:
    """results that are still visible on every side; a null binding_id is allowed, any other must agree and be synchronised."""
    m = chunks.where("lifecycle_status = 'ACTIVE'").select(*ZONE_CHUNK, F.coalesce("parent_id", "chunk_id").alias("parent_chunk_id"), "parent_id", "document_id", "document_version")
    p = chunks.where("lifecycle_status = 'ACTIVE' AND granularity = 'PARENT'").select("access_zone_id", F.col("chunk_id").alias("parent_chunk_id"), "document_id", "document_version")
    d = versions.where("status = 'ACTIVE' AND lifecycle_status = 'ACTIVE'").select("access_zone_id", "document_id", "document_version")
    b = bindings.where(alive(as_of) & (F.col("access_level") <= level) & (F.col("qdrant_sync_status") == "SYNCED") & (F.col("representation_type") == "ORIGINAL")).select("access_zone_id", "binding_id", *[F.col(c).alias(f"b_{c}") for c in ("chunk_id", "document_id", "document_version", "parent_chunk_id")])
    j = results.join(m, [*ZONE_CHUNK, "parent_chunk_id"]).join(p, ["access_zone_id", "parent_chunk_id", "document_id", "document_version"], "left_semi").join(d, ["access_zone_id", "document_id", "document_version"], "left_semi").join(b, ["access_zone_id", "binding_id"], "left")
    agrees = (F.col("b_chunk_id") == F.col("chunk_id")) & (F.col("b_document_id") == F.col("document_id")) & (F.col("b_document_version") == F.col("document_version")) & F.col("b_parent_chunk_id").eqNullSafe(F.col("parent_id"))
    return j.where(F.col("binding_id").isNull() | F.coalesce(agrees, F.lit(False))).select(*results.columns)


def index_payload(bindings: DataFrame) -> DataFrame:
    """what the index keeps of a binding, typed, with the sentinel for an expiry that never comes."""
    epoch = F.coalesce(F.floor(F.unix_micros("expires_at") / F.lit(1_000_000)), F.lit(NEVER_EPOCH)).cast("bigint")
    return bindings.select("access_zone_id", "qdrant_point_id", "binding_id", "chunk_id", F.coalesce("parent_chunk_id", "chunk_id").alias("parent_chunk_id"), "document_id", "document_version", F.col("chunk_granularity").alias("granularity"), "representation_type", "access_level", "lifecycle_status", "qdrant_sync_status", epoch.alias("expires_at_epoch"), "payload_version", "model_version", "metadata")
