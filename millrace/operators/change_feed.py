"""Applying a stream of inserts, updates and deletes (problem 1).

Deliveries of one change are reduced to the one with the highest attempt by a hash aggregation that starts before
the shuffle, on (key, version), so a hot key spreads over all tasks. What is left per key is associative: the
latest upsert, payload update and delete, each with its version. Tasks keep them in embedded DuckDB tables
through conditional conflict updates (a stored sequence gives way only to a greater one): once before the rows of
a key meet, exporting a table whenever it has grown to its bound, and once per bucket of keys. The number of buckets
follows the number of events, and a task works on its buckets one after the other, so memory does not grow with the
data. Tombstones stay in the state, and the bucket results are published with one rename.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import publish

#: Operation codes; of two deliveries with equal version and attempt the greater code holds.
UPSERT, UPDATE, DELETE = 1, 2, 3
OPERATIONS = {"UPSERT_POINT": UPSERT, "UPDATE_PAYLOAD": UPDATE, "DELETE_POINT": DELETE}
_NONE = -(2**63)
_SEQS = ("up", "pay", "del")
#: Keys in one DuckDB table: about 230 bytes each, index included.
BUCKET_KEYS = 1 << 20
_ROWS = 100_000


def _operation_code(op: Column) -> Column:
    name = F.upper(F.regexp_replace(op, r"(?U)^\s+|\s+$", ""))
    code = F.lit(0)
    for k, v in OPERATIONS.items():
        code = F.when(name == k, v).otherwise(code)
    return code


def _merge_states(nkeys: int, memory_limit: str, most_keys: int = BUCKET_KEYS, bucketed: bool = False):
    """mapInArrow body: upsert partial states (bucket, keys, sequences) into a DuckDB table keyed by the row key, and export
    it. Rows of a key may come back in several exports unless bucketed: then rows come sorted by bucket, and each bucket is
    exported as a whole; else a table is exported when it holds most_keys."""

    def run(batches: Iterator) -> Iterator:
        import duckdb
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = [f"k{i}" for i in range(nkeys)]
        con = duckdb.connect(config={"threads": 1, "memory_limit": memory_limit, "temp_directory": ""})
        seqs = ", ".join(f"{s}_v BIGINT, {s}_a BIGINT" for s in _SEQS)
        create = f"CREATE OR REPLACE TABLE state (bucket INTEGER, {', '.join(f'{k} VARCHAR' for k in keys)}, {seqs}, PRIMARY KEY ({', '.join(keys)}))"
        best = ", ".join(f"max({s}_v), arg_max({s}_a, {s}_v)" for s in _SEQS)
        newer = " OR ".join(f"excluded.{s}_v > state.{s}_v" for s in _SEQS)
        sets = ", ".join(
            f"{s}_a = CASE WHEN excluded.{s}_v > state.{s}_v THEN excluded.{s}_a ELSE state.{s}_a END, "
            f"{s}_v = greatest(excluded.{s}_v, state.{s}_v)"
            for s in _SEQS
        )
        upsert = (
            f"INSERT INTO state SELECT bucket, {', '.join(keys)}, {best} FROM incoming GROUP BY ALL "
            f"ON CONFLICT ({', '.join(keys)}) DO UPDATE SET {sets} WHERE {newer}"
        )
        con.execute(create)
        held: list = []
        rows = 0

        def flush() -> None:
            nonlocal held, rows
            if held:
                con.register("incoming", pa.Table.from_batches(held))
                con.execute(upsert)
                con.unregister("incoming")
            held, rows = [], 0

        def export() -> Iterator:
            flush()
            yield from con.sql("SELECT * FROM state").to_arrow_reader(65_536)
            con.execute(create)

        current = None
        for b in batches:
            while b.num_rows:
                part, b = b, b.slice(b.num_rows)
                if bucketed:
                    first = part.column(0)[0].as_py()
                    n = pc.sum(pc.equal(part.column(0), first)).as_py()  # sorted, so these lead the batch
                    part, b = part.slice(0, n), part.slice(n)
                    if first != current:
                        if current is not None:
                            yield from export()
                        current = first
                held.append(part)
                rows += part.num_rows
                if rows >= _ROWS:
                    flush()
                    if not bucketed and con.execute("SELECT count(*) FROM state").fetchall()[0][0] >= most_keys:
                        yield from export()
        yield from export()
        con.close()

    return run


def apply_changes(
    events: DataFrame,
    key: Sequence[str] = ("access_zone_id", "binding_id"),
    operation: str = "operation",
    version: str = "operation_version",
    attempt: str = "attempt_count",
    memory_limit: str = "700MB",
    buckets: int | None = None,
) -> DataFrame:
    """State of every key at the end of the feed: (*key, operation_version, attempt_count, deleted).

    Key strings are compared and returned in lower case; the operation without case and padding. A row without
    a key part or version is no change, nor is a change whose holding delivery names an unknown operation. A null attempt
    ranks below every other. Among deliveries with equal version and attempt, DELETE holds before UPDATE before
    UPSERT. Repeated rows count once; order of arrival plays no part. deleted marks a tombstone, whose
    operation_version is that of the delete; keys that only ever saw updates have no state and no row.
    Attempts must lie within ±2^59. An empty feed gives an empty state; other columns are ignored. By default there are
    so many buckets that even a feed of one event for every key fills none of them beyond BUCKET_KEYS / 2 on average.
    """
    key = list(key)
    code = F.coalesce(F.col(attempt).cast("bigint"), F.lit(-1)) * 4 + _operation_code(F.col(operation))
    changes = (
        events.select(*[F.lower(F.col(k)).alias(f"k{i}") for i, k in enumerate(key)], F.col(version).cast("bigint").alias("v"), code.alias("c"))
        .where(" AND ".join(f"k{i} IS NOT NULL" for i in range(len(key))) + " AND v IS NOT NULL")
        .groupBy(*[f"k{i}" for i in range(len(key))], "v")
        .agg(F.max("c").alias("c"))
    )
    op, tries = F.pmod(F.col("c"), F.lit(4)), F.shiftright("c", 2)
    keys = [f"k{i}" for i in range(len(key))]
    seqs = []
    for s, o in zip(_SEQS, (UPSERT, UPDATE, DELETE), strict=True):
        seqs += [F.when(op == o, F.col("v")).otherwise(F.lit(_NONE)).alias(f"{s}_v"), F.when(op == o, tries).otherwise(F.lit(_NONE)).alias(f"{s}_a")]
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or -(-2 * events.count() // BUCKET_KEYS)
    few = n <= parts  # then a task is a bucket
    bucket = F.lit(0) if few else F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    partial = changes.where(op != 0).select(bucket.alias("bucket"), *keys, *seqs)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), *[T.StructField(k, T.StringType()) for k in keys], *[T.StructField(f"{s}_{x}", T.LongType()) for s in _SEQS for x in "va"]])
    met = partial.mapInArrow(_merge_states(len(key), memory_limit, BUCKET_KEYS // 2), schema)
    met = met.repartition(parts, *keys) if few else met.repartition(parts, "bucket").sortWithinPartitions("bucket")
    state = met.mapInArrow(_merge_states(len(key), memory_limit, bucketed=True), schema)
    live = F.col("up_v") > F.col("del_v")
    paid = live & (F.col("pay_v") > F.col("up_v"))
    pick = lambda x: F.when(paid, F.col(f"pay_{x}")).when(live, F.col(f"up_{x}")).otherwise(F.col(f"del_{x}"))
    tries = F.when(pick("a") == -1, F.lit(None)).otherwise(pick("a"))
    return state.where(live | (F.col("del_v") > _NONE)).select(
        *[F.col(k).alias(n) for k, n in zip(keys, key, strict=True)], pick("v").alias("operation_version"), tries.alias("attempt_count"), (~live).alias("deleted")
    )


def publish_state(events: DataFrame, target: str, **options) -> DataFrame:
    """apply_changes, written bucket by bucket and published all at once under target."""
    return publish(apply_changes(events, **options), target)
