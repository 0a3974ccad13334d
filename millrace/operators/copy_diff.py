"""Differences between two copies of a dataset (problem 4).

Of each side only prints travel first: key print, order and row print, reduced to the latest state per key by an aggregation
that combines before the shuffle. Both sides then add their (key print, row print) pairs with opposite signs into one
invertible Bloom lookup table per bucket of keys, so equal rows cancel inside the aggregation and only cells touched by a
difference are left. Peeling a bucket's cells reveals the prints of the differing keys; only the rows of those keys are
fetched, by a semi join against the written key table, reduced to their latest state and compared field by field. A
bucket with more differences than its table can hold does not peel: then all its keys are fetched, which is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import write_work

#: Stands for "never expires" in whole seconds.
NEVER_EPOCH = 253402300799
_HASHES = 3
#: Names beside the columns of the data, which may have any others.
_K, _B = "__diff_key_print__", "__diff_bucket__"


def json_value(col: Column) -> Column:
    """One text for equal JSON values: keys sorted, spacing dropped, equal numbers alike. Text that is no JSON stays."""
    v = F.to_json(F.try_parse_json(col))
    # 1.0 is the value 1; strings are matched first, so that digits inside them are not touched
    v = F.regexp_replace(v, r'("(?:[^"\\]|\\.)*")|(-?\d+)\.0+(?=[,\]}]|$)', "$1$2")
    return F.coalesce(v, col)


def _named(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in key))


def _key_print(key: Sequence[str], seed: int = 0) -> Column:
    return F.xxhash64(*([F.lit(seed)] if seed else []), *[F.lower(F.col(k)) for k in key])


def _rank(order: str, fields: Mapping[str, Column]) -> Column:
    """(time, print of the fields): of rows with one key the greatest is the latest state."""
    return F.struct(F.coalesce(F.unix_micros(F.col(order)), F.lit(-(2**63))).alias("o"), F.xxhash64(*[x for c in fields.values() for x in (c, c.isNull())]).alias("r"))


def latest(df: DataFrame, key: Sequence[str], order: str, fields: Mapping[str, Column]) -> DataFrame:
    """The row with the greatest order value of each key (null order ranks lowest; of ties the one with the
    greater print of its fields, so the choice does not depend on row order). Keys with a null part are dropped."""
    row = F.struct(*[c.alias(n) for n, c in fields.items()])
    return _named(df, key).groupBy(*[F.lower(F.col(k)).alias(k) for k in key]).agg(F.max_by(row, _rank(order, fields)).alias("row")).select(*key, "row.*")


def latest_prints(df: DataFrame, key: Sequence[str], order: str, fields: Mapping[str, Column]) -> DataFrame:
    """(k, r): the key's print and the row print of the row that latest gives. Keys are told apart by 128 bits."""
    rows = _named(df, key).select(_key_print(key).alias("k"), _key_print(key, 11).alias("k2"), _rank(order, fields).alias("m"))
    return rows.groupBy("k", "k2").agg(F.max("m").alias("m")).select("k", "m.r")


def _peel(m: int):
    """applyInPandas body: reveal the key prints in one bucket's cells; a bucket that does not empty is marked whole."""
    import numpy as np

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        bucket = int(cells["bucket"].iloc[0])
        mask = (1 << 64) - 1
        table = {int(c): [int(n), int(k) & mask, int(r) & mask, int(x) & mask] for c, n, k, r, x in zip(cells["cell"], cells["n"], cells["k"], cells["r"], cells["x"], strict=True)}
        found: set[int] = set()
        todo = list(table)
        while todo:
            c = todo.pop()
            e = table.get(c)
            if e is None or abs(e[0]) != 1 or _check(e[1], e[2]) != e[3]:
                continue
            n, k, r, x = e
            found.add(k)
            for j in range(_HASHES):
                d = _cell(x, j, m)
                t = table.setdefault(d, [0, 0, 0, 0])
                t[0] -= n
                t[1] ^= k
                t[2] ^= r
                t[3] ^= x
                if t == [0, 0, 0, 0]:
                    del table[d]
                else:
                    todo.append(d)
        if table:
            return pd.DataFrame({"bucket": [bucket], "k": [0], "whole": [True]})
        k = np.array(sorted(found), dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"bucket": bucket, "k": k, "whole": False})

    return run


def _check(k: int, r: int) -> int:
    """Spark's xxhash64(k, r): not linear, so a cell holding several pairs is not taken for one that holds a single pair."""
    import struct

    import xxhash

    return xxhash.xxh64_intdigest(struct.pack("<Q", r), seed=xxhash.xxh64_intdigest(struct.pack("<Q", k), seed=42))


def _cell(x: int, j: int, m: int) -> int:
    third = m // _HASHES
    return j * third + ((x >> (j * 21)) & 0x1FFFFF) % third


def _cell_col(x: Column, j: int, m: int) -> Column:
    third = m // _HASHES
    return (F.shiftrightunsigned(x, j * 21).bitwiseAND(F.lit(0x1FFFFF)) % third + j * third).cast("int")


def _bucket(buckets: int, k: str = "k") -> Column:
    return F.pmod(F.xxhash64(k, F.lit(7)), F.lit(buckets)).cast("int")


def revealed_keys(a: DataFrame, b: DataFrame, buckets: int, cells: int) -> DataFrame:
    """(bucket, k, whole): prints of keys whose rows differ between a and b, both with columns k, r. The pairs move to their
    bucket once; tables are filled and peeled where they arrive."""
    pairs = a.select("k", "r", F.lit(1).alias("n")).unionByName(b.select("k", "r", F.lit(-1).alias("n")))
    placed = pairs.withColumns({"bucket": _bucket(buckets), "x": F.xxhash64("k", "r")}).repartition("bucket")
    left = (
        placed.withColumn("cell", F.explode(F.array(*[_cell_col(F.col("x"), j, cells) for j in range(_HASHES)])))
        .groupBy("bucket", "cell")
        .agg(F.sum("n").alias("n"), *[F.expr(f"bit_xor({c})").alias(c) for c in "krx"])
        .where("n != 0 OR k != 0 OR r != 0 OR x != 0")
    )
    return left.groupBy("bucket").applyInPandas(_peel(cells), "bucket int, k long, whole boolean")


def copy_differences(
    a: DataFrame,
    b: DataFrame,
    key: Sequence[str],
    compare: Mapping[str, tuple[Column, Column]],
    order_a: str,
    order_b: str,
    only_a: str = "missing_in_b",
    only_b: str = "missing_in_a",
    buckets: int | None = None,
    cells: int = 1536,
) -> DataFrame:
    """(*key, difference): one row per key that only one copy has, and per differing field of a key in both.

    compare gives, per field, the expression over a and the one over b, of one type; values differ unless equal
    or both null. Keys are compared and returned in lower case; rows with a null key part belong to no point and
    give no row. Each copy may hold earlier states: the row with the latest order value counts (see latest).
    Extra columns are ignored; an empty side makes every key of the other one missing.
    A bucket's table has so many cells, whatever the size of the data; by default a bucket takes about 2048 rows (the
    counts come from the file footers), of which about 600 may differ. These settings bound memory, not
    results: overfull buckets are compared key by key.
    """
    if cells % _HASHES or cells // _HASHES > 0x1FFFFF:
        raise ValueError("cells must be a multiple of 3 and below 6291456")
    key = list(key)
    n = buckets or max(64, -(-max(a.count(), b.count()) // 2048))

    fields_a, fields_b = ({f: c[at] for f, c in compare.items()} for at in (0, 1))
    # written, so that the joins below know the size of what they look for before they choose how to move the rows
    keys = write_work(revealed_keys(latest_prints(a, key, order_a, fields_a), latest_prints(b, key, order_b, fields_b), n, cells), "revealed")
    any_whole = bool(keys.where("whole").limit(1).count())

    def fetched(df: DataFrame, order: str, fields: Mapping[str, Column]) -> DataFrame:
        rows = _named(df, key).withColumn(_K, _key_print(key))
        found = rows.join(keys.where("NOT whole").select(F.col("k").alias(_K)), _K, "left_semi")
        if any_whole:
            marked = rows.withColumn(_B, _bucket(n, _K)).join(keys.where("whole").select(F.col("bucket").alias(_B)), _B, "left_semi")
            found = found.unionByName(marked.drop(_B))
        return latest(found, key, order, fields).select(*key, F.struct(*compare).alias("row"))

    both = fetched(a, order_a, fields_a).alias("a").join(fetched(b, order_b, fields_b).alias("b"), key, "full_outer").select(*key, F.col("a.row").alias("ra"), F.col("b.row").alias("rb"))
    fields = [F.when(~F.col(f"ra.{n}").eqNullSafe(F.col(f"rb.{n}")), F.lit(n)) for n in compare]
    found = F.when(F.col("rb").isNull(), F.array(F.lit(only_a))).when(F.col("ra").isNull(), F.array(F.lit(only_b))).otherwise(F.array_compact(F.array(*fields)))
    return both.select(*key, F.explode(found).alias("difference"))
