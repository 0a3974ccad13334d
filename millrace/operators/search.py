"""Top-k search of a stated query set against all rows.

The queries go to the tasks in blocks of bounded size; each task scores its rows against a block and keeps the k best
per query, so what is shuffled is k rows per query and task, whatever the size of the corpus. The last step ranks them.
Scores are compared at six decimals and ties go to the smaller key, so results do not depend on partitioning.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.storage import write_work

#: Queries in a block, rows scored at a time, and the resolution of scores.
BLOCK, SLICE, SCALE = 1024, 2048, 1_000_000
#: Sparse queries in a block (one counts for each so many terms), and rows kept for them; rows, and queries, whose inner
#: products are made at a time.
SPARSE_BLOCK, SPARSE_TERMS, SPARSE_KEPT, SPARSE_ROWS, SPARSE_QUERIES = 16384, 64, 1 << 18, 64, 2048


def _blocks(queries: DataFrame, key: str, block: int, load: Column | None = None) -> Iterator[tuple[int, list]]:
    """The number of blocks, and the rows of queries in blocks of about `block` rows, each read by itself: no task or driver
    holds more than one. load says for how many rows a row counts."""
    n = queries.count() if load is None else math.ceil(queries.agg(F.sum(load)).first()[0] or 0)
    parts = -(-n // block)
    for p in range(parts):
        rows = (queries if parts == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p)).collect()
        if rows:
            yield parts, sorted(rows, key=lambda r: r[0])


def best_rows(corpus: DataFrame, keys: Sequence[str], inputs: Sequence[str], queries: DataFrame, query_key: str, prepare: Callable, score: Callable, k: int, least: float | None = None, block: int = BLOCK, by: Sequence[str] = (), pieces: Callable | None = None, load: Column | None = None, once: bool = False) -> DataFrame:
    """(query_key, *keys, score, rank): for each query the k rows with the greatest score.

    prepare(rows) makes the state of a block of query rows; score(state, columns) gives a matrix of rows by
    queries for the input columns of a slice, with -inf where a row is no candidate. Scores below least are no results.
    by names keys that tell queries of one query_key apart: all rows of a query have the same values there.
    pieces(state, columns, limit), in place of score, yields (rows, queries, matrix) and may leave out what cannot reach
    limit, each query's least scaled score so far. load: as in _blocks. once: the corpus is costly to make, so several blocks share a written copy.
    """
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in corpus.schema}
    schema = f"`{query_key}` {dict(queries.dtypes)[query_key]}, " + ", ".join(f"`{c}` {fields[c]}" for c in keys) + ", score double"
    spark = corpus.sparkSession
    rows = corpus.select(*keys, *inputs)
    found = spark.createDataFrame([], schema)
    floor = None if least is None else round(least * SCALE)
    qtype = queries.schema[query_key].dataType

    def slices(state, cols, limit):
        import numpy as np

        for at in range(0, len(cols[0]), SLICE):
            s = score(state, [c.slice(at, SLICE) for c in cols])
            yield np.arange(at, at + len(s)), np.arange(len(limit)), s

    def mapped(shared):
        def run(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_type

            ids, state = shared.value
            best: list[list] = [[] for _ in ids]
            limit = np.full(len(ids), np.iinfo(np.int64).min if floor is None else floor, dtype=np.int64)
            ktypes = None
            for b in batches:
                ktypes = [b.column(j).type for j in range(len(keys))]
                names = list(zip(*[b.column(j).to_pylist() for j in range(len(keys))], strict=True))
                for at, cs, s in (pieces or slices)(state, [b.column(len(keys) + j) for j in range(len(inputs))], limit):
                    none = ~np.isfinite(s)
                    q = np.rint(np.where(none, 0, s) * SCALE).astype(np.int64)
                    q[none] = np.iinfo(np.int64).min
                    for j in np.flatnonzero(((q >= limit[cs]) & ~none).any(axis=0)):
                        c, col = cs[j], q[:, j]
                        (hit,) = np.nonzero((col >= limit[c]) & ~none[:, j])
                        if len(hit) > 4 * k:  # only the k greatest of a slice, and their ties, can matter
                            hit = hit[col[hit] >= np.partition(col[hit], len(hit) - k)[len(hit) - k]]
                        best[c] = heapq.nsmallest(k, [*best[c], *((-int(col[i]), names[at[i]]) for i in hit)])
                        if len(best[c]) == k:
                            limit[c] = max(limit[c], -best[c][-1][0])
            out = [(ids[c], *name, -v / SCALE) for c, rows_ in enumerate(best) for v, name in rows_]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(cols[0], to_arrow_type(qtype)), *[pa.array(v, t) for v, t in zip(cols[1:-1], ktypes, strict=True)], pa.array(cols[-1], pa.float64())], names=[query_key, *keys, "score"])

        return run

    for parts, rows_ in _blocks(queries, query_key, block, load):
        if once and parts > 1:
            rows, once = write_work(rows, "corpus"), False
        shared = spark.sparkContext.broadcast(([r[query_key] for r in rows_], prepare(rows_)))
        found = found.unionByName(rows.mapInArrow(mapped(shared), schema))
    w = Window.partitionBy(query_key, *by).orderBy(F.col("score").desc(), *keys)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column):
    import numpy as np

    n = len(column)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def dense_topk(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, keys: Sequence[str], vector: str = "embedding", same: str | None = None, least: float | None = None, not_self: str | None = None, block: int = BLOCK) -> DataFrame:
    """The k rows with the greatest cosine for each query; both sides hold vectors of one length.

    Null, empty and zero vectors match nothing. same names a column (in both) whose values must be equal, as
    zones must; not_self a key column that must differ from the query's key. If same is a key too, query keys need
    to be unique only within it.
    """
    usable = lambda df: df.where(F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0))
    q = usable(queries).select(query_key, vector, *([same] if same else []))
    inputs = [vector, *([same] if same else []), *([not_self] if not_self else [])]

    def prepare(rows):
        import numpy as np

        m = np.array([r[vector] for r in rows], dtype=np.float64)
        return m / np.linalg.norm(m, axis=1, keepdims=True), [r[same] for r in rows] if same else None, [r[query_key] for r in rows]

    def score(state, cols):
        import numpy as np

        m, zones, ids = state
        v = _matrix(cols[0])
        s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ m.T
        if same:
            s[np.array(cols[1].to_pylist(), dtype=object)[:, None] != np.array(zones, dtype=object)[None, :]] = -np.inf
        if not_self:
            s[np.array(cols[-1].to_pylist(), dtype=object)[:, None] == np.array(ids, dtype=object)[None, :]] = -np.inf
        return s

    # a key column that is an input too must come under another name
    extra = {c: f"in_{c}" for c in inputs if c in keys}
    return best_rows(usable(corpus).withColumns({n: F.col(c) for c, n in extra.items()}), keys, [extra.get(c, c) for c in inputs], q, query_key, prepare, score, k, least, block, [same] if same in keys else [])


def _postings(rows, ids, weights):
    """term -> (queries, weights) as arrays."""
    import numpy as np

    by: dict = {}
    for c, r in enumerate(rows):
        for t, w in zip(r[ids], r[weights] if weights else [1.0] * len(r[ids]), strict=True):
            by.setdefault(t, []).append((c, w))
    return len(rows), {t: (np.array([c for c, _ in p]), np.array([w for _, w in p])) for t, p in by.items()}


def _sparse_state(rows):
    """The queries' entries, one query behind the other: (queries, terms, ascending), then each entry's query, place of its
    term and weight, and the first entry and number of entries of each query."""
    import numpy as np

    entries = lambda j: (e[j] for c, r in enumerate(rows) for e in zip(repeat(c), r["indices"], r["values"]) if e[1] is not None)  # noqa: B905, E731
    of, ids, w = np.fromiter(entries(0), np.int64), np.fromiter(entries(1), np.int64), np.fromiter(entries(2), np.float64)
    terms, at = np.unique(ids, return_inverse=True)
    size = np.bincount(of, minlength=len(rows))
    return len(rows), terms, of, at, w, np.cumsum(size) - size, size


def _sparse_pieces(state, cols, limit):
    """Inner products of slices of rows, those with the greatest values first, with the queries that a row of the slice may
    bring over their limit: the greatest values of the slice, term by term, bound what its rows can reach."""
    import numpy as np

    n, terms, of, at, w, first, size = state
    finite = np.isfinite(w).all()
    lengths, others = (c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in cols)
    if (lengths != others).any():
        raise ValueError("indices and values differ in length")
    row = np.repeat(np.arange(len(lengths)), lengths)
    ids, values = (c.flatten() for c in cols)
    ids = np.asarray(ids.fill_null(-(2**63)), np.int64)
    values = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
    place = np.minimum(np.searchsorted(terms, ids), max(0, len(terms) - 1))
    have = terms[place] == ids if len(terms) else np.zeros(len(ids), bool)
    row, place, values = row[have], place[have], values[have]
    most = np.zeros(len(lengths))
    np.maximum.at(most, row, np.abs(values))
    ranked = np.argsort(-most, kind="stable")
    rank = np.empty_like(ranked)
    rank[ranked] = np.arange(len(ranked))
    order = np.argsort(rank[row], kind="stable")
    row, place, values = rank[row][order], place[order], values[order]
    for lo in range(0, len(lengths), SPARSE_ROWS):
        a, z = np.searchsorted(row, [lo, lo + SPARSE_ROWS])
        if a == z:
            continue
        names = ranked[lo : lo + SPARSE_ROWS]
        here, local = np.unique(place[a:z], return_inverse=True)
        # values by term and row; the last line stands for terms that no row has
        table = np.bincount(local * len(names) + row[a:z] - lo, weights=values[a:z], minlength=(len(here) + 1) * len(names)).reshape(-1, len(names))
        line = np.full(len(terms), len(here))
        line[here] = np.arange(len(here))
        line = line[at]
        with np.errstate(invalid="ignore"):
            reach = np.bincount(of, weights=np.where(w > 0, w * table.max(axis=1)[line], w * table.min(axis=1)[line]), minlength=n)
        can = np.flatnonzero(~(reach <= 0) & ~(reach * SCALE + 1 < limit))
        can = can[np.argsort(-size[can], kind="stable")]
        for p in range(0, len(can), SPARSE_QUERIES):
            cs = can[p : p + SPARSE_QUERIES]
            s = np.zeros((len(cs), len(names)))
            for j in range(size[cs[0]]):
                e = first[cs[: np.count_nonzero(size[cs] > j)]] + j
                with np.errstate(invalid="ignore"):
                    part = table[line[e]] * w[e][:, None]
                s[: len(e)] += part if finite else np.where(table[line[e]] == 0, 0, part)
            yield names, cs, np.where(s > 0, s, -np.inf).T


def sparse_topk(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, keys: Sequence[str], block: int | None = None, once: bool = False) -> DataFrame:
    """The k rows with the greatest inner product of (indices, values); empty vectors match nothing.

    Whatever cannot reach the k best so far is left out by an exact bound. once: as in best_rows."""
    q = queries.where(F.size("indices") > 0).select(query_key, "indices", "values")
    block = block or max(1, min(SPARSE_BLOCK, SPARSE_KEPT // k))
    return best_rows(corpus, keys, ["indices", "values"], q, query_key, _sparse_state, None, k, None, block, pieces=_sparse_pieces, load=F.greatest(F.lit(1.0), F.size("indices") / SPARSE_TERMS), once=once)


def lexical_topk(queries: DataFrame, corpus: DataFrame, k: int, query_key: str, keys: Sequence[str], text: str = "text", block: int = BLOCK) -> DataFrame:
    """The k rows that hold most of a query's distinct words, rows with the whole query as a substring first.

    The score is the share of the query's words, plus 1 for an exact match; words are runs between white space in lower case.
    Every row with at least one of the words is a candidate.
    """
    from millrace.functions.text import normalize_space, word_set

    t = lambda c: F.lower(normalize_space(F.col(c)))
    q = queries.where(F.size(word_set(F.col(text))) > 0).select(query_key, word_set(F.col(text)).alias("words"), t(text).alias("whole"))

    def prepare(rows):
        return _postings(rows, "words", None), [len(r["words"]) for r in rows], [r["whole"] for r in rows]

    def score(state, cols):
        import numpy as np

        (n, by), sizes, wholes = state
        out = np.full((len(cols[0]), n), -np.inf)
        sizes = np.array(sizes)
        for i, (ws, body) in enumerate(zip(cols[0].to_pylist(), cols[1].to_pylist(), strict=True)):
            hit = [by[w][0] for w in ws or () if w in by]
            if hit:
                m = np.bincount(np.concatenate(hit), minlength=n)
                out[i] = np.where(m > 0, m / sizes, -np.inf)
                for c in np.flatnonzero(m == sizes):
                    out[i, c] += wholes[c] in body
        return out

    rows = corpus.where(F.col(text).isNotNull()).withColumns({"words_": word_set(F.col(text)), "whole_": t(text)})
    return best_rows(rows, keys, ["words_", "whole_"], q, query_key, prepare, score, k, None, block)


def neighbours(rows: DataFrame, group: str, key: str, vector: str, k: int = 3, least: float = 0.70, most_rows: int | None = None, policy: str = "SKIP", within: int = SLICE, block: int = BLOCK) -> DataFrame:
    """For each row the k most similar other rows of its group, with cosine of at least `least`:
    (group, source, target, score, rank). Keys are unique within a group.

    Groups of at most `within` rows are compared in one task, larger ones in blocks of queries against all of their rows,
    so no task holds more than `within` vectors of a group and none is left out. Only if most_rows is given are larger
    groups left out (SKIP, the documented policy for large documents) or do they end the job (FAIL).
    """
    ok = rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull() & F.exists(vector, lambda x: x != 0)).select(group, key, vector)
    sizes = ok.groupBy(group).agg(F.count("*").alias("n_"))
    if most_rows is not None:
        if policy == "FAIL":
            sizes = sizes.withColumn("n_", F.when(F.col("n_") > most_rows, F.raise_error(F.lit("group too large to compare"))).otherwise(F.col("n_")))
        sizes = sizes.where(F.col("n_") <= most_rows)
    small = ok.join(sizes.where(F.col("n_") <= within).select(group), group, "left_semi")
    large = ok.join(sizes.where(F.col("n_") > within).select(group), group, "left_semi")
    kinds = dict(rows.dtypes)

    def near(f):
        import numpy as np
        import pandas as pd

        f = f.sort_values(key).reset_index(drop=True)
        v = np.array(f[vector].tolist(), dtype=np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        s = np.rint(v @ v.T * SCALE).astype(np.int64)
        np.fill_diagonal(s, -(2**62))
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        i = np.repeat(np.arange(len(f)), order.shape[1])
        j = order.ravel()
        rank = np.tile(np.arange(1, order.shape[1] + 1), len(f))
        keep = s[i, j] >= round(least * SCALE)
        i, j, rank = i[keep], j[keep], rank[keep]
        return pd.DataFrame({group: f[group].iloc[0], "source": f[key].to_numpy()[i], "target": f[key].to_numpy()[j], "score": s[i, j] / SCALE, "rank": rank.astype("int32")})

    found = small.groupBy(group).applyInPandas(near, f"`{group}` {kinds[group]}, source {kinds[key]}, target {kinds[key]}, score double, rank int")
    blocks = dense_topk(large.withColumnRenamed(key, "source"), large.withColumnRenamed(key, "target"), k, "source", [group, "target"], vector, same=group, least=least, not_self="target", block=block)
    return found.unionByName(blocks.select(group, "source", "target", "score", "rank"))
