"""Retrieval, latency and stability metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ir_metrics(ranking: DataFrame, judgments: DataFrame, key: str, query: str = "query_id") -> DataFrame:
    """Per judged query precision@5, hit@5, recall@5/10/20, reciprocal rank@10 and nDCG@10 with gain 2^rel - 1.

    ranking (query, key, rank from 1), judgments (query, key, relevance > 0). A query without results scores 0.
    """
    j = judgments.where("relevance > 0").groupBy(query, key).agg(F.max("relevance").alias("relevance"))
    hit = ranking.groupBy(query, key).agg(F.min("rank").alias("rank")).join(j, [query, key])
    gain = lambda rel, r: (F.pow(F.lit(2.0), rel.cast("double")) - 1) / F.log2(r + F.lit(1.0))
    ideal = j.withColumn("r", F.row_number().over(Window.partitionBy(query).orderBy(F.col("relevance").desc(), key))).groupBy(query).agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("r") <= 10, gain(F.col("relevance"), F.col("r")))).alias("ideal"))
    at = lambda k: F.count_if(F.col("rank") <= k)
    got = hit.groupBy(query).agg(at(5).alias("h5"), at(10).alias("h10"), at(20).alias("h20"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, gain(F.col("relevance"), F.col("rank")))).alias("dcg"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    out = ideal.join(got, query, "left")
    return out.select(query, (z("h5") / 5).alias("p5"), (z("h5") > 0).cast("int").alias("hit5"), *[F.round(z(f"h{k}") / F.col("n_relevant"), 9).alias(f"recall{k}") for k in (5, 10, 20)], F.round(F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0), 9).alias("rr10"), F.round(z("dcg") / F.col("ideal"), 9).alias("ndcg10"))


def macro(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Means over queries."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in columns])


def no_answer(outcomes: DataFrame, by: Sequence[str] = (), thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Outcomes (*by, expected_empty, answered) per query, by slice: precision and recall of giving no answer, the share of
    answerable queries that got none (false abstention), and whether all thresholds hold: a least value for the first two, a
    greatest for the last. 0 where there is nothing to divide by; null flags count as false."""
    limits = {"no_answer_precision": 0.0, "no_answer_recall": 0.0, "false_abstention": 1.0, **(thresholds or {})}
    empty, silent = F.coalesce("expected_empty", F.lit(False)), ~F.coalesce("answered", F.lit(False))
    g = outcomes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(silent).alias("s"), F.count_if(empty).alias("e"), F.count_if(silent & empty).alias("both"))
    answerable = F.col("n") - F.col("e")
    out = g.select(*by, F.col("n").alias("n_queries"), F.round(ratio(F.col("both"), F.col("s")), 6).alias("no_answer_precision"), F.round(ratio(F.col("both"), F.col("e")), 6).alias("no_answer_recall"), F.round(ratio(F.col("s") - F.col("both"), answerable), 6).alias("false_abstention"))
    holds = (F.col("no_answer_precision") >= limits["no_answer_precision"]) & (F.col("no_answer_recall") >= limits["no_answer_recall"]) & (F.col("false_abstention") <= limits["false_abstention"])
    return out.withColumn("passed", holds)


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def nearest_rank_up(values: DataFrame, by: Sequence[str], value: str, ps: Sequence[float]) -> DataFrame:
    """The element at ceil((n - 1) * p) of the sorted values, exactly.

    Equal values are counted before anything moves; the distinct values of a group are cut into `cells` stretches of equal width,
    whose counts give each stretch its offset, so running sums never go over a whole group in one task.
    Null values are left out; a group without values gives no row. Values are numbers.
    """
    by = list(by)
    cells = 1024
    c = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("c_"))
    span = c.groupBy(*by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"), F.sum("c_").alias("n"))
    v, lo, hi = (F.col(x).cast("double") for x in (value, "lo_", "hi_"))
    c = c.join(span, by).withColumn("cell_", F.when(hi > lo, F.least(F.lit(cells - 1), F.floor((v - lo) / F.nullif(hi - lo, F.lit(0.0)) * cells))).otherwise(0).cast("int"))
    part = c.groupBy(*by, "cell_").agg(F.sum("c_").alias("s_"))
    part = part.withColumn("before_", F.sum("s_").over(Window.partitionBy(*by).orderBy("cell_")) - F.col("s_")).drop("s_")
    c = c.join(part, [*by, "cell_"]).withColumn("upto_", F.col("before_") + F.sum("c_").over(Window.partitionBy(*by, "cell_").orderBy(value)))
    pick = lambda p: F.min(F.when(F.col("upto_") > F.ceil((F.col("n") - 1) * F.lit(p)), F.col(value))).alias(f"p{round(p * 100)}")
    return c.groupBy(*by).agg(F.max("n").alias("n"), *[pick(p) for p in ps], F.max(value).alias("max"))


def stability(a: DataFrame, b: DataFrame, key: str, k: int, query: str = "query_id") -> DataFrame:
    """Whether the first results agree, and the Jaccard similarity of the first k, of two runs (query, key, rank).
    Two empty results are alike (1)."""
    side = lambda d, n: d.where(F.col("rank") <= k).groupBy(query).agg(F.collect_set(key).alias(n), F.min_by(key, "rank").alias(n + "1"))
    j = side(a, "x").join(side(b, "y"), query, "full_outer")
    empty = F.array().cast(dict(side(a, "x").dtypes)["x"])
    x, y = F.coalesce("x", empty), F.coalesce("y", empty)
    u = F.size(F.array_union(x, y))
    return j.select(query, F.coalesce(F.col("x1").eqNullSafe(F.col("y1")), F.lit(False)).alias("top1"), F.when(u == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(x, y)) / u, 9)).alias("jaccard"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """struct<low, high>, the score interval of a proportion; [0, 1] for n = 0."""
    p, zz = successes / n, z * z
    mid = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.struct(F.round(F.when(n > 0, low).otherwise(0.0), 9).alias("low"), F.round(F.when(n > 0, high).otherwise(1.0), 9).alias("high"))
