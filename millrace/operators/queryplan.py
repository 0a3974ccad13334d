"""Query plans for a whole table of queries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.querytext import Limits, plan

_SEGMENT = "struct<index:int,kind:string,weight:double,tokens:int,token_start:int,token_end:int,byte_start:int,byte_end:int,original_start:int,original_end:int,required:boolean,intent_ids:array<int>,text:string>"
_INTENT = "struct<id:int,kind:string,required:boolean,weight:double,segments:array<int>,byte_start:int,byte_end:int,text:string,hash:string>"


def plan_queries(queries: DataFrame, key: str, text: str, limits: Limits | None = None) -> DataFrame:
    """(key, error, tier, normalized_text, n_tokens, segments, intents), one row per query; null and blank texts have the error EMPTY."""
    limits = limits or Limits()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(out_schema)
        for b in batches:
            plans = [plan(t or "", limits) for t in b.column(1).to_pylist()]
            cols = [b.column(0)] + [pa.array([p.get(n) for p in plans], fields.field(i).type) for i, n in enumerate(("error", "tier", "text", "tokens", "segments", "intents"), 1)]
            yield pa.record_batch(cols, names=[key, "error", "tier", "normalized_text", "n_tokens", "segments", "intents"])

    kind = dict(queries.dtypes)[key]
    schema = f"`{key}` {kind}, error string, tier string, normalized_text string, n_tokens int, segments array<{_SEGMENT}>, intents array<{_INTENT}>"
    out_schema = queries.sparkSession.createDataFrame([], schema).schema
    return queries.select(key, text).mapInArrow(run, schema)


def segments_of(plans: DataFrame, key: str) -> DataFrame:
    return plans.select(key, F.inline("segments"))


def intents_of(plans: DataFrame, key: str) -> DataFrame:
    return plans.select(key, F.inline("intents"))


def bound_intents(plans: DataFrame, key: str) -> DataFrame:
    """Pairs of segments and intents whose byte ranges overlap, for plans whose ranges came from elsewhere too."""
    s = plans.select(key, F.posexplode("segments").alias("i", "s"))
    t = plans.select(key, F.posexplode("intents").alias("j", "t"))
    # both sides hold a handful of rows per query; the equality on the query carries the join
    return s.join(t, key).where("s.byte_start < t.byte_end AND t.byte_start < s.byte_end").select(key, F.col("s.index").alias("segment_index"), F.col("t.id").alias("intent_id"))
