"""JSON-lines sources, schema checks and report sinks."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.storage import _fs, publish

#: Schemas of evaluation inputs: corpus documents, relations, queries and judgments.
SCHEMAS = {
    "document": "schema_version string, document_id string, title string, corpus string, access_zone_code string, access_level string, tags array<string>, ttl_days int, legal_hold boolean, metadata map<string,string>, blocks array<struct<block_id:string,type:string,heading:string,text:string>>",
    "relation": "schema_version string, relation_id string, corpus string, from_document_id string, from_block_id string, to_document_id string, to_block_id string, relation_type string, weight double",
    "query": "schema_version string, id string, category string, question string, tags array<string>, language string, critical boolean, as_of_date date, context struct<access_zone_code:string,caller_access_level:string,profile:string>, expected struct<must_contain_phrases:array<string>,must_contain_document_ids:array<string>,forbidden_phrases:array<string>,forbidden_document_ids:array<string>,min_contexts_count:int,max_contexts_count:int,expected_empty:boolean>",
    "judgment": "query_id string, relevant array<struct<document_id:string,source_block_id:string,relevance:int>>",
}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped. A line that is no such object fails the read rather than vanish."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("mode", "FAILFAST").json(path)


def schema_differences(df: DataFrame, expected: T.StructType | str) -> list[str]:
    """What df lacks or has otherwise than expected; empty if it is compatible."""
    want = T.StructType.fromDDL(expected) if isinstance(expected, str) else expected
    have = {f.name: f.dataType for f in df.schema}
    return [f"missing {f.name}" if f.name not in have else f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in want if have.get(f.name) != f.dataType]


def exists(spark: SparkSession, path: str) -> bool:
    """S18."""
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> bool:
    """Remove a collection; nothing to remove is a success too."""
    fs, p, _ = _fs(spark, path)
    return fs.delete(p, True) or not fs.exists(p)


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines that appear all at once: written aside and renamed."""
    spark = df.sparkSession
    stage = f"{path}._writing-{uuid.uuid4().hex}"
    df.write.json(stage)
    fs, src, Path = _fs(spark, stage)
    fs.delete(Path(path), True)
    if not fs.rename(src, Path(path)):
        raise OSError(f"could not move {stage} to {path}")


def publish_tables(tables: Mapping[str, DataFrame], target: str) -> DataFrame:
    """Several tables as one snapshot: every table is written under one new folder, whose name a last rename of the
    manifest makes current. Readers see all tables of a snapshot or none."""
    spark = next(iter(tables.values())).sparkSession
    run = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{target}/data/{run}/{name}")
    return publish(spark.createDataFrame([(n, f"{target}/data/{run}/{n}") for n in tables], "name string, path string").coalesce(1), f"{target}/manifest")


def read_tables(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    from millrace.storage import read_published

    m = read_published(spark, f"{target}/manifest")
    return {r["name"]: spark.read.parquet(r["path"]) for r in m.collect()} if m is not None else {}
