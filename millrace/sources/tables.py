"""Parquet table source. Schemas come from the files' footers; filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import use_utc


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{where}/{name}.parquet")


#: Bytes per core under which a table counts as small.
SMALL = 16 << 20


def wide_table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """A table whose rows cost much more to work on than to read. A small file gives one scan task, however many
    cores there are: its rows are dealt out to all of them. Larger tables, and tables of many files, are read as they are."""
    t = table(spark, where, name)
    cores = spark.sparkContext.defaultParallelism
    size = int(str(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return t.repartition(cores) if len(t.inputFiles()) < cores and size < cores * SMALL else t
