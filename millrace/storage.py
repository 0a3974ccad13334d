"""Shared storage: the checkpoint folder, lineage cuts, and snapshots that appear all at once or not at all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The session's spark.checkpoint.dir is used as it is; only where it is
    unset (tests on one machine) a folder of our own is made."""
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if have:
        return have.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="millrace-")
    sc.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint(eager=True)


def write_work(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result as Parquet into the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def publish(df: DataFrame, target: str) -> DataFrame:
    """Publish df as the next snapshot of target: all bucket files are staged first, then one rename makes them
    visible. A job that dies before the rename leaves the former snapshot untouched. Readers use read_published."""
    spark = df.sparkSession
    stage = f"{target}/_staging-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    fs, src, path = _fs(spark, stage)
    known = [s.getPath().getName() for s in fs.listStatus(path(target))]
    done = max([int(n[9:]) for n in known if n.startswith("snapshot-")], default=0)
    while not fs.rename(src, path(f"{target}/snapshot-{done + 1:012d}")):
        if not fs.exists(path(f"{target}/snapshot-{done + 1:012d}")):
            raise OSError(f"could not publish {stage}")
        done += 1
    return spark.read.schema(df.schema).parquet(f"{target}/snapshot-{done + 1:012d}")


def read_published(spark: SparkSession, target: str) -> DataFrame | None:
    """The newest snapshot of target, or None."""
    fs, p, _ = _fs(spark, target)
    if not fs.exists(p):
        return None
    done = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("snapshot-"))
    return spark.read.parquet(f"{target}/{done[-1]}") if done else None
