"""Tables between the jobs of an operator that needs several."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


#: Rows of a kept table from which on it is joined by a shuffle.  Spark sees the bytes of its files, and ten million rows of small numbers can have a few.
MANY = 100_000


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Writes a table and reads it again: the lineage ends there, and the loss of an executor costs nothing that was done before.

    The shuffle files of the job go when the table is complete, as nothing reads them again."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    seen, conf = Observation(), df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.hint("merge") if seen.get.get("n", 0) > MANY else out
