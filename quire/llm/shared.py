"""Tables between the jobs of one operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a temporary folder only where it is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write a table and read it again: cuts lineage, and survives the loss of executors.

    The shuffle files of the job go when the table is complete, as nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.quire_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of save() that no later job reads."""
    for t in tables:
        path = getattr(t, "quire_path", None)
        if path:
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may have ended; the cluster clears its checkpoint folder
        pass


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc().isStopped() is False:
            _delete(spark, path)


#: A key with more than one in so many of the rows is hot; there are fewer such keys than this.
HOT_SHARE = 1000


def skew_join(rows: DataFrame, sized: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``sized``, a saved table of one row a key with the number ``c`` of its rows.

    The rows of hot keys stay where they are: the fewer than ``HOT_SHARE`` keys with more than that part of all rows are
    broadcast, the others are joined by a shuffle in which no key is large."""
    total = sized.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    hot = sized.where(F.col("c") > total // HOT_SHARE + 64).drop("c")
    cold = sized.where(F.col("c") <= total // HOT_SHARE + 64).drop("c")
    if hot.isEmpty():
        return rows.join(cold, key)
    apart = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return apart.join(cold, key).unionByName(rows.join(F.broadcast(hot), key))


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column, k: int) -> Column:
    """crc32 of an id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % k


def boxed(docs: DataFrame, *leave: str) -> Column:
    """All columns of ``docs`` but ``leave`` in one struct, so that no name of theirs meets a name of an operator."""
    names = [c for c in docs.columns if c.lower() not in leave]
    return F.struct(F.lit(0).alias("k"), *([F.struct(*(F.col(f"`{c}`") for c in names)).alias("c")] if names else [])).alias("row")


def unboxed(docs: DataFrame, *leave: str) -> list[Column]:
    """The columns that ``boxed`` put away, to select from a table that has its struct as ``row``."""
    return [F.col(f"row.c.`{c}`").alias(c) for c in docs.columns if c.lower() not in leave]


def text_of(docs: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")


def as_out(given: DataFrame, fields: str) -> StructType:
    """The schema of ``given`` without its column ``t``, and further fields."""
    return StructType([f for f in given.schema.fields if f.name != "t"] + StructType.fromDDL(fields).fields)
