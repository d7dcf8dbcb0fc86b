"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole texts that go to a Python worker at once; Spark's own 10,000 keep several times as much memory in both.
BATCH_ROWS = 1000
#: Repeated ids that may be broadcast.
REPEATED_IDS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (tests, a laptop) a folder below the
    warehouse is set and used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
        spark.sparkContext.setCheckpointDir(base)
    return base


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; its session sends at most ``BATCH_ROWS`` rows to Python at once from now on."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors.

    The folder's name is new for each call, so concurrent runs don't meet.
    Shuffle files of steps that nothing refers to any more are let go: Spark
    deletes them once the driver has collected its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


def drop(*written: DataFrame) -> None:
    """Delete what ``materialise`` wrote, once no plan that will still run reads it."""
    for df in written:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it has at most ``rows`` rows, else unchanged (and then shuffled)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_key(docs: DataFrame, name: str = "k") -> DataFrame:
    """``docs`` with a column that tells rows of one id apart: the text's 64-bit hash, 0 where the id alone does.

    Ids that are null or repeated need the hash; constants compress to
    nothing.  The repeated ids are broadcast; beyond ``REPEATED_IDS`` of them
    all rows carry the hash, so no text is shuffled for its key.
    """
    small_batches(docs)
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    ids = docs.select(F.col("doc_id").cast("long").alias("_again")).where("_again IS NOT NULL").groupBy("_again").agg(F.count("*").alias("_n"))
    again = materialise(ids.where("_n > 1").select("_again"), "ids")
    n = again.limit(REPEATED_IDS + 1).count()
    if n > REPEATED_IDS:
        return docs.withColumn(name, digest)
    if not n:
        return docs.withColumn(name, F.when(F.col("doc_id").cast("long").isNull(), digest).otherwise(F.lit(0).cast("long")))
    found = docs.join(F.broadcast(again), F.col("doc_id").cast("long") == F.col("_again"), "left")
    several = F.col("doc_id").cast("long").isNull() | F.col("_again").isNotNull()
    return found.withColumn(name, F.when(several, digest).otherwise(F.lit(0).cast("long"))).select(*docs.columns, name)


def keyed(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id, k (tells rows of one id apart, see ``with_key``) and text, null text as empty.

    Only these columns are kept, so other columns of ``docs`` can't clash.
    """
    columns = dict.fromkeys(["doc_id", "text", *extra])
    return with_key(docs.select(*columns), "_key").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("_key").alias("k"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        *extra,
    )
