"""A code graph: named relations as lazy DataFrames, and cutting of long lineages."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratagraph.plans.schema import RELATIONS


class CodeGraph:
    """Relations by attribute; one that wasn't given is empty, with its schema.

    A relation may be given as a function that makes it; it is called when first asked for.
    """

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame | Callable[[], DataFrame]]):
        unknown = set(relations) - set(RELATIONS)
        if unknown:
            raise ValueError(f"unknown relations: {sorted(unknown)}")
        self.spark = spark
        self.relations = relations

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in RELATIONS:
            raise AttributeError(name)
        found = self.relations.get(name)
        if found is None:
            found = self.relations[name] = self.spark.createDataFrame([], RELATIONS[name])
        elif not isinstance(found, DataFrame):
            found = self.relations[name] = found()
        return found

    def replace(self, **relations: DataFrame) -> CodeGraph:
        return CodeGraph(self.spark, self.relations | relations)

    def persisted(self) -> CodeGraph:
        """The same graph with its relations kept in memory or on disk for many queries."""
        return CodeGraph(self.spark, {k: getattr(self, k).persist() for k in self.relations})


def cut(df: DataFrame) -> DataFrame:
    """Write to the folder that driver and executors share and read back: the lineage ends there.

    The folder is ``spark.checkpoint.dir``; a default below the warehouse is used only where
    none is set.  One job for each call, and lost executors lose nothing.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints")
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written = path
    return out


def drop(*written: DataFrame) -> None:
    """Delete what ``cut`` wrote, once no plan that will still run reads it."""
    for df in written:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
