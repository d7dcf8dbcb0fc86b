"""A store of graph versions as Parquet, with a pointer to the current one (SRC-11, SRC-18, SNK-01, SNK-09)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.plans.graph import CodeGraph

PRECISION = {"ast": 0, "precise_fallback": 1, "precise": 2}


class GraphStore:
    """Versions below one folder; readers see a version only after its pointer row was written."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(p)

    def versions(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/_versions") if self._exists(f"{self.root}/_versions") else None

    def current(self) -> dict | None:
        v = self.versions()
        row = v.orderBy(F.desc("number")).limit(1).collect() if v is not None else []
        return row[0].asDict() if row else None

    def publish(self, g: CodeGraph, precision: str = "ast", fingerprint: str = "") -> dict:
        """Write a version and then its pointer; a less precise graph doesn't replace one of the same sources."""
        now = self.current()
        if now and now["fingerprint"] == fingerprint and PRECISION[now["precision"]] > PRECISION[precision]:
            raise ValueError(f"the current version is {now['precision']}")
        version = uuid.uuid4().hex
        for name in sorted(g.relations):
            getattr(g, name).write.mode("errorifexists").parquet(f"{self.root}/{version}/{name}")
        row = {"number": (now["number"] if now else 0) + 1, "version": version, "precision": precision, "fingerprint": fingerprint, "relations": sorted(g.relations)}
        self.spark.createDataFrame([tuple(row.values())], "number int, version string, precision string, fingerprint string, relations array<string>").withColumn("generated_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/_versions")
        return row

    def load(self, number: int | None = None) -> CodeGraph:
        """The current version, or an earlier one as a baseline."""
        v = self.versions()
        if v is None:
            raise FileNotFoundError(self.root)
        rows = (v.orderBy(F.desc("number")) if number is None else v.where(F.col("number") == number)).limit(1).collect()
        if not rows:
            raise KeyError(number)
        return CodeGraph(self.spark, {n: self.spark.read.parquet(f"{self.root}/{rows[0]['version']}/{n}") for n in rows[0]["relations"]})

    def save_snapshot(self, metrics: DataFrame) -> None:
        """Append one named metric row."""
        metrics.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/_snapshots")

    def snapshots(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/_snapshots")
