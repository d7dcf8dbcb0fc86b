"""Freshness, incremental rebuilds and sessions (INC family)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.operators.diffs import changed_files
from stratagraph.plans.graph import CodeGraph


def stale(indexed: DataFrame, present: DataFrame) -> DataFrame:
    """INC-01: files that differ by digest."""
    return changed_files(indexed, present)


def changed_dirs(changes: DataFrame) -> DataFrame:
    return changes.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir")).distinct()


def reusable(relation: DataFrame, dirs: DataFrame, file: str = "file", precise: bool = False) -> DataFrame:
    """INC-03: rows of files outside changed folders, without rows that only typed analysis made."""
    rows = relation if precise or "precise" not in relation.columns else relation.where("NOT coalesce(precise, false)")
    return rows.withColumn("_d", F.regexp_replace(file, "/[^/]*$", "")).join(dirs.withColumnRenamed("dir", "_d"), "_d", "left_anti").drop("_d").select(*relation.columns)


def rebuild(old: CodeGraph, fresh: CodeGraph, changes: DataFrame) -> CodeGraph:
    """INC-02: a changed file replaces its whole folder; other records are reused."""
    dirs = changed_dirs(changes)
    out = {}
    for name in list(old.relations):
        df = getattr(old, name)
        file = next((c for c in ("file", "path", "from_file") if c in df.columns), None)
        out[name] = df if file is None else reusable(df, dirs, file).unionByName(getattr(fresh, name), allowMissingColumns=True)
    return CodeGraph(old.spark, out)


def refresh(adopt: Callable[[], CodeGraph | None], is_fresh: Callable[[CodeGraph], bool], build: Callable[[], CodeGraph], attempts: int = 2) -> tuple[CodeGraph | None, str]:
    """INC-04: adopt a newer artifact, serve what is current, else rebuild at most twice, else degrade openly."""
    g = adopt()
    if g is not None and is_fresh(g):
        return g, "current"
    for _ in range(attempts):
        try:
            built = build()
        except Exception:  # a failed build leaves the old graph in place; the state says so
            continue
        if is_fresh(built):
            return built, "rebuilt"
    return g, "degraded" if g is not None else "unavailable"


def graph_state(g: CodeGraph, source: str, freshness: str, complete: bool, precision: str, refresh_: str = "idle", persistence: str = "stored") -> DataFrame:
    """INC-05: the independent axes of a graph's state, one row."""
    return g.spark.createDataFrame([(source, freshness, "complete" if complete else "partial", precision, refresh_, persistence)], "source string, freshness string, completeness string, precision string, refresh string, persistence string")


def expired(sessions: DataFrame, now: str, idle_hours: float = 2.0) -> DataFrame:
    """INC-06: open sessions idle for too long, or whose server is gone (column ``server_alive``)."""
    idle = F.lit(now).cast("timestamp").cast("double") - F.col("last_seen").cast("timestamp").cast("double")
    return sessions.where("ended_at IS NULL").where((idle > idle_hours * 3600) | ~F.coalesce("server_alive", F.lit(True)))


def adopt_sessions(commands: DataFrame, sessions: DataFrame) -> DataFrame:
    """INC-07: commands without session adopt the one session that was active then; none or several leave it empty."""
    s = sessions.select(F.col("session_id").alias("_s"), F.col("created_at").alias("_a"), F.coalesce("ended_at", F.lit("9999-12-31").cast("timestamp")).alias("_b"), F.col("root").alias("_root"))
    c = commands.withColumn("_id", F.monotonically_increasing_id())
    hit = c.join(s, (c["root"] == s["_root"]) & (c["timestamp"] >= s["_a"]) & (c["timestamp"] < s["_b"])).groupBy("_id").agg(F.count("*").alias("n"), F.min("_s").alias("adopted"))
    return c.join(hit, "_id", "left").withColumn("session_id", F.when(F.col("n") == 1, F.col("adopted"))).drop("_id", "n", "adopted")


def sessionise(events: DataFrame, user: str = "user_id", ts: str = "ts", tie: str = "event_id", gap: str = "2 hours") -> DataFrame:
    """Events numbered by session: a new one after a gap."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    fresh = F.lag(ts).over(w).isNull() | (F.col(ts) - F.lag(ts).over(w) > F.expr(f"INTERVAL {gap}"))
    return events.withColumn("_new", F.when(fresh, 1).otherwise(0)).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
