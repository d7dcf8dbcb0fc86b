"""Traversals over the call, import and test graphs (TRV family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.operators.aggs import attribution_edges
from stratagraph.operators.joins import call_targets
from stratagraph.plans.fixpoint import best_paths, closure, labelled, nearest, reach_counts
from stratagraph.plans.graph import CodeGraph

MAX_DEPTH = 10


def seeds(ids: DataFrame, column: str = "id", seed: str | None = None) -> DataFrame:
    return ids.select(F.col(seed).cast("string").alias("seed") if seed else F.lit("").alias("seed"), F.col(column).alias("id")).distinct()


def call_edges(g: CodeGraph, reverse: bool = False, by_name: bool = False) -> DataFrame:
    """(src, dst, exact, synthetic) of calls; reversed for callers; unresolved spellings as nodes of their own with ``by_name``."""
    to = F.coalesce("callee_symbol_id", F.lower("callee_raw")) if by_name else F.col("callee_symbol_id")
    a, b = F.coalesce("caller_symbol_id", "caller_name"), to
    src, dst = (b, a) if reverse else (a, b)
    return g.calls.select(src.alias("src"), dst.alias("dst"), (E.exact() | F.coalesce("synthetic", F.lit(False))).alias("exact"), F.coalesce("synthetic", F.lit(False)).alias("synthetic")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def clamp(depth: int, most: int = MAX_DEPTH) -> int:
    return max(1, min(most, depth))


def callers_depth(g: CodeGraph, start: DataFrame, depth: int = 3) -> DataFrame:
    """TRV-01: (seed, id, depth) of callers, each once at its first depth; ``start`` has (seed, id)."""
    return closure(call_edges(g, reverse=True, by_name=True), start, clamp(depth)).where("depth > 0")


def callees_depth(g: CodeGraph, start: DataFrame, depth: int = 3) -> DataFrame:
    """TRV-02: distinct call sites met on the way down, with their first depth."""
    reach = closure(call_edges(g, by_name=True), start, clamp(depth) - 1)
    c = g.calls.where(~F.coalesce("synthetic", F.lit(False))).withColumn("caller", F.coalesce("caller_symbol_id", "caller_name"))
    hit = c.join(reach, c["caller"] == reach["id"])
    return hit.groupBy("seed", "caller", "file", "line", "column", "callee_raw").agg((F.min("depth") + 1).alias("depth"), F.min("callee_symbol_id").alias("callee_symbol_id"))


def impact(g: CodeGraph, start: DataFrame) -> DataFrame:
    """TRV-05: everything that reaches a target; exact if exact edges alone do. Wrappers are walked, never shown."""
    calls = g.calls
    unique = g.symbols.groupBy(F.lower("name").alias("_n")).agg(F.count("*").alias("_c"), F.min("id").alias("_id")).where("_c = 1")
    named = calls.where("callee_symbol_id IS NULL").join(unique, F.lower("callee_raw") == F.col("_n")).select(F.col("_id").alias("src"), F.coalesce("caller_symbol_id", "caller_name").alias("dst"), F.lit(False).alias("exact"))
    edges = call_edges(g, reverse=True).select("src", "dst", "exact").unionByName(named)
    wrappers = calls.where("synthetic").select(F.col("caller_symbol_id").alias("id")).where("id IS NOT NULL").distinct()
    own = start.select("seed", "id")
    return labelled(edges, start).join(own, ["seed", "id"], "left_anti").join(wrappers, "id", "left_anti")


def path(g: CodeGraph, start: DataFrame, end: str, max_steps: int | None = None) -> DataFrame:
    """TRV-06: the best-ranked path from each seed to ``end``: certainty, then length, tests, spelling."""
    tests = g.symbols.where(E.is_test_path("file")).select(F.col("id").alias("dst"), F.lit(1).alias("test")).distinct()
    e = call_edges(g).join(tests, "dst", "left")
    cost = [F.when(F.col("exact"), 0).otherwise(2), F.when(F.col("synthetic"), 0).otherwise(1), F.coalesce("test", F.lit(0)), F.lit(1)]
    found = best_paths(e, start, cost, max_steps).where(F.col("id") == end)
    return found.select("seed", "id", F.when(F.col("rank.r0") == 0, "exact").otherwise("possible").alias("certainty"), F.col("rank.r1").alias("length"), "path")


def deps(g: CodeGraph, package: str, max_depth: int | None = None) -> DataFrame:
    """TRV-08: transitive imports; a path leads on to the package of its last segment."""
    e = g.imports.select(F.col("from_package").alias("src"), F.element_at(F.split("import_path", "/"), -1).alias("dst")).distinct()
    return closure(e, g.spark.createDataFrame([("", package)], "seed string, id string"), max_depth).where("depth > 0").select(F.col("id").alias("package"), "depth")


def coverage(g: CodeGraph, tests: DataFrame, max_depth: int | None = None) -> DataFrame:
    """TRV-09: what each test (seed, id) reaches, with label and depth."""
    return labelled(attribution_edges(g), tests, max_depth).where("depth > 0")


def test_reach(g: CodeGraph, tests: DataFrame) -> DataFrame:
    """TRV-10: per symbol, how many tests reach it exactly and possibly; counted by hubs, without a row for each pair."""
    both = F.array(F.lit("0"), F.lit("1"))
    way = lambda c: F.concat("way", c).alias(c)  # noqa: E731  exact and possible edges as two graphs
    edges = attribution_edges(g).withColumn("way", F.explode(F.when(F.col("exact"), both).otherwise(F.array(F.lit("1"))))).select(way("src"), way("dst"))
    start = seeds(tests, "id", "id").where("id IS NOT NULL").withColumn("way", F.explode(both)).select(way("seed"), way("id"))
    counts = reach_counts(edges, start).select(F.substring("id", 1, 1).alias("way"), F.expr("substring(id, 2)").alias("id"), "n")
    by = lambda way: F.sum(F.when(F.col("way") == way, F.col("n")).otherwise(0))
    return counts.groupBy("id").agg(by("0").alias("exact_tests"), by("1").alias("tests"))


def tests_of(g: CodeGraph, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """TRV-11: tests that reach each seed, walking back and stopping at tests."""
    entries = g.test_edges.select(F.col("test_func").alias("id")).unionByName(g.symbols.where(E.is_test_file("file") & E.test_name("name")).select("id")).distinct()
    e = attribution_edges(g).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "exact")
    e = e.join(entries.withColumnRenamed("id", "src"), "src", "left_anti")
    return labelled(e, start, max_depth).where("depth > 0").join(entries, "id", "left_semi")


def trace(g: CodeGraph, message: str, fallback: int = 5) -> DataFrame:
    """TRV-14: for each matching error, the shortest chain back to a handler or main; else some immediate callers."""
    hit = g.errors.where(F.contains(F.lower("message"), F.lit(message.lower())))
    start = hit.select(F.col("function").alias("seed"), F.col("function").alias("id")).distinct()
    ends = g.routes.select(F.col("handler").alias("id")).unionByName(g.symbols.where("name = 'main'").select("id")).distinct()
    paths = nearest(call_edges(g, reverse=True), ends, start.select("id"))
    full = start.join(paths, "id").select("seed", F.reverse("path").alias("path"), F.lit("entry").alias("kind"))
    if not fallback:
        return full
    near = call_edges(g, reverse=True).join(start.join(full.select("seed"), "seed", "left_anti"), F.col("src") == F.col("id"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("dst"))).where(F.col("r") <= fallback)
    return full.unionByName(near.select("seed", F.array("dst", "seed").alias("path"), F.lit("caller").alias("kind")))


def error_flow(g: CodeGraph, message: str) -> DataFrame:
    """TRV-15: definitions, paths to entries and related tests of an error, as (part, function, detail)."""
    hit = g.errors.where(F.contains(F.lower("message"), F.lit(message.lower())))
    start = hit.select(F.col("function").alias("seed"), F.col("function").alias("id")).distinct()
    return (
        hit.select(F.lit("definition").alias("part"), "function", F.concat_ws(":", "file", "line").alias("detail"))
        .unionByName(trace(g, message, 0).select(F.lit("path").alias("part"), F.col("seed").alias("function"), F.array_join("path", " > ").alias("detail")))
        .unionByName(tests_of(g, start).select(F.lit("test").alias("part"), F.col("seed").alias("function"), F.col("id").alias("detail")))
    )


def downstream(g: CodeGraph, start: DataFrame) -> DataFrame:
    """TRV-16: closure from caller names to callee spellings."""
    e = g.calls.select(F.col("caller_name").alias("src"), F.col("callee_raw").alias("dst")).distinct()
    return closure(e, start)


def match_route(g: CodeGraph, q: str) -> DataFrame:
    """TRV-18: routes of the best tier only: handler, whole pattern, method and pattern, shape, part of the pattern."""
    low = q.lower()
    method, _, rest = low.partition(" ")
    tier = (
        F.when(F.lower("handler") == low, 1).when(F.lower("path") == low, 2).when((F.lower("method") == method) & (F.lower("path") == rest), 3)
        .when(E.route_shape("path") == F.lit("/".join("{}" if s[:1] in (":", "*", "{") else s for s in low.split("/"))), 4).when(F.contains(F.lower("path"), F.lit(low)), 5)
    )
    hit = g.routes.withColumn("tier", tier).where("tier IS NOT NULL")
    best = hit.agg(F.min("tier").alias("_t"))
    return hit.join(F.broadcast(best), F.col("tier") == F.col("_t")).drop("_t")


def endpoint(g: CodeGraph, q: str, depth: int = 5) -> DataFrame:
    """TRV-17: what a route's handlers reach, with the SQL and environment on the way, as (handler, part, name, depth)."""
    handlers = match_route(g, q).select(F.col("handler").alias("seed"), F.col("handler").alias("id")).distinct()
    reach = closure(call_edges(g, by_name=True), handlers, clamp(depth, 20))
    out = reach.where("depth > 0").select("seed", F.lit("call").alias("part"), F.col("id").alias("name"), "depth")
    sql = reach.join(g.sqls, F.col("id") == F.col("function")).select("seed", F.lit("sql").alias("part"), F.col("query").alias("name"), "depth")
    env = reach.join(g.env_reads, F.col("id") == F.col("function")).select("seed", F.lit("env").alias("part"), F.col("key").alias("name"), "depth")
    return out.unionByName(sql).unionByName(env).groupBy(F.col("seed").alias("handler"), "part", "name").agg(F.min("depth").alias("depth"))


def diagram(edges: DataFrame, depth: int = 3) -> DataFrame:
    """TRV-22: (src, dst, n, depth) of grouped edges within ``depth`` levels of entries; all nodes are entries where none is."""
    grouped = edges.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    nodes = grouped.select(F.col("src").alias("id")).unionByName(grouped.select(F.col("dst").alias("id"))).distinct()
    entries = nodes.join(grouped.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    start = entries if not entries.isEmpty() else nodes
    reach = closure(grouped.select("src", "dst"), seeds(start), depth).select(F.col("id").alias("src"), "depth")
    return grouped.join(reach, "src").where(F.col("depth") < depth)


def exact_neighbours(g: CodeGraph, start: DataFrame, reverse: bool, depth: int = 3) -> DataFrame:
    """TRV-21: exact-only walks for one identity."""
    return closure(call_edges(g, reverse=reverse).where("exact"), start, depth).where("depth > 0")


def target_seeds(g: CodeGraph, q: str) -> DataFrame:
    """(seed, id) of what a selector stands for."""
    return call_targets(g, q).select(F.lit(q).alias("seed"), "id")
