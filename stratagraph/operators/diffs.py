"""Comparisons of two versions of a graph (SET family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.plans.graph import CodeGraph


def api_drift(old: CodeGraph, new: CodeGraph) -> DataFrame:
    """SET-01: (kind, id, change, breaking) of exported symbols and routes."""
    public = lambda g: g.symbols.where(F.col("name").rlike("^[A-Z]") & ~E.is_test_file("file"))
    a = public(old).select("id", F.col("kind").alias("old_kind"), F.col("signature").alias("old_signature")).dropDuplicates(["id"])
    b = public(new).select("id", F.col("kind").alias("new_kind"), F.col("signature").alias("new_signature")).dropDuplicates(["id"])
    both = a.join(b, "id", "full_outer")
    change = F.when(F.col("new_kind").isNull(), "removed").when(F.col("old_kind").isNull(), "added").when((F.col("old_kind") != F.col("new_kind")) | ~F.col("old_signature").eqNullSafe(F.col("new_signature")), "changed")
    out = both.select(F.coalesce("new_kind", "old_kind").alias("kind"), "id", change.alias("change")).where("change IS NOT NULL")
    key = F.concat_ws(" ", "method", "path")
    ra, rb = (g.routes.select(key.alias("id"), F.col("handler").alias(h)).dropDuplicates(["id"]) for g, h in ((old, "a"), (new, "b")))
    r = ra.join(rb, "id", "full_outer").select(F.lit("route").alias("kind"), "id", F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed").alias("change")).where("change IS NOT NULL")
    members = method_diff(old, new).unionByName(field_diff(old, new))
    return out.unionByName(r).withColumn("breaking", F.col("change") != "added").unionByName(members)


def method_diff(old: CodeGraph, new: CodeGraph) -> DataFrame:
    """SET-02: methods of interfaces; any change breaks, an added one breaks implementers."""
    m = lambda g, c: g.symbols.where("kind = 'interface'").select("id", F.explode("interface_methods").alias("method", c))
    both = m(old, "a").join(m(new, "b"), ["id", "method"], "full_outer").join(old.symbols.select("id").distinct(), "id", "left_semi").join(new.symbols.select("id").distinct(), "id", "left_semi")
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select(F.lit("interface method").alias("kind"), F.concat_ws(".", "id", "method").alias("id"), change.alias("change")).where("change IS NOT NULL").withColumn("breaking", F.lit(True))


def field_diff(old: CodeGraph, new: CodeGraph) -> DataFrame:
    """SET-03: struct fields by JSON contract name; removed or retyped breaks."""
    def f(g: CodeGraph, c: str) -> DataFrame:
        rows = g.symbols.where("kind = 'struct'").select("id", F.explode("struct_fields").alias("f"))
        return rows.select("id", E.json_name(F.col("f.tag"), F.col("f.name")).alias("field"), F.col("f.type").alias(c)).where("field IS NOT NULL").dropDuplicates(["id", "field"])

    both = f(old, "a").join(f(new, "b"), ["id", "field"], "full_outer").join(old.symbols.select("id").distinct(), "id", "left_semi").join(new.symbols.select("id").distinct(), "id", "left_semi")
    change = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.select(F.lit("field").alias("kind"), F.concat_ws(".", "id", "field").alias("id"), change.alias("change")).where("change IS NOT NULL").withColumn("breaking", F.col("change") != "added")


def changes(old: DataFrame, new: DataFrame, key: str = "id", digest: str = "declaration_digest") -> DataFrame:
    """SET-04, SET-05: (id, status) new, deleted or modified; declarations of one id are matched as a multiset."""
    def side(df: DataFrame, name: str) -> DataFrame:
        n = Window.partitionBy(key).orderBy(digest)
        return df.select(key, digest).withColumn("n", F.row_number().over(n)).withColumnRenamed(digest, name)

    both = side(old, "a").join(side(new, "b"), [key, "n"], "full_outer")
    both = both.withColumn("in_a", F.max(F.col("a").isNotNull()).over(Window.partitionBy(key))).withColumn("in_b", F.max(F.col("b").isNotNull()).over(Window.partitionBy(key)))
    changed = both.where("NOT (a <=> b)")
    status = F.when(~F.col("in_a"), "new").when(~F.col("in_b"), "deleted").otherwise("modified")
    return changed.select(key, status.alias("status")).distinct()


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files whose digest differs: the filter in front of ``changes``; also SRC freshness (INC-01)."""
    both = old.select("path", F.col("content_digest").alias("a")).join(new.select("path", F.col("content_digest").alias("b")), "path", "full_outer")
    status = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def evaluation(changes_: DataFrame, unreadable: DataFrame) -> DataFrame:
    """The completeness of a change report: complete, partial (some files unread) or cannot_evaluate (all)."""
    n = changes_.agg(F.count("*").alias("changes"))
    u = unreadable.agg(F.count("*").alias("unknown"))
    return n.join(F.broadcast(u), F.lit(True)).withColumn("evaluation", F.when(F.col("unknown") == 0, "complete").when(F.col("changes") > 0, "partial").otherwise("cannot_evaluate"))


def snapshot_diff(a: DataFrame, b: DataFrame, metrics: list[str], eps: float = 0.005) -> DataFrame:
    """SET-06: metric deltas of two one-row snapshots; more is worse."""
    long = lambda df, c: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")).select("x.metric", F.col("x.v").alias(c))
    out = long(a, "before").join(long(b, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))
    return out.withColumn("verdict", F.when(F.abs("delta") <= eps, "unchanged").when(F.col("delta") > 0, "WORSE").otherwise("improved"))


def dedupe_calls(calls: DataFrame) -> DataFrame:
    """SET-07."""
    return calls.dropDuplicates()


def filter_potential(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """SET-08: function values (column ``potential``) stay only if their short name is a callable's."""
    names = symbols.where(F.col("kind").isin("function", "method")).select(F.lower("name").alias("_n")).distinct()
    kept = calls.where("potential").join(names, E.short_name("callee_raw") == F.col("_n"), "left_semi")
    return calls.where("NOT coalesce(potential, false)").unionByName(kept)


def dedupe_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """SET-09: of equal edges one that isn't heuristic."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("heuristic", F.lit(False)), *[c for c in edges.columns if c not in keys and c != "heuristic"])
    return edges.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def changed_lines(diff: DataFrame, untracked: DataFrame) -> DataFrame:
    """SET-10: (file, line) of a diff and of whole untracked files, without tests."""
    whole = untracked.select(F.col("path").alias("file"), F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")))).alias("line"))
    return diff.select("file", "line").unionByName(whole).where(~E.is_test_file("file")).distinct()


def order_changed(pairs: DataFrame) -> DataFrame:
    """WIN-07: whether matched declarations (file, old_line, new_line) changed their order, per file."""
    w = Window.partitionBy("file").orderBy("old_line").rowsBetween(Window.unboundedPreceding, -1)
    return pairs.withColumn("before", F.max("new_line").over(w)).groupBy("file").agg(F.coalesce(F.max(F.col("before") > F.col("new_line")), F.lit(False)).alias("reordered"))
