"""Join operators: who calls whom, who implements what, who owns a path (JON family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.plans.fixpoint import closure
from stratagraph.plans.graph import CodeGraph

#: Lines of a bucket in the range join of lines and declarations.
LINES = 64


def sites(calls: DataFrame) -> DataFrame:
    """AGG-01: one row for each place of a call; wrappers aren't places, rows without place never collapse."""
    real = calls.where(~F.coalesce("synthetic", F.lit(False))).withColumn("caller", F.coalesce("caller_symbol_id", "caller_name"))
    located = real.where("file <> '' AND line > 0").dropDuplicates(["caller", "file", "line", "column", "callee_raw"])
    return located.unionByName(real.where("NOT coalesce(file <> '' AND line > 0, false)"))


def site_targets(calls: DataFrame) -> DataFrame:
    """AGG-02: one row for each place and target."""
    real = calls.where(~F.coalesce("synthetic", F.lit(False))).withColumn("caller", F.coalesce("caller_symbol_id", "caller_name")).withColumn("target", F.coalesce("callee_symbol_id", "callee_raw"))
    return real.dropDuplicates(["caller", "file", "line", "column", "callee_raw", "target"])


def forwarding(calls: DataFrame, seeds: DataFrame, reverse: bool = True) -> DataFrame:
    """TRV-03, TRV-04: (seed, id) over wrapper edges, backwards or forwards, seeds included."""
    edge = calls.where("synthetic AND caller_symbol_id IS NOT NULL AND callee_symbol_id IS NOT NULL")
    edge = edge.select(F.col("callee_symbol_id" if reverse else "caller_symbol_id").alias("src"), F.col("caller_symbol_id" if reverse else "callee_symbol_id").alias("dst"))
    return closure(edge, seeds).select("seed", "id")


def interface_targets(g: CodeGraph, interface: str, method: str) -> DataFrame:
    """FIL-05: ids of a method on every implementing type, value and pointer receivers."""
    names = g.implements.where((F.lower("interface") == interface.lower()) | F.lower("interface").endswith("." + interface.lower())).select(F.regexp_replace("concrete", r"^.*[.*]", "").alias("t")).distinct()
    own = g.symbols.where((F.col("kind") == "method") & (F.lower("name") == method.lower()))
    return own.join(names, F.regexp_replace(own["receiver"], r"^\*", "") == names["t"], "left_semi").select("id")


def call_targets(g: CodeGraph, q: str) -> DataFrame:
    """FIL-06: ids a selector stands for, with wrappers that forward to them."""
    ids = g.symbols.where(E.match_symbol(q)).select("id")
    if "::" in q:
        ids = ids.unionByName(g.calls.where(F.lower("callee_symbol_id") == q.lower()).select(F.col("callee_symbol_id").alias("id")))
    if q.count(".") == 1:
        ids = ids.unionByName(interface_targets(g, *q.split(".")))
    seeds = ids.distinct().withColumn("seed", F.lit(0))
    return forwarding(g.calls, seeds).select("id").distinct()


def callers(g: CodeGraph, q: str, fuzzy: bool = True, tests: bool = True) -> DataFrame:
    """JON-01: call sites of a symbol, by id or by how the call is spelled."""
    targets = call_targets(g, q).withColumnRenamed("id", "_id")
    raw = F.contains(F.lower("callee_raw"), F.lit(q.lower())) if fuzzy else F.lower("callee_raw") == q.lower()
    found = sites(g.calls).join(targets, F.col("callee_symbol_id") == F.col("_id"), "left").where(F.col("_id").isNotNull() | raw)
    where = g.symbols.select(F.col("id").alias("_s"), F.col("file").alias("caller_file"), F.col("line").alias("caller_line")).dropDuplicates(["_s"])
    out = found.join(where, found["caller_symbol_id"] == where["_s"], "left")
    out = out.select("caller", "callee_raw", "callee_symbol_id", "file", "line", "column", F.coalesce("caller_file", "file").alias("caller_file"), F.coalesce("caller_line", "line").alias("caller_line"), F.when(F.col("_id").isNotNull(), E.certainty()).otherwise("possible").alias("resolution_status"))
    return out if tests else out.where(~E.is_test_file("file"))


def callees(g: CodeGraph, q: str, tests: bool = True) -> DataFrame:
    """JON-02: what the matched symbols call, one row for each site."""
    own = g.symbols.where(E.match_symbol(q)).select(F.col("id").alias("_id")).distinct()
    out = sites(g.calls).join(own, F.col("caller_symbol_id") == F.col("_id"), "left_semi")
    out = out.select("caller", "callee_raw", "callee_symbol_id", "file", "line", "column", E.certainty().alias("resolution_status"))
    return out if tests else out.where(~E.is_test_file("file"))


def divide(required: DataFrame, offered: DataFrame, group: str, owner: str, keys: list[str]) -> DataFrame:
    """JON-03, JON-10: (group, owner) pairs where the owner offers every key of the group; no cross product."""
    need = required.select(group, *keys).distinct()
    size = need.groupBy(group).agg(F.count("*").alias("_n"))
    have = offered.select(owner, *keys).distinct().join(need, keys).groupBy(group, owner).agg(F.count("*").alias("_h"))
    return have.join(size, group).where("_h = _n").select(group, owner)


def implementers(g: CodeGraph, interface: str, signatures: bool = True) -> DataFrame:
    """JON-03: typed edges if there are any for the interface, else structs with all its methods."""
    q = interface.lower()
    typed = g.implements.where((F.lower("interface") == q) | F.lower("interface").endswith("." + q) | (F.lower("interface_id") == q))
    typed = typed.select(F.col("concrete_id").alias("id"), F.col("concrete").alias("name"), F.lit("exact").alias("resolution_status")).distinct()
    first = g.symbols.where((F.col("kind") == "interface") & E.match_symbol(interface)).orderBy("file", "line", "id").limit(1)
    keys = ["method", "sig"] if signatures else ["method"]
    need = first.select(F.col("id").alias("iface"), F.explode("interface_methods").alias("method", "sig"))
    have = g.symbols.where("kind = 'method'").select(F.concat_ws("/", "package_name", F.regexp_replace("receiver", r"^\*", "")).alias("owner"), F.col("name").alias("method"), F.col("method_signature").alias("sig"))
    pairs = divide(need, have, "iface", "owner", keys)
    structs = g.symbols.where("kind = 'struct'").withColumn("owner", F.concat_ws("/", "package_name", "name"))
    duck = structs.join(pairs, "owner").select("id", "name", F.lit("possible").alias("resolution_status"))
    some = typed.limit(1).select(F.lit(1).alias("_x"))
    return typed.unionByName(duck.join(some, F.lit(True), "left_anti"))


def interfaces_of(g: CodeGraph, struct: str) -> DataFrame:
    """JON-04: interfaces a struct satisfies; by names only where there are no typed edges."""
    q = struct.lower()
    typed = g.implements.where((F.lower("concrete") == q) | F.lower("concrete").endswith("." + q)).select(F.col("interface").alias("name"), F.lit("exact").alias("resolution_status")).distinct()
    need = g.symbols.where("kind = 'interface'").select(F.col("id").alias("iface"), F.col("name").alias("_name"), F.explode(F.map_keys("interface_methods")).alias("method"))
    have = g.symbols.where(F.col("kind") == "method").where(F.lower(F.regexp_replace("receiver", r"^\*", "")) == q.rpartition(".")[2]).select(F.lit(struct).alias("owner"), F.col("name").alias("method"))
    names = need.select("iface", "_name").distinct()
    duck = divide(need, have, "iface", "owner", ["method"]).join(names, "iface").select(F.col("_name").alias("name"), F.lit("possible").alias("resolution_status"))
    return typed.unionByName(duck.join(typed.limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti"))


def mocks(g: CodeGraph, interface: str) -> DataFrame:
    """JON-05: implementers that are declared in test files."""
    return implementers(g, interface).join(g.symbols.where(E.is_test_path("file")).select("id"), "id", "left_semi")


def longest_prefix(left: DataFrame, owners: DataFrame, path: str, prefix: str, separator: str = "/") -> DataFrame:
    """JON-06, JON-07: each path with the owner of its longest containing prefix.

    Every path is expanded into its own prefixes, so that this is an equi-join.
    """
    parts = F.split(path, separator)
    mine = left.select(path).distinct().withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))))
    root = F.when(F.col(prefix).isin(".", ""), "").otherwise(F.regexp_replace(prefix, f"{separator}$", ""))
    found = mine.join(owners.withColumn("_p", root), "_p")
    best = Window.partitionBy(path).orderBy(F.desc(F.length("_p")), *[c for c in owners.columns if c != prefix])
    return found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_p", "_r")


def backfill(calls: DataFrame, typed: DataFrame) -> DataFrame:
    """JON-08: callee ids from typed facts by the whole site, else by place; unmatched exact facts are added.

    ``typed`` has (caller_symbol_id, callee_symbol_id, callee_raw, file, line, column, resolution).
    """
    site = ["callee_raw", "file", "line", "column"]
    near = typed.groupBy("caller_symbol_id", *site).agg(F.min("callee_symbol_id").alias("_a"), F.min("resolution").alias("_ar"))
    far = typed.groupBy(*site).agg(F.min("callee_symbol_id").alias("_b"), F.min("resolution").alias("_br"))
    out = calls.join(near, ["caller_symbol_id", *site], "left").join(far, site, "left")
    out = out.withColumn("callee_symbol_id", F.coalesce("callee_symbol_id", "_a", "_b")).withColumn("resolution", F.coalesce("_ar", "_br", "resolution"))
    out = out.withColumn("precise", F.coalesce("_a", "_b").isNotNull() | F.coalesce("precise", F.lit(False))).select(*calls.columns)
    rest = typed.where("resolution = 'resolved_static'").join(calls.select(*site).distinct(), site, "left_anti")
    added = rest.select(*[F.col(c) if c in rest.columns else F.lit(True).alias(c) if c == "precise" else F.lit(None).cast(calls.schema[c].dataType).alias(c) for c in calls.columns])
    return out.unionByName(added)


def fan_out(calls: DataFrame, targets: DataFrame) -> DataFrame:
    """JON-09: an interface call becomes one edge for each target (site, callee, resolution); exact ones beat possible ones."""
    site = ["file", "line", "column", "callee_raw"]
    t = targets.select(*site, F.col("callee_symbol_id").alias("_t"), F.col("resolution").alias("_r"))
    best = t.groupBy(*site, "_t").agg(F.min_by("_r", F.when(F.col("_r") == "resolved_static", 0).otherwise(1)).alias("_r"))
    out = calls.join(best, site, "left")
    return out.withColumn("callee_symbol_id", F.coalesce("_t", "callee_symbol_id")).withColumn("resolution", F.coalesce("_r", "resolution")).select(*calls.columns)


def enclosing(points: DataFrame, symbols: DataFrame) -> DataFrame:
    """JON-11: the innermost declaration around (file, line); lines are bucketed, so it is an equi-join."""
    spans = symbols.select("file", F.col("id").alias("owner"), F.col("name").alias("owner_name"), F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    spans = spans.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / LINES), F.floor(F.greatest("_a", "_b") / LINES))))
    keyed = points.withColumn("_id", F.monotonically_increasing_id()).withColumn("_k", F.floor(F.col("line") / LINES))
    found = keyed.join(spans, ["file", "_k"], "left").withColumn("_in", F.coalesce((F.col("line") >= F.col("_a")) & (F.col("line") <= F.col("_b")), F.lit(False)))
    order = Window.partitionBy("_id").orderBy(F.desc("_in"), F.desc("_a"), "_b", "owner")
    one = found.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return one.select(*points.columns, F.when(F.col("_in"), F.col("owner")).alias("owner"), F.when(F.col("_in"), F.col("owner_name")).alias("owner_name"))


def boundary_violations(imports: DataFrame, layers: list[dict]) -> DataFrame:
    """JON-12: imports (from_package, import_path) from a layer into a place it may not import.

    ``layers`` has name, packages and may_import; the first layer that matches a package is its own.
    """
    def layer(column: str):
        out = F.lit(None).cast("string")
        for spec in reversed(layers):
            hit = F.lit(False)
            for p in spec["packages"]:
                hit |= E.match_package(column, p)
            out = F.when(hit, spec["name"]).otherwise(out)
        return out

    allowed = F.lit(False)
    for spec in layers:
        for name in spec.get("may_import", []):
            allowed |= (F.col("layer") == spec["name"]) & (F.col("target_layer") == name)
    named = imports.withColumn("layer", layer("from_package")).withColumn("target_layer", layer("import_path"))
    return named.where(F.col("layer").isNotNull() & ~E.is_stdlib("import_path") & (F.col("from_package") != F.col("import_path")) & ~F.coalesce(F.col("layer") == F.col("target_layer"), F.lit(False)) & ~F.coalesce(allowed, F.lit(False)))


def dependents(g: CodeGraph, path: str) -> DataFrame:
    """JON-13."""
    return g.imports.where((F.col("import_path") == path) | F.col("import_path").endswith("/" + path)).select("from_package").distinct()


def body_env(g: CodeGraph, symbol: str) -> DataFrame:
    """JON-18: environment reads inside a symbol's lines, the accessor under its file's alias of ``os``."""
    own = g.symbols.where(E.match_symbol(symbol)).select(F.col("file").alias("_f"), F.col("line").alias("_a"), F.col("end_line").alias("_b"), "id")
    alias = g.imports.where("import_path = 'os'").select(F.col("from_file").alias("_f"), F.coalesce(F.nullif("alias", F.lit("")), F.lit("os")).alias("_os")).distinct()
    near = g.calls.join(own, (g.calls["file"] == own["_f"]) & g.calls["line"].between(own["_a"], own["_b"])).join(alias, "_f")
    return near.where((F.col("callee_raw") == F.concat("_os", F.lit(".Getenv"))) | (F.col("callee_raw") == F.concat("_os", F.lit(".LookupEnv")))).select("id", "callee_raw", "file", "line")
