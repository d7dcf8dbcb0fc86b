"""Aggregations: fan-in, coupling, size outliers, coverage, session audits (AGG family)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.operators.joins import forwarding, site_targets, sites
from stratagraph.plans.fixpoint import closure, labelled
from stratagraph.plans.graph import CodeGraph

CALLABLE = ("function", "method")


def fan_in(g: CodeGraph) -> DataFrame:
    """AGG-03: (target, n): distinct sites that reach a target directly or through wrappers; unresolved ones by spelling."""
    pairs = site_targets(g.calls).select("caller", "file", "line", "column", "callee_raw", "target")
    wrapped = g.calls.where("synthetic").select(F.col("caller_symbol_id").alias("id")).where("id IS NOT NULL").distinct()
    if wrapped.isEmpty():
        return pairs.distinct().groupBy("target").agg(F.count("*").alias("n"))
    ahead = forwarding(g.calls, wrapped.select(F.col("id").alias("seed"), "id"), reverse=False).where("seed <> id")
    through = pairs.join(ahead, pairs["target"] == ahead["seed"]).select("caller", "file", "line", "column", "callee_raw", F.col("id").alias("target"))
    return pairs.unionByName(through).distinct().groupBy("target").agg(F.count("*").alias("n"))


def hotspot(g: CodeGraph, n: int = 20, tests: bool = False) -> DataFrame:
    """AGG-04: most called functions and methods; a call counts by id or by any of four spellings."""
    s = g.symbols.where(F.col("kind").isin(*CALLABLE))
    s = s if tests else s.where(~E.is_test_file("file"))
    spelled = F.array_distinct(F.array("id", "name", E.display_name(), F.concat_ws(".", "package_name", "name")))
    keys = s.select("id", "name", "kind", "file", "line", F.explode(spelled).alias("target"))
    counts = keys.join(fan_in(g), "target").groupBy("id", "name", "kind", "file", "line").agg(F.sum("n").alias("incoming_calls"))
    return counts.orderBy(F.desc("incoming_calls"), F.lower("name"), "file", "line", "id").limit(n)


def coupling(g: CodeGraph, stdlib: bool = False, only: str | None = None) -> DataFrame:
    """AGG-05: fan-out, fan-in and instability of packages over distinct import edges.

    Short names become full paths first (of several the last by path); the filter holds for both ends.
    """
    full = g.packages.groupBy("name").agg(F.max("import_path_best_effort").alias("full"))
    e = g.imports.select("from_package", "import_path").distinct().join(full, F.col("from_package") == F.col("name"), "left")
    e = e.select(F.coalesce("full", "from_package").alias("f"), F.col("import_path").alias("t")).where("f <> t").distinct()
    if not stdlib:
        known = g.packages.select(F.col("import_path_best_effort").alias("t")).distinct()
        own = e.join(known, "t", "left_semi")
        e = own.unionByName(e.join(known, "t", "left_anti").where(~E.is_stdlib("t")))
    if only is not None:
        e = e.where(F.col("f").startswith(only) & F.col("t").startswith(only))
    both = e.select(F.col("f").alias("package"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select("t", F.lit(0), F.lit(1)))
    out = both.groupBy("package").agg(F.sum("o").alias("fan_out"), F.sum("i").alias("fan_in"))
    total = F.col("fan_out") + F.col("fan_in")
    return out.withColumn("instability", F.when(total == 0, F.lit(-1.0)).otherwise(F.col("fan_out").cast("double") / total))


def god_objects(g: CodeGraph, n: int | None = 10, methods: int = 5, fields: int = 8, calls: int = 15, by_type: bool = False) -> DataFrame:
    """AGG-06: receivers with too many methods, fields or outgoing call sites.

    Receivers are keyed as written; with ``by_type`` a star is dropped first.
    """
    key = F.regexp_replace("receiver", r"^\*", "") if by_type else F.col("receiver")
    m = g.symbols.where("kind = 'method' AND receiver <> ''").withColumn("type", key)
    count = m.groupBy("type").agg(F.count("*").alias("methods"))
    size = g.symbols.where("kind = 'struct'").groupBy(F.col("name").alias("type")).agg(F.max(F.size("struct_fields")).alias("fields"))
    out = sites(g.calls).join(m.select(F.col("id").alias("caller_symbol_id"), "type"), "caller_symbol_id").groupBy("type").agg(F.count("*").alias("calls"))
    all_ = count.join(size, "type", "full_outer").join(out, "type", "full_outer").na.fill(0)
    over = lambda c, most: F.greatest(F.col(c) - most, F.lit(0))
    score = over("methods", methods) + over("fields", fields) + F.floor(over("calls", calls) / 2)
    found = all_.where((F.col("methods") > methods) | (F.col("fields") > fields) | (F.col("calls") > calls)).withColumn("score", score).withColumn("severity", E.severity("score"))
    found = found.orderBy(F.desc("score"), "type")
    return found if n is None else found.limit(n)


def orphans_by_name(g: CodeGraph) -> DataFrame:
    """AGG-08: callables whose name no call spells."""
    used = g.calls.where(~F.coalesce("synthetic", F.lit(False))).select(F.explode(F.array("callee_raw", F.element_at(F.split("callee_raw", r"\."), -1))).alias("name")).distinct()
    return g.symbols.where(F.col("kind").isin(*CALLABLE) & ~F.col("name").isin("main", "init")).join(used, "name", "left_anti")


def attribution_edges(g: CodeGraph) -> DataFrame:
    """TRV-12: distinct (src, dst, exact) links from calls and test edges; unresolved spellings through TRV-13."""
    c = g.calls.where("callee_symbol_id IS NOT NULL").select(F.coalesce("caller_symbol_id", "caller_name").alias("src"), F.col("callee_symbol_id").alias("dst"), E.exact().alias("exact"))
    open_ = g.calls.where("callee_symbol_id IS NULL").select(F.coalesce("caller_symbol_id", "caller_name").alias("src"), "callee_raw")
    t = g.test_edges.where("target_symbol_id IS NOT NULL").select(F.col("test_func").alias("src"), F.col("target_symbol_id").alias("dst"), E.exact().alias("exact"))
    found = open_.join(unresolved_targets(g), "callee_raw").select("src", F.col("id").alias("dst"), F.lit(False).alias("exact"))
    return c.unionByName(t).unionByName(found).distinct()


def unresolved_targets(g: CodeGraph) -> DataFrame:
    """TRV-13: (callee_raw, id): callables that an unresolved spelling may mean; distinct spellings meet names in an equi-join."""
    raws = g.calls.where("callee_symbol_id IS NULL").select("callee_raw").distinct().withColumn("short", E.short_name("callee_raw"))
    s = g.symbols.where(F.col("kind").isin(*CALLABLE)).select("id", F.lower("name").alias("short"), E.display_name().alias("display"))
    return raws.join(s, "short").where(F.contains("callee_raw", F.lit(".")) | (F.lower("callee_raw") == F.col("short"))).select("callee_raw", "id").distinct()


def untested(g: CodeGraph, exclude: list[str] | None = None, interface_methods: bool = True, executed: DataFrame | None = None) -> DataFrame:
    """AGG-09: called production callables without exact transitive test.

    Ordered none before possible, then by callers.  With ``executed`` (id, statements)
    runtime coverage decides instead.
    """
    tests = g.test_edges.select(F.lit(0).alias("seed"), F.col("test_func").alias("id")).unionByName(g.symbols.where(E.is_test_file("file") & E.test_name("name")).select(F.lit(0).alias("seed"), "id")).distinct()
    reach = labelled(attribution_edges(g), tests).select("id", "resolution")
    s = g.symbols.where(F.col("kind").isin(*CALLABLE) & ~E.is_test_file("file"))
    for pattern in exclude or []:
        s = s.where(~E.glob("file", pattern))
    if not interface_methods:
        s = s.join(interface_method_ids(g), "id", "left_anti")
    counted = s.select("id", "name", "kind", "file", "line").join(fan_in(g).withColumnRenamed("target", "id").withColumnRenamed("n", "callers"), "id")
    if executed is not None:
        return counted.join(executed.where("statements > 0").select("id"), "id", "left_anti")
    out = counted.join(reach, "id", "left").where("coalesce(resolution, 'none') <> 'exact'").withColumn("resolution", F.coalesce("resolution", F.lit("none")))
    return out.orderBy(F.when(F.col("resolution") == "none", 0).otherwise(1), F.desc("callers"), "name", "id")


def interface_method_ids(g: CodeGraph) -> DataFrame:
    """AGG-10: methods of an interface that their receiver implements, or with one of the usual names."""
    required = g.symbols.where("kind = 'interface'").select(F.col("id").alias("interface_id"), F.explode(F.map_keys("interface_methods")).alias("name"))
    promised = g.implements.select("interface_id", F.col("concrete_id").alias("type_id")).distinct().join(required, "interface_id").select("type_id", "name").distinct()
    receiver = F.substring_index(F.regexp_replace("receiver", r"^[(*)]+|[(*)]+$", ""), "[", 1)
    m = g.symbols.where("kind = 'method' AND receiver <> ''").select("id", "name", F.concat(F.substring_index("id", "::", 1), F.lit("::"), receiver).alias("type_id"))
    return m.join(promised, ["type_id", "name"], "left_semi").select("id").unionByName(m.where(F.col("name").isin(*E.COMMON_INTERFACE_METHODS)).select("id")).distinct()


def evidence(g: CodeGraph, ids: DataFrame) -> DataFrame:
    """What a role is told from, one row for each of ``ids`` (id): traffic, size, data access, entry surface.

    Production callers and callees are call sites; ``handles`` says that a route names the symbol.
    """
    s = g.symbols.join(ids.select("id").distinct(), "id", "left_semi")
    s = s.select("id", "kind", "name", "receiver", "package_name", F.coalesce(F.size("struct_fields"), F.lit(0)).alias("fields")).dropDuplicates(["id"])
    own = s.select("id")
    c = sites(g.calls)
    count = lambda df, key, name: df.select(F.col(key).alias("id")).join(own, "id", "left_semi").groupBy("id").agg(F.count("*").alias(name))
    runs = g.sqls.select(F.col("function").alias("id")).unionByName(g.sqls.join(g.symbols.select("id", E.display_name().alias("_shown")), F.col("function") == F.col("_shown")).where("function <> id").select("id"))
    below = c.select(F.col("caller_symbol_id").alias("id"), F.col("callee_symbol_id").alias("_to")).distinct().join(runs.select(F.col("id").alias("_to")).distinct(), "_to", "left_semi")
    owner = F.regexp_replace("receiver", r"^[(*)]+|[(*)]+$", "")
    methods = g.symbols.where("kind = 'method'").groupBy("package_name", owner.alias("name")).agg(F.count("*").alias("methods"))
    named = g.routes.select(E.short_name("handler").alias("_h")).unionByName(g.routes.select(F.lower("handler").alias("_h"))).where("_h <> ''").distinct()
    out = s.join(methods, ["package_name", "name"], "left")
    for part in (
        count(c.where(~E.is_test_file("file")), "callee_symbol_id", "prod_callers"), count(c, "caller_symbol_id", "callees"), count(runs, "id", "sqls"), count(below, "id", "sql_callees"),
        count(g.test_edges.select("target_symbol_id", "test_func").distinct(), "target_symbol_id", "tests"),
    ):
        out = out.join(part, "id", "left")
    handled = s.join(named, (F.lower("name") == F.col("_h")), "left_semi").select("id").unionByName(s.join(named, F.lower("id") == F.col("_h"), "left_semi").select("id")).distinct()
    out = out.join(handled.withColumn("handles", F.lit(True)), "id", "left")
    return out.na.fill(0, ["methods", "prod_callers", "callees", "sqls", "sql_callees", "tests"]).na.fill(False, ["handles"])


def complexity(facts: DataFrame, name: str = "") -> DataFrame:
    """AGG-07: (id, name, file, line, complexity, label) of functions, most complex first; a score that isn't known is labelled so."""
    label = F.when(F.col("complexity").isNull() | (F.col("complexity") < 1), "UNKNOWN").when(F.col("complexity") <= 5, "LOW").when(F.col("complexity") <= 10, "MEDIUM").when(F.col("complexity") <= 20, "HIGH").otherwise("VERY HIGH")
    hit = facts if not name else facts.where((F.lower("name") == name.lower()) | (F.col("id") == name) | (E.short_name("name") == name.lower()))
    return hit.withColumn("label", label).orderBy(F.desc_nulls_last("complexity"), "name", "file", "line")


def statements_in_range(symbols: DataFrame, blocks: DataFrame, bucket: int = 64) -> DataFrame:
    """AGG-11: per symbol, statements and executed statements of blocks that start inside it."""
    spans = symbols.select("id", "file", "line", "end_line").withColumn("_k", F.explode(F.sequence(F.floor(F.col("line") / bucket), F.floor(F.greatest("line", "end_line") / bucket))))
    b = blocks.select("file", F.col("start_line").alias("_s"), "statements", "count").withColumn("_k", F.floor(F.col("_s") / bucket))
    hit = spans.join(b, ["file", "_k"]).where("_s BETWEEN line AND end_line")
    return hit.groupBy("id").agg(F.sum("statements").alias("total"), F.sum(F.when(F.col("count") > 0, F.col("statements")).otherwise(0)).alias("statements"))


def uncovered_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """AGG-12: (file, line) in a block that was never executed, and in none that was."""
    b = blocks.where("statements > 0").select("file", "start_line", "end_line", "count").withColumn("line", F.explode(F.sequence("start_line", F.greatest("start_line", "end_line"))))
    per = b.groupBy("file", "line").agg(F.bool_or(F.col("count") > 0).alias("ran"))
    return lines.select("file", "line").distinct().join(per, ["file", "line"]).where("NOT ran").select("file", "line")


def merge_ranges(lines: DataFrame) -> DataFrame:
    """WIN-03: consecutive lines of a file as ranges."""
    rows = lines.select("file", "line").distinct().withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line")))
    return rows.groupBy("file", "island").agg(F.min("line").alias("range_start"), F.max("line").alias("range_end"), F.count("*").alias("n")).drop("island")


def uncovered_report(changed: DataFrame, blocks: DataFrame) -> DataFrame:
    """AGG-13: per file, changed and uncovered lines and the uncovered ranges."""
    open_ = uncovered_lines(changed, blocks)
    ranges = merge_ranges(open_).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("range_start", "range_end"))).alias("ranges"), F.sum("n").alias("uncovered"))
    total = changed.select("file", "line").distinct().groupBy("file").agg(F.count("*").alias("changed"))
    return total.join(ranges, "file", "left").select("file", "changed", F.coalesce("uncovered", F.lit(0)).alias("uncovered"), "ranges")


def reachable_orphans(g: CodeGraph, extra_roots: DataFrame | None = None) -> DataFrame:
    """TRV-07: production callables that no root reaches.

    Roots are main, init, tests, exported symbols outside ``internal`` and route handlers.
    """
    s = g.symbols.where(F.col("kind").isin(*CALLABLE))
    rooted = F.col("name").isin("main", "init") | E.is_test_file("file") | (F.col("name").rlike("^[A-Z]") & ~F.array_contains(F.split("file", "/"), "internal"))
    roots = s.where(rooted).select("id").unionByName(s.join(g.routes.select(E.short_name("handler").alias("_h")).distinct(), F.lower("name") == F.col("_h"), "left_semi").select("id"))
    roots = roots.unionByName(g.calls.where("caller_name = 'init' AND caller_symbol_id IS NULL AND callee_symbol_id IS NOT NULL").select(F.col("callee_symbol_id").alias("id")))
    return unreached(g, roots if extra_roots is None else extra_roots)


def unreached(g: CodeGraph, roots: DataFrame) -> DataFrame:
    """Production callables outside the forward closure of ``roots`` (id)."""
    reach = closure(attribution_edges(g).select("src", "dst"), roots.select(F.lit(0).alias("seed"), "id").distinct())
    return g.symbols.where(F.col("kind").isin(*CALLABLE) & ~E.is_test_file("file")).join(reach.select("id"), "id", "left_anti")


def metric_snapshot(g: CodeGraph, name: str, complexity: DataFrame | None = None) -> DataFrame:
    """AGG-15: one row of metrics; coupling with the standard library."""
    c = coupling(g, stdlib=True)
    parts = [
        g.symbols.agg(F.count("*").alias("symbols")),
        orphans_by_name(g).agg(F.count("*").alias("orphans")),
        god_objects(g, None).agg(F.count("*").alias("god_object_count"), F.array_sort(F.collect_list("type")).alias("god_objects")),
        c.where("instability >= 0").agg(F.avg("instability").alias("avg_instability")),
        g.imports.select("from_package", "import_path").distinct().agg(F.count("*").alias("coupling_edges")),
    ]
    if complexity is not None:
        parts.append(complexity.agg(F.max("complexity").alias("max_complexity")))
    out = parts[0].withColumn("name", F.lit(name))
    for p in parts[1:]:  # each side is one row
        out = out.join(F.broadcast(p), F.lit(True))
    return out


def summary(g: CodeGraph) -> DataFrame:
    """AGG-14: top hotspots, the most unstable package, counts of orphans and god objects, as (metric, rank, name, value)."""
    hot = hotspot(g, 3).select(F.lit("hotspot").alias("metric"), "name", F.col("incoming_calls").cast("double").alias("value"))
    worst = coupling(g).where("instability >= 0").orderBy(F.desc("instability"), F.desc("fan_out"), "package").limit(1).select(F.lit("instability").alias("metric"), F.col("package").alias("name"), F.col("instability").alias("value"))
    lone = orphans_by_name(g).agg(F.lit("orphans").alias("metric"), F.lit("").alias("name"), F.count("*").cast("double").alias("value"))
    gods = god_objects(g, None).agg(F.lit("god objects").alias("metric"), F.lit("").alias("name"), F.count("*").cast("double").alias("value"))
    return hot.unionByName(worst).unionByName(lone).unionByName(gods)


def baseline(g: CodeGraph) -> DataFrame:
    """AGG-16: what the next publication compares with."""
    o = orphans_by_name(g).agg(F.count("*").alias("orphan_count"))
    return o.join(F.broadcast(g.imports.select("from_package", "import_path").distinct().agg(F.count("*").alias("coupling_edges"))), F.lit(True))


def file_density(g: CodeGraph) -> DataFrame:
    """AGG-19: symbols of each package."""
    return g.symbols.groupBy("package_name").agg(F.count("*").alias("n_symbols"))


def explain_counts(g: CodeGraph, symbol_id: str) -> DataFrame:
    """AGG-20: evidence around one symbol, one row."""
    c = sites(g.calls)
    parts = {
        "callers": c.where(F.col("callee_symbol_id") == symbol_id),
        "callees": c.where(F.col("caller_symbol_id") == symbol_id),
        "tests": g.test_edges.where(F.col("target_symbol_id") == symbol_id).select("test_func").distinct(),
        "sqls": g.sqls.where(F.col("function") == symbol_id),
        "envs": g.env_reads.where(F.col("function") == symbol_id),
        "interfaces": g.implements.where(F.col("concrete_id") == symbol_id),
    }
    out = g.symbols.where(F.col("id") == symbol_id).agg(F.count("*").alias("declared")).withColumn("id", F.lit(symbol_id))
    for name, df in parts.items():
        out = out.join(F.broadcast(df.agg(F.count("*").alias(name))), F.lit(True))
    return out


PLANNING, REVIEWING = "plan", "review"
COMPOSED = ("plan", "review", "context", "explore", "endpoint")
RAW = ("callers", "callees", "source", "node", "query")


def audit(log: DataFrame, keys: list[str], composed: tuple[str, ...] = COMPOSED, raw: tuple[str, ...] = RAW) -> DataFrame:
    """AGG-17: per session, counts by status, plan and review, composability, score and grade.

    Invocation errors don't count; without composed or raw commands composability is 100, without commands so is success.
    """
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    tried = F.col("status") != "invocation_error"
    out = log.groupBy(*keys).agg(
        F.count("*").alias("total_commands"), one(F.col("status") == "success").alias("success_count"), one(F.col("status") == "failure").alias("failure_count"), one(~tried).alias("invocation_errors"),
        F.max(F.when((F.col("command") == PLANNING) & tried, 1).otherwise(0)).alias("planned"), F.max(F.when((F.col("command") == REVIEWING) & tried, 1).otherwise(0)).alias("reviewed"),
        one(F.col("command").isin(*composed) & tried).alias("composed"), one(F.col("command").isin(*raw) & tried).alias("raw"),
    )
    share = lambda a, b: F.when(b == 0, F.lit(100.0)).otherwise(F.col(a).cast("double") / b * 100)
    out = out.withColumn("success_rate", share("success_count", F.col("success_count") + F.col("failure_count"))).withColumn("composability", share("composed", F.col("composed") + F.col("raw")))
    out = out.withColumn("score", 35.0 * F.col("planned") + 35.0 * F.col("reviewed") + 0.3 * F.col("composability"))
    return out.withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").otherwise("F"))


def credit_unselected(audited: DataFrame, unselected: DataFrame, key: str = "session_id") -> DataFrame:
    """AGG-18: plan and review calls of the journal without session count for the one session they were adopted by.

    ``unselected`` has (command, candidates array<string>); only rows with one candidate are credited.
    """
    mine = unselected.where((F.size("candidates") == 1) & F.col("command").isin(PLANNING, REVIEWING)).select(F.element_at("candidates", 1).alias(key), "command")
    extra = mine.groupBy(key).agg(F.max(F.when(F.col("command") == PLANNING, 1).otherwise(0)).alias("_p"), F.max(F.when(F.col("command") == REVIEWING, 1).otherwise(0)).alias("_r"))
    out = audited.join(extra, key, "left").withColumn("planned", F.greatest("planned", F.coalesce("_p", F.lit(0)))).withColumn("reviewed", F.greatest("reviewed", F.coalesce("_r", F.lit(0))))
    return out.drop("_p", "_r").withColumn("score", 35.0 * F.col("planned") + 35.0 * F.col("reviewed") + 0.3 * F.col("composability"))


def filter_complexity(df: DataFrame, n: int | None = None, prefix: str | None = None, tests: bool = True) -> DataFrame:
    """FIL-18."""
    if not tests:
        df = df.where(~E.is_test_file("file"))
    if prefix:
        df = df.where(F.col("file").startswith(prefix))
    df = df.orderBy(F.desc("complexity"), "name", "file", "line")
    return df if n is None else df.limit(n)
