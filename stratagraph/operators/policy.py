"""Checks, gates and validation predicates (POL family).

A predicate's outcome has three values: pass, fail and cannot_evaluate; an
absence passes only where the facts it rests on are complete.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.operators import aggs
from stratagraph.operators.joins import boundary_violations
from stratagraph.plans.graph import CodeGraph

DEFAULTS = {"max_arity": 6, "max_complexity": 20}
RULES = (
    "boundaries", "api_drift", "require_tests_for_changed_routes", "require_tests_for_changed_exported_symbols",
    "test_coverage", "no_orphans", "max_arity", "max_complexity", "new_globals",
)
#: What a rule can't be judged without: argument of ``check``, and the reason that is given where it is missing.
NEEDS = {
    "boundaries": ("layers", "no boundaries config exists"),
    "api_drift": ("drift", "no baseline provided"),
    "require_tests_for_changed_routes": ("changed", "no baseline or uncommitted changes provided"),
    "require_tests_for_changed_exported_symbols": ("changed", "no baseline or uncommitted changes provided"),
    "new_globals": ("baseline", "no baseline or uncommitted changes provided"),
    "max_complexity": ("complexity", "no complexity facts provided"),
}


def _levels(config: dict) -> dict[str, tuple[str, int | None]]:
    """(level, value) of each rule that is on; a name that isn't a rule is an error."""
    if unknown := sorted(set(config) - set(RULES)):
        raise ValueError(f"unknown check name in config: {unknown[0]}")
    out = {}
    for name, spec in config.items():
        level, value = (spec.get("level", "off"), spec.get("value")) if isinstance(spec, dict) else (spec, None)
        if level != "off":
            out[name] = (level, value if value and value > 0 else DEFAULTS.get(name))
    return out


def skipped(config: dict, **inputs) -> list[tuple[str, str]]:
    """(rule, reason) of rules that are on but can't be judged from ``inputs``."""
    return [(name, NEEDS[name][1]) for name in RULES if name in _levels(config) and name in NEEDS and inputs.get(NEEDS[name][0]) is None]


def _finding(df: DataFrame, rule: str, level: str, name, file, detail) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), name.cast("string").alias("name"), file.cast("string").alias("file"), detail.cast("string").alias("detail"))


def without_test(g: CodeGraph, s: DataFrame) -> DataFrame:
    """Rows of ``s`` (id, name, ...) that no test edge names by id or by name."""
    direct = g.test_edges.select(F.explode(F.array("target_symbol_id", "target")).alias("id")).where("id IS NOT NULL").distinct()
    spelled = g.test_edges.select(E.short_name("target").alias("_n")).where("_n <> ''").distinct()
    return s.join(direct, "id", "left_anti").join(spelled, F.lower(s["name"]) == F.col("_n"), "left_anti")


def check(g: CodeGraph, config: dict, changed: DataFrame | None = None, drift: DataFrame | None = None, complexity: DataFrame | None = None, layers: list[dict] | None = None, baseline: CodeGraph | None = None) -> DataFrame:
    """POL-01: findings of all rules that are on and can be judged (see ``skipped``); a rule is a level or {'level', 'value'}."""
    on = _levels(config)
    missing = {name for name, _ in skipped(config, changed=changed, drift=drift, complexity=complexity, layers=layers, baseline=baseline)}
    s = g.symbols.where(F.col("kind").isin("function", "method"))
    exported = F.col("name").rlike("^[A-Z]")

    def findings(rule: str, level: str, value: int | None) -> DataFrame:
        if rule == "boundaries":
            return _finding(boundary_violations(g.imports, layers), rule, level, F.col("from_package"), F.col("from_file"), F.col("import_path"))
        if rule == "api_drift":
            return _finding(drift.where("breaking"), rule, level, F.col("id"), F.lit(""), F.col("change"))
        if rule == "require_tests_for_changed_routes":
            hit = without_test(g, s.join(changed.select("id").distinct(), "id", "left_semi"))
            handlers = g.routes.select(F.explode(F.array(F.lower("handler"), E.short_name("handler"))).alias("_h")).where("_h <> ''").distinct()
            hit = hit.join(handlers, (F.lower("id") == F.col("_h")), "left_semi").unionByName(hit.join(handlers, F.lower("name") == F.col("_h"), "left_semi")).dropDuplicates(["id"])
            return _finding(hit, rule, level, F.col("name"), F.col("file"), F.lit("changed route handler has no mapped tests"))
        if rule == "require_tests_for_changed_exported_symbols":
            hit = g.symbols.where(exported & (F.col("kind") != "interface") & ~E.is_test_file("file")).join(changed.select("id").distinct(), "id", "left_semi")
            return _finding(without_test(g, hit), rule, level, F.col("name"), F.col("file"), F.lit("changed exported symbol has no mapped tests"))
        if rule == "test_coverage":
            return _finding(without_test(g, s.where(exported & ~E.is_test_file("file"))), rule, level, F.col("name"), F.col("file"), F.lit("exported symbol has no mapped tests"))
        if rule == "no_orphans":
            return _finding(aggs.reachable_orphans(g), rule, level, E.display_name(), F.col("file"), F.lit("unreachable"))
        if rule == "max_arity":
            n = E.arg_count("signature")
            return _finding(s.where(n > value), rule, level, E.display_name(), F.col("file"), n)
        if rule == "max_complexity":
            return _finding(complexity.where(F.col("complexity") > value), rule, level, F.col("name"), F.col("file"), F.col("complexity"))
        fresh = g.symbols.where("kind = 'var'").join(baseline.symbols.where("kind = 'var'").select("name").distinct(), "name", "left_anti")
        return _finding(fresh, rule, level, F.col("name"), F.col("file"), F.lit("new package-level global"))

    parts = [findings(rule, *on[rule]) for rule in RULES if rule in on and rule not in missing]
    if not parts:
        return g.spark.createDataFrame([], "rule string, level string, name string, file string, detail string")
    return reduce(DataFrame.unionByName, parts)


def check_status(findings: DataFrame, skipped_rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """errors, warnings, skipped and passed, warning or failed, in one row."""
    n = findings.agg(F.sum(F.when(F.col("level") == "error", 1).otherwise(0)).alias("errors"), F.sum(F.when(F.col("level") == "warn", 1).otherwise(0)).alias("warnings")).na.fill(0)
    n = n.withColumn("skipped", F.lit(len(skipped_rules or [])))
    return n.withColumn("status", F.when(F.col("errors") > 0, "failed").when(F.col("warnings") > 0, "warning").otherwise("passed"))


def changed_names(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """POL-02: normalised names of changed symbols."""
    return symbols.join(changes.select("id").distinct(), "id", "left_semi").select("id", E.short_name("name").alias("name")).distinct()


GATES = {"max_complexity": "complexity", "max_instability": "instability", "max_god_object_methods": "god_object_methods", "max_new_coupling_edges": "coupling_edges"}


def gate(g: CodeGraph, policy: dict, complexity: DataFrame | None = None, baseline: dict | None = None, fresh: bool = True) -> DataFrame:
    """POL-03: one row for each gate: value, limit, worst offender, and pass, fail or cannot_evaluate.

    A gate that lacks its input can't be evaluated; a stale graph is refused.
    """
    if unknown := sorted(set(policy) - set(GATES) - {"allow_new_orphans"}):
        raise ValueError(f"unknown gate: {unknown[0]}")
    if not fresh:
        raise ValueError("the graph is stale; build it again")
    rows: list[DataFrame] = []

    def add(name: str, df: DataFrame | None, value=None, worst=None, limit=None) -> None:
        if df is None:
            rows.append(g.spark.createDataFrame([(name, None, None, None)], "gate string, value double, `limit` double, worst string"))
            return
        rows.append(df.agg(F.max(value).cast("double").alias("value"), F.max_by(worst, value).cast("string").alias("worst")).select(F.lit(name).alias("gate"), F.coalesce("value", F.lit(0.0)).alias("value"), F.lit(float(limit)).alias("limit"), "worst"))

    if "max_complexity" in policy:
        add("complexity", complexity, F.col("complexity"), F.col("name"), policy["max_complexity"])
    if "max_instability" in policy:
        add("instability", aggs.coupling(g, stdlib=True), F.col("instability"), F.col("package"), policy["max_instability"])
    if "max_god_object_methods" in policy:
        m = g.symbols.where("kind = 'method' AND receiver <> ''").groupBy(F.regexp_replace("receiver", r"^\*", "").alias("type")).agg(F.count("*").alias("n"))
        add("god_object_methods", m, F.col("n"), F.col("type"), policy["max_god_object_methods"])
    if not policy.get("allow_new_orphans", True):
        add("orphans", None) if baseline is None else add("orphans", aggs.orphans_by_name(g).agg(F.count("*").alias("n")), F.col("n"), F.lit(""), baseline["orphan_count"])
    if "max_new_coupling_edges" in policy:
        edges = g.imports.select("from_package", "import_path").distinct().agg(F.count("*").alias("n"))
        add("coupling_edges", None) if baseline is None else add("coupling_edges", edges, F.col("n"), F.lit(""), baseline["coupling_edges"] + policy["max_new_coupling_edges"])
    if not rows:
        return g.spark.createDataFrame([], "gate string, value double, `limit` double, worst string, outcome string")
    outcome = F.when(F.col("limit").isNull(), "cannot_evaluate").when(F.col("value") > F.col("limit"), "fail").otherwise("pass")
    return reduce(DataFrame.unionByName, rows).withColumn("outcome", outcome)


def create_boundaries(imports: DataFrame) -> DataFrame:
    """POL-04: layers from the first two path segments and what they import now."""
    layer = lambda c: F.array_join(F.slice(F.split(c, "/"), 1, 2), "/")
    pairs = imports.where(~E.is_stdlib("import_path")).select(layer("from_package").alias("layer"), layer("import_path").alias("to")).distinct()
    return pairs.groupBy("layer").agg(F.array_sort(F.collect_set(F.when(F.col("to") != F.col("layer"), F.col("to")))).alias("may_import"))


def parse_binding(text: str) -> dict:
    """POL-14: strict binding with a canonical fingerprint."""
    keys = {"schema_version", "predicate", "subject", "object", "required_precision", "allow", "argument", "forbidden_values", "include_tests"}
    spec = json.loads(text)
    if not isinstance(spec, dict) or set(spec) - keys or not {"predicate", "subject"} <= set(spec):
        raise ValueError("unknown or missing members")
    if spec["predicate"] not in PREDICATES:
        raise ValueError(f"unknown predicate {spec['predicate']!r}")
    if spec["subject"].get("language", "go") != "go":
        raise ValueError("only Go subjects")
    return spec | {"fingerprint": hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()}


def _outcome(df: DataFrame, fails, unknown=None) -> DataFrame:
    """One row (outcome, evidence) from violation rows and rows that leave it open."""
    out = df.agg(F.sum(F.when(fails, 1).otherwise(0)).alias("bad"), F.sum(F.when(unknown, 1).otherwise(0)).alias("open") if unknown is not None else F.lit(0).alias("open")).na.fill(0)
    return out.select(F.when(F.col("bad") > 0, "fail").when(F.col("open") > 0, "cannot_evaluate").otherwise("pass").alias("outcome"), F.col("bad").alias("evidence"))


def _allowed(file, package, allow: list[str]):
    """FIL-20: files, or packages with an optional ``/...``."""
    out = F.lit(False)
    for a in allow:
        hit = (file == a) if a.endswith(".go") else E.flow_package(package, a)
        out |= F.coalesce(hit, F.lit(False))
    return out


def symbol_exists(g: CodeGraph, b: dict) -> DataFrame:
    """POL-07: none fails, one passes, several are ambiguous."""
    n = g.symbols.where(E.match_symbol_exact(b["subject"]["id"])).agg(F.countDistinct("id").alias("evidence"))
    return n.select(F.when(F.col("evidence") == 0, "fail").when(F.col("evidence") == 1, "pass").otherwise("cannot_evaluate").alias("outcome"), "evidence")


def package_imports(g: CodeGraph, b: dict) -> DataFrame:
    """POL-08."""
    n = g.imports.where((F.col("from_package") == b["subject"]["id"]) & (F.col("import_path") == b["object"]["id"])).agg(F.count("*").alias("evidence"))
    return n.select(F.when(F.col("evidence") > 0, "pass").otherwise("fail").alias("outcome"), "evidence")


def call_edge_exists(g: CodeGraph, b: dict) -> DataFrame:
    """POL-09: absence needs every call of the subject to be resolved."""
    own = g.calls.where(F.coalesce("caller_symbol_id", "caller_name") == b["subject"]["id"])
    n = own.agg(F.sum(F.when(F.col("callee_symbol_id") == b["object"]["id"], 1).otherwise(0)).alias("evidence"), F.bool_or(F.col("callee_symbol_id").isNull()).alias("open"))
    return n.select(F.when(F.col("evidence") > 0, "pass").when(F.coalesce("open", F.lit(False)), "cannot_evaluate").otherwise("fail").alias("outcome"), F.coalesce("evidence", F.lit(0)).alias("evidence"))


def type_implements(g: CodeGraph, b: dict) -> DataFrame:
    """POL-10."""
    n = g.implements.where((F.col("concrete_id") == b["subject"]["id"]) & (F.col("interface_id") == b["object"]["id"])).agg(F.count("*").alias("evidence"))
    return n.select(F.when(F.col("evidence") > 0, "pass").otherwise("fail").alias("outcome"), "evidence")


def imports_only_from(g: CodeGraph, b: dict) -> DataFrame:
    """POL-11: only the allowed files and packages import the subject."""
    hit = g.imports.where(F.col("import_path") == b["subject"]["id"])
    if not b.get("include_tests"):
        hit = hit.where(~E.is_test_file("from_file"))
    return _outcome(hit, ~_allowed(F.col("from_file"), "from_package", b.get("allow", [])))


def callers_only_from(g: CodeGraph, b: dict) -> DataFrame:
    """POL-12: only allowed places call the subject; a call of its name that isn't resolved leaves it open."""
    short = b["subject"]["id"].rpartition("::")[2].rpartition(".")[2].lower()
    where = g.symbols.select(F.col("id").alias("_s"), F.col("package_name").alias("_p")).dropDuplicates(["_s"])
    c = g.calls.join(where, F.col("caller_symbol_id") == F.col("_s"), "left")
    if not b.get("include_tests"):
        c = c.where(~E.is_test_file("file"))
    outside = ~_allowed(F.col("file"), "_p", b.get("allow", []))
    typed = F.col("callee_symbol_id") == b["subject"]["id"]
    return _outcome(c, typed & outside, F.col("callee_symbol_id").isNull() & (E.short_name("callee_raw") == short) & outside)


def call_arg_constant(arguments: DataFrame, b: dict) -> DataFrame:
    """POL-13: of (callee, index, value) rows for each call, the argument is constant and not forbidden."""
    hit = arguments.where((F.col("callee") == b["subject"]["id"]) & (F.col("index") == b.get("argument", 0)))
    bad = F.col("value").isin(b.get("forbidden_values", [])) if b.get("forbidden_values") else F.lit(False)
    return _outcome(hit, bad, F.col("value").isNull())


PREDICATES = {
    "symbol_exists": symbol_exists, "package_imports": package_imports, "call_edge_exists": call_edge_exists,
    "type_implements": type_implements, "imports_only_from": imports_only_from, "callers_only_from": callers_only_from, "call_arg_constant": None,
}


def validate(g: CodeGraph, binding: str, fresh: bool = True, complete: bool = True, precision: str = "precise", arguments: DataFrame | None = None) -> DataFrame:
    """POL-05, POL-06: the outcome of a binding; stale, incomplete or imprecise graphs cannot be evaluated."""
    b = parse_binding(binding)
    reason = None if fresh and complete else "stale_graph" if not fresh else "incomplete_graph"
    if reason is None and b.get("required_precision") == "precise" and precision != "precise":
        reason = "insufficient_precision"
    if reason is None and b["predicate"] == "call_arg_constant" and arguments is None:
        reason = "missing_facts"
    if reason is not None:
        return g.spark.createDataFrame([("cannot_evaluate", 0, reason)], "outcome string, evidence bigint, reason string")
    out = call_arg_constant(arguments, b) if b["predicate"] == "call_arg_constant" else PREDICATES[b["predicate"]](g, b)
    return out.select("outcome", F.col("evidence").cast("long").alias("evidence"), F.lit(None).cast("string").alias("reason"))
