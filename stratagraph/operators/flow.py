"""Taint flow as a semi-naive fixed point over facts (FLW family).

A trace says that a value of a function holds data of a source:
(function, value, source, sanitised kinds, call string).  Each round joins
only the traces that were new or better in the last round with transfers,
calls and returns; of traces with one key the best stays (confident, complete
call string, short path).  Call strings keep the last ``k`` frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.plans.fixpoint import pairs
from stratagraph.plans.graph import CodeGraph, cut

# Which calls are sources and sinks, and which arguments of a sink count (None: all).
SOURCE_CALLS = {
    "os.Getenv": "environment", "os.LookupEnv": "environment",
    "viper.GetString": "environment", "viper.GetBool": "environment", "viper.GetInt": "environment", "viper.Get": "environment",
    "r.FormValue": "http_request", "r.PostFormValue": "http_request",
}
#: Calls that decode into one of their arguments.
DECODE_CALLS = {"json.Unmarshal": 1, "json.UnmarshalRead": 1, "json.UnmarshalDecode": 1}
SINK_CALLS = {
    "Query": "sql_query", "QueryRow": "sql_query", "Exec": "sql_query", "Prepare": "sql_query", "Raw": "sql_query",
    "QueryContext": "sql_query", "QueryRowContext": "sql_query", "ExecContext": "sql_query", "PrepareContext": "sql_query",
    "exec.Command": "process_execution", "exec.CommandContext": "process_execution",
    "os.WriteFile": "filesystem", "os.ReadFile": "filesystem", "os.Open": "filesystem", "os.OpenFile": "filesystem", "os.OpenRoot": "filesystem",
    "os.Create": "filesystem", "os.Remove": "filesystem", "os.RemoveAll": "filesystem", "os.Mkdir": "filesystem", "os.MkdirAll": "filesystem",
    "os.Chmod": "filesystem", "os.Chown": "filesystem", "os.Lchown": "filesystem", "os.Chtimes": "filesystem", "os.Truncate": "filesystem",
    "os.Stat": "filesystem", "os.Lstat": "filesystem", "os.Readlink": "filesystem", "os.DirFS": "filesystem",
    "os.CreateTemp": "filesystem", "os.MkdirTemp": "filesystem", "os.Rename": "filesystem", "os.Symlink": "filesystem", "os.Link": "filesystem",
    "http.Get": "network", "http.Head": "network", "http.Post": "network", "http.PostForm": "network",
    "http.NewRequest": "network", "http.NewRequestWithContext": "network", "Do": "network",
}
SINK_ARGUMENTS = {
    "QueryContext": (1,), "QueryRowContext": (1,), "ExecContext": (1,), "PrepareContext": (1,), "exec.Command": None, "exec.CommandContext": None,
    "os.CreateTemp": (0, 1), "os.MkdirTemp": (0, 1), "os.Rename": (0, 1), "os.Symlink": (0, 1), "os.Link": (0, 1),
    "http.NewRequest": (1,), "http.NewRequestWithContext": (2,),
}
REQUEST_TYPES = ("*http.Request",)
DEFAULT_K, MAX_K = 3, 16


def budget(facts: int, asked: int | None = None) -> int:
    """FLW-15: attempted rows before propagation stops."""
    return max(2_000_000, min(2_000_000_000, 400 * facts)) if asked is None else max(1, min(2_000_000_000, asked))


def classify_source(callee: str):
    """FLW-03 for a callee column."""
    return reduce(lambda out, kv: F.when(F.col(callee) == kv[0], kv[1]).otherwise(out), SOURCE_CALLS.items(), F.lit(None).cast("string"))


def classify_sink(callee: str):
    """FLW-04 for a callee column: by the whole name, or its last part for query methods."""
    last = F.element_at(F.split(callee, r"\."), -1)
    return reduce(lambda out, kv: F.when((F.col(callee) if "." in kv[0] else last) == kv[0], kv[1]).otherwise(out), SINK_CALLS.items(), F.lit(None).cast("string"))


def related(a, b):
    """SCL-21: equal, or one a dotted prefix of the other."""
    return (a == b) | a.startswith(F.concat(b, F.lit("."))) | b.startswith(F.concat(a, F.lit(".")))


def sink_arguments(callee: str, count: int) -> range | tuple[int, ...]:
    """Positions of the arguments that reach a sink; the first where nothing else is said."""
    name = callee if callee in SINK_CALLS else callee.rpartition(".")[2]
    found = SINK_ARGUMENTS.get(name, (0,))
    return range(1 if name == "exec.CommandContext" else 0, count) if found is None else tuple(i for i in found if i < count)


def resolve_calls(calls: DataFrame, g: CodeGraph, functions: DataFrame) -> DataFrame:
    """FLW-10: (function_id, file, line, callee, callee_id): what a call may enter, by the first rule that finds something.

    Typed ids at the same site, else the function of an imported package under its alias, else one of the same
    package.  Three equi-joins; a call that none of them resolves has no row.
    """
    site = ["function_id", "file", "line", "callee"]
    c = calls.select(*site).distinct()
    known = functions.select(F.col("id").alias("callee_id")).distinct()
    typed = g.calls.where("callee_symbol_id IS NOT NULL").select(F.col("caller_symbol_id").alias("function_id"), "file", "line", F.col("callee_raw").alias("callee"), F.col("callee_symbol_id").alias("callee_id")).distinct()
    short = F.element_at(F.split("callee", r"\.|::"), -1)
    names = F.array(F.element_at(F.split("import_path", "/"), -1), F.coalesce(F.nullif("alias", F.lit("")), F.element_at(F.split("import_path", "/"), -1)))
    imported = g.imports.select(F.col("from_file").alias("file"), F.explode(names).alias("_q"), "import_path").distinct()
    qualified = c.where(F.contains("callee", F.lit("."))).withColumn("_q", F.substring_index("callee", ".", 1)).join(imported, ["file", "_q"])
    near = c.where(~F.contains("callee", F.lit("."))).withColumn("callee_id", F.concat(F.regexp_extract("function_id", "^(.*::)", 1), short))
    found = reduce(DataFrame.unionByName, [
        c.join(typed, site).select(*site, "callee_id", F.lit(1).alias("_tier")),
        qualified.select(*site, F.concat_ws("::", "import_path", short).alias("callee_id"), F.lit(2).alias("_tier")),
        near.select(*site, "callee_id", F.lit(3).alias("_tier")),
    ]).join(known, "callee_id", "left_semi")
    found = cut(found)
    best = found.groupBy(*site).agg(F.min("_tier").alias("_tier"))
    return found.join(best, [*site, "_tier"]).select(*site, "callee_id").distinct()


def _root(c):
    return F.element_at(F.split(c, r"\."), 1)


def flow(g: CodeGraph, policy: dict | None = None, k: int = DEFAULT_K, tests: bool = False, package: str | None = None, max_rounds: int = 64, work: int | None = None, paths: bool = True) -> tuple[DataFrame, dict]:
    """FLW-01: findings (source_function, source_kind, sink_function, sink_kind, line, severity, confidence, path) and a report.

    ``policy`` has sanitizers, sources and sinks; the report says whether the fixed point was reached.
    Without ``paths`` the findings have none, and all sources share one propagation: its states are places of a value,
    and which source reaches which sink is asked of the graph of their steps, where sinks are nodes too.  No state
    yields to another there, so a cut call string always goes on beside a complete one.  A function without a value
    that returns never asks who called it, so it starts a new call string; where none returns and nothing sanitises,
    the steps of all places are read off the facts at once.
    """
    policy = policy or {}
    k = max(1, min(MAX_K, k))
    facts = g.flow_facts if tests else g.flow_facts.where(~E.is_test_file("file"))
    if package:
        facts = facts.where(E.flow_package("function_id", package) | F.col("function_id").startswith(package.removesuffix("/...")))
    facts = cut(facts)
    n_facts = facts.count()
    limit = budget(n_facts, work)
    fn = g.flow_functions.dropDuplicates(["id"]).select(F.col("id").alias("callee_id"), "name", F.col("params").alias("params"))

    own = facts.where("kind = 'source'").select("function_id", F.col("target").alias("value"), F.struct(F.col("function_id").alias("function"), F.col("source_kind").alias("kind"), "line").alias("source"))
    for spec in policy.get("sources", []):
        extra = facts.where((F.col("kind") == "call") & E.flow_function("callee", spec["function"])).select("function_id", F.col("target").alias("value"), F.struct(F.col("function_id").alias("function"), F.lit(spec["kind"]).alias("kind"), "line").alias("source"))
        own = own.unionByName(extra)
    none = F.array().cast("array<string>")
    delta = own.select("function_id", "value", "source", none.alias("clean"), none.alias("stack"), F.lit(False).alias("low"), F.lit(False).alias("truncated"), F.array("function_id").alias("path")).where("value IS NOT NULL").distinct()
    key = ["function_id", "value", "source", "clean", "stack"]
    rank = F.struct("low", "truncated", F.size("path").alias("n"), "path")
    best = delta = cut(delta.groupBy(*key).agg(F.min_by(F.struct("low", "truncated", "path"), rank).alias("b")).select(*key, "b.low", "b.truncated", "b.path"))

    moves = facts.where("kind IN ('transfer', 'return')").select("function_id", F.col("target").alias("to"), F.explode("inputs").alias("from"))
    moves = cut(moves.withColumn("root", _root(F.col("from"))).distinct())
    args = facts.where("kind = 'call'").select("function_id", "file", "callee", "line", "column", F.col("target").alias("result"), F.posexplode("arguments").alias("pos", "refs")).withColumn("from", F.explode("refs")).drop("refs")
    args = cut(args.withColumn("root", _root(F.col("from"))))
    entered = resolve_calls(args, g, g.flow_functions).join(fn.select("callee_id", "name", "params"), "callee_id")
    names = lambda c: F.transform(c, lambda p: p["name"])
    held = own.select("function_id", "value").union(moves.select("function_id", "to")).union(fn.select("callee_id", F.explode(names("params"))))
    results, args = args.select("function_id", "result"), args.join(entered, ["function_id", "file", "line", "callee"], "left")
    if paths:
        args = args.withColumn("returns", F.lit(True))
    else:
        returns = cut(held.union(results).where(F.col("value").startswith("$return")).select(F.col("function_id").alias("callee_id"), F.lit(True).alias("returns")).distinct())
        args = args.join(returns, "callee_id", "left").withColumn("returns", F.coalesce("returns", F.lit(False)))
    args = cut(args)
    clean_kinds = reduce(lambda out, s: F.when(E.flow_function("callee", s["function"]), F.array(*map(F.lit, s.get("for") or ["*"]))).otherwise(out), policy.get("sanitizers", []), none)
    args = args.withColumn("cleans", clean_kinds)
    call = cut(args.where("callee_id IS NOT NULL AND returns").select(F.col("callee_id").alias("function_id"), F.col("function_id").alias("caller"), F.concat_ws("@", "function_id", "line", "column").alias("frame"), "result", "cleans").where("result IS NOT NULL").distinct())

    def step(delta: DataFrame) -> DataFrame:
        """Where traces go next."""
        d = delta.withColumn("root", _root(F.col("value")))
        a = d.join(moves, ["function_id", "root"]).where(related(F.col("value"), F.col("from")))
        a = a.select("function_id", F.col("to").alias("value"), "source", "clean", "stack", "low", "truncated", "path")
        c = d.join(args, ["function_id", "root"]).where(related(F.col("value"), F.col("from")))
        frame = F.concat_ws("@", "function_id", "line", "column")
        grown = F.concat("stack", F.array(frame))
        param = F.element_at("params", F.least(F.col("pos") + 1, F.size("params")))["name"]
        # Arguments beyond the parameters belong to a last one that is variadic, else to none.
        takes = (F.col("pos") < F.size("params")) | F.element_at("params", -1)["type"].startswith("...")
        inside = c.where("callee_id IS NOT NULL AND size(params) > 0").where(takes).select(F.col("callee_id").alias("function_id"), param.alias("value"), "source", "clean", F.when(F.col("returns"), F.slice(grown, F.greatest(F.size(grown) - k + 1, F.lit(1)), F.lit(k))).otherwise(none).alias("stack"), "low", (F.col("returns") & (F.col("truncated") | (F.size(grown) > k))).alias("truncated"), F.concat("path", F.array("callee_id")).alias("path"))
        # A sanitiser cleans what goes in, resolved or not; any other unknown call hands it on with low confidence.
        through = c.where("(callee_id IS NULL OR size(cleans) > 0) AND result IS NOT NULL").select("function_id", F.col("result").alias("value"), "source", F.array_sort(F.array_union("clean", "cleans")).alias("clean"), "stack", (F.col("low") | (F.size("cleans") == 0)).alias("low"), "truncated", "path")
        back = d.where(F.col("value").startswith("$return") & ((F.size("stack") > 0) | F.col("truncated")))
        back = back.join(call, "function_id").where((F.size("stack") == 0) | (F.get("stack", F.size("stack") - 1) == F.col("frame")))
        back = back.select(F.col("caller").alias("function_id"), F.col("result").alias("value"), "source", F.array_sort(F.array_union("clean", "cleans")).alias("clean"), F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0))).alias("stack"), (F.col("low") | (F.size("stack") == 0)).alias("low"), "truncated", F.concat("path", F.array("caller")).alias("path"))
        return reduce(DataFrame.unionByName, [a, inside, through, back]).where("value IS NOT NULL")

    attempted, rounds, done = 0, 0, False
    while paths and rounds < max_rounds and attempted < limit:
        rounds += 1
        new = step(delta)
        new = cut(new.groupBy(*key).agg(F.min_by(F.struct("low", "truncated", "path"), rank).alias("b")).select(*key, "b.low", "b.truncated", "b.path"))
        attempted += new.count()
        old = best.select(*key, F.struct("low", "truncated", F.size("path").alias("n"), "path").alias("o"))
        delta = cut(new.join(old, key, "left").where(F.col("o").isNull() | (rank < F.col("o"))).drop("o"))
        if delta.isEmpty():
            done = True
            break
        best = cut(best.join(delta.select(*key), key, "left_anti").unionByName(delta))

    state = ["function_id", "value", "clean", "stack", "low", "truncated"]
    if not paths:
        seen = delta = cut(delta.select(*state).distinct())
        unknown = args.where("callee_id IS NULL AND result IS NOT NULL")
        if max_rounds > 0 and not policy.get("sanitizers") and returns.isEmpty():
            rounds, done = 1, True
            lows = [F.lit(low) for low in ((False,) if unknown.isEmpty() else (False, True))]
            seen = held.union(unknown.select("function_id", "result")).where("value IS NOT NULL").distinct().select("function_id", "value", none.alias("clean"), none.alias("stack"), F.explode(F.array(*lows)).alias("low"), F.lit(False).alias("truncated"))
    while not paths and not done and rounds < max_rounds and attempted < limit:
        rounds += 1
        new = step(delta.withColumn("source", F.to_json(F.struct(*state))).withColumn("path", none))
        new = cut(new.select("source", *state).distinct())
        attempted += new.count()
        delta = cut(new.select(*state).distinct().join(seen, state, "left_anti"))
        if delta.isEmpty():
            done = True
            break
        seen = seen.unionByName(delta)
        if rounds % 5 == 0:
            seen = cut(seen)

    sinks = facts.where("kind = 'sink'").select("function_id", "line", "column", "sink_kind", F.explode("inputs").alias("from"))
    for spec in policy.get("sinks", []):
        extra = facts.where((F.col("kind") == "call") & E.flow_function("callee", spec["function"])).select("function_id", "line", "column", F.lit(spec["kind"]).alias("sink_kind"), F.explode(F.get("arguments", F.lit(spec.get("argument", 0)))).alias("from"))
        sinks = sinks.unionByName(extra)
    reaches = related(F.col("value"), F.col("from")) & ~F.array_contains("clean", "*") & ~F.array_contains("clean", F.col("sink_kind"))
    if paths:
        hit = best.join(sinks, "function_id").where(reaches)
        found = hit.groupBy("source", "function_id", "line", "column", "sink_kind").agg(F.min_by(F.struct("low", "truncated", "path"), rank).alias("b"))
    else:
        seen = cut(seen.withColumn("id", F.monotonically_increasing_id()))
        steps = step(seen.withColumn("source", F.col("id")).withColumn("path", none)).select(F.col("source").alias("src"), *state).distinct()
        steps = cut(steps.join(seen.withColumnRenamed("id", "dst"), state).select("src", "dst"))
        attempted = attempted or steps.count()
        # A sink is a node for certain states and one for others; only where it has both, pairs meet again.
        hit = cut(seen.join(sinks, "function_id").where(reaches).select("id", F.struct("function_id", "line", "column", "sink_kind").alias("spot"), "low").distinct())
        ends = hit.groupBy("spot").agg(F.min("low").alias("a"), F.max("low").alias("b")).select("spot", (F.col("a") != F.col("b")).alias("both"), F.explode(F.array_distinct(F.array("a", "b"))).alias("low"))
        ends = cut(ends.withColumn("id", -1 - F.monotonically_increasing_id()))
        edges = steps.union(hit.join(ends.withColumnRenamed("id", "dst"), ["spot", "low"]).select("id", "dst"))
        begin = best.join(seen, state).select(F.col("source").alias("seed"), "id")
        met = pairs(edges, begin, ends)
        found = met.where("NOT both").select("seed", "spot", "low")
        if not ends.where("both").isEmpty():
            found = found.union(met.where("both").groupBy("seed", "spot").agg(F.min("low").alias("low")))
        found = found.select(F.col("seed").alias("source"), "spot.*", F.struct("low").alias("b"))
    out = found.select(
        F.col("source.function").alias("source_function"), F.col("source.kind").alias("source_kind"), F.col("source.line").alias("source_line"), F.col("function_id").alias("sink_function"), "sink_kind", "line",
        E.flow_severity("sink_kind", "source.kind").alias("severity"), F.when(F.col("b.low"), "low").otherwise("high").alias("confidence"), *([F.col("b.path").alias("path")] if paths else []),
    )
    return out, {"complete": done, "rounds": rounds, "attempted": attempted, "budget": limit, "facts": n_facts, "reason": None if done else "work budget spent" if attempted >= limit else "rounds spent"}


def work_share(traces: DataFrame, n: int = 10) -> DataFrame:
    """WIN-06: the functions with most traces."""
    return traces.groupBy("function_id").agg(F.count("*").alias("work")).orderBy(F.desc("work"), "function_id").limit(n)


def reach(sources: DataFrame, edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """Function-level taint: (source, sink) pairs where the sink's function is reachable from the source's."""
    start = sources.select(F.col("function").alias("seed"), F.col("function").alias("id")).where("id IS NOT NULL")
    return pairs(edges, start, sinks.select(F.col("function").alias("id"))).select(F.col("seed").alias("source"), F.col("id").alias("sink"))
