"""Workflows over several operators, rankings and pages (CMP, WIN, PAG families)."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.operators import aggs, census, joins, traverse
from stratagraph.operators.census import has
from stratagraph.plans.graph import CodeGraph

EXPLORE_LIMITS = {"compact": 5, "standard": 10, "deep": 25}


def context(g: CodeGraph, q: str, n: int = 20) -> DataFrame:
    """CMP-01: the symbol, its role, callers, callees and tests as one row for each match."""
    s = g.symbols.where(E.match_symbol(q)).select("id", "name", "kind", "file", "line", "signature")
    s = s.join(aggs.evidence(g, s).select("id", E.quick_role().alias("role")), "id", "left")
    c = joins.sites(g.calls)
    first = lambda df, key, item, name: df.groupBy(F.col(key).alias("id")).agg(F.slice(F.array_sort(F.collect_set(item)), 1, n).alias(name))
    ids = s.select("id")
    out = s
    for df, key, item, name in (
        (c, "callee_symbol_id", F.coalesce("caller_symbol_id", "caller_name"), "callers"),
        (c, "caller_symbol_id", F.coalesce("callee_symbol_id", "callee_raw"), "callees"),
        (g.test_edges, "target_symbol_id", F.col("test_func"), "tests"),
    ):
        mine = df.join(ids, df[key] == ids["id"], "left_semi")
        out = out.join(first(mine, key, item, name), "id", "left")
    return out


def explore_rank(rows: DataFrame, question: str, terms: list[str]) -> DataFrame:
    """WIN-05: result rows ranked for a question; what they scored before counts too."""
    q, terms = question.lower(), [t.lower() for t in terms]
    name, file, detail = F.lower("name"), F.lower(F.coalesce("file", F.lit(""))), F.lower(F.coalesce("detail", F.lit("")))
    # The weights of each kind of match.
    score = F.col("score") + F.when(name == q, 1000).otherwise(0) + F.when(F.col("kind").isin(*E.NOT_SYMBOLS), 0).otherwise(100)
    for t in terms:
        score += F.when(name == t, 100).when(F.contains(name, F.lit(t)), 30).otherwise(0) + F.when(F.contains(file, F.lit(t)), 10).otherwise(0) + F.when(F.contains(detail, F.lit(t)), 5).otherwise(0)
    return rows.withColumn("score", score.cast("int")).orderBy(F.desc("score"), "name", "kind", "file", "line")


def explore(g: CodeGraph, question: str, mode: str = "standard", limit: int | None = None) -> dict[str, DataFrame]:
    """CMP-02: ranked matches, and the neighbourhood of the best one in bounded sections."""
    n = min(100, limit or EXPLORE_LIMITS[mode])
    terms = E.explore_terms(question)
    matches = explore_rank(census.query(g, terms), question, terms).limit(n)
    best = matches.where(F.col("kind").isin("function", "method")).limit(1).select(F.lit("").alias("seed"), F.col("stable_id").alias("id"))
    up = traverse.exact_neighbours(g, best, True).orderBy("depth", "id").limit(n)
    down = traverse.exact_neighbours(g, best, False).orderBy("depth", "id").limit(n)
    return {"matches": matches, "selected": best, "callers": up, "callees": down, "impact": traverse.impact(g, best).orderBy("depth", "id").limit(n)}


def explain(g: CodeGraph, symbol_id: str) -> DataFrame:
    """CMP-03: one sentence from the evidence counts."""
    own = g.symbols.where(F.col("id") == symbol_id).select("id")
    c = aggs.explain_counts(g, symbol_id).join(aggs.evidence(g, own).select("id", E.role().alias("role"), "name"), "id", "left")
    return c.select("id", F.format_string("%s is a %s with %d callers and %d callees; %d tests name it directly; it runs %d SQL statements and reads %d environment keys.", F.coalesce("name", "id"), F.coalesce("role", F.lit("symbol")), "callers", "callees", "tests", "sqls", "envs").alias("narrative"))


def plan(g: CodeGraph, start: DataFrame) -> DataFrame:
    """CMP-04: before an edit, per seed: callers, blast radius, tests, routes in it, SQL and environment below, exported or not."""
    up = traverse.impact(g, start)
    down = traverse.downstream(g, start)
    count = lambda df, name: df.groupBy("seed").agg(F.countDistinct("id").alias(name))
    direct = joins.sites(g.calls).join(start, F.col("callee_symbol_id") == F.col("id")).groupBy("seed").agg(F.count("*").alias("callers"))
    routes = up.select("seed", "id").unionByName(start.select("seed", "id")).join(g.routes.select(F.col("handler").alias("id")), "id")
    sql = down.join(g.sqls.select(F.col("function").alias("id"), "query"), "id").groupBy("seed").agg(F.count("*").alias("sqls"))
    env = down.join(g.env_reads.select(F.col("function").alias("id"), "key"), "id").groupBy("seed").agg(F.countDistinct("key").alias("envs"))
    tests = count(traverse.tests_of(g, start), "tests")
    public = g.symbols.select("id", F.col("name").rlike("^[A-Z]").alias("public")).dropDuplicates(["id"])
    out = start.select("seed", "id").join(public, "id", "left")
    for part in (direct, count(up, "impact"), count(routes, "routes"), sql, env, tests):
        out = out.join(part, "seed", "left")
    return out.na.fill(0)


def review(g: CodeGraph, start: DataFrame) -> DataFrame:
    """CMP-05: the plan after an edit, with the errors of the edited functions."""
    e = g.errors.join(start, F.col("function") == F.col("id")).groupBy("seed").agg(F.count("*").alias("errors"))
    return plan(g, start).join(e, "seed", "left").na.fill(0, ["errors"])


def review_changes(old: CodeGraph, new: CodeGraph) -> DataFrame:
    """CMP-06: review of what differs; deleted declarations are listed, their callers are not evaluated."""
    from stratagraph.operators.diffs import changes

    c = changes(old.symbols, new.symbols)
    live = c.where("status <> 'deleted'").select(F.col("id").alias("seed"), "id")
    return c.join(review(new, live).drop("seed"), "id", "left").withColumn("evaluated", F.col("status") != "deleted")


def risk(g: CodeGraph, start: DataFrame, complexity: DataFrame | None = None) -> DataFrame:
    """CMP-07: a score up to 100 from transitive callers, complexity, tests, exposure, SQL and environment; unknown complexity is 0 points."""
    p = plan(g, start)
    p = p.join(complexity.select("id", "complexity"), "id", "left") if complexity is not None else p.withColumn("complexity", F.lit(-1))
    cx = F.greatest(F.lit(0), F.least(F.lit(25), 2 * (F.coalesce("complexity", F.lit(-1)) - 1)))
    # The points of each part and their bounds.
    score = F.least(F.lit(30), 3 * F.col("impact")) + cx + F.when(F.col("tests") == 0, 20).when(F.col("tests") == 1, 10).otherwise(0)
    score += F.when(F.col("public"), 10).otherwise(0) + F.when(F.col("sqls") > 0, 10).otherwise(0) + F.when(F.col("envs") > 0, 5).otherwise(0)
    return p.withColumn("risk", F.least(F.lit(100), score).cast("int")).withColumn("label", E.risk_label("risk"))


def select_tests(g: CodeGraph, changed: DataFrame) -> dict[str, DataFrame]:
    """CMP-08: for changed ids, the tests to run by package with their best evidence, and roots without any."""
    start = changed.select(F.col("id").alias("seed"), "id").distinct()
    found = traverse.tests_of(g, start)
    best = found.groupBy("id").agg(F.min(F.struct(F.when(F.col("resolution") == "exact", 0).otherwise(1).alias("r"), "depth", "seed")).alias("b"))
    where = g.symbols.select("id", "package_name", "name").dropDuplicates(["id"])
    tests = best.join(where, "id", "left").select(F.coalesce("package_name", F.lit("")).alias("package_name"), "id", F.when(F.col("b.r") == 0, "exact").otherwise("possible").alias("resolution"), F.col("b.depth").alias("depth"), F.col("b.seed").alias("root"))
    missed = start.join(found.select("seed").distinct(), "seed", "left_anti").join(g.symbols.select("id").distinct(), "id", "left").select("id", F.lit("no test reaches it").alias("reason"))
    return {"tests": tests, "by_package": tests.groupBy("package_name").agg(F.array_sort(F.collect_set("id")).alias("tests")), "unselected": missed}


# --- pages -------------------------------------------------------------------


def fingerprint(g: CodeGraph) -> str:
    """PAG-04: an order-free hash over the rows of every relation that was given."""
    parts = []
    for name in sorted(g.relations):
        df = getattr(g, name)
        plain = [F.to_json(F.struct(F.col(f.name))) if f.dataType.simpleString().startswith("map") else F.col(f.name) for f in df.schema.fields]
        r = df.select(F.xxhash64(*plain).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("s")).first()
        parts.append(f"{name}:{r['n']}:{r['s']}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def cursor(*bound: str, offset: int) -> str:
    """A cursor that is only good for what it was made for."""
    seal = hashlib.sha256("\0".join(bound).encode()).hexdigest()
    return base64.urlsafe_b64encode(json.dumps({"offset": offset, "seal": seal}).encode()).decode()


def open_cursor(text: str, *bound: str) -> int:
    try:
        got = json.loads(base64.urlsafe_b64decode(text.encode()))
        offset, seal = int(got["offset"]), got["seal"]
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("malformed cursor") from e
    if seal != hashlib.sha256("\0".join(bound).encode()).hexdigest() or offset < 0:
        raise ValueError("this cursor belongs to another query or snapshot")
    return offset


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 100, max_bytes: int = 16 * 1024) -> DataFrame:
    """PAG-01, PAG-02: rows after ``offset`` up to ``limit`` (1 to 200) and a byte budget; one row always fits.

    Only the first offset + limit rows are ordered in one place (a bounded top-k).
    """
    limit = max(1, min(200, limit))
    top = df.orderBy(*order).limit(offset + limit)
    w = Window.orderBy(*order)
    rows = top.withColumn("_n", F.row_number().over(w)).where(F.col("_n") > offset)
    size = F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_b", size).where((F.col("_b") <= max_bytes) | (F.col("_n") == offset + 1)).drop("_n", "_b")


def tests_page(tests: DataFrame, offset: int = 0, limit: int = 50, max_depth: int | None = None) -> dict[str, DataFrame]:
    """PAG-03: a summary by depth and label, and one page."""
    t = tests if max_depth is None else tests.where(F.col("depth") <= max_depth)
    return {"summary": t.groupBy("depth", "resolution").agg(F.count("*").alias("n")).orderBy("depth", "resolution"), "page": page(t, ["depth", "resolution", "id"], offset, limit, 1 << 20)}


def best_state(df: DataFrame, key: list[str]) -> DataFrame:
    """WIN-02: per key exact before possible, then less depth."""
    w = Window.partitionBy(*key).orderBy(F.when(F.col("resolution") == "exact", 0).otherwise(1), "depth")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """WIN-04."""
    return df.orderBy(*order).limit(k)


def any_term(columns: list[str], terms: list[str]):
    return reduce(lambda a, b: a | b, [has(c, t) for c in columns for t in terms])
