"""Registered queries over the star-schema code graph, each with the same result in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.operators import aggs, census, compose, diffs, flow, incremental, joins, policy, traverse, workspace
from stratagraph.plans import fixpoint
from stratagraph.plans.graph import CodeGraph
from stratagraph.sources.star import oracle, star_graph, table, view
from stratagraph.streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Callable[[CodeGraph], DataFrame]], Callable]:
    """A query over the graph, under ``name``."""

    def keep(f: Callable[[CodeGraph], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(star_graph(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return f

    return keep


def register_views(name: str, sql: str | None = None) -> Callable:
    """A query over views or tables: f(get) where get(name) is a DataFrame."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: view(spark, sf_dir, t) if t.startswith("cg_") else table(spark, sf_dir, t))
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return f

    return keep


def baseline(g: CodeGraph, get: Callable[[str], DataFrame]) -> CodeGraph:
    return g.replace(symbols=get("cg_symbols_baseline").selectExpr("*", "sha2(concat(signature, CAST(arity AS STRING)), 256) AS declaration_digest"))


def thin(g: CodeGraph) -> CodeGraph:
    """The graph with the thin call relation, for traversals."""
    return g.replace(calls=g.calls.where("line = 1 AND return_usage = 'discarded'"))


SEEDS = ("1", "7", "42")
S = "(VALUES ('1'), ('7'), ('42'))"


def seeds(g: CodeGraph) -> DataFrame:
    return g.spark.createDataFrame([(s, s) for s in SEEDS], "seed string, id string")


# --- filters and census ------------------------------------------------------


@register("fil01_match_symbol", "SELECT id, name FROM cg_symbols WHERE lower(name) = 'small ring' OR id = 'small ring'")
def _(g):
    return g.symbols.where(E.match_symbol("Small Ring")).select("id", "name")


@register("fil01_match_symbol_receiver", "SELECT id, receiver FROM cg_symbols WHERE receiver = 'Brand#2' AND name = 'small ring'")
def _(g):
    return g.symbols.where(E.match_symbol("Brand#2.small ring")).select("id", "receiver")


@register("fil02_match_exact", "SELECT id FROM cg_symbols WHERE id = '77' OR lower(name) = '77'")
def _(g):
    return g.symbols.where(E.match_symbol_exact("77")).select("id")


@register("fil07_test_paths", "SELECT id, file FROM cg_symbols WHERE file LIKE '%_test.go'")
def _(g):
    return g.symbols.where(E.is_test_path("file")).select("id", "file")


@register("fil08_without_tests", "SELECT id FROM cg_symbols WHERE NOT is_test")
def _(g):
    return census.no_tests(g.symbols).select("id")


@register("fil10_match_package", "SELECT id FROM cg_symbols WHERE regexp_matches(package_name, '^pkg1')")
def _(g):
    return g.symbols.where(E.match_package(F.concat(F.lit("p/"), F.substring("package_name", 1, 4)), "p/pkg1/**") | E.match_package(F.substring("package_name", 1, 4), "pkg1")).select("id")


@register("fil12_route_contains", "SELECT path FROM cg_routes WHERE contains(lower(path), '/en/')")
def _(g):
    return g.routes.where(E.route_contains("path", "/EN/")).select("path")


@register("fil14_type_boundary", "SELECT id FROM cg_symbols WHERE regexp_matches(signature, '(^|[^A-Za-z0-9_])economy($|[^A-Za-z0-9_])')")
def _(g):
    return g.symbols.where(E.contains_type("signature", "economy")).select("id")


@register("fil21_unique_raw", "SELECT lower(name) AS raw, min(id) AS id FROM cg_symbols GROUP BY lower(name) HAVING count(*) = 1")
def _(g):
    return g.symbols.groupBy(F.lower("name").alias("raw")).agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1").select("raw", "id")


@register("prj01_query", """
SELECT kind, name, id AS stable_id, file, line, CASE WHEN lower(name) = 'small ring' THEN 100 ELSE 40 END AS score FROM cg_symbols WHERE contains(lower(name), 'small') OR contains(id, 'small') OR contains(lower(name), 'small ring')""")
def _(g):
    return census.query(g.replace(symbols=g.symbols.withColumn("struct_fields", F.lit(None).cast(g.symbols.schema["struct_fields"].dataType)).withColumn("receiver", F.lit(""))), ["small", "small ring"]).where("kind IN ('function', 'method', 'struct', 'interface')").select("kind", "name", "stable_id", "file", "line", "score")


@register("prj02_node", "SELECT id, name FROM cg_symbols WHERE contains(lower(name), 'ring')")
def _(g):
    return census.node(g.replace(symbols=g.symbols.withColumn("receiver", F.lit(""))), "ring").where("kind <> 'package'").select(F.col("stable_id").alias("id"), "name")


@register("prj04_fields", "SELECT id, part_type AS name, brand AS type FROM cg_symbols WHERE kind = 'struct' AND id = '8'")
def _(g):
    return census.fields(g, "8").select("id", "name", "type")


@register("prj05_embeds", "SELECT id FROM cg_symbols WHERE kind = 'struct' AND brand = 'Brand#3'")
def _(g):
    return census.embeds(g, "Brand#3").select("id")


@register("prj07_imports", "SELECT from_package, to_package AS import_path FROM cg_imports WHERE contains(to_package, 'pkg1')")
def _(g):
    return census.external_imports(g, "PKG1").select("from_package", "import_path")


@register("prj08_routes", "SELECT concat_ws(' ', method, path) AS name, authority AS file FROM cg_routes")
def _(g):
    return census.routes(g).select("name", "file")


@register("prj09_query_routes", "SELECT method, path, authority AS file FROM cg_routes WHERE contains(lower(path), '/de/')")
def _(g):
    return census.query_routes(g, "/de/").select("method", "path", "file").where(F.contains("path", F.lit("/de/")))


@register("prj10_query_sql", "SELECT query, function, line FROM cg_sqls WHERE verb = 'INSERT' AND table_name IN ('t1', 't2', 't3')")
def _(g):
    return census.query_sql(g, verbs=["insert"], tables=["T1", "t2", "t3"]).select("query", "function", "line")


@register("prj11_errors", "SELECT message, function, line FROM cg_errors WHERE contains(message, 'k=7')")
def _(g):
    return census.errors(g, "K=7").select("message", "function", "line")


@register("prj12_envs", "SELECT env_key AS key, function, line FROM cg_env_reads WHERE contains(env_key, 'KEY_4')")
def _(g):
    return census.envs(g, "key_4").select("key", "function", "line")


@register("prj16_fixtures", "SELECT id FROM cg_symbols WHERE is_test")
def _(g):
    return census.fixtures(g).select("id")


@register("prj17_schema", "SELECT id, part_type AS field FROM cg_symbols WHERE kind = 'struct' AND lower(brand) = 'brand#4'")
def _(g):
    return census.schema(g, "Brand#4").select("id", "field")


@register("prj18_constructors", "SELECT id FROM cg_symbols WHERE kind IN ('function', 'method') AND (part_type = 'ECONOMY' OR package_name = 'pkg3' AND brand = 'ECONOMY')")
def _(g):
    returning = F.concat(F.lit("func "), "name", F.lit("(x ECONOMY) *"), "part_type", F.lit(", error"))
    return census.constructors(g.replace(symbols=g.symbols.withColumn("signature", returning)), "ECONOMY").select("id")


@register("prj20_mutate", "SELECT function, file, line, concat_ws('.', type_name, field) AS detail FROM cg_mutations WHERE field = 'Brand#5' AND type_name = 'ECONOMY'")
def _(g):
    return census.mutate(g, "brand#5", "economy").where("kind = 'mutation'").select(F.col("name").alias("function"), "file", "line", "detail")


@register("prj21_returnusage", "SELECT DISTINCT caller AS caller_name, callee AS callee_raw, file, line, coalesce(nullif(return_usage, ''), 'passed') AS usage FROM cg_calls WHERE callee IN ('11') QUALIFY row_number() OVER (PARTITION BY caller, file, line, callee ORDER BY return_usage) = 1")
def _(g):
    return census.return_usages(g, "11").select("caller_name", "callee_raw", "file", "line", "usage")


@register("prj22_usages", "SELECT id, 'result' AS how FROM cg_symbols WHERE kind IN ('function', 'method') AND part_type = 'PROMO'")
def _(g):
    return census.usages(g, "promo").where("kind = 'signature'").select(F.col("stable_id").alias("id"), F.lit("result").alias("how"))


@register("prj24_arity", "SELECT id, arity FROM cg_symbols WHERE kind IN ('function', 'method') AND arity >= 7")
def _(g):
    return census.arity(g, 7).select("id", "arity")


@register("prj27_skeleton", "SELECT package_name, count(*)::INT AS declarations FROM cg_symbols GROUP BY package_name")
def _(g):
    return census.skeleton(g).select("package_name", "declarations")


@register("prj29_identity", "SELECT 'exact' AS status, '77' AS id, CAST(1 AS BIGINT) AS n")
def _(g):
    return census.identity(g, "77")


@register("prj30_stats", "SELECT 'calls' AS relation, count(*) AS n_rows FROM cg_calls UNION ALL SELECT 'symbols', count(*) FROM cg_symbols UNION ALL SELECT 'imports', count(*) FROM cg_imports")
def _(g):
    return census.stats(g, ["calls", "symbols", "imports"])


# --- joins -------------------------------------------------------------------


@register("jon01_callers", "SELECT DISTINCT caller, file, line FROM cg_calls WHERE callee = '42'")
def _(g):
    return joins.callers(g, "42", fuzzy=False).select("caller", "file", "line")


@register("jon02_callees", "SELECT DISTINCT callee AS callee_symbol_id, file, line FROM cg_calls WHERE caller = '42'")
def _(g):
    return joins.callees(g, "42").select("callee_symbol_id", "file", "line")


@register_views("jon03_implementers_division", """
SELECT m.iface, t.type_id FROM cg_iface_methods m JOIN cg_type_methods t ON m.method = t.method GROUP BY m.iface, t.type_id
HAVING count(*) = (SELECT count(*) FROM cg_iface_methods x WHERE x.iface = m.iface)""")
def _(get):
    return joins.divide(get("cg_iface_methods"), get("cg_type_methods"), "iface", "type_id", ["method"])


@register_views("jon06_longest_prefix", "SELECT file, package_name AS owner FROM (SELECT DISTINCT file, package_name FROM cg_symbols) q")
def _(get):
    s = get("cg_symbols").select("file").distinct()
    owners = get("cg_packages").select(F.col("id").alias("dir"), F.col("id").alias("owner")).unionByName(get("cg_packages").select(F.lit("").alias("dir"), F.lit("root").alias("owner")).distinct())
    return joins.longest_prefix(s, owners, "file", "dir").select("file", "owner")


@register_views("jon11_enclosing", """
WITH p AS (SELECT event_id, CAST(event_id % 20000 AS INT) AS line FROM events WHERE event_type = 'click')
SELECT p.event_id, s.id AS owner FROM p LEFT JOIN cg_symbols s ON p.line BETWEEN s.line AND s.end_line AND s.kind IN ('function', 'method')""")
def _(get):
    points = get("events").where("event_type = 'click'").selectExpr("event_id", "CAST(event_id % 20000 AS INT) AS line", "'all' AS file")
    s = get("cg_symbols").where("kind IN ('function', 'method')").withColumn("file", F.lit("all"))
    return joins.enclosing(points, s).select("event_id", "owner")


@register("jon12_boundaries", "SELECT from_package, to_package AS import_path FROM cg_imports WHERE from_package IN ('pkg1', 'pkg2', 'pkg3') AND to_package NOT IN ('pkg1', 'pkg2', 'pkg3', 'pkg4', 'pkg5')")
def _(g):
    layers = [{"name": "api", "packages": ["x.y/pkg1", "x.y/pkg2", "x.y/pkg3"], "may_import": ["core"]}, {"name": "core", "packages": ["x.y/pkg4", "x.y/pkg5"], "may_import": []}]
    named = g.imports.select(F.concat(F.lit("x.y/"), "from_package").alias("from_package"), F.concat(F.lit("x.y/"), "import_path").alias("import_path"))
    out = joins.boundary_violations(named, layers).where("layer = 'api'")
    return out.select(F.substring("from_package", 5, 99).alias("from_package"), F.substring("import_path", 5, 99).alias("import_path"))


@register("jon13_dependents", "SELECT DISTINCT from_package FROM cg_imports WHERE to_package = 'pkg3'")
def _(g):
    return joins.dependents(g, "pkg3")


@register_views("jon16_http_contracts", """
WITH c AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, authority, path FROM cg_routes),
n AS (SELECT authority, method, lower(path) AS p, count(*) AS n FROM c GROUP BY ALL)
SELECT c.page_id AS function_name, c.authority, r.page_id AS handler, CASE WHEN n.n > 1 THEN 'ambiguous' ELSE 'exact' END AS resolution_status FROM c JOIN c r ON c.authority = r.authority AND lower(c.path) = lower(r.path) AND c.method = r.method
JOIN n ON n.authority = c.authority AND n.method = c.method AND n.p = lower(c.path) WHERE c.path <> ''""")
def _(get):
    r = get("cg_routes")
    calls = r.where("path <> ''").select(F.lit("client").alias("repository_id"), F.col("page_id").alias("function_name"), "method", "authority", "path", F.lit(None).cast("string").alias("reason"))
    services = r.select("authority", F.col("authority").alias("repository_id")).distinct()
    routes = r.select(F.col("authority").alias("repository_id"), "method", "path", F.col("page_id").alias("handler"))
    return workspace.http_contracts(calls, services, routes).where("handler IS NOT NULL").select("function_name", "authority", "handler", "resolution_status")


# --- aggregates --------------------------------------------------------------


@register("agg01_sites", "SELECT DISTINCT caller, file, line, callee AS callee_raw FROM cg_calls")
def _(g):
    return joins.sites(g.calls).select("caller", "file", "line", "callee_raw")


@register("agg02_site_targets", "SELECT caller, count(*) AS n FROM (SELECT DISTINCT caller, callee, file, line FROM cg_calls) q GROUP BY caller")
def _(g):
    return joins.site_targets(g.calls).groupBy("caller").agg(F.count("*").alias("n"))


@register("agg03_fan_in", "SELECT callee AS target, count(*) AS n FROM (SELECT DISTINCT caller, callee, file, line FROM cg_calls) q GROUP BY callee")
def _(g):
    return aggs.fan_in(g)


HOTSPOT = """
SELECT s.id, s.name, s.kind, count(*) AS incoming_calls FROM (SELECT DISTINCT caller, callee, file, line FROM cg_calls) c JOIN cg_symbols s ON s.id = c.callee
WHERE s.kind IN ('function', 'method') AND NOT s.is_test GROUP BY s.id, s.name, s.kind, s.file, s.line ORDER BY incoming_calls DESC, lower(s.name), s.file, s.line, s.id LIMIT 20"""


@register("agg04_hotspot", HOTSPOT)
def hotspot(g):
    return aggs.hotspot(g, 20).select("id", "name", "kind", "incoming_calls")


@register("agg05_coupling", """
WITH e AS (SELECT DISTINCT from_package AS f, to_package AS t FROM cg_imports), fo AS (SELECT f AS p, count(*) AS fan_out FROM e GROUP BY f), fi AS (SELECT t AS p, count(*) AS fan_in FROM e GROUP BY t)
SELECT coalesce(fo.p, fi.p) AS package, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS fan_in, CAST(coalesce(fan_out, 0) AS DOUBLE) / (coalesce(fan_out, 0) + coalesce(fan_in, 0)) AS instability FROM fo FULL OUTER JOIN fi ON fo.p = fi.p""")
def _(g):
    return aggs.coupling(g).select("package", "fan_out", "fan_in", "instability")


@register("agg06_godobj", """
WITH m AS (SELECT receiver AS type, count(*) AS methods FROM cg_symbols WHERE kind = 'method' GROUP BY receiver),
o AS (SELECT s.receiver AS type, count(*) AS calls FROM (SELECT DISTINCT caller, file, line, callee FROM cg_calls) c JOIN cg_symbols s ON s.id = c.caller AND s.kind = 'method' GROUP BY s.receiver)
SELECT m.type, m.methods, coalesce(o.calls, 0) AS calls, greatest(m.methods - 5, 0) + floor(greatest(coalesce(o.calls, 0) - 15, 0) / 2)::BIGINT AS score FROM m LEFT JOIN o ON o.type = m.type
WHERE m.methods > 5 OR o.calls > 15 ORDER BY score DESC, m.type LIMIT 10""")
def _(g):
    return aggs.god_objects(g, 10).select("type", "methods", "calls", F.col("score").cast("long").alias("score"))


@register("agg08_orphans_by_name", "SELECT id FROM cg_symbols s WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM cg_calls c WHERE c.callee = s.id)")
def _(g):
    return aggs.orphans_by_name(g.replace(symbols=g.symbols.withColumn("name", F.col("id")))).select("id")


@register("agg09_untested", """
WITH RECURSIVE t(id) AS (SELECT DISTINCT target FROM cg_test_edges WHERE resolution = 'resolved_static' UNION SELECT c.callee FROM t JOIN cg_calls c ON c.caller = t.id AND c.resolution = 'resolved_static'),
cnt AS (SELECT callee AS id, count(*) AS callers FROM (SELECT DISTINCT caller, callee, file, line FROM cg_calls) d GROUP BY callee)
SELECT s.id, s.name, cnt.callers FROM cg_symbols s JOIN cnt ON cnt.id = s.id LEFT JOIN t ON t.id = s.id WHERE t.id IS NULL AND s.kind IN ('function', 'method') AND NOT s.is_test""")
def _(g):
    prefixed = g.test_edges.withColumn("test_func", F.concat(F.lit("test:"), "test_func"))
    return aggs.untested(g.replace(test_edges=prefixed)).select("id", "name", "callers")


@register("agg10_interface_methods")
def _(g):
    s = g.symbols.withColumn("interface_methods", F.when(F.col("kind") == "interface", F.create_map("name", "signature")).cast("map<string,string>"))
    return aggs.interface_method_ids(g.replace(symbols=s))


@register_views("agg11_statements", """
WITH b AS (SELECT CAST(l_orderkey % 20000 AS INT) AS start_line, l_linenumber AS statements, CAST(l_quantity AS INT) % 3 AS cnt FROM lineitem)
SELECT s.id, sum(b.statements)::BIGINT AS total, sum(CASE WHEN cnt > 0 THEN b.statements ELSE 0 END)::BIGINT AS statements FROM cg_symbols s JOIN b ON b.start_line BETWEEN s.line AND s.end_line GROUP BY s.id""")
def _(get):
    blocks = get("lineitem").selectExpr("'all' AS file", "CAST(l_orderkey % 20000 AS INT) AS start_line", "l_linenumber AS statements", "CAST(l_quantity AS INT) % 3 AS count")
    return aggs.statements_in_range(get("cg_symbols").withColumn("file", F.lit("all")), blocks)


@register_views("agg12_uncovered_lines", """
WITH b AS (SELECT l_linenumber AS f, CAST(l_partkey AS INT) AS a, CAST(l_partkey + l_quantity AS INT) AS z, CAST(l_suppkey % 2 AS INT) AS cnt FROM lineitem),
x AS (SELECT f, unnest(range(a, z + 1)) AS line, cnt FROM b), p AS (SELECT f, line, max(cnt) AS ran FROM x GROUP BY f, line),
l AS (SELECT DISTINCT l_linenumber AS f, l_partkey AS line FROM lineitem WHERE l_returnflag = 'R')
SELECT CAST(l.f AS VARCHAR) AS file, CAST(l.line AS INT) AS line FROM l JOIN p ON p.f = l.f AND p.line = l.line WHERE p.ran = 0""")
def _(get):
    li = get("lineitem")
    blocks = li.selectExpr("CAST(l_linenumber AS STRING) AS file", "CAST(l_partkey AS INT) AS start_line", "CAST(l_partkey + l_quantity AS INT) AS end_line", "1 AS statements", "CAST(l_suppkey % 2 AS INT) AS count")
    return aggs.uncovered_lines(li.where("l_returnflag = 'R'").selectExpr("CAST(l_linenumber AS STRING) AS file", "CAST(l_partkey AS INT) AS line"), blocks)


@register("agg14_summary", """
WITH h AS (SELECT s.name, count(*) AS n, s.id, s.file, s.line FROM (SELECT DISTINCT caller, callee, file, line FROM cg_calls) c JOIN cg_symbols s ON s.id = c.callee WHERE s.kind IN ('function', 'method') AND NOT s.is_test GROUP BY s.id, s.name, s.file, s.line ORDER BY n DESC, lower(s.name), s.file, s.line, s.id LIMIT 3)
SELECT 'hotspot' AS metric, name, CAST(n AS DOUBLE) AS value FROM h""")
def _(g):
    return aggs.summary(g).where("metric = 'hotspot'")


@register("agg15_metric_snapshot", "SELECT (SELECT count(*) FROM cg_symbols) AS symbols, (SELECT count(*) FROM (SELECT DISTINCT from_package, to_package FROM cg_imports) q) AS coupling_edges")
def _(g):
    return aggs.metric_snapshot(g, "now").select("symbols", "coupling_edges")


@register_views("agg17_session_audit", """
SELECT user_id, session_no::BIGINT AS session_no, count(*) AS total_commands, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END)::BIGINT AS success_count,
round(max(CASE WHEN command = 'plan' THEN 35.0 ELSE 0 END) + max(CASE WHEN command = 'review' THEN 35.0 ELSE 0 END) + 0.3 * coalesce(CAST(sum(CASE WHEN command IN ('plan', 'review', 'context') THEN 1 ELSE 0 END) AS DOUBLE) / nullif(sum(CASE WHEN command IN ('plan', 'review', 'context', 'callers', 'source') THEN 1 ELSE 0 END), 0) * 100, 100.0), 6)::DOUBLE AS score
FROM cg_session_log GROUP BY user_id, session_no""")
def _(get):
    return aggs.audit(get("cg_session_log"), ["user_id", "session_no"]).select("user_id", F.col("session_no").cast("long").alias("session_no"), "total_commands", "success_count", F.round("score", 6).alias("score"))


@register("agg19_file_density", "SELECT package_name, count(*) AS n_symbols FROM cg_symbols GROUP BY package_name")
def _(g):
    return aggs.file_density(g)


@register("agg20_explain", """
SELECT '42' AS id, (SELECT count(*) FROM (SELECT DISTINCT caller, file, line FROM cg_calls WHERE callee = '42') q) AS callers, (SELECT count(*) FROM (SELECT DISTINCT callee, file, line FROM cg_calls WHERE caller = '42') q) AS callees,
(SELECT count(DISTINCT test_id) FROM cg_test_edges WHERE target = '42') AS tests, (SELECT count(*) FROM cg_sqls WHERE function = '42') AS sqls, (SELECT count(*) FROM cg_env_reads WHERE function = '42') AS envs""")
def _(g):
    return aggs.explain_counts(g, "42").select("id", "callers", "callees", "tests", "sqls", "envs")


@register_views("win03_line_ranges", """
SELECT file, min(line) AS range_start, max(line) AS range_end, count(*) AS n FROM (SELECT file, line, line - row_number() OVER (PARTITION BY file ORDER BY line) AS island FROM (SELECT DISTINCT file, line FROM cg_calls) d) q GROUP BY file, island""")
def _(get):
    return aggs.merge_ranges(get("cg_calls"))


@register("win02_best_state", "SELECT callee AS id, CASE WHEN bool_or(resolution = 'resolved_static') THEN 'exact' ELSE 'possible' END AS resolution FROM cg_calls GROUP BY callee")
def _(g):
    return compose.best_state(g.calls.select(F.col("callee_symbol_id").alias("id"), E.certainty().alias("resolution"), F.col("line").alias("depth")), ["id"]).select("id", "resolution")


@register("pag01_page", "SELECT id, name FROM cg_symbols ORDER BY id LIMIT 50 OFFSET 50")
def _(g):
    return compose.page(g.symbols.select("id", "name"), ["id"], 50, 50, 1 << 20)


# --- traversals --------------------------------------------------------------

UP = "SELECT DISTINCT caller AS dst, callee AS src, resolution FROM cg_calls_thin"


@register("trv01_callers_depth", f"""
WITH RECURSIVE r(seed, id, depth) AS (SELECT s, s, 0 FROM {S} v(s) UNION SELECT r.seed, c.caller, r.depth + 1 FROM r JOIN cg_calls_thin c ON c.callee = r.id WHERE r.depth < 3)
SELECT seed, id, min(depth) AS depth FROM r GROUP BY seed, id HAVING min(depth) > 0""")
def _(g):
    return traverse.callers_depth(thin(g), seeds(g), 3)


@register("trv02_callees_depth", f"""
WITH RECURSIVE r(seed, id, depth) AS (SELECT s, s, 0 FROM {S} v(s) UNION SELECT r.seed, c.callee, r.depth + 1 FROM r JOIN cg_calls_thin c ON c.caller = r.id WHERE r.depth < 2)
SELECT r.seed, c.caller, c.file, c.callee AS callee_raw, min(r.depth) + 1 AS depth FROM r JOIN (SELECT DISTINCT caller, callee, file FROM cg_calls WHERE line = 1 AND return_usage = 'discarded') c ON c.caller = r.id GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY r.seed, c.caller, c.file, c.callee"))
def _(g):
    return traverse.callees_depth(thin(g), seeds(g), 3).select("seed", "caller", "file", "callee_raw", "depth")


@register("trv05_impact", f"""
WITH RECURSIVE ex(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT ex.seed, c.caller FROM ex JOIN cg_calls_thin c ON c.callee = ex.id AND c.resolution = 'resolved_static'),
al(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT al.seed, c.caller FROM al JOIN cg_calls_thin c ON c.callee = al.id)
SELECT al.seed, al.id, CASE WHEN ex.id IS NOT NULL THEN 'exact' ELSE 'possible' END AS resolution FROM al LEFT JOIN ex ON ex.id = al.id AND ex.seed = al.seed WHERE al.id <> al.seed""")
def _(g):
    return traverse.impact(thin(g), seeds(g)).select("seed", "id", "resolution")


@register("trv06_path_length", """
WITH RECURSIVE r(id, depth) AS (SELECT '1', 0 UNION SELECT c.callee, r.depth + 1 FROM r JOIN cg_calls_thin c ON c.caller = r.id AND c.resolution = 'resolved_static' WHERE r.depth < 20)
SELECT id, min(depth) AS length FROM r GROUP BY id""")
def _(g):
    e = traverse.call_edges(thin(g)).where("exact")
    start = g.spark.createDataFrame([("1", "1")], "seed string, id string")
    return fixpoint.best_paths(e, start, [F.lit(0), F.lit(1)], 20).select("id", F.col("rank.r1").alias("length"))


@register("trv07_reachable_orphans", """
WITH RECURSIVE r(id) AS (SELECT id FROM cg_symbols WHERE kind IN ('function', 'method') AND (is_test OR exported) UNION SELECT c.callee FROM r JOIN cg_calls c ON c.caller = r.id)
SELECT s.id, s.name FROM cg_symbols s LEFT JOIN r ON r.id = s.id WHERE r.id IS NULL AND s.kind IN ('function', 'method') AND NOT s.is_test""")
def _(g):
    roots = g.symbols.where("kind IN ('function', 'method') AND (is_test OR exported)").select("id")
    bare = CodeGraph(g.spark, {"symbols": g.symbols, "calls": g.calls})
    return aggs.unreached(bare, roots).select("id", "name")


@register("trv08_deps", """
WITH RECURSIVE r(id, depth) AS (SELECT 'pkg1', 0 UNION SELECT i.to_package, r.depth + 1 FROM r JOIN cg_imports i ON i.from_package = r.id WHERE r.depth < 12) SELECT id AS package, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0""")
def _(g):
    return traverse.deps(g, "pkg1")


@register("trv10_test_reach", """
WITH RECURSIVE e AS (SELECT DISTINCT caller AS a, callee AS b, resolution FROM cg_calls_thin UNION ALL SELECT DISTINCT concat('t', test_id), target, resolution FROM cg_test_edges),
al(t, id) AS (SELECT DISTINCT concat('t', test_id), concat('t', test_id) FROM cg_test_edges UNION SELECT al.t, e.b FROM al JOIN e ON e.a = al.id),
ex(t, id) AS (SELECT DISTINCT concat('t', test_id), concat('t', test_id) FROM cg_test_edges UNION SELECT ex.t, e.b FROM ex JOIN e ON e.a = ex.id AND e.resolution = 'resolved_static')
SELECT al.id, count(ex.id) AS exact_tests, count(*) AS tests FROM al LEFT JOIN ex ON ex.t = al.t AND ex.id = al.id WHERE al.id <> al.t GROUP BY al.id""")
def _(g):
    t = thin(g)
    t = CodeGraph(g.spark, {"calls": t.calls, "test_edges": g.test_edges.withColumn("test_func", F.concat(F.lit("t"), "test_func"))})
    return traverse.test_reach(t, t.test_edges.select(F.col("test_func").alias("id")).distinct()).select("id", "exact_tests", "tests")


@register("trv11_tests_of", f"""
WITH RECURSIVE e AS (SELECT DISTINCT caller AS a, callee AS b FROM cg_calls_thin UNION ALL SELECT DISTINCT concat('t', test_id), target FROM cg_test_edges),
r(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT r.seed, e.a FROM r JOIN e ON e.b = r.id) SELECT seed, id FROM r WHERE starts_with(id, 't')""")
def _(g):
    t = thin(g)
    t = CodeGraph(g.spark, {"calls": t.calls, "test_edges": g.test_edges.withColumn("test_func", F.concat(F.lit("t"), "test_func"))})
    return traverse.tests_of(t, seeds(g)).select("seed", "id")


@register("trv12_attribution_edges", "SELECT DISTINCT caller AS src, callee AS dst, resolution = 'resolved_static' AS exact FROM cg_calls UNION SELECT DISTINCT test_id, target, resolution = 'resolved_static' FROM cg_test_edges")
def _(g):
    return aggs.attribution_edges(g)


@register("trv16_downstream", f"""
WITH RECURSIVE r(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT r.seed, c.callee FROM r JOIN cg_calls_thin c ON c.caller = r.id) SELECT seed, id FROM r""")
def _(g):
    return traverse.downstream(thin(g), seeds(g)).select("seed", "id")


@register("trv17_endpoint", """
WITH RECURSIVE h AS (SELECT DISTINCT handler FROM cg_routes WHERE contains(lower(path), '/fr/')),
r(seed, id, depth) AS (SELECT handler, handler, 0 FROM h UNION SELECT r.seed, c.callee, r.depth + 1 FROM r JOIN cg_calls_thin c ON c.caller = r.id WHERE r.depth < 3)
SELECT seed AS handler, id AS name, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY seed, id""")
def _(g):
    return traverse.endpoint(thin(g), "/fr/", 3).where("part = 'call'").select("handler", "name", "depth")


@register("trv18_match_route", "SELECT method, path, 5 AS tier FROM cg_routes WHERE contains(lower(path), '/es/')")
def _(g):
    return traverse.match_route(g, "/es/").select("method", "path", "tier")


@register("trv22_diagram", "SELECT from_package AS src, to_package AS dst, count(*) AS n FROM cg_imports GROUP BY 1, 2")
def _(g):
    return traverse.diagram(g.imports.select(F.col("from_package").alias("src"), F.col("import_path").alias("dst")), 30).select("src", "dst", "n")


# --- diffs, policies, composites ---------------------------------------------


@register_views("set04_changes", """
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM cg_symbols a FULL OUTER JOIN cg_symbols_baseline b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.arity <> b.arity""")
def _(get):
    d = lambda df: df.withColumn("declaration_digest", F.sha2(F.concat("signature", F.col("arity").cast("string")), 256))
    return diffs.changes(d(get("cg_symbols_baseline")), d(get("cg_symbols")))


@register_views("set07_dedupe_calls", "SELECT count(*) AS n FROM (SELECT DISTINCT * FROM cg_calls) q")
def _(get):
    return diffs.dedupe_calls(get("cg_calls")).agg(F.count("*").alias("n"))


@register_views("set08_filter_potential", "SELECT id FROM cg_calls_thin c JOIN cg_symbols s ON s.id = c.callee WHERE s.kind IN ('function', 'method')")
def _(get):
    c = get("cg_calls_thin").withColumn("potential", F.lit(True)).withColumn("callee_raw", F.col("callee"))
    return diffs.filter_potential(c, get("cg_symbols").withColumn("name", F.col("id"))).select(F.col("callee").alias("id"))


@register_views("set09_dedupe_edges", "SELECT caller, callee, min(CASE WHEN resolution = 'resolved_static' THEN 0 ELSE 1 END) = 1 AS heuristic FROM cg_calls GROUP BY caller, callee")
def _(get):
    e = get("cg_calls").select("caller", "callee", (F.col("resolution") != "resolved_static").alias("heuristic"))
    return diffs.dedupe_edges(e, ["caller", "callee"])


@register("pol01_check", """
SELECT 'max_arity' AS rule, 'warn' AS level, CASE WHEN receiver <> '' THEN '(' || receiver || ').' || name ELSE name END AS name, file, '2' AS detail FROM cg_symbols WHERE kind IN ('function', 'method')
UNION ALL SELECT 'test_coverage', 'error', upper(name), file, 'exported symbol has no mapped tests' FROM cg_symbols s WHERE kind IN ('function', 'method') AND NOT is_test AND NOT EXISTS (SELECT 1 FROM cg_test_edges t WHERE t.target = s.id)
UNION ALL SELECT 'boundaries', 'error', 'x.y/' || from_package, from_file, 'x.y/' || to_package FROM cg_imports WHERE from_package = 'pkg1' AND to_package <> 'pkg2' OR from_package = 'pkg2'""")
def _(g):
    named = g.imports.withColumn("from_package", F.concat(F.lit("x.y/"), "from_package")).withColumn("import_path", F.concat(F.lit("x.y/"), "import_path"))
    layers = [{"name": "api", "packages": ["x.y/pkg1"], "may_import": ["core"]}, {"name": "core", "packages": ["x.y/pkg2"], "may_import": []}]
    arity = policy.check(g, {"max_arity": {"level": "warn", "value": 1}})
    upper = g.replace(symbols=g.symbols.withColumn("name", F.upper("name")).withColumn("receiver", F.lit("")), imports=named)
    return arity.unionByName(policy.check(upper, {"test_coverage": "error", "boundaries": "error", "api_drift": "off"}, layers=layers))


@register("pol03_gate", """
WITH m AS (SELECT receiver, count(*) AS n FROM cg_symbols WHERE kind = 'method' GROUP BY receiver) SELECT 'god_object_methods' AS gate, CAST(max(n) AS DOUBLE) AS value, CAST(30 AS DOUBLE) AS "limit", CASE WHEN max(n) > 30 THEN 'fail' ELSE 'pass' END AS outcome FROM m UNION ALL SELECT 'complexity', NULL, NULL, 'cannot_evaluate'""")
def _(g):
    return policy.gate(g, {"max_god_object_methods": 30, "max_complexity": 5}).select("gate", "value", "limit", "outcome")


@register("pol09_call_edge", "SELECT CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS evidence FROM cg_calls WHERE caller = '1' AND callee = '7'")
def _(g):
    return policy.validate(g, '{"predicate": "call_edge_exists", "subject": {"id": "1"}, "object": {"id": "7"}}').select("outcome", "evidence")


@register("pol11_imports_only_from", "SELECT CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS outcome, count(*) AS evidence FROM cg_imports WHERE to_package = 'pkg3' AND from_package NOT IN ('pkg1', 'pkg2')")
def _(g):
    return policy.validate(g, '{"predicate": "imports_only_from", "subject": {"id": "pkg3"}, "allow": ["pkg1", "pkg2"]}').select("outcome", "evidence")


@register("cmp01_context", "SELECT '42' AS id, (SELECT count(DISTINCT caller) FROM cg_calls WHERE callee = '42')::INT AS callers, (SELECT count(DISTINCT callee) FROM cg_calls WHERE caller = '42')::INT AS callees")
def _(g):
    return compose.context(g, "42", 1000).select("id", F.size("callers").alias("callers"), F.size("callees").alias("callees"))


@register("cmp04_plan", f"""
WITH RECURSIVE al(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT al.seed, c.caller FROM al JOIN cg_calls_thin c ON c.callee = al.id)
SELECT seed, count(*) - 1 AS impact FROM al GROUP BY seed""")
def _(g):
    return compose.plan(thin(g), seeds(g)).select("seed", "impact")


@register("cmp07_risk", f"""
WITH RECURSIVE dn(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT dn.seed, c.callee FROM dn JOIN cg_calls_thin c ON c.caller = dn.id),
e AS (SELECT DISTINCT caller AS a, callee AS b FROM cg_calls_thin UNION ALL SELECT DISTINCT concat('t', test_id), target FROM cg_test_edges),
up(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT up.seed, e.a FROM up JOIN e ON e.b = up.id),
ca(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT ca.seed, q.caller FROM ca JOIN cg_calls_thin q ON q.callee = ca.id),
c AS (SELECT seed AS callee, count(*) - 1 AS n FROM ca GROUP BY seed),
t AS (SELECT seed, count(*) AS n FROM up WHERE starts_with(id, 't') GROUP BY seed)
SELECT v.s AS seed, least(100, least(30, 3 * coalesce(c.n, 0)) + CASE WHEN coalesce(t.n, 0) = 0 THEN 20 WHEN t.n = 1 THEN 10 ELSE 0 END
+ CASE WHEN EXISTS (SELECT 1 FROM dn JOIN cg_sqls q ON q.function = dn.id WHERE dn.seed = v.s) THEN 10 ELSE 0 END + CASE WHEN EXISTS (SELECT 1 FROM dn JOIN cg_env_reads q ON q.function = dn.id WHERE dn.seed = v.s) THEN 5 ELSE 0 END)::INT AS risk
FROM {S} v(s) LEFT JOIN c ON c.callee = v.s LEFT JOIN t ON t.seed = v.s""")
def _(g):
    t = thin(g)
    t = t.replace(test_edges=g.test_edges.withColumn("test_func", F.concat(F.lit("t"), "test_func")), symbols=g.symbols.where("NOT is_test"))
    return compose.risk(t, seeds(g)).select("seed", "risk")


@register("flw01_function_taint", """
WITH RECURSIVE r(seed, id) AS (SELECT DISTINCT function, function FROM cg_env_reads WHERE env_key = 'KEY_7' UNION SELECT r.seed, c.callee FROM r JOIN cg_calls_thin c ON c.caller = r.id)
SELECT DISTINCT r.seed AS source, r.id AS sink FROM r JOIN cg_sqls q ON q.function = r.id""")
def _(g):
    t = thin(g)
    return flow.reach(t.env_reads.where("key = 'KEY_7'"), traverse.call_edges(t).select("src", "dst"), t.sqls).select("source", "sink")


@register_views("scl10_sql_classifier", "SELECT query, verb, access, table_name FROM cg_sqls")
def _(get):
    from stratagraph.functions.sqlclass import classified

    q = get("cg_sqls").select("query")
    kinds = q.distinct().withColumn("c", classified("query")).select("query", "c.verb", "c.access", F.element_at("c.tables", 1)["name"].alias("table_name"))
    return q.join(kinds, "query")


@register_views("inc01_stale", "SELECT coalesce(a.id, b.id) AS path, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM cg_symbols a FULL OUTER JOIN cg_symbols_baseline b ON a.id = b.id WHERE b.id IS NULL OR a.arity <> b.arity")
def _(get):
    f = lambda df: df.select(F.col("id").alias("path"), F.sha2(F.col("arity").cast("string"), 256).alias("content_digest"))
    return incremental.stale(f(get("cg_symbols_baseline")), f(get("cg_symbols")))


@register_views("inc06_sessions", "SELECT user_id, count(DISTINCT session_no) AS sessions, count(*) AS commands FROM cg_session_log GROUP BY user_id")
def _(get):
    return incremental.sessionise(get("events")).groupBy("user_id").agg(F.countDistinct("session_no").alias("sessions"), F.count("*").alias("commands"))


@register_views("inc06_live_counts", "SELECT date_trunc('hour', ts) AS window_start, CASE event_type WHEN 'signup' THEN 'plan' WHEN 'purchase' THEN 'review' WHEN 'click' THEN 'callers' WHEN 'view' THEN 'context' ELSE 'source' END AS command, count(*) AS n FROM events GROUP BY 1, 2")
def _(get):
    return sessions.live_counts(get("cg_session_log")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "command", "n")


@register_views("wsp04_query", "SELECT 'packages' AS kind, CAST(module_key AS VARCHAR) AS repository_id, name FROM cg_packages WHERE contains(name, 'nation_1') UNION SELECT 'symbols', CAST(package_key % 5 AS VARCHAR), name FROM cg_symbols WHERE contains(lower(name), 'nation_1')")
def _(get):
    parts = {"packages": get("cg_packages").select(F.col("module_key").cast("string").alias("repository_id"), "name"), "symbols": get("cg_symbols").select((F.col("package_key") % 5).cast("string").alias("repository_id"), "name")}
    return workspace.query(parts, "nation_1")


@register_views("wsp06_virtual_edges", "SELECT DISTINCT concat(CAST(a.package_key % 5 AS VARCHAR), ':', c.caller) AS src, concat(CAST(a.package_key % 5 AS VARCHAR), ':', c.callee) AS dst FROM cg_calls_thin c JOIN cg_symbols a ON a.id = c.caller WHERE c.resolution = 'resolved_static'")
def _(get):
    s = get("cg_symbols").select(F.col("id").alias("caller"), (F.col("package_key") % 5).cast("string").alias("repository_id"))
    c = get("cg_calls_thin").join(s, "caller").select("repository_id", F.col("caller").alias("caller_symbol_id"), F.col("caller").alias("caller_name"), F.col("callee").alias("callee_symbol_id"), "resolution")
    return workspace.virtual_edges(c, certainty="exact").select("src", "dst")


from stratagraph import queries_detail  # noqa: E402, F401  it registers more queries with the functions above
