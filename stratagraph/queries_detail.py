"""More registered queries over the star-schema code graph, with their SQL: wrappers, interfaces, predicates, scalar forms, flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.operators import aggs, census, compose, diffs, flow, joins, policy, traverse, workspace
from stratagraph.operators.census import row
from stratagraph.plans.graph import CodeGraph, cut
from stratagraph.queries import SEEDS, S, baseline, register, register_views, seeds, thin
from stratagraph.sources.star import view

DISPLAY = "CASE WHEN receiver <> '' THEN '(' || receiver || ').' || name ELSE name END"
CALLABLE = "kind IN ('function', 'method')"


def mixed(g, get):
    """The graph whose calls have wrappers and unresolved spellings."""
    calls = get("cg_calls_mixed").selectExpr("caller AS caller_symbol_id", "caller AS caller_name", "callee_raw", "callee AS callee_symbol_id", "file", "line", "1 AS column", "synthetic", "NOT callee IS NULL AS precise", "resolution", "'' AS return_usage")
    return g.replace(calls=calls)


def register_mixed(name, sql=None):
    """A query f(graph, get) over the mixed graph."""
    from stratagraph.queries import ORACLE, QUERIES, oracle, star_graph

    def keep(f):
        def run(spark, sf_dir):
            get = lambda t: view(spark, sf_dir, t)
            return f(mixed(star_graph(spark, sf_dir), get), get)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = oracle(sql)
        return f

    return keep


# --- wrappers and unresolved spellings ---------------------------------------

AHEAD = """ahead(seed, id) AS (SELECT DISTINCT caller, caller FROM cg_calls_mixed WHERE synthetic UNION SELECT a.seed, c.callee FROM ahead a JOIN cg_calls_mixed c ON c.caller = a.id AND c.synthetic)"""


@register_mixed("agg03_fan_in_wrapped", f"""
WITH RECURSIVE {AHEAD}, p AS (SELECT DISTINCT caller, file, line, callee_raw, coalesce(callee, callee_raw) AS target FROM cg_calls_mixed WHERE NOT synthetic)
SELECT target, count(*) AS n FROM (SELECT * FROM p UNION SELECT p.caller, p.file, p.line, p.callee_raw, a.id FROM p JOIN ahead a ON a.seed = p.target WHERE a.id <> a.seed) q GROUP BY target""")
def _(g, get):
    return aggs.fan_in(g)


@register_mixed("trv03_forwarding_back", f"WITH RECURSIVE r(seed, id) AS (SELECT s, s FROM {S} v(s) UNION SELECT r.seed, c.caller FROM r JOIN cg_calls_mixed c ON c.callee = r.id AND c.synthetic) SELECT seed, id FROM r")
def _(g, get):
    return joins.forwarding(g.calls, seeds(g))


@register_mixed("trv04_forwarding_ahead", f"WITH RECURSIVE {AHEAD} SELECT seed, id FROM ahead")
def _(g, get):
    own = g.calls.where("synthetic").select(F.col("caller_symbol_id").alias("seed"), F.col("caller_symbol_id").alias("id")).distinct()
    return joins.forwarding(g.calls, own, reverse=False)


@register_mixed("trv13_unresolved_targets", f"SELECT DISTINCT c.callee_raw, s.id FROM cg_calls_mixed c JOIN cg_symbols s ON lower(s.name) = lower(c.callee_raw) AND s.{CALLABLE} WHERE c.callee IS NULL")
def _(g, get):
    return aggs.unresolved_targets(g)


@register_mixed("agg16_baseline", f"""
SELECT (SELECT count(*) FROM cg_symbols WHERE {CALLABLE} AND name NOT IN ('main', 'init') AND name NOT IN (SELECT callee_raw FROM cg_calls_mixed WHERE NOT synthetic)) AS orphan_count,
(SELECT count(*) FROM (SELECT DISTINCT from_package, to_package FROM cg_imports) q) AS coupling_edges""")
def _(g, get):
    return aggs.baseline(g)


@register_mixed("jon08_backfill", """
WITH t AS (SELECT c.caller, c.callee, s.name AS raw, c.file, c.line FROM cg_calls c JOIN cg_symbols s ON s.id = c.callee), near AS (SELECT caller, raw, file, line, min(callee) AS a FROM t GROUP BY ALL), far AS (SELECT raw, file, line, min(callee) AS b FROM t GROUP BY ALL)
SELECT m.caller, m.callee_raw, m.file, m.line, coalesce(m.callee, near.a, far.b) AS callee_symbol_id FROM cg_calls_mixed m LEFT JOIN near ON near.caller = m.caller AND near.raw = m.callee_raw AND near.file = m.file AND near.line = m.line LEFT JOIN far ON far.raw = m.callee_raw AND far.file = m.file AND far.line = m.line""")
def _(g, get):
    names = g.symbols.select(F.col("id").alias("callee"), F.col("name").alias("callee_raw"))
    typed = get("cg_calls").join(names, "callee").select(F.col("caller").alias("caller_symbol_id"), F.col("callee").alias("callee_symbol_id"), "callee_raw", "file", "line", F.lit(1).alias("column"), F.lit("cha_possible_target").alias("resolution"))
    return joins.backfill(g.calls, typed).select(F.col("caller_symbol_id").alias("caller"), "callee_raw", "file", "line", "callee_symbol_id")


@register_mixed("jon09_fan_out", """
WITH t AS (SELECT s.name AS raw, c.file, c.line, c.callee, min(CASE WHEN c.resolution = 'resolved_static' THEN 0 ELSE 1 END) AS r FROM cg_calls c JOIN cg_symbols s ON s.id = c.callee GROUP BY ALL)
SELECT m.caller, m.callee_raw, m.file, m.line, coalesce(t.callee, m.callee) AS callee_symbol_id, CASE t.r WHEN 0 THEN 'resolved_static' WHEN 1 THEN 'cha_possible_target' ELSE m.resolution END AS resolution
FROM cg_calls_mixed m LEFT JOIN t ON t.raw = m.callee_raw AND t.file = m.file AND t.line = m.line""")
def _(g, get):
    names = g.symbols.select(F.col("id").alias("callee"), F.col("name").alias("callee_raw"))
    targets = get("cg_calls").join(names, "callee").select("callee_raw", "file", "line", F.lit(1).alias("column"), F.col("callee").alias("callee_symbol_id"), "resolution")
    return joins.fan_out(g.calls, targets).select(F.col("caller_symbol_id").alias("caller"), "callee_raw", "file", "line", "callee_symbol_id", "resolution")


# --- selectors, census -------------------------------------------------------


@register("fil03_file_selector", "SELECT id FROM cg_symbols WHERE (file = 'pkg3/promo.go' OR ends_with(file, '/pkg3/promo.go')) AND lower(name) = 'hot gear' AND receiver = ''")
def _(g):
    return g.symbols.where(E.match_symbol("pkg3/promo.go:Hot Gear")).select("id")


@register("fil05_interface_targets", "SELECT id FROM cg_symbols WHERE kind = 'method' AND lower(name) = 'red widget' AND receiver IN (SELECT concrete FROM cg_implements WHERE interface = 'Brand#3')")
def _(g):
    return joins.interface_targets(g, "brand#3", "Red Widget")


@register("fil06_call_targets", "SELECT id FROM cg_symbols WHERE lower(name) = 'blue bolt' OR id = 'blue bolt'")
def _(g):
    return joins.call_targets(g, "blue bolt")


@register_views("fil11_stdlib", "SELECT DISTINCT 'net' || path AS path FROM cg_routes WHERE method = 'POST'")
def _(get):
    return get("cg_routes").select(F.concat(F.when(F.col("method") == "POST", "net").otherwise(F.col("authority")), "path").alias("path")).where(E.is_stdlib("path")).distinct()


@register("fil13_sql_filter", "SELECT query, function, line FROM cg_sqls WHERE access = 'read' AND contains(lower(query), 'from t1')")
def _(g):
    return census.query_sql(g, accesses=["read"], term="FROM T1").select("query", "function", "line")


@register("fil15_mutation_type", "SELECT function, field, line, file FROM cg_mutations WHERE lower(type_name) = 'promo'")
def _(g):
    return g.mutations.where(E.mutation_type_matches("type_name", "*shop.Promo")).select("function", "field", "line", "file")


@register("fil16_flow_package", "SELECT id FROM cg_symbols WHERE package_name = 'pkg3' OR starts_with(package_name, 'pkg3/')")
def _(g):
    return g.symbols.where(E.flow_package("package_name", "pkg3/...")).select("id")


@register("fil17_flow_function", "SELECT id FROM cg_symbols WHERE lower(package_name || '.' || name) = 'pkg3.hot gear'")
def _(g):
    return g.symbols.withColumn("q", F.concat_ws(".", "package_name", "name")).where(E.flow_function("q", "pkg3.Hot Gear")).select("id")


@register("fil18_complexity_filter", "SELECT id, arity AS complexity FROM cg_symbols WHERE starts_with(file, 'pkg1') AND NOT is_test")
def _(g):
    return aggs.filter_complexity(g.symbols.withColumn("complexity", F.col("arity")), prefix="pkg1", tests=False).select("id", "complexity")


@register("fil19_exclude_globs", "SELECT id FROM cg_symbols WHERE NOT starts_with(file, 'pkg2/') AND NOT regexp_matches(file, '^pkg1[^/]/promo[^/]*$')")
def _(g):
    return g.symbols.where(~E.glob("file", "pkg2/**") & ~E.glob("file", "pkg1?/promo*")).select("id")


@register("prj01_query_relations", f"""
WITH r AS (
SELECT 'package' AS kind, id AS stable_id, name, id AS file, 0 AS line, CASE WHEN lower(name) = 'nation_1' THEN 100 ELSE 60 END AS score FROM cg_packages WHERE contains(lower(name), 'nation_1') OR contains(lower(id), 'nation_1')
UNION ALL SELECT kind, id, {DISPLAY}, file, line, CASE WHEN lower(name) = 'promo' THEN 100 ELSE 40 END FROM cg_symbols WHERE contains(lower(name), 'promo') OR contains(lower(name), 'nation_1') OR (kind = 'struct' AND (contains(lower(part_type), 'promo') OR contains(lower(brand), 'promo')))
UNION ALL SELECT 'import', NULL, to_package, from_file, 0, 20 FROM cg_imports WHERE contains(to_package, 'nation_1') OR contains(to_package, 'promo'))
SELECT DISTINCT kind, stable_id, name, file, line, score FROM r""")
def _(g):
    return census.query(g, ["nation_1", "Promo"]).select("kind", "stable_id", "name", "file", "line", "score")


@register("prj03_focus", f"""
WITH c AS (SELECT c.caller, s.package_name || '.' || s.name AS raw, o.file, c.line FROM cg_calls c JOIN cg_symbols s ON s.id = c.callee JOIN cg_symbols o ON o.id = c.caller), f AS (SELECT DISTINCT file FROM cg_symbols WHERE package_name = 'pkg3')
SELECT kind, {DISPLAY} AS name, id AS stable_id, file, line, signature AS detail, 0 AS score FROM cg_symbols WHERE package_name = 'pkg3'
UNION ALL SELECT 'callee', raw, NULL, max(file), 0, count(*)::VARCHAR || ' calls', count(*)::INT FROM c WHERE file IN (FROM f) GROUP BY raw
UNION ALL SELECT 'caller', caller, NULL, file, line, raw, 0 FROM c WHERE file NOT IN (FROM f) AND starts_with(raw, 'pkg3.')""")
def _(g):
    to = g.symbols.select(F.col("id").alias("callee_symbol_id"), F.concat_ws(".", "package_name", "name").alias("raw"))
    own = g.symbols.select(F.col("id").alias("caller_symbol_id"), F.col("file").alias("own_file"))
    calls = g.calls.join(to, "callee_symbol_id").join(own, "caller_symbol_id").withColumn("callee_raw", F.col("raw")).withColumn("file", F.col("own_file")).drop("raw", "own_file")
    return census.focus(g.replace(calls=calls), "pkg3").select("kind", "name", "stable_id", "file", "line", "detail", "score")


@register("prj06_public", "SELECT id, upper(name) AS name FROM cg_symbols WHERE package_name = 'pkg3'")
def _(g):
    return census.public(g.replace(symbols=g.symbols.withColumn("name", F.upper("name"))), "pkg3").select("id", "name")


@register("prj13_http_calls", "SELECT function_name, method, url, source_line FROM cg_http_calls WHERE method = 'POST' OR contains(lower(url), 'post') OR contains(function_name, 'post')")
def _(g):
    return census.http_calls(g, "Post").select("function_name", "method", "url", "source_line")


@register("prj14_concurrency", "SELECT kind, function, line FROM cg_concurrency WHERE contains(kind, 'channel')")
def _(g):
    return census.concurrency(g, "CHANNEL").select("kind", "function", "line")


@register("prj15_globals", "SELECT s.id, s.brand AS name, m.function AS mutator, m.file AS at_file, m.line AS at_line FROM cg_symbols s LEFT JOIN cg_mutations m ON m.field = s.brand WHERE s.kind = 'struct' AND s.package_name = 'pkg8'")
def _(g):
    var = g.symbols.withColumn("kind", F.when(F.col("kind") == "struct", "var").otherwise(F.col("kind"))).withColumn("name", F.col("brand"))
    return census.globals_(g.replace(symbols=var), "pkg8").select("id", "name", "mutator", "at_file", "at_line")


@register("prj19_literals", "SELECT type_name, function, file, line FROM cg_literals WHERE type_name = 'PROMO'")
def _(g):
    return census.literals(g, "PROMO")


@register("prj23_field_usages", """
SELECT 'declaration' AS kind, name || '.' || part_type AS name, id AS stable_id, brand AS detail, file, line FROM cg_symbols WHERE kind = 'struct' AND lower(name) = 'hot gear' AND part_type = 'Brand#4'
UNION ALL SELECT 'use', function, NULL, access, file, line FROM cg_field_uses WHERE lower(type_name) = 'promo' AND field = 'Brand#4'""")
def _(g):
    return census.field_usages(g, "promo", "Brand#4").select("kind", "name", "stable_id", "detail", "file", "line")


@register_views("prj25_strings", f"""
SELECT e.line, e.message AS text, s.id AS owner FROM cg_errors e LEFT JOIN cg_symbols s ON e.line BETWEEN s.line AND s.end_line AND s.{CALLABLE} WHERE contains(e.message, 'k=3') OR contains(e.message, 'k=44')""")
def _(get):
    tokens = get("cg_errors").select(F.lit("all").alias("file"), "line", F.col("message").alias("text"))
    return census.string_literals(tokens, get("cg_symbols").withColumn("file", F.lit("all")), ["K=3", "k=44"]).select("line", "text", "owner")


@register_views("prj26_source", "SELECT id, line, end_line, 'ok' AS status, list_aggregate(list_transform(range(line, end_line + 1), lambda x: 'line ' || x::VARCHAR), 'string_agg', chr(10)) AS source FROM cg_symbols WHERE id = '7'")
def _(get):
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("line "), i.cast("string"))), "\n")
    texts = get("cg_symbols").select(F.col("file").alias("path")).distinct().withColumn("text", text).withColumn("digest", F.sha2("text", 256))
    return census.source(texts, get("cg_symbols"), "7").select("id", "line", "end_line", "status", "source")


@register("prj28_skeleton_file", "SELECT package_name, count(*)::INT AS declarations, string_agg(signature, chr(10) ORDER BY display, line, signature) AS skeleton FROM (SELECT *, " + DISPLAY + " AS display FROM cg_symbols WHERE file = 'pkg3/promo.go') q GROUP BY package_name")
def _(g):
    return census.skeleton(g, "pkg3/promo.go")


@register("agg07_complexity", "SELECT id, arity AS complexity, CASE WHEN arity < 1 THEN 'UNKNOWN' WHEN arity <= 5 THEN 'LOW' WHEN arity <= 10 THEN 'MEDIUM' ELSE 'HIGH' END AS label FROM cg_symbols WHERE " + CALLABLE)
def _(g):
    facts = g.symbols.where(CALLABLE).select("id", "name", "file", "line", F.col("arity").alias("complexity"))
    return aggs.complexity(facts).select("id", "complexity", "label")


@register("agg10_interface_methods", """
SELECT 'x::' || m.id AS id FROM cg_symbols m WHERE m.kind = 'method' AND EXISTS (SELECT 1 FROM cg_implements i JOIN cg_symbols f ON f.id = i.interface_id WHERE i.concrete = m.receiver AND f.name = m.name)""")
def _(g):
    s = g.symbols.withColumn("interface_methods", F.when(F.col("kind") == "interface", F.create_map("name", "signature")).cast("map<string,string>"))
    s = s.withColumn("id", F.when(F.col("kind") == "method", F.concat(F.lit("x::"), "id")).otherwise(F.col("id")))
    implements = g.implements.withColumn("concrete_id", F.concat(F.lit("x::"), "concrete_id"))
    return aggs.interface_method_ids(g.replace(symbols=s, implements=implements))


@register_views("agg13_uncovered_report", """
WITH b AS (SELECT l_linenumber AS f, CAST(l_partkey AS INT) AS a, CAST(l_partkey + l_quantity AS INT) AS z, CAST(l_suppkey % 2 AS INT) AS cnt FROM lineitem),
x AS (SELECT f, unnest(range(a, z + 1)) AS line, cnt FROM b), p AS (SELECT f, line, max(cnt) AS ran FROM x GROUP BY f, line),
l AS (SELECT DISTINCT l_linenumber AS f, l_partkey AS line FROM lineitem WHERE l_returnflag = 'R')
SELECT CAST(l.f AS VARCHAR) AS file, count(*) AS changed, count(CASE WHEN p.ran = 0 THEN 1 END) AS uncovered FROM l LEFT JOIN p ON p.f = l.f AND p.line = l.line GROUP BY l.f""")
def _(get):
    li = get("lineitem")
    blocks = li.selectExpr("CAST(l_linenumber AS STRING) AS file", "CAST(l_partkey AS INT) AS start_line", "CAST(l_partkey + l_quantity AS INT) AS end_line", "1 AS statements", "CAST(l_suppkey % 2 AS INT) AS count")
    return aggs.uncovered_report(li.where("l_returnflag = 'R'").selectExpr("CAST(l_linenumber AS STRING) AS file", "CAST(l_partkey AS INT) AS line"), blocks).select("file", "changed", "uncovered")


# --- interfaces --------------------------------------------------------------


@register("jon03_implementers_typed", "SELECT DISTINCT concrete AS id, 'exact' AS resolution_status FROM cg_implements WHERE interface = 'Brand#3'")
def _(g):
    return joins.implementers(g, "brand#3").select("id", "resolution_status")


@register("jon04_interfaces", "SELECT DISTINCT interface AS name, 'exact' AS resolution_status FROM cg_implements WHERE concrete = 'Brand#7'")
def _(g):
    return joins.interfaces_of(g, "brand#7")


@register("jon05_mocks", "SELECT DISTINCT concrete AS id FROM cg_implements WHERE interface = 'Brand#3' AND concrete IN (SELECT brand FROM cg_symbols WHERE is_test)")
def _(g):
    return joins.mocks(g.replace(symbols=g.symbols.withColumn("id", F.col("brand"))), "Brand#3").select("id")


@register_views("jon07_module_owner", "SELECT DISTINCT authority || path AS path, split_part(authority, '.', 1) AS owner FROM cg_routes WHERE contains(authority, '.') AND path <> ''")
def _(get):
    r = get("cg_routes").where("contains(authority, '.') AND path <> ''")
    owners = r.select(F.col("authority").alias("dir"), F.substring_index("authority", ".", 1).alias("owner")).distinct()
    return joins.longest_prefix(r.select(F.concat("authority", "path").alias("path")), owners, "path", "dir").select("path", "owner")


# --- traversals --------------------------------------------------------------


@register("trv09_coverage", f"""
WITH RECURSIVE e AS (SELECT DISTINCT caller AS a, callee AS b, resolution FROM cg_calls UNION SELECT DISTINCT 't' || test_id, target, resolution FROM cg_test_edges),
st AS (SELECT DISTINCT 't' || test_id AS s FROM cg_test_edges WHERE target IN ('1', '7', '42')),
ex(seed, id) AS (SELECT s, s FROM st UNION SELECT ex.seed, e.b FROM ex JOIN e ON e.a = ex.id AND e.resolution = 'resolved_static'), al(seed, id) AS (SELECT s, s FROM st UNION SELECT al.seed, e.b FROM al JOIN e ON e.a = al.id)
SELECT al.seed, al.id, CASE WHEN ex.id IS NOT NULL THEN 'exact' ELSE 'possible' END AS resolution FROM al LEFT JOIN ex ON ex.seed = al.seed AND ex.id = al.id WHERE al.id <> al.seed""")
def _(g):
    t = g.replace(test_edges=g.test_edges.withColumn("test_func", F.concat(F.lit("t"), "test_func")))
    start = t.test_edges.where(F.col("target").isin(*SEEDS)).select(F.col("test_func").alias("seed"), F.col("test_func").alias("id")).distinct()
    return traverse.coverage(t, start).select("seed", "id", "resolution")


@register("trv21_exact_neighbours", f"""
WITH RECURSIVE r(seed, id, depth) AS (SELECT s, s, 0 FROM {S} v(s) UNION SELECT r.seed, c.callee, r.depth + 1 FROM r JOIN cg_calls c ON c.caller = r.id AND c.resolution = 'resolved_static' WHERE r.depth < 2)
SELECT seed, id, min(depth) AS depth FROM r GROUP BY seed, id HAVING min(depth) > 0""")
def _(g):
    return traverse.exact_neighbours(g, seeds(g), False, 2)


@register("trv20_workspace_impact", f"""
WITH RECURSIVE n AS (SELECT id, (package_key % 5)::VARCHAR || ':' || id AS k FROM cg_symbols), e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM cg_calls_thin c JOIN n a ON a.id = c.caller JOIN n b ON b.id = c.callee),
r(seed, id) AS (SELECT k, k FROM n WHERE id IN {tuple(SEEDS)} UNION SELECT r.seed, e.a FROM r JOIN e ON e.b = r.id) SELECT seed, id FROM r WHERE seed <> id""")
def _(g):
    key = g.symbols.select("id", F.concat_ws(":", (F.col("package_key") % 5).cast("string"), "id").alias("k"))
    a, b = key.toDF("caller_symbol_id", "src"), key.toDF("callee_symbol_id", "dst")
    edges = thin(g).calls.join(a, "caller_symbol_id").join(b, "callee_symbol_id").select("src", "dst").distinct()
    start = key.where(F.col("id").isin(*SEEDS)).select(F.col("k").alias("seed"), F.col("k").alias("id"))
    return workspace.impact(edges, start).where("seed <> id").select("seed", "id")


@register("trv14_trace", """
WITH RECURSIVE f AS (SELECT DISTINCT function AS s FROM cg_errors WHERE contains(message, 'k=7')), h AS (SELECT DISTINCT handler FROM cg_routes),
r(seed, id, depth) AS (SELECT s, s, 0 FROM f UNION SELECT r.seed, c.caller, r.depth + 1 FROM r JOIN cg_calls c ON c.callee = r.id WHERE r.depth < 4)
SELECT seed, min(depth) AS steps FROM r JOIN h ON h.handler = r.id GROUP BY seed HAVING min(depth) < 4""")
def _(g):
    return traverse.trace(g, "K=7", 0).select("seed", (F.size("path") - 1).alias("steps")).where("steps < 4")


# --- changes -----------------------------------------------------------------


def drift(name: str, sql: str, what):
    @register_views(name, sql)
    def _(get):
        from stratagraph.plans.graph import CodeGraph

        def graph(symbols):
            tag = F.concat(F.lit('json:"'), F.lower("part_type"), F.lit('"'))
            field = F.array(F.struct(F.col("part_type").alias("name"), (F.col("arity") % 3).cast("string").alias("type"), tag.alias("tag")))
            s = symbols.select("id", "kind", F.upper("name").alias("name"), "file", F.concat_ws("/", "signature", "arity").alias("signature"), F.when(F.col("kind") == "struct", field).alias("struct_fields"), F.when(F.col("kind") == "interface", F.create_map("name", F.col("arity").cast("string"))).alias("interface_methods"))
            return CodeGraph(symbols.sparkSession, {"symbols": s})

        return what(graph(get("cg_symbols_baseline")), graph(get("cg_symbols")))


BOTH = "FROM (SELECT * FROM cg_symbols_baseline {w}) a FULL OUTER JOIN (SELECT * FROM cg_symbols {w}) b ON a.id = b.id"
METHODS = "SELECT 'interface method' AS kind, a.id || '.' || a.name AS id, 'changed' AS change, true AS breaking FROM cg_symbols_baseline a JOIN cg_symbols b ON a.id = b.id WHERE a.kind = 'interface' AND a.arity <> b.arity"
FIELDS = "SELECT 'field' AS kind, a.id || '.' || lower(a.part_type) AS id, 'changed' AS change, true AS breaking FROM cg_symbols_baseline a JOIN cg_symbols b ON a.id = b.id WHERE a.kind = 'struct' AND a.arity % 3 <> b.arity % 3"
drift("set02_method_diff", METHODS, diffs.method_diff)
drift("set03_field_diff", FIELDS, diffs.field_diff)
drift("set01_api_drift", f"""
SELECT coalesce(b.kind, a.kind) AS kind, coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'removed' WHEN a.id IS NULL THEN 'added' ELSE 'changed' END AS change, a.id IS NOT NULL AS breaking
{BOTH.format(w='WHERE NOT is_test')} WHERE a.id IS NULL OR b.id IS NULL OR a.arity <> b.arity UNION ALL {METHODS} UNION ALL {FIELDS}""", diffs.api_drift)


@register_views("set06_snapshot_diff", """
WITH a AS (SELECT count(*)::DOUBLE AS n, max(arity)::DOUBLE AS m FROM cg_symbols_baseline), b AS (SELECT count(*)::DOUBLE AS n, max(arity)::DOUBLE AS m FROM cg_symbols)
SELECT 'symbols' AS metric, a.n AS before, b.n AS after, CASE WHEN abs(b.n - a.n) <= 0.005 THEN 'unchanged' WHEN b.n > a.n THEN 'WORSE' ELSE 'improved' END AS verdict FROM a, b
UNION ALL SELECT 'max_arity', a.m, b.m, CASE WHEN abs(b.m - a.m) <= 0.005 THEN 'unchanged' WHEN b.m > a.m THEN 'WORSE' ELSE 'improved' END FROM a, b""")
def _(get):
    one = lambda t: get(t).agg(F.count("*").alias("symbols"), F.max("arity").alias("max_arity"))
    return diffs.snapshot_diff(one("cg_symbols_baseline"), one("cg_symbols"), ["symbols", "max_arity"]).drop("delta")


@register_views("set10_changed_lines", "SELECT DISTINCT file, line FROM cg_symbols WHERE NOT is_test UNION SELECT 'new/' || doc_id::VARCHAR || '.go', unnest(range(1, len(string_split(text, chr(10))) + 1))::INT FROM documents WHERE text IS NOT NULL")
def _(get):
    return diffs.changed_lines(get("cg_symbols").select("file", "line"), get("documents").where("text IS NOT NULL").select(F.concat(F.lit("new/"), F.col("doc_id").cast("string"), F.lit(".go")).alias("path"), "text"))


# --- predicates --------------------------------------------------------------


def predicate(name: str, spec: str, sql: str, **inputs):
    @register(name, sql)
    def _(g):
        return policy.validate(g, spec, **{k: f(g) for k, f in inputs.items()}).select("outcome", "evidence")


predicate("pol07_symbol_exists", '{"predicate": "symbol_exists", "subject": {"id": "hot gear"}}', "SELECT CASE count(*) WHEN 0 THEN 'fail' WHEN 1 THEN 'pass' ELSE 'cannot_evaluate' END AS outcome, count(*) AS evidence FROM cg_symbols WHERE replace(lower(name), ' ', '') = 'hotgear' OR lower(package_name || '.' || name) = 'hotgear'")
predicate("pol08_package_imports", '{"predicate": "package_imports", "subject": {"id": "pkg1"}, "object": {"id": "pkg2"}}', "SELECT CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS evidence FROM cg_imports WHERE from_package = 'pkg1' AND to_package = 'pkg2'")
predicate("pol10_type_implements", '{"predicate": "type_implements", "subject": {"id": "Brand#7"}, "object": {"id": "9"}}', "SELECT CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS outcome, count(*) AS evidence FROM cg_implements WHERE concrete = 'Brand#7' AND interface_id = '9'")
predicate("pol12_callers_only_from", '{"predicate": "callers_only_from", "subject": {"id": "42"}, "allow": ["pkg1", "pkg2"]}', "SELECT CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS outcome, count(*) AS evidence FROM cg_calls c LEFT JOIN cg_symbols s ON s.id = c.caller WHERE c.callee = '42' AND coalesce(s.package_name, '') NOT IN ('pkg1', 'pkg2')")
predicate(
    "pol13_call_arg_constant", '{"predicate": "call_arg_constant", "subject": {"id": "42"}, "argument": 1, "forbidden_values": ["3"]}',
    "SELECT CASE WHEN sum(CASE WHEN line = 3 THEN 1 ELSE 0 END) > 0 THEN 'fail' ELSE 'pass' END AS outcome, coalesce(sum(CASE WHEN line = 3 THEN 1 ELSE 0 END), 0)::BIGINT AS evidence FROM cg_calls WHERE callee = '42'",
    arguments=lambda g: g.calls.select(F.col("callee_symbol_id").alias("callee"), F.lit(1).alias("index"), F.col("line").cast("string").alias("value")),
)


@register_views("pol04_create_boundaries", "SELECT f AS layer, t AS may_import FROM (SELECT DISTINCT 'x.y/' || from_package AS f, 'x.y/' || to_package AS t FROM cg_imports) q WHERE f <> t")
def _(get):
    named = get("cg_imports").select(F.concat(F.lit("x.y/"), "from_package", F.lit("/sub")).alias("from_package"), F.concat(F.lit("x.y/"), "to_package").alias("import_path"))
    return policy.create_boundaries(named).select("layer", F.explode("may_import").alias("may_import"))


# --- ranks, pages, roles -----------------------------------------------------


@register("win05_explore_rank", f"""
SELECT id AS stable_id, 1 + CASE WHEN lower(name) = 'hot gear promo' THEN 1000 ELSE 0 END + CASE WHEN kind = 'function' THEN 0 ELSE 100 END
+ CASE WHEN contains(name, 'gear') THEN 30 ELSE 0 END + CASE WHEN contains(name, 'promo') THEN 30 ELSE 0 END + CASE WHEN contains(file, 'promo') THEN 10 ELSE 0 END + CASE WHEN contains(signature, 'gear') THEN 5 ELSE 0 END + CASE WHEN contains(signature, 'promo') THEN 5 ELSE 0 END AS score FROM cg_symbols""")
def _(g):
    kind = F.when(F.col("kind") == "function", "call").otherwise(F.col("kind"))
    rows = row(g.symbols, kind, "name", detail=F.col("signature"), stable_id=F.col("id"), score=F.lit(1))
    return compose.explore_rank(rows, "Hot Gear PROMO", ["Gear", "PROMO"]).select("stable_id", "score")


FACTS = f"""s AS (SELECT id, kind, name, receiver FROM cg_symbols), pc AS (SELECT callee AS id, count(*) AS n FROM (SELECT DISTINCT caller, file, line, callee FROM cg_calls) q GROUP BY callee), ce AS (SELECT caller AS id, count(*) AS n FROM (SELECT DISTINCT caller, file, line, callee FROM cg_calls) q GROUP BY caller),
f AS (SELECT s.id, s.kind, coalesce(pc.n, 0) AS callers, coalesce(ce.n, 0) AS callees, EXISTS (SELECT 1 FROM cg_routes r WHERE r.handler = s.id OR r.handler = s.name) AS handles, EXISTS (SELECT 1 FROM cg_sqls q WHERE q.function = s.id) AS sqls,
EXISTS (SELECT 1 FROM cg_calls c JOIN cg_sqls q ON q.function = c.callee WHERE c.caller = s.id) AS below, EXISTS (SELECT 1 FROM cg_test_edges t WHERE t.target = s.id) AS tested FROM s LEFT JOIN pc ON pc.id = s.id LEFT JOIN ce ON ce.id = s.id)"""


@register("scl15_role", f"""
WITH {FACTS} SELECT id, CASE WHEN kind = 'struct' THEN 'data transfer object (no methods)' WHEN kind = 'interface' THEN 'contract definition' WHEN handles THEN 'HTTP handler (entry point)'
WHEN callers = 0 AND NOT tested AND kind <> 'method' THEN 'unused or entry point (no detected production callers)' WHEN callers >= 5 AND callees <= 2 THEN 'high-traffic leaf utility' WHEN callers >= 5 AND callees >= 5 THEN 'high-traffic orchestrator'
WHEN callees >= 5 AND callers <= 2 THEN 'service orchestrator (coordinator)' WHEN sqls OR below THEN 'data access layer' WHEN callees = 0 THEN 'leaf function' ELSE 'internal utility' END AS role FROM f""")
def _(g):
    return aggs.evidence(g, g.symbols).select("id", E.role().alias("role"))


@register("scl16_quick_role", f"""
WITH {FACTS} SELECT id, CASE WHEN handles THEN 'HTTP handler' WHEN sqls THEN 'data access' WHEN callers = 0 THEN 'entry point' WHEN callers >= 5 AND callees >= 5 THEN 'orchestrator' WHEN callers >= 5 THEN 'utility' WHEN callees >= 5 THEN 'coordinator' ELSE 'internal' END AS role FROM f""")
def _(g):
    return aggs.evidence(g, g.symbols).select("id", E.quick_role().alias("role"))


@register("cmp05_review_errors", f"SELECT v.s AS seed, (SELECT count(*) FROM cg_errors e WHERE e.function = v.s) AS errors FROM {S} v(s)")
def _(g):
    return compose.review(thin(g), seeds(g)).select("seed", "errors")


@register("cmp08_select_tests", f"""
WITH RECURSIVE e AS (SELECT DISTINCT caller AS a, callee AS b FROM cg_calls_thin UNION ALL SELECT DISTINCT concat('t', test_id), target FROM cg_test_edges),
r(id) AS (SELECT s FROM {S} v(s) UNION SELECT e.a FROM r JOIN e ON e.b = r.id) SELECT id FROM r WHERE starts_with(id, 't')""")
def _(g):
    t = thin(g).replace(test_edges=g.test_edges.withColumn("test_func", F.concat(F.lit("t"), "test_func")), symbols=g.symbols.where("NOT is_test"))
    return compose.select_tests(t, seeds(g))["tests"].select("id")


@register("pag03_tests_page", "SELECT resolution, count(*) AS n FROM (SELECT DISTINCT test_id, CASE WHEN resolution = 'resolved_static' THEN 'exact' ELSE 'possible' END AS resolution FROM cg_test_edges) q GROUP BY resolution")
def _(g):
    tests = g.test_edges.select(F.col("test_func").alias("id"), E.certainty().alias("resolution"), F.lit(1).alias("depth")).distinct()
    return compose.tests_page(tests)["summary"].select("resolution", "n")


@register("win06_work_share", "SELECT function AS function_id, count(*) AS work FROM cg_sqls GROUP BY function ORDER BY work DESC, function LIMIT 10")
def _(g):
    return flow.work_share(g.sqls.select(F.col("function").alias("function_id")))


# --- scalar forms ------------------------------------------------------------


def scalar(name: str, sql: str, make):
    register_views(name, sql)(make)


scalar("scl01_short_name", "SELECT p_partkey AS id, lower(p_name) AS short FROM part", lambda get: get("part").select(F.col("p_partkey").alias("id"), E.short_name(F.concat(F.lit("x/y::(*"), F.regexp_replace("p_brand", "#", ""), F.lit(")."), "p_name")).alias("short")))
scalar("scl02_join_route", "SELECT page_id, rtrim(url, '/') || '/' || ltrim(coalesce(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), ''), '/') AS joined FROM pages WHERE url IS NOT NULL", lambda get: get("cg_routes").where("url IS NOT NULL").select("page_id", E.join_route("url", "path").alias("joined")))
scalar("scl03_static_segments", "SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9_+.-]*://[^/?#]*)?([^?#]*)', 1), '/'), lambda x: x <> '' AND NOT regexp_matches(x, '^[:*{]')), '|') AS segments FROM pages WHERE url IS NOT NULL", lambda get: get("pages").where("url IS NOT NULL").select("page_id", F.array_join(E.static_segments("url"), "|").alias("segments")))
scalar("scl08_signature_usage", "SELECT id, CASE WHEN lower(part_type) = 'promo' THEN 'return' WHEN brand = 'promo' THEN 'param' END AS usage FROM cg_symbols", lambda get: get("cg_symbols").select("id", E.signature_usage("signature", "promo").alias("usage")))
scalar("scl09_arg_count", "SELECT doc_id, CASE WHEN trim(regexp_extract(text, '(?s)^[^(]*\\((.*)\\)', 1)) = '' THEN 0 ELSE len(string_split(regexp_extract(text, '(?s)^[^(]*\\((.*)\\)', 1), ',')) END::INT AS args FROM documents WHERE text IS NOT NULL", lambda get: get("documents").where("text IS NOT NULL").select("doc_id", E.arg_count("text").alias("args")))
scalar("scl14_severity", "SELECT p_partkey AS id, CASE WHEN p_size >= 40 THEN 'CRITICAL' WHEN p_size >= 20 THEN 'HIGH' WHEN p_size >= 8 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM part", lambda get: get("part").select(F.col("p_partkey").alias("id"), E.severity("p_size").alias("severity")))
scalar("scl18_test_name", "SELECT id FROM cg_symbols WHERE regexp_matches('Test' || CASE WHEN exported THEN upper(name) ELSE name END, '^(Test|Benchmark|Fuzz|Example)($|[^a-z])')", lambda get: get("cg_symbols").where(E.test_name(F.concat(F.lit("Test"), F.when(F.col("exported"), F.upper("name")).otherwise(F.col("name"))))).select("id"))
scalar("scl20_flow_severity", "SELECT sink, source, CASE WHEN sink IN ('sql_query', 'process_execution') OR (sink = 'filesystem' AND source IN ('http_request', 'decoded_json')) THEN 'high' ELSE 'medium' END AS severity FROM (SELECT DISTINCT CASE event_type WHEN 'view' THEN 'sql_query' WHEN 'click' THEN 'filesystem' ELSE 'network' END AS sink, CASE WHEN user_id % 2 = 0 THEN 'http_request' ELSE 'environment' END AS source FROM events) q", lambda get: get("events").select(F.when(F.col("event_type") == "view", "sql_query").when(F.col("event_type") == "click", "filesystem").otherwise("network").alias("sink"), F.when(F.col("user_id") % 2 == 0, "http_request").otherwise("environment").alias("source")).distinct().select("sink", "source", E.flow_severity("sink", "source").alias("severity")))
scalar("scl22_json_name", "SELECT id, CASE WHEN brand = 'Brand#4' THEN NULL WHEN is_test THEN name ELSE lower(part_type) END AS field FROM cg_symbols", lambda get: get("cg_symbols").select("id", E.json_name(F.when(F.col("brand") == "Brand#4", 'json:"-"').when(F.col("is_test"), 'db:"x"').otherwise(F.concat(F.lit('json:"'), F.lower("part_type"), F.lit(',omitempty"'))), F.col("name")).alias("field")))
scalar("scl21_related_refs", "SELECT DISTINCT n_name AS a, r.r_name AS b FROM nation JOIN region r ON n_name = r.r_name OR starts_with(n_name, r.r_name || '.') OR starts_with(r.r_name, n_name || '.') UNION SELECT DISTINCT r_name || '.x', r_name FROM region", lambda get: get("region").select(F.concat("r_name", F.lit(".x")).alias("a"), F.col("r_name").alias("b")).where(flow.related(F.col("a"), F.col("b"))))


# --- flow --------------------------------------------------------------------


@register("flw14_findings", """
WITH RECURSIVE r(seed, id) AS (SELECT DISTINCT function, function FROM cg_env_reads WHERE env_key = 'KEY_7' UNION SELECT r.seed, c.callee FROM r JOIN cg_calls_thin c ON c.caller = r.id)
SELECT DISTINCT r.seed AS source_function, r.id AS sink_function, 'environment' AS source_kind, 'sql_query' AS sink_kind, 'high' AS severity, 'high' AS confidence FROM r JOIN cg_sqls q ON q.function = r.id""")
def _(g):
    """Each function hands its parameter to what it calls; some read the environment, some run SQL with it."""
    t = thin(g)
    none = F.array().cast("array<string>")
    no_args = F.array().cast("array<array<string>>")

    def facts(df, kind, line, target=None, callee=None, source=None, sink=None, inputs=none, arguments=no_args):
        text = lambda v: F.lit(v).cast("string") if v is None or isinstance(v, str) else v
        return df.select(
            F.col("f").alias("function_id"), F.col("f").alias("function"), F.lit("a.go").alias("file"), F.lit(kind).alias("kind"), text(target).alias("target"), text(callee).alias("callee"),
            text(source).alias("source_kind"), text(sink).alias("sink_kind"), F.lit("").alias("detail"), inputs.alias("inputs"), arguments.alias("arguments"), F.lit(False).alias("parameter_only"), line.cast("int").alias("line"), F.lit(1).alias("column"),
        )

    v = F.array(F.lit("v"))
    env = cut(t.env_reads.where("key = 'KEY_7'").select(F.col("function").alias("f")).distinct())
    sql = cut(t.sqls.select(F.col("function").alias("f")).distinct())
    calls = cut(t.calls.select(F.col("caller_symbol_id").alias("f"), F.col("callee_symbol_id").alias("to")).distinct())
    place = F.col("to").cast("int") + 10
    every = calls.select("f").union(calls.select("to")).union(env).union(sql).distinct()
    flows = facts(env, "source", F.lit(1), "v", source="environment").unionByName(facts(sql, "sink", F.lit(2), sink="sql_query", inputs=v)).unionByName(facts(calls, "call", place, F.concat(F.lit("$call:"), "to"), F.col("to"), inputs=v, arguments=F.array(v)))
    typed = calls.select(F.col("f").alias("caller_symbol_id"), F.col("to").alias("callee_raw"), F.col("to").alias("callee_symbol_id"), F.lit("a.go").alias("file"), place.alias("line"))
    functions = every.select(F.col("f").alias("id"), F.col("f").alias("name"), F.lit("a.go").alias("file"), F.array(F.struct(F.lit("v").alias("name"), F.lit("string").alias("type"))).alias("params"))
    found, _ = flow.flow(CodeGraph(g.spark, {"flow_facts": flows, "flow_functions": functions, "calls": typed}), k=1, paths=False)
    # A function has one source and one sink at most, so no two findings differ in their lines alone.
    return found.select("source_function", "sink_function", "source_kind", "sink_kind", "severity", "confidence")


@register_views("inc03_changed_files", "SELECT coalesce(a.id, b.id) AS path, CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM cg_symbols a FULL OUTER JOIN cg_symbols_baseline b ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.arity <> b.arity")
def _(get):
    f = lambda df: df.select(F.col("id").alias("path"), F.sha2(F.col("arity").cast("string"), 256).alias("content_digest"))
    return diffs.changed_files(f(get("cg_symbols_baseline")), f(get("cg_symbols")))


scalar(
    "scl25_byte_size",
    "SELECT p_partkey AS id, CASE p_size % 5 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1048576 WHEN 3 THEN p_size::BIGINT * 1000000000 END::BIGINT AS bytes FROM part",
    lambda get: get("part").select(F.col("p_partkey").alias("id"), E.byte_size(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.element_at(F.array(*map(F.lit, ("", "KB", " mib", "g ", "X"))), (F.col("p_size") % 5 + 1).cast("int")))).alias("bytes")),
)
