"""The star-schema tables seen as a code graph.

Each view is one SQL text over placeholders; Spark gets DataFrames for them,
and the oracle gets the same text with table names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagraph.plans.graph import CodeGraph

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

VIEWS: dict[str, str] = {
    "cg_modules": "SELECT concat('mod:', CAST(r_regionkey AS STRING)) AS id, lower(r_name) AS path, r_regionkey AS module_key FROM {region}",
    "cg_packages": "SELECT concat('pkg', CAST(n_nationkey AS STRING)) AS id, lower(n_name) AS name, n_nationkey AS package_key, n_regionkey AS module_key FROM {nation}",
    "cg_symbols": "SELECT CAST(p_partkey AS STRING) AS id, p_name AS name, CAST(p_partkey % 25 AS INT) AS package_key, CASE WHEN p_partkey % 10 < 6 THEN 'function' WHEN p_partkey % 10 < 8 THEN 'method' WHEN p_partkey % 10 = 8 THEN 'struct' ELSE 'interface' END AS kind, CASE WHEN p_partkey % 10 IN (6, 7) THEN p_brand ELSE '' END AS receiver, concat('pkg', CAST(p_partkey % 25 AS STRING), '/', lower(p_type), CASE WHEN p_size >= 46 THEN '_test.go' ELSE '.go' END) AS file, CAST(p_partkey * 10 AS INT) AS line, CAST(p_partkey * 10 + p_size % 10 AS INT) AS end_line, p_size % 10 AS arity, p_size >= 46 AS is_test, p_brand IN ('Brand#1','Brand#2','Brand#3') AS exported, concat('pkg', CAST(p_partkey % 25 AS STRING)) AS package_name, concat('func ', p_name, '(', p_brand, ' int) (', lower(p_type), ', error)') AS signature, p_type AS part_type, p_brand AS brand FROM {part}",
    "cg_calls": "SELECT CAST(caller AS STRING) AS caller, CAST(callee AS STRING) AS callee, CAST(file AS STRING) AS file, line, CASE WHEN l_linestatus = 'F' THEN 'resolved_static' ELSE 'cha_possible_target' END AS resolution, CASE WHEN l_returnflag = 'R' THEN 'discarded' WHEN l_returnflag = 'A' THEN 'assigned' ELSE '' END AS return_usage FROM (SELECT l_partkey AS caller, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS callee, l_orderkey AS file, l_linenumber AS line, l_returnflag, l_linestatus FROM {lineitem}) q WHERE callee IS NOT NULL AND callee <> caller",
    "cg_calls_thin": "SELECT DISTINCT caller, callee, resolution FROM {cg_calls} WHERE line = 1 AND return_usage = 'discarded'",
    "cg_calls_mixed": "SELECT c.caller, CASE WHEN c.line = 2 THEN NULL ELSE c.callee END AS callee, CASE WHEN c.line = 2 THEN s.name ELSE c.callee END AS callee_raw, c.file, c.line, c.line = 6 AND CAST(c.caller AS BIGINT) % 50 = 7 AS synthetic, CASE WHEN c.line = 6 AND CAST(c.caller AS BIGINT) % 50 = 7 THEN 'synthetic_wrapper' WHEN c.line = 2 THEN '' ELSE c.resolution END AS resolution FROM {cg_calls} c JOIN {cg_symbols} s ON s.id = c.callee",
    "cg_imports": "SELECT CAST(o_orderkey AS STRING) AS from_file, concat('pkg', CAST(c_nationkey AS STRING)) AS from_package, concat('pkg', CAST(s_nationkey AS STRING)) AS to_package FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {supplier} ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey",
    "cg_test_edges": "SELECT CAST(l_orderkey AS STRING) AS test_id, CAST(l_partkey AS STRING) AS target, CASE WHEN l_linestatus = 'F' THEN 'resolved_static' ELSE '' END AS resolution FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber = 2",
    "cg_iface_methods": "SELECT DISTINCT p_brand AS iface, p_type AS method FROM {part} WHERE p_partkey % 20 = 9",
    "cg_type_methods": "SELECT DISTINCT CAST(l_suppkey AS STRING) AS type_id, p_type AS method FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber = 1 AND l_returnflag = 'R' AND l_quantity >= 40",
    "cg_routes": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, regexp_extract(url, '^https?://([^/?#]+)', 1) AS authority, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path, CAST(page_id * 3 AS STRING) AS handler, url FROM {pages}",
    "cg_errors": "SELECT CAST(event_id AS INT) AS line, concat('error k=', regexp_extract(props, '\"k\": *([0-9]+)', 1)) AS message, CAST(user_id AS STRING) AS function FROM {events} WHERE event_type = 'error'",
    "cg_env_reads": "SELECT CAST(event_id AS INT) AS line, concat('KEY_', regexp_extract(props, '\"k\": *([0-9]+)', 1)) AS env_key, CAST(user_id AS STRING) AS function FROM {events} WHERE event_type = 'view'",
    "cg_sqls": "SELECT CAST(event_id AS INT) AS line, CAST(user_id AS STRING) AS function, CASE WHEN event_type = 'purchase' THEN concat('INSERT INTO t', regexp_extract(props, '\"k\": *([0-9]+)', 1), ' VALUES (1)') ELSE concat('SELECT id FROM t', regexp_extract(props, '\"k\": *([0-9]+)', 1)) END AS query, concat('t', regexp_extract(props, '\"k\": *([0-9]+)', 1)) AS table_name, CASE WHEN event_type = 'purchase' THEN 'INSERT' ELSE 'SELECT' END AS verb, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS access FROM {events} WHERE event_type IN ('purchase', 'signup')",
    "cg_session_log": "SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'plan' WHEN 'purchase' THEN 'review' WHEN 'click' THEN 'callers' WHEN 'view' THEN 'context' ELSE 'source' END AS command, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_no FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL '2' HOUR THEN 1 ELSE 0 END AS is_new FROM {events}) q",
    "cg_symbols_baseline": "SELECT id, name, package_key, kind, package_name, file, line, is_test, exported, signature, receiver, part_type, brand, CASE WHEN CAST(id AS BIGINT) % 7 = 1 THEN arity + 1 ELSE arity END AS arity FROM {cg_symbols} WHERE CAST(id AS BIGINT) % 7 <> 0",
    "cg_implements": "SELECT DISTINCT p_brand AS interface, concat('Brand#', CAST(l_suppkey % 25 + 1 AS STRING)) AS concrete, CAST(p_partkey AS STRING) AS interface_id FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE p_partkey % 10 = 9",
    "cg_http_calls": "SELECT CAST(page_id AS INT) AS source_line, CAST(page_id * 3 AS STRING) AS function_name, CASE WHEN page_id % 4 = 0 THEN 'POST' ELSE 'GET' END AS method, url FROM {pages}",
    "cg_concurrency": "SELECT CASE event_id % 4 WHEN 0 THEN 'goroutine' WHEN 1 THEN 'channel send' WHEN 2 THEN 'channel receive' ELSE 'mutex lock' END AS kind, CAST(user_id AS STRING) AS function, CAST(event_id AS INT) AS line FROM {events} WHERE event_type = 'click'",
    "cg_literals": "SELECT p_type AS type_name, CAST(l_suppkey AS STRING) AS function, CAST(l_orderkey AS STRING) AS file, l_linenumber AS line FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_returnflag = 'N'",
    "cg_field_uses": "SELECT p_type AS type_name, p_brand AS field, CASE WHEN l_returnflag = 'A' THEN 'write' ELSE 'read' END AS access, CAST(l_suppkey AS STRING) AS function, CAST(l_orderkey AS STRING) AS file, l_linenumber AS line FROM {lineitem} JOIN {part} ON p_partkey = l_partkey",
    "cg_mutations": "SELECT p_brand AS field, p_type AS type_name, CAST(l_suppkey AS STRING) AS function, CAST(l_orderkey AS STRING) AS file, l_linenumber AS line FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE l_linenumber = 3 AND l_returnflag = 'A'",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a lazy DataFrame; only the tables it names are read."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    used |= {v: view(spark, sf_dir, v) for v in VIEWS if f"{{{v}}}" in text}
    return spark.sql(text, **used)


def oracle(sql: str, recursive: bool = False) -> str:
    """DuckDB SQL with the views that ``sql`` names in front of it."""
    need: list[str] = []

    def want(text: str) -> None:
        for v in VIEWS:
            if v in text.replace("{", " ").replace("}", " ").split() or f"{{{v}}}" in text or _names(text, v):
                if v not in need:
                    want(VIEWS[v])
                    need.append(v)

    want(sql)
    names = {n: n for n in (*TABLES, *VIEWS)}
    parts = [f"{v} AS ({VIEWS[v].format(**names)})" for v in need]
    body = sql.strip().removeprefix("WITH RECURSIVE").removeprefix("WITH") if sql.strip().startswith("WITH") else None
    if body is not None:
        return "WITH RECURSIVE " + ", ".join([*parts, body.strip()])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql


def _names(text: str, name: str) -> bool:
    import re

    return re.search(rf"(?<!\w){name}(?!\w)", text) is not None


def star_graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The relations of a code graph, each lazy."""
    v = lambda name: view(spark, sf_dir, name)
    symbols = lambda: v("cg_symbols").selectExpr(
        "*", "'' AS doc", "signature AS method_signature", "CAST(NULL AS map<string,string>) AS interface_methods",
        "CASE WHEN kind = 'struct' THEN array(named_struct('name', part_type, 'type', brand, 'tag', concat('json:\"', lower(part_type), '\" db:\"', lower(brand), '\"'))) ELSE CAST(array() AS array<struct<name:string,type:string,tag:string>>) END AS struct_fields",
        "CASE WHEN kind = 'struct' THEN array(concat('*', brand)) ELSE CAST(array() AS array<string>) END AS embedded_structs",
        "sha2(signature, 256) AS declaration_digest",
    )
    calls = lambda: v("cg_calls").selectExpr("caller AS caller_symbol_id", "caller AS caller_name", "callee AS callee_raw", "callee AS callee_symbol_id", "file", "line", "1 AS column", "false AS synthetic", "true AS precise", "resolution", "return_usage")
    return CodeGraph(
        spark,
        {
            "modules": lambda: v("cg_modules").selectExpr("id", "path", "path AS dir"),
            "packages": lambda: v("cg_packages").selectExpr("id", "name", "id AS import_path_best_effort", "id AS dir", "CAST(array() AS array<string>) AS files"),
            "symbols": symbols,
            "calls": calls,
            "imports": lambda: v("cg_imports").selectExpr("from_file", "from_package", "to_package AS import_path", "'' AS alias"),
            "test_edges": lambda: v("cg_test_edges").selectExpr("test_id AS test_func", "target", "target AS target_symbol_id", "resolution", "'' AS file", "0 AS line", "0 AS column", "true AS precise"),
            "routes": lambda: v("cg_routes").selectExpr("method", "path", "handler", "false AS inline_body", "authority AS file", "CAST(page_id AS INT) AS line", "handler AS function"),
            "errors": lambda: v("cg_errors").selectExpr("message", "function", "'e.go' AS file", "line"),
            "env_reads": lambda: v("cg_env_reads").selectExpr("env_key AS key", "'os.Getenv' AS accessor", "'e.go' AS file", "line", "function", "true AS precise"),
            "sqls": lambda: v("cg_sqls").selectExpr("query", "function", "'q.go' AS file", "line", "verb", "access", "'exact' AS classification", "array(named_struct('name', table_name, 'access', access)) AS tables"),
            "implements": lambda: v("cg_implements").selectExpr("interface", "concrete", "interface_id", "concrete AS concrete_id"),
            "http_calls": lambda: v("cg_http_calls").selectExpr("'c.go' AS source_file", "source_line", "function_name", "method", "url", "'' AS url_base", "'' AS url_suffix", "CAST(array() AS array<string>) AS static_segments", "false AS has_dynamic", "true AS url_suffix_static", "false AS request_only"),
            "concurrency": lambda: v("cg_concurrency").selectExpr("kind", "function", "'g.go' AS file", "line", "'' AS detail"),
            "literals": lambda: v("cg_literals"),
            "field_uses": lambda: v("cg_field_uses").selectExpr("type_name", "'' AS package", "field", "access", "function", "file", "line", "1 AS column"),
            "mutations": lambda: v("cg_mutations").selectExpr("*", "'assign' AS via", "true AS precise"),
        },
    )
