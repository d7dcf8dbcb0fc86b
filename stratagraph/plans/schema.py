"""Schemas of the code-graph relations (DDL) and of the common result row."""

RELATIONS: dict[str, str] = {
    "modules": "id string, path string, dir string",
    "packages": "id string, name string, import_path_best_effort string, dir string, files array<string>",
    "files": "id string, path string, package_name string, lines int, generated boolean, content_digest string",
    "symbols": "id string, kind string, name string, receiver string, package_name string, file string, line int, end_line int, arity int, doc string, signature string, method_signature string, interface_methods map<string,string>, declared_interface_methods map<string,string>, struct_fields array<struct<name:string,type:string,tag:string>>, embedded_structs array<string>, declaration_digest string",
    "imports": "from_file string, from_package string, import_path string, alias string",
    "calls": "caller_symbol_id string, caller_name string, callee_raw string, callee_symbol_id string, file string, line int, column int, synthetic boolean, precise boolean, resolution string, return_usage string",
    "env_reads": "key string, accessor string, file string, line int, function string, precise boolean",
    "variable_uses": "symbol_id string, package_name string, name string, function string, file string, line int, column int",
    "field_uses": "type_name string, package string, field string, access string, function string, file string, line int, column int",
    "dependencies": "module string, version string",
    "routes": "method string, path string, handler string, inline_body boolean, file string, line int, function string",
    "sqls": "query string, function string, file string, line int, verb string, access string, classification string, tables array<struct<name:string,access:string>>",
    "errors": "message string, function string, file string, line int",
    "concurrency": "kind string, function string, file string, line int, detail string",
    "test_edges": "test_func string, target string, target_symbol_id string, resolution string, file string, line int, column int, precise boolean",
    "implements": "interface string, concrete string, interface_id string, concrete_id string",
    "mutations": "field string, type_name string, function string, file string, line int, via string, precise boolean",
    "literals": "type_name string, function string, file string, line int",
    "http_calls": "source_file string, source_line int, function_name string, method string, url string, url_base string, url_suffix string, static_segments array<string>, has_dynamic boolean, url_suffix_static boolean, request_only boolean",
    "flow_facts": "function_id string, function string, file string, kind string, target string, callee string, source_kind string, sink_kind string, detail string, inputs array<string>, arguments array<array<string>>, parameter_only boolean, line int, column int",
    "flow_functions": "id string, name string, file string, params array<struct<name:string,type:string>>",
    "session_log": "type string, session_id string, created_at timestamp, ended_at timestamp, timestamp timestamp, command string, args array<string>, intention string, execution_ms bigint, status string",
    "coverage": "file string, start_line int, start_col int, end_line int, end_col int, statements int, count int",
}

#: What census queries return.
RESULT = "kind string, name string, stable_id string, file string, line int, detail string, score int, resolution_status string"

#: A call site; rows that agree on it are one place in the source.
SITE = ("caller", "file", "line", "column", "callee_raw")

EXACT = ("resolved_static", "synthetic_wrapper")
