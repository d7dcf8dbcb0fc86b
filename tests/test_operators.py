"""Hand-built graphs with expected rows."""

import json

import pytest
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.golang.lexer import digest, tokens, unquote
from stratagraph.golang.parser import parse
from stratagraph.operators import aggs, census, compose, diffs, flow, incremental, joins, policy, render, traverse, workspace
from stratagraph.plans import fixpoint
from stratagraph.plans.graph import CodeGraph
from stratagraph.plans.schema import RELATIONS
from stratagraph.sources import files, store
from stratagraph.streaming import sessions

SOURCE = """package shop // a comment

import (
	"database/sql"
	"fmt"
	env "os"
)

type Store interface {
	Find(id string) (string, error)
	Save(id, name string) error
}

type Item struct {
	ID, Name string `json:"id"`
	*Base
	Tags []string
}

var ErrGone = fmt.Errorf("gone %d", 1)

func NewItem(id string) *Item { return &Item{ID: id} }

func (i *Item) Load(db *sql.DB, a, b int) (string, error) {
	key := env.Getenv("SHOP_KEY")
	if a > 0 && b > 0 {
		for range []int{1} {
			go work(key)
		}
	}
	rows := db.Query("SELECT name FROM items WHERE id = " + "$1", key)
	i.Name = rows
	defer rows.Close()
	return helper(key), nil
}

func helper(s string) string { return s }
"""


def rel(spark, name, *rows):
    full = spark.createDataFrame([], RELATIONS[name]).schema
    return spark.createDataFrame([tuple(r.get(f.name) for f in full.fields) for r in rows], full)


def sym(id, kind="function", name=None, **more):
    return {"id": id, "kind": kind, "name": name or id, "receiver": "", "package_name": "p", "file": "p/a.go", "line": 1, "end_line": 5, "arity": 1, "signature": "func f(a int) error"} | more


def call(a, b, line=1, resolution="resolved_static", **more):
    return {"caller_symbol_id": a, "caller_name": a, "callee_raw": b, "callee_symbol_id": b, "file": "p/a.go", "line": line, "column": 1, "synthetic": False, "resolution": resolution, "return_usage": ""} | more


@pytest.fixture(scope="module")
def g(spark):
    return CodeGraph(spark, {
        "symbols": rel(spark, "symbols", sym("main", name="main"), sym("a"), sym("b"), sym("c"), sym("lone"), sym("T", "struct", struct_fields=[("F", "int", 'json:"f"')]), sym("TestA", file="p/a_test.go")),
        "calls": rel(spark, "calls", call("main", "a"), call("a", "b", 2), call("b", "c", 3, "cha_possible_target"), call("c", "b", 4), call("x", "b", 5, "synthetic_wrapper", synthetic=True), call("a", "x", 6)),
        "test_edges": rel(spark, "test_edges", {"test_func": "TestA", "target": "a", "target_symbol_id": "a", "resolution": "resolved_static"}),
        "routes": rel(spark, "routes", {"method": "GET", "path": "/users/:id", "handler": "a", "inline_body": False, "file": "p/a.go", "line": 1}),
        "errors": rel(spark, "errors", {"message": "it broke", "function": "c", "file": "p/a.go", "line": 3}),
    })


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_selectors(spark):
    s = rel(spark, "symbols", sym("ex.io/p::(*Svc).Get", "method", "Get", receiver="*Svc", package_name="p"), sym("ex.io/p::Get", name="Get"), sym("ex.io/q::Run", name="Run", package_name="q"))
    hit = lambda q: ids(s.where(E.match_symbol(q)))
    assert hit("svc.get") == ["ex.io/p::(*Svc).Get"] and hit("p.get") == ["ex.io/p::(*Svc).Get", "ex.io/p::Get"]
    assert hit("ex.io/q.Run") == ["ex.io/q::Run"] and hit("p/a.go:Get") == ["ex.io/p::Get"] and hit("a.go:Svc.Get") == ["ex.io/p::(*Svc).Get"]
    assert hit("p.Svc.Get") == ["ex.io/p::(*Svc).Get"]


def test_expressions(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first()["x"]
    assert one(E.route_shape(F.lit("/Users/:id/{x}/*rest"))) == "/users/{}/{}/{}"
    assert one(E.join_route(F.lit("/api/"), F.lit("/x"))) == "/api/x"
    assert one(E.json_name(F.lit('json:"-"'), F.lit("F"))) is None and one(E.json_name(F.lit('json:"a,omitempty"'), F.lit("F"))) == "a" and one(E.json_name(F.lit(""), F.lit("F"))) == "F"
    assert one(E.arg_count(F.lit("func (s *S) F(a int, b string) error"))) == 2 and one(E.arg_count(F.lit("func F() error"))) == 0
    assert one(E.test_name(F.lit("TestX"))) and not one(E.test_name(F.lit("Testing")))
    assert one(E.is_stdlib(F.lit("net/http"))) and not one(E.is_stdlib(F.lit("ex.io/a")))
    assert one(E.match_package(F.lit("a/b/c"), "a/**")) and not one(E.match_package(F.lit("a/b/c"), "a/*"))
    assert one(E.match_package(F.lit("a/b"), "a/*")) and not one(E.match_package(F.lit("a/b"), "*")) and not one(E.match_package(F.lit("a/b"), "**"))
    assert E.explore_terms("How does the Login work, for users?") == ["Login", "for", "users"] and E.explore_terms("what is the") == ["what is the"]
    assert one(E.arg_count(F.lit("func F(a int) (T, error)"))) == 2
    assert E.test_pattern(["B", "A"]) == ["^(A|B)$"] and len(E.test_pattern([f"Test{i}" for i in range(100)], 100)) > 5


def test_traversals(spark, g):
    seed = spark.createDataFrame([("b", "b")], "seed string, id string")
    up = {r["id"]: r["resolution"] for r in traverse.impact(g, seed).collect()}
    assert up == {"a": "exact", "main": "exact", "c": "exact"}
    assert {(r["id"], r["depth"]) for r in traverse.callers_depth(g, seed, 1).collect()} == {("a", 1), ("c", 1), ("x", 1)}
    p = traverse.path(g, spark.createDataFrame([("main", "main")], "seed string, id string"), "c").first()
    assert p["path"] == ["main", "a", "b", "c"] and p["certainty"] == "possible"
    t = {(r["seed"], r["id"], r["resolution"]) for r in traverse.tests_of(g, spark.createDataFrame([("b", "b"), ("c", "c"), ("lone", "lone")], "seed string, id string")).collect()}
    assert t == {("b", "TestA", "exact"), ("c", "TestA", "possible")}
    assert [r["path"] for r in traverse.trace(g, "broke").where("kind = 'entry'").collect()] in ([["a", "b", "c"]],)
    assert ids(aggs.reachable_orphans(g)) == ["lone"]
    assert [r["tier"] for r in traverse.match_route(g, "/users/{x}").collect()] == [4]
    names = {(r["part"], r["name"]) for r in traverse.endpoint(g, "/users/:id", 2).collect()}
    assert ("call", "b") in names and ("call", "c") in names


def test_counts(g):
    fan = {r["target"]: r["n"] for r in aggs.fan_in(g).collect()}
    assert fan == {"a": 1, "b": 3, "c": 1, "x": 1}  # a -> x reaches b through the wrapper
    assert [r["id"] for r in aggs.hotspot(g, 2).collect()] == ["b", "a"]
    left = {r["id"]: r["resolution"] for r in aggs.untested(g).collect()}
    assert left == {"c": "possible"}
    assert ids(aggs.orphans_by_name(g)) == ["TestA", "lone"]
    assert [r["label"] for r in compose.risk(g, g.spark.createDataFrame([("lone", "lone")], "seed string, id string")).collect()] == ["SAFE"]


def test_pages(g):
    c = compose.cursor("s", "q", offset=7)
    assert compose.open_cursor(c, "s", "q") == 7
    for bad in ((c, "s", "other"), ("???", "s", "q")):
        with pytest.raises(ValueError):
            compose.open_cursor(*bad)
    assert [r["id"] for r in compose.page(g.symbols.select("id"), ["id"], 2, 2).collect()] == ["a", "b"]
    assert len(compose.page(g.symbols.select("id"), ["id"], 0, 200, 1).collect()) == 1
    assert compose.fingerprint(g) == compose.fingerprint(g.replace(calls=g.calls.repartition(3)))
    assert compose.fingerprint(g) != compose.fingerprint(g.replace(calls=g.calls.limit(2)))


def test_policies(g):
    out = lambda b, **k: policy.validate(g, json.dumps(b), **k).first()["outcome"]
    edge = {"predicate": "call_edge_exists", "subject": {"id": "a"}, "object": {"id": "b"}}
    assert out(edge) == "pass" and out(edge, fresh=False) == "cannot_evaluate"
    assert out(edge | {"object": {"id": "zz"}}) == "fail"
    assert out({"predicate": "symbol_exists", "subject": {"id": "nope"}}) == "fail"
    assert out({"predicate": "callers_only_from", "subject": {"id": "b"}, "allow": ["p"]}) == "fail"  # x has no package
    with pytest.raises(ValueError):
        policy.parse_binding('{"predicate": "x", "subject": {}}')
    many = g.replace(symbols=g.symbols.withColumn("signature", F.lit("func f(a, b, c, d, e, f, g int)")))
    assert policy.check_status(policy.check(many, {"max_arity": "error"})).first()["status"] == "failed"
    assert policy.check(g, {"max_arity": {"level": "error", "value": 0}}).count() == 0  # no limit means six
    assert policy.check_status(policy.check(g, {})).first()["status"] == "passed"
    with pytest.raises(ValueError):
        policy.check(g, {"nonsense": "error"})
    config = {"max_complexity": "error", "api_drift": "warn", "new_globals": "off", "require_tests_for_changed_routes": "error"}
    left = policy.skipped(config)
    assert [r for r, _ in left] == ["api_drift", "require_tests_for_changed_routes", "max_complexity"]
    assert policy.check_status(policy.check(g, config), left).first().asDict() == {"errors": 0, "warnings": 0, "skipped": 3, "status": "passed"}
    changed = g.symbols.where("id IN ('a', 'b')").select("id")
    assert policy.check(g, {"require_tests_for_changed_routes": "error"}, changed=changed).count() == 0  # TestA exercises a
    bare = CodeGraph(g.spark, {k: v for k, v in g.relations.items() if k != "test_edges"})
    assert [r["name"] for r in policy.check(bare, {"require_tests_for_changed_routes": "error"}, changed=changed).collect()] == ["a"]
    gates = {r["gate"]: r["outcome"] for r in policy.gate(g, {"max_complexity": 5, "max_god_object_methods": 1}).collect()}
    assert gates == {"complexity": "cannot_evaluate", "god_object_methods": "pass"}
    with pytest.raises(ValueError):
        policy.gate(g, {"max_nonsense": 1})


def test_interface_methods(spark):
    """Only methods that an implements edge of their own receiver asks for, and the usual names."""
    own = CodeGraph(spark, {
        "symbols": rel(spark, "symbols", sym("p::Runner", "interface", "Runner", interface_methods={"Run": "()"}), sym("p::(*T).Run", "method", "Run", receiver="*T"), sym("p::(*Other).Run", "method", "Run", receiver="*Other"), sym("p::(*T).Scan", "method", "Scan", receiver="*T"), sym("p::Box[K].Run", "method", "Run", receiver="Box[K]"), sym("p::Run", name="Run")),
        "implements": rel(spark, "implements", {"interface": "Runner", "concrete": "T", "interface_id": "p::Runner", "concrete_id": "p::T"}, {"interface": "Runner", "concrete": "Box", "interface_id": "p::Runner", "concrete_id": "p::Box"}),
    })
    assert ids(aggs.interface_method_ids(own)) == ["p::(*T).Run", "p::(*T).Scan", "p::Box[K].Run"]


def test_roles(spark):
    calls = [call(f"c{i}", "hub", i) for i in range(5)] + [call("hub", f"d{i}", i) for i in range(5)] + [call("x", "one", 1), call("one", "query", 2), call("t", "query", 3, file="p/a_test.go")]
    symbols = [sym(n) for n in ("hub", "one", "query", "lone", "leaf", "page")] + [sym("D", "struct", "D"), sym("I", "interface", "I"), sym("Big", "struct", "Big", struct_fields=[(f"F{i}", "int", "") for i in range(15)])]
    own = CodeGraph(spark, {"symbols": rel(spark, "symbols", *symbols), "calls": rel(spark, "calls", *calls, call("y", "leaf", 9)), "sqls": rel(spark, "sqls", {"query": "SELECT 1", "function": "query"}), "routes": rel(spark, "routes", {"method": "GET", "path": "/", "handler": "h.page"})})
    e = aggs.evidence(own, own.symbols)
    full = {r["id"]: r["r"] for r in e.select("id", E.role().alias("r")).collect()}
    assert full == {
        "hub": "high-traffic orchestrator", "one": "data access layer", "query": "data access layer", "lone": "unused or entry point (no detected production callers)", "leaf": "leaf function",
        "page": "HTTP handler (entry point)", "D": "data transfer object (no methods)", "I": "contract definition", "Big": "large data model or potential god object",
    }
    quick = {r["id"]: r["r"] for r in e.where("kind = 'function'").select("id", E.quick_role().alias("r")).collect()}
    assert quick == {"hub": "orchestrator", "one": "internal", "query": "data access", "lone": "entry point", "leaf": "internal", "page": "HTTP handler"}


def test_constructors_and_schema(spark):
    s = [sym("p::NewT", name="NewT", signature="func NewT(u *U) (*T, error)"), sym("p::Of", name="Of", signature="func Of() p.T"), sym("p::(F).Make", "method", "Make", receiver="F", signature="func (F) Make() *T"), sym("p::Use", name="Use", signature="func Use(t *T) error"), sym("p::Two", name="Two", signature="func Two() (T, error)")]
    tags = {"A": 'db:"users"', "B": 'db:"users_old"', "C": 'gorm:"column:users"', "D": 'json:"users,omitempty"'}
    own = CodeGraph(spark, {"symbols": rel(spark, "symbols", *s, *[sym(n, "struct", n, struct_fields=[("F", "int", t)]) for n, t in tags.items()])})
    assert ids(census.constructors(own, "T")) == ["p::(F).Make", "p::NewT", "p::Of"]
    assert ids(census.constructors(own, "p.T")) == ["p::(F).Make", "p::NewT", "p::Of"]
    assert ids(census.schema(own, "Users")) == ["A", "C", "D"]


def test_explore_rank(spark):
    rows = spark.createDataFrame([("var", "Login flow", "a.go", "", 1), ("call", "Login flow", "a.go", "", 1), ("function", "login", "login.go", "flow", 5)], "kind string, name string, file string, detail string, score int")
    got = {r["kind"]: r["score"] for r in compose.explore_rank(rows.withColumn("line", F.lit(1)), "Login flow", ["Login", "flow"]).collect()}
    assert got == {"var": 1 + 1000 + 100 + 60, "call": 1 + 1000 + 60, "function": 5 + 100 + 100 + 10 + 5}


def test_long_path(spark):
    """A target forty steps away is found; a bound is only kept where one is given."""
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "src string, dst string")
    start = spark.createDataFrame([("n0", "n0")], "seed string, id string")
    far = fixpoint.best_paths(edges, start, [F.lit(0), F.lit(1)])
    assert far.where("id = 'n40'").first()["rank"]["r1"] == 40
    assert fixpoint.best_paths(edges, start, [F.lit(0), F.lit(1)], 3).count() == 4


def fact(function, kind, line, **more):
    return {"function_id": function, "function": function, "file": "p/a.go", "kind": kind, "inputs": [], "arguments": [], "line": line, "column": 1} | more


def taint(spark, facts, policy=None, calls=(), imports=(), **functions):
    """(source, sink, confidence) of a small flow graph; ``functions`` maps names to their parameters."""
    own = CodeGraph(spark, {
        "flow_facts": rel(spark, "flow_facts", *facts), "calls": rel(spark, "calls", *calls), "imports": rel(spark, "imports", *imports),
        "flow_functions": rel(spark, "flow_functions", *[{"id": f"p::{n}", "name": n, "file": "p/a.go", "params": p} for n, p in functions.items()]),
    })
    found, report = flow.flow(own, policy)
    assert report["complete"]
    return sorted((r["source_function"], r["sink_function"], r["sink_kind"], r["confidence"]) for r in found.collect())


def test_flow_calls(spark):
    """A call enters a function by its typed id, an import's alias or its own package, never by a like name elsewhere."""
    read = fact("p::main", "source", 1, target="v", source_kind="environment")
    sink = fact("p::save", "sink", 9, sink_kind="sql_query", inputs=["s"])
    to = lambda callee, **more: fact("p::main", "call", 2, target="$call:2:1", callee=callee, inputs=["v"], arguments=[["v"]], **more)
    save = {"main": [], "save": [("s", "string")]}
    assert taint(spark, [read, sink, to("save")], **save) == [("p::main", "p::save", "sql_query", "high")]
    assert taint(spark, [read, sink, to("ext.save")], **save) == []
    assert taint(spark, [read, sink, to("db.save")], imports=[{"from_file": "p/a.go", "from_package": "p", "import_path": "p", "alias": "db"}], **save) == [("p::main", "p::save", "sql_query", "high")]
    typed = {"caller_symbol_id": "p::main", "callee_raw": "x.Do", "callee_symbol_id": "p::save", "file": "p/a.go", "line": 2}
    assert taint(spark, [read, sink, to("x.Do")], calls=[typed], **save) == [("p::main", "p::save", "sql_query", "high")]
    # The result of an unknown call goes on with low confidence.
    own = fact("p::main", "sink", 3, sink_kind="network", inputs=["$call:2:1"])
    assert taint(spark, [read, own, to("ext.wrap")], **save) == [("p::main", "p::main", "network", "low")]


def test_flow_arguments_and_sanitisers(spark):
    read = fact("p::main", "source", 1, target="v", source_kind="environment")
    sink = fact("p::put", "sink", 9, sink_kind="sql_query", inputs=["rest"])
    args = fact("p::main", "call", 2, target="$call:2:1", callee="put", inputs=["v"], arguments=[["a"], ["b"], ["v"]])
    assert taint(spark, [read, sink, args], main=[], put=[("x", "string"), ("rest", "...string")]) == [("p::main", "p::put", "sql_query", "high")]
    assert taint(spark, [read, sink, args], main=[], put=[("x", "string"), ("rest", "string")]) == []
    clean = [read, fact("p::main", "call", 2, target="$call:2:1", callee="quote", inputs=["v"], arguments=[["v"]]), fact("p::quote", "return", 8, target="$return:0", inputs=["s"]), fact("p::main", "sink", 3, sink_kind="sql_query", inputs=["$call:2:1"]), fact("p::main", "sink", 4, sink_kind="network", inputs=["$call:2:1"])]
    both = {"main": [], "quote": [("s", "string")]}
    assert [r[2] for r in taint(spark, clean, **both)] == ["network", "sql_query"]
    assert [r[2] for r in taint(spark, clean, {"sanitizers": [{"function": "quote", "for": ["sql_query"]}]}, **both)] == ["network"]
    assert taint(spark, clean, {"sanitizers": [{"function": "quote"}]}, **both) == []


def test_sink_arguments():
    facts = parse("p/a.go", 'package p\n\nimport (\n\t"encoding/json"\n\t"os"\n)\n\nfunc run(a, b string, raw []byte) {\n\tos.WriteFile(a, b, 0)\n\tos.Rename(a, b)\n\tvar out T\n\tjson.Unmarshal(raw, out)\n}\n', "ex.io/p")["flow_facts"]
    sinks = [(f["callee"], f["inputs"]) for f in facts if f["kind"] == "sink"]
    assert sinks == [("os.WriteFile", ["a"]), ("os.Rename", ["a", "b"])]
    assert [(f["target"], f["source_kind"]) for f in facts if f["kind"] == "source"] == [("out", "decoded_json")]


def test_diffs(spark, g):
    old = g.replace(symbols=rel(spark, "symbols", sym("Gone", name="Gone"), sym("Kept", name="Kept", signature="func Kept()"), sym("S", "struct", "S", struct_fields=[("A", "int", ""), ("B", "int", "")])))
    new = g.replace(symbols=rel(spark, "symbols", sym("New", name="New"), sym("Kept", name="Kept", signature="func Kept(x int)"), sym("S", "struct", "S", struct_fields=[("A", "string", ""), ("C", "int", "")])))
    got = {(r["id"], r["change"], r["breaking"]) for r in diffs.api_drift(old, new).collect()}
    assert {("Gone", "removed", True), ("New", "added", False), ("Kept", "changed", True), ("S.A", "changed", True), ("S.B", "removed", True), ("S.C", "added", False)} == got
    pairs = spark.createDataFrame([("f", 1, 1), ("f", 2, 3), ("f", 3, 2), ("h", 1, 1), ("h", 2, 2)], "file string, old_line int, new_line int")
    assert {r["file"]: r["reordered"] for r in diffs.order_changed(pairs).collect()} == {"f": True, "h": False}


def test_flow(spark):
    fact = lambda fn, kind, **m: {"function_id": fn, "function": fn, "file": "a.go", "kind": kind, "inputs": [], "arguments": [], "line": 1, "column": 1} | m
    rows = [
        fact("h", "source", target="r", source_kind="http_request"), fact("h", "transfer", target="name", inputs=["r.Form"]),
        fact("h", "call", callee="save", target="$call:1:1", arguments=[["name"]]), fact("save", "transfer", target="path", inputs=["p"]), fact("save", "sink", sink_kind="filesystem", inputs=["path"], line=9),
        fact("h", "call", callee="clean", target="safe", arguments=[["name"]], line=2), fact("h", "sink", sink_kind="sql_query", inputs=["safe"], line=7), fact("h", "sink", sink_kind="sql_query", inputs=["other"], line=8),
    ]
    g = CodeGraph(spark, {"flow_facts": rel(spark, "flow_facts", *rows), "flow_functions": rel(spark, "flow_functions", {"id": "save", "name": "save", "params": [("p", "string")]})})
    found, report = flow.flow(g, {"sanitizers": [{"function": "clean", "for": ["sql_query"]}]})
    assert [(r["sink_function"], r["line"], r["severity"], r["confidence"]) for r in found.collect()] == [("save", 9, "high", "high")] and report["complete"]
    found, _ = flow.flow(g)
    assert {(r["line"], r["confidence"]) for r in found.collect()} == {(9, "high"), (7, "low")}
    assert flow.budget(10) == 2_000_000 and flow.budget(10**9) == 2_000_000_000


def test_go_reader():
    f = parse("shop/a.go", SOURCE, "ex.io/shop")
    s = {x["id"]: x for x in f["symbols"]}
    load = s["ex.io/shop::(*Item).Load"]
    assert load["arity"] == 3 and load["kind"] == "method" and load["method_signature"] == "(*sql.DB, int, int) (string, error)"
    assert s["ex.io/shop::Store"]["interface_methods"] == {"Find": "(string) (string, error)", "Save": "(string, string) error"}
    item = s["ex.io/shop::Item"]
    assert [x["name"] for x in item["struct_fields"]] == ["ID", "Name", "Base", "Tags"] and item["embedded_structs"] == ["*Base"]
    assert [(e["key"], e["accessor"]) for e in f["env_reads"]] == [("SHOP_KEY", "os.Getenv")]
    assert [(q["verb"], q["tables"]) for q in f["sqls"]] == [("SELECT", [{"name": "items", "access": "read"}])]
    assert [(e["message"], e["function"]) for e in f["errors"]] == [("gone %d", "init")]
    usage = {c["callee_raw"]: c["return_usage"] for c in f["calls"]}
    assert usage["work"] == "goroutine" and usage["rows.Close"] == "deferred" and usage["helper"] == "returned" and usage["env.Getenv"] == "assigned"
    assert {c["name"]: c["complexity"] for c in f["complexity"]}["(*Item).Load"] == 4
    assert [m["field"] for m in f["mutations"]] == ["Name"] and f["mutations"][0]["type_name"] == "Item"
    assert {c["kind"] for c in f["concurrency"]} == {"goroutine"}


def test_lexer():
    assert [t.text for t in tokens("a := `x\ny` /* z */ + \"q\\n\"")] == ["a", ":=", "`x\ny`", "+", '"q\\n"']
    assert unquote('"a\\n\\x41\\u00e9"') == "a\nAé" and unquote("`a\\n`") == "a\\n"
    same = lambda a, b: digest(tokens(a)) == digest(tokens(b))
    assert same("f( x ) // c", "f(x)") and not same("f(x)", "f(y)")


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "src/shop").mkdir(parents=True)
    (tmp_path / "src/vendor").mkdir()
    (tmp_path / "src/shop/a.go").write_text(SOURCE)
    (tmp_path / "src/vendor/v.go").write_text("package v")
    (tmp_path / "src/shop/gen.pb.go").write_text("package v")
    (tmp_path / "src/go.mod").write_text("module ex.io\n\nrequire (\n\ta.b/c v1.2.3\n\td.e/f v0.1.0 // indirect\n)\nrequire g.h/i v1.0.0\n")
    found = files.walk(spark, str(tmp_path / "src"))
    assert [r["path"] for r in found.collect()] == ["shop/a.go"]
    graph, extra = files.source_graph(found, "ex.io")
    assert aggs.fan_in(graph).where("target = 'ex.io/shop::helper'").first()["n"] == 1
    assert extra["strings"].where("text = 'SHOP_KEY'").count() == 1
    got = census.source(found.select("path", "text", "digest"), graph.symbols, "helper").first()
    assert got["status"] == "ok" and got["source"].startswith("func helper(")
    mods = {(r["module"], r["dependency"], r["version"]) for r in files.go_mod(spark, str(tmp_path / "src")).collect()}
    assert mods == {("ex.io", "a.b/c", "v1.2.3"), ("ex.io", "d.e/f", "v0.1.0"), ("ex.io", "g.h/i", "v1.0.0")}
    s = store.GraphStore(spark, str(tmp_path / "store"))
    s.publish(graph, "precise", "f1")
    with pytest.raises(ValueError):
        s.publish(graph, "ast", "f1")
    assert s.load().symbols.count() == graph.symbols.count() and s.current()["number"] == 1
    assert set(render.reports(graph)) >= {"index.md", "tests.md"} and len(render.reports(graph)) == 9
    assert json.loads(render.envelope(graph.symbols.select("id"), "x", "q", 2))["more"]
    (tmp_path / "c.out").write_text("mode: set\nm/a.go:1.2,3.4 2 1\nm/a.go:4.1,5.2 1 0\nbad\n")
    blocks = files.coverage_profile(spark, str(tmp_path / "c.out"))
    (tmp_path / "d.diff").write_text("--- a/m/a.go\n+++ b/m/a.go\n@@ -1,0 +2,3 @@\n+x\n@@ -9 +12 @@\n+y\n")
    lines = files.unified_diff(spark, str(tmp_path / "d.diff")).withColumn("file", F.lit("m/a.go"))
    assert sorted(r["line"] for r in lines.collect()) == [2, 3, 4, 12]
    report = aggs.uncovered_report(lines, blocks).first()
    assert (report["changed"], report["uncovered"]) == (4, 1)


def test_sessions(spark, tmp_path):
    rows = [("command", "s", "plan", "success"), ("command", "s", "review", "success"), ("command", "s", "x", "invocation_error"), ("command", "s", "y", "invocation_error")]
    log = spark.createDataFrame(rows, "type string, session_id string, command string, status string")
    a = aggs.audit(log, ["session_id"]).first()
    assert (a["success_rate"], a["composed"], a["raw"], a["composability"], a["score"], a["grade"]) == (100.0, 2, 0, 100.0, 100.0, "A")
    src = tmp_path / "events"
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:00", "plan", "success"), (1, "2024-01-01 01:00:00", "x", "failure"), (1, "2024-01-01 09:00:00", "plan", "success"), (2, "2024-01-03 00:00:00", "x", "success")], "user_id long, ts string, command string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.write.parquet(str(src))
    live = sessions.live_sessions(spark.readStream.schema(ev.schema).parquet(str(src)))
    q = live.writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["user_id"], r["commands"]) for r in spark.sql("SELECT * FROM live").collect()}
    assert got == {(1, 2), (1, 1)}  # the last session is still open
    assert sessions.live_sessions(ev).count() == 3
    adopt = incremental.adopt_sessions(
        spark.createDataFrame([("r", "2024-01-01 01:00:00"), ("r", "2024-01-05 00:00:00")], "root string, timestamp string").withColumn("timestamp", F.col("timestamp").cast("timestamp")),
        spark.createDataFrame([("s1", "r", "2024-01-01 00:00:00", "2024-01-02 00:00:00")], "session_id string, root string, created_at string, ended_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "ended_at")}),
    )
    assert sorted(str(r["session_id"]) for r in adopt.collect()) == ["None", "s1"]


def test_workspace(spark):
    imports = spark.createDataFrame([("a", "x.go", "pa", "ex.io/b/lib", "")], "repository_id string, from_file string, from_package string, import_path string, alias string")
    owners = workspace.module_owners(spark.createDataFrame([("ex.io/a", "a"), ("ex.io/b", "b")], "path string, repository_id string"))
    assert [(r["owner"], r["resolution_status"]) for r in workspace.cross_imports(imports, owners).collect()] == [("b", "exact")]
    calls = spark.createDataFrame([("a", "m", None, "lib.Do", "x.go", 1, 1, False)], "repository_id string, caller_symbol_id string, callee_symbol_id string, callee_raw string, file string, line int, column int, synthetic boolean")
    symbols = spark.createDataFrame([("b", "ex.io/b/lib::Do")], "repository_id string, id string")
    assert [(r["target"], r["resolution_status"]) for r in workspace.cross_calls(calls, imports, symbols).collect()] == [("ex.io/b/lib::Do", "possible")]


def test_loop_equals_plain(spark):
    import random

    rng = random.Random(4)
    edges = {(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(60)}
    want = {}
    for s in ("1", "2"):
        depth, front = {s: 0}, [s]
        while front:
            front = [d for x in front for a, d in edges if a == x and d not in depth and not depth.update({d: depth[x] + 1})]
        want |= {(s, k): v for k, v in depth.items()}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    start = spark.createDataFrame([("1", "1"), ("2", "2")], "seed string, id string")
    assert {(r["seed"], r["id"]): r["depth"] for r in fixpoint.closure(e, start).collect()} == want
    lab = fixpoint.labelled(e.withColumn("exact", F.col("src") < "3"), start)
    assert lab.where("resolution = 'exact'").count() <= len(want) == lab.count()
    need = spark.createDataFrame([("g", "1"), ("g", "2"), ("h", "3")], "g string, k string")
    have = spark.createDataFrame([("o", "1"), ("o", "2"), ("p", "1"), ("p", "3")], "o string, k string")
    assert {tuple(r) for r in joins.divide(need, have, "g", "o", ["k"]).collect()} == {("g", "o"), ("h", "p")}
