"""Reachability without a row for each pair, against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from stratagraph.operators import flow, traverse
from stratagraph.plans import fixpoint
from stratagraph.plans.graph import CodeGraph


def walk(edges, start):
    seen, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in edges:
            if a == at and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def edge_frame(spark, edges):
    return spark.createDataFrame(sorted(edges), "src string, dst string")


def random_edges(seed, nodes, n):
    r = random.Random(seed)
    return {(f"n{r.randrange(nodes)}", f"n{r.randrange(nodes)}") for _ in range(n)}


@pytest.fixture
def written(monkeypatch):
    """Rows of everything that fixed points write."""
    rows, cut = [], fixpoint.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(fixpoint, "cut", counted)
    return rows


@pytest.mark.parametrize("nodes, n", [(12, 10), (40, 70), (30, 25)])
def test_pairs(spark, nodes, n):
    edges = random_edges(n, nodes, n) | {("m1", "m2"), ("m2", "m1"), ("self", "self")}
    # A seed of several nodes, one that isn't in the graph and one that only meets itself.
    starts = {(f"s{i % 9}", f"n{i}") for i in range(nodes)} | {("far", "absent"), ("self", "self"), ("s1", "m1")}
    ends = {f"n{i}" for i in range(0, nodes, 2)} | {"absent", "self", "m2"}
    got = [tuple(r) for r in fixpoint.pairs(edge_frame(spark, edges), spark.createDataFrame(sorted(starts), "seed string, id string"), spark.createDataFrame([(x,) for x in sorted(ends)], "id string")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(s, x) for s, at in starts for x in walk(edges, at) & ends}


def test_components(spark):
    edges = {("b", "a"), ("b", "c"), ("x", "y"), ("z", "y"), ("l", "l"), *((f"p{i:02}", f"p{i + 1:02}") for i in range(40))}
    got = {}
    for r in fixpoint.components(edge_frame(spark, edges)).collect():
        got.setdefault(r["part"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted([["a", "b", "c"], ["x", "y", "z"], [f"p{i:02}" for i in range(41)]])


def test_taint_writes_no_row_for_each_pair(spark, written):
    edges = random_edges(3, 150, 600)
    every = spark.createDataFrame([(f"n{i}",) for i in range(150)], "function string")
    got = {tuple(r) for r in flow.reach(every, edge_frame(spark, edges), every.where("function IN ('n1', 'n2')")).collect()}
    assert got == {(f"n{i}", x) for i in range(150) for x in walk(edges, f"n{i}") & {"n1", "n2"}} and len(got) > 200
    assert sum(written) < 150 * 150 / 3


def graph(spark, **rels):
    from test_operators import rel

    return CodeGraph(spark, {k: rel(spark, k, *v) for k, v in rels.items()})


def test_tests_are_counted_without_pairs(spark, written):
    r = random.Random(5)
    calls = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}", r.choice(["resolved_static", "cha_possible_target"])) for _ in range(170)]
    tests = [(f"t{i % 250}", f"n{r.randrange(60)}", r.choice(["resolved_static", ""])) for i in range(300)] + [("n1", "n2", ""), ("n2", "n1", "resolved_static")]
    g = graph(spark, calls=[{"caller_symbol_id": a, "callee_symbol_id": b, "resolution": x} for a, b, x in calls], test_edges=[{"test_func": a, "target_symbol_id": b, "resolution": x} for a, b, x in tests])
    got = {(x["id"], x["exact_tests"], x["tests"]) for x in traverse.test_reach(g, g.test_edges.selectExpr("test_func AS id")).collect()}
    ways = {e: [(a, b) for a, b, x in calls + tests if not e or x == "resolved_static"] for e in (True, False)}
    hit = {e: [x for t in {t for t, _, _ in tests} for x in walk(ways[e], t) - {t}] for e in ways}
    assert got == {(x, hit[True].count(x), hit[False].count(x)) for x in set(hit[False])}
    assert sum(written) < len(hit[False]) + len(hit[True])


def test_trace_keeps_one_path_a_node(spark, written):
    r = random.Random(7)
    calls = {(f"n{r.randrange(90)}", f"n{r.randrange(90)}") for _ in range(400)}
    handlers = ["n3", "n50", "n71", "n72"]
    g = graph(spark, calls=[{"caller_symbol_id": a, "callee_symbol_id": b} for a, b in calls], routes=[{"handler": h} for h in handlers], errors=[{"message": "broke", "function": f"n{i}"} for i in range(0, 90, 2)] + [{"message": "broke", "function": "lone"}])
    got = {x["seed"]: x["path"] for x in traverse.trace(g, "broke", 0).collect()}
    used = sum(written)
    start = spark.createDataFrame([(f"n{i}", f"n{i}") for i in range(0, 90, 2)], "seed string, id string")
    every = fixpoint.best_paths(edge_frame(spark, {(b, a) for a, b in calls}), start, [F.lit(0), F.lit(1)]).collect()
    want = {}
    for x in sorted((x for x in every if x["id"] in handlers), key=lambda x: (x["rank"]["r1"], x["id"]), reverse=True):
        want[x["seed"]] = x["path"][::-1]
    assert got == want and len(want) > 30 and max(map(len, want.values())) > 2
    assert used < 90 * 6


def flow_graph(spark, facts, functions):
    from test_operators import fact

    return graph(spark, flow_facts=[fact(f"p::{a}", kind, line, **more) for a, kind, line, more in facts], flow_functions=[{"id": f"p::{n}", "name": n, "file": "p/a.go", "params": [("s", "string")]} for n in functions])


def findings(df):
    return sorted((r["source_function"], r["source_line"], r["sink_function"], r["sink_kind"], r["line"], r["severity"], r["confidence"]) for r in df.collect())


def test_flow_without_paths_finds_the_same(spark):
    call = lambda a, to, line, by: (a, "call", line, {"target": f"$call:{line}:1", "callee": to, "inputs": [by], "arguments": [[by]]})
    facts = [
        ("a", "source", 1, {"target": "v", "source_kind": "environment"}), ("b", "source", 2, {"target": "w.x", "source_kind": "http_request"}), ("a", "source", 9, {"target": "other", "source_kind": "environment"}),
        call("a", "mid", 3, "v"), call("b", "mid", 4, "w"), call("mid", "quote", 5, "s"), call("mid", "out.side", 6, "s"), call("mid", "mid", 16, "s"),
        ("quote", "return", 7, {"target": "$return:0", "inputs": ["s"]}), ("mid", "return", 8, {"target": "$return:0", "inputs": ["$call:5:1"]}),
        *((f, "sink", line, {"sink_kind": kind, "inputs": [by]}) for f, line, kind, by in [("mid", 10, "sql_query", "$call:5:1"), ("mid", 11, "network", "$call:5:1"), ("mid", 12, "network", "$call:6:1"), ("a", 13, "network", "$call:3:1"), ("b", 14, "sql_query", "$call:4:1"), ("a", 15, "filesystem", "other"), ("b", 17, "filesystem", "w")]),
    ]
    g = flow_graph(spark, facts, ["a", "b", "mid", "quote"])
    policy = {"sanitizers": [{"function": "quote", "for": ["sql_query"]}]}
    want, _ = flow.flow(g, policy)
    got, report = flow.flow(g, policy, paths=False)
    assert "path" not in got.columns and report["complete"]
    assert findings(got) == findings(want) and {r[-1] for r in findings(got)} == {"high", "low"} and len(findings(got)) > 6
    alone = flow_graph(spark, [facts[2], facts[-2]], ["a"])  # a source and its sink with no step between
    assert [r[:5] for r in findings(flow.flow(alone, paths=False)[0])] == [("p::a", 9, "p::a", "filesystem", 15)]


def test_sources_share_one_propagation(spark, written, monkeypatch):
    monkeypatch.setattr(flow, "cut", fixpoint.cut)
    edges = {(a, b) for a, b in random_edges(11, 40, 110) if a != b}
    end = max((f"n{i}" for i in range(40)), key=lambda x: len(walk({(b, a) for a, b in edges}, x)))
    facts = [(f"n{i}", "source", 1, {"target": "s", "source_kind": "environment"}) for i in range(40)] + [(end, "sink", 2, {"sink_kind": "sql_query", "inputs": ["s"]})]
    facts += [(a, "call", 10 + int(b[1:]), {"target": "$call:" + b, "callee": b, "inputs": ["s"], "arguments": [["s"]]}) for a, b in edges]
    got, report = flow.flow(flow_graph(spark, facts, [f"n{i}" for i in range(40)]), k=1, paths=False)
    assert {(r[0], r[2]) for r in findings(got)} == {(f"p::n{i}", f"p::{end}") for i in range(40) if end in walk(edges, f"n{i}")} and len(findings(got)) > 20
    assert report["attempted"] < 40 * len(edges) / 4


def test_call_strings_only_where_a_value_returns(spark):
    layers = [[f"l{i}x{j}" for j in range(5)] for i in range(4)]
    call = lambda a, to, line: (a, "call", line, {"target": f"$call:{line}:1", "callee": to, "inputs": ["s"], "arguments": [["s"]]})
    facts = [(f, "source", 1, {"target": "s", "source_kind": "environment"}) for f in layers[0]]
    facts += [call(a, b, 10 + j) for x, y in zip(layers, layers[1:]) for a in x for j, b in enumerate(y)]
    facts += [call(f, "same", 20) for f in layers[-1]] + [("same", "return", 21, {"target": "$return:0", "inputs": ["s"]})]
    facts += [(f, "sink", 22, {"sink_kind": "sql_query", "inputs": ["$call:20:1"]}) for f in layers[-1]]
    # One sink that a certain and an uncertain value reach.
    facts += [call("l0x0", "out.side", 60), ("l0x0", "sink", 61, {"sink_kind": "network", "inputs": ["s", "$call:60:1"]})]
    got, report = flow.flow(flow_graph(spark, facts, [*sum(layers, []), "same"]), k=1, paths=False)
    want = [(f"p::{a}", 1, f"p::{b}", "sql_query", 22, "high", "high") for a in layers[0] for b in layers[-1]] + [("p::l0x0", 1, "p::l0x0", "network", 61, "medium", "high")]
    assert findings(got) == sorted(want) and report["complete"]
    assert report["attempted"] < 150  # each layer's functions once, not once for each way in
