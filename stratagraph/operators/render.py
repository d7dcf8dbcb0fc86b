"""Reports, wiki pages, diagrams and envelopes (SNK and REN families).

Counting and ranking happen in Spark; what is collected is a bounded page.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import aggs, census
from stratagraph.plans.graph import CodeGraph

PAGE = 1000


def table(df: DataFrame, limit: int = PAGE) -> str:
    """Rows as a Markdown table; one more row than the limit is noted."""
    rows = df.limit(limit + 1).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows[:limit]]
    return "\n".join(lines + (["", f"More than {limit} rows; query the relation for the rest."] if len(rows) > limit else []))


def important_files(g: CodeGraph, n: int = 20) -> DataFrame:
    """SNK-04: files by symbols plus calls."""
    both = g.symbols.groupBy("file").agg(F.count("*").alias("score")).unionByName(g.calls.groupBy("file").agg(F.count("*").alias("score")))
    return both.groupBy("file").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "file").limit(n)


def index_counts(g: CodeGraph) -> DataFrame:
    """SNK-03."""
    return g.symbols.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def tests_report(g: CodeGraph) -> DataFrame:
    """SNK-05."""
    return g.test_edges.dropDuplicates(["test_func", "target", "target_symbol_id"]).select("test_func", "target", "target_symbol_id", "file", "line").orderBy("test_func", "target", "target_symbol_id")


def reports(g: CodeGraph) -> dict[str, str]:
    """SNK-02: nine Markdown reports."""
    return {
        "index.md": "# Index\n\n" + table(index_counts(g)),
        "symbols.md": "# Important files\n\n" + table(important_files(g)),
        "deps.md": "# Imports\n\n" + table(g.imports.groupBy("import_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "import_path")),
        "routes.md": "# Routes\n\n" + table(census.routes(g).select("name", "file", "line", "detail")),
        "sql.md": "# SQL\n\n" + table(census.query_sql(g).select("verb", "access", "query", "function", "file", "line")),
        "errors.md": "# Errors\n\n" + table(g.errors.orderBy("message", "file", "line")),
        "config.md": "# Environment\n\n" + table(g.env_reads.select("key", "accessor", "file", "line").orderBy("key", "file", "line")),
        "concurrency.md": "# Concurrency\n\n" + table(g.concurrency.orderBy("kind", "file", "line")),
        "tests.md": "# Tests\n\n" + table(tests_report(g)),
    }


def wiki(g: CodeGraph, packages: Iterable[str] = ()) -> dict[str, str]:
    """SNK-06: overview, architecture, hotspots, and a page for each asked package."""
    pages = {"overview.md": "# Overview\n\n" + table(census.stats(g)), "architecture.md": "# Architecture\n\n" + mermaid(g.imports.select(F.col("from_package").alias("src"), F.col("import_path").alias("dst"))), "hotspots.md": "# Hotspots\n\n" + table(aggs.hotspot(g))}
    pages |= {name: text for name, text in reports(g).items() if name in ("routes.md", "errors.md", "concurrency.md")}
    for p in packages:
        pages[f"packages/{p}.md"] = f"# {p}\n\n" + table(census.public(g, p).select("kind", "name", "signature"))
    return pages


def envelope(df: DataFrame, command: str, query: str, limit: int = 100, complete: bool = True, state: dict | None = None) -> str:
    """SNK-07: rows of a page as a JSON answer that tells its completeness."""
    rows = [json.loads(r) for r in df.limit(limit + 1).toJSON().collect()]
    return json.dumps({"schema_version": "2", "command": command, "query": query, "status": "ok" if rows else "empty", "count": min(len(rows), limit), "results": rows[:limit], "more": len(rows) > limit, "completeness": "complete" if complete else "partial", "graph_state": state or {}})


def files_only(df: DataFrame) -> DataFrame:
    """SNK-08."""
    return df.select("file").distinct().orderBy("file")


def mermaid(edges: DataFrame, direction: str = "LR", limit: int = PAGE) -> str:
    """REN-01..04: distinct (src, dst) edges, optionally labelled, as a diagram."""
    label = [c for c in ("label",) if c in edges.columns]
    rows = edges.select("src", "dst", *label).distinct().orderBy("src", "dst").limit(limit).collect()
    ids: dict[str, str] = {}
    node = lambda x: ids.setdefault(x, f"n{len(ids)}")
    arrows = [f"  {node(r['src'])} -->{'|' + r['label'] + '|' if label and r['label'] else ''} {node(r['dst'])}" for r in rows]
    return "\n".join([f"graph {direction}", *(f'  {i}["{x.replace(chr(34), chr(39))}"]' for x, i in ids.items()), *arrows])


def walk_edges(edges: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """The edges (src, dst) among nodes of a walk (id, depth) up to ``depth``; for the diagrams of callers, callees and impact."""
    r = reached.where(F.col("depth") <= depth).select("id").distinct()
    return edges.join(r.withColumnRenamed("id", "src"), "src", "left_semi").join(r.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def fixed_width(df: DataFrame, limit: int = 50) -> str:
    """REN-05: a text table."""
    rows = [[str(v) for v in r] for r in df.limit(limit).collect()]
    width = [max(len(c), *(len(r[i]) for r in rows)) if rows else len(c) for i, c in enumerate(df.columns)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in width]), *map(line, rows)])


def audit_report(audit: DataFrame, as_json: bool = False, limit: int = 200) -> str:
    """REN-06."""
    return envelope(audit, "session audit", "", limit) if as_json else fixed_width(audit, limit)
