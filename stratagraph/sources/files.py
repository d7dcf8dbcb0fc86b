"""Readers: source trees, graph documents, logs, profiles, diffs, policies (SRC family).

All of them go through Spark's readers, so inputs may be in any store Spark
can open.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratagraph.functions import expr as E
from stratagraph.plans.graph import CodeGraph
from stratagraph.plans.schema import RELATIONS

MAX_FILE = 8 << 20


def walk(spark: SparkSession, root: str, pattern: str = "*.go", exclude: list[str] | None = None, ignored: DataFrame | None = None, max_bytes: int = MAX_FILE) -> DataFrame:
    """SRC-01..04, 06, 07: (path, text, digest, length) of source files below ``root``.

    Ignored and excluded folders, generated files and files over ``max_bytes`` are left out;
    ``ignored`` (path) lists what version control ignores.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).where(F.col("length") <= max_bytes)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace(F.col("path"), r"^[a-zA-Z]+:/*", ""), "^.*?" + re.escape(base.lstrip("/")) + "/", "")
    out = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("digest"), "length")
    out = out.where(~E.ignored_dir("path") & ~E.generated_file("path", "text"))
    if exclude:
        out = out.where(~E.under_excluded("path", exclude))
    return out if ignored is None else out.join(ignored, "path", "left_anti")


def build_selection(spark: SparkSession, tags: list[str] | None = None, goos: str = "linux", goarch: str = "amd64", module_mode: str = "mod") -> DataFrame:
    """SRC-05: the selection parameters and their fingerprint, one row."""
    row = (",".join(sorted(tags or [])), goos, goarch, module_mode)
    return spark.createDataFrame([row], "tags string, goos string, goarch string, module_mode string").withColumn("fingerprint", F.sha2(F.concat_ws("\n", "tags", "goos", "goarch", "module_mode"), 256))


def active_files(files: DataFrame, goos: str = "linux", goarch: str = "amd64", tags: tuple[str, ...] = ()) -> DataFrame:
    """Files whose name and first build line fit the selection."""
    systems, machines = ("linux", "darwin", "windows", "freebsd"), ("amd64", "arm64", "386", "arm", "wasm")
    stem = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.go$", ""), "_test$", "")
    last = F.element_at(F.split(stem, "_"), -1)
    fits = ~F.contains(stem, F.lit("_")) | (~last.isin(*[s for s in systems if s != goos]) & ~last.isin(*[m for m in machines if m != goarch]))
    line = F.regexp_extract("text", r"(?m)^//go:build ([^\n]*)$", 1)
    known = {goos, goarch, *tags, "unix", "gc"}
    one = line.rlike(r"^!?\w+$")
    name = F.regexp_replace(line, "!", "")
    holds = F.when(line == "", True).when(one, name.isin(*known) != line.startswith("!")).otherwise(True)
    return files.where(fits & holds)


def parse_sources(files: DataFrame, import_prefix: str = "") -> DataFrame:
    """SRC-08: one pass over the files; rows (kind, data) where data is the fact as JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from stratagraph.golang.parser import parse

        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                folder = path.rpartition("/")[0]
                facts = parse(path, text or "", "/".join(x for x in (import_prefix, folder) if x))
                rows = [(k, json.dumps(r)) for k, rs in facts.items() for r in rs]
                if rows:
                    yield pd.DataFrame(rows, columns=["kind", "data"])

    return files.select("path", "text").mapInPandas(run, "kind string, data string")


EXTRA = {"strings": "file string, line int, text string", "complexity": "id string, name string, file string, line int, complexity int"}


def facts(parsed: DataFrame, kind: str) -> DataFrame:
    """One relation of parsed facts."""
    return parsed.where(F.col("kind") == kind).select(F.from_json("data", EXTRA.get(kind) or RELATIONS[kind]).alias("r")).select("r.*")


def source_graph(files: DataFrame, import_prefix: str = "") -> tuple[CodeGraph, dict[str, DataFrame]]:
    """A graph without typed facts, and the extra relations (string tokens, complexity)."""
    parsed = parse_sources(files, import_prefix).persist()
    kinds = ("files", "symbols", "imports", "calls", "env_reads", "routes", "sqls", "errors", "concurrency", "test_edges", "mutations", "literals", "http_calls", "flow_facts", "flow_functions")
    rel = {k: facts(parsed, k) for k in kinds}
    rel["files"] = rel["files"].drop("content_digest").join(files.select("path", F.col("digest").alias("content_digest")), "path", "left")
    folder = F.regexp_replace("file", "/?[^/]*$", "")
    rel["packages"] = rel["symbols"].groupBy("package_name", folder.alias("dir")).agg(F.array_sort(F.collect_set("file")).alias("files")).select(F.concat_ws("/", F.lit(import_prefix), F.nullif("dir", F.lit(""))).alias("id"), F.col("package_name").alias("name"), F.concat_ws("/", F.lit(import_prefix), F.nullif("dir", F.lit(""))).alias("import_path_best_effort"), "dir", "files")
    own = rel["symbols"].where("kind IN ('function', 'method')").select(F.col("id").alias("_id"), F.col("name").alias("_n"), F.col("package_name").alias("_p"), "receiver").where("receiver = ''")
    where = rel["files"].select(F.col("path").alias("file"), F.col("package_name").alias("_p"))
    calls = rel["calls"].drop("callee_symbol_id").join(where, "file", "left").join(own.select("_id", "_n", "_p").dropDuplicates(["_n", "_p"]), (F.col("callee_raw") == F.col("_n")) & (rel["calls"]["callee_raw"].isNotNull()) & (where["_p"] == own["_p"]), "left")
    rel["calls"] = calls.withColumn("callee_symbol_id", F.col("_id")).select(*[f.split()[0] for f in RELATIONS["calls"].split(", ")])
    return CodeGraph(files.sparkSession, rel), {k: facts(parsed, k) for k in EXTRA}


def go_mod(spark: SparkSession, root: str) -> DataFrame:
    """SRC-09, SRC-10: (dir, module, dependency, version) of every module file."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "go.mod").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_replace("value", r"//[^\n]*", "")
    blocks = F.concat(F.array_join(F.regexp_extract_all(body, F.lit(r"(?s)require\s*\(([^)]*)\)"), F.lit(1)), "\n"), F.lit("\n"), F.array_join(F.regexp_extract_all(body, F.lit(r"(?m)^require\s+([^(\s]\S*\s+\S+)"), F.lit(1)), "\n"))
    deps = F.filter(F.split(blocks, "\n"), lambda x: x.rlike(r"\S"))
    return raw.select(F.regexp_replace("path", "/go.mod$", "").alias("dir"), F.regexp_extract("value", r"(?m)^module\s+(\S+)", 1).alias("module"), F.explode_outer(F.transform(deps, lambda x: F.split(F.regexp_replace(x, r"^\s+", ""), r"\s+"))).alias("d")).select("dir", "module", F.get("d", F.lit(0)).alias("dependency"), F.get("d", F.lit(1)).alias("version"))


def graph_document(spark: SparkSession, path: str) -> CodeGraph:
    """SRC-11: a graph from one JSON document with an array for each relation; unknown members are ignored."""
    raw = spark.read.text(path, wholetext=True)
    doc = {name: f"array<struct<{', '.join(_pairs(ddl))}>>" for name, ddl in RELATIONS.items()}
    whole = raw.select(F.from_json("value", ", ".join(f"{n} {d}" for n, d in doc.items())).alias("g"))
    return CodeGraph(spark, {name: whole.select(F.explode(f"g.{name}").alias("r")).select("r.*") for name in RELATIONS})


def _pairs(ddl: str) -> list[str]:
    return [f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(ddl).fields]


def coverage_profile(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: blocks of a coverage profile; malformed lines are dropped."""
    p = r"^(.+):(\d+)\.(\d+),(\d+)\.(\d+) (\d+) (\d+)$"
    rows = spark.read.text(path).where(F.col("value").rlike(p))
    part = lambda i: F.regexp_extract("value", p, i)
    names = ("start_line", "start_col", "end_line", "end_col", "statements", "count")
    return rows.select(part(1).alias("file"), *[part(i + 2).cast("int").alias(n) for i, n in enumerate(names)])


def unified_diff(spark: SparkSession, path: str) -> DataFrame:
    """SRC-13: (file, line) that a diff without context adds or changes."""
    raw = spark.read.text(path, wholetext=True)
    parts = raw.select(F.explode(F.filter(F.split("value", r"(?m)^\+\+\+ "), lambda x: x.startswith("b/"))).alias("p"))
    hunks = parts.select(F.regexp_extract("p", r"^b/([^\n\t]+)", 1).alias("file"), F.explode(F.regexp_extract_all("p", F.lit(r"(?m)^@@ -\S+ \+(\d+(?:,\d+)?) @@"), F.lit(1))).alias("h"))
    start = F.element_at(F.split("h", ","), 1).cast("int")
    size = F.when(F.contains("h", F.lit(",")), F.element_at(F.split("h", ","), -1).cast("int")).otherwise(1)
    return hunks.select("file", start.alias("a"), size.alias("n")).where("n > 0").select("file", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("n") - 1)).alias("line"))


def session_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """SRC-14: session events; lines that aren't JSON are skipped."""
    reader = (spark.readStream if stream else spark.read).schema(RELATIONS["session_log"]).option("mode", "DROPMALFORMED")
    return reader.json(path)


def manifest(text: str) -> dict:
    """SRC-15: a workspace manifest (JSON, or YAML where a YAML reader is installed), validated."""
    try:
        spec = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("a JSON manifest is expected: no YAML reader is installed") from e
        spec = yaml.safe_load(text)
    repos = [r["id"] for r in spec.get("repositories", [])]
    if not repos or len(set(repos)) != len(repos):
        raise ValueError("repositories need distinct ids")
    for s in spec.get("scopes", []):
        if set(s["repositories"]) - set(repos):
            raise ValueError(f"scope {s['id']!r} names unknown repositories")
    return spec


def flow_policy(text: str) -> dict:
    """SRC-17: sanitizers, sources and sinks, validated."""
    spec = json.loads(text)
    if set(spec) - {"sanitizers", "sources", "sinks"}:
        raise ValueError("unknown members")
    for part in spec.values():
        for rule in part:
            if not rule.get("function"):
                raise ValueError("a rule needs a function")
            if rule.get("argument", 0) < 0 or rule.get("severity", "high") not in ("low", "medium", "high"):
                raise ValueError("invalid argument or severity")
    return spec


def fingerprint(files: DataFrame) -> DataFrame:
    """SCL-06: one hash over the sorted (path, digest) rows, by way of one hash for each folder."""
    per = files.groupBy(F.regexp_replace("path", "/?[^/]*$", "").alias("dir")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "digest"))), "\n"), 256).alias("h"))
    return per.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "dir", "h"))), "\n"), 256).alias("fingerprint"))
