"""Census queries: filter and project one relation, or unite several projections (PRJ family)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.plans.graph import CodeGraph


def row(df: DataFrame, kind: str | Column, name: str | Column, file: str | Column = "file", line: str | Column = "line", detail: Column | None = None, stable_id: Column | None = None, score: Column | None = None, status: Column | None = None) -> DataFrame:
    """The common result row of a relation."""
    text = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text(name).alias("name"),
        (stable_id if stable_id is not None else F.lit(None)).cast("string").alias("stable_id"), text(file).alias("file"),
        (F.col(line) if isinstance(line, str) else line).cast("int").alias("line"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"),
        (score if score is not None else F.lit(0)).cast("int").alias("score"), (status if status is not None else F.lit(None)).cast("string").alias("resolution_status"),
    )


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def has(column: str | Column, query: str) -> Column:
    """Substring without case."""
    return F.contains(F.lower(column), F.lit(query.lower()))


def no_tests(df: DataFrame, column: str = "file") -> DataFrame:
    """FIL-08: rows outside ``_test.go`` files."""
    return df.where(~E.is_test_file(column))


def ordered(df: DataFrame) -> DataFrame:
    """WIN-01 with a total order: score, name, then place."""
    return df.orderBy(F.desc("score"), "name", "kind", "file", "line", "detail")


def query(g: CodeGraph, terms: list[str]) -> DataFrame:
    """PRJ-01: rows of any relation that hold any of the terms, best first."""
    terms = [t.lower() for t in terms if t]
    any_of = lambda *cols: reduce(lambda a, b: a | b, [has(F.coalesce(c, F.lit("")), t) for c in map(_col, cols) for t in terms], F.lit(False))
    equal = lambda c: reduce(lambda a, b: a | b, [F.lower(c) == t for t in terms], F.lit(False))
    score = lambda c, base: F.when(equal(c), 100).otherwise(base)
    s = g.symbols
    fields = F.exists("struct_fields", lambda f: any_of(f["name"], f["type"]))
    parts = [
        row(g.packages.where(any_of("name", "import_path_best_effort")), "package", "name", F.col("dir"), F.lit(0), F.col("import_path_best_effort"), F.col("id"), score("name", 60)),
        row(g.files.where(any_of("path")), "file", "path", "path", F.lit(0), F.col("package_name"), F.col("id"), score("path", 30)),
        row(g.routes.where(any_of("path", "handler")), "route", F.concat_ws(" ", "method", "path"), detail=F.col("handler"), score=score("path", 50)),
        row(s.where(any_of("name", "id") | F.coalesce(fields, F.lit(False))), F.col("kind"), E.display_name(), detail=F.col("signature"), stable_id=F.col("id"), score=score("name", 40)),
        row(g.imports.where(any_of("import_path")), "import", "import_path", "from_file", F.lit(0), F.col("alias"), score=score("import_path", 20)),
        row(g.calls.where(~F.coalesce("synthetic", F.lit(False)) & any_of("callee_raw")), "call", "callee_raw", detail=F.col("caller_name"), stable_id=F.col("callee_symbol_id"), score=score("callee_raw", 10)),
        row(g.variable_uses.where(any_of("name")), "variable", "name", detail=F.col("function"), stable_id=F.col("symbol_id"), score=score("name", 15)),
    ]
    found = union(parts).groupBy("kind", "stable_id", "name", "file", "line").agg(F.max("score").alias("score"), F.min("detail").alias("detail"), F.min("resolution_status").alias("resolution_status"))
    return ordered(found.select("kind", "name", "stable_id", "file", "line", "detail", "score", "resolution_status"))


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node(g: CodeGraph, q: str) -> DataFrame:
    """PRJ-02."""
    low = q.lower()
    return union([
        row(g.packages.where(F.lower("name") == low), "package", "name", F.col("dir"), F.lit(0), stable_id=F.col("id")),
        row(g.files.where((F.lower("path") == low) | F.lower("path").endswith("/" + low)), "file", "path", "path", F.lit(0), stable_id=F.col("id")),
        row(g.symbols.where(E.match_symbol(q) | has("name", q) | has(E.display_name(), q)), F.col("kind"), E.display_name(), detail=F.col("signature"), stable_id=F.col("id")),
    ])


def focus(g: CodeGraph, package: str) -> DataFrame:
    """PRJ-03: a package's symbols and imports, its callees by frequency, and callers from outside."""
    inside = g.symbols.where(F.col("package_name") == package)
    files = inside.select("file").distinct()
    calls = g.calls.join(files, "file", "left_semi").groupBy("callee_raw").agg(F.count("*").alias("n"), F.max("file").alias("file"))
    outside = g.calls.join(files, "file", "left_anti").where(F.col("callee_raw").startswith(package + "."))
    return union([
        row(inside, F.col("kind"), E.display_name(), stable_id=F.col("id"), detail=F.col("signature")),
        row(g.imports.join(files, g.imports["from_file"] == files["file"], "left_semi").select("import_path", "from_file").distinct(), "import", "import_path", "from_file", F.lit(0)),
        row(calls, "callee", "callee_raw", line=F.lit(0), detail=F.concat("n", F.lit(" calls")), score=F.col("n")),
        row(outside, "caller", "caller_name", detail=F.col("callee_raw")),
    ])


def _first_match(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys).limit(1)


def fields(g: CodeGraph, struct: str) -> DataFrame:
    """PRJ-04: of the first matching struct only."""
    first = _first_match(g.symbols.where((F.col("kind") == "struct") & E.match_symbol(struct)), "file", "line", "id")
    return first.select("id", "file", F.posexplode("struct_fields").alias("pos", "f")).select("id", "file", "pos", "f.name", "f.type", "f.tag").orderBy("pos")


def embeds(g: CodeGraph, name: str) -> DataFrame:
    """PRJ-05."""
    return g.symbols.where((F.col("kind") == "struct") & (F.array_contains("embedded_structs", name) | F.array_contains("embedded_structs", "*" + name)))


def public(g: CodeGraph, package: str) -> DataFrame:
    """PRJ-06: exported symbols, the package by name, folder or import path."""
    p = package.strip("/")
    paths = g.packages.where((F.col("name") == p) | (F.col("dir") == p) | F.col("dir").endswith("/" + p) | F.col("import_path_best_effort").endswith("/" + p) | (F.col("import_path_best_effort") == p)).select(F.col("name").alias("package_name")).distinct()
    named = g.symbols.where(F.col("name").rlike("^[A-Z]"))
    return named.where(F.col("package_name") == p).unionByName(named.where(F.col("package_name") != p).join(paths, "package_name", "left_semi"))


def external_imports(g: CodeGraph, q: str = "") -> DataFrame:
    """PRJ-07."""
    return g.imports.where(has("import_path", q))


def routes(g: CodeGraph) -> DataFrame:
    """PRJ-08."""
    note = F.when(F.col("inline_body"), "inline handler").when(F.col("path") == "<unresolved path>", "unresolved path").otherwise("")
    return row(g.routes, "route", F.concat_ws(" ", "method", "path"), detail=F.concat_ws(" ", "handler", F.nullif(note, F.lit(""))))


def query_routes(g: CodeGraph, term: str = "", module: str | None = None, tests: bool = False) -> DataFrame:
    """PRJ-09: routes by term, owning module and test files."""
    out = g.routes if tests else no_tests(g.routes)
    if term:
        out = out.where(has("path", term) | has("handler", term) | has("file", term) | E.route_contains("path", term))
    if module is not None:
        from stratagraph.operators.joins import longest_prefix

        owner = longest_prefix(out.select("file").distinct(), g.modules.select("dir", F.col("id").alias("owner")), "file", "dir")
        out = out.join(owner.where(F.col("owner") == module).select("file"), "file", "left_semi")
    return out.orderBy("file", "line", "method", "path")


def query_sql(g: CodeGraph, verbs: list[str] | None = None, accesses: list[str] | None = None, tables: list[str] | None = None, term: str = "") -> DataFrame:
    """PRJ-10 with FIL-13: any of each list; a table by its last part, or all parts."""
    out = g.sqls
    if verbs:
        out = out.where(F.upper("verb").isin([v.upper() for v in verbs]))
    if accesses:
        out = out.where(F.col("access").isin(accesses))
    if tables:
        out = out.where(reduce(lambda a, b: a | b, [_names_table(n.lower()) for n in tables]))
    if term:
        out = out.where(has("query", term))
    return out.orderBy(F.lower("query"), "file", "line", "function")


def _names_table(name: str) -> Column:
    last = lambda t: F.element_at(F.split(F.lower(t["name"]), r"\."), -1)
    if "." in name:
        return F.exists("tables", lambda t: F.lower(t["name"]) == name)
    return F.exists("tables", lambda t: last(t) == name)


def errors(g: CodeGraph, q: str = "", tests: bool = True) -> DataFrame:
    """PRJ-11."""
    out = g.errors.where(has("message", q))
    return out if tests else no_tests(out)


def envs(g: CodeGraph, q: str = "") -> DataFrame:
    """PRJ-12."""
    return g.env_reads.where(has("key", q) | has("accessor", q))


def http_calls(g: CodeGraph, q: str = "") -> DataFrame:
    """PRJ-13."""
    return g.http_calls.where(has("method", q) | has("url", q) | has("function_name", q))


def concurrency(g: CodeGraph, q: str = "") -> DataFrame:
    """PRJ-14."""
    return g.concurrency.where(has("kind", q) | has("function", q))


def globals_(g: CodeGraph, package: str) -> DataFrame:
    """PRJ-15: package-level values and who changes them."""
    own = g.symbols.where(F.col("kind").isin("var", "const") & (F.col("package_name") == package))
    m = g.mutations.select(F.col("field").alias("_f"), F.col("function").alias("mutator"), F.col("file").alias("at_file"), F.col("line").alias("at_line"))
    return own.join(m, own["name"] == m["_f"], "left").select("id", "kind", "name", "file", "line", "mutator", "at_file", "at_line")


def fixtures(g: CodeGraph) -> DataFrame:
    """PRJ-16."""
    return g.symbols.where(E.is_test_file("file") & ~F.col("name").rlike("^(Test|Benchmark|Example)"))


def schema(g: CodeGraph, table: str) -> DataFrame:
    """PRJ-17: the first field of each struct whose tag has the table's name between marks."""
    t = table.lower()
    spelled = (f'"{t}"', f"'{t}'", f':{t}"', f":{t}'", f'"{t},', f"'{t},")
    hit = F.filter("struct_fields", lambda f: reduce(lambda a, b: a | b, [F.contains(F.lower(f["tag"]), F.lit(x)) for x in spelled]))
    return g.symbols.where(F.col("kind") == "struct").withColumn("hit", F.element_at(F.nullif(hit, F.array().cast(g.symbols.schema["struct_fields"].dataType)), 1)).where("hit IS NOT NULL").select("id", "name", "file", "line", "hit.name", "hit.tag").toDF("id", "struct", "file", "line", "field", "tag")


def constructors(g: CodeGraph, type_name: str) -> DataFrame:
    """PRJ-18: functions and methods with the type after the last ``) `` of their signature; ``package.Type`` also bare in its package."""
    result = F.regexp_extract("signature", r"(?s)^.*(\) .*)$", 1)
    hit = result.rlike(rf"[* .]{_quoted(type_name)}([,) ]|$)")
    if type_name.count(".") == 1:
        package, bare = type_name.split(".")
        hit |= (F.lower("package_name") == package.lower()) & result.rlike(rf"[* ]{_quoted(bare)}([,) ]|$)")
    return g.symbols.where(F.col("kind").isin("function", "method") & hit)


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def literals(g: CodeGraph, type_name: str) -> DataFrame:
    """PRJ-19: composite literals of the type, also as ``package.Type`` by folder."""
    out = F.col("type_name") == type_name
    if "." in type_name:
        package, _, name = type_name.rpartition(".")
        out |= (F.col("type_name") == name) & (F.element_at(F.split("file", "/"), -2) == package)
    return g.literals.where(out)


def mutate(g: CodeGraph, field: str, type_name: str | None = None) -> DataFrame:
    """PRJ-20: who writes a field; without any, a limit row for each declared field."""
    hit = F.lower("field") == field.lower()
    if type_name:
        hit &= E.mutation_type_matches("type_name", type_name)
    found = row(g.mutations.where(hit), "mutation", "function", detail=F.concat_ws(".", "type_name", "field"))
    declared = g.symbols.where("kind = 'struct'").select("id", "name", "file", "line", F.explode("struct_fields").alias("f")).where(F.lower("f.name") == field.lower())
    limit = row(declared, "limit", F.concat_ws(".", "name", "f.name"), detail=F.lit("declared; no write found"), stable_id=F.col("id"))
    return found.unionByName(limit.join(found.limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti"))


def return_usages(g: CodeGraph, function: str) -> DataFrame:
    """PRJ-21: one row for each call site, with what becomes of the result."""
    f = function.lower()
    hit = (F.lower("callee_raw") == f) | F.lower("callee_raw").endswith("." + f)
    out = g.calls.where(hit).withColumn("usage", E.usage_label())
    return out.dropDuplicates(["caller_symbol_id", "caller_name", "file", "line", "column", "callee_raw"]).select("caller_name", "callee_raw", "file", "line", "column", "usage")


def usages(g: CodeGraph, name: str) -> DataFrame:
    """PRJ-22: where a type, variable or constant is used."""
    s = g.symbols
    inner = s.where("kind = 'struct'").select("id", "name", "file", "line", F.explode("struct_fields").alias("f"))
    methods = s.where("kind = 'interface'").select("id", "name", "file", "line", F.explode("interface_methods").alias("m", "sig"))
    return union([
        row(g.variable_uses.where(F.lower("name") == name.lower()), "variable use", "function", stable_id=F.col("symbol_id"), detail=F.col("name")),
        row(s.where(F.col("kind").isin("function", "method") & E.contains_type("signature", name)), "signature", E.display_name(), stable_id=F.col("id"), detail=E.signature_usage("signature", name)),
        row(inner.where(E.contains_type(F.col("f.type"), name)), "field", F.concat_ws(".", "name", "f.name"), stable_id=F.col("id"), detail=F.col("f.type")),
        row(methods.where(E.contains_type(F.col("sig"), name)), "interface method", F.concat_ws(".", "name", "m"), stable_id=F.col("id"), detail=F.col("sig")),
        row(g.literals.where(F.col("type_name") == name), "literal", "function", detail=F.col("type_name")),
    ])


def field_usages(g: CodeGraph, type_name: str, field: str) -> DataFrame:
    """PRJ-23: declarations, and uses by the owning type."""
    declared = g.symbols.where((F.col("kind") == "struct") & E.match_symbol(type_name)).select("id", "name", "file", "line", F.explode("struct_fields").alias("f")).where(F.col("f.name") == field)
    uses = g.field_uses.where((F.lower("type_name") == type_name.lower().rpartition(".")[2]) & (F.col("field") == field))
    return row(declared, "declaration", F.concat_ws(".", "name", "f.name"), stable_id=F.col("id"), detail=F.col("f.type")).unionByName(row(uses, "use", "function", detail=F.col("access")))


def arity(g: CodeGraph, least: int) -> DataFrame:
    """PRJ-24."""
    return g.symbols.where(F.col("kind").isin("function", "method") & (F.col("arity") >= least)).orderBy(F.desc("arity"), "name", "id")


def string_literals(tokens: DataFrame, symbols: DataFrame, terms: list[str]) -> DataFrame:
    """PRJ-25: string tokens (file, line, text) with any term, and the innermost function around them."""
    from stratagraph.operators.joins import enclosing

    hit = reduce(lambda a, b: a | b, [has("text", t) for t in terms])
    return enclosing(tokens.where(hit), symbols.where(F.col("kind").isin("function", "method")))


def source(texts: DataFrame, symbols: DataFrame, q: str, limit: int = 65536) -> DataFrame:
    """PRJ-26: the lines of the best matching symbol from (path, text, digest); status tells why there are none.

    Exact matches come before fuzzy ones, then those with the same case; more than one is ambiguous.
    """
    rank = F.when(E.match_symbol_exact(q), 0).otherwise(2) - F.when(F.contains(F.col("id"), F.lit(q)) | (F.col("name") == q), F.lit(1)).otherwise(0)
    found = symbols.where(E.match_symbol(q) | E.match_symbol_exact(q)).withColumn("rank", rank)
    best = found.withColumn("least", F.min("rank").over(Window.partitionBy(F.lit(1)))).where("rank = least").withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    lines = F.array_join(F.slice(F.split("text", "\n"), F.col("line"), F.col("end_line") - F.col("line") + 1), "\n")
    out = best.join(texts, best["file"] == texts["path"], "left").withColumn("source", lines)
    status = F.when(F.col("n") > 1, "ambiguous").when(F.col("text").isNull(), "no source").when(F.col("digest") != F.sha2("text", 256), "source changed").when(F.length("source") > limit, "too large").otherwise("ok")
    return out.select("id", "file", "line", "end_line", status.alias("status"), F.when(status == "ok", F.col("source")).alias("source"))


def skeleton(g: CodeGraph, file: str | None = None) -> DataFrame:
    """PRJ-27, PRJ-28: declarations of each package by name."""
    s = g.symbols if file is None else g.symbols.where(F.col("file") == file)
    lines = F.array_sort(F.collect_list(F.struct(E.display_name().alias("name"), "line", F.coalesce(F.nullif("signature", F.lit("")), F.concat_ws(" ", "kind", "name")).alias("text"))))
    return s.groupBy("package_name").agg(lines.alias("d")).select("package_name", F.size("d").alias("declarations"), F.array_join(F.transform("d", lambda x: x["text"]), "\n").alias("skeleton"))


def identity(g: CodeGraph, q: str, package: str | None = None) -> DataFrame:
    """PRJ-29: the exact symbol a selector names, or why not."""
    hit = g.symbols.where(E.match_symbol_exact(q) & (F.col("package_name") == package if package else F.lit(True)))
    one = hit.agg(F.countDistinct("id").alias("n"), F.min("id").alias("id"))
    return one.select(F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "exact").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("id")).alias("id"), "n")


def stats(g: CodeGraph, names: list[str] | None = None) -> DataFrame:
    """PRJ-30: rows of each relation."""
    return union([getattr(g, n).agg(F.lit(n).alias("relation"), F.count("*").alias("n_rows")) for n in names or sorted(g.relations)])


def empty_context(g: CodeGraph, page: DataFrame, relation: str) -> dict:
    """PRJ-31: what was searched, for an answer without rows."""
    n = getattr(g, relation).count()
    return {"relation": relation, "indexed": n, "warning": None if not page.isEmpty() else f"no match among {n} {relation}" if n else f"nothing indexed in {relation}: absence can't be concluded"}
