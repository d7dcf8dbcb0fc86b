"""Several repositories as one graph: ownership, cross-repository calls, HTTP contracts (WSP family, JON-14..17)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import expr as E
from stratagraph.operators.census import has
from stratagraph.operators.joins import longest_prefix
from stratagraph.plans.fixpoint import best_paths, closure
from stratagraph.plans.graph import CodeGraph

CERTAINTIES = ("exact", "ambiguous", "possible")


def select_scope(manifest: dict, scope: str | None) -> list[str]:
    """WSP-03: repositories of a named, the default or the only scope."""
    scopes = {s["id"]: s["repositories"] for s in manifest.get("scopes", [])}
    if scope is None:
        if len(scopes) == 1:
            return next(iter(scopes.values()))
        scope = manifest.get("default_scope")
    if scope not in scopes:
        raise ValueError(f"unknown scope {scope!r}")
    return scopes[scope]


def members(graphs: dict[str, CodeGraph], relation: str) -> DataFrame:
    """SRC-16: one relation of all members with its ``repository_id``."""
    return reduce(DataFrame.unionByName, [getattr(g, relation).withColumn("repository_id", F.lit(r)) for r, g in sorted(graphs.items())])


def module_owners(modules: DataFrame) -> DataFrame:
    """WSP-02: (module_path, repository_id, owners); a module with several owners is ambiguous."""
    return modules.groupBy(F.col("path").alias("module_path")).agg(F.countDistinct("repository_id").alias("owners"), F.min("repository_id").alias("owner"))


def cross_imports(imports: DataFrame, owners: DataFrame) -> DataFrame:
    """JON-14: imports that another member's module owns, by longest module path."""
    owned = longest_prefix(imports.select("import_path"), owners.select("module_path", F.col("owner"), "owners"), "import_path", "module_path")
    return imports.join(owned, "import_path").where("owner <> repository_id").withColumn("resolution_status", F.when(F.col("owners") > 1, "ambiguous").otherwise("exact"))


def cross_calls(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """JON-15: calls into other members: by typed id, else alias -> import path -> id.

    One target is exact for typed facts and possible for spelled ones; several are ambiguous.
    """
    s = symbols.select(F.col("id").alias("target"), F.col("repository_id").alias("target_repo"))
    c = calls.where("NOT coalesce(synthetic, false)").withColumn("alias", F.element_at(F.split("callee_raw", r"\."), 1)).withColumn("member", F.element_at(F.split("callee_raw", r"\."), -1))
    typed = c.where("callee_symbol_id IS NOT NULL").join(s, F.col("callee_symbol_id") == F.col("target")).withColumn("evidence", F.lit("typed"))
    a = imports.select(F.col("repository_id").alias("_r"), F.col("from_file").alias("_f"), F.coalesce(F.nullif("alias", F.lit("")), F.element_at(F.split("import_path", "/"), -1)).alias("_a"), "import_path")
    spelled = c.where("callee_symbol_id IS NULL AND alias <> member").join(a, (F.col("repository_id") == F.col("_r")) & (F.col("file") == F.col("_f")) & (F.col("alias") == F.col("_a")))
    spelled = spelled.withColumn("wanted", F.concat_ws("::", "import_path", "member")).join(s, F.col("wanted") == F.col("target")).withColumn("evidence", F.lit("spelled"))
    cols = ["repository_id", "caller_symbol_id", "file", "line", "column", "callee_raw", "target", "target_repo", "evidence"]
    out = typed.select(*cols).unionByName(spelled.select(*cols)).where("target_repo <> repository_id").distinct()
    n = out.groupBy("repository_id", "file", "line", "column", "callee_raw").agg(F.count("*").alias("n"))
    return out.join(n, ["repository_id", "file", "line", "column", "callee_raw"]).withColumn("resolution_status", F.when(F.col("n") > 1, "ambiguous").when(F.col("evidence") == "typed", "exact").otherwise("possible")).drop("n")


def http_destinations(http_calls: DataFrame, clients: DataFrame) -> DataFrame:
    """JON-17: (authority, path) of client calls, from the static URL or a configured base, with a reason where neither resolves.

    ``clients`` has (repository_id, base, authority_id, path_prefix).
    """
    b = clients.select(F.col("repository_id").alias("_r"), "base", "authority_id", "path_prefix")
    c = http_calls.join(b, (F.col("repository_id") == F.col("_r")) & (F.col("url_base") == F.col("base")), "left")
    host = F.nullif(F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.lit(""))
    fixed = F.nullif(F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)?", 1), F.lit(""))
    reason = (
        F.when(F.col("request_only"), "request only").when(F.coalesce("method", F.lit("")) == "", "no method").when(host.isNotNull() & ~F.col("has_dynamic"), F.lit(None))
        .when(F.col("authority_id").isNull() & (F.coalesce("url_base", F.lit("")) == ""), "dynamic url").when(F.col("authority_id").isNull(), "unknown base").when(~F.col("url_suffix_static"), "dynamic suffix")
    )
    path = F.when(host.isNotNull() & ~F.col("has_dynamic"), F.coalesce(fixed, F.lit("/"))).otherwise(E.join_route(F.coalesce("path_prefix", F.lit("")), F.coalesce("url_suffix", F.lit(""))))
    return c.withColumn("reason", reason).withColumn("authority", F.when(F.col("reason").isNull(), F.coalesce("authority_id", host))).withColumn("path", F.when(F.col("reason").isNull(), path)).drop("_r", "base")


def http_contracts(destinations: DataFrame, services: DataFrame, routes: DataFrame) -> DataFrame:
    """JON-16: client calls joined to routes by authority, method and path shape; the unresolved keep a reason.

    ``services`` has (authority, repository_id); ``routes`` has (repository_id, method, path, handler); method ANY serves all.
    """
    sv = services.select("authority", F.col("repository_id").alias("server"))
    rt = routes.select(F.col("repository_id").alias("server"), F.upper("method").alias("route_method"), E.route_shape("path").alias("shape"), F.col("path").alias("route"), "handler")
    d = destinations.withColumn("shape", E.route_shape("path")).withColumn("_id", F.monotonically_increasing_id())
    at = d.join(sv, "authority", "left")
    hit = at.join(rt, ["server", "shape"]).where((F.upper("method") == F.col("route_method")) | (F.col("route_method") == "ANY"))
    n = hit.groupBy("_id").agg(F.count("*").alias("n"))
    found = hit.join(n, "_id").withColumn("resolution_status", F.when(F.col("n") > 1, "ambiguous").otherwise("exact")).select("_id", "server", "handler", "route", "resolution_status")
    out = at.groupBy("_id").agg(F.count("server").alias("servers")).join(d, "_id").join(found, "_id", "left")
    why = F.when(F.col("handler").isNotNull(), F.lit(None)).otherwise(F.coalesce("reason", F.when(F.col("servers") == 0, "unknown authority").otherwise("no matching route")))
    return out.select("repository_id", "function_name", "method", "authority", "path", "server", "route", "handler", "resolution_status", why.alias("reason"))


def query(parts: dict[str, DataFrame], text: str) -> DataFrame:
    """WSP-04: substring search; each part has (repository_id, name)."""
    return reduce(DataFrame.unionByName, [df.where(has("name", text)).select(F.lit(kind).alias("kind"), "repository_id", "name") for kind, df in sorted(parts.items())]).distinct()


def resolve_selector(symbols: DataFrame, selector: str) -> str:
    """WSP-05: one node key for ``repo:selector``; exact beats fuzzy, several are an error."""
    repo, _, q = selector.partition(":") if ":" in selector and "::" not in selector.partition(":")[0] + ":" + selector.partition(":")[2][:1] else ("", "", selector)
    s = symbols.where(F.col("repository_id") == repo) if repo else symbols
    for cond in (E.match_symbol_exact(q), E.match_symbol(q)):
        found = s.where(cond).select(F.concat_ws(":", "repository_id", "id").alias("k")).distinct().limit(2).collect()
        if len(found) == 1:
            return found[0]["k"]
        if found:
            raise ValueError(f"{selector!r} is ambiguous")
    raise ValueError(f"{selector!r} names nothing")


def virtual_edges(calls: DataFrame, imports: DataFrame | None = None, cross: DataFrame | None = None, http: DataFrame | None = None, certainty: str = "possible") -> DataFrame:
    """WSP-06: (src, dst, kind, certainty) over node keys, at least as certain as asked."""
    key = lambda r, i: F.concat_ws(":", r, i)
    parts = [calls.where("callee_symbol_id IS NOT NULL").select(key("repository_id", F.coalesce("caller_symbol_id", "caller_name")).alias("src"), key("repository_id", "callee_symbol_id").alias("dst"), F.lit("calls").alias("kind"), E.certainty().alias("certainty"))]
    if imports is not None:
        parts.append(imports.select(key("repository_id", "from_package").alias("src"), key("owner", "import_path").alias("dst"), F.lit("imports_module").alias("kind"), F.col("resolution_status").alias("certainty")))
    if cross is not None:
        parts.append(cross.select(key("repository_id", "caller_symbol_id").alias("src"), key("target_repo", "target").alias("dst"), F.lit("calls_go").alias("kind"), F.col("resolution_status").alias("certainty")))
    if http is not None:
        parts.append(http.where("handler IS NOT NULL").select(key("repository_id", "function_name").alias("src"), key("server", "handler").alias("dst"), F.lit("calls_http").alias("kind"), F.col("resolution_status").alias("certainty")))
    allowed = CERTAINTIES[: CERTAINTIES.index(certainty) + 1]
    return reduce(DataFrame.unionByName, parts).where(F.col("certainty").isin(*allowed)).distinct()


def path(edges: DataFrame, start: DataFrame, end: str, max_steps: int | None = None) -> DataFrame:
    """TRV-19: the best-ranked path over the overlay."""
    order = F.when(F.col("certainty") == "exact", 0).when(F.col("certainty") == "ambiguous", 1).otherwise(2)
    crossing = F.when(F.element_at(F.split("src", ":"), 1) != F.element_at(F.split("dst", ":"), 1), 1).otherwise(0)
    return best_paths(edges, start, [order, F.lit(1), crossing], max_steps).where(F.col("id") == end)


def impact(edges: DataFrame, start: DataFrame, max_depth: int | None = None) -> DataFrame:
    """TRV-20: what reaches each seed over the overlay."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start, max_depth).where("depth > 0")


def status(expected: DataFrame, current: DataFrame) -> DataFrame:
    """WSP-01, WSP-07: members with their artifact's fingerprint against the present one: fresh, stale or missing."""
    both = expected.select("repository_id", F.col("fingerprint").alias("a")).join(current.select("repository_id", F.col("fingerprint").alias("b")), "repository_id", "left")
    return both.select("repository_id", F.when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "fresh").otherwise("stale").alias("status"))
