"""Column builders: selectors, path predicates, route and name forms, labels.

Everything about the query text is computed on the driver, so that a selector
is a foldable expression inside whole-stage code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree on these lists.
IGNORED_DIRS = (".git", "vendor", "testdata")
STOP_WORDS = ("a", "an", "and", "are", "does", "from", "how", "is", "of", "the", "to", "what", "where", "which", "why", "work", "working", "works")
COMMON_INTERFACE_METHODS = (
    "Error", "Unwrap", "Is", "As", "String", "GoString", "Format",
    "MarshalJSON", "UnmarshalJSON", "MarshalText", "UnmarshalText",
    "MarshalBinary", "UnmarshalBinary", "MarshalYAML", "UnmarshalYAML",
    "Len", "Less", "Swap", "Read", "Write", "Close",
    "ServeHTTP", "Scan", "Value", "LogValue",
)
#: Result kinds of a question's matches that aren't symbols.
NOT_SYMBOLS = ("package", "file", "import", "call")


def _bare(receiver: str = "receiver") -> Column:
    return F.regexp_replace(F.lower(F.coalesce(F.col(receiver), F.lit(""))), r"\*", "")


def display_name() -> Column:
    """``(Receiver).Name`` for methods, else the name."""
    return F.when(F.coalesce("receiver", F.lit("")) != "", F.concat(F.lit("("), "receiver", F.lit(")."), "name")).otherwise(F.col("name"))


def file_selector(query: str) -> bool:
    """Whether a selector is spelled by file or import path."""
    return ".go:" in query or ("/" in query and "::" not in query)


def match_qualified(query: str) -> Column:
    """``path/file.go:Name``, ``file.go:Recv.Method`` or ``import/path.Member``."""
    q = query.lower()
    if ".go:" in q:
        file, _, member = q.rpartition(":")
        at = (F.lower("file") == file) | F.lower("file").endswith("/" + file)
        receiver, _, name = member.translate(str.maketrans("", "", "()*")).rpartition(".")
        return at & (F.lower("name") == name) & (_bare() == receiver)
    package, _, member = q.rpartition(".")
    return F.lower("id") == f"{package}::{member}"


def match_symbol(query: str) -> Column:
    """The fuzzy-exact selector over a symbols row."""
    if file_selector(query):
        return match_qualified(query)
    q = query.lower()
    name, receiver = F.lower("name"), F.lower(F.coalesce("receiver", F.lit("")))
    stripped = F.regexp_replace(receiver, r"^[*(]+", "")
    out = (F.lower("id") == q) | (name == q)
    out |= (receiver != "") & ((F.concat(stripped, F.lit("."), name) == q) | (F.concat(F.lit("("), stripped, F.lit(")."), name) == q))
    if "." in q:
        out |= F.contains(F.lower("id"), F.lit(q.replace(".", "::")))
        p = q.translate(str.maketrans("", "", "()*")).split(".")
        package = F.lower("package_name")
        if len(p) == 2:
            out |= ((package == p[0]) | (_bare() == p[0])) & (name == p[1])
        elif len(p) == 3:
            out |= (package == p[0]) & (_bare() == p[1]) & (name == p[2])
    return out


def match_symbol_exact(query: str) -> Column:
    """As ``match_symbol`` without substrings; parentheses, stars and spaces don't count."""
    q = query.lower().translate(str.maketrans("", "", "()* "))
    clean = lambda c: F.translate(F.lower(c), "()* ", "")
    receiver = clean(F.coalesce("receiver", F.lit("")))
    full = F.concat_ws(".", F.nullif(receiver, F.lit("")), clean(F.col("name")))
    return (clean(F.col("id")) == q) | (clean(F.col("name")) == q) | (full == q) | (F.concat(F.lower("package_name"), F.lit("."), full) == q)


def is_test_path(path: str | Column) -> Column:
    """Test files for ranking: suffix, mock or fake anywhere, or a test folder."""
    p = F.col(path) if isinstance(path, str) else path
    folders = F.arrays_overlap(F.split(p, "/"), F.array(*map(F.lit, ("testdata", "test", "tests"))))
    return p.endswith("_test.go") | F.lower(p).rlike("mock|fake") | folders


def is_test_file(path: str | Column) -> Column:
    """Test files by suffix only."""
    return (F.col(path) if isinstance(path, str) else path).endswith("_test.go")


def ignored_dir(path: str) -> Column:
    parts = F.split(path, "/")
    return F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRS))) | F.exists(parts, lambda x: (x != ".") & (x != "..") & x.rlike("^[._]."))


def generated_file(path: str, text: str) -> Column:
    head = F.slice(F.split(text, "\n"), 1, 10)
    return F.col(path).endswith(".pb.go") | F.col(path).endswith("_generated.go") | F.exists(head, lambda x: F.contains(x, F.lit("Code generated")))


def under_excluded(path: str, dirs: list[str]) -> Column:
    """Below one of the excluded folders; absolute ones and ``..`` are refused."""
    out = F.lit(False)
    for d in dirs:
        d = d.replace("\\", "/").strip("/").removeprefix("./")
        if not d or d.startswith("..") or "/../" in f"/{d}/":
            raise ValueError(f"not a folder below the root: {d!r}")
        out |= F.col(path).startswith(d + "/")
    return out


def match_package(package: str | Column, pattern: str) -> Column:
    """Exact, ``prefix/**`` for a subtree, ``prefix/*`` for one level; a bare ``*`` or ``**`` is only itself."""
    p = F.col(package) if isinstance(package, str) else package
    if pattern.endswith("/**"):
        base = pattern[:-3]
        return (p == pattern) | (p == base) | p.startswith(base + "/")
    if pattern.endswith("/*"):
        return (p == pattern) | p.rlike("^" + re.escape(pattern[:-1]) + "[^/]*$")
    return p == pattern


def is_stdlib(path: str | Column) -> Column:
    p = F.col(path) if isinstance(path, str) else path
    return ~F.contains(F.element_at(F.split(p, "/"), 1), F.lit("."))


def route_shape(path: str | Column) -> Column:
    """Lower case, with ``:x``, ``*x`` and ``{x}`` segments as ``{}``."""
    parts = F.split(F.lower(path), "/")
    return F.array_join(F.transform(parts, lambda s: F.when(s.rlike(r"^(:.*|\*.*|\{.*\})$"), F.lit("{}")).otherwise(s)), "/")


def route_contains(path: str | Column, query: str) -> Column:
    shape = "/".join("{}" if re.fullmatch(r":.*|\*.*|\{.*\}", s) else s for s in query.lower().split("/"))
    return F.contains(route_shape(path), F.lit(shape))


def contains_type(text: str | Column, name: str) -> Column:
    """A type's name as a whole identifier."""
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike(f"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])")


def mutation_type_matches(column: str, name: str) -> Column:
    clean = F.regexp_replace(F.lower(column), r"[*&]", "")
    q = re.sub(r"[*&]", "", name.lower())
    return (clean == q) | clean.endswith("." + q) | F.lit(q).endswith(F.concat(F.lit("."), clean))


def flow_package(package: str, pattern: str) -> Column:
    if pattern.endswith("/..."):
        base = pattern[:-4]
        return (F.col(package) == base) | F.col(package).startswith(base + "/")
    return F.col(package) == pattern


def flow_function(column: str, name: str) -> Column:
    c, q = F.lower(column), name.lower()
    if "." not in q:
        return (c == q) | (F.element_at(F.split(c, r"\.|::"), -1) == q)
    return (c == q) | c.endswith("." + q) | c.endswith("::" + q)


def glob(path: str, pattern: str) -> Column:
    """Shell pattern on a path; a trailing ``/**`` is the whole subtree."""
    if pattern.endswith("/**"):
        return F.col(path).startswith(pattern[:-2])
    out = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]-^" else re.escape(c) for c in pattern)
    return F.col(path).rlike(f"^{out}$")


def short_name(raw: str | Column) -> Column:
    """Receiver and qualifiers off, lower case."""
    return F.lower(F.element_at(F.split(F.regexp_replace(raw, r"[()*]", ""), r"\.|::"), -1))


def join_route(prefix: str | Column, suffix: str | Column) -> Column:
    return F.concat(F.regexp_replace(prefix, "/+$", ""), F.lit("/"), F.regexp_replace(suffix, "^/+", ""))


def static_segments(url: str | Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][\w+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda s: (s != "") & ~s.rlike(r"^[:*{]"))


def exact(resolution: str = "resolution") -> Column:
    """Static and wrapper edges are exact; everything else is possible."""
    return F.coalesce(F.col(resolution).isin("resolved_static", "synthetic_wrapper"), F.lit(False))


def certainty(resolution: str = "resolution") -> Column:
    return F.when(exact(resolution), "exact").otherwise("possible")


def usage_label(column: str = "return_usage") -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("passed"))


def severity(score: str) -> Column:
    s = F.col(score)
    return F.when(s >= 40, "CRITICAL").when(s >= 20, "HIGH").when(s >= 8, "MEDIUM").otherwise("LOW")


def risk_label(score: str) -> Column:
    return F.when(F.col(score) > 70, "DANGER").when(F.col(score) > 30, "REVIEW").otherwise("SAFE")


def flow_severity(sink: str, source: str) -> Column:
    high = F.col(sink).isin("sql_query", "process_execution") | ((F.col(sink) == "filesystem") & F.col(source).isin("http_request", "decoded_json"))
    return F.when(high, "high").otherwise("medium")


def json_name(tag: str | Column, field: str | Column) -> Column:
    """The contract name of a struct field; null where the tag says ``-``."""
    name = F.regexp_extract(tag, r'json:"([^",]*)', 1)
    return F.when(name == "-", F.lit(None)).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.col(field) if isinstance(field, str) else field))


def arg_count(signature: str | Column) -> Column:
    """Parts between commas from the first parenthesis of a signature to the last one."""
    inner = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)", 1)
    return F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))


def signature_usage(signature: str, name: str) -> Column:
    """Whether a type is in the parameters, the results or both."""
    params = contains_type(F.substring_index(signature, ")", 1), name)
    results = contains_type(F.regexp_extract(signature, r"^[^)]*\)(?:[^(]*\([^)]*\))?(.*)$", 1), name) | contains_type(F.regexp_extract(signature, r"\)\s*\(?([^()]*)\)?\s*$", 1), name)
    return F.when(params & results, "both").when(params, "param").when(results, "return")


def test_name(name: str | Column) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return c.rlike(r"^(Test|Benchmark|Fuzz|Example)($|[^\p{Ll}])")


def test_pattern(names: list[str], limit: int = 4096) -> list[str]:
    """Anchored ``-run`` patterns, split so that none is longer than ``limit`` bytes."""
    out, held = [], []
    for n in sorted(set(names)):
        if held and len("^(" + "|".join(map(re.escape, [*held, n])) + ")$") > limit:
            out.append("^(" + "|".join(map(re.escape, held)) + ")$")
            held = []
        held.append(n)
    return out + (["^(" + "|".join(map(re.escape, held)) + ")$"] if held else [])


def explore_terms(question: str) -> list[str]:
    """The words of a question that aren't stop words; the whole question where nothing is left."""
    words = [w for w in re.split(r"[\s,;!?()\[\]{}\"'`]+", question) if w and w.lower() not in STOP_WORDS]
    return words or [question]


def role() -> Column:
    """What a symbol is for, from columns of evidence (see ``aggs.evidence``), by the first rule that holds."""
    callers, callees = F.col("prod_callers"), F.col("callees")
    return (
        F.when((F.col("kind") == "struct") & ((F.col("methods") >= 10) | (F.col("fields") >= 15)), "large data model or potential god object")
        .when((F.col("kind") == "struct") & (F.col("methods") == 0), "data transfer object (no methods)")
        .when(F.col("kind") == "struct", "data model")
        .when(F.col("kind") == "interface", "contract definition")
        .when(F.col("handles"), "HTTP handler (entry point)")
        .when((callers == 0) & (F.col("tests") == 0) & (F.col("kind") != "method"), "unused or entry point (no detected production callers)")
        .when((callers >= 5) & (callees <= 2), "high-traffic leaf utility")
        .when((callers >= 5) & (callees >= 5), "high-traffic orchestrator")
        .when((callees >= 5) & (callers <= 2), "service orchestrator (coordinator)")
        .when((F.col("sqls") > 0) | (F.col("sql_callees") > 0), "data access layer")
        .when(callees == 0, "leaf function")
        .otherwise("internal utility")
    )


def quick_role() -> Column:
    """The coarse role, from the same evidence: entry surface, then data access, then traffic."""
    callers, callees = F.col("prod_callers"), F.col("callees")
    return (
        F.when(F.col("handles"), "HTTP handler")
        .when(F.col("sqls") > 0, "data access")
        .when(callers == 0, "entry point")
        .when((callers >= 5) & (callees >= 5), "orchestrator")
        .when(callers >= 5, "utility")
        .when(callees >= 5, "coordinator")
        .otherwise("internal")
    )


def byte_size(text: str | Column) -> Column:
    """Bytes of a size like ``2GB`` (decimal) or ``2 GiB`` (binary), any case; null where it isn't a positive size below 2**63."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    number = F.regexp_extract(c, r"^([0-9]+)\s*[a-zA-Z]*$", 1)
    unit = F.lower(F.regexp_extract(c, r"^[0-9]+\s*([a-zA-Z]*)$", 1))
    power = F.when(unit.isin("", "b"), 0).when(unit.rlike("^[kmgt](i?b?)$"), F.instr(F.lit("kmgt"), F.substring(unit, 1, 1)))
    step = F.when(F.contains(unit, F.lit("i")), F.lit(1024)).otherwise(F.lit(1000)).cast("decimal(38,0)")
    scale = F.when(power == 0, 1).when(power == 1, step).when(power == 2, step * step).when(power == 3, step * step * step).when(power == 4, step * step * step * step)
    total = F.try_multiply(F.when(F.length(F.ltrim(number, F.lit("0"))) <= 19, number).cast("decimal(20,0)"), scale.cast("decimal(18,0)"))
    return F.when((total > 0) & (total <= F.lit(2**63 - 1)), total.cast("long"))
