"""Facts of one Go file: symbols, imports, calls and what the calls mean.

The reader follows declarations and braces rather than a full grammar, which
is what the relations need.  Facts that take a type checker (resolved callees,
interface satisfaction) are input relations elsewhere.
"""

from __future__ import annotations

import re

from stratagraph.golang.lexer import Token, digest, tokens, unquote

# What calls mean.
ENV_ACCESSORS = ("os.Getenv", "os.LookupEnv", "viper.GetString", "viper.GetInt", "viper.GetBool", "viper.Get")
SQL_METHODS = {"Query": 0, "QueryRow": 0, "Exec": 0, "QueryContext": 1, "QueryRowContext": 1, "ExecContext": 1, "Raw": 0}
ERROR_CALLS = ("panic", "errors.New", "fmt.Errorf")
HTTP_METHODS = {"GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "Get", "Post", "Put", "Patch", "Delete", "Options", "Head", "Any", "Handle", "HandleFunc"}
HTTP_CLIENT = {"http.Get": ("GET", 0), "http.Head": ("HEAD", 0), "http.Post": ("POST", 0), "http.PostForm": ("POST", 0), "http.NewRequest": (None, 1), "http.NewRequestWithContext": (None, 2)}
SYNC_METHODS = {"Lock": "mutex", "RLock": "mutex", "Unlock": "mutex", "RUnlock": "mutex", "Wait": "waitgroup", "Done": "waitgroup"}
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
REQUEST_TYPE = "*http.Request"
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class GoFile:
    """One parsed file; ``facts`` maps a relation to its rows."""

    def __init__(self, path: str, source: str, import_path: str = ""):
        self.path, self.source = path, source
        self.t: list[Token] = tokens(source, newlines=True)
        self.package = ""
        self.import_path = import_path
        self.aliases: dict[str, str] = {}
        self.facts: dict[str, list[dict]] = {k: [] for k in ("imports", "symbols", "calls", "env_reads", "routes", "sqls", "errors", "concurrency", "test_edges", "mutations", "literals", "http_calls", "strings", "complexity", "flow_facts", "flow_functions")}
        self._top()

    # --- tokens

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def skip(self, i: int) -> int:
        while i < len(self.t) and self.t[i].kind == "newline":
            i += 1
        return i

    def match(self, i: int) -> int:
        """The index of the bracket that closes the one at i."""
        depth = 0
        for j in range(i, len(self.t)):
            x = self.t[j]
            if x.kind == "mark":
                if x.text in OPEN:
                    depth += 1
                elif x.text in CLOSE:
                    depth -= 1
                    if not depth:
                        return j
        return len(self.t) - 1

    def words(self, a: int, b: int) -> str:
        """Source text between tokens a and b (exclusive) on one line."""
        if a >= b:
            return ""
        return re.sub(r"\s+", " ", self.source[self.t[a].pos : self.t[b - 1].pos + len(self.t[b - 1].text)]).strip()

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Top-level comma-separated parts of tokens a..b."""
        out, depth, start = [], 0, a
        for i in range(a, b):
            x = self.t[i]
            if x.kind == "mark":
                depth += (x.text in OPEN) - (x.text in CLOSE)
                if x.text == "," and not depth:
                    out.append((start, i))
                    start = i + 1
        out.append((start, b))
        trimmed = []
        for x, y in out:
            x = self.skip(x)
            while y > x and self.t[y - 1].kind == "newline":
                y -= 1
            if x < y:
                trimmed.append((x, y))
        return trimmed

    def string_at(self, a: int, b: int) -> str | None:
        """The value of a static string expression: literals joined by plus."""
        parts = [x for x in self.t[a:b] if x.kind != "newline"]
        if not parts or any(x.kind != "string" for x in parts[::2]) or any(x.text != "+" for x in parts[1::2]) or len(parts) % 2 == 0:
            return None
        return "".join(unquote(x.text) for x in parts[::2])

    # --- declarations

    def _top(self) -> None:
        i, n = 0, len(self.t)
        while i < n:
            w = self.text(i)
            if self.t[i].kind == "name" and w == "package":
                self.package = self.text(i + 1)
                i += 2
            elif w == "import":
                i = self._group(i + 1, self._import)
            elif w == "func":
                i = self._func(i)
            elif w == "type":
                i = self._group(i + 1, self._type)
            elif w in ("var", "const"):
                i = self._group(i + 1, lambda j, kind=w: self._value(j, kind))
            else:
                i += 1
        for x in self.t:
            if x.kind == "string":
                self.facts["strings"].append({"file": self.path, "line": x.line, "text": unquote(x.text)})

    def _group(self, i: int, one) -> int:
        i = self.skip(i)
        if self.text(i) != "(":
            return one(i)
        end = self.match(i)
        i = self.skip(i + 1)
        while i < end:
            i = self.skip(max(one(i), i + 1))
            while self.text(i) == ";":
                i = self.skip(i + 1)
        return end + 1

    def _line_end(self, i: int) -> int:
        """After the declaration that starts at i: a newline or semicolon outside brackets."""
        depth = 0
        while i < len(self.t):
            x = self.t[i]
            if x.kind == "mark":
                depth += (x.text in OPEN) - (x.text in CLOSE)
                if depth < 0 or (x.text == ";" and not depth):
                    return i
            if x.kind == "newline" and not depth and self.text(i - 1) not in (",", "=", "+", "||", "&&", "|"):
                return i
            i += 1
        return i

    def _import(self, i: int) -> int:
        alias = ""
        if self.t[i].kind != "string":
            alias, i = self.text(i), i + 1
        if i < len(self.t) and self.t[i].kind == "string":
            path = unquote(self.text(i))
            self.aliases[alias or path.rpartition("/")[2]] = path
            self.facts["imports"].append({"from_file": self.path, "from_package": self.package, "import_path": path, "alias": alias})
        return i + 1

    def _symbol(self, kind: str, name: str, a: int, b: int, receiver: str = "", **more) -> str:
        sid = f"{self.import_path or self.package}::" + (f"({receiver}).{name}" if receiver else name)
        end = self.t[b - 1]
        self.facts["symbols"].append({
            "id": sid, "kind": kind, "name": name, "receiver": receiver, "package_name": self.package, "file": self.path, "line": self.t[a].line,
            "end_line": end.line + end.text.count("\n"), "arity": 0, "doc": "", "signature": "", "method_signature": "", "interface_methods": None, "struct_fields": [], "embedded_structs": [],
            "declaration_digest": digest([x for x in self.t[a:b] if x.kind != "newline"]), **more,
        })
        return sid

    def _params(self, a: int, b: int) -> list[tuple[str, str]]:
        """(name, type) of a parameter list; unnamed ones have no name."""
        parts = [self.words(x, y) for x, y in self.split(a, b)]
        named = any(re.match(r"^[^\W\d]\w*\s+\S", p) and not p.startswith(("func ", "chan ", "map ", "struct ", "interface ")) for p in parts)
        if not named:
            return [("", p) for p in parts]
        out, kind = [], ""
        for p in reversed(parts):
            name, _, rest = p.partition(" ")
            kind = rest.strip() or kind
            out.append((name, kind))
        return out[::-1]

    def _func(self, i: int) -> int:
        start, i, receiver, me = i, self.skip(i + 1), "", ""
        if self.text(i) == "(":
            end = self.match(i)
            got = self._params(i + 1, end)
            me, receiver = got[0] if got else ("", "")
            receiver = re.sub(r"\[.*\]$", "", receiver)
            i = self.skip(end + 1)
        name, i = self.text(i), i + 1
        if self.text(i) == "[":
            i = self.match(i) + 1
        if self.text(i) != "(":
            return i
        close = self.match(i)
        params = self._params(i + 1, close)
        j = close + 1
        while j < len(self.t) and self.text(j) != "{" and self.t[j].kind != "newline":
            j = self.match(j) + 1 if self.text(j) in ("(", "[") else j + 2 if self.text(j) in ("interface", "struct") and self.text(j + 1) == "{" and self.text(j + 2) != "}" else self.match(j + 1) + 1 if self.text(j) in ("interface", "struct") else j + 1
        result = self.words(close + 1, j)
        end = self.match(j) + 1 if self.text(j) == "{" else j
        head = f"({', '.join(t for _, t in params)}) {result}".strip()
        sid = self._symbol("method" if receiver else "function", name, start, end, receiver, arity=len(params), signature=f"func {f'({receiver}) ' if receiver else ''}{name}({', '.join(f'{n} {t}'.strip() for n, t in params)}) {result}".strip(), method_signature=head)
        self.facts["flow_functions"].append({"id": sid, "name": name, "file": self.path, "params": [{"name": n, "type": t} for n, t in params]})
        for n, t in params:
            if t == REQUEST_TYPE and n:
                self.facts["flow_facts"].append(self._flow(sid, name, "source", j, target=n, source_kind="http_request", parameter_only=True))
        if self.text(j) == "{":
            self._body(j + 1, end - 1, sid, name, receiver, me)
        return end

    def _type(self, i: int) -> int:
        start, name = i, self.text(i)
        i += 1
        if self.text(i) == "[" and self.t[i + 1].kind == "name" and self.text(i + 2) != "]":
            i = self.match(i) + 1
        if self.text(i) == "=":
            i += 1
        kind = self.text(i)
        if kind in ("struct", "interface") and self.text(i + 1) == "{":
            end = self.match(i + 1)
            if kind == "struct":
                fields, embedded = self._fields(i + 2, end)
                self._symbol("struct", name, start, end + 1, struct_fields=fields, embedded_structs=embedded)
            else:
                self._symbol("interface", name, start, end + 1, interface_methods=self._methods(i + 2, end))
            return end + 1
        end = self._line_end(i)
        self._symbol("type", name, start, end, signature=self.words(i, end))
        return end

    def _rows(self, a: int, b: int):
        i = self.skip(a)
        while i < b:
            j = min(self._line_end(i), b)
            yield i, j
            i = self.skip(j + (self.text(j) == ";"))

    def _fields(self, a: int, b: int) -> tuple[list[dict], list[str]]:
        fields, embedded = [], []
        for x, y in self._rows(a, b):
            tag = ""
            if self.t[y - 1].kind == "string" and y - 1 > x:
                tag, y = unquote(self.text(y - 1)), y - 1
            names, k = [], x
            while self.t[k].kind == "name" and self.text(k + 1) == "," and k + 2 < y:
                names.append(self.text(k))
                k = self.skip(k + 2)
            if y - k == 1 or self.text(k) == "*" or self.text(k + 1) == ".":
                kind = self.words(k, y)
                embedded.append(kind)
                fields.append({"name": kind.lstrip("*").rpartition(".")[2], "type": kind, "tag": tag})
            else:
                kind = self.words(k + 1, y)
                fields += [{"name": n, "type": kind, "tag": tag} for n in [*names, self.text(k)]]
        return fields, embedded

    def _methods(self, a: int, b: int) -> dict[str, str]:
        out = {}
        for x, y in self._rows(a, b):
            if self.t[x].kind == "name" and self.text(x + 1) == "(":
                close = self.match(x + 1)
                out[self.text(x)] = f"({', '.join(t for _, t in self._params(x + 2, close))}) {self.words(close + 1, y)}".strip()
        return out

    def _value(self, i: int, kind: str) -> int:
        end = self._line_end(i)
        k = i
        while k < end and self.t[k].kind == "name":
            if self.text(k) != "_":
                self._symbol(kind, self.text(k), i, end)
            if self.text(k + 1) != ",":
                break
            k = self.skip(k + 2)
        eq = next((j for j in range(k, end) if self.text(j) == "="), None)
        if eq is not None:
            self._body(eq + 1, end, None, "init", "", "")
        return end

    # --- bodies

    def _flow(self, sid: str, name: str, kind: str, i: int, **more) -> dict:
        x = self.t[min(i, len(self.t) - 1)]
        return {"function_id": sid, "function": name, "file": self.path, "kind": kind, "target": None, "callee": None, "source_kind": None, "sink_kind": None, "detail": "", "inputs": [], "arguments": [], "parameter_only": False, "line": x.line, "column": x.column, **more}

    def _refs(self, a: int, b: int) -> list[str]:
        """Dotted names that an expression reads; calls in it give ``$call:column``."""
        out, i = [], a
        while i < b:
            if self.t[i].kind == "name" and self.text(i) not in KEYWORDS and self.text(i - 1) != ".":
                j = i + 1
                while self.text(j) == "." and j + 1 < b and self.t[j + 1].kind == "name":
                    j += 2
                if self.text(j) == "(":
                    out.append(f"$call:{self.t[j].line}:{self.t[j].column}")
                    i = self.match(j) + 1
                    continue
                out.append(self.words(i, j))
                i = j
            else:
                i += 1
        return out

    def _body(self, a: int, b: int, sid: str | None, name: str, receiver: str, me: str) -> None:
        shown = f"({receiver}).{name}" if receiver else name
        complexity = 1
        statement = a
        test = self.path.endswith("_test.go") and re.match(r"^(Test|Benchmark|Fuzz)($|[^a-z])", name) is not None
        i = a
        while i < b:
            x = self.t[i]
            if x.kind == "newline" or x.text in (";", "{", "}"):
                statement = i + 1
            if x.kind == "name" and x.text in ("if", "for"):
                complexity += 1
            elif x.kind == "name" and x.text == "case":
                complexity += 1
            elif x.kind == "mark" and x.text in ("&&", "||"):
                complexity += 1
            if x.text == "go" and x.kind == "name":
                self._concurrency("goroutine", shown, x, self.words(i + 1, min(i + 4, b)))
            elif x.text == "<-" and self.t[i - 1].kind == "name" and self.text(i - 1) not in KEYWORDS and self.text(i - 1) not in ("=",):
                self._concurrency("channel_send", shown, x, self.text(i - 1))
            elif x.text == "select" and x.kind == "name":
                self._concurrency("select", shown, x, "")
            if x.kind == "name" and x.text not in KEYWORDS and self.text(i - 1) != ".":
                j = i + 1
                while self.text(j) == "." and j + 1 < b and self.t[j + 1].kind == "name":
                    j += 2
                raw = self.words(i, j)
                if self.text(j) == "(":
                    self._call(raw, i, j, statement, sid, name, shown, receiver, me, test)
                elif self.text(j) == "{" and self._literal(i, j):
                    self.facts["literals"].append({"type_name": raw, "function": shown, "file": self.path, "line": x.line})
                elif self.text(j) in ("=", "+=", "-=", "*=", "/=", "|=", "&=", "++", "--") and "." in raw and i == self.skip(statement):
                    owner, _, field = raw.rpartition(".")
                    self.facts["mutations"].append({"field": field, "type_name": receiver.lstrip("*") if owner == me else owner, "function": shown, "file": self.path, "line": x.line, "via": "inc" if self.text(j) in ("++", "--") else "assign", "precise": False})
                if sid and self.text(j) in (":=", "=") and i == self.skip(statement):
                    end = self._line_end(j + 1)
                    self.facts["flow_facts"].append(self._flow(sid, name, "transfer", i, target=raw, inputs=self._refs(j + 1, min(end, b))))
                i = j
                continue
            if x.text == "return" and x.kind == "name" and sid:
                end = min(self._line_end(i + 1), b)
                for k, (p, q) in enumerate(self.split(i + 1, end)):
                    self.facts["flow_facts"].append(self._flow(sid, name, "return", i, target=f"$return:{k}", inputs=self._refs(p, q)))
            i += 1
        if sid:
            self.facts["complexity"].append({"id": sid, "name": shown, "file": self.path, "line": self.t[a].line, "complexity": complexity})

    def _literal(self, i: int, j: int) -> bool:
        """Whether a brace after a name opens a composite literal rather than a block."""
        return self.text(j - 1)[:1].isupper() and self.text(i - 1) not in ("if", "for", "switch", "range", "interface") and not any(self.text(k) in ("if", "for", "switch") for k in range(max(0, i - 3), i) if self.t[k].line == self.t[i].line)

    def _concurrency(self, kind: str, function: str, x: Token, detail: str) -> None:
        self.facts["concurrency"].append({"kind": kind, "function": function, "file": self.path, "line": x.line, "detail": detail})

    def _usage(self, i: int, close: int, statement: int) -> str:
        first = self.text(self.skip(statement))
        if first == "go":
            return "goroutine"
        if first == "defer":
            return "deferred"
        if first == "return":
            return "returned"
        eq = next((k for k in range(statement, i) if self.text(k) in (":=", "=")), None)
        if eq is not None:
            return "partially_ignored" if "_" in [self.text(k) for k in range(statement, eq)] else "assigned"
        if self.skip(statement) == i and (close + 1 >= len(self.t) or self.t[close + 1].kind == "newline" or self.text(close + 1) in (";", "}")):
            return "discarded"
        return ""

    def _call(self, raw: str, i: int, j: int, statement: int, sid: str | None, name: str, shown: str, receiver: str, me: str, test: bool) -> None:
        x, close = self.t[i], self.match(j)
        args = self.split(j + 1, close)
        place = {"file": self.path, "line": x.line}
        head, _, method = raw.rpartition(".")
        named = f"{self.aliases[head].rpartition('/')[2]}.{method}" if head in self.aliases else raw
        self.facts["calls"].append({"caller_symbol_id": sid, "caller_name": shown, "callee_raw": raw, "callee_symbol_id": None, **place, "column": self.t[j].column, "synthetic": False, "precise": False, "resolution": "", "return_usage": self._usage(i, close, statement)})
        static = [self.string_at(p, q) for p, q in args]
        if named in ENV_ACCESSORS and static and static[0] is not None:
            self.facts["env_reads"].append({"key": static[0], "accessor": named, **place, "function": shown, "precise": False})
            if sid:
                self.facts["flow_facts"].append(self._flow(sid, name, "source", j, target=f"$call:{self.t[j].line}:{self.t[j].column}", source_kind="environment"))
        if named in ERROR_CALLS:
            text = next((s for s in static if s is not None), None)
            if text is not None:
                self.facts["errors"].append({"message": text, "function": shown, **place})
        if head and method in SQL_METHODS and SQL_METHODS[method] < len(static) and static[SQL_METHODS[method]] is not None:
            from stratagraph.functions.sqlclass import classify

            query = static[SQL_METHODS[method]]
            verb, access, status, tables = classify(query)
            if verb:
                self.facts["sqls"].append({"query": query, "function": shown, **place, "verb": verb, "access": access, "classification": status, "tables": [{"name": n, "access": a} for n, a in tables]})
        if head and method in SYNC_METHODS and not args:
            self._concurrency(SYNC_METHODS[method], shown, x, raw)
        if head and method in HTTP_METHODS and static and static[0] is not None and len(args) > 1 and named not in HTTP_CLIENT:
            verb, _, path = static[0].partition(" ") if " " in static[0] else ("ANY" if method in ("Any", "Handle", "HandleFunc") else method.upper(), "", static[0])
            last = self.words(*args[-1])
            inline = last.startswith("func")
            self.facts["routes"].append({"method": verb, "path": path, "handler": "" if inline else last, "inline_body": inline, **place, "function": shown})
        if named in HTTP_CLIENT and HTTP_CLIENT[named][1] < len(args):
            verb, at = HTTP_CLIENT[named]
            url = static[at]
            self.facts["http_calls"].append({"source_file": self.path, "source_line": x.line, "function_name": shown, "method": verb or (static[at - 1] or ""), "url": url or "", "url_base": "" if url else self.words(*args[at]).split("+")[0].strip(), "url_suffix": "", "static_segments": [s for s in re.sub(r"^\w+://[^/]*", "", url or "").split("/") if s], "has_dynamic": url is None, "url_suffix_static": url is not None, "request_only": verb is None})
        if test and not re.match(r"^[tb]\.", raw):
            self.facts["test_edges"].append({"test_func": shown, "target": raw, "target_symbol_id": None, "resolution": "", **place, "column": self.t[j].column, "precise": False})
        if sid:
            from stratagraph.operators.flow import DECODE_CALLS, SINK_CALLS, SOURCE_CALLS, sink_arguments

            refs = [self._refs(p, q) for p, q in args]
            self.facts["flow_facts"].append(self._flow(sid, name, "call", j, target=f"$call:{self.t[j].line}:{self.t[j].column}", callee=named, arguments=refs))
            sink = SINK_CALLS.get(named) or (SINK_CALLS.get(method) if head else None)
            if sink:
                self.facts["flow_facts"].append(self._flow(sid, name, "sink", j, callee=named, sink_kind=sink, inputs=sorted({r for k in sink_arguments(named if named in SINK_CALLS else method, len(refs)) for r in refs[k]})))
            if named in DECODE_CALLS and DECODE_CALLS[named] < len(refs):
                for ref in refs[DECODE_CALLS[named]]:
                    self.facts["flow_facts"].append(self._flow(sid, name, "source", j, target=ref, source_kind="decoded_json"))
            if named not in ENV_ACCESSORS and SOURCE_CALLS.get(named) == "environment":
                self.facts["flow_facts"].append(self._flow(sid, name, "source", j, target=f"$call:{self.t[j].line}:{self.t[j].column}", source_kind="environment"))


def parse(path: str, source: str, import_path: str = "") -> dict[str, list[dict]]:
    """Rows by relation for one file."""
    f = GoFile(path, source, import_path)
    return f.facts | {"files": [{"id": path, "path": path, "package_name": f.package, "lines": source.count("\n") + 1, "generated": "Code generated" in "\n".join(source.split("\n")[:10])}]}
