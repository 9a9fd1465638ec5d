"""Python sources as data: Arrow UDFs over the standard library's syntax trees.

Sources that do not parse give null facts, no findings but a parse_error, and unchanged text.  Snippets are cut at 120 characters.
Renaming works on NAME tokens that are not attributes or keyword arguments, so formatting stays; names in strings and comments stay too.
"""

from __future__ import annotations

import ast
import io
import keyword
import re
import tokenize
import warnings
from collections.abc import Callable, Iterator

import pandas as pd

from sparkcurate.functions.udf import arrow_udf

SNIPPET = 120


def tree_of(code: str | None) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def dotted(node: ast.AST | None) -> str:
    """a.b.c of a name, attribute, call or subscript."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}".lstrip(".")
    if isinstance(node, (ast.Call, ast.Subscript)):
        return dotted(node.func if isinstance(node, ast.Call) else node.value)
    return ""


# -- facts ------------------------------------------------------------------------------------------------------------------------------

FACTS = "struct<classes:array<string>,functions:array<string>,imports:array<string>,calls:array<string>,is_async:boolean,hints:boolean>"


def facts(code: str | None) -> dict | None:
    tree = tree_of(code)
    if tree is None:
        return None
    out: dict = {"classes": [], "functions": [], "imports": [], "calls": [], "is_async": False, "hints": False}
    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef):
            out["classes"].append(n.name)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out["functions"].append(n.name)
            out["is_async"] |= isinstance(n, ast.AsyncFunctionDef)
            out["hints"] |= n.returns is not None or any(a.annotation for a in n.args.args)
        elif isinstance(n, ast.Import):
            out["imports"] += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            out["imports"].append(n.module or ".")
        elif isinstance(n, ast.Call) and dotted(n.func):
            out["calls"].append(dotted(n.func))
    return {k: sorted(v) if isinstance(v, list) else v for k, v in out.items()}


@arrow_udf(FACTS)
def ast_facts(code: pd.Series) -> pd.DataFrame:
    rows = [facts(c) or dict.fromkeys(("classes", "functions", "imports", "calls", "is_async", "hints")) for c in code]
    return pd.DataFrame(rows, columns=["classes", "functions", "imports", "calls", "is_async", "hints"])


@arrow_udf("boolean")
def is_valid_python(code: pd.Series) -> pd.Series:
    return code.map(lambda c: c is not None and tree_of(c) is not None).astype(bool)


def accesses(code: str | None) -> list[str]:
    """var.field and var.field.field of the variables that hold the result of a call, once each."""
    tree = tree_of(code)
    if tree is None:
        return []
    held = {t.id for n in ast.walk(tree) if isinstance(n, ast.Assign) and isinstance(n.value, (ast.Call, ast.Await)) for t in n.targets if isinstance(t, ast.Name)}
    found = {dotted(n) for n in ast.walk(tree) if isinstance(n, ast.Attribute)}
    return sorted(f for f in found if f.split(".")[0] in held)


@arrow_udf("array<string>")
def field_accesses(code: pd.Series) -> pd.Series:
    return code.map(accesses)


#: Phrases that mark a text as prose about code.
PROSE = ("would use", "should use", "I'll use", "we could", "to call", "needs to", "want to", "going to", "can use", "let me", "i would", "i should", "i need")
PROSE_REACH = 100


def occurrence(word: str, code: str | None) -> str:
    """Where the first line with the word has it: none, comment (the line begins as one), string (a quote is open before the word), prose (a phrase
    of PROSE in the lowered text begins under PROSE_REACH characters from the word there), real_call (a bracket follows) or code_context."""
    text = code or ""
    line = next((x.strip() for x in text.splitlines() if word in x), None)
    if line is None:
        return "none"
    before, _, _ = line.partition(word)
    if line.startswith("#"):
        return "comment"
    if any(before.count(quote) % 2 for quote in "\"'"):
        return "string"
    lowered = text.lower()
    places = [lowered.find(phrase) for phrase in PROSE]
    if any(p >= 0 and abs(p - lowered.find(word)) < PROSE_REACH for p in places):
        return "prose"
    return "real_call" if re.search(rf"\b{re.escape(word)}\s*\(", line) else "code_context"


@arrow_udf("string")
def keyword_occurrence(word: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([occurrence(w, c) if w is not None else None for w, c in zip(word, code)])


# -- search and rewrite -----------------------------------------------------------------------------------------------------------------

MATCHES = "array<struct<line:int,kind:string,name:string,snippet:string>>"


def found(code: str | None, pattern: str) -> list[dict]:
    """Nodes of a kind (class, def, call, decorator, import, return, assign, for), or `kind:name` of those named so; calls, decorators and
    imports also match by the last part of a dotted name."""
    tree = tree_of(code)
    if tree is None:
        return []
    kind, _, name = pattern.partition(":")
    lines, out = (code or "").split("\n"), []

    def add(node: ast.AST, k: str, n: str) -> None:
        if k == kind and (not name or name in (n, n.rpartition(".")[2])):
            out.append({"line": node.lineno, "kind": k, "name": n, "snippet": lines[node.lineno - 1].strip()[:SNIPPET]})

    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef):
            add(n, "class", n.name)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(n, "def", n.name)
        elif isinstance(n, ast.Call):
            add(n, "call", dotted(n.func))
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            for a in n.names:
                add(n, "import", f"{n.module}.{a.name}" if isinstance(n, ast.ImportFrom) and n.module else a.name)
        elif isinstance(n, ast.Return):
            add(n, "return", "")
        elif isinstance(n, ast.Assign):
            add(n, "assign", dotted(n.targets[0]))
        elif isinstance(n, (ast.For, ast.AsyncFor)):
            add(n, "for", "")
        for d in getattr(n, "decorator_list", ()):
            add(d, "decorator", dotted(d))
    return sorted(out, key=lambda x: (x["line"], x["kind"], x["name"]))


def find_pattern(pattern: str):
    """A UDF: code -> array of matches."""

    @arrow_udf(MATCHES)
    def run(code: pd.Series) -> pd.Series:
        return code.map(lambda c: found(c, pattern))

    return run


def renamed(code: str | None, old: str, new: str) -> tuple[str, int]:
    """(code with the name replaced, times); unchanged if it cannot be read or the new name is none."""
    text = code or ""
    if not new.isidentifier() or keyword.iskeyword(new) or tree_of(text) is None:
        return text, 0
    try:
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline))
    except (tokenize.TokenError, SyntaxError):
        return text, 0
    depth, places = 0, []
    for before, t, after in zip([None, *tokens], tokens, [*tokens[1:], None]):
        depth += t.string in ("(", "[", "{") if t.type == tokenize.OP else 0
        depth -= t.string in (")", "]", "}") if t.type == tokenize.OP else 0
        attribute = before is not None and before.string == "."
        argument = depth > 0 and after is not None and after.string == "="
        if t.type == tokenize.NAME and t.string == old and not attribute and not argument:
            places.append(t.start)
    lines = text.split("\n")
    for row, column in reversed(places):
        x = lines[row - 1]
        lines[row - 1] = x[:column] + new + x[column + len(old) :]
    return "\n".join(lines), len(places)


def rename(old: str, new: str):
    """A UDF: code -> struct<code, times>."""

    @arrow_udf("struct<code:string,times:int>")
    def run(code: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([renamed(c, old, new) for c in code], columns=["code", "times"])

    return run


def with_import(code: str | None, line: str) -> str:
    """The import added after the last one at the top, or after the doc string; once only."""
    text = code or ""
    tree, wanted = tree_of(text), tree_of(line)
    if tree is None or wanted is None or not wanted.body:
        return text
    have = {ast.dump(n) for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom))}
    if ast.dump(wanted.body[0]) in have:
        return text
    at = 0
    for k, n in enumerate(tree.body):
        if isinstance(n, (ast.Import, ast.ImportFrom)) or (k == 0 and isinstance(n, ast.Expr) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str)):
            at = n.end_lineno or n.lineno
    lines = text.split("\n")
    return "\n".join([*lines[:at], line, *lines[at:]])


def add_import(line: str):
    """A UDF: code -> code."""

    @arrow_udf("string")
    def run(code: pd.Series) -> pd.Series:
        return code.map(lambda c: with_import(c, line))

    return run


# -- symbols ----------------------------------------------------------------------------------------------------------------------------

SYMBOLS = "array<struct<path:string,depth:int,name:string,kind:int,line:int,end_line:int>>"


def flat_symbols(response: str | None) -> list[dict]:
    """Symbols of a language server's answer, nested or flat, as rows with path and depth; lines from 1."""
    import json

    try:
        value = json.loads(response or "null")
    except ValueError:
        return []
    out: list[dict] = []

    def walk(items: object, path: str, depth: int) -> None:
        for x in items if isinstance(items, list) else ():
            if not isinstance(x, dict) or "name" not in x:
                continue
            own = f"{path}/{x['name']}".lstrip("/")
            span = x.get("range") or (x.get("location") or {}).get("range") or {}
            at = lambda k: (span.get(k) or {}).get("line", 0) + 1  # noqa: B023, E731
            out.append({"path": own, "depth": depth, "name": x["name"], "kind": x.get("kind"), "line": at("start"), "end_line": at("end")})
            walk(x.get("children"), own, depth + 1)

    walk(value, "", 0)
    return out


@arrow_udf(SYMBOLS)
def document_symbols(response: pd.Series) -> pd.Series:
    return response.map(flat_symbols)


# -- validators of components, services, middleware and routes; their names of rules are fixed values -----------------------------------------------------------------------------

ISSUES = "array<struct<validator:string,rule:string,severity:string,line:int,message:string>>"
Issue = tuple[str, str, int, str]


def decorated(node: ast.ClassDef | ast.FunctionDef, *names: str) -> bool:
    return any(dotted(d).rpartition(".")[2] in names for d in node.decorator_list)


def classes(tree: ast.Module) -> list[ast.ClassDef]:
    return [n for n in ast.walk(tree) if isinstance(n, ast.ClassDef)]


def method(node: ast.ClassDef, name: str) -> ast.FunctionDef | None:
    return next((n for n in node.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == name), None)


def html_calls(node: ast.AST) -> list[ast.Call]:
    return [n for n in ast.walk(node) if isinstance(n, ast.Call) and dotted(n.func).rpartition(".")[2] == "html"]


def injected(node: ast.ClassDef) -> list[tuple[str, int]]:
    """Types of fields annotated Inject[type], with their lines."""
    out = []
    for n in node.body:
        if isinstance(n, ast.AnnAssign) and isinstance(n.annotation, ast.Subscript) and dotted(n.annotation.value) == "Inject":
            out.append((dotted(n.annotation.slice), n.lineno))
    return out


def component(tree: ast.Module) -> Iterator[Issue]:
    for c in classes(tree):
        call, html = method(c, "__call__"), html_calls(c)
        if not (decorated(c, "dataclass") or call or html) or injected(c) or decorated(c, "injectable", "middleware"):
            continue
        if not decorated(c, "dataclass"):
            yield "component-must-have-dataclass", "error", c.lineno, f"{c.name} is no dataclass"
        if not call:
            yield "component-must-have-callable", "error", c.lineno, f"{c.name} has no __call__"
        elif dotted(call.returns) != "Node":
            yield "component-callable-must-return-node", "warning", call.lineno, f"{c.name}.__call__ does not return Node"
        if any(isinstance(a, ast.JoinedStr) for h in html for a in h.args):
            yield "component-no-fstring-in-html", "error", c.lineno, f"{c.name} gives html() a formatted string"


def escape(tree: ast.Module) -> Iterator[Issue]:
    for call in html_calls(tree):
        for a in call.args:
            if isinstance(a, ast.JoinedStr):
                yield "no-fstring-in-html", "error", a.lineno, "html() takes a formatted string"


def render_tree(tree: ast.Module) -> Iterator[Issue]:
    """Nothing is reported yet."""
    yield from ()


def services(tree: ast.Module) -> Iterator[Issue]:
    for c in classes(tree):
        if decorated(c, "injectable") or injected(c):
            if not decorated(c, "injectable"):
                yield "service-must-have-injectable", "error", c.lineno, f"{c.name} is not registered"
            if not decorated(c, "dataclass"):
                yield "service-must-have-dataclass", "error", c.lineno, f"{c.name} is no dataclass"


def dependencies(tree: ast.Module) -> Iterator[Issue]:
    kind = {c.name: "service" if decorated(c, "injectable") else "component" if decorated(c, "dataclass") else "unknown" for c in classes(tree)}
    for c in classes(tree):
        for t, line in injected(c):
            if kind[c.name] == "service" and kind.get(t, "unknown") == "component":
                yield "service-cannot-depend-on-component", "error", line, f"service {c.name} injects component {t}"


def injection_sites(tree: ast.Module) -> Iterator[Issue]:
    known: set[str] = set()
    for n in sorted((x for x in ast.walk(tree) if isinstance(x, (ast.Import, ast.ImportFrom, ast.ClassDef))), key=lambda x: x.lineno):
        if isinstance(n, ast.ClassDef):
            for t, line in injected(n):
                if t not in known:
                    yield "inject-type-must-be-imported", "warning", line, f"{t} is not imported"
        else:
            known |= {a.name for a in n.names}


def middleware(tree: ast.Module) -> Iterator[Issue]:
    for c in classes(tree):
        marks = [d for d in c.decorator_list if dotted(d).rpartition(".")[2] == "middleware"]
        for d in marks:
            literal = isinstance(d, ast.Call) and any(k.arg == "categories" and isinstance(k.value, (ast.List, ast.Tuple, ast.Set, ast.Constant)) for k in d.keywords)
            if not literal:
                yield "middleware-must-have-categories", "warning", c.lineno, f"{c.name} names no categories"
        call = method(c, "__call__")
        if call and (marks or decorated(c, "hookable", "injectable")):
            if [a.arg for a in call.args.args] != ["self", "target", "props", "context"]:
                yield "middleware-must-have-correct-signature", "error", call.lineno, f"{c.name}.__call__ must take target, props, context"


def template_binding(tree: ast.Module) -> Iterator[Issue]:
    seen = False
    for n in sorted((x for x in ast.walk(tree) if isinstance(x, (ast.ClassDef, ast.Call))), key=lambda x: (x.lineno, isinstance(x, ast.Call))):
        if isinstance(n, ast.ClassDef):
            seen |= bool(injected(n))
        elif seen and dotted(n.func).rpartition(".")[2] == "html" and any(isinstance(a, ast.JoinedStr) for a in n.args) and not any(k.arg == "context" for k in n.keywords):
            yield "di-template-needs-context", "warning", n.lineno, "html() without context="


def routes(tree: ast.Module) -> Iterator[Issue]:
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and dotted(n.func).rpartition(".")[2] in ("Route", "add_route"):
            path = next((a.value for a in n.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), None)
            if path is None:
                continue
            if not path.startswith("/"):
                yield "route-must-start-with-slash", "error", n.lineno, f"{path} has no leading slash"
            if path.count("{") != path.count("}"):
                yield "route-unbalanced-braces", "error", n.lineno, f"{path} has open braces"


VALIDATORS: dict[str, Callable[[ast.Module], Iterator[Issue]]] = {
    "component": component,
    "render_tree": render_tree,
    "escape": escape,
    "service_registration": services,
    "dependency_graph": dependencies,
    "injection_site": injection_sites,
    "middleware_chain": middleware,
    "template_binding": template_binding,
    "route_pattern": routes,
}


def issues(code: str | None) -> list[dict]:
    tree = tree_of(code)
    if tree is None:
        return [{"validator": "parse", "rule": "parse-error", "severity": "error", "line": 0, "message": "not valid Python"}]
    out = [dict(zip(("validator", "rule", "severity", "line", "message"), (name, *i))) for name, check in VALIDATORS.items() for i in check(tree)]
    return sorted(out, key=lambda x: (x["line"], x["rule"]))


@arrow_udf(ISSUES)
def domain_issues(code: pd.Series) -> pd.Series:
    return code.map(issues)
