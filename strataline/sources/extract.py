"""Symbols, edges, imports and endpoints out of source texts, one extractor per language.

Python is parsed with the standard library; the other languages by line patterns with bracket
depth, which finds declarations but resolves no types. Extractors can be added to REGISTRY.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.text import line_numbers

SYMBOLS = "path string, qualified_name string, name string, kind string, is_exported boolean, visibility string, line_start int, line_end int, parent string, signature string, doc_comment string"
EDGES = "path string, source string, target string, kind string, line int, confidence string"


class Found:
    """What an extractor finds in one file."""

    def __init__(self, path: str):
        self.path, self.symbols, self.edges, self.imports = path, [], [], []

    def symbol(self, name: str, kind: str, exported: bool, start: int, end: int, parent: str | None = None, signature: str | None = None, doc: str | None = None, visibility: str | None = None) -> str:
        q = f"{parent}.{name}" if parent else f"{self.path}::{name}"
        self.symbols.append((self.path, q, name, kind, exported, visibility, start, end, parent, signature, doc))
        if parent:
            self.edge(parent, q, "contains", start, "resolved")
        return q

    def edge(self, source: str, target: str, kind: str, line: int, confidence: str = "heuristic") -> None:
        self.edges.append((self.path, source, target, kind, line, confidence))


def python(path: str, text: str) -> Found:
    """Functions, methods, classes and constants; calls by name; imports."""
    out = Found(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return out

    def open_(n: str) -> tuple[bool, str | None]:
        return not n.startswith("_"), "private" if n.startswith("__") and not n.endswith("__") else "protected" if n.startswith("_") else None

    def calls(node: ast.AST, q: str) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                f = x.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    out.edge(q, f"{path}::{name}", "calls", x.lineno)

    def visit(body: list, parent: str | None, in_class: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                exp, vis = open_(n.name)
                sig = f"def {n.name}({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                q = out.symbol(n.name, "method" if in_class else "function", exp, n.lineno, n.end_lineno, parent, sig, ast.get_docstring(n), vis)
                calls(n, q)
            elif isinstance(n, ast.ClassDef):
                exp, vis = open_(n.name)
                q = out.symbol(n.name, "class", exp, n.lineno, n.end_lineno, parent, f"class {n.name}", ast.get_docstring(n), vis)
                for b in n.bases:
                    if isinstance(b, ast.Name):
                        out.edge(q, f"{path}::{b.id}", "extends", n.lineno)
                visit(n.body, q, True)
            elif isinstance(n, (ast.Assign, ast.AnnAssign)):
                for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                    if isinstance(t, ast.Name) and (in_class or isinstance(n, ast.AnnAssign) or t.id.isupper()):
                        out.symbol(t.id, "variable", open_(t.id)[0], n.lineno, n.end_lineno, parent)
            elif isinstance(n, ast.Import):
                out.imports += [(path, a.name, n.lineno) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.imports.append((path, "." * n.level + (n.module or ""), n.lineno))

    visit(tree.body, None, False)
    return out


_BLANK = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*|/\*.*?\*/", re.S)
# Declarations by language: (pattern, kind); group 1 is the name
_DECL = {
    "typescript": [
        (r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\*?\s+([\w$]+)", "function"), (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([\w$]+)", "class"),
        (r"(?:export\s+)?interface\s+([\w$]+)", "interface"), (r"(?:export\s+)?type\s+([\w$]+)\s*(?:<[^=]*>)?\s*=", "type"), (r"(?:export\s+)?(?:const\s+)?enum\s+([\w$]+)", "enum"),
        (r"(?:export\s+)?(?:const|let|var)\s+([\w$]+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>", "function"), (r"(?:export\s+)?(?:const|let|var)\s+([\w$]+)\b", "variable"),
        (r"(?:export\s+)?(?:namespace|module)\s+([\w$]+)", "module"),
    ],
    "go": [(r"func\s+\([^)]*\)\s*(\w+)", "method"), (r"func\s+(\w+)", "function"), (r"type\s+(\w+)\s+struct", "class"), (r"type\s+(\w+)\s+interface", "interface"), (r"type\s+(\w+)", "type"), (r"(?:var|const)\s+(\w+)", "variable")],
    "rust": [
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)", "function"), (r"(?:pub\s+)?struct\s+(\w+)", "class"), (r"(?:pub\s+)?trait\s+(\w+)", "interface"),
        (r"(?:pub\s+)?enum\s+(\w+)", "enum"), (r"(?:pub\s+)?(?:const|static)\s+(\w+)\s*:", "variable"), (r"(?:pub\s+)?mod\s+(\w+)", "module"),
    ],
}
_COMPILED = {k: [(re.compile(r"\s*" + p), kind) for p, kind in v] for k, v in _DECL.items()}
_METHOD = re.compile(r"\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*([\w$]+)\s*(?:<[^(]*>)?\([^;]*\)\s*(?::[^{;]+)?\{")
# Members of types by language: (kind of the type, pattern, kind of the member)
_MEMBER = {
    "typescript": [
        ("class", r"\s*(?:(?:public|private|protected|static|readonly|override|declare)\s+)*([\w$]+)[?!]?\s*(?::[^;{(]+)?(?:=[^>].*)?;?\s*$", "property"), ("interface", r"\s*(?:readonly\s+)?([\w$]+)\??\s*:\s*[^(]", "property"),
        ("interface", r"\s*([\w$]+)\??\s*(?:<[^(]*>)?\(", "method"),
    ],
    "go": [("class", r"\s*(\w+)\s+[\w*\[\].]+", "property"), ("interface", r"\s*(\w+)\(", "method")],
    "rust": [("class", r"\s*(?:pub(?:\([^)]*\))?\s+)?(\w+)\s*:\s*[^:]", "property")],
}
_MEMBERS = {k: [(of, re.compile(p), kind) for of, p, kind in v] for k, v in _MEMBER.items()}
_TEST_CASE = re.compile(r"\s*(?:test|it|describe)(?:\.\w+)?\s*\(\s*(['\"`])(.+?)\1\s*,\s*(?:async\b|function\b|\()")
_CALL = re.compile(r"(?<![\w.])([A-Za-z_$][\w$]*)\s*\(")
_KEYWORDS = frozenset("if for while switch catch return function func fn match loop else new typeof await super import".split())
_IMPORT = {
    "typescript": re.compile(r"(?:import|export)\b[^'\"\n]*?from\s*['\"]([^'\"]+)['\"]|(?:import|require)\s*\(\s*['\"]([^'\"]+)['\"]|^\s*import\s*['\"]([^'\"]+)['\"]", re.M),
    "go": re.compile(r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", re.M),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)", re.M),
}


def braced(language: str) -> Callable[[str, str], Found]:
    """Extractor for a language with braces: declarations with their extent, members of classes, calls by name."""

    def run(path: str, text: str) -> Found:
        out = Found(path)
        code = _BLANK.sub(lambda m: "".join(c if c == "\n" else " " for c in m[0]), text)
        lines, source = code.split("\n"), text.split("\n")
        depth, ends, opens = 0, {}, []
        for i, line in enumerate(lines, 1):
            for c in line:
                if c == "{":
                    opens.append(i)
                elif c == "}" and opens:
                    ends[opens.pop()] = i
        stack: list[tuple[int, str, str]] = []
        body = 0  # last line of the function or method read last: no member stands in it
        for i, line in enumerate(lines, 1):
            if language == "typescript" and (m := _TEST_CASE.match(source[i - 1])):  # the callback of a test is a function
                label = f"test:{m[2][:80]}"
                q = out.symbol(label, "function", False, i, ends.get(i, i), None, label)
                for k in range(i, ends.get(i, i) + 1):
                    for c in _CALL.finditer(lines[k - 1]):
                        if c[1] not in _KEYWORDS and k > i:
                            out.edge(q, f"{path}::{c[1]}", "calls", k)
                continue
            while stack and stack[-1][0] < i:
                stack.pop()
            inner = stack[-1] if stack else None
            hit = None
            if inner is None or inner[2] == "module":
                hit = next(((m, k) for p, k in _COMPILED[language] if (m := p.match(line))), None)
            elif inner[2] in ("class", "impl") and language == "typescript":
                m = _METHOD.match(line)
                hit = (m, "method") if m and m[1] not in _KEYWORDS else None
            elif inner[2] in ("impl", "interface") and language == "rust":
                m = _COMPILED["rust"][0][0].match(line)
                hit = (m, "method") if m else None
            if language == "rust" and hit is None and (m := re.match(r"\s*impl(?:<[^>]*>)?\s+(?:([\w:]+)(?:<[^>]*>)?\s+for\s+)?(\w+)", line)):
                q = f"{path}::{m[2]}"
                if m[1]:
                    out.edge(q, f"{path}::{m[1].rsplit(':', 1)[-1]}", "type_ref", i)
                if i in ends:
                    stack.append((ends[i], q, "impl"))
                continue
            if hit is None and inner is not None and i > body and i < inner[0]:
                hit = next(((m, k) for of, p, k in _MEMBERS[language] if of == inner[2] and (m := p.match(line)) and m[1] not in _KEYWORDS), None)
            if hit is None:
                continue
            m, kind = hit
            name, end = m[1], ends.get(i, i)
            exported = line.lstrip().startswith("export") if language == "typescript" else name[:1].isupper() if language == "go" else line.lstrip().startswith("pub")
            parent = inner[1] if inner else None
            if language == "go" and kind == "method":
                recv = re.match(r"\s*func\s+\(\s*\w*\s*\*?(\w+)", line)
                parent = f"{path}::{recv[1]}" if recv else None
            if parent and language == "typescript":
                exported = next((s[4] for s in out.symbols if s[1] == parent), exported)
            above = i - 2
            note = []
            while above >= 0 and re.match(r"\s*(?://|/\*|\*)", source[above]):
                note.insert(0, source[above].strip())
                above -= 1
            q = out.symbol(name, kind, exported, i, end, parent, source[i - 1].strip().rstrip("{").strip(), "\n".join(note) or None, "export" if exported else None)
            if kind in ("function", "method"):
                body = max(body, end)
                for k in range(i, end + 1):
                    for c in _CALL.finditer(lines[k - 1]):
                        if c[1] not in _KEYWORDS and not (k == i and c[1] == name):
                            out.edge(q, f"{path}::{c[1]}", "calls", k)
            if kind == "class" and (x := re.search(r"\bextends\s+([\w$]+)", line)):
                out.edge(q, f"{path}::{x[1]}", "extends", i)
            if kind in ("class", "module", "interface") and end > i:
                stack.append((end, q, kind))
        number = line_numbers(text)
        for m in _IMPORT[language].finditer(text):
            k = m.lastindex  # the pattern may start on a blank line before
            out.imports.append((path, m[k], number(m.start(k))))
        return out

    return run


#: Extractors by language; the one place to plug in others.
REGISTRY: dict[str, Callable[[str, str], Found]] = {"python": python, "typescript": braced("typescript"), "javascript": braced("typescript"), "go": braced("go"), "rust": braced("rust")}

_CLIENT = re.compile(r"\b(?:axios|http|client|api)\.(get|post|put|patch|delete)\s*\(\s*[`'\"]([^`'\"]+)|\bfetch\s*\(\s*[`'\"]([^`'\"]+)[`'\"](?:\s*,\s*\{[^}]*method\s*:\s*['\"](\w+))?", re.I)
_SERVER = re.compile(r"\b(?:app|router|r|mux|server|group|g|e)\.(get|post|put|patch|delete|handlefunc|handle|any)\s*\(\s*[\"'`](/[^\"'`]*)", re.I)


def endpoints(text: str | None) -> list[tuple[str, str | None, str, int]]:
    """(path pattern, method or null, role, line) of HTTP calls and routes in a text."""
    out = []
    line = line_numbers(text or "")
    for m in _CLIENT.finditer(text or ""):
        out.append((m[2] or m[3], (m[1] or m[4] or "GET").upper(), "client", line(m.start())))
    for m in _SERVER.finditer(text or ""):
        verb = m[1].upper()
        out.append((m[2], None if verb in ("HANDLEFUNC", "HANDLE", "ANY") else verb, "server", line(m.start())))
    return sorted(out, key=lambda e: e[3])


def fingerprint(signature: str, name: str) -> str:
    """Name with the number of parameters and of results of a Go signature."""
    rest = signature.split(name, 1)[1] if name in signature else ""
    parts, depth, cur = [], 0, ""
    for c in rest.strip():
        depth += (c in "([{") - (c in ")]}")
        cur += c
        if depth == 0 and c == ")":
            parts.append(cur.strip())
            cur = ""
    tail = cur.strip()

    def count(group: str) -> int:
        inner, d, n = group[1:-1].strip(), 0, 1
        for c in inner:
            d += (c in "([{") - (c in ")]}")
            n += c == "," and d == 0
        return n if inner else 0

    params = count(parts[0]) if parts else 0
    results = count(parts[1]) if len(parts) > 1 else int(bool(tail))
    return f"{name}/{params}/{results}"


def _run(b: pd.DataFrame) -> list[Found]:
    return [REGISTRY[lang](p, t or "") for p, lang, t in zip(b["path"], b["language"], b["content"]) if lang in REGISTRY]


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of (path, language, content) with ids by path, kind and qualified name."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([s for f in _run(b) for s in f.symbols], columns=[x.split()[0] for x in SYMBOLS.split(", ")])

    rows = files.select("path", "language", "content").mapInPandas(go, SYMBOLS)
    return rows.withColumn("stable_id", F.substring(F.sha2(F.concat_ws(":", "path", "kind", "qualified_name"), 256), 1, 32))


def edges(files: DataFrame) -> DataFrame:
    """Edges between qualified names; a target outside the file keeps its local name and joins nothing."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([e for f in _run(b) for e in f.edges], columns=[x.split()[0] for x in EDGES.split(", ")])

    return files.select("path", "language", "content").mapInPandas(go, EDGES)


def imports(files: DataFrame) -> DataFrame:
    """(path, import_path, line)."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([i for f in _run(b) for i in f.imports], columns=["path", "import_path", "line"])

    return files.select("path", "language", "content").mapInPandas(go, "path string, import_path string, line int")


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports joined to the files they name: (path, import_path, line, target), null if external.

    A relative path is made absolute by dropping "." and ".." parts, then tried with the usual
    endings by one equi-join on the path without its ending.
    """
    base = F.regexp_replace("path", "/?[^/]*$", "")
    joined = F.concat_ws("/", F.when(base != "", base), F.regexp_replace("import_path", r"\.(js|ts|tsx|jsx)$", ""))
    parts = F.filter(F.split(joined, "/"), lambda x: (x != ".") & (x != ""))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    keyed = found.withColumn("k", F.when(F.col("import_path").startswith("."), F.array_join(walked, "/")))
    known = files.select(F.col("path").alias("target"), F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/index$", "").alias("k")).groupBy("k").agg(F.min("target").alias("target"))
    return keyed.join(known, "k", "left").drop("k")


def go_dispatch(symbols: DataFrame) -> DataFrame:
    """``interface_dispatch`` of extracted symbols (path, stable_id, name, kind, qualified_name, parent, signature)."""
    kinds = symbols.select("path", F.col("qualified_name").alias("parent"), F.col("kind").alias("parent_kind")).distinct()
    m = symbols.where(F.col("path").endswith(".go") & (F.col("kind") == "method")).join(kinds, ["path", "parent"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["fingerprint"] = [fingerprint(s or "", n) for s, n in zip(b["signature"], b["name"])]
            yield b[["path", "stable_id", "parent_kind", "fingerprint"]]

    rows = m.select("path", "stable_id", "parent_kind", "name", "signature").mapInPandas(run, "path string, stable_id string, parent_kind string, fingerprint string")
    return interface_dispatch(rows)


def interface_dispatch(symbols: DataFrame) -> DataFrame:
    """(source, target) dispatches_to edges of Go: interface methods to same-file methods with one fingerprint.

    ``symbols`` has (path, stable_id, parent_kind, fingerprint) of methods.
    """
    i = symbols.where(F.col("parent_kind") == "interface").select("path", "fingerprint", F.col("stable_id").alias("source"))
    m = symbols.where(F.col("parent_kind") != "interface").select("path", "fingerprint", F.col("stable_id").alias("target"))
    return i.join(m, ["path", "fingerprint"]).select("source", "target").distinct()
