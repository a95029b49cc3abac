"""What a source text refers to: names used, names imported, and types of local variables.

Nothing is resolved here; ``operators/resolution.py`` joins these rows with symbols. Scopes
name where an imported name is defined: a path without its ending, or ``go:`` and an import
path, which only the module table can place.
"""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from strataline.functions.text import line_numbers
from strataline.sources import extract

SCHEMA = "what string, path string, owner string, name string, receiver string, kind string, line int, col int, scope string"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]
_ENDING = re.compile(r"\.(?:d\.ts|\w+)$")


def file_scope(path: str) -> str:
    """A path without ending, and without the name a directory's own module has."""
    return re.sub(r"(?:^|/)(?:index|__init__|mod)$", "", _ENDING.sub("", path))


class Uses:
    """References, bindings and typed variables of one file."""

    def __init__(self, path: str, found: extract.Found):
        self.path = path
        self.rows: list[tuple] = []
        # innermost symbols last
        self.spans = sorted(((s[6], s[7], s[1], s[3]) for s in found.symbols if s[3] in ("function", "method", "class", "interface", "type")), key=lambda s: (s[0], -s[1]))

    def owner(self, line: int) -> str | None:
        held = None
        for start, end, q, _ in self.spans:
            if start > line:
                break
            if line <= end:
                held = q
        return held

    def ref(self, kind: str, name: str, receiver: str | None, line: int, col: int, owner: str | None = None) -> None:
        owner = owner or self.owner(line)
        if owner:
            self.rows.append(("ref", self.path, owner, name, receiver, kind, line, col, None))

    def bind(self, local: str, imported: str, scope: str, line: int) -> None:
        """``imported`` is a name of the scope, or * for the scope itself."""
        self.rows.append(("bind", self.path, None, local, imported, None, line, None, scope))

    def typed(self, variable: str, type_name: str, line: int, package: str | None = None) -> None:
        owner = self.owner(line)
        if owner:
            self.rows.append(("typed", self.path, owner, variable, type_name, package, line, None, None))


def _python(path: str, text: str, found: extract.Found) -> list[tuple]:
    out = Uses(path, found)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    here = posixpath.dirname(path)

    def scopes(module: str, level: int) -> list[str]:
        if level:
            base = here
            for _ in range(level - 1):
                base = posixpath.dirname(base)
            return [posixpath.join(base, module.replace(".", "/")).rstrip("/")]
        top = module.replace(".", "/")
        return list(dict.fromkeys([top, posixpath.join(path.split("/")[0], top)]))

    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom):
            for scope in scopes(n.module or "", n.level):
                for a in n.names:
                    out.bind(a.asname or a.name, a.name, scope, n.lineno)
                    out.bind(a.asname or a.name, "*", f"{scope}/{a.name}".lstrip("/"), n.lineno)
        elif isinstance(n, ast.Import):
            for a in n.names:
                for scope in scopes(a.name, 0):
                    out.bind(a.asname or a.name.split(".")[0], "*", scope, n.lineno)
        elif isinstance(n, ast.Call):
            f = n.func
            if isinstance(f, ast.Name):
                out.ref("calls", f.id, None, n.lineno, f.col_offset)
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                out.ref("calls", f.attr, f.value.id, n.lineno, f.col_offset)
            for a in [*n.args, *(k.value for k in n.keywords)]:
                if isinstance(a, ast.Name):
                    out.ref("passed_as", a.id, None, a.lineno, a.col_offset)
        elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and id(n) not in called:
            out.ref("field_access", n.attr, n.value.id, n.lineno, n.col_offset)
        elif isinstance(n, ast.ClassDef):
            for b in n.bases:
                if isinstance(b, ast.Name):
                    out.ref("extends", b.id, None, n.lineno, b.col_offset)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            args = [*n.args.posonlyargs, *n.args.args, *n.args.kwonlyargs]
            for a in args:
                if isinstance(a.annotation, ast.Name):
                    out.ref("type_ref", a.annotation.id, None, n.lineno, a.col_offset)
                    out.rows.append(("typed", path, out.owner(n.lineno), a.arg, a.annotation.id, None, n.lineno, None, None))
            if isinstance(n.returns, ast.Name):
                out.ref("type_ref", n.returns.id, None, n.lineno, n.returns.col_offset)
        if isinstance(n, ast.Assign) and isinstance(n.value, ast.Call) and isinstance(n.value.func, ast.Name):
            for t in n.targets:
                if isinstance(t, ast.Name):
                    out.typed(t.id, n.value.func.id, n.lineno)
    return out.rows


# Words that are no names of functions or types
_WORDS = frozenset("if for while switch catch return function func fn match loop else new typeof await super import in of instanceof case throw delete void yield let const var mut as true false null undefined this self None Some Ok Err nil string number boolean any unknown never int bool error byte".split())
_CALL = re.compile(r"(?<![\w$.])(?:([\w$]+)(?:\.|::))?([A-Za-z_$][\w$]*)\s*(?:<[^<>()]*>)?\(")
_NEW = re.compile(r"\bnew\s+(?:([\w$]+)\.)?([A-Za-z_$][\w$]*)")
_LITERAL = re.compile(r"(?<![\w.])&?(?:(\w+)\.)?([A-Z]\w*)\s*\{")
_ARGUMENT = re.compile(r"(?<=[(,])\s*(?:([\w$]+)\.)?([A-Za-z_$][\w$]*)\s*(?=[,)])")
_FIELD = re.compile(r"(?<![\w$.])([\w$]+)\.([A-Za-z_$][\w$]*)\b(?!\s*[(<.])")
_TYPE = re.compile(r"(?:[:|<&,]|\bas\b|->)\s*(?:readonly\s+|&|\*|\[\])*\s*([A-Z][\w$]*)(?!\s*[({:.])")
_HERITAGE = re.compile(r"\b(?:class|interface)\s+[\w$]+(?:<[^{]*?>)?(?:\s+extends\s+([\w$.,\s<>]+?))?(?:\s+implements\s+([\w$.,\s<>]+?))?\s*\{")
_VARIABLE = {
    "script": re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::\s*[\w$<>]+\s*)?=\s*new\s+(?:([\w$]+)\.)?([\w$]+)|([\w$]+)\s*:\s*()([A-Z][\w$]*)\s*(?=[,)=;])"),
    "go": re.compile(r"\b(\w+)\s*:?=\s*&?(?:(\w+)\.)?(?:New|Make)?([A-Z]\w*)\s*[({]|\b(\w+)\s+\*?(?:(\w+)\.)?([A-Z]\w*)\s*[,)]"),
    "rust": re.compile(r"\blet\s+(?:mut\s+)?(\w+)\s*(?::\s*\w+\s*)?=\s*()([A-Z]\w*)::|\b(\w+)\s*:\s*&?(?:mut\s+)?()([A-Z]\w*)\s*(?=[,)=])"),
}
_NAMED = re.compile(r"\b(?:import|export)\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+([\w$]+))?\s*from\s*['\"]([^'\"]+)['\"]", re.S)
_REQUIRE = re.compile(r"\b(?:const|let|var)\s+(?:([\w$]+)|\{([^}]*)\})\s*=\s*(?:await\s+import|require)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)")
_GO_IMPORT = re.compile(r"^\s*(?:import\s+)?(?:([\w.]+)\s+)?\"([\w./-]+)\"\s*$", re.M)
_USE = re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+)(?:::\{([^}]*)\})?(?:\s+as\s+(\w+))?", re.M)
_FAMILY = {"typescript": "script", "javascript": "script", "go": "go", "rust": "rust"}


def script_scope(path: str, target: str, aliases: dict[str, str]) -> str | None:
    """Scope of a relative import, or of one that starts with a configured alias."""
    if target.startswith("."):
        return file_scope(posixpath.normpath(posixpath.join(posixpath.dirname(path), re.sub(r"\.(?:js|ts|tsx|jsx|mjs)$", "", target))) + ".x")
    for prefix in sorted(aliases, key=len, reverse=True):
        if target.startswith(prefix):
            return file_scope(posixpath.normpath(aliases[prefix] + target[len(prefix) :]) + ".x")
    return None


def _list(names: str) -> Iterator[tuple[str, str]]:
    """(imported, local) of a list in braces."""
    for part in names.split(","):
        words = re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^\s*type\s+", "", part).strip())
        if words[0]:
            yield words[0].strip(), words[-1].strip()


def _bindings(out: Uses, family: str, text: str, aliases: dict[str, str]) -> None:
    number = line_numbers(text)
    line = lambda m: number(m.start(m.lastindex or 0))
    path = out.path
    if family == "script":
        for m in _NAMED.finditer(text):
            scope = script_scope(path, m[4], aliases)
            if scope is None:
                continue
            if m[1]:
                out.bind(m[1], "default", scope, line(m))
            for imported, local in _list(m[2] or ""):
                out.bind(local, imported, scope, line(m))
            if m[3]:
                out.bind(m[3], "*", scope, line(m))
        for m in _REQUIRE.finditer(text):
            scope = script_scope(path, m[3], aliases)
            if scope is not None:
                for imported, local in [("*", m[1])] if m[1] else _list(m[2]):
                    out.bind(local, imported, scope, line(m))
    elif family == "go":
        for m in _GO_IMPORT.finditer(text):
            last = next((x for x in reversed(m[2].split("/")) if not re.fullmatch(r"v\d+", x)), m[2])
            if m[1] not in ("_", "."):
                out.bind(m[1] or last, "*", "go:" + m[2], line(m))
    else:
        root = path[: path.rfind("/src/") + 4] if "/src/" in path else "src" if path.startswith("src/") else posixpath.dirname(path)
        for m in _USE.finditer(text):
            parts = [x for x in m[1].split("::") if x]
            names = [(x, y) for x, y in _list(m[2])] if m[2] else [(parts[-1], m[3] or parts[-1])]
            head = parts if m[2] else parts[:-1]
            base = {"crate": root, "self": file_scope(path), "super": posixpath.dirname(file_scope(path))}.get(head[0] if head else "", None)
            if base is None:
                continue
            scope = "/".join([base, *head[1:]]).strip("/")
            for imported, local in names:
                out.bind(local, imported, scope, line(m))
                out.bind(local, "*", f"{scope}/{imported}", line(m))


def _braced(language: str, path: str, text: str, found: extract.Found, aliases: dict[str, str]) -> list[tuple]:
    family = _FAMILY[language]
    out = Uses(path, found)
    _bindings(out, family, text, aliases)
    code = extract._BLANK.sub(lambda m: "".join(c if c == "\n" else " " for c in m[0]), text)
    number = line_numbers(code)
    heads = {(s[6], s[2]) for s in found.symbols}
    for m in _HERITAGE.finditer(code) if family == "script" else ():
        at = number(m.start())
        for group, kind in ((m[1], "extends"), (m[2], "type_ref")):
            for name in re.sub(r"<[^<>]*>", "", group or "").split(","):
                if name.strip():
                    out.ref(kind, name.strip().rsplit(".", 1)[-1], None, at, 0)
    for i, line in enumerate(code.split("\n"), 1):
        if re.match(r"\s*(?:import\b|use\b|package\b|export\s*\{|export\s+\*)", line):
            continue
        fresh = set()
        for m in _NEW.finditer(line):
            out.ref("instantiates", m[2], m[1], i, m.start(2))
            fresh.add(m.start(2))
        if family != "script":
            for m in _LITERAL.finditer(line):
                if not re.search(r"\b(?:type|struct|enum|trait|impl|interface|fn|func)\b", line[: m.start()]):
                    out.ref("instantiates", m[2], m[1], i, m.start(2))
        for m in _CALL.finditer(line):
            if m[2] not in _WORDS and m.start(2) not in fresh and (i, m[2]) not in heads and not re.search(r"\b(?:function|func|fn)\s*$", line[: m.start(2)]):
                out.ref("calls", m[2], m[1], i, m.start(2))
        for m in _ARGUMENT.finditer(line):
            if m[2] not in _WORDS and not any(start == i for start, *_ in out.spans):
                out.ref("passed_as", m[2], m[1], i, m.start(2))
        for m in _FIELD.finditer(line):
            out.ref("field_access", m[2], m[1], i, m.start(2))
        for m in _TYPE.finditer(line):
            out.ref("type_ref", m[1], None, i, m.start(1))
        for m in _VARIABLE[family].finditer(line):
            g = m.groups()
            var, package, name = g[:3] if g[0] else g[3:]
            if var and name:
                out.typed(var, name, i, package or None)
    return out.rows


def uses(path: str, language: str, text: str, aliases: dict[str, str] | None = None) -> list[tuple]:
    """Rows (what, path, owner, name, receiver, kind, line, col, scope) of one source text.

    ``ref``: ``owner`` uses ``name``, perhaps of ``receiver``. ``bind``: ``name`` stands for
    ``receiver`` (a name, or * for all) of ``scope``. ``typed``: in ``owner`` the variable
    ``name`` holds a ``receiver``, perhaps of the package ``kind``.
    """
    if language not in extract.REGISTRY or not text:
        return []
    found = extract.REGISTRY[language](path, text)
    rows = _python(path, text, found) if language == "python" else _braced(language, path, text, found, aliases or {}) if language in _FAMILY else []
    return list(dict.fromkeys(rows))


def table(files: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """``uses`` of all rows of (path, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, lang, t in zip(b["path"], b["language"], b["content"]) for r in uses(p, lang, t or "", aliases)], columns=_COLUMNS)

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)
