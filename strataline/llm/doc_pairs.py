"""Functions paired with their documentation (problem 1).

Comment, signature and balanced body are captured together from the source texts by recursive
patterns of the ``regex`` library; symbols whose source text is not at hand, or does not
reach as far as the symbol, are taken from their stored columns. Strings and comments inside a body are consumed as units, so braces and
quotes within them do not unbalance it; all repetitions are possessive, so a match takes
time linear in the text and very long texts do not backtrack.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- patterns

_DEFINE = r"""
(?(DEFINE)
  (?P<str> "(?:[^"\\\n]++|\\.)*+" | QUOTED | `(?:[^`\\]++|\\.)*+` )
  (?P<tri> \"{3}(?:[^"\\]++|\\.|"(?!""))*+\"{3} | '{3}(?:[^'\\]++|\\.|'(?!''))*+'{3} )
  (?P<blk> /\*(?:[^*]++|\*(?!/))*+\*/ )
  (?P<lin> //[^\n]*+ )
  (?P<par> \( (?:[^()"'`/]++|(?&str)|(?&blk)|(?&lin)|(?&par)|['"`/])*+ \) )
  (?P<sq>  \[ (?:[^\[\]"'`/]++|(?&str)|(?&blk)|(?&lin)|(?&sq)|['"`/])*+ \] )
  (?P<ang> < (?:[^<>(){};=]++|(?&ang)|(?&par)|=>|->)*+ > )
  (?P<cur> \{ (?:[^{}"'`/]++|(?&str)|(?&blk)|(?&lin)|(?&cur)|['"`/])*+ \} )
)
"""
_STRING = r"'(?:[^'\\\n]++|\\.)*+'"
#: One character in quotes; a single quote without its other one is a lifetime, not a string.
_CHARACTER = r"'(?:[^'\\\n]|\\[^\n']{1,10})'"

_LEAD = r"""
(?P<doc> [ \t]*+ (?&blk) [ \t]*+ \n | (?: [ \t]*+ //[^\n]*+ \n )++ ) (*SKIP)
(?: [ \t]*+ [@#]\[?[^\n]*+ \n )*+
(?P<pad> [ \t]*+)
"""

_FLAGS = regex.V1 | regex.VERBOSE | regex.MULTILINE | regex.DOTALL

# Words that open a statement, not a function
_NOT_NAMES = "if|for|while|switch|catch|return|else|do|try|with|new|typeof|await|throw|match|loop|select|case|super"

_TYPE = r"(?: [ \t]*+ : [ \t]*+ (?: [\w$.|& \t]++ | (?&ang) | (?&sq) | (?&par) | \{[^{}\n;]*+\}(?=[^\n]*\{) )++ )"
_HEADS = {
    "script": rf"""(?P<sig>
        (?:(?:export|default|async|public|private|protected|static|override|readonly|abstract|declare|get|set)[ \t]++)*+
        (?: (?:const|let|var)[ \t]++ (?P<name>[\w$]++) {_TYPE}?+ [ \t]*+ = [ \t]*+ (?:async[ \t]++)?+ (?:function\b\*?+[ \t]*+[\w$]*+)?+
          | function\b\*?+ [ \t]*+ (?P<name>[\w$]++) | (?P<name>(?!(?:{_NOT_NAMES})\b)[\w$]++) )
        [ \t]*+ (?&ang)?+ [ \t]*+ (?&par) (?P<type>{_TYPE})?+ (?:[ \t]*+ =>)?+ )""",
    "go": r"""(?P<sig> (?P<type>func) [ \t]++ (?:(?&par)[ \t]*+)?+ (?P<name>\w++) [ \t]*+ (?&sq)?+ (?&par)
        (?: [ \t]*+ (?: (?&par) | (?&sq) | (?:interface|struct)\{\} | [\w.*]++ | <-)++ )*+ )""",
    "rust": r"""(?P<sig> (?:(?:pub(?:\([^()]*\))?|async|const|unsafe|extern|default)[ \t]++)*+ (?P<type>fn) [ \t]++ (?P<name>\w++)
        [ \t]*+ (?&ang)?+ (?&par) (?:[ \t\n]*+ -> [^{};\n]++)?+ (?: \s where [^{};]++ )?+ )""",
    "c": rf"""(?P<sig> (?:(?!(?:{_NOT_NAMES})\b)[\w$.:]++ (?&ang)?+ (?:\[\]|[*&?])*+ [ \t\n*&]++)++ (?P<name>[\w$~]++) [ \t]*+ (?&par) (?P<type>)
        (?: \s*+ (?:const\b|noexcept\b|override\b|final\b|throws \s++ [\w.]++ (?: \s*+ , \s*+ [\w.]++ )*+) )*+ )""",
}
#: A balanced body, or the end of the line where the head alone shows a declaration.
_BODY = r"(?: \s*+ (?P<body>(?&cur)) | (?(type) [ \t]*+ ;?+ [ \t]*+ (?=\n|\Z) | (?!) ) )"

_BRACED = {k: regex.compile(_DEFINE.replace("QUOTED", _CHARACTER if k == "rust" else _STRING) + "^" + _LEAD + v + _BODY, _FLAGS) for k, v in _HEADS.items()}

_PYTHON = regex.compile(
    _DEFINE.replace("QUOTED", _STRING)
    + r"""^(?P<doc> (?: [ \t]*+ \#[^\n]*+ \n )++ )?+
    (?: [ \t]*+ @[^\n]*+ \n )*+
    (?P<pad>[ \t]*+)
    (?P<sig> (?:async[ \t]++)?+ def [ \t]++ (?P<name>\w++) [ \t]*+ (?&par) (?:[ \t]*+ -> [^:\n]++)?+ ) [ \t]*+ :
    (?P<body> [^\n]*+ (?: \n (?: [ \t]*+ (?=\n|\Z) | (?P=pad)[ \t]++ (?: (?&tri) | [^\n"'] | (?&str) | ["'] )*+ ) )*+ )""",
    _FLAGS,
)
_DOCSTRING = regex.compile(r"\s*+(?P<q>\"{3}|'{3})(?P<doc>.*?)(?P=q)", regex.DOTALL | regex.V1)

# Languages of files by the shape of their functions
FAMILY = {"typescript": "script", "javascript": "script", "tsx": "script", "jsx": "script", "go": "go", "rust": "rust", "python": "python"} | dict.fromkeys(("java", "c", "cpp", "c++", "csharp", "c#", "kotlin", "scala"), "c")


def capture(text: str | None, language: str | None) -> list[tuple[str, str, str, str]]:
    """(name, signature, comment, body) of each documented function of a source text.

    An unknown language is tried as a script and as a language with types before names. A
    function cut off by the end of the text has no balanced body and is left out; one that
    is only declared (with a return type, ``func`` or ``fn``) has an empty one. Nested
    functions are found as well.
    """
    if not text:
        return []
    family = FAMILY.get((language or "").lower())
    out: list[tuple[str, str, str, str]] = []
    seen: set[tuple[str, str, str]] = set()
    inner = [text]
    while inner:
        part = inner.pop()
        if family == "python":
            for m in _PYTHON.finditer(part):
                own = _DOCSTRING.match(m["body"])
                doc = own["doc"] if own else m["doc"]
                if doc:
                    out.append((m["name"], m["sig"].strip(), doc, m["body"]))
                if "def" in m["body"]:
                    inner.append(m["body"])
            continue
        closed = part.rfind("*/") + 2 if "*/" in part else 0  # no block comment opens behind the last end of one
        part = part[:closed] + part[closed:].replace("/*", "/ ")
        for kind in (family,) if family else ("script", "c"):
            for m in _BRACED[kind].finditer(part):
                body = m["body"] or ""
                found = (m["name"], m["doc"], body)
                if found not in seen:
                    seen.add(found)
                    out.append((m["name"], m["sig"].strip(), m["doc"], body))
                    if "/*" in body or "//" in body:
                        inner.append(body[1:])
    return out


# ---------------------------------------------------------------- comments

_MARKS = regex.compile(r"^[ \t]*+(?:/\*[*!]?|\*+/|\*(?!\*)|//[/!]?|\#+!?|--(?=\s)|;+(?=\s)|\"{3}|'{3}|<!--)[ \t]?|[ \t]*(?:\*+/|\"{3}|'{3}|-->)[ \t]*$", regex.M)
_WORDS = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{Lo}+|\p{N}+")
_BRACED_TAG = regex.compile(r"\{@\w+[^{}]*\}")
# Tags that document a name (and perhaps a type), a type, or nothing
_NAMED = regex.compile(r"^[@\\:](?:param|parameter|arg|argument|key|keyword|ivar|cvar|var|tparam|typeparam|template|prop|property|raises?|throws|exception|type|see|seealso|link|member|name|function|method|memberof|alias)\b:?\s*(?:\{[^{}]*\}\s*)?(?:\[?[\w$.*&]+(?:=[^\]\s]*)?\]?:?(?:\s+[\w.\[\], |]+(?=:))?:?)?\s*(?:\([^()]*\):?)?\s*[-:–—]*\s*(?P<rest>.*)$", regex.I)
_VALUED = regex.compile(r"^[@\\:](?:returns?|rtype|yields?|ytype|result)\b:?\s*(?:\{[^{}]*\}\s*)?[-:–—]*\s*(?P<rest>.*)$", regex.I)
_TYPE_ONLY = regex.compile(r"^(?:void|any|none|null|nil|undefined|unknown|never|self|this|bool(?:ean)?|int(?:eger)?|float|double|number|str(?:ing)?|bytes?|object|array|list|dict|map|set|tuple|error|[iuf](?:8|16|32|64)|usize|(?:\w+(?:\.\w+)*)?\s*[<\[(].*[>\])])[?|.\s]*$", regex.I)
_BARE_TAG = regex.compile(r"^[@\\](?:inheritdoc|override|overrides|internal|public|private|protected|package|static|abstract|final|virtual|readonly|async|deprecated|hidden|ignore|api|beta|alpha|experimental|nocollapse|constructor|class|export|test|author|since|version|todo|generated|suppress\w*|ts-\w+)\b[^\p{L}]*$", regex.I)
# Instructions to tools
_TOOL = regex.compile(r"^(?:(?:eslint|jshint|jslint|tslint|stylelint|lint|xo|oxlint|biome|flake8|pylint|pyright|mypy|ruff|pyre|isort|black|yapf|fmt|prettier|clang-format|clang-tidy|rustfmt|gofmt|golint|golangci|staticcheck|istanbul|c8|v8|coverage|codecov|sonar|nosonar|webpack\w*|vite|rollup|babel|flow|autopep8|spell-?check(?:er)?|cspell|codespell|markdownlint|standard|phpcs|psalm|phpstan|rubocop|checkstyle|detekt|ktlint|swiftlint|editorconfig|dprint|deno|nyc|bandit|semgrep|pragma|type|noinspection|resharper|region|endregion|go|line|cgo|language|vim?|mode|kate|global|globals|exported|jscs)[-:]\S.*|(?:eslint|prettier|istanbul|c8|v8|coverage|fmt|yapf|clang-format)\b[-: ]+(?:ignore|disable|enable|off|on|skip|next).*|(?:type|pyright|mypy|coverage|ruff|lint|biome|istanbul)[: ]+ignore\b.*|pragma\b:?.*|no(?:qa|lint|sec|sonar|inspection|pragma)\b.*|@?ts-(?:ignore|expect-error|nocheck|check)\b.*|use strict|#?(?:end)?region\b.*|allow\([\w:, ]+\))\.?$", regex.I)
# placeholders
_PLACE = regex.compile(r"^(?:(?:todo|fixme|xxx|hack|tbd|wip|tba|note)\b[\s:!.-]*(?:(?:please\s+)?(?:add|write|fill(?:\s+in)?|insert|complete|improve|update|document|describe)?\s*(?:me|this|it|here|the)?\s*(?:docs?|documentation|docstring|description|comments?|function|method|text|later)?(?:\s+(?:here|later|this|me|string))?)|n\s*/\s*a|none|null|nil|nothing|empty|blank|undocumented|not\s+documented|tb[da]|to\s+be\s+(?:documented|done|defined|written|added)|(?:no|missing|add|insert|enter|your|some|a)?\s*(?:short\s+|brief\s+)?(?:description|documentation|docs?|docstring|comments?|summary)(?:\s+(?:here|goes\s+here|available|provided|yet|needed|missing))*|placeholder|lorem\s+ipsum.*|document\s+(?:me|this)|fill\s+(?:me\s+)?in|self[- ]explanatory|see\s+(?:above|below|name|code)|\?+|foo|bar|test|text\s+here)[\s.!:;,-]*$", regex.I)
# Words that add nothing to a restated name
_FILLER = frozenset("a an the this that these is are it its of for to in on and or with by from as does do will function method fn func def procedure routine helper constructor class returns return get gets set sets called named implementation implements die der das den dem diese dieser dieses funktion methode von la el los las esta este un una funcion metodo de del le les cette fonction une du эта этот функция метод see".split())
# Headings of sections that list names
_HEADING = regex.compile(r"^(?:args|arguments|parameters|params|returns?|yields?|raises|throws|attributes|notes?|examples?)\s*:?\s*$|^#+\s*(?:arguments|parameters|returns|errors|panics|safety|examples?)\s*$", regex.I)


def strip_marks(comment: str) -> str:
    """The text of a comment without its comment marks."""
    lines = _MARKS.sub("", _MARKS.sub("", comment.replace("\r\n", "\n"))).split("\n")
    return "\n".join(x.strip() for x in lines).strip()


def _stems(w: str) -> set[str]:
    """Spellings of a word under English inflection, for comparing with a name's words."""
    w = w.casefold()
    out = {w}
    for end in ("s", "es", "ed", "d", "ing", "er", "ers", "'s"):
        if w.endswith(end) and len(w) > len(end) + 1:
            base = w[: -len(end)]
            out |= {base, base + "e"}
            if len(base) > 2 and base[-1] == base[-2]:
                out.add(base[:-1])
            if base.endswith("i"):
                out.add(base[:-1] + "y")
    return out


def describes(name: str | None, comment: str | None) -> bool:
    """Whether a comment tells something about the symbol ``name``.

    It does not if, marks aside, all its lines are blank, decoration, instructions to
    tools, placeholders, tags without a description, or restate the name or its words.
    A null comment tells nothing; with a null name nothing can be restated.
    """
    if not comment:
        return False
    text = _BRACED_TAG.sub(" ", strip_marks(comment))
    kept = []
    for line in text.split("\n"):
        line = line.strip().lstrip("*").strip()
        if not any(c.isalnum() for c in line) or _HEADING.match(line) or _TOOL.match(line) or _BARE_TAG.match(line) or _PLACE.match(line):
            continue
        m = _VALUED.match(line)
        if m:
            line = m["rest"].strip()
            if not line or _TYPE_ONLY.match(line):
                continue
        else:
            m = _NAMED.match(line)
            if m:
                line = m["rest"].strip()
        if any(c.isalnum() for c in line) and not _PLACE.match(line) and not _TOOL.match(line):
            kept.append(line)
    if not kept:
        return False
    words = [w.casefold() for w in _WORDS.findall(" ".join(kept))]
    own: set[str] = set()
    for w in _WORDS.findall(name or ""):
        own |= _stems(w)
    own.add((name or "").casefold().replace("_", ""))
    return any(not (w in _FILLER and own) and not (_stems(w) & own) for w in words)


# ---------------------------------------------------------------- operators


def _letters(c):
    """A comment's letters and digits: equal however it is marked and laid out."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def captured(docs: DataFrame, with_body: bool = True) -> DataFrame:
    """(file_id, name, signature, doc, body): documented functions captured in the source texts of files.

    ``docs`` needs file_id, text and language; rows without a file or a text have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (fid, name, sig, doc, body if with_body else "")
                for fid, text, language in zip(*(c.to_pylist() for c in b.columns))
                for name, sig, doc, body in capture(text, language)
            ]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64())] + [pa.array(c, pa.string()) for c in cols[1:]], names=["file_id", "name", "signature", "doc", "body"])

    some = docs.where(F.col("file_id").isNotNull() & (F.length("text") > 0)).select(F.col("file_id").cast("long").alias("file_id"), "text", "language")
    return some.mapInArrow(run, "file_id long, name string, signature string, doc string, body string")


def symbol_pairs(symbols: DataFrame, docs: DataFrame, kinds: tuple[str, ...] = ("function", "method"), with_body: bool = True) -> DataFrame:
    """(stable_id, name, kind, signature, description, body, origin) of documented symbols.

    ``symbols`` needs stable_id, file_id, name, kind, signature and doc_comment, ``docs``
    the columns of ``captured``; others are not read. A row is left out if its kind is
    another or null, its stable_id is null, its signature is null or blank, or its comment
    tells nothing (``describes``). A symbol is a function captured in its file's text if
    name and comment are the same, marks and layout aside: origin ``source``, description
    and body as captured. The others have origin ``stored``, the stored comment and a null
    body: their text is not at hand, ends before them, or holds another comment. Repeated
    rows come out once; rows of one stable_id that differ come out each. Symbols and
    captures meet by file, name and comment, so no key of the join holds many rows but by
    repetition, which the distinct before it removes.
    """
    cols = ["stable_id", "file_id", "name", "kind", "signature", "doc_comment"]
    some = symbols.select(*cols).where(
        F.col("kind").isin(*kinds) & F.col("stable_id").isNotNull() & (F.trim("signature") != "") & (F.trim("doc_comment") != "")
    ).distinct()
    found = captured(docs, with_body).withColumn("same", _letters(F.col("doc")))
    found = found.groupBy("file_id", "name", "same").agg(F.min(F.struct("doc", "body")).alias("c"))
    met = some.withColumn("same", _letters(F.col("doc_comment"))).join(found, ["file_id", "name", "same"], "left")
    rows = met.select("stable_id", "name", "kind", "signature", F.coalesce("c.doc", "doc_comment").alias("doc"), "c.body", F.when(F.col("c").isNull(), "stored").otherwise("source").alias("origin"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_, names = b.column("doc").to_pylist(), b.column("name").to_pylist()
            keep = [describes(n, d) for n, d in zip(names, docs_)]
            text = pa.array([strip_marks(d) for d in docs_], pa.string())
            yield b.set_column(4, "description", text).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(told, "stable_id string, name string, kind string, signature string, description string, body string, origin string").distinct()


def source_pairs(docs: DataFrame) -> DataFrame:
    """(doc_id, name, signature, description, body) of the documented functions in source texts.

    ``docs`` needs doc_id, text and language. A null or empty text has none; a language
    that is null or unknown is read as a braced script. Texts are whole, one task row each.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                for name, sig, doc, body in capture(r["text"], r["language"]):
                    if describes(name, doc):
                        rows.append((r["doc_id"], name, sig, strip_marks(doc), body))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64())] + [pa.array(c, pa.string()) for c in cols[1:]], names=["doc_id", "name", "signature", "description", "body"]
            )

    return docs.select("doc_id", "text", "language").mapInArrow(pairs, "doc_id long, name string, signature string, description string, body string")
